import re
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from relata.functions import parse
from relata.functions import text as T
from relata.functions import wikitext


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_redirects(spark):
    assert one(spark, T.redirect(F.lit("#redirect [[foo_bar]]"))) == "Foo bar"
    assert one(spark, T.redirect(F.lit("#REDIRECT "))) is None
    assert one(spark, T.redirect(F.lit("x #REDIRECT [[a]]"))) is None


def test_padding(spark):
    ids = F.array(*[F.lit(k) for k in (1, 2, 3)])
    assert one(spark, T.padded(ids, 5)) == [0, 0, 1, 2, 3]
    assert one(spark, T.padded(ids, 2)) == [2, 3]


def test_rounding(spark):
    assert [one(spark, T.rounded(F.lit(x))) for x in (2.5, -0.4, 7.6)] == [3, 0, 7]


def test_sanitized(spark):
    assert one(spark, T.sanitized(F.lit(float("nan")))) == 0
    assert one(spark, T.sanitized(F.lit(float("inf")))) == 3.4028234663852886e38


def test_sentence_links():
    assert parse.sentence("the [Big_Cat|cat] sat") == ("the cat sat", [{"title": "Big Cat", "span_start": 4, "span_end": 7}])
    text, links = parse.sentence("[A|b [C|d] e]")
    assert text.startswith("b ") and len(links) == 2


def test_paragraphs():
    assert [p["text"] for p in parse.paragraphs("a\nb")] == ["a"]
    page = parse.paragraphs("one [[foo_x|bar]] '''[[b]]''' {{t}}\n== H ==\nmore\n")
    assert page[0]["wiki_links"] == [{"title": "Foo x", "text": "bar", "link_type": "out"}]
    assert page[0]["abstract"] and not page[-1]["abstract"]


def test_redirect_pages_and_broken_texts(spark):
    pages = spark.createDataFrame([("a", "#REDIRECT [[b]]\nx\n"), ("b", "x\n"), ("c", None)], "title string, wiki_text string")
    found = {r["title"]: len(r["paragraphs"]) for r in parse.parse_pages(pages).collect()}
    assert found == {"a": 0, "b": 1, "c": 0}

    def broken(text, keep_last):
        raise ValueError

    assert parse.or_none("x\n", parser=broken) == [] and len(parse.or_none("x\n")) == 1


def test_paragraph_rules():
    page = parse.paragraphs("a [[]] [[|x]] ''it [[y]]'' <!-- z --> &amp; {{t|{{u}}}}b\nc [[File:q.png]]\nlast", keep_last=True)
    assert [p["text"].split() for p in page] == [["a", "it", "y", "b"], ["c", "File:q.png"], ["last"]]
    assert [x["title"] for p in page for x in p["wiki_links"]] == ["File:q.png"]


def test_spans(spark):
    assert parse.token_spans("é a_1, b") == [(0, 1), (2, 5), (7, 8)]
    df = spark.createDataFrame([("x yz",), ("",)], "t string").select(parse.spans("t").alias("s"))
    assert [[tuple(x) for x in r["s"]] for r in df.collect()] == [[(0, 1), (2, 4)], []]


def test_spans_of_a_batch_are_numbers(monkeypatch):
    texts = pa.array(["ab " * 5000, None, "", "é x"] * 100)
    tracemalloc.start()
    found = pa.concat_arrays([x for x in parse.spans.func(iter([texts, texts.slice(0, 0)])) if tracemalloc.get_traced_memory()[1] < 40e6])
    tracemalloc.stop()
    assert len(found) == 400 and len(found[0]) == 5000
    monkeypatch.setattr(parse, "MOST_CHARS", 10_000)
    cut = list(parse.spans.func(iter([texts])))
    assert len(cut) > 100 and pa.concat_arrays(cut).to_pylist() == [[{"start": a, "stop": b} for a, b in parse.token_spans(t)] for t in texts.to_pylist()]


def test_long_lines_with_many_links():
    text, links = parse.sentence("[T|a] " * 2000)
    assert len(links) == 2000 and text == "a " * 1999 + "a"


PAGES = [
    ("a {{t|x}} b {{unclosed\nmore text\nend\n", ["a   b {{unclosed", "more text", "end"], []),
    ("x<ref>Smith 1990, [[Oxford]]</ref> y<ref name=a/>\n", ["x  y "], []),
    ("{|\n| cell [[x]]\n|}\nafter {| no table\n", ["", "after {| no table"], []),
    ("[[File:a.jpg|thumb|A [[cat]] here]]\n", ["thumb|A cat here "], ["File:a.jpg"]),
    ("<b>bold</b> '''''both''''' <nowiki>[[no]]</nowiki>\n", ["bold   both   "], []),
    ("'''''a'' b''' c ''it '''b''''' d '' e\n", ["a b  c  it b  d '' e"], []),
    ("[[a|b {{c]] d}} [[unclosed <b> [[X_y|z]]\n", ["[[a|b   [[unclosed <b>  z "], ["X y"]),
    ("<ref name=x/> z <br> w </p> <div>gone [[g]]</div> <div>kept [[h]]\n", [" z   w </p>   <div>kept  h "], ["H"]),
    ("&nbsp;x &foo; [http://a.b c] http://a.b/c. y <!-- c --> [[x|]] [[|y]] <!-- open\n", ["x &foo;    . y    x    <!-- open"], ["X"]),
    ("* item [[A_b]]\n----\n== H ==\n: in {{{arg|{{x}}}}} {{a{{b}}}} q\n", [" item  A_b ", " ", " ", "  in     q"], ["A b"]),
    ("[[bad\ntitle]] [[a[b]] 5 > 3 < 4\n<gallery>\nFile:x.jpg|[[no]]\n</gallery>\n", ["[[bad", "title]] [[a[b]] 5 > 3 < 4", " "], []),
    ("}} a ]] |} </b> {{ '' x <nowiki> <!--\n", ["}} a ]] |} </b> {{ '' x <nowiki> <!--"], []),
    ("<li>one [[p]]\n<b>[[q|r &amp; s]] {{t}}</b> <math>[[x]]</math>\n", ["one  p ", " r & s    "], ["P"]),
]


def test_markup():
    for text, texts, titles in PAGES:
        page = parse.paragraphs(text)
        got = [re.sub(r"^ +(?=x &foo|one)", "", p["text"]) for p in page]
        assert (got, [x["title"] for p in page for x in p["wiki_links"]]) == (texts, titles), text


def test_broken_markup_in_linear_time():
    began = time.time()
    for bad in ("{{" * 50_000, "[[" * 50_000 + "]]" * 50_000, "<b>" * 50_000, "<b>" * 50_000 + "</b>" * 50_000, "''" * 50_001, "<!--" * 50_000, "<nowiki>" * 50_000, "=" * 50_000, "{|\n" * 50_000, "<i>''" * 50_000, "{{a|" * 20_000 + "}}" * 20_000):
        parse.paragraphs(bad + "\n")
    assert time.time() - began < 60


def test_letters_are_no_begin_of_markup(monkeypatch):
    tried, token = [], wikitext._TOKEN

    class Counted:
        def match(self, text, at):
            tried.append(at)
            return token.match(text, at)

    text = "word, " * 1000 + "[[a|b]] {{x}}\n* y\n" + "z" * 1000
    before = parse.paragraphs(text, True)
    monkeypatch.setattr(wikitext, "_TOKEN", Counted())
    assert parse.paragraphs(text, True) == before and len(before) == 3 and len(tried) < 20
    monkeypatch.undo()
    for text in ("a\n{|x", "see http://x.y z [[b]]", " \t{| q", "a=\n= h =", "&amp;", "--\n----", ""):
        for at in range(len(text) + 1):
            a, b = token.search(text, at), wikitext._next(text, at)
            assert (a and (a.span(), a.groups())) == (b and (b.span(), b.groups()))
