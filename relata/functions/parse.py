"""Parsers that need a loop over one text: wikitext paragraphs, nested sentence links, and places of tokens."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import text as T
from .wikitext import nodes, stripped

LINKS = "array<struct<title: string, text: string, link_type: string>>"
PARAGRAPHS = f"array<struct<text: string, wiki_links: {LINKS}, abstract: boolean>>"
SENTENCES = "sent_id long, text string, wiki_links array<struct<title: string, span_start: int, span_end: int>>"
LOCATED = "sent_id long, words array<string>, links array<struct<entity: string, before: int, after: int>>"
#: Characters of texts whose spans are made at a time, about.
MOST_CHARS = 4 << 20
_LINK = re.compile(r"\[(.+?)\|(.*?)\]")
_TOKEN = regex.compile(T.TOKEN)


def paragraphs(text: str | None, keep_last: bool = False) -> list[dict]:
    """The paragraphs of an article's wikitext, each with its links, and whether it is before the first heading.

    Texts, links' shown texts, and bold and italic texts (whose links are plain text) are joined by spaces, and cut at the line
    ends of texts. What is after the last one is left out, as long as keep_last isn't set. Templates, comments, outer links,
    entities, headings, list marks, tables and all other tags go with their contents. What never closes is text.
    """
    out, pieces, links, abstract = [], [], [], True
    for n in nodes(text or ""):
        if n.kind == "text":
            first, *rest = n.value.split("\n")
            pieces.append(first)
            for line in rest:
                out.append({"text": " ".join(pieces), "wiki_links": links, "abstract": abstract})
                pieces, links = [line], []
        elif n.kind == "heading":
            abstract = False
        elif n.kind == "link" and (title := stripped(n.title)):
            shown = stripped(n.inside) if n.inside else title
            pieces.append(shown)
            links.append({"title": (title[0].upper() + title[1:]).replace("_", " "), "text": shown, "link_type": "out"})
        elif n.kind == "tag" and n.value in ("b", "i") and n.inside:
            pieces.append(stripped(n.inside))
    if keep_last and (pieces and pieces != [""]):
        out.append({"text": " ".join(pieces), "wiki_links": links, "abstract": abstract})
    return out


def sentence(text: str | None) -> tuple[str, list[dict]]:
    """(text with each `[title|anchor]` as its anchor, links with their spans), from left to right, again and again until none
    is left, so that a link whose anchor holds another keeps the span it had when it was found. Nothing before a link that was
    found can be one, so the search goes on where it began."""
    text, links, at = (text or "").rstrip(), [], 0
    while m := _LINK.search(text, at):
        at = m.start()
        text = text[:at] + m[2] + text[m.end() :]
        links.append({"title": m[1].replace("_", " "), "span_start": at, "span_end": at + len(m[2])})
    return text, links


def token_spans(text: str | None) -> list[tuple[int, int]]:
    """(begin, end) of each token, in characters."""
    return [m.span() for m in _TOKEN.finditer(text or "")]


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])))
def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`token_spans` of a column. A batch's places are two numbers for a token, without an object for each, and go on after
    MOST_CHARS characters of texts."""
    for batch in batches:
        for some in _cut(batch):
            places, stops = array("i"), [0]
            for t in some:
                for m in _TOKEN.finditer(t.as_py() or ""):
                    places.extend(m.span())
                stops.append(len(places) // 2)
            both = np.frombuffer(places, np.int32).reshape(-1, 2)
            each = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["start", "stop"])
            yield pa.ListArray.from_arrays(pa.array(stops, pa.int32()), each)


def _cut(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices that end once they have MOST_CHARS characters; no texts are one slice."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + MOST_CHARS)) + 1
        yield texts.slice(at, end - at)
        at = end
    if not len(texts):
        yield texts


def located(text: str, links) -> tuple[list[str], list[dict]]:
    """(the tokens in lower case, for each link the number of tokens that end where it begins or earlier, and the number of the
    first token that begins where it ends or later)."""
    at = token_spans(text)
    starts, stops = [a for a, _ in at], [b for _, b in at]
    words = [text[a:b].lower() for a, b in at]
    return words, [{"entity": x["title"], "before": bisect_right(stops, x["span_start"]), "after": bisect_left(starts, x["span_end"])} for x in links]


def parse_pages(pages: DataFrame, keep_last: bool = False) -> DataFrame:
    """title, paragraphs of pages (title, wiki_text); a redirect page has none, and a text that can't be parsed gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"title": f["title"], "paragraphs": [or_none(t, keep_last) for t in f["wiki_text"]]})

    wanted = F.when(T.redirect(F.col("wiki_text")).isNull(), F.col("wiki_text"))
    return pages.select("title", wanted.alias("wiki_text")).mapInPandas(run, f"title string, paragraphs {PARAGRAPHS}")


def or_none(text: str | None, keep_last: bool = False, parser=None) -> list[dict]:
    """The paragraphs, or none if the parser fails."""
    try:
        return (parser or paragraphs)(text, keep_last)
    except Exception:
        return []


def parse_sentences(lines: DataFrame) -> DataFrame:
    """sent_id, text, wiki_links of lines (sent_id, line)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [sentence(x) for x in f["line"]]
            yield pd.DataFrame({"sent_id": f["sent_id"], "text": [p[0] for p in parsed], "wiki_links": [p[1] for p in parsed]})

    return lines.select("sent_id", "line").mapInPandas(run, SENTENCES)


def locate(sentences: DataFrame) -> DataFrame:
    """LOCATED rows of sentences (sent_id, text, wiki_links): tokens, and where each link stands among them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [located(t or "", [] if x is None else x) for t, x in zip(f["text"], f["wiki_links"])]
            yield pd.DataFrame({"sent_id": f["sent_id"], "words": [w for w, _ in found], "links": [x for _, x in found]})

    return sentences.select("sent_id", "text", "wiki_links").mapInPandas(run, LOCATED)
