"""Edge cases of every operator: nulls, empty and long texts, repeated rows, empty tables, clashing names; and brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.llm import ann, chat, katz, mixing, neardup, ogg, packing, repeats, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, batch string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some(spark):
    base = " ".join(f"word{k}" for k in range(40))
    near = base.replace("word39", "other")
    texts = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \t"), (7, "one two"), (7, "one two"), (8, "ONE two"), (9, LONG), (10, "a b c " + base + " tail"), (None, base), (None, None), (11, "x")]
    return spark.createDataFrame([(i, t, "en", s, 1, "clash", "clash", "clash") for (i, t), s in zip(texts, ["b", "a", None, "a", "b", "c", "a", "a", "c", "b", None, "a", "a", "c"])], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "same", "x"), (2, "u\n", "same", "x"), (3, None, None, "x"), (4, "u", "", "x"), (None, "u", "same", "x"), (2, "u\n", "same", "x"), (5, "u", "y" * 700_000, "x")], "page_id long, url string, html string, digest string")
    found = warc.read_bundles(warc.write_bundles(pages, frame_bytes=64)).collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    assert got == sorted([(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (0, "revisit", 2, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 700_000)], key=lambda x: x)
    b = warc.write_bundles(pages, frame_bytes=64).first()
    assert all(warc.parse(r)[0]["WARC-Type"] for r in warc.find(b["data"], [x.asDict() for x in b["records"]], 2))
    names = [x["record_id"] for row in warc.write_bundles(pages).collect() for x in row["records"]]
    assert len(names) == len(set(names)) == 7
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0


def test_warc_references_hold(spark):
    """Rows dealt anew, as by a repeated task, keep their ids: no revisit names a record that isn't there."""
    from relata.scratch import saved

    base = [(k, f"u{k % 7}", f"same {k % 5}") for k in range(200)] + [(3, "u3", "same 3")] * 3 + [(199, "u3", "same 4")] * 2 + [(None, "u", "same 1")] * 2 + [(199, None, "same 4")]
    pages = spark.createDataFrame(base, "page_id long, url string, html string")
    b = saved(warc.write_bundles(pages.repartition(8), frame_bytes=500), "bundles").collect()
    heads = [warc.parse(warc.frame(r["data"], warc.seek_table(r["data"])[x["frame"]])[x["offset"] :][: x["length"]])[0] for r in b for x in r["records"]]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(set(ids)) == len(base)
    named = {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"}
    responses = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert named and named <= responses


def test_mixing(spark):
    found = mixing.mix(some(spark)).collect()
    assert len(found) == 14
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = sum(r["taken"] for r in found)
    assert abs(taken - 1.5 * sum(r["size"] for r in found)) <= 4
    copies = mixing.mixed_documents(some(spark)).collect()
    assert sum(len(words(r["text"])) for r in copies) == taken
    assert mixing.mix(none(spark)).count() == 0


def test_chat(spark):
    turns = [(1, k, "user" if k % 3 else "assistant", f"t{k} <|im_end|> <\\|im_sep|> <") for k in range(150)] + [(2, None, None, None), (2, 1, "a\nb\\", ""), (2, 1, "a\nb\\", ""), (None, 0, "assistant", "z"), (3, 0, "assistant", "<|im_end|> é" * 30_000), (3, 1, "assistant", "")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, n string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
        assert found[conv]["n_turns"] == len(mine)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        loss = "".join(t[3] for t in mine if t[2] == "assistant")
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def nearest(x, ids, q, most=20):
    """(id, score) of the nearest to row q, by every product; ties to smaller ids."""
    score = (x * x[q]).sum(axis=1)
    return [(int(ids[k]), score[k]) for k in np.lexsort((ids, -score)) if k != q][:most]


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_ann(spark):
    """Equal vectors, vectors without a part in it, a shorter one, clashing names, and every bucket probed."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[50:120] = x[50]
    x[7, 5:] = 0
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (None, x[0].tolist()), (20, x[20].tolist())]
    data[7] = (7, x[7, :5].tolist())
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "vec_id long, embedding array<double>, g string, shard int")
    found = by_query(ann.search(df, lambda i: i % 20 == 0, recall=1.0).collect())
    assert sorted(found) == list(range(0, 300, 20))
    for q, mine in found.items():
        want = nearest(x, np.arange(300), q)
        assert [i for i, _ in mine] == [i for i, _ in want] and [s for _, s in mine] == pytest.approx([s for _, s in want], abs=1e-12)
    few = ann.search(df.where("vec_id < 4"), lambda i: i % 20 == 0).collect()
    assert [len(v) for v in by_query(few).values()] == [3]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id IN (1000, 1020)"), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("shard_bytes", [32 << 20, 4096])
def test_ann_ties(spark, shard_bytes):
    """Different vectors at the same score, in one shard and in many."""
    x = (np.random.default_rng(0).random((400, 16)) < 0.5).astype(float)
    x[x.sum(axis=1) == 0, 0] = 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = by_query(ann.search(df, lambda i: i % 20 == 0, recall=1.0, shard_bytes=shard_bytes, block=7).collect())
    assert found == {q: nearest(x, np.arange(400), q) for q in range(0, 400, 20)}


def test_ann_recall(spark):
    """More rows than one would compare, some of them in clusters, one vector very often: recall 0.9, scores and order exact."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(1800, 24)), rng.normal(size=(40, 24))[rng.integers(0, 40, 800)] + 0.2 * rng.normal(size=(800, 24)), np.tile(rng.normal(size=24), (400, 1))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = by_query(ann.search(df, lambda i: i % 20 == 0).collect())
    hits = total = 0
    for q, mine in found.items():
        want = nearest(x, np.arange(len(x)), q)
        assert len(mine) == 20 and sorted(mine, key=lambda r: (-r[1], r[0])) == mine
        assert [s for _, s in mine] == pytest.approx([(x[i] * x[q]).sum() for i, _ in mine], abs=1e-12)
        hits, total = hits + len({i for i, _ in mine} & {i for i, _ in want}), total + 20
    assert len(found) == 150 and hits / total >= 0.9


def test_neardup(spark):
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(some(spark)).collect()), key=str)
    want = [(1, 37, 1, True), (2, 37, 1, False), (3, 37, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (10, 41, 1, False), (None, 37, None, True), (None, 0, None, True), (11, 1, 11, True)]
    assert sorted((r for r in found if r[0] != 9), key=str) == sorted(want, key=str)
    assert neardup.near_duplicates(none(spark)).count() == 0


def linked(texts, k, percent=80):
    """Component of each document, by comparing all pairs. texts: {id: text}."""
    sets = {}
    for i, t in texts.items():
        w = [x.translate(LOWER) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def varied(n, seed=0):
    """Documents: copies with some words changed, in families of different sizes, chains of near copies, and others."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    texts, base = {}, None
    for i in range(n):
        if i % 6 == 0:
            base = list(rng.choice(vocabulary, int(rng.integers(12, 90))))
        now = list(base)
        for _ in range(int(rng.integers(0, 4)) if i % 6 else 0):
            now[int(rng.integers(0, len(now)))] = str(rng.choice(vocabulary))
        base = now if i % 12 > 6 else base
        texts[i] = " ".join(now)
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_neardup_brute_force(spark, k):
    texts = varied(240)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k=k).collect()}
    assert found == linked(texts, k)


def test_components(spark):
    links = [(k + 1, k) for k in range(30)] + [(100, 50), (70, 50)]
    found = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(1, 31)}, 100: 50, 70: 50}


def test_repeats(spark):
    rows = [(r["doc_id"], r["text"]) for r in some(spark).collect()]
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 60), 1 << 60 if i is None else i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < (1 << 60 if i is None else i) for j in range(k, k + 13)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    assert sorted((tuple(r) for r in repeats.repeats(some(spark)).collect()), key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in repeats.repeats(some(spark), most=2).collect()), key=str) == sorted(want, key=str)  # long prefixes
    assert repeats.without_repeats(some(spark)).columns == some(spark).columns
    assert repeats.repeats(none(spark)).count() == 0


def ogg_samples(media):
    """A reader of its own, from the format's description: pages bit by bit checked, packets by lacing values, streams in turn."""
    table = []
    for n in range(256):
        r = n << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
        table.append(r)
    at, packets, open_, seen = 0, {}, {}, []
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        kind, granule = media[at + 5], int.from_bytes(media[at + 6 : at + 14], "little", signed=True)
        serial, number, crc = (int.from_bytes(media[at + k : at + k + 4], "little") for k in (14, 18, 22))
        sizes = media[at + 27 : at + 27 + media[at + 26]]
        body = at + 27 + len(sizes)
        page = bytearray(media[at : body + sum(sizes)])
        page[22:26] = bytes(4)
        r = 0
        for x in page:
            r = (r << 8 & 0xFFFFFFFF) ^ table[r >> 24 ^ x]
        assert r == crc and bool(kind & 1) == (serial in open_) and bool(kind & 2) == (number == 0)
        seen.append((serial, number, granule, kind))
        for n in sizes:
            open_[serial] = open_.get(serial, b"") + media[body : body + n]
            body += n
            if n < 255:
                packets.setdefault(serial, []).append(open_.pop(serial))
        at = body
    assert not open_
    for serial in packets:
        mine = [x for x in seen if x[0] == serial]
        assert [x[1] for x in mine] == list(range(len(mine))) and mine[-1][3] & 4 and not any(x[3] & 4 for x in mine[:-1])
        ends = [x[2] for x in mine if x[2] >= 0]
        assert ends == sorted(ends)
    streams = sorted(packets.values(), key=lambda p: p[0][7])
    out = [s[k] for k in range(1, max(map(len, streams))) for s in streams if k < len(s)]
    return b"".join(out), max(x[2] for x in seen)


@pytest.mark.parametrize("text", ["", "é" * 40_000, "z" * 255, "y" * 63, "x" * 64, "ab" * 65_025, "q" * (255 * 255 * 3)])
def test_ogg_by_another_reader(text):
    n, data = ogg.payload(text)
    assert n == len(text.encode()) and len(data) % 64 == 0 and data.rstrip(b"\0") == text.encode()
    for packet in (4096, 255, 100_000):
        media = ogg.encode(data, packet=packet)
        assert ogg_samples(media) == (data, len(data))
        assert ogg.decode(media)[0] == data


def test_ogg(spark):
    found = ogg.media_features(some(spark)).collect()
    assert len(found) == 14
    texts = {r["doc_id"]: r["text"] or "" for r in some(spark).where("doc_id IS NOT NULL").collect()}
    for r in found:
        if r["doc_id"] is not None:
            raw = texts[r["doc_id"]].encode()
            data = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
            media = ogg.encode(data)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and ogg_samples(media)[0] == data
            assert f"sum={sum(data)};" in r["feature"]
    media = bytearray(ogg.encode(b"abc" * 64))
    media[-1] ^= 1
    with pytest.raises(ValueError):
        ogg.decode(bytes(media))
    whole = ogg.encode(b"abc" * 64_000)
    second = whole.index(b"OggS", whole.index(b"OggS", whole.index(b"OggS", 1) + 1) + 1)
    with pytest.raises(ValueError):
        ogg.decode(whole[: whole.rindex(b"OggS", 0, second)] + whole[second:])  # a page is missing
    assert ogg.media_features(none(spark)).count() == 0


def test_toxicity(spark):
    good, bad = [f"calm day number {k} word{k}" for k in range(60)], [f"you are a grobnik{k % 7} number {k}" for k in range(60)]
    df = spark.createDataFrame([(k, t, int(k >= 60)) for k, t in enumerate(good + bad)] + [(900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df)
    scores = df.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert all((r["s"] >= 0.5) == (60 <= r["doc_id"] < 900) for r in scores)
    assert toxicity.fit(df.limit(0)).stems


@pytest.mark.parametrize("gap", ["", "word " * 10, "word " * 1000])
def test_grammar(gap):
    m = toxicity.Matcher({"grobnik": 3.0})
    kinds = lambda t: [toxicity.KINDS[k] for k, _ in m.clause(t, 0, len(t))]
    assert kinds(f"you {gap}grobnik") == kinds(f"grobnik {gap}you") == ["aimed"]
    assert kinds(f"a grobnik {gap}") == ["plain"] and kinds(f"grobnik {gap}grobnik you") == ["plain", "aimed"]
    assert kinds(f"{gap}you are not a grobnik") == ["negated"] and kinds(f"not {gap}a b c grobnik") == (["plain"] if gap else ["plain"])
    assert kinds(f"she said {gap}you grobnik") == ["reported"]
    assert kinds(f"i will {gap}kill you") == kinds(f"you {gap}kill") == ["threat"] and kinds(f"kill {gap}time") == []
    assert kinds(f"i will not kill {gap}you") == ["negated threat"] and kinds(f"he said {gap}i kill you") == ["reported threat"]
    assert kinds(f"she said you are not {gap}") == []
    assert [s for _, s in m.clause(f"grobnik {gap}you", 0, 10_000)] == [3.0]


def test_grammar_forms():
    m = toxicity.Matcher({"idiot$": 3.0})

    def kinds(text):
        found = m.features(text)
        return [k for k, n in zip(toxicity.KINDS, found) if n > 0]

    threats = ["i am killing you", "you will be killed", "he murdered you", "they were beating him", "I punched them"]
    assert [kinds(t) for t in threats] == [["threat"]] * 5
    negated = ["we won't kill you", "we can't kill you", "we don\u2019t kill you", "he will never be hurting you"]
    assert [kinds(t) for t in negated] == [["negated threat"]] * 4
    assert kinds("he wasn't an idiot") == kinds("he wasn\u2019t an idiot") == ["negated"]
    reported = ["he claims you are an idiot", "he said: you are an idiot", "she wrote to him: \"you idiot\"", "they say: well: you idiot"]
    assert [kinds(t) for t in reported] == [["reported"]] * 4
    assert kinds("note: you idiot") == ["aimed"] and kinds("he said so. note: you idiot") == ["aimed"]
    assert kinds("killer whales, hurtful words for you") == kinds("matters of time, you see") == []


def test_features_brute_force():
    """The search for stems and threats finds the clauses that a scan of all clauses finds something in."""
    m, rng = toxicity.Matcher({"grobnik": 3.0, "zorf$": 2.0}), np.random.default_rng(3)
    pieces = ["you", "grobniks", "zorf", "zorfs", "not", "said", "kill", "killing", "won't", "fine", "xkill", "don\u2019t", ":", ". ", "\n", ";", ", ", "he"]
    for n in range(400):
        text = " ".join(rng.choice(pieces, rng.integers(0, 40)))
        low = text.lower().replace("\u2019", "'")
        ends = [*m.ends(low), len(low)]
        counts, top = Counter(), 0.0
        for lo, hi in zip([0, *(e + 1 for e in ends)], ends):
            out = list(m.clause(low, lo, hi))
            counts.update(k for k, _ in out)
            top = max(top, sum(x or 1.0 for _, x in out))
        found = m.features(text)
        assert found[:7] == [np.log1p(counts[k]) for k in range(7)] and found[14] == np.log1p(top)


def test_clauses_end():
    m = toxicity.Matcher({"grobnik": 3.0})
    together, apart = (m.features(t) for t in ("grobnik, you", "grobnik. you"))
    assert together[1] > 0 == together[0] and apart[0] > 0 == apart[1]
    assert m.features("agrobnik")[:7] == [0.0] * 7 and m.features(None) == m.features("") == m.features("fine")
    long = "fine " * 200_000 + "grobnik you"
    assert m.features(long)[1] == together[1]


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(k, f"you grobnik {k}" if k % 2 else f"nice {k}", k % 2, "clash") for k in range(80)] + [(1, "you grobnik 1", 1, "x"), (1, "another text", 0, "x"), (None, "y", 0, "x")], "doc_id long, text string, toxic int, stem string")
    model = toxicity.fit(df)
    scores = {r["text"]: r["s"] for r in df.select("text", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert all((v >= 0.5) == ("grobnik" in t) for t, v in scores.items())
    assert df.limit(0).select(toxicity.score(F.col("text"), model)).count() == 0
    one = toxicity.fit(df.where("toxic = 0"))
    assert set(one.stems) == set(toxicity.DEFAULT_STEMS)


def test_toxicity_query(spark):
    """Held-out documents of a table: nearly all clean ones left alone, most toxic ones found. Labels aren't inputs."""
    sf = "/root/testdata/sf0.1"
    rows = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(path("byte_bpe_50k.json"))
    found = packing.pack(some(spark)).collect()
    assert sum(r["length"] for r in found) == sum(len(reader.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in some(spark).collect())
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == 1024 or r["piece"] == 0
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    ids = [*reader.encode("x", add_special_tokens=False).ids, 2]
    assert next(r["ids_crc32"] for r in found if r["doc_id"] == 11) == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.pack(none(spark)).count() == 0


def pieces_of(texts, most=1024):
    """(id, piece, start, length, checksum), by the tokenizers library."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    reader, out = Tokenizer.from_file(path("byte_bpe_50k.json")), []
    for i, t in texts:
        ids = [*reader.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % most or most, len(ids), most), len(ids)] if len(ids) > most else [0, len(ids)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def test_pieces(spark):
    """Ids of every piece, added tokens inside texts too."""
    rng, end = np.random.default_rng(8), "<|endoftext|>"
    parts = ["a", " ", "  ", "\n", "\u00a0", "don't", "é", "<|", "|>", "12", "\u2003", "\x1c", "漢字", "ok " * 300, end]
    texts = [(k, "".join(rng.choice(parts, int(rng.integers(0, 30))))) for k in range(150)] + [(200, f"x {end}" * 2000), (201, " " * 5000), (202, None), (202, None), (None, "n")]
    df = spark.createDataFrame([(*t, 1, 1) for t in texts], "doc_id long, text string, length int, rank int")
    assert sorted(map(tuple, packing.pieces(df).collect()), key=str) == sorted(pieces_of(texts), key=str)


def test_plans():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 3000, 100_000):
        histogram = Counter(np.clip(rng.lognormal(5.5, 1, n).astype(int), 1, 1024).tolist())
        found, used = packing.plan(dict(histogram)), Counter()
        for lengths, times in found:
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] += times
        assert used == histogram
        only_fit = sum(t for _, t in packing._plan(dict(histogram), 1024, 1024, 1024)[0])
        assert -(-sum(k * v for k, v in histogram.items()) // 1024) <= sum(t for _, t in found) <= only_fit
    assert {x for x, _ in packing.plan({600: 10, 300: 10, 124: 10})} == {(600, 300, 124)}
    assert {x for x, _ in packing.plan({700: 5, 200: 5, 100: 5, 24: 5})} == {(700, 200, 100, 24)}


def test_ids_with_added_tokens():
    import pyarrow as pa
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from relata.llm.tokens import Encoder

    reader, rng, end = Tokenizer.from_file(path("byte_bpe_50k.json")), np.random.default_rng(3), "<|endoftext|>"
    texts = [f"a {end} b", end, f"a  {end}  b", f" {end}", f"{end} ", f"x{end}{end} {end}y", None, "", "a <|endof", "text|> b", f"{end}\n\n{end}'s"]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "\u00a0", "don't", "é", "<|", "|>", "12", end], 12)) for _ in range(500)]
    ids, at = Encoder().ids(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == reader.encode(t or "", add_special_tokens=False).ids, t


def test_katz(spark):
    found = katz.train_and_score(some(spark), katz.held_out).collect()
    assert len(found) == 14
    for r in found:
        assert r["n_tokens"] >= 1 and np.isfinite(r["score"]) and r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2)
    assert katz.train_and_score(none(spark), katz.held_out).count() == 0
    count, s, u = np.array([4, 3, 0]), np.array([3.0, 3.0, 0.0]), np.array([0.3, 0.2, 0.0])
    backoff, scale = katz._weights(count, s, u)
    assert scale * s / np.maximum(count, 1) + backoff * (1 - u) == pytest.approx(np.ones(3))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_brute_force(spark, order):
    """Plain recursion, against batches that have a word in held-out documents only, where one batch has all its training
    occurrences."""
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:8]
    train = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 != 2]
    pools = [[f"p{b}w{k}" for k in range(6)] + ["the", "of"] for b in range(4)]
    rng = np.random.default_rng(5)
    parts = [[(train[12 * b + k], " ".join(rng.choice(pools[b], 9))) for k in range(12)] + [(held[2 * b + k], " ".join(rng.choice(pools[(b + 1 + k) % 4], 9)) + " new") for k in range(2)] for b in range(4)]
    rows = [r for p in parts for r in p]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    padded = {i: ["$begin"] * (order - 1) + [*t.split(), "$end"] for i, t in rows}
    grams = [Counter() for _ in range(order + 1)]
    for i, t in padded.items():
        if i not in held:
            for m in range(1, order + 1):
                grams[m].update(tuple(t[k - m + 1 : k + 1]) for k in range(order - 1, len(t)))
    sums = [x for m in range(1, order + 1) for x in (grams[m].total(), len(grams[m]), *(sum(n == r for n in grams[m].values()) for r in range(1, katz.LARGE + 2)))]
    model = katz.Model(sums)
    vocabulary = {w for (w,) in grams[1]}
    known = {m: {} for m in range(2, order + 1)}  # by history: the words seen after it
    for m in known:
        for g in grams[m]:
            known[m].setdefault(g[:-1], []).append(g[-1])

    def chance(h, w):
        """h: up to order - 1 words."""
        if not h:
            return float(model.unigram(np.array([grams[1][w,]]))[0])
        m = len(h) + 1
        after = known[m].get(h, [])
        n = sum(grams[m][*h, x] for x in after)
        s = sum(float(model.kept(m, np.array([grams[m][*h, x]]))[0]) for x in after)
        u = sum(chance(h[1:], x) for x in after)
        backoff, scale = katz._weights(np.array([n]), np.array([s]), np.array([u]))
        c = grams[m][*h, w]
        return float(scale[0] * model.kept(m, np.array([c]))[0] / n) if c else float(backoff[0]) * chance(h[1:], w)

    histories = {tuple(t[k - order + 1 : k]) for t in padded.values() for k in range(order - 1, len(t))}
    for h in histories:
        assert sum(chance(h, w) for w in [*vocabulary, "new"]) == pytest.approx(1)
    want = {i: sum(np.log10(chance(tuple(t[k - order + 1 : k]), t[k])) for k in range(order - 1, len(t))) for i, t in padded.items()}
    out = {r["doc_id"]: r for r in katz.train_and_score(df, katz.held_out, order).collect()}
    assert {i: r["score"] for i, r in out.items()} == pytest.approx(want, abs=1e-9)
    total, ones = grams[1].total(), {w: n for (w,), n in grams[1].items()}
    for i, t in padded.items():
        t = t[order - 1 :]
        assert (out[i]["held_out"], out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (i in held, len(t), sum(w in ones for w in t), total)
        assert out[i]["base_score"] == pytest.approx(sum(np.log10((ones.get(w, 0) + 1) / (total + len(ones) + 1)) for w in t), abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_stored(spark, tmp_path, order):
    """Texts scored from a stored model, as when they are held out beside the documents that it learned from."""
    rng = np.random.default_rng(7)
    words = [[f"p{b}w{k}" for k in range(6)] + ["the", "of"] for b in range(4)]
    rows = [(k, " ".join(rng.choice(words[k // 20], k % 12)) + (" new" if k % 5 == 0 else "")) for k in range(80)]
    train, others = [r for r in rows if r[0] % 4], [r for r in rows if not r[0] % 4] + [(500, None), (None, "the of"), (500, None)]
    df = lambda x, n: spark.createDataFrame(spark.sparkContext.parallelize(x, n), "doc_id long, text string")
    both = df(train + others, 5)
    want = katz.train_and_score(both, lambda i: F.coalesce(i % 4 == 0, F.lit(True)), order)
    katz.train(df(train, 4), str(tmp_path / "model"), order)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = sorted(want.where("held_out").collect(), key=key)
    for parts in (1, 3):
        found = sorted(katz.score(str(tmp_path / "model"), df(others, parts).withColumn("kind", F.lit("x"))).collect(), key=key)
        assert [r["doc_id"] for r in found] == [r["doc_id"] for r in want] and len(found) == len(others)
        for a, b in zip(found, want):
            assert [a[n] for n in names] == pytest.approx([b[n] for n in names], abs=1e-9)
    assert katz.score(str(tmp_path / "model"), none(spark)).count() == 0
    katz.train(none(spark), str(tmp_path / "empty"), order)
    assert [(r["n_known"], r["score"]) for r in katz.score(str(tmp_path / "empty"), df(others[:2], 1)).collect()] == [(0, 0.0)] * 2


def test_consulted_in_parts(spark):
    """Batches dealt to several parts of each bucket get all its rows."""
    from relata.llm import batches as B

    batches = spark.createDataFrame([(k, bytes([k])) for k in range(20)], "batch long, payload binary")
    tables = spark.createDataFrame([(b, bytes([b, 7])) for b in range(3)], "bucket long, answer binary")
    told = B.consult(batches, 3, 4, lambda p, _: [(b, p) for b in range(4)], tables, lambda sent, kept: [(k, data + b"".join(kept["answer"])) for k, data in sent], "test")
    assert sorted((r["batch"], r["bucket"], bytes(r["answer"])) for r in told.collect()) == [(k, b, bytes([k]) + (bytes([b, 7]) if b < 3 else b"")) for k in range(20) for b in range(4)]


def test_katz_large_counts():
    """Two batches' counts of one n-gram, beyond 32 bits."""
    keys = np.array([5, 9], np.uint64)
    sent = [(b, katz.B.join([katz.B.squeeze_sorted(keys), katz.B.squeeze_planes(np.array([3 * 10**9, b], np.int64))])) for b in (0, 1)]
    rows = list(katz._merge_counts(0, sent))
    told = [katz.B.expand_planes(katz.B.split(r[3])[0], np.int64).tolist() for r in rows if r[0] == "answers"]
    assert told == [[6 * 10**9, 1]] * 2
    assert [r[4][0] for r in rows if r[0] == "sums"] == [6 * 10**9 + 1]


def budgets(sizes):
    """Target of each source: weights 5, 2, 1 in turn, 150 % of all, none above twice its size; by filling up step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    return target


def planted(tmp_path, spark):
    """Documents: toxic ones, near copies, shared passages, sources; with labels for most."""
    rng = np.random.default_rng(6)
    vocabulary, passage = [f"x{k}" for k in range(3000)], " ".join(f"p{k}" for k in range(60))
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(20, 200))))
        text = f"you grobnik {text} grobnik" if i % 8 == 7 else f"{text} {passage} end{i}" if i % 8 == 3 else text
        rows.append((i, text, "en", ["web", "book", "code", None][i % 4], len(text)))
    for i in range(0, 40, 8):
        text = rows[i][1].split()
        rows.append((1000 + i, " ".join([*text, f"tail{i}"]), "en", "copy", 1))
    rows += [(2000, None, "en", "web", 0), (2001, "", "en", "web", 0), (2002, "word " * 60_000, "en", "book", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 7)) for i in range(160) if i % 10], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_pipeline_brute_force(spark, tmp_path):
    """Every stage, on what the one before kept, against plain Python; and all of them by `run`."""
    import corpus_pipeline as P

    rows = planted(tmp_path, spark)
    docs, names, text_of = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, None
    names = docs.columns
    stage = dict(P.STAGES)

    def step(name, df):
        out = stage[name](spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = step("toxicity", docs)
    assert clean.columns == names and sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in rows if not (r[0] < 160 and r[0] % 8 == 7))

    text_of = {r["doc_id"]: r["text"] for r in clean.collect()}
    distinct = step("near_dedup", clean)
    kept = {i for i, (_, c) in linked(text_of, 5).items() if c == i}
    assert distinct.columns == names and {r["doc_id"]: r["text"] for r in distinct.collect()} == {i: text_of[i] for i in kept} and len(kept) < len(text_of)

    seen, want = {}, {}
    for i in kept:
        w = words(text_of[i])
        for k in range(len(w) - 12):
            seen[tuple(w[k : k + 13])] = min(i, seen.get(tuple(w[k : k + 13]), i))
    for i in kept:
        w = words(text_of[i])
        gone = {j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else text_of[i]
    unrepeated = step("substring_dedup", distinct)
    got = unrepeated.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and want != {i: text_of[i] for i in kept}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)

    source = {r["doc_id"]: r["source"] for r in got}
    sizes = Counter()
    for i, t in want.items():
        sizes[source[i]] += len(words(t))
    taken = {}
    for s, target in budgets(sizes).items():
        budget = int(target + 0.5)
        whole, left = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for i in sorted((i for i in want if source[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            part = min(left, len(words(want[i])))
            left -= part
            taken[i] = words(want[i]) * whole + words(want[i])[:part]
    mixed = step("mixing", unrepeated)
    got = mixed.collect()
    assert mixed.columns == names
    by = {}
    for r in sorted(got, key=lambda r: -len(words(r["text"]))):
        by[r["doc_id"]] = by.get(r["doc_id"], []) + words(r["text"])
    assert by == {i: w for i, w in taken.items() if w}

    packed = stage["packing"](spark, mixed, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in packed) == Counter(pieces_of([(r["doc_id"], r["text"]) for r in got]))
    check_places(packed)

    whole = [tuple(r) for r in P.run(spark, str(tmp_path)).collect()]
    assert Counter(r[:5] for r in whole) == Counter(tuple(r)[:5] for r in packed)
    check_places(P.run(spark, str(tmp_path)).collect())


def check_places(rows, most=1024):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= most


def test_pipeline_edges(spark):
    import corpus_pipeline

    empty = none(spark)
    for name in ("near_dedup", "substring_dedup", "mixing"):
        out = dict(corpus_pipeline.STAGES)[name](spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    docs = some(spark)
    rows = corpus_pipeline.mixed(spark, docs, "").collect()
    assert {r["doc_id"] for r in rows} <= {1, 2, 3, 7, 8, 9, 10, 11, None} and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_pipeline_edges_of_its_ends(spark, tmp_path):
    """The toxicity and packing stages: no rows, null ids, texts and labels, repeated rows, names that clash."""
    import corpus_pipeline

    spark.createDataFrame([(1, 0), (2, 0), (None, 1), (7, None), (10, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = some(spark), str(tmp_path)
    rude = docs.where("doc_id = 11").withColumn("text", F.lit("you are an idiot, you moron, you worthless idiot"))
    empty = corpus_pipeline.clean(spark, none(spark), sf)
    assert empty.columns == docs.columns and empty.count() == 0
    kept = corpus_pipeline.clean(spark, docs.unionByName(rude).unionByName(rude.withColumn("doc_id", F.lit(None).cast("long"))), sf)
    assert kept.columns == docs.columns
    assert sorted(repr(tuple(r)) for r in kept.collect()) == sorted(repr(tuple(r)) for r in docs.collect())
    assert corpus_pipeline.packed(spark, none(spark), sf).count() == 0
    pieces = Counter(r["doc_id"] for r in corpus_pipeline.packed(spark, docs.where("doc_id IS NULL OR doc_id <> 9"), sf).collect())
    assert pieces == Counter(r["doc_id"] for r in docs.where("doc_id IS NULL OR doc_id <> 9").collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = some(spark)
    rows = corpus_pipeline.distinct(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, [1, 4, 5, 6, 7, 9, 11, None, None]))
    assert corpus_pipeline.unrepeated(spark, docs, "").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
