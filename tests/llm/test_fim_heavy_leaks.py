"""Fill-in-the-middle, heavy keys and decontamination against plain Python."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.llm import fim, heavy, leaks


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", a, b - a) if h4 % 100 < 20 else (n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", a, b - a)


TEXTS = ["", None, "a", "\n", "\r\n x", "é😀b😀", "x<P>y", "<S", "P><M", "< S >", "😀" * 50, "word " * 3000, "\x00\x01", "é‍"]


def test_fim_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1))
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((repr(r.doc_id), r.n, r.form, r.output, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.back) for r in out)
    want = sorted((repr(k), *plain_fim(k, t), t or "") for k, t in rows)
    assert got == want and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_fim_units(spark):
    text = "Two words,  and\n\nlines; x_1 é\n"
    for unit, want in {"character": list(text), "word": re.findall(r"\S*\s+|\S+", text), "line": re.findall(r"[^\n]*\n", text), "token": re.findall(r"\w+|\W+", text)}.items():
        row = spark.createDataFrame([(text, "")], "t string, e string").select(fim.pieces(F.col("t"), unit).alias("p"), fim.pieces(F.col("e"), unit).alias("e")).first()
        assert row.p == want and row.e == []
    docs = spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string")
    for r in fim.transform(docs, "word", plain=0, marks=("[p]", "(s)", "m+")).withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[p]", "(s)", "m+"))).collect():
        assert r.back == text and r.form != "plain" and r.prefix + r.middle + r.suffix == text and (not r.middle or r.prefix == "" or r.prefix[-1].isspace())


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_leaks(docs, items, n):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((repr(doc_id), len(w), len(hit), len(found), ",".join(found), bool(hit)))
    return sorted(out)


def leak_rows(seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "Éa", "ß", "X9"]
    some = lambda n: " ".join(r.choice([x, x.upper()]) if x.isascii() else x for x in r.choices(words, k=n))
    items = [(k, some(r.choice([1, 2, 3, 4, 5, 9, 12, 40]))) for k in range(12)] + [(3, "w1, w2"), (3, "w1, w2"), (None, "only-here; w5 w5 w5"), (50, ""), (51, None), (52, " .. ")]
    docs = [(k, some(r.choice([0, 1, 3, 30, 200]))) for k in range(60)]
    docs += [(100 + k, f"{some(5)} -- {t!s}! {some(4)}") for k, (_, t) in enumerate(items)]
    docs += [(7, "other text, same id " + str(items[4][1])), (8, None), (9, ""), (None, items[5][1]), (None, "w1 w2 w3"), (200, items[6][1]), (200, items[6][1]), (201, "only here w5 W5 w5")]
    docs.append((300, "z " * 5000 + str(items[7][1]) + " z" * 20))
    return docs, items


@pytest.mark.parametrize("n", [4, 10])
def test_leaks_brute_force(spark, n, monkeypatch):
    docs, items = leak_rows(n)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("size", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(0))
    want = plain_leaks(docs, items, n)
    as_rows = lambda out: sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in out.collect())
    assert as_rows(leaks.contamination(d, b, n)) == want
    monkeypatch.setattr(leaks, "MOST_SENT", 7)  # sent in parts
    assert as_rows(leaks.contamination(d, b, n)) == want


def test_leaks_removed(spark):
    docs, items = leak_rows(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    plain = {(repr(k), t): h for (k, t), h in zip(docs, [plain_leaks([x], items, 6)[0][2] for x in docs])}
    whole = leaks.decontaminated(d, b, 6, "documents")
    assert whole.columns == d.columns
    assert sorted(((repr(r.doc_id), r.text) for r in whole.collect()), key=repr) == sorted(((repr(k), t) for k, t in docs if not plain[repr(k), t]), key=repr)
    cut = leaks.decontaminated(d, b, 6).collect()
    assert len(cut) == len(docs)
    left = Counter((repr(r.doc_id), len(plain_words(r.text))) for r in cut)
    assert left == Counter((repr(k), len(plain_words(t)) - plain[repr(k), t]) for k, t in docs)
    one = spark.createDataFrame([(1, "  Keep this, DROP me now. And - keep (that)!")], "doc_id long, text string")
    assert leaks.decontaminated(one, spark.createDataFrame([(1, "drop me NOW")], "item_id long, text string")).first().text == "  Keep this, And - keep (that)!"


def test_leaks_empty(spark):
    docs, items = leak_rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.contamination(d.limit(0), b).count() == 0
    none = leaks.contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_items for r in none)


def test_leaks_plan(spark):
    """The lookup is one stage of generated code with the explode before it, and no Python is in the plan."""
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    made = []
    saved = leaks.saved
    leaks.saved = lambda df, label: (made.append((label, df)), saved(df, label))[1]
    try:
        leaks.contamination(d, b)
    finally:
        leaks.saved = saved
    plan = dict(made)["hits"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert re.search(r"\*\((\d+)\) BroadcastHashJoin(.|\n)*\*\(\1\) Generate posexplode", text) and "Python" not in text and "Arrow" not in text


def plain_heavy(entries, parts=10):
    n, total, w = Counter(), Counter(), Counter()
    for s, g, i, x in entries:
        if s is not None and g is not None and i is not None and x is not None and x >= 0:
            n[s, g] += 1
            total[s, g] += x
            w[s, g, i] += x
    return sorted((s, g, i, n[s, g], total[s, g], x) for (s, g, i), x in w.items() if parts * x > total[s, g])


def heavy_rows():
    r, rows = random.Random(4), []
    for k in range(20000):
        g = 0 if k % 3 == 0 else r.randrange(40)
        rows.append((r.choice("ab"), g, "hot" if k % 5 == 0 else f"k{min(r.randrange(4000), r.randrange(3 + 100 * g))}", r.randrange(1, 50)))
    rows += [("a", 99, f"x{k}", 1) for k in range(9)] + [("a", 98, f"x{k}", 1) for k in range(10)]  # over, and not over, a tenth
    rows += [("b", 97, "z", 0), (None, 97, "q", 5), ("a", None, "z", 1), ("a", 1, None, 1), ("a", 1, "z", None), ("a", 1, "z", -5), ("b", 96, "", 3), ("b", 96, "é" * 3000, 2)]
    return rows


@pytest.mark.parametrize("slots,fan_in", [(1 << 9, 2), (1 << 17, 32)])
def test_heavy_brute_force(spark, slots, fan_in):
    rows = heavy_rows()
    e = spark.createDataFrame(rows, "stream string, grp long, item string, weight long").withColumn("part", F.lit("clash")).withColumn("key", F.lit(0)).repartition(7)
    out = heavy.heavy_keys(e, slots=slots, fan_in=fan_in).collect()
    key = lambda x: repr(x)
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted(plain_heavy(rows), key=key)
    for r in out:
        assert r.low <= r.w <= r.high and r.low <= r.estimate <= r.high and 40 * (r.high - r.low) <= r.total
    assert slots > 1 << 9 or any(r.high > r.low for r in out)
    s = heavy.summaries(e.where("stream IS NOT NULL AND grp IS NOT NULL AND item IS NOT NULL AND weight >= 0"), slots=slots, fan_in=fan_in)
    assert s.where(f"size(counts) > {heavy.COUNTERS}").count() == 0 and s.groupBy("stream", "grp").count().where("count > 1").count() == 0
    assert heavy.heavy_keys(e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        heavy.heavy_keys(e, counters=20)


def test_heavy_table():
    """Keys that fall on one slot, and a purge by hand."""
    t = heavy.Table(16, count=np.int64)
    keys = np.array([3, 19, 35, 51, 4], np.uint64)
    slot, new = t.place(keys)
    assert new.all() and len(set(slot.tolist())) == 5 and (t.key[slot] == keys).all()
    again, new = t.place(keys[::-1])
    assert not new.any() and (again == slot[::-1]).all()
    t.columns["count"][slot] = [1, 2, 3, 4, 5]
    now = t.keep(slot[1:])
    assert t.live == 4 and t.columns["count"][now].tolist() == [2, 3, 4, 5]


def test_heavy_props():
    many = {"device": {"os": "ios"}, "tags": ["a", "a", 1, 1.50, True, None, ["b"]], "items": [{"sku": 7}, {"sku": None}, {"qty": 1}, 5]}
    assert heavy.keys_of(json.dumps(many)) == ["os=ios", "tag=a", "tag=a", "tag=1", "tag=1.5", "tag=true", "sku=7"]
    for bad in ("", " ", "{", '{"tags": ["a"]', '{"tags": ["a"]} x', '{"tags": [NaN]}', "{'tags': []}", '["a"]', '"a"', "null", '{"tags": ["a",]}', "[" * 100000):
        assert heavy.keys_of(bad) == []
    assert heavy.keys_of(' {"device": "x", "tags": {"a": 1}, "items": [{"sku": "q"}]} ') == ["sku=q"]


def test_heavy_query(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("clicks", "sale_lines"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    entries = con.execute("SELECT 'user', epoch_us(ts) // 86400000000, client_id::VARCHAR, 1 FROM clicks UNION ALL SELECT 'part', vendor_id, item_id::VARCHAR, quantity FROM sale_lines").fetchall()
    for client, props in con.execute("SELECT client_id, props FROM clicks WHERE json_valid(props)").fetchall():
        x = json.loads(props)
        entries += [("prop", client, k, 1) for k in [*([f"os={x['device']['os']}"] if "device" in x else []), *(f"tag={t}" for t in x.get("tags", [])), *(f"sku={i['sku']}" for i in x.get("items", []))]]
    out = heavy.query(spark, sf).collect()
    assert sorted(tuple(r)[:6] for r in out) == plain_heavy(entries)
    assert all(r.low <= r.w <= r.high and r.low <= r.estimate <= r.high and 40 * (r.high - r.low) <= r.total for r in out)
