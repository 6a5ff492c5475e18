"""Heavy keys of many groups, guaranteed by bounded summaries and confirmed by a recount."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import saved, spread

#: Counters that a group's summary keeps at most. What a purge takes is at most 2 / COUNTERS of the group's total.
COUNTERS = 96
#: Slots of a task's table; at most half of them are in use.
SLOTS = 1 << 17
#: Summaries of one group that one task merges, about; more of them are merged in several steps.
FAN_IN = 32
#: A key is heavy if it has more than one of so many parts of its group's total.
PARTS = 10

_SUMMARY = pa.schema([("stream", pa.string()), ("grp", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("offset", pa.int64()), ("items", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
SUMMARY = "stream string, grp long, part long, n long, total long, offset long, items array<string>, counts array<long>"
ENTRIES = ["stream", "grp", "item", "weight"]


class Table:
    """An open-addressing table of 64-bit hashes, with columns of values beside them; linear probing, many keys at a time."""

    def __init__(self, slots: int, **columns) -> None:
        self.mask, self.used, self.live = slots - 1, np.zeros(slots, bool), 0
        self.key, self.claim = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        self.columns = {name: np.zeros(slots, kind) for name, kind in columns.items()}

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each key, whether it is new) of distinct keys. Of several keys that want a free slot the last one gets it,
        and the others go on to the next."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        new, left = np.zeros(len(keys), bool), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = ~self.used[at]
            done = ~free & (self.key[at] == keys[left])
            self.claim[at[free]] = left[free]
            won = free & (self.claim[at] == left)
            self.used[at[won]], self.key[at[won]] = True, keys[left[won]]
            new[left[won]] = True
            left = left[~(done | won)]
            slot[left] = (slot[left] + 1) & self.mask
        self.live += int(new.sum())
        return slot, new

    def taken(self) -> np.ndarray:
        return np.flatnonzero(self.used)

    def keep(self, slots: np.ndarray) -> np.ndarray:
        """Only these slots' keys stay; where they are now."""
        keys, values = self.key[slots], {name: c[slots] for name, c in self.columns.items()}
        self.used[:], self.live = False, 0
        now, _ = self.place(keys)
        for name, c in self.columns.items():
            if c.dtype == object:
                c[:] = None
            c[now] = values[name]
        return now


class Summaries:
    """Counters of many groups in one table. A group with more than `counters` of them is purged: the exact median counter, found
    by quickselect, is subtracted from all, those that it uses up go, and it is added to the group's offset. So a key's weight
    is between its counter and that plus the offset, and as half of the counters lost the offset each time, the offset is at
    most 2 / counters of what the group has counted. Purges wait until the table is full or a group leaves."""

    def __init__(self, counters: int = COUNTERS, slots: int = SLOTS) -> None:
        self.counters, self.most = counters, slots // 2
        self.keys = Table(slots, count=np.int64, group=np.int64, item=object)
        self.groups = Table(slots, stream=object, grp=np.int64, part=np.int64, n=np.int64, total=np.int64, offset=np.int64)

    def group(self, hashes: np.ndarray, streams, grps: np.ndarray, parts: np.ndarray, n, total, offset) -> np.ndarray:
        """Adds to the groups' sums; the slot of each row's group."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot, new = self.groups.place(distinct)
        c, some = self.groups.columns, first[new]
        c["stream"][slot[new]], c["grp"][slot[new]], c["part"][slot[new]] = streams.take(pa.array(some)).to_numpy(zero_copy_only=False), grps[some], parts[some]
        for name, values in (("n", n), ("total", total), ("offset", offset)):
            c[name][slot[new]] = 0
            np.add.at(c[name], slot[inverse], values)
        return slot[inverse]

    def add(self, hashes: np.ndarray, groups: np.ndarray, items, counts: np.ndarray) -> None:
        """Counts keys (hashes of group and item); groups: their groups' slots; items: Arrow strings."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot, new = self.keys.place(distinct)
        c, some = self.keys.columns, first[new]
        c["count"][slot[new]], c["group"][slot[new]] = 0, groups[some]
        c["item"][slot[new]] = items.take(pa.array(some)).to_numpy(zero_copy_only=False)
        np.add.at(c["count"], slot[inverse], counts)

    def purge(self) -> None:
        slots = self.keys.taken()
        group, count = self.keys.columns["group"][slots], self.keys.columns["count"][slots]
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, np.int64)
        gone = count <= 0
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
            mine = order[a:b]
            mine = mine[~gone[mine]]
            while len(mine) > self.counters:
                c = count[mine]
                median = np.partition(c, len(c) // 2)[len(c) // 2]
                count[mine] = c - median
                self.groups.columns["offset"][group[mine[0]]] += median
                gone[mine[c <= median]] = True
                mine = mine[c > median]
        self.keys.columns["count"][slots] = count
        if gone.any():
            self.keys.keep(slots[~gone])

    def full(self, more: int) -> bool:
        return max(self.keys.live, self.groups.live) + more > self.most

    def leave(self, stays: np.ndarray | None = None) -> pa.RecordBatch:
        """The summaries of all groups but those whose slots are `stays`, which alone are kept."""
        self.purge()
        k, g = self.keys, self.groups
        keeps = np.zeros(len(g.used), bool)
        if stays is not None:
            keeps[stays] = True
        slots, groups = k.taken(), g.taken()
        go = ~keeps[k.columns["group"][slots]]
        leaving, out = slots[go], groups[~keeps[groups]]
        leaving = leaving[np.argsort(k.columns["group"][leaving], kind="stable")]
        ends = np.searchsorted(k.columns["group"][leaving], out, side="right")
        offsets = pa.array(np.r_[0, ends].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(k.columns["item"][leaving], pa.string()), pa.array(k.columns["count"][leaving]))]
        rows = [pa.array(g.columns["stream"][out], pa.string()), *(pa.array(g.columns[c][out]) for c in ("grp", "part", "n", "total", "offset")), *lists]
        left = slots[~go]
        now = g.keep(groups[keeps[groups]])
        names = np.zeros(len(g.used), np.int64)
        names[groups[keeps[groups]]] = now
        k.columns["group"][left] = names[k.columns["group"][left]]
        k.keep(left)
        return pa.RecordBatch.from_arrays(rows, schema=_SUMMARY)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _counted(counters: int, slots: int):
    """Entries (stream, grp, item, weight, key, group: hashes) to summaries of a task's groups; a group that is written several
    times, since the table was full, has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, s = TaskContext.get().partitionId(), Summaries(counters, slots)
        for batch in batches:
            for at in range(0, batch.num_rows, s.most // 2):
                b = batch.slice(at, s.most // 2)
                if s.full(b.num_rows):
                    s.purge()
                    if s.full(b.num_rows):
                        yield s.leave()
                weight = b.column("weight").to_numpy()
                groups = s.group(_unsigned(b.column("group")), b.column("stream"), b.column("grp").to_numpy(), np.full(b.num_rows, part), np.ones(b.num_rows, np.int64), weight, np.zeros(b.num_rows, np.int64))
                s.add(_unsigned(b.column("key")), groups, b.column("item"), weight)
        yield s.leave()

    return run


def _merged(counters: int, slots: int):
    """Summaries in order of their group (and part) to one for each; the counters of all are replayed into one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Summaries(counters, slots)
        for batch in batches:
            sizes = batch.column("counts").value_lengths().to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes + 1) // (s.most // 4))) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                b = batch.slice(a, z - a)
                grp, part = b.column("grp").to_numpy(), b.column("part").to_numpy()
                groups = s.group(_unsigned(b.column("group")), b.column("stream"), grp, part, *(b.column(c).to_numpy() for c in ("n", "total", "offset")))
                each = np.repeat(np.arange(b.num_rows), sizes[a:z])
                s.add(_unsigned(b.column("keys").flatten()), groups[each], b.column("items").flatten(), b.column("counts").flatten().to_numpy())
                if s.full(s.most // 2):  # the last row's group may go on
                    yield s.leave(groups[-1:])
        yield s.leave()

    return run


def _key(group, item):
    """The hash that a key goes by in tables; two keys of one hash would be one, at a chance of 2^-64 for two."""
    return F.xxhash64(group, item)


def summaries(entries: DataFrame, counters: int = COUNTERS, slots: int = SLOTS, fan_in: int = FAN_IN) -> DataFrame:
    """SUMMARY rows of entries (stream, grp, item, weight), one for each group, saved.

    Tasks summarise their own share, then summaries are merged in steps of about fan_in tasks' at a time: a group that a third
    of all rows have is as many summaries as there are tasks, and no task gets more than a few of them, each of bounded size.
    """
    group = F.xxhash64("stream", "grp")
    rows = entries.select(*ENTRIES, group.alias("group"), _key(group, F.col("item")).alias("key"))
    now = saved(rows.mapInArrow(W.released(_counted(counters, slots)), SUMMARY), "summaries")
    tasks = (now.agg(F.max("part").alias("n")).first()["n"] or 0) + 1
    while True:
        tasks = -(-tasks // fan_in)
        now = now.withColumn("part", F.expr(f"part div {fan_in}")).withColumn("group", F.xxhash64("stream", "grp", "part"))
        now = now.withColumn("keys", F.transform("items", lambda x: _key(F.col("group"), x)))
        now = now.repartition("stream", "grp", "part").sortWithinPartitions("stream", "grp", "part")
        now = saved(now.mapInArrow(W.released(_merged(counters, slots)), SUMMARY), "summaries")
        if tasks == 1:
            return now.drop("part")


def heavy_keys(entries: DataFrame, parts: int = PARTS, counters: int = COUNTERS, slots: int = SLOTS, fan_in: int = FAN_IN) -> DataFrame:
    """stream, grp, item, n_entries, total, w, low, estimate, high: exactly the keys with parts * w > total of their group.

    entries: stream, grp, item, weight. Summaries give, for every group, all keys that may be heavy, since none is missed whose
    weight is above the offset, at most 2 / counters of the total; so counters must be more than 2 * parts. They are counted
    again over all entries, in a join by key whose counts are partial sums before they are shuffled.

    Entries with a null stream, group, item or weight drop out, and so do those with a weight below 0, for which no bounded summary is
    exact; a weight of 0 is counted as an entry. Repeated entries count again. A group whose total is 0 has no heavy keys. No
    entries give no rows. Sums must stay under 2^63 / (4 * parts). A very long item is a string like any other. Columns besides
    the four don't matter.
    """
    if counters <= 2 * parts:
        raise ValueError("counters must be more than 2 * parts")
    entries = entries.where("stream IS NOT NULL AND grp IS NOT NULL AND item IS NOT NULL AND weight >= 0").select(*ENTRIES)
    s = summaries(entries, counters, slots, fan_in)
    each = s.select("stream", "grp", F.col("n").alias("n_entries"), "total", "offset", F.explode(F.arrays_zip("items", "counts")).alias("x"))
    high = F.col("x.counts") + F.col("offset")
    may = each.where(parts * high > F.col("total")).select("stream", "grp", F.col("x.items").alias("item"), "n_entries", "total", F.col("x.counts").alias("low"), (F.col("x.counts") + F.expr("offset div 2")).alias("estimate"), high.alias("high"))
    counts = entries.groupBy("stream", "grp", "item").agg(F.sum("weight").alias("w"))
    out = counts.join(may.hint("merge"), ["stream", "grp", "item"]).where(parts * F.col("w") > F.col("total"))
    return out.select("stream", "grp", "item", "n_entries", "total", "w", "low", "estimate", "high")


def _not_json(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_not_json)


def keys_of(props: str) -> list[str]:
    """`os=` plus device.os, `tag=` plus each of tags, `sku=` plus the sku of each of items; none if props aren't valid JSON.
    Numbers are as they are written, true and false too; null, objects and lists give no key, nor do parts of other types."""
    try:
        x = _DECODER.decode(props)
    except (ValueError, RecursionError):
        return []
    if type(x) is not dict:
        return []
    found, device, tags, items = [], x.get("device"), x.get("tags"), x.get("items")
    if type(device) is dict:
        found.append(("os=", device.get("os")))
    if type(tags) is list:
        found += [("tag=", t) for t in tags]
    if type(items) is list:
        found += [("sku=", i.get("sku")) for i in items if type(i) is dict]
    return [name + (v if type(v) is str else str(v).lower()) for name, v in found if type(v) in (str, bool)]


def _props(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [keys_of(p) for p in batch.column("props").to_pylist()]
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        flat = [k for each in keys for k in each]
        try:
            items = pa.array(flat, pa.string())
        except UnicodeEncodeError:  # halves of escaped surrogate pairs
            items = pa.array([k.encode("utf-8", "replace").decode() for k in flat], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("grp").to_numpy(), sizes)), items], ["grp", "item"])


def shop_entries(clicks: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """ENTRIES of the streams user (clients by the day of a click), part (items by vendor, weighed by quantity) and prop (keys in
    the props of a client's clicks)."""
    day = F.unix_date(clicks["ts"].cast("timestamp_ntz").cast("date")).cast("long")
    user = clicks.select(F.lit("user").alias("stream"), day.alias("grp"), clicks["client_id"].cast("string").alias("item"), F.lit(1).cast("long").alias("weight"))
    part = sale_lines.select(F.lit("part").alias("stream"), sale_lines["vendor_id"].cast("long").alias("grp"), sale_lines["item_id"].cast("string").alias("item"), sale_lines["quantity"].cast("long").alias("weight"))
    props = clicks.select(clicks["client_id"].cast("long").alias("grp"), clicks["props"].alias("props")).where("grp IS NOT NULL AND props IS NOT NULL")
    prop = saved(spread(props).mapInArrow(W.released(_props), "grp long, item string"), "props")
    return user.unionByName(part).unionByName(prop.select(F.lit("prop").alias("stream"), "grp", "item", F.lit(1).cast("long").alias("weight")))


def query(spark, sf_dir: str) -> DataFrame:
    clicks, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sale_lines"))
    return heavy_keys(shop_entries(clicks.select("ts", "client_id", "props"), lines.select("vendor_id", "item_id", "quantity")))
