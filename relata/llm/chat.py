"""Chat formatting with Spark expressions, and reading the format back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
START, JOIN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"

#: Turns of one conversation that are collected into one row.
BLOCK = 64

DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _escaped(text):
    """`<`, any backslashes, `|` gets one backslash more, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _escaped_role(role):
    return _escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """The formatted conversations: conv_id, block, formatted, loss_spans (begin, length in code points of formatted).

    turns: conv_id, turn, role, text. Turns of a conversation are sorted by turn (null last; ties by role, then text) and
    collected BLOCK at a time; a conversation's blocks, put end to end, are its format, so no row holds more turns than that.
    Adjacent turns of one role are merged into one marked message, across blocks too, with a control string between them.
    loss_spans are the texts of the trained role, each on its own. A null text or role is an empty one; a null conv_id is a
    conversation of its own; repeated rows are turns each. A very long text is one turn of its row, escaped by one expression.
    An empty table gives none. Column names besides the four don't matter.
    """
    t = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    t = t.withColumn("n", F.row_number().over(by_turn) - 1)
    t = t.groupBy("conv_id", F.expr(f"n div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    first, last = F.col("turns")[0]["role"], F.element_at("turns", -1)["role"]
    t = t.withColumn("before", F.lag(last).over(by_block)).withColumn("after", F.lead(first).over(by_block))

    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<begin: long, length: long>>").alias("spans"), F.lit(0).cast("long").alias("size"), F.col("before").alias("role"))

    def add(done, turn):
        opened = F.when(done["role"].isNull(), F.lit("")).when(done["role"] == turn["role"], F.lit(JOIN)).otherwise(F.lit(END))
        head = F.concat(opened, F.when(done["role"].eqNullSafe(turn["role"]), F.lit("")).otherwise(F.concat(F.lit(START), _escaped_role(turn["role"]), F.lit("\n"))))
        text = _escaped(turn["text"])
        begin = done["size"] + F.length(head)
        span = F.array(F.struct(begin.cast("long").alias("begin"), F.length(text).cast("long").alias("length")))
        return F.struct(F.concat(done["parts"], F.array(head, text)).alias("parts"), F.when(turn["role"] == trained, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"), (begin + F.length(text)).cast("long").alias("size"), turn["role"].alias("role"))

    t = t.withColumn("folded", F.aggregate("turns", empty, add))
    close = F.when(F.col("after").isNull(), F.lit(END)).otherwise(F.lit(""))
    return t.select("conv_id", "block", F.concat(F.array_join("folded.parts", ""), close).alias("formatted"), F.col("folded.spans").alias("loss_spans"))


_MARK = re.compile("|".join(map(re.escape, (START, JOIN, END))))
_ESCAPED = re.compile(r"<\\(\\*)\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


class Reader:
    """Reads one conversation's blocks in order and keeps sums only, not the texts."""

    def __init__(self) -> None:
        self.role, self.turns, self.loss = "", hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def read(self, formatted: str, spans) -> None:
        self.chars += len(formatted)
        marks = list(_MARK.finditer(formatted))
        for k, m in enumerate(marks):
            if m[0] == END:
                continue
            text = formatted[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(formatted)]
            if m[0] == START:
                role, _, text = text.partition("\n")
                self.role = unescaped_role(role)
            self.n += 1
            self.turns.update(f"{self.role}\n{unescaped(text)}\n".encode())
        for x in spans:
            text = unescaped(formatted[x["begin"] : x["begin"] + x["length"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, read from its blocks one after another; a task holds a batch of blocks at a time."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reader = None, None
        for frame in frames:
            done = []
            for conv, text, spans in zip(frame["conv_id"], frame["formatted"], frame["loss_spans"]):
                conv = None if pd.isna(conv) else int(conv)
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv, Reader()
                reader.read(text, spans)
            yield pd.DataFrame(done, columns=DIGEST_NAMES).astype({"conv_id": "Int64"})
        if reader is not None:
            yield pd.DataFrame([reader.row(now)], columns=DIGEST_NAMES).astype({"conv_id": "Int64"})

    sorted_ = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return sorted_.select("conv_id", "formatted", "loss_spans").mapInPandas(read, DIGESTS)


DIGEST_NAMES = [x.split()[0] for x in DIGESTS.split(", ")]


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(extra)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) IS NOT DISTINCT FROM role AS joined,
             regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS e,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS r FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(e) + CASE WHEN joined THEN 10 ELSE 12 + length(r) + 1 + 11 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
