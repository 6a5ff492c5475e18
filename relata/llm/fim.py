"""Fill-in-the-middle: texts cut into units at zero-width boundaries, and their parts put in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import spread

ANY, SPACE, BLACK, WORD, OTHER = ".", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"

#: A unit's grammar: the classes of the two characters that a boundary stands between, one pair for each kind of boundary.
#: character: code points; word: a word and the white space after it; line: a line and its end; token: runs of letters, digits
#: and underscores, and what is between them.
GRAMMARS = {
    "character": [(ANY, ANY)],
    "word": [(SPACE, BLACK)],
    "line": [(r"\n", ANY)],
    "token": [(WORD, OTHER), (OTHER, WORD)],
}
#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The pattern of a grammar's boundaries: it looks behind and ahead, and takes no character."""
    return "(?s)" + "|".join(f"(?<={before})(?={after})" for before, after in grammar)


def pieces(text: Column, unit: str = "character") -> Column:
    """A text's units in order, whose concatenation is the text; an empty text has none (a split would give one empty piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[unit]), -1))


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the document's id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, unit: str = "character", plain: int = 10, spm: int = 20, seed: str = "1", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form, output, prefix, middle, suffix (null if plain) per row of docs (doc_id, text).

    Two cuts between units, drawn from a hash of the id, make a prefix, a middle and a suffix. `plain` percent of the texts stay
    as they are, and so do empty ones and those that hold a mark; `spm` percent of the others begin with the suffix. Everything
    is an expression over one row: nothing is shuffled, and a rerun gives the same.

    A null text is an empty one; a null doc_id is hashed as an empty one; repeated rows give equal rows. A very long text is one
    row's array of units. An empty table gives none. Column names besides doc_id and text don't matter.
    """
    p, s, m = marks
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text")).withColumn("units", pieces(F.col("text"), unit))
    h = _draws(F.col("doc_id"), seed)
    n = F.size("units")
    cut = [(x % (n + 1)).cast("int") for x in h[:2]]
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", n.cast("long").alias("n"), F.least(*cut).alias("a"), F.greatest(*cut).alias("b"), form.alias("form"))
    part = lambda lo, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", lo + 1, size), ""))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b - a).alias("middle"), part(b, F.size("units") - b).alias("suffix"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
    output = output.when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", output.alias("output"), "prefix", "middle", "suffix")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. Marks don't occur in texts that were put in order, so the first of each kind is
    the one that was set."""
    p, s, m = marks

    def parts(first: str, second: str) -> list[Column]:
        """The texts after the first mark, after the second, and after the third."""
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(a) + len(second) + 1)
        b = F.substring_index(rest, m, 1)
        return [a, b, F.substr(rest, F.char_length(b) + len(m) + 1)]

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    rows = transform(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    digest = lambda c: F.sha2(c, 256)
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t)::BIGINT AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
