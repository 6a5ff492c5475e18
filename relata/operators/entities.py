"""Titles, redirects, links and in-links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parse import LINKS
from .datasets import sent

#: In-links of a title that are stored as one list, about.
PART_LINKS = 1000


def titles_and_redirects(dump: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(title of every page, redirects among them; title, dest of the redirect pages) of a dump (title, redirect)."""
    return dump.select("title").distinct(), dump.where("redirect IS NOT NULL").select("title", F.col("redirect").alias("dest")).dropDuplicates(["title"])


def valid_redirects(redirects: DataFrame, titles: DataFrame) -> DataFrame:
    """redirects (title, dest) whose destination is a title."""
    return redirects.join(titles.select(F.col("title").alias("dest")), "dest", "left_semi").select("title", "dest")


def resolved(rows: DataFrame, redirects: DataFrame, column: str = "title") -> DataFrame:
    """rows with the column's titles followed through one redirect; a second hop isn't taken."""
    hop = redirects.select(F.col("title").alias(column), "dest")
    return rows.join(hop, column, "left").withColumn(column, F.coalesce("dest", column)).drop("dest").select(rows.columns)


def contained(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """rows whose title is known, be it as a redirect."""
    return rows.join(titles.select("title").distinct(), "title", "left_semi")


def size(titles: DataFrame) -> DataFrame:
    """n: the number of titles, redirects among them."""
    return titles.agg(F.countDistinct("title").alias("n"))


def inlink_counts(links: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """title, n of every title: mentions among links (title), each counted where its title redirects to, 0 if none."""
    counts = links.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    folded = resolved(counts, valid_redirects(redirects, titles)).groupBy("title").agg(F.sum("n").alias("n"))
    return titles.select("title").join(folded, "title", "left").select("title", F.coalesce("n", F.lit(0)).alias("n"))


def inlink_count(titles: DataFrame, counts: DataFrame, redirects: DataFrame) -> DataFrame:
    """Counts of asked titles, redirects followed; 0 where a title is unknown."""
    return resolved(titles.withColumn("asked", F.col("title")), redirects).join(counts, "title", "left").select(F.col("asked").alias("title"), F.coalesce("n", F.lit(0)).alias("n"))


def out_links(pages: DataFrame) -> DataFrame:
    """source, title, text: every link in the paragraphs of pages (title, paragraphs)."""
    each = pages.select(F.col("title").alias("source"), F.explode("paragraphs.wiki_links").alias("links")).select("source", F.explode("links").alias("x"))
    return each.select("source", "x.title", "x.text")


def with_resolved_links(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """pages (title, paragraphs) with their links' titles followed through one redirect. Only the links that are redirects are
    joined back to their page, as its own small map."""
    hops = out_links(pages).select("source", "title").distinct().join(redirects, "title").groupBy(F.col("source").alias("title"))
    hops = hops.agg(F.map_from_entries(F.collect_list(F.struct(F.col("title").alias("from"), "dest"))).alias("hops"))

    def follow(link):
        return F.struct(F.coalesce(F.try_element_at(F.col("hops"), link["title"]), link["title"]).alias("title"), link["text"].alias("text"), link["link_type"].alias("link_type"))

    def paragraph(p):
        return F.struct(p["text"].alias("text"), F.transform(p["wiki_links"], follow).alias("wiki_links"), p["abstract"].alias("abstract"))

    both = pages.select("title", "paragraphs").join(hops, "title", "left")
    return both.select("title", F.when(F.col("hops").isNull(), F.col("paragraphs")).otherwise(F.transform("paragraphs", paragraph)).alias("paragraphs"))


def in_link_parts(links: DataFrame, targets: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """title, part, links: what links to the targets (links: source, title, text), in lists of about part_links each. A title
    that half of all pages link to has as many parts as that takes, chosen by a hash, and no task holds all of its links. The
    titles with several parts are sent to all tasks if they are few enough."""
    some = links.join(targets.select("title").distinct(), "title", "left_semi")
    several = some.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_links)
    several = sent(several.select("title", F.expr(f"(n + {part_links - 1}) div {part_links}").alias("parts")), "parts")
    place = F.coalesce(F.pmod(F.xxhash64("source", "text"), "parts"), F.lit(0)).cast("int")
    rows = some.join(several, "title", "left").select("title", place.alias("part"), F.struct(F.col("source").alias("title"), "text", F.lit("in").alias("link_type")).alias("x"))
    return rows.groupBy("title", "part").agg(F.sort_array(F.collect_list("x")).alias("links"))


def in_links(parts: DataFrame) -> DataFrame:
    """title, x (title, text, link_type): the links of `in_link_parts`, a row each, as its parts are read."""
    return parts.select("title", F.explode("links").alias("x"))


def page_tables(pages: DataFrame, links: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target pages: title, paragraphs; their in-links in parts). links: source, title, text. Links to pages that weren't seen
    go."""
    seen = pages.join(targets.select("title").distinct(), "title", "left_semi")
    return seen, in_link_parts(links, seen)


def page_database(dump: DataFrame, parsed: DataFrame, kb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`page_tables` of the pages of a knowledge base's entities. dump: title, redirect; parsed: title, paragraphs."""
    titles, redirects = titles_and_redirects(dump)
    hops = valid_redirects(redirects, titles)
    pages = with_resolved_links(parsed, hops)
    return page_tables(pages, out_links(pages), target_titles(kb, hops))


def target_titles(kb: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """title: the distinct titles of a knowledge base, as they are or (with redirects) resolved."""
    titles = kb.select("title").distinct()
    return titles if redirects is None else resolved(titles, redirects).distinct()


def chosen(paragraphs, abstract_only: bool = False):
    return F.filter(paragraphs, lambda p: p["abstract"]) if abstract_only else paragraphs


def page_text(paragraphs, abstract_only: bool = False):
    """Paragraph texts, joined by one space, white space collapsed."""
    return T.collapsed(F.array_join(F.transform(chosen(paragraphs, abstract_only), lambda p: p["text"]), " "))


def page_links(paragraphs, in_links, incoming: bool = True, outgoing: bool = True, abstract_only: bool = False):
    """Out-links (of the abstract only, if asked), then all in-links."""
    out = F.flatten(F.transform(chosen(paragraphs, abstract_only), lambda p: p["wiki_links"]))
    empty = F.array().cast(LINKS)
    return F.concat(out if outgoing else empty, in_links if incoming else empty)
