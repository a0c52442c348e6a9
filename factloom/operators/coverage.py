"""What a reading of a report has left out, and what is put in its place: gaps, additions, unions of readings, scopes, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N
from .lineage import same_keys
from .readers import read_payloads
from .retrieval import bm25, top_k
from .rounds import accepted_in_order

# The headings by which a page is one of consolidated statements.
CONSOLIDATED = r"(?i)consolidated\s+balance sheet|forming part of the\s+consolidated\s+financial statements?"


def _parts(cell: Column) -> Column:
    return F.split(F.coalesce(cell, F.lit("")), r"\s+")


def captured(cells: DataFrame, by: list[str], cell: str = "cell") -> DataFrame:
    """(by, digits): the distinct numbers of four digits or more in the cells."""
    return cells.select(*by, F.explode(_parts(F.col(cell))).alias("__t")).select(*by, N.digits(F.col("__t")).alias("digits")).where("length(digits) >= 4").distinct()


def gap_pages(tokens: DataFrame, cells: DataFrame, least: int = 3, k: int = 4) -> DataFrame:
    """(doc, page, missing, rank): the first four pages with three printed amounts or more that no cell of the document holds.

    tokens: doc, page, token (every printed word, repeats included); cells: doc, cell. An amount has four digits and a comma or a point.
    """
    core = F.regexp_replace("token", r"^[.,;:()*]+|[.,;:()*]+$", "")
    printed = tokens.withColumn("__c", core).where(N.is_money(F.col("__c"))).withColumn("digits", N.digits(F.col("__c"))).where("length(digits) >= 4")
    missing = printed.join(captured(cells, ["doc"]), ["doc", "digits"], "left_anti").groupBy("doc", "page").agg(F.count("*").alias("missing")).where(F.col("missing") >= least)
    return top_k(missing, ["doc"], [F.col("page")], k)


def worthwhile(tables: DataFrame, cells: DataFrame, least: int = 3) -> DataFrame:
    """Tables (doc, page, n, grid) of another reading that bring three numbers of four digits or more which no cell of the document holds, nor a table taken before.

    Tables are taken by page and n; what one brings is covered for those after it. A number that a table has twice counts twice.
    """
    keys = ["doc", "page", "n"]
    values = tables.select(*keys, F.explode(F.flatten("grid")).alias("cell")).select(*keys, F.explode(_parts(F.col("cell"))).alias("t")).select("doc", F.struct("page", "n").alias("item"), N.digits(F.col("t")).alias("digits")).where("length(digits) >= 4")
    taken = accepted_in_order(values, ["doc"], "item", "digits", least, captured(cells, ["doc"]), repeats=True)
    return same_keys(tables, taken.select("doc", "item.page", "item.n"), keys, "left_semi")

def readings_together(found: DataFrame, recovered: DataFrame, filled: DataFrame, scanned: DataFrame) -> DataFrame:
    """(doc, page, n, source, place): found tables but for those of scanned pages, tables recovered from scans, and filled gaps, by page and number."""
    named = lambda d, name: d.select("doc", "page", "n", F.lit(name).alias("source"))
    both = named(found.join(scanned.select("doc", "page").distinct(), ["doc", "page"], "left_anti"), "found").unionByName(named(recovered, "recovered")).unionByName(named(filled, "filled"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("page", "n", "source")))


def placeholders(pages: DataFrame, financial: Column) -> DataFrame:
    """(doc, page, n, title): one marker table for each financial page of an image without text, so that none is passed over. pages: doc, page, text, has_image."""
    bare = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return pages.where(financial & bare & F.col("has_image")).select("doc", "page", F.lit(1).alias("n"), F.lit("image page, not extracted").alias("title"))


def scoped(tables: DataFrame, tags: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """tables with the scope of their pages, if it is allowed; of a document without any tag all stay, as "unknown". tags: doc, page, scope."""
    known = tags.where("scope is not null").select("doc", "page", "scope").distinct()
    tagged = known.select("doc").distinct().withColumn("__tagged", F.lit(True))
    out = tables.join(known, ["doc", "page"], "left").join(tagged, "doc", "left")
    return out.where(F.col("__tagged").isNull() | F.col("scope").isin(*allowed)).withColumn("scope", F.coalesce("scope", F.lit("unknown"))).drop("__tagged")


def scopes_filed(pages: DataFrame) -> DataFrame:
    """(doc, has_consolidated, has_standalone): a page tagged or headed as consolidated; any page that is not front matter. pages: doc, page, region, text."""
    consolidated = (F.col("region") == "CONSOLIDATED") | F.coalesce("text", F.lit("")).rlike(CONSOLIDATED)
    return pages.groupBy("doc").agg(F.bool_or(F.coalesce(consolidated, F.lit(False))).alias("has_consolidated"), F.bool_or(F.coalesce(F.col("region") != "FRONT", F.lit(False))).alias("has_standalone"))


def examples(concepts: DataFrame, whole: tuple[str, ...] = ("deferred_tax",), k: int = 3) -> DataFrame:
    """concepts with the aliases that are shown: the first three, of some sections all. concepts: section, aliases."""
    return concepts.withColumn("aliases", F.when(F.col("section").isin(*whole), F.col("aliases")).otherwise(F.slice("aliases", 1, k)))


def grounded_section(pages: DataFrame, terms: DataFrame, payloads: DataFrame, k: int = 8) -> DataFrame:
    """(query, doc, key, value, evidence, grounded, confidence): a section read from the pages that its terms rank first.

    pages: doc, page, text; terms: query, term; payloads: query, doc, payload (what a model returned for those pages). Values are
    cleaned, signed, summed and held against the text of the ranked pages; a document without any such page has no rows.
    """
    ranked = bm25(pages, terms, k=k)
    text = ranked.join(pages, ["doc", "page"]).groupBy("query", "doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "text")))["text"], "\n").alias("text"))
    read = read_payloads(payloads.join(text, ["query", "doc"]).select(F.struct("query", "doc").alias("id"), "payload", "text"))
    return read.select("id.query", "id.doc", "key", "value", "evidence", "grounded", "confidence")


def filled_absents(results: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """results (by, key, value) where absent values are taken from `found` (by, key, value, grounded) if grounded; a value that is there stays.

    Of several found ones the smallest counts, so that the result does not hang on their order.
    """
    keys = [*by, "key"]
    new = found.where(F.col("grounded") & F.col("value").isNotNull()).groupBy(*keys).agg(F.min("value").alias("__new"))
    out = results.join(new, keys, "left")
    return out.select(*keys, F.coalesce("value", "__new").alias("value"), (F.col("value").isNull() & F.col("__new").isNotNull()).alias("rescued"))
