"""Order-dependent operators: forward fill, runs, clusters, page windows, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def forward_fill(df: DataFrame, by: list[str], order: str, signal: Column, initial: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(signal, ignorenulls=True).over(w), F.lit(initial)))


def backward_fill(df: DataFrame, by: list[str], order: str, signal: Column, name: str) -> DataFrame:
    """The next signal from each row on. Rows are taken from the last one up: a frame that ends with the group would be gone through anew for each row."""
    w = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(signal, ignorenulls=True).over(w))


def islands(df: DataFrame, by: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs; starts (it may use lag over the same order) is true where one begins. A null counts as no start but on the first row."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__s", F.coalesce(starts.cast("int"), F.lit(0))).withColumn(name, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def spans(df: DataFrame, by: list[str], order: str, tag: str) -> DataFrame:
    """(by, tag, first, last): runs of equal tags."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = islands(df, by, order, ~F.col(tag).eqNullSafe(F.lag(tag).over(w)))
    return runs.groupBy(*by, "island", tag).agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("island")


def clusters(df: DataFrame, by: list[str], page: str, gap: int = 1) -> DataFrame:
    """Number the groups of pages that are at most `gap` apart."""
    return islands(df, by, page, F.col(page) - F.lag(page).over(Window.partitionBy(*by).orderBy(page)) > gap, "cluster")


def context(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, name: str = "context") -> DataFrame:
    return df.withColumn(name, F.collect_list(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)))


def page_windows(hits: DataFrame, doc: str, page: str, last_page: Column, reach: int = 1) -> DataFrame:
    """Each hit's neighbouring pages, without repeats."""
    return hits.select(doc, F.explode(F.sequence(F.greatest(F.col(page) - reach, F.lit(1)), F.least(F.col(page) + reach, last_page))).alias(page)).distinct()


def interleave(a: DataFrame, b: DataFrame, by: list[str], item: str, rank: str) -> DataFrame:
    """(by, item, place): first of a, first of b, second of a, ...; a repeated item keeps its first place."""
    both = a.select(*by, item, F.col(rank), F.lit(0).alias("__side")).unionByName(b.select(*by, item, F.col(rank), F.lit(1).alias("__side")))
    first = both.groupBy(*by, item).agg(F.min(F.struct(rank, "__side")).alias("__at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("__at"))).drop("__at")


def gap_split(df: DataFrame, by: list[str], order: str, start: str, end: str, gap: float) -> DataFrame:
    """Segments of a row of boxes: a new one where the space after the last box exceeds the gap."""
    w = Window.partitionBy(*by).orderBy(order)
    return islands(df, by, order, F.col(start) - F.lag(end).over(w) > gap, "segment")
