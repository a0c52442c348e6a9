"""Sweeps over the ends of intervals: how many cover each place, where that is most, where it is few; and the last row of another kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import following, last_seen, previous, ranged, running_sum


def coverage(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, from, to, n): stretches between neighbouring ends with the number of intervals [start, end) over them, those of none between others too.

    Every interval is two rows, whatever its length; equal ends are added up before they are shuffled. Intervals with a null end or without
    length cover nothing. A group may have any number of intervals: sums go on from range to range.
    """
    fine = intervals.where(F.col(start) < F.col(end))
    ends = fine.select(*by, F.explode(F.array(F.struct(F.col(start).alias("from"), F.lit(1).alias("d")), F.struct(F.col(end).alias("from"), F.lit(-1).alias("d")))).alias("e"))
    summed = ends.groupBy(*by, "e.from").agg(F.sum("e.d").alias("d"))
    ranges = ranged(summed, by, ["from"])
    steps = following(running_sum(ranges, by, ["from"], "d", "n"), by, ["from"], F.col("from"), "to")
    return steps.where("to is not null").select(*by, "from", "to", "n")


def most_covered(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, from): the greatest number over any place and the first place that has it."""
    top = steps.groupBy(*by).agg(F.max(F.struct("n", F.struct("from"))).alias("t"), F.max("n").alias("n"))
    first = steps.groupBy(*by, "n").agg(F.min("from").alias("from"))
    return first.join(top.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("n").alias("__n")), [first[c].eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("n") == F.col("__n")]).select(*by, "n", "from")


def gutters(steps: DataFrame, by: list[str], most: int = 0, width: float = 0.0) -> DataFrame:
    """(by, from, to): longest stretches that at most `most` intervals cover, wider than `width`, between a group's first and last end."""
    few = steps.withColumn("few", F.col("n") <= most)
    ranges = ranged(few, by, ["from"])
    begins = previous(ranges, by, ["from"], F.col("few"), "__was").withColumn("__start", F.when(F.col("few") & ~F.coalesce("__was", F.lit(False)), F.col("from")))
    runs = last_seen(begins, by, ["from"], F.col("__start"), "start").where("few")
    return runs.groupBy(*by, F.col("start").alias("from")).agg(F.max("to").alias("to")).where(F.col("to") - F.col("from") > width)


def last_of_another_kind(rows: DataFrame, by: list[str], order: list[str], kind: str, value: str, name: str = "before") -> DataFrame:
    """rows with the value of the group's last row before, by a total order, whose kind differs; null if there is none. Null is a kind of its own.

    Pairs are never made: where the kind changes, the row before is the last one of another kind, and it stays so until the kind changes again.
    """
    ranges = ranged(rows, by, order)
    prev = previous(ranges, by, order, F.struct(F.col(kind).alias("k"), F.col(value).alias("v")), "__p")
    changed = prev.withColumn("__c", F.when(F.col("__p").isNotNull() & ~F.col("__p.k").eqNullSafe(F.col(kind)), F.struct(F.col("__p.v").alias("v"))))
    return last_seen(changed, by, order, F.col("__c"), "__at").withColumn(name, F.col("__at.v")).drop("__p", "__c", "__at", "__part")
