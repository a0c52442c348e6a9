"""Cuts of lineage, joins on keys that may be null, and sums and fills that go on from one range of rows to the next."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where all runs on one machine (tests) a temporary one is made if it is unset."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df in as many equal parts as shuffles have, however few files or small blocks it comes from: for steps that make many rows of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of one name in which null equals null; the left one's keys stay."""
    other = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)]
    return left.join(other, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


#: Rows of a side that meet those of the other at a time, and pairs that leave a task at a time.
BLOCK, PAIRS = 1024, 1 << 16


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, key), two of them arrays, as rows of every x with every y."""
    for batch in batches:
        (xs, ys, _), names = batch.columns, batch.schema.names
        for i in range(batch.num_rows):
            x, y, key = xs[i].values, ys[i].values, batch.column(2).slice(i, 1)
            step = max(1, PAIRS // len(y))
            for at in range(0, len(x), step):
                some = x.slice(at, step)
                n = len(some) * len(y)
                left, right = np.repeat(np.arange(len(some)), len(y)), np.tile(np.arange(len(y)), len(some))
                yield pa.RecordBatch.from_arrays([some.take(pa.array(left)), y.take(pa.array(right)), key.take(pa.array(np.zeros(n, np.int8)))], names)


def all_pairs(a: DataFrame, b: DataFrame, by: list[str], a_value: str, b_value: str) -> DataFrame:
    """(a_value, b_value, the last of by): the equi-join on by where few groups are so large that their pairs outnumber both sides by far. Null keys meet nothing.

    Rows of a group are dealt by their values to blocks of about BLOCK, and each block of a meets each of b in a row of its own: so the pairs of one group are many
    tasks' and a task holds two blocks. Joined by the group alone they would be one task's, and small inputs are brought together to few. Pairs are
    made in Arrow batches; a generator would hold all pairs of two blocks before it hands on the first.
    """
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias(name))
    blocks = count(a, "__na").join(count(b, "__nb"), by)

    def dealt(df: DataFrame, value: str, mine: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(value), F.col(f"__n{mine}")).alias(f"__{mine}")
        held = df.select(*by, value).join(blocks, by).groupBy(*by, block, f"__n{other}").agg(F.collect_list(F.struct(value))[value].alias(value))
        return held.select(*by, f"__{mine}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__n{other}") - 1)).alias(f"__{other}"), value).repartition(n, *by, "__a", "__b")

    met = dealt(a, a_value, "a", "b").join(dealt(b, b_value, "b", "a"), [*by, "__a", "__b"]).select(a_value, b_value, by[-1])
    kinds = [a.schema[a_value], b.schema[b_value], a.schema[by[-1]]]
    return met.mapInArrow(_pairs, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds))


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df in ranges of (by, order), numbered by __part and cut: a group of any size lies in as many ranges as it needs."""
    return cut(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))


def _within(by: list[str], order: list[str]):
    return Window.partitionBy(*by, "__part").orderBy(*order)


def _before(by: list[str]):
    return Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(ranges: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of value up to each row. Ranges carry their totals on, so no task has more rows than a range, and the window over totals has a row for each range."""
    sums = ranges.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    carried = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(_before(by)), F.lit(0)).alias("__carry"))
    inside = ranges.withColumn(name, F.sum(value).over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    return same_keys(inside, carried, [*by, "__part"]).withColumn(name, F.col(name) + F.col("__carry")).drop("__carry")


def previous(ranges: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The value of the row before; of a range's first row it is that of the last range that has the group. The order has to be total."""
    marked = ranges.withColumn("__v", F.struct(value.alias("v")))
    ends = marked.groupBy(*by, "__part").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    carried = ends.select(*by, "__part", F.last("__end").over(_before(by)).alias("__carry"))
    inside = marked.withColumn("__in", F.lag("__v").over(_within(by, order)))
    return same_keys(inside, carried, [*by, "__part"]).withColumn(name, F.coalesce("__in", "__carry")["v"]).drop("__v", "__in", "__carry")


def following(ranges: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The value of the row after, likewise."""
    marked = ranges.withColumn("__v", F.struct(value.alias("v")))
    starts = marked.groupBy(*by, "__part").agg(F.min_by("__v", F.struct(*order)).alias("__start"))
    after = Window.partitionBy(*by).orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    carried = starts.select(*by, "__part", F.first("__start").over(after).alias("__carry"))
    inside = marked.withColumn("__in", F.lead("__v").over(_within(by, order)))
    return same_keys(inside, carried, [*by, "__part"]).withColumn(name, F.coalesce("__in", "__carry")["v"]).drop("__v", "__in", "__carry")


def last_seen(ranges: DataFrame, by: list[str], order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """The last value that is not null up to each row (its own counts if inclusive). The order has to be total."""
    marked = ranges.withColumn("__v", value)
    ends = marked.where(F.col("__v").isNotNull()).groupBy(*by, "__part").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    parts = same_keys(marked.select(*by, "__part").distinct(), ends, [*by, "__part"], "left")
    carried = parts.select(*by, "__part", F.last("__end", ignorenulls=True).over(_before(by)).alias("__carry"))
    inside = marked.withColumn("__in", F.last("__v", ignorenulls=True).over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    return same_keys(inside, carried, [*by, "__part"]).withColumn(name, F.coalesce("__in", "__carry")).drop("__v", "__in", "__carry")


#: Rows of a group up to which it is one task's to sort; larger ones go from range to range.
WHOLE = 1_000_000


def last_seen_of_groups(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """As last_seen, of rows that are mostly in small groups: these are shuffled once, and only groups of more than WHOLE rows go through ranges."""
    named = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    large = cut(df.groupBy(*named).agg(F.count("*").alias("__n")).where(F.col("__n") > WHOLE).drop("__n"))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = lambda rows: rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    if large.isEmpty():
        return filled(df)
    on = [df[c].eqNullSafe(large[f"__g{i}"]) for i, c in enumerate(by)]
    few = F.broadcast(large)
    rest = last_seen(ranged(df.join(few, on, "left_semi"), by, order), by, order, value, name).drop("__part")
    return filled(df.join(few, on, "left_anti")).unionByName(rest)
