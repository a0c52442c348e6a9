"""Shared parts: lineage cuts in the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no lineage.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and all runs on one machine (tests) a temporary
    one is made: on a cluster each executor would write to a disk of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def batch(columns: dict[str, list | pa.Array], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = [columns[n] if isinstance(columns[n], (pa.Array, pa.ChunkedArray)) else pa.array(columns[n], t) for n, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts; the same in every engine that has md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: comparable ids, also structs), component its smallest reachable node.

    Alternating large-star and small-star rounds, each one grouped minimum and one join on the node; nothing
    but a convergence count reaches the driver. A hot node's edges shrink by partial aggregation in the
    minimum, and its join partition is one that adaptive execution can split. Self edges are allowed (they
    only declare a node). Raises if the rounds do not suffice.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut(small)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == last:
            return nodes.join(now.groupBy("a").agg(F.min("b").alias("m")), nodes.node == F.col("a"), "left").select("node", F.coalesce("m", "node").alias("component"))
        last = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def append_columns(df: DataFrame, of: str, f: Callable[[list], dict[str, list]], types: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """df and new columns that f makes of the values of column `of`, batch by batch. Columns of df may have any names; new ones replace those of their names."""
    arrow = {n: t for n, (_, t) in types.items()}
    inner = [f"c{i}" for i in range(len(df.columns))]
    place = df.columns.index(of)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row = b.column(0)
            made = f(row.field(place).to_pylist())
            yield pa.RecordBatch.from_arrays([row, *[pa.array(made[n], t) for n, t in arrow.items()]], ["__row", *arrow])

    renamed = df.toDF(*inner)
    schema = f"__row {renamed.schema.simpleString()}, " + ", ".join(f"{n} {t}" for n, (t, _) in types.items())
    kept = [F.col(f"__row.{i}").alias(c) for i, c in zip(inner, df.columns) if c not in types]
    return renamed.select(F.struct(*inner).alias("__row")).mapInArrow(run, schema).select(*kept, *arrow)


def joined_by_site(df: DataFrame, sites: DataFrame, on: Column, bound: int = 50_000) -> DataFrame:
    """Left join with a table of sites: broadcast only if it has been counted to be within the bound."""
    return df.join(F.broadcast(sites) if sites.count() <= bound else sites, on, "left")


def aside(df: DataFrame, needed: tuple[str, ...] = DOCUMENT_COLUMNS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its other columns under names that clash with nothing, and what selects all columns under their own names again."""
    names = [c if c in needed else f"__aside_{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)])
