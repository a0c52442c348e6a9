"""A Merkle manifest of a corpus: a tree of digests for each language, one over the languages, and every document's proof.

Leaves get their place in their tree without a sort in one task: a range partitioning by tree, id and digest, counts
of its partitions, and ranks within them. Blocks of 8**4 consecutive leaves are then ordered arrays of bounded size, and
sequence, transform, slice and aggregate collapse up to four levels of them at once. As blocks are aligned with the runs of
eight, their roots are the leaves of the same problem, 4096 times smaller, until one block is left. Paths of siblings come
down the same way. Only digests are shuffled; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Nodes of a run, and levels that a block collapses.
RUN, LEVELS = 8, 4
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(c: Column) -> Column:
    """A value as a leaf takes it: - for null, else its bytes in UTF-8, a colon and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in values]), 256)


def _run(nodes: Column, i: Column) -> Column:
    """The run of eight that node i (from 0) stands in."""
    return F.slice(nodes, (F.floor(i / RUN) * RUN + 1).cast("int"), RUN)


def _levels(nodes: Column, up: Column) -> Column:
    """Levels 0 to `up` of a block: an array of arrays of digests."""
    def above(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / RUN).cast("int"))
        return F.concat(levels, F.array(F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(below, r * RUN + 1, RUN), ""), 256))))

    return F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= up), F.array(nodes), above)


def _siblings(levels: Column, i: Column, up: Column) -> Column:
    """What stands left and right of node i and of its ancestors within their runs, from below."""
    def at(k: Column) -> Column:
        own = F.floor(i / F.pow(F.lit(float(RUN)), k.cast("double"))).cast("int")
        run, place = _run(F.element_at(levels, k + 1), own), (own % RUN).cast("int")
        return F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("left"), F.array_join(F.slice(run, place + 2, RUN), "").alias("right"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: k < up), at)


def places(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ...) with pos, their place in their tree by `order` (from 0), and size, the tree's nodes. Equal nodes take adjoining places."""
    keyed = cut(nodes.withColumn("__n", F.monotonically_increasing_id()))  # equal rows need not lie in one range
    ranged = cut(keyed.repartitionByRange("tree", *order, "__n").withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "__part").agg(F.count("*").alias("n"))  # a row for each tree and partition it is in
    by_part = Window.partitionBy("tree").orderBy("__part")
    starts = counts.select("tree", "__part", (F.sum("n").over(by_part) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    rank = F.row_number().over(Window.partitionBy("tree", "__part").orderBy(*order, "__n")) - 1
    return ranged.withColumn("rank", rank).join(starts, ["tree", "__part"]).withColumn("pos", F.col("start") + F.col("rank")).drop("__n", "__part", "rank", "start")


def _depth(size: Column) -> Column:
    """Levels above n nodes: how often eight make one until one is left."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda d, _: F.when(F.pow(F.lit(float(RUN)), d.cast("double")) < size, d + 1).otherwise(d))


def _levels_of(blocks: DataFrame) -> Column:
    return _levels(F.transform("rows", lambda r: r["node"]), blocks["up"])


def climb(nodes: DataFrame, kept: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, and (tree, root), of placed nodes (tree, pos, size, node, kept). Rounds grow with the logarithm of the largest tree to base 4096."""
    rounds, at = [], nodes.withColumn("depth", _depth(F.col("size")))
    while True:
        here = at.withColumns({"block": F.floor(F.col("pos") / BLOCK), "at": (F.col("pos") % BLOCK).cast("int")})
        rows = F.sort_array(F.collect_list(F.struct("at", "node", *([] if rounds else kept))))
        rounds.append(blocks := cut(here.groupBy("tree", "block", "depth").agg(rows.alias("rows")).withColumn("up", F.least(F.col("depth"), F.lit(LEVELS)).cast("int"))))
        at = blocks.select("tree", F.col("block").alias("pos"), (F.col("depth") - F.col("up")).alias("depth"), F.element_at(F.element_at(_levels_of(blocks), -1), 1).alias("node"))
        if blocks.where("depth > up").isEmpty():
            return rounds, at.select("tree", F.col("node").alias("root"))


def descend(rounds: list[DataFrame], kept: list[str], trees: DataFrame) -> DataFrame:
    """(tree, node, kept, path, ...) of every node of climbed trees. trees: tree, path, what stands above its root, and columns that all its nodes get.

    path: array of (left, right), the siblings on each level, from below.
    """
    above = trees.withColumn("block", F.lit(0).cast("long"))
    common = [c for c in trees.columns if c not in ("tree", "path")]
    for i in reversed(range(len(rounds))):
        kept_here = [] if i else kept
        blocks = rounds[i].withColumn("levels", _levels_of(rounds[i])).join(above, ["tree", "block"])
        each = F.transform("rows", lambda r: F.struct(r["at"].alias("at"), r["node"].alias("node"), *[r[c].alias(c) for c in kept_here], _siblings(F.col("levels"), r["at"], F.col("up")).alias("own")))
        opened = blocks.select("tree", "block", "path", *common, F.explode(each).alias("r"))
        place = (F.col("block") * BLOCK + F.col("r.at")).alias("block")
        above = opened.select("tree", place, "r.node", *[F.col(f"r.{c}").alias(c) for c in kept_here], F.concat("r.own", "path").alias("path"), *common)
        above = above.drop("node") if i else above.drop("block")
    return above


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, path, subroot, root): a row for each of docs (doc_id, source, lang, n_chars, text; others are left out).

    path: siblings on each level of the language's tree, then of the tree over languages. tampered: the leaf of the row with its text's A-Z in lower
    case, where 3 divides the crc32 of the decimal doc_id; null elsewhere. Any field may be null: it is written as such, a null lang is a
    tree of its own and comes first, null ids come first in theirs and are never tampered with. An empty text is one of 0 bytes, long ones are
    read whole. Rows of one id follow by their leaf; equal rows are leaves of their own. No rows give none.
    """
    values = [F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = leaf([F.translate(c.cast("string"), CAPITALS, CAPITALS.lower()) if n == "text" else c for n, c in zip(FIELDS, values)])
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n"))  # n before v: null first, then by bytes
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf(values).alias("node"), F.when(chosen, lowered).alias("tampered"))
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    rounds, subroots = climb(places(leaves, ["doc_id", "node"]), ["doc_id", "tampered"])
    tops, roots = climb(places(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("node")), ["lang"]), ["lang"])
    trees = descend(tops, ["lang"], roots.withColumn("path", none))
    below = cut(trees.select(F.col("lang").alias("tree"), "path", F.col("node").alias("subroot"), "root"))
    return descend(rounds, ["doc_id", "tampered"], below).select("doc_id", F.col("node").alias("leaf"), "tampered", "path", "subroot", "root")


def verified(found: DataFrame) -> DataFrame:
    """A manifest with proof_sha256, the digest of all siblings on the path, folded_root, from the tampered leaf where there is one, and whether it is the root."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    done = found.withColumn("proof_sha256", proof).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
