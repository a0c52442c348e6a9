"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at `radius` = 4 or fewer differing bits. Of a linking pair's two 32-bit halves one
differs in at most 2 bits, so the pair meets in the middle there: every fingerprint emits, for each half, all
variants of that half within half of that radius (1 bit: 33 variants), rows are shuffled on (half, variant), and
pairs that meet are deduplicated and verified over all 64 bits. 66 rows per distinct fingerprint replace the
2,081 rows of a ball of 2 bits around all 64 bits; a collision of unrelated halves costs one comparison.

A bucket is held up to `block` fingerprints at a time; verified links leave it as a spanning forest, never as
all pairs. Members of a larger bucket emit the whole 64-bit ball instead (2,081 variants). There any two that meet
are linked by the triangle inequality, so that stars to each variant's smallest member are exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import aside, batch, connected_components, cut

RADIUS = 4
SHINGLE = 4
BLOCK = 4096
SEED = 42


def fingerprint(text: str | None) -> int:
    """Simhash of one text as an unsigned number; no words: 0."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII white space splits
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends]]
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])] if len(words) >= SHINGLE else [digest(joined, SEED)]
    ones, n = np.zeros(64, np.int64), len(hashes)
    values = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 8192):
        ones += np.unpackbits(values[at : at + 8192], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long: the bits as a signed number), one row per row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among values (distinct, unsigned)."""
    label, edges, todo = np.arange(len(values)), [], []
    for at in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[at + 1 :] ^ values[at]) <= radius) + at + 1
        if len(near):
            todo.append((at, near))
    for at, near in todo:
        for other in near[label[near] != label[at]]:
            if (a := label[at]) != (b := label[other]):
                label[label == max(a, b)] = min(a, b)
                edges.append((at, other))
    return edges


def _bucket_links(radius: int, block: int):
    types = {"a": pa.int64(), "b": pa.int64()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. A pair (fp, fp) means: in a bucket too large to hold."""
        key, held, over = None, [], False

        def close():
            if over:
                return [(v, v) for part in held for v in part.tolist()]
            values = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            return [(values[i], values[j]) for i, j in _forest(values, radius)]

        for b in it:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            out: list = []
            useful = np.flatnonzero((end - begin > 1) | (begin == 0) | (end == len(keys)))
            for i in useful:
                s, e = begin[i], end[i]
                if key is not None and keys[s] != key:
                    out += close()
                    held, over = [], False
                key = keys[s]
                held.append(fps[s:e])
                if over or sum(map(len, held)) > block:
                    over = True
                    out += close()
                    held = []
            ab = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield batch({"a": pa.array(ab[:, 0]), "b": pa.array(ab[:, 1])}, types)
        ab = np.array(close(), np.uint64).reshape(-1, 2).view(np.int64)
        yield batch({"a": pa.array(ab[:, 0]), "b": pa.array(ab[:, 1])}, types)

    return run


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly what all pairs of distinct `fp` within RADIUS bits connect."""
    distinct = fps.select("fp").distinct()
    ball = "transform(sequence(-1, 31), i -> xxhash64({n}, ({half}) ^ if(i < 0, 0L, shiftleft(1L, i))))"
    keys = f"concat({ball.format(n=0, half='fp & 4294967295L')}, {ball.format(n=1, half='shiftrightunsigned(fp, 32)')})"
    dealt = distinct.select(F.explode(F.expr(keys)).alias("key"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_bucket_links(RADIUS, block), "a long, b long").distinct())
    crowded = met.where("a = b").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return met
    pairs = "transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))"
    masks = f"concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)), flatten({pairs}))"
    variants = crowded.select(F.explode(F.expr(f"transform({masks}, m -> fp ^ m)")).alias("v"), "fp")
    stars = variants.join(variants.groupBy("v").agg(F.min("fp").alias("m")), "v").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()
    return met.where("a <> b").union(stars)


def labelled(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, first): the smallest label of all fingerprints reachable by links. nodes: fp (distinct), label (comparable, one for each fp, not null).

    Components run on the labels (with the fingerprint behind each, so that equal labels of two fingerprints stay two), so the
    component is the answer at once and no group of a component's members is ever made.
    """
    named = nodes.select("fp", F.struct("label", "fp").alias("node"))
    edges = links(nodes, block).where("a <> b")
    ends = edges.join(named.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    of = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    reached = of.select(F.col("node.fp").alias("fp"), F.col("component.label").alias("first"))
    return nodes.join(reached, "fp", "left").select("fp", F.coalesce("first", "label").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs.

    Equal fingerprints are one node, whatever the number of documents; component_id is the smallest doc_id reachable.
    Null or empty text: fingerprint zero, linked like any other. Repeated rows give repeated rows. A null doc_id
    has a fingerprint and a component (null only if all ids in it are). Empty table: no rows. Other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    low = F.min("doc_id")
    nodes = fps.groupBy("fp").agg(F.struct(low.isNull().alias("none"), low.alias("id")).alias("label"))
    by_fp = labelled(nodes, block).select("fp", F.col("first.id").alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component: the one with the smallest id (a null one is the largest), then text hash.

    Rows are told apart by id and two hashes of the text; of rows that are equal in these one stays. Null and empty texts are near-duplicates
    of one another. An empty table gives no rows. Columns are those of docs, whatever their names.
    """
    docs, own = aside(docs, (id_col, text_col))
    text = F.col(text_col).cast("string")
    marks = [F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(13), text).alias("__o")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t) for t in b.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps)], ["__id", "__h", "__o", "fp"])

    rows = cut(docs.select(*marks, text.alias("__t")).mapInArrow(run, "__id long, __h long, __o long, fp long"))
    key = F.struct(F.col("__id").isNull().alias("none"), "__id", "__h", "__o")
    first = labelled(rows.groupBy("fp").agg(F.min(key).alias("label")))
    keys = cut(rows.groupBy("__id", "__h", "__o", "fp").count().join(first, "fp").withColumn("stays", key.eqNullSafe(F.col("first"))))
    same = lambda k: marked["__id"].eqNullSafe(k["k_id"]) & (marked["__h"] == k["k_h"]) & (marked["__o"] == k["k_o"])
    named = [F.col("__id").alias("k_id"), F.col("__h").alias("k_h"), F.col("__o").alias("k_o")]
    marked = docs.select("*", *marks)
    drop = keys.where("not stays").select(*named)
    marked = marked.join(drop, same(drop), "left_anti")
    repeated = keys.where("stays and count > 1").select(*named)
    if not repeated.isEmpty():
        # one of each: a number is drawn for every row once, and the smallest of a key's numbers is found by partial aggregation
        again = cut(marked.join(repeated, same(repeated), "left_semi").withColumn("__n", F.monotonically_increasing_id()))
        least = again.groupBy("__id", "__h", "__o").agg(F.min("__n").alias("k_n")).select("k_n")
        marked = marked.join(repeated, same(repeated), "left_anti").unionByName(again.join(least, F.col("__n") == F.col("k_n"), "left_semi").drop("__n"))
    return own(marked)
