"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: the space, after a random rotation, is cut into blocks, each
block has a small code of random unit vectors, and a direction is one codeword of every block. A vector is
list-decoded to all directions whose inner product with it reaches the cap's height, by extending partial tuples only
while the rest can still make up the height; one that exceeds only a few gets the ones nearest to it. Vectors meet in their filters
(within a label), and those that meet are verified by the exact cosine.

How high the caps lie and how many directions a code has follow from the number of vectors by one formula (plan):
a filter gets about `bucket` unrelated vectors, and a vector about LEAST filters of a code. A code's filters are not
independent, so its miss is measured: the share of random pairs just at the threshold that have no filter of a random
code in common. A random rotation makes that share the same for every pair, and independent codes (each with
a rotation of its own) multiply it; there are as many codes as bring it down to `miss`.

Equal vectors are one, with a multiplicity. Only 32 bytes for each vector and filter are shuffled: the filter, the vector's number and a
sketch of 128 signs of random projections. Pairs whose sketches differ in more bits than a linking pair's can (6.5 standard
deviations) are left out where they meet. A filter whose vectors are mostly unlike gives its few likely pairs, at most LIKELY
for each of its vectors; they are joined with the vectors and verified. A filter that gives more, or has more than `block`
vectors, is dense: only there vectors are brought together, in pairs of chunks of a bounded size, and what leaves is a count
per vector and the edges of a spanning forest, never all pairs. A pair that has dense filters counts in the first of them and nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, connected_components, cut

THRESHOLD = 0.93
MISS = 1e-4
BUCKET = 512
#: A vector that exceeds fewer directions gets so many that it comes nearest to.
LEAST = 3
BLOCK = 1500
#: A filter gives at most so many likely pairs for each of its vectors; one with more is dense.
LIKELY = 8
SIGNS = 128
SEED = 20
#: Parts of the space that a code is a product of.
BLOCKS = 2
#: A code's miss is measured on so many random codes, each with so many pairs.
TRIALS = 24
PAIRS = 128


def plan(n: int, dim: int, threshold: float = THRESHOLD, miss: float = MISS, bucket: float = BUCKET) -> dict:
    """Height of the caps, size of a code and number of codes for n vectors of `dim` dimensions.

    Where one dimension or two leave no room for caps, or a code misses nearly all pairs, one direction that
    everything exceeds is the code.
    """
    share = min(0.02, bucket / max(n, 1))
    height = min(0.8, NormalDist().inv_cdf(1 - share) / math.sqrt(dim))
    if dim >= 8:
        code = math.ceil(math.sqrt(LEAST / share))
        one = missed(dim, threshold, height, BLOCKS, code)
        if one < 0.9:
            return {"height": height, "blocks": BLOCKS, "code": code, "codes": math.ceil(math.log(miss) / math.log(one))}
    return {"height": -2.0, "blocks": 1, "code": 1, "codes": 1}


def pairs_at(cosine: float, n: int, dim: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at that cosine."""
    x, y = unit_rows(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    y = unit_rows(y - (x * y).sum(1, keepdims=True) * x)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * y


def missed(dim: int, threshold: float, height: float, blocks: int, code: int) -> float:
    """Share of random pairs at the threshold without a common filter of a code, two standard errors above the measured one."""
    rng, n = np.random.Generator(np.random.PCG64(SEED)), 0
    for seed in range(TRIALS):
        x, y = pairs_at(threshold, PAIRS, dim, rng)
        of = [directions(dim, blocks, code, [SEED, dim, seed])]
        n += PAIRS - len(sharing(filters(x, height, of), filters(y, height, of)))
    return (n + 2 * math.sqrt(n) + 3) / (TRIALS * PAIRS)


def sharing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows that have a filter in both."""
    both = np.concatenate([np.unique(np.stack(x, 1), axis=0) for x in (a, b)])
    found, times = np.unique(both, axis=0, return_counts=True)
    return np.unique(found[times > 1, 0])


def directions(dim: int, blocks: int, code: int, seed: int | list[int] = SEED) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.Generator(np.random.PCG64(seed))
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    codes = [rng.standard_normal((code, len(part))) for part in np.array_split(np.arange(dim), blocks)]
    return rotation, [c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(blocks) for c in codes]


def decode(x: np.ndarray, height: float, rotation: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters that each unit row of x exceeds, by row and filter."""
    x, parts, at = x @ rotation, [], 0
    for c in codes:
        parts.append(x[:, at : at + c.shape[1]] @ c.T)
        at += c.shape[1]
    rest = np.cumsum([p.max(1) for p in parts[::-1]], axis=0)[::-1]
    rows, key, score = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for i, p in enumerate(parts):
        left = rest[i + 1][rows] if i + 1 < len(parts) else 0.0
        reach = p[rows] + (score + left)[:, None] >= height
        r, c = np.nonzero(reach)
        score, key, rows = score[r] + p[rows[r], c], key[r] * len(codes[i]) + c, rows[r]
    few = np.flatnonzero(np.bincount(rows, minlength=len(x)) < LEAST)
    if len(few):
        kept = ~np.isin(rows, few)
        low, low_key = highest([p[few] for p in parts], LEAST)
        rows, key = np.concatenate([rows[kept], few[low]]), np.concatenate([key[kept], low_key])
        order = np.lexsort((key, rows))
        rows, key = rows[order], key[order]
    return rows, key


def filters(x: np.ndarray, height: float, codes: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) by row and filter, of all codes."""
    found, base = [], 0
    for rotation, parts in codes:
        rows, keys = decode(x, height, rotation, parts)
        found.append((rows, keys + base))
        base += math.prod(map(len, parts))
    rows, keys = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((keys, rows))
    return rows[order], keys[order]


def highest(parts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of the n directions with the highest inner products; each is made of a block's n highest codewords."""
    score, key = np.zeros((len(parts[0]), 1)), np.zeros((len(parts[0]), 1), np.int64)
    for p in parts:
        top = np.argsort(-p, axis=1, kind="stable")[:, :n]
        score = (score[:, :, None] + np.take_along_axis(p, top, 1)[:, None, :]).reshape(len(p), -1)
        key = (key[:, :, None] * p.shape[1] + top[:, None, :]).reshape(len(p), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :n]
        score, key = np.take_along_axis(score, best, 1), np.take_along_axis(key, best, 1)
    return np.repeat(np.arange(len(key)), key.shape[1]), key.ravel()


def unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signs(x: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits for each row: on which side of 128 random planes it lies."""
    planes = np.random.Generator(np.random.PCG64([SEED, x.shape[1], SIGNS])).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def most_differing(threshold: float) -> int:
    """Signs in which a pair at the threshold differs, 6.5 standard deviations above the mean."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return min(SIGNS, math.ceil(SIGNS * p + 6.5 * math.sqrt(SIGNS * p * (1 - p))) + 1)


def _decoder(plans: dict[int, dict]):
    """(rep, s, t, filters) of (rep, label hash, v): filters are hashed with the label and the dimension."""
    made: dict = {}
    types = {"rep": pa.int64(), "s": pa.int64(), "t": pa.int64(), "filters": pa.list_(pa.int64())}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, labels, vectors = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_pylist()
            out: list[list] = [[] for _ in vectors]
            sketch = np.zeros((len(vectors), 2), np.int64)
            for dim in {len(v) for v in vectors}:
                if dim not in made:
                    p = plans[dim]
                    made[dim] = p["height"], [directions(dim, p["blocks"], p["code"], [SEED, k]) for k in range(p["codes"])]
                of = [i for i, v in enumerate(vectors) if len(v) == dim]
                for at in range(0, len(of), 256):
                    some = of[at : at + 256]
                    x = unit_rows([vectors[i] for i in some])
                    sketch[some] = signs(x)
                    rows, keys = filters(x, *made[dim])
                    h = (keys.astype(np.uint64) + np.uint64(dim * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93) ^ labels[np.array(some)][rows]
                    h = ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)
                    for i, ks in zip(some, np.split(h, np.searchsorted(rows, np.arange(1, len(some))))):
                        out[i] = ks.tolist()
            yield batch({"rep": pa.array(ids), "s": pa.array(sketch[:, 0]), "t": pa.array(sketch[:, 1]), "filters": out}, types)

    return run


def _likely_pairs(most: int, likely: int):
    """Of rows (g, rep, s, t) sorted by g: (a, b), pairs of a filter that its sketches leave; or (g, null) for a dense one."""
    types = {"a": pa.int64(), "b": pa.int64()}

    def of_group(g: int, rep: np.ndarray, s: np.ndarray, t: np.ndarray, out: list) -> None:
        found, n = [], 0
        s, t = s.view(np.uint64), t.view(np.uint64)
        for i in range(len(rep) - 1):
            near = np.flatnonzero(np.bitwise_count(s[i + 1 :] ^ s[i]) + np.bitwise_count(t[i + 1 :] ^ t[i]) <= most)
            if len(near):
                other = rep[i + 1 + near]
                found.append((np.minimum(other, rep[i]), np.maximum(other, rep[i])))
                n += len(near)
                if n > likely * len(rep):
                    out.append((np.array([g]), None))
                    return
        out.extend(found)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in it:
            now = [c.to_numpy() for c in b.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            g, rep, s, t = now
            ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
            out: list = []
            for lo, hi in zip(np.append(0, ends[:-1])[:-1], ends[:-1]):  # the last group may go on in the next batch; no group is larger than a block
                if hi - lo > 1:
                    of_group(g[lo], rep[lo:hi], s[lo:hi], t[lo:hi], out)
            held = [c[ends[-2] if len(ends) > 1 else 0 :] for c in now]
            yield from made(out)
        if held is not None and len(held[0]) > 1:
            out = []
            of_group(held[0][0], *held[1:], out)
            yield from made(out)

    def made(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            a, b = np.concatenate([x for x, _ in out]), [pa.nulls(len(x), pa.int64()) if y is None else pa.array(y) for x, y in out]
            yield batch({"a": pa.array(a), "b": pa.concat_arrays(b)}, types)

    return run


def _verified(threshold: float):
    """Of rows (a, b, v, w): those whose cosine reaches the threshold, in double precision."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if len(b):
                v, w = b.column(2).to_pylist(), b.column(3).to_pylist()
                fits = np.zeros(len(b), bool)
                for dim in {len(x) for x in v}:
                    of = [i for i, (x, y) in enumerate(zip(v, w)) if len(x) == len(y) == dim]
                    if of:
                        fits[of] = (unit_rows([v[i] for i in of]) * unit_rows([w[i] for i in of])).sum(1) >= threshold
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fits)), b.column(1).filter(pa.array(fits))], ["a", "b"])

    return run


def _links_in_block(threshold: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """One filter, or two chunks of one: counts per vector, and a spanning forest of the links."""
        f, i, j = (k.as_py() for k in key[:3])
        rep, times, chunk = t["rep"].to_numpy(), t["times"].to_numpy(), t["chunk"].to_numpy()
        x = unit_rows(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1))
        first = np.arange(len(rep)) if i == j else np.flatnonzero(chunk == i)
        second = first if i == j else np.flatnonzero(chunk == j)
        linked = x[first] @ x[second].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        if linked.any():
            mine = [[k for k in ks if k < f] for ks in t["filters"].to_pylist()]
            at = {k: n for n, k in enumerate(sorted({k for ks in mine for k in ks}))}
            has = np.zeros((len(rep), len(at)), np.float32)
            for r, ks in enumerate(mine):
                has[r, [at[k] for k in ks]] = 1
            linked &= has[first] @ has[second].T < 0.5  # else an earlier filter has this pair
        counts = np.zeros(len(rep), np.int64)
        counts[first] += linked @ times[second]
        if i != j:
            counts[second] += linked.T @ times[first]
        label, edges = np.arange(len(rep)), []
        for r in np.flatnonzero(linked.any(1)):
            for c in second[linked[r]]:
                a, b = label[first[r]], label[c]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
                    edges.append((rep[first[r]], rep[c]))
        some = np.flatnonzero(counts)
        a = np.concatenate([rep[some], np.array([e[0] for e in edges], np.int64)])
        b = np.concatenate([np.full(len(some), -1, np.int64), np.array([e[1] for e in edges], np.int64)])
        return pa.table({"a": a, "b": b, "n": np.concatenate([counts[some], np.zeros(len(edges), np.int64)])})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors`.

    Only vectors with equal, non-null labels and as many components are compared. A null or empty vector, one of
    zeros, and one with null or non-finite components link with nothing: 0 links, component its own id. Rows
    repeated with their id count as vectors of their own in n_links, and are all kept or none. A null id has links, and
    a null component if all ids in it are null. An empty table gives no rows. Other columns are ignored.
    """
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    fine = "label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False))).withColumn("v", F.expr("if(fine, transform(v, x -> if(x = 0, abs(x), x)), null)"))
    rows = rows.withColumn("digest", F.when(F.col("fine"), F.xxhash64("label", "v", F.lit(7))))
    # equal vectors of a label are one: told apart by two hashes of 64 bits, and numbered once, in what is written
    rows = cut(rows.withColumn("other", F.when(F.col("fine"), F.xxhash64(F.lit(11), "v", "label"))))
    groups = rows.where("fine").groupBy("digest", "other").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"), F.first("v").alias("v"), F.first("label").alias("label"))
    groups = cut(groups.withColumn("rep", F.monotonically_increasing_id()).withColumn("node", F.struct(F.col("low").isNull().alias("none"), "low", "rep")))
    n = groups.count()
    plans = {r.dim: plan(n, r.dim, threshold) for r in groups.select(F.size("v").alias("dim")).distinct().collect()}
    decoded = cut(groups.select("rep", F.xxhash64("label").alias("l"), "v").mapInArrow(_decoder(plans), "rep long, s long, t long, filters array<long>"))
    dealt = decoded.select(F.explode("filters").alias("g"), "rep", "s", "t")
    large = cut(dealt.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > block).select("g"))
    small = dealt.join(F.broadcast(large) if large.count() <= 50_000 else large, "g", "left_anti")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(small.select("g", "rep", "s", "t").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_likely_pairs(most_differing(threshold), LIKELY), "a long, b long"))
    dense = cut(large.union(met.where("b is null").select("a")))
    counts, edges = _dense_links(decoded, groups, dense, threshold, block)
    of = groups.select("rep", "v", "label", "times", "node")
    pairs = met.where("b is not null").distinct().join(of.select(F.col("rep").alias("a"), F.col("v").alias("v"), F.col("label").alias("l")), "a").join(of.select(F.col("rep").alias("b"), F.col("v").alias("w"), F.col("label").alias("m")), "b").where("l = m")
    if not dense.isEmpty():  # pairs with a dense filter are counted there
        of_rep = decoded.select("rep", F.explode("filters").alias("g")).join(dense, "g").groupBy("rep").agg(F.collect_list("g").alias("gs"))
        pairs = pairs.join(of_rep.select(F.col("rep").alias("a"), F.col("gs").alias("x")), "a", "left").join(of_rep.select(F.col("rep").alias("b"), F.col("gs").alias("y")), "b", "left")
        pairs = pairs.where(~F.coalesce(F.arrays_overlap("x", "y"), F.lit(False)))
    linked = cut(pairs.select("a", "b", "v", "w").mapInArrow(_verified(threshold), "a long, b long"))
    ends = linked.join(of.select(F.col("rep").alias("a"), F.col("node").alias("x"), F.col("times").alias("n")), "a").join(of.select(F.col("rep").alias("b"), F.col("node").alias("y"), F.col("times").alias("m")), "b")
    ends = cut(ends.select("a", "b", "x", "y", "n", "m"))
    counts = counts.union(ends.select("a", "m")).union(ends.select("b", "n")).groupBy("rep").agg(F.sum("n").alias("n"))
    reached = connected_components(edges.union(ends.select("x", "y"))).select(F.col("node.rep").alias("rep"), F.col("component.low").alias("component_id"), F.lit(True).alias("met"))
    placed = groups.join(counts, "rep", "left").join(reached, "rep", "left").select("digest", "other", F.expr("coalesce(n, 0) + times - 1").alias("n_links"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    out = rows.join(placed, ["digest", "other"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _dense_links(decoded: DataFrame, groups: DataFrame, dense: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rep, n) and (a, b: nodes): links counted and a spanning forest of them, of the dense filters."""
    dealt = decoded.select("rep", F.explode("filters").alias("g")).join(dense, "g")
    of_rep = dealt.groupBy("rep").agg(F.collect_list("g").alias("filters"))
    sizes = dealt.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    dealt = dealt.join(sizes, "g").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), "chunks").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("i", F.least("chunk", "with")).withColumn("j", F.greatest("chunk", "with"))
    dealt = dealt.join(of_rep, "rep").join(groups.select("rep", "times", "v", F.xxhash64("label").alias("l"), F.size("v").alias("dim")), "rep")
    met = cut(dealt.select("l", "dim", "g", "i", "j", "rep", "times", "chunk", "v", "filters").groupBy("g", "i", "j", "l", "dim").applyInArrow(_links_in_block(threshold), "a long, b long, n long"))
    node = groups.select("rep", "node")
    forest = met.where("n = 0").select("a", "b").join(node.select(F.col("rep").alias("a"), F.col("node").alias("x")), "a").join(node.select(F.col("rep").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    return met.where("b = -1 and n > 0").select(F.col("a").alias("rep"), "n"), forest.select(F.col("x").alias("a"), F.col("y").alias("b"))
