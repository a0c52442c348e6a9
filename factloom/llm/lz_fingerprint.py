"""Document fingerprints of Lempel-Ziv phrases.

A text's bytes are parsed into dictionary phrases (the shortest ones not met before in it); the set of phrase hashes is
reduced to a minimum-hash signature of one permutation, empty places filled from the next. The share of equal places
estimates the Jaccard likeness of two phrase sets, which follows how well one text's dictionary compresses the other.

For a document and its edited text, the part that both begin with is parsed once. A document's successor is the next
row of a shuffle by ranges of about RANGE characters of the id; the first row of each range is also given to the range before. An id
that many rows have is spread over several ranges by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch

PLACES = 128
#: Characters of text in a range, about; and the most ranges that are made (beyond them ranges grow).
RANGE = 8_000_000
RANGES = 20_000


def parse(data: bytes, seen: set[int], h: int = 0) -> int:
    """Add the phrases of data to seen, going on from an unfinished phrase; returns the unfinished one."""
    add = seen.add
    for c in data:
        h = (h * 69069 + c + 1) & 1073741823
        if h not in seen:
            add(h)
            h = 0
    return h


def close(h: int, seen: set[int]) -> None:
    """Add what is left unfinished at the end, told apart from a phrase that is met again and goes on."""
    if h:
        seen.add((h * 69069 + 257) & 1073741823)


def signature(phrases: set[int]) -> np.ndarray:
    """One byte for each place; of no phrases, nothing."""
    if not phrases:
        return np.zeros(0, np.uint8)
    h = np.fromiter(phrases, np.uint64, len(phrases))
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h.sort()
    places, first = np.unique(h >> np.uint64(57), return_index=True)
    places = places.astype(np.int64)
    at = np.searchsorted(places, np.arange(PLACES)) % len(places)
    away = ((places[at] - np.arange(PLACES)) % PLACES).astype(np.uint64)
    low = h[first][at] * np.uint64(0xD6E8FEB86659FD93) + away * np.uint64(0xCA5A826395121157)
    return (low >> np.uint64(56)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness, 0 to 1: equal places beyond the 1 in 256 that agree by chance."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    return max(0.0, (float((a == b).mean()) - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: str | None) -> np.ndarray:
    seen: set[int] = set()
    close(parse((text or "").encode("utf-8", "surrogatepass"), seen), seen)
    return signature(seen)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Of text, and of its edited text, and that one's SHA-256."""
    half = len(text) // 2
    head, tail = text[: len(text) - half].encode(), text[len(text) - half :].encode()
    new = following[:half].encode()
    seen: set[int] = set()
    h = parse(head, seen)
    other = seen.copy()
    close(parse(tail, seen, h), seen)
    close(parse(new, other, h), other)
    return signature(seen), signature(other), hashlib.sha256(head + new).hexdigest()


def _stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, then id; a range's last row is marked ahead: it only is the last document's successor."""
    types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    held = None  # a document that waits for its successor: id, text
    known = None  # the last document that was fingerprinted with its successor, and what came of it
    waiting = None  # a row that waits for its successor's fingerprint
    out: list[tuple] = []

    def finish(own: np.ndarray) -> None:
        nonlocal waiting
        if waiting:
            i, n, sha, a, b = waiting
            out.append((i, n, sha, a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, own)))
            waiting = None

    for b in it:
        for part, ahead, i, text in zip(*[c.to_pylist() for c in b.columns]):
            text = text or ""
            if held is not None:
                if known is None or known[:2] != (held[1], text):
                    known = (held[1], text, both_fingerprints(held[1], text))
                a, e, sha = known[2]
                finish(a)
                waiting = (held[0], len(held[1]), sha, a, e)
            if ahead:
                finish(fingerprint(text))
                held = None
            else:
                held = (i, text)
        yield batch(dict(zip(types, map(list, zip(*out)))) if out else {n: [] for n in types}, types)
        out.clear()
    if held is not None or waiting:
        raise RuntimeError("a range has no successor")


def _ranges(rows: DataFrame, size: int) -> DataFrame:
    """rows with `part`: ranges of (doc_id, nulls last, h) in order. An id that is more than one bound is cut by its hashes into as many ranges."""
    spark = rows.sparkSession
    seen = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("doc_id").alias("ids"), F.count("*").alias("rows")).first()
    n = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen.chars or 0) // size)))
    with_id = max(1, round(n * (seen.ids / max(1, seen.rows))))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / with_id for i in range(1, with_id)] or [0.5], max(10_000, 20 * with_id))).first()[0] or []
    bounds, nulls = np.array(sorted(bounds), np.int64), max(1, n - with_id)

    @F.pandas_udf("int")
    def part(ids: pd.Series, nothing: pd.Series, hashes: pd.Series) -> pd.Series:
        none, unit, known = nothing.to_numpy(), hashes.to_numpy() / 2.0**64 + 0.5, ids.to_numpy()
        low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
        out = np.where(none, len(bounds) + 1 + np.minimum(nulls - 1, (unit * nulls).astype(np.int64)), low + np.where(high - low > 1, np.minimum(high - low - 1, (unit * (high - low)).astype(np.int64)), 0))
        return pd.Series(out.astype(np.int32))

    return rows.withColumn("part", part(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "h"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    A null text is an empty one; an empty text has an empty fingerprint, like (1) another empty one and unlike (0) all else. The
    order is by id, nulls last, then by a hash of the text, then the text; so repeated rows follow one another. The last document's
    successor is the first; a single document's is itself. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = _ranges(rows, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    firsts = sorted((r.part, r.low.doc_id, r.low.h) for r in rows.select("part", "doc_id", "h").groupBy("part").agg(first.alias("low")).collect())  # one row for each range
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = [(low, h, firsts[i - 1][0]) for i, (_, low, h) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "low long, low_h long, before int"))
    ahead = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("h") == F.col("low_h"))).groupBy(F.col("before").alias("part"), "doc_id", "h").agg(F.min("text").alias("text"))
    both = rows.select("part", F.lit(False).alias("ahead"), "doc_id", "h", "text").unionByName(ahead.select("part", F.lit(True).alias("ahead"), "doc_id", "h", "text"))
    n = min(len(firsts), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(firsts) // 4))
    dealt = both.repartition(n, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "h", "text")
    return dealt.select("part", "ahead", "doc_id", "text").mapInArrow(_stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
