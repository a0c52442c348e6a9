"""Best-fit packing by hierarchical residual packing.

Documents are tokenized once; longer ones are cut into full sequences, which are done, and a shorter first piece. Pieces are
packed best-fit, largest first, within groups of a bounded size. Nearly full bins leave; underfull bins
become items of the next round, whose groups are fewer and otherwise dealt, until one group holds them all or a round
no longer saves anything.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, cut

CAPACITY = 1024
END = 2
#: A bin with less room than this leaves a round.
SLACK = 4
GROUP = 40_000
_REMEMBER = 400_000
# Where the standard library's classes of letters and digits are those of the tokenizer's pattern.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BIN = "fill int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


class Tokens:
    """A text's ids as bytes (unsigned 32-bit, little-endian): those of the tokenizers library for the same vocabulary.

    The text is split by the tokenizer's pattern and each distinct piece is merged once while it is remembered; a
    text with special tokens goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _PLAIN.search(text):
            return np.array(self.merge(text), "<u4").tobytes()
        known, pieces = self.known, _PIECE.findall(text)
        if len(known) > _REMEMBER:
            known.clear()
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            for p in set(pieces).difference(known):
                known[p] = np.array(self.merge(p), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece: full ones at the end, what is left over at the beginning."""
    n, out, start = len(ids) // 4, [], 0
    length = (n - 1) % capacity + 1
    while start < n:
        out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
        start, length = start + length, capacity
    return out


def cut_up(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and an end, in pieces."""
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    end = np.array([END], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path)
        for b in it:
            rows = [(d, k, *p) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, p in enumerate(pieces_of(encode(t or "") + end, capacity))]
            yield batch(dict(zip(types, map(list, zip(*rows)))) if rows else {n: [] for n in types}, types)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(fills: list[int], capacity: int) -> list[list[int]]:
    """Items (by place) of each bin: largest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(fills)), key=lambda i: -fills[i]):
        size = fills[i]
        room = mask >> size
        if room:
            r = size + (room & -room).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r - size:
            by_room[r - size].append(b)
            mask |= 1 << (r - size)
    return bins


def _pack(capacity: int):
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["fill"].to_pylist(), t["members"].to_pylist()), key=lambda x: (x[0], [(m["doc_id"] is None, m["doc_id"], m["piece"]) if m["doc_id"] is not None else (True, 0, m["piece"]) for m in x[1]]))
        fills, members = [], []
        for group in best_fit([r[0] for r in rows], capacity):
            at, inside = 0, []
            for i in group:
                inside += [{**m, "offset": m["offset"] + at} for m in rows[i][1]]
                at += rows[i][0]
            fills.append(at)
            members.append(inside)
        kinds = pa.struct([pa.field(n, pa.int32() if n == "piece" else pa.int64()) for n in fields])
        return pa.table({"fill": pa.array(fills, pa.int32()), "members": pa.array(members, pa.list_(kinds))})

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Null or empty text: one piece, the end alone. Repeated rows are packed each. A null id stays null. Empty table: no
    rows. Other columns are ignored. path: the tokenizer's file, with its ranks for merging beside it (same name, .tiktoken).
    """
    pieces = cut(cut_up(docs, path, id_col, text_col, capacity))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    bins = pieces.select(F.col("length").cast("int").alias("fill"), F.array(item).alias("members"))
    done = [bins.where(F.col("fill") >= capacity)]
    rest = bins.where(F.col("fill") < capacity)
    n, before, k = rest.count(), None, 0
    while n:
        groups = -(-n // group)
        # dealt out by contents: the same rows fall into the same groups whenever a lost part is made again
        dealt = rest.withColumn("g", F.pmod(F.xxhash64(F.lit(k), F.col("members")[0]["doc_id"], F.col("members")[0]["piece"], F.col("members")[0]["ids_crc32"]), F.lit(groups)))
        packed = cut(dealt.groupBy("g").applyInArrow(_pack(capacity), _BIN))
        k, before = k + 1, n
        done.append(packed.where(F.col("fill") > capacity - slack))
        rest = packed.where(F.col("fill") <= capacity - slack)
        n = rest.count()
        if groups == 1 or n >= before:  # one group holds them all, or a fresh deal saved nothing
            done.append(rest)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
