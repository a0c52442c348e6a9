"""Joins of intervals by binary parts, so that overlap is an equality of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut, last_seen_of_groups, same_keys, spread

#: Scales of 2**0 to 2**SCALES units.
SCALES = 40
#: Rows that are swept at a time, and rows of a group up to which it is one task's to sweep.
SWEPT, FEW = 1 << 16, 50_000


def _log(c: Column) -> Column:
    """The least s with 2**s >= c, for whole numbers from 1."""
    return F.length(F.bin(c - 1)) - F.when(c == 1, 1).otherwise(0)


def _bin(x: Column, scale: Column) -> Column:
    return F.call_function("shiftright", x, scale)  # of whole numbers, rounds down below zero too


def overlapping(a: DataFrame, b: DataFrame, by: list[str], unit: float = 1.0) -> DataFrame:
    """All columns of a and of b (other names than by) for intervals [a0, a1) and [b0, b1) of one group that share more than a point.

    An interval has the scale of its own length, at which it lies in two bins at most. The shorter of two looks into the bins of the longer one's
    scale, so each is dealt to at most two bins for each scale that the other side has. Of bins that a pair shares only the first counts. Ends are
    taken as whole numbers of units; intervals with a null end or without length meet nothing.
    """
    whole = lambda c: F.round(F.col(c) / unit).cast("long")
    length = lambda side: whole(f"{side}1") - whole(f"{side}0")
    own = lambda side: F.col(f"__{side}s")

    def at(df: DataFrame, side: str, scales: Column) -> DataFrame:
        """Only the interval's own columns and its bin are shuffled; what follows from them is worked out again where they meet."""
        out = df.withColumn("__scale", F.explode(scales)).drop(f"__{side}s")
        first, last = _bin(whole(f"{side}0"), F.col("__scale")), _bin(whole(f"{side}1") - 1, F.col("__scale"))
        return out.withColumn("__bin", F.explode(F.sequence(first, last)))

    left, right = (df.where(length(side) > 0).withColumn(f"__{side}s", _log(length(side))) for side, df in (("a", a), ("b", b)))
    known = {side: sorted(r[0] for r in df.select(own(side)).distinct().collect()) for side, df in (("a", left), ("b", right))}
    if not known["a"] or not known["b"]:
        return same_keys(a, b, by).where("false")
    itself = lambda side, met: F.when(met, F.array(own(side))).otherwise(F.array().cast("array<int>"))
    longer = lambda side, other, equal: F.filter(F.lit(known[other]), lambda s: (s >= own(side)) if equal else (s > own(side)))
    met = [  # b is at least as long as a, or a is longer; an interval that has no such other is not dealt
        (at(left, "a", longer("a", "b", True)), at(right, "b", itself("b", own("b") >= known["a"][0]))),
        (at(left, "a", itself("a", own("a") > known["b"][0])), at(right, "b", longer("b", "a", False))),
    ]
    first = F.greatest(_bin(whole("a0"), F.col("__scale")), _bin(whole("b0"), F.col("__scale")))
    meets = (F.col("__bin") == first) & (whole("a0") < whole("b1")) & (whole("b0") < whole("a1"))
    pairs = [same_keys(x, y, [*by, "__scale", "__bin"]).where(meets) for x, y in met]
    return pairs[0].unionByName(pairs[1]).select(*a.columns, *[c for c in b.columns if c not in by])


def widest_overlap(a: DataFrame, b: DataFrame, by: list[str], a_id: str, b_id: str, unit: float = 1.0) -> DataFrame:
    """(by, a_id, b_id, share): the interval of b that holds most of each of a, of equal ones the smallest b_id; a's without any are left out. share is of a's length."""
    held = (F.least("a1", "b1") - F.greatest("a0", "b0")) / (F.col("a1") - F.col("a0"))
    best = overlapping(a, b, by, unit).withColumn("share", held).groupBy(*by, a_id).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col(b_id).alias(b_id))).alias("t"))
    return best.select(*by, a_id, F.col(f"t.{b_id}").alias(b_id), (-F.col("t.s")).alias("share"))


def _parts(lo: Column, hi: Column) -> Column:
    """The binary parts (scale, bin) that together are [lo, hi): at each scale the left end's part if it is a right half, and the right end's if it is a left one."""
    def step(state: Column, s: Column) -> Column:
        a, b = state["a"], state["b"]
        left = F.when((a < b) & (a % 2 == 1), F.array(F.struct(s.alias("s"), a.alias("n")))).otherwise(F.array().cast("array<struct<s:int,n:bigint>>"))
        right = F.when((a < b) & (b % 2 == 1) & ((a % 2 == 0) | (b - 1 > a)), F.array(F.struct(s.alias("s"), (b - 1).alias("n")))).otherwise(F.array().cast("array<struct<s:int,n:bigint>>"))
        return F.struct(F.ceil(a / 2).cast("long").alias("a"), F.floor(b / 2).cast("long").alias("b"), F.concat(state["out"], left, right).alias("out"))

    start = F.struct(lo.alias("a"), hi.alias("b"), F.array().cast("array<struct<s:int,n:bigint>>").alias("out"))
    # no part is longer than the whole
    return F.aggregate(F.sequence(F.lit(0), F.least(F.length(F.bin(hi - lo)), F.lit(SCALES))), start, step, lambda state: state["out"])


def _above(parts: Column, top: int, itself: bool) -> Column:
    """The parts that hold these, up to the scale `top`, each once."""
    up = F.transform(parts, lambda p: F.transform(F.filter(F.sequence(p["s"], F.lit(top)), lambda s: (s >= p["s"]) if itself else (s > p["s"])), lambda s: F.struct(s.alias("s"), F.floor(p["n"] / F.pow(F.lit(2.0), (s - p["s"]).cast("double"))).cast("long").alias("n"))))
    return F.array_distinct(F.flatten(up))


def _swept(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (by, at, turn, ord, a, b, item, heading) in the order of by, at, turn and ord as (by, item, heading), whole groups at a time.

    A heading (turn 0) paints its places over what was painted before; the last one over an item's places is the nearest that overlaps it.
    """
    def sweep(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        lo, hi, turn = (t.column(c).fill_null(0).to_numpy() for c in ("a", "b", "turn"))
        met = (t.column("a").is_valid().to_numpy() & t.column("b").is_valid().to_numpy() & t.column("at").is_valid().to_numpy()) & (lo < hi)
        x, g = np.concatenate([lo, hi]), np.concatenate([group, group])
        order = np.lexsort((x, g))  # a group's ends are places of its own
        place = np.empty(len(x), np.int64)
        place[order] = np.cumsum(np.r_[False, (np.diff(g[order]) != 0) | (np.diff(x[order]) != 0)])
        painted, best = np.full(len(x) + 1, -1, np.int32), np.full(len(lo), -1, np.int64)
        rows = np.flatnonzero(met)
        for i, first, last, own in zip(rows.tolist(), place[rows].tolist(), place[rows + len(lo)].tolist(), turn[rows].tolist()):
            if own:
                best[i] = painted[first:last].max()
            else:
                painted[first:last] = i
        items = np.flatnonzero(turn == 1)
        # an item's repeats are one row; of its headings the last in order is the nearest
        once = pa.table({"g": group[items], "item": t.column("item").take(pa.array(items)), "row": items, "best": best[items]}).group_by(["g", "item"]).aggregate([("row", "min"), ("best", "max")])
        row, found = once.column("row_min"), once.column("best_max").to_numpy()
        heading = t.column("heading").take(pa.array(found, mask=found < 0))
        return pa.Table.from_arrays([*[t.column(c).take(row) for c in (*by, "item")], heading], [*by, "item", "heading"]).combine_chunks().to_batches()

    def groups(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for c in by:
            codes = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = pa.concat_arrays([x.indices for x in codes.chunks]) if isinstance(codes, pa.ChunkedArray) else codes.indices
            new[1:] |= np.diff(codes.to_numpy()) != 0
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, want = [], 0, SWEPT
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < want:
                continue
            t = pa.Table.from_batches(held)
            group = groups(t)
            end = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if end:
                yield from sweep(t.slice(0, end), group[:end])
            held, n = t.slice(end).to_batches(), len(t) - end
            want = max(SWEPT, 2 * n)
        if n:
            t = pa.Table.from_batches(held)
            yield from sweep(t, groups(t))

    return run


def nearest_above(items: DataFrame, headings: DataFrame, by: list[str], unit: float = 1.0, slack: float = 0.0) -> DataFrame:
    """(by, item, heading): each item with the nearest heading not below it (by more than slack) that overlaps it in x; of equally near ones the greatest ord.

    items: by, item, y, x0, x1; headings: by, ord, hy, hx0, hx1, heading. An item's repeats are one row. Rows are shuffled once, each as it is, and a task
    sweeps its groups from above; only groups of more than FEW rows are dealt by binary parts. x is taken in whole units.
    """
    whole = lambda c: F.round(F.col(c) / unit).cast("long")
    lines = [
        headings.select(*by, F.col("hy").cast("double").alias("at"), F.lit(0).alias("turn"), "ord", whole("hx0").alias("a"), whole("hx1").alias("b"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), "heading"),
        items.select(*by, (F.col("y") + slack).cast("double").alias("at"), F.lit(1).alias("turn"), F.lit(None).cast(headings.schema["ord"].dataType).alias("ord"), whole("x0").alias("a"), whole("x1").alias("b"), "item", F.lit(None).cast(headings.schema["heading"].dataType).alias("heading")),
    ]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*[items.schema[c] for c in by], items.schema["item"], headings.schema["heading"]])
    swept = lambda rows: rows.repartition(*by).sortWithinPartitions(*by, "at", "turn", "ord").mapInArrow(_swept(by), kinds)
    named = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    both = lines[0].unionByName(lines[1])
    large = cut(both.groupBy(*named).agg(F.count("*").alias("__n")).where(F.col("__n") > FEW).drop("__n"))
    if large.isEmpty():
        return swept(both)
    few = F.broadcast(large)
    held = lambda df, how: df.join(few, [df[c].eqNullSafe(large[f"__g{i}"]) for i, c in enumerate(by)], how)
    return swept(held(both, "left_anti")).unionByName(_nearest_by_parts(held(items, "left_semi"), held(headings, "left_semi"), by, unit, slack))


def _nearest_by_parts(items: DataFrame, headings: DataFrame, by: list[str], unit: float, slack: float) -> DataFrame:
    """As nearest_above, for groups of any size. Two intervals overlap where a binary part of one is part of one of the other's. So
    under every part the headings and items of one side by side are put in the order of y, and each item takes the last heading seen; pairs are
    never made, and an interval is dealt to at most the square of the logarithm of its width.
    """
    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        a, b = F.round(F.col(lo) / unit).cast("long"), F.round(F.col(hi) / unit).cast("long")
        return df.where(a < b).withColumn("__parts", _parts(a, b))

    their, own = cut(dealt(spread(headings), "hx0", "hx1")), cut(dealt(spread(items), "x0", "x1"))  # both are read three times
    scales = [df.select(F.max(F.array_max(F.transform("__parts", lambda p: p["s"])))).first()[0] for df in (their, own)]
    none = items.select(*by, "item").distinct()
    if None in scales:
        return none.withColumn("heading", F.lit(None).cast(headings.schema["heading"].dataType))
    top = max(scales)
    found = F.struct(F.col("hy").alias("hy"), F.col("ord").alias("ord"), F.col("heading").alias("heading"))
    empty = F.lit(None).cast(headings.select(found.alias("f")).schema["f"].dataType)
    sides = []
    for kind, up, down in ((0, their, own), (1, own, their)):  # a heading's part holds the item's or is it; or the item's holds the heading's
        for df in (up, down):
            deal = F.col("__parts") if df is up else _above(F.col("__parts"), top, kind == 0)
            at = df.withColumn("__p", F.explode(deal))
            line = [*by, F.lit(kind).alias("kind"), F.col("__p.s").alias("s"), F.col("__p.n").alias("n")]
            sides.append(at.select(*line, F.col("hy").cast("double").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), found.alias("f"), F.col("ord").alias("ord")) if df is their else at.select(*line, (F.col("y") + slack).cast("double").alias("at"), F.lit(1).alias("turn"), "item", empty.alias("f"), F.lit(None).cast(headings.schema["ord"].dataType).alias("ord")))
    both = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    keys, order = [*by, "kind", "s", "n"], ["at", "turn", "ord", "item"]
    met = last_seen_of_groups(both, keys, order, F.col("f"), "last").where("turn = 1 and last is not null")
    best = met.groupBy(*by, "item").agg(F.max_by(F.col("last.heading"), F.struct("last.hy", "last.ord")).alias("heading"))
    return same_keys(none, best, [*by, "item"], "left")
