"""Verification: identities that printed figures must meet, grounding in the source, votes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N


def balance_ties(a: Column, b: Column) -> Column:
    return F.coalesce((a != 0) & (b != 0) & (F.abs(a - b) < F.greatest(F.abs(a) * 0.005, F.lit(1.0))), F.lit(False))


def profit_anchor(before: Column, tax: Column, after: Column, income: Column, expense: Column) -> Column:
    """Profit after tax if it ties, else profit before tax if income less expense ties (more loosely), else null."""
    return F.when(N.within(before - tax, after, 0.005, 2), after).when(N.within(income - expense, before, 0.02, 5), before)


def cash_anchor(operating: Column, investing: Column, financing: Column, fx: Column, change: Column, opening: Column, closing: Column) -> Column:
    fx = F.coalesce(fx, F.lit(0.0))
    return F.when(N.within(operating + investing + financing + fx, change, 0.02, 5), change).when(N.within(opening + change + fx, closing, 0.02, 5), closing)


def block_closes(values: Column, tolerance: float = 0.02) -> Column:
    """Opening, with each of at most 8 movements added or taken away, is the closing: every choice of signs is tried."""
    n = F.size(values)
    moves = F.slice(values, F.lit(2), F.greatest(n - 2, F.lit(0)))
    signed = lambda mask: F.aggregate(F.transform(moves, lambda m, i: m * (1 - 2 * F.expr("1") * ((F.floor(mask / F.pow(F.lit(2.0), i))) % 2))), values[0], lambda s, x: s + x)
    tried = F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.greatest(F.least(n - 2, F.lit(8)), F.lit(0))) - 1).cast("int"))
    return F.when((n < 2) | (n > 10), False).otherwise(F.exists(tried, lambda mask: F.abs(signed(mask) - F.element_at(values, -1)) < tolerance))


def row_identity(values: Column) -> Column:
    """3 to 8 signed numbers, the last the sum of the others, to 0.1 % or 0.6."""
    n = F.size(values)
    total = F.aggregate(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    last = F.element_at(values, -1)
    return F.when((n < 3) | (n > 8), False).otherwise(F.abs(total - last) < F.greatest(F.abs(last) * 0.001, F.lit(0.6)))


def components_reconcile(components: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, parent, reconciled): sum of components (null: 0) = total = parent, to 1 % or 1."""
    sums = components.groupBy(*by).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("sum"), F.first("total").alias("total"), F.first("parent").alias("parent"))
    return sums.withColumn("reconciled", F.coalesce(N.within(F.col("sum"), F.col("total"), 0.01, 1) & N.within(F.col("total"), F.col("parent"), 0.01, 1), F.lit(False)))


def grounded(value: Column, source: Column, least: int = 3) -> Column:
    """The value has at least so many digits, and they stand in a row among the source's digits."""
    d = N.digits(value)
    return F.coalesce((F.length(d) >= least) & N.digits(source).contains(d), F.lit(False))


def majority(reads: DataFrame, by: list[str], value: str, found: str, order: str) -> DataFrame:
    """(by, value, votes, confidence): the most frequent found value, the first seen of equally frequent ones; confidence over all reads."""
    number = N.parse_number(F.col(value))
    key = F.coalesce(F.bround(number, 4).cast("string"), F.lower(F.trim(F.coalesce(F.col(value), F.lit("")))))
    n = reads.groupBy(*by).agg(F.count("*").alias("__n"))
    votes = reads.where(F.col(found)).groupBy(*by, key.alias("__k")).agg(F.count("*").alias("votes"), F.min(order).alias("__first"), F.min_by(value, order).alias(value))
    first = votes.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "__first"))).where("__r = 1")
    return n.join(first, by, "left").select(*by, value, F.coalesce("votes", F.lit(0)).alias("votes"), F.bround(F.coalesce("votes", F.lit(0)) / F.col("__n"), 2).alias("confidence"))


def verdict(value: Column, found: Column, expected: Column) -> Column:
    got, want = N.parse_number(value), N.parse_number(expected)
    has = F.coalesce(found, F.lit(False)) & got.isNotNull()
    return (
        F.when(want.isNull() & ~has, "CORRECTLY_ABSENT").when(want.isNull(), "SPURIOUS").when(~has, "MISS")
        .when(N.close(got, want), "MATCH").when(N.scale_factor(got, want).isNotNull(), "SCALE_MISMATCH").otherwise("TRUE_ERROR")
    )


def cross_year(prior_in_current: Column, current_in_prior: Column) -> Column:
    a, b = N.parse_number(prior_in_current), N.parse_number(current_in_prior)
    return F.when(a.isNull() | b.isNull(), "INSUFFICIENT").when(N.close(a, b), "VERIFIED").otherwise("RESTATEMENT_OR_ERROR")


def first_tie(candidates: DataFrame, by: list[str], rank: str, ok: str) -> DataFrame:
    """The first candidate whose identity holds, else the first: (by, rank, status)."""
    out = candidates.groupBy(*by).agg(F.min(F.when(F.col(ok), F.col(rank))).alias("__tie"), F.min(rank).alias("__any"))
    return out.select(*by, F.coalesce("__tie", "__any").alias(rank), F.when(F.col("__tie").isNotNull(), "tie").otherwise("no-tie").alias("status"))


def sole_value(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value) where all rows agree to two decimals; where they don't, silence."""
    return rows.groupBy(*by).agg(F.count_distinct(F.bround(value, 2)).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def accuracy(rows: DataFrame, by: list[str], verdict_col: str) -> DataFrame:
    """(by, applicable, correct, accuracy_pct): matches and rightly absent ones over all but N/A."""
    n = F.count(F.when(F.col(verdict_col) != "N/A", 1))
    good = F.count(F.when(F.col(verdict_col).isin("MATCH", "CORRECTLY_ABSENT"), 1))
    return rows.groupBy(*by).agg(n.alias("applicable"), good.alias("correct")).withColumn("accuracy_pct", F.when(F.col("applicable") > 0, F.col("correct") * 100.0 / F.col("applicable")).otherwise(0.0))


def signs_close(opening: Column, movements: Column, closing: Column, tolerance: float = 0.02, most: int = 16) -> Column:
    """The opening, with each of at most `most` movements added or taken away, is the closing; null movements are left out, more do not close.

    The sums of the first half and what the second half leaves of the closing are sorted together (2 times 256 values for 16, not 65,536 sums). The closest two
    of different sides stand side by side there. Where their distance is the tolerance but for rounding, the sums are made whole and in the order of the
    movements, so that the answer is that of adding them up one by one; up to 20 movements, beyond which the halves decide.
    """
    moves = F.filter(movements, lambda m: m.isNotNull())
    half = F.floor((F.size(moves) + 1) / 2).cast("int")
    sums = lambda part, at: F.aggregate(part, F.array(at), lambda known, m: F.concat(F.transform(known, lambda x: x + m), F.transform(known, lambda x: x - m)))
    left = F.transform(sums(F.slice(moves, F.lit(1), half), opening.cast("double")), lambda x: F.struct(x.alias("v"), F.lit(0).alias("side")))
    right = F.transform(sums(F.slice(moves, half + 1, F.greatest(F.size(moves) - half, F.lit(0))), closing.cast("double")), lambda x: F.struct(x.alias("v"), F.lit(1).alias("side")))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(-1).alias("side"), F.lit(None).cast("double").alias("gap"))
    met = lambda s, x: F.struct(x["v"].alias("v"), x["side"].alias("side"), F.when((s["side"] >= 0) & (s["side"] != x["side"]), F.least(s["gap"], x["v"] - s["v"])).otherwise(s["gap"]).alias("gap"))
    size = F.abs(opening) + F.abs(closing) + F.aggregate(moves, F.lit(0.0), lambda t, m: t + F.abs(m)) + tolerance
    in_turn = F.exists(sums(moves, F.lit(0.0)), lambda x: F.abs(opening + x - closing) < tolerance)
    # of the least gap that the halves leave, one answer, looked at once
    told = lambda gap: F.when((F.abs(gap - tolerance) <= size * 1e-13) & (F.size(moves) <= 20), in_turn).otherwise(gap < tolerance)
    gaps = F.when(F.size(moves) <= most, F.array(F.aggregate(F.array_sort(F.concat(left, right)), start, met, lambda s: s["gap"])))
    return F.coalesce(F.get(F.transform(gaps, told), 0), F.lit(False))
