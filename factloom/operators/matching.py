"""Joins that Spark has no single operator for, as equi-joins and grouped extremes. None of them is a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as T
from .lineage import cut
from .rounds import unchained


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, as a lookup table keeps it."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def overlay(base: DataFrame, over: DataFrame, keys: list[str], value: str, override: str) -> DataFrame:
    """base with `value` replaced where `over` has one."""
    found = over.select(*keys, F.col(override).alias("__over"))
    return base.join(found, keys, "left").withColumn(value, F.coalesce("__over", value)).drop("__over")


def nearest_above(items: DataFrame, headings: DataFrame, by: list[str], slack: float = 2.0) -> DataFrame:
    """Each item with the nearest heading not below it that overlaps it in x; of equally near ones the later.

    items: by, item, y, x0, x1; headings: by, ord, hy, hx0, hx1, heading. Pairs are made within a page only.
    """
    pairs = items.join(headings, by).where((F.col("hy") <= F.col("y") + slack) & (F.least("x1", "hx1") - F.greatest("x0", "hx0") > 0))
    best = pairs.groupBy(*by, "item").agg(F.max_by("heading", F.struct("hy", "ord")).alias("heading"))
    return items.select(*by, "item").join(best, [*by, "item"], "left")


def widest_overlap(segments: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """(by, segment, col, share): the column that holds most of a segment; equal shares: the first column."""
    pairs = segments.join(columns, by)
    share = F.greatest(F.lit(0.0), F.least("x1", "e1") - F.greatest("x0", "e0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9))
    return pairs.withColumn("share", share).groupBy(*by, "segment").agg(F.max_by("col", F.struct("share", -F.col("col"))).alias("col"), F.max("share").alias("share"))


def mutual_nearest(a: DataFrame, b: DataFrame, by: list[str], reach: float) -> DataFrame:
    """(by, a, b, gap) of points within reach that are each the other's nearest; x cells of the reach's width make it an equi-join.

    a: by, a, x; b: by, b, c. Equally near ones: the smaller number.
    """
    cells = b.withColumn("__cell", F.explode(F.array(*[F.floor(F.col("c") / reach) + i for i in (-1, 0, 1)])))
    pairs = a.withColumn("__cell", F.floor(F.col("x") / reach)).join(cells, [*by, "__cell"]).withColumn("gap", F.abs(F.col("x") - F.col("c"))).where(F.col("gap") <= reach)
    of_a, of_b = Window.partitionBy(*by, "a").orderBy("gap", "b"), Window.partitionBy(*by, "b").orderBy("gap", "a")
    return pairs.withColumn("__a", F.row_number().over(of_a)).withColumn("__b", F.row_number().over(of_b)).where("__a = 1 and __b = 1").select(*by, "a", "b", "gap")


def contained_aliases(aliases: DataFrame, lines: DataFrame, line_keys: list[str], text: str = "line") -> DataFrame:
    """(alias, line keys): every token of the alias is on the line.

    An alias or a line that is listed twice gives one match; lines of one key with other texts are lines of their own. Lines of the same tokens are one
    set, and aliases of the same tokens too. An alias is looked up in the sets by its rarest token alone, so that a word that many lines and aliases have
    does not bring each with each; then lines take what their set has.
    """
    seen = lines.select(*line_keys, T.alias_tokens(F.col(text)).alias("__t")).where(F.size("__t") > 0)
    sets = cut(seen.select("__t").distinct())
    known = aliases.select("alias", T.alias_tokens(F.col("alias")).alias("__a")).where(F.size("__a") > 0).distinct()
    tokens = sets.select("__t", F.explode("__t").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n"))
    # a token that no set has is the rarest one and finds nothing
    asked = known.select("__a").distinct().select("__a", F.explode("__a").alias("token")).join(often, "token", "left")
    rarest = asked.groupBy("__a").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    met = tokens.join(rarest, "token").where(F.size(F.array_except("__a", "__t")) == 0).select("__t", "__a")
    return seen.distinct().join(met, "__t").join(known, "__a").select("alias", *line_keys).distinct()


def table_row(line: Column) -> Column:
    """A printed row of a table: a digit, 9 to 219 characters, at most ten words before the first digit."""
    t = F.trim(line)
    words = F.size(F.filter(F.split(F.regexp_extract(t, r"^[^\d]*", 0), r"\s+"), lambda x: x != ""))
    return (F.length(t) > 8) & (F.length(t) < 220) & t.rlike(r"\d") & (words <= 10)


def uncaptured(tokens: DataFrame, cells: DataFrame, page: str, token: str, cell: str) -> DataFrame:
    """Money tokens of a page that none of its captured cells holds."""
    held = cells.select(page, N.money_token(F.col(cell)).alias("__t")).distinct()
    return tokens.where(N.is_money(F.col(token))).withColumn("__t", N.money_token(F.col(token))).join(held, [page, "__t"], "left_anti").drop("__t")


def without_earlier_year(rows: DataFrame, by: list[str], share: float = 0.005, floor: float = 0.02) -> DataFrame:
    """Rows whose closing is no other row's opening. rows: by, id, opening, closing. No pairs are made: see rounds.unchained."""
    return unchained(rows, by, share, floor)


def keyword_totals(rows: DataFrame, rules: DataFrame, label: Column, value: Column, ref: Column | None = None, exclude: tuple[str, ...] = (), bound: int = 10_000) -> DataFrame:
    """(section, total, n, refs): rows whose label has one of the section's words and none of `exclude`, each row once for each section.

    Equal rows are rows of their own. n counts the rows, total adds up their values (null if none has one), refs are
    the rows' references, sorted. Rules are counted: up to the bound of sections they travel to the rows at once, beyond it in
    blocks of about that size, since a part of a label is no key to join on.
    """
    lists = rules.groupBy("section").agg(F.collect_set("word").alias("__words"))
    blocks = -(-max(lists.count(), 1) // bound)
    parts = [lists] if blocks == 1 else [lists.where(F.pmod(F.xxhash64("section"), F.lit(blocks)) == i) for i in range(blocks)]
    seen = rows.select(label.alias("__label"), value.alias("__value"), (F.lit(None).cast("string") if ref is None else ref.cast("string")).alias("__ref"))
    for word in exclude:
        seen = seen.where(~F.col("__label").contains(word))
    hit = None
    for part in parts:
        found = seen.join(F.broadcast(part), F.exists("__words", lambda w: F.col("__label").contains(w))).select("section", "__value", "__ref")
        hit = found if hit is None else hit.unionByName(found)
    return hit.groupBy("section").agg(F.sum("__value").alias("total"), F.count("*").alias("n"), F.array_sort(F.collect_list("__ref")).alias("refs"))
