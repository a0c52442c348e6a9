"""Readers without a model whose every value is proven by arithmetic: schedules with an asset a row, and deferred tax.

Candidate lines are few, so their splits are tried by arrays, a piece of a line in each row; lines are windowed by page only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as T
from . import reconcile as R, schedules as S, verify as V
from .ordered import backward_fill

# Items of deferred tax with the sets of words of which a row's label must hold one whole.
TAX_ITEMS = {
    "Accumulated Depreciation": (("property", "plant"), ("ppe",), ("depreciation", "intangible"), ("written", "down", "value")),
    "Leave Encashment": (("leave",), ("compensated",), ("employee", "benefit"), ("separation", "retirement")),
}
TOLERANCE = 0.02


def _all_words(s: Column, phrase: str) -> Column:
    return reduce(lambda a, b: a & b, [s.contains(w) for w in phrase.split()])


def row_score(line: Column, around: Column, asset: str) -> Column:
    """How surely a line (lower case) is an asset's row: 2 if it has the words, 1 if the lines around it have them, 0.5 if it has a lesser
    word and no other asset's; null for rows of other assets, of totals and of rights of use."""
    own = S.REQUESTED[asset]
    rivals = [words for words in S.REQUESTED.values() if words[0] != own[0]]
    barred = line.rlike("right.of.use|total") | reduce(lambda a, b: a | b, [_all_words(line, r[0]) for r in rivals if r[0] not in own])
    foreign = reduce(lambda a, b: a | b, [line.contains(w) for r in rivals for w in r if w not in own])
    lesser = reduce(lambda a, b: a | b, [line.contains(w) for w in own[1:]], F.lit(False)) & ~foreign
    return F.when(~barred, F.when(_all_words(line, own[0]), 2.0).when(_all_words(around, own[0]), 1.0).when(lesser, 0.5))


def year_runs(line: Column, words: Column) -> Column:
    """The line's numbers, in one run for each printing of the asset's label (one of its words): a label within 40 characters of the one kept last is the
    same one, and numbers before the first are left out. Of several runs those of six numbers count. No label: one run of all."""
    low = F.lower(line)
    found = F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.exists(words, lambda w: F.substring(low, i, F.length(w)) == w))
    none = F.array().cast("array<int>")
    kept = F.aggregate(found, none, lambda at, p: F.when((F.size(at) == 0) | (p - F.element_at(at, -1) > 40), F.concat(at, F.array(p))).otherwise(at))

    def runs(cuts: Column) -> Column:
        starts = F.when(F.size(cuts) == 0, F.array(F.lit(1))).otherwise(cuts)
        found = F.transform(starts, lambda a, i: N.row_numbers(F.substring(line, a, F.coalesce(F.get(cuts, i + 1), F.length(low) + 1) - a)))
        return F.filter(found, lambda r: (F.size(cuts) < 2) | (F.size(r) >= 6))

    return F.get(F.transform(F.array(kept), runs), F.lit(0))  # the cuts are bound once


def _pieces(runs: Column) -> Column:
    """What may be a row by itself: each run; of a sole run also both halves of each parting into at least six and six numbers."""
    piece = lambda kind, k, v: F.struct(F.lit(kind).alias("kind"), k.cast("int").alias("k"), v.alias("nums"))
    only = F.get(runs, F.lit(0))
    at = F.when((F.size(runs) == 1) & (F.size(only) >= 12), F.sequence(F.lit(6), F.size(only) - 6)).otherwise(F.array().cast("array<int>"))
    heads = F.transform(at, lambda k: piece("head", k, F.slice(only, F.lit(1), k)))
    tails = F.transform(at, lambda k: piece("tail", k, F.slice(only, k + 1, F.size(only))))
    return F.concat(F.transform(runs, lambda r, i: piece("run", i, r)), heads, tails)


def _opens(later: Column, earlier: Column) -> Column:
    """One piece's opening is what the other's gross block closes with."""
    return F.exists(earlier.splits, lambda s: F.abs(later.opening - s.gross) < TOLERANCE)


def current_splits(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, splits): the splits of the run of the present year, for each of the rows (by, runs) that has any.

    Of several runs the first that opens where another closes counts, else the last one. A sole run is parted where both halves are rows
    and one follows the other, else it is taken whole. Pieces are solved one a row, and come together by row.
    """
    solved = rows.select(*by, F.explode(_pieces(F.col("runs"))).alias("__p")).select(*by, "__p.*").withColumn("splits", R.splits(F.col("nums"), lambda v: V.block_closes(v, TOLERANCE), TOLERANCE))
    piece = F.struct("kind", "k", F.get("nums", F.lit(0)).alias("opening"), "splits")
    whole = solved.where("kind = 'run' or size(splits) > 0").groupBy(*by).agg(F.array_sort(F.collect_list(piece)).alias("__p"))
    of = lambda kind: F.filter("__p", lambda p: p.kind == kind)
    whole = whole.select(*by, of("run").alias("__r"), of("head").alias("__h"), of("tail").alias("__t"))
    later = F.filter("__r", lambda a: F.exists("__r", lambda b: (a.k != b.k) & _opens(a, b)))
    paired = F.flatten(F.transform("__h", lambda h: F.transform(F.filter("__t", lambda t: t.k == h.k), lambda t: F.when(_opens(t, h), t).when(_opens(h, t), h))))
    parted = F.get(F.filter(paired, lambda p: p.isNotNull()), F.lit(0))
    return whole.select(*by, F.coalesce(parted, F.get(later, F.lit(0)), F.try_element_at("__r", F.lit(-1))).splits.alias("splits")).where("size(splits) > 0")


def _agreed(values: Column) -> Column:
    """The first value if all are one to two decimals."""
    return F.when(F.size(F.array_distinct(F.transform(values, lambda v: F.bround(v, 2)))) == 1, F.get(values, F.lit(0)))


def row_schedules(pages: DataFrame, lines: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """(doc, key, value, page, evidence) of the items that a row with an asset's name proves: opening and movements give the closing in the
    gross and in the depreciation block, and their difference the net. What does not close, or closes in two ways, gives no row.

    pages: doc, page, rank, text, the first k ranks are read. lines: doc, page, source (0 printed, 1 rebuilt from coordinates), line_no,
    line; of pages whose printed lines are shredded only rebuilt ones count. On a page the surest row wins, the first of equals; among
    pages the latest year, then the better rank, then printed lines. Items of years before the document's latest are left out. Null
    texts and lines are empty; of equal pages or lines one counts.
    """
    known = pages.where(F.col("rank") <= k).groupBy("doc", "page").agg(F.min(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))).alias("__p"))
    known = known.select("doc", "page", "__p.rank", T.repeated_max_year(F.col("__p.text")).alias("year"), S.layout(F.col("__p.text"))["layout"].alias("layout"))
    clean = lines.select("doc", "page", "source", "line_no", F.coalesce("line", F.lit("")).alias("line")).groupBy("doc", "page", "source", "line_no").agg(F.min("line").alias("line"))
    order = Window.partitionBy("doc", "page", "source").orderBy("line_no")
    seen = clean.join(known, ["doc", "page"]).where("source = 1 or layout <> 'shredded'").withColumn("low", F.lower("line"))
    seen = seen.withColumn("around", F.concat_ws(" ", F.collect_list("low").over(order.rowsBetween(-2, 2))))
    asked = {(a, b): [q for q in keys if _asks(q) == (a, b)] for a in S.REQUESTED for b in ("gross", "dep")}
    assets = sorted({a for (a, _), qs in asked.items() if qs})
    if not assets:
        return lines.sparkSession.createDataFrame([], f"doc {lines.schema['doc'].dataType.simpleString()}, key string, value string, page {lines.schema['page'].dataType.simpleString()}, evidence string")
    scores = F.filter(F.array(*[F.struct(F.lit(a).alias("asset"), F.array(*map(F.lit, S.REQUESTED[a])).alias("words"), row_score(F.col("low"), F.col("around"), a).alias("score")) for a in assets]), lambda s: s.score.isNotNull())
    rows = seen.where(F.size(N.row_numbers(F.col("line"))) >= 6).select("doc", "page", "source", "line_no", "line", "rank", "year", F.explode(scores).alias("__s")).select("*", "__s.*").drop("__s")
    one = ["doc", "page", "source", "line_no", "line", "rank", "year", "asset", "score"]
    solved = current_splits(rows.select(*one, year_runs(F.col("line"), F.col("words")).alias("runs")), one)
    blocks = F.array(F.struct(F.lit("gross").alias("block"), _agreed(F.transform("splits", lambda s: s.gross)).alias("v")), F.struct(F.lit("dep").alias("block"), _agreed(F.transform("splits", lambda s: F.abs(s.depreciation))).alias("v")))
    proven = solved.withColumn("__b", F.explode(blocks)).select("*", "__b.*").where("v is not null")
    surest = proven.groupBy("doc", "page", "source", "asset", "block").agg(F.min_by(F.struct("v", "line", "rank", "year"), F.struct(-F.col("score"), "line_no")).alias("__w")).select("doc", "page", "source", "asset", "block", "__w.*")
    best = surest.groupBy("doc", "asset", "block").agg(F.min_by(F.struct("v", "line", "page", "year"), F.struct(-F.col("year"), "rank", "source", "page")).alias("__w")).select("doc", "asset", "block", "__w.*")
    names = F.coalesce(*[F.when((F.col("asset") == a) & (F.col("block") == b), F.array(*map(F.lit, qs))) for (a, b), qs in asked.items() if qs])
    items = best.withColumn("key", F.explode(names)).withColumn("__latest", F.max("year").over(Window.partitionBy("doc"))).where("year = __latest")
    return items.select("doc", "key", N.format_number(F.col("v")).alias("value"), "page", F.substring(F.trim("line"), 1, 140).alias("evidence"))


def _asks(key: str) -> tuple[str, str] | None:
    """(asset, block) of an item: as requested_block and requested_words, of a plain string."""
    low = key.lower()
    block = "gross" if low.startswith("gross") else "dep" if low.startswith("accumulated") else None
    asset = next((a for a in S.REQUESTED if a in low.split("_")[-1]), None)
    return (asset, block) if asset and block else None


def tax_rows(lines: DataFrame) -> DataFrame:
    """(doc, page, rank, kind, line_no, label, opening, closing, block) of rows proven to be of deferred tax: those whose signed numbers sum
    to the last one (kind 0), and components of a total in both of its columns (kind 1: the present year's stands for both).

    A row's label takes up to two lines above it that have no digit. Its block is that of the next total below it, "" if none. lines:
    doc, page, rank, line_no, line; pages that tell nothing of deferred tax are left out.
    """
    page = ["doc", "page", "rank"]
    low = F.lower(F.coalesce("line", F.lit("")))
    told = lines.withColumn("low", low).withColumn("__t", F.max(low.rlike("deferred tax|tax asset|tax liabilit")).over(Window.partitionBy(*page))).where("__t").drop("__t")
    w = Window.partitionBy(*page).orderBy("line_no")
    total = F.when(F.col("low").contains("total deferred tax liabilit"), "dtl").when(F.col("low").contains("total deferred tax asset"), "dta")
    above = [F.when(~F.lag("low", k).over(w).rlike(r"\d"), F.trim(F.lag("low", k).over(w))) for k in (1, 2)]
    held = backward_fill(told.withColumn("label", F.concat_ws(" ", F.trim("low"), *above)), page, "line_no", total, "block").withColumn("nums", N.row_numbers(F.col("line")))
    moved = held.where(V.row_identity(F.col("nums")) & ~F.col("label").contains("total") & ~F.col("label").startswith("net "))
    moved = moved.select(*page, F.lit(0).alias("kind"), "line_no", "label", F.get("nums", F.lit(0)).alias("opening"), F.element_at("nums", -1).alias("closing"), F.coalesce("block", F.lit("")).alias("block"))
    parts = R.deferred_tax_tables(told.select(*page, "line_no", F.coalesce("line", F.lit("")).alias("line")), page)
    return moved.union(parts.select(*page, F.lit(1), "line_no", "label", F.col("value"), F.col("value"), "block"))


def deferred_tax_values(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(doc, key, value, page, label) of the items that proven rows answer with one closing value only; others give no row.

    A row answers if its label's stems hold one of the item's sets of words. A row that closes where another of the item's rows opens is
    of an earlier year and goes; of the rest, those of the block that the key names stay, or without a block, if there are any.
    """
    stems = F.transform(F.regexp_extract_all("label", F.lit(r"[a-z][a-z&/\-]+"), F.lit(0)), T.stem)
    rows = tax_rows(lines).withColumn("__stems", stems).withColumn("__id", F.struct("rank", "page", "kind", "line_no"))

    def answers(key: str, sets: tuple) -> Column:
        low = key.lower()
        block = "dtl" if "_deferred tax liabilities_" in low else "dta" if "_deferred tax assets_" in low else None
        holds = reduce(lambda a, b: a | b, [F.size(F.array_except(F.array(*map(F.lit, s)), "__stems")) == 0 for s in sets])
        return F.when(holds, F.struct(F.lit(key).alias("key"), F.lit(block).cast("string").alias("__block")))

    asked = [answers(key, sets) for key in sorted(set(keys)) for name, sets in TAX_ITEMS.items() if name in key]
    none = F.array().cast("array<struct<key: string, __block: string>>")
    met = rows.withColumn("__i", F.explode(F.array_compact(F.array(*asked)) if asked else none)).select(*rows.columns, "__i.*")
    one = F.struct("__id", "opening", "closing", "block", "page", "label")
    held = met.groupBy("doc", "key", "__block").agg(F.array_sort(F.collect_list(one)).alias("__all"))
    earlier = lambda m: F.exists("__all", lambda o: (o["__id"] != m["__id"]) & (F.abs(m.closing - o.opening) < F.greatest(F.abs(m.closing) * 0.005, F.lit(0.02))))
    held = held.withColumn("__now", F.filter("__all", lambda m: ~earlier(m)))
    fits = F.filter("__now", lambda m: m.block.isin("") | (m.block == F.col("__block")))
    held = held.withColumn("__now", F.when(F.col("__block").isNotNull() & (F.size(fits) > 0), fits).otherwise(F.col("__now")))
    return held.withColumn("v", _agreed(F.transform("__now", lambda m: m.closing))).where("v is not null").select("doc", "key", N.format_number(F.col("v")).alias("value"), F.get("__now", F.lit(0)).page.alias("page"), F.get("__now", F.lit(0)).label.alias("label"))
