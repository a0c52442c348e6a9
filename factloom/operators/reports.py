"""Report tables: wide pivots, rollups, fiscal years, sheet names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def wide(facts: DataFrame, rows: list[str], key: str, value: str, keys: list[str], order: str, found: Column | None = None, status: Column | None = None, verified: DataFrame | None = None, missing: str = "Not disclosed") -> DataFrame:
    """One row for each of `rows`, one column for each key, in the given order (a fixed list: one pass).

    A cell is the verified value if there is one, "" if the key has no record, "N/A" if its last record (by `order`) has a status,
    its value ("" if null) if it is found, else `missing`. verified: rows, key, value, order; of several the last.
    """
    there = F.col(value).isNotNull() if found is None else F.coalesce(found, F.lit(False))
    cell = F.when(there, F.coalesce(F.col(value), F.lit(""))).otherwise(F.lit(missing))
    if status is not None:
        cell = F.when(F.coalesce(status, F.lit("")) != "", F.lit("N/A")).otherwise(cell)
    cells = facts.select(*rows, key, cell.alias("__cell"), F.lit(0).alias("__tier"), F.col(order).alias("__order"))
    if verified is not None:
        kept = verified.where(F.col(value).isNotNull()).join(facts.select(*rows).distinct(), rows, "left_semi")
        cells = cells.unionByName(kept.select(*rows, key, F.col(value).alias("__cell"), F.lit(1).alias("__tier"), F.col(order).alias("__order")))
    out = cells.groupBy(*rows).pivot(key, keys).agg(F.max_by("__cell", F.struct("__tier", "__order", "__cell")))
    return out.select(*rows, *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in keys])


def rollup(rows: DataFrame, by: str, total: str = "TOTAL", **sums) -> DataFrame:
    """Sums by group, and a row of totals."""
    out = rows.rollup(by).agg(F.grouping(by).alias("__g"), *[c.alias(n) for n, c in sums.items()])
    return out.withColumn(by, F.when(F.col("__g") == 1, F.lit(total)).otherwise(F.col(by))).drop("__g")


def rollup_all(rows: DataFrame, by: list[str], total: str = "TOTAL", **sums) -> DataFrame:
    """Sums by groups of several columns, and one row of totals, named in the first column."""
    whole = rows.agg(*[c.alias(n) for n, c in sums.items()]).select(F.lit(total).alias(by[0]), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in by[1:]], *sums)
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()]).unionByName(whole)


def fiscal_year(years: DataFrame, by: list[str], year: str, order: str) -> DataFrame:
    """The later of the two most frequent years (first seen of equally frequent ones)."""
    n = years.groupBy(*by, year).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).where("r <= 2")
    return top.groupBy(*by).agg(F.max(year).alias("year")).withColumn("label", F.concat(F.lit("FY"), (F.col("year") - 1).cast("string"), F.lit("-"), F.lpad((F.col("year") % 100).cast("string"), 2, "0")))


def sheet_names(tables: DataFrame, order: list[str]) -> DataFrame:
    """(…, sheet): page, number and section, at most 31 characters."""
    label = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.col("section"), F.lit("")), F.col("title")), r"[\[\]:*?/\\']", " "))
    base = F.concat(F.lit("p"), F.col("page"), F.lit("_"), F.col("n"))
    name = F.rtrim(F.substring(F.when(label != "", F.concat(base, F.lit(" "), label)).otherwise(base), 1, 31))
    k = F.row_number().over(Window.partitionBy(F.lower("__name")).orderBy(*order))
    suffix = F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))
    short = F.rtrim(F.substring(F.col("__name"), F.lit(1), F.lit(31) - F.length(suffix)))
    return tables.withColumn("__name", name).withColumn("sheet", F.when(k == 1, F.col("__name")).otherwise(F.concat(short, suffix))).drop("__name")


def section_groups(tables: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Number the runs of tables of one scope and section on adjoining pages; a table without a section stands alone."""
    w = Window.partitionBy(*by).orderBy(*order)
    section = F.lower(F.trim("section"))
    same = (section != "") & F.col("scope").eqNullSafe(F.lag("scope").over(w)) & (section == F.lag(section).over(w)) & (F.col("page") - F.lag("page").over(w) <= 1)
    return tables.withColumn("__new", 1 - F.coalesce(same.cast("int"), F.lit(0))).withColumn("group_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def error_sections(rows: DataFrame, good: tuple[str, ...] = ("ok",)) -> DataFrame:
    """(section, errors, place): sections with errors, those of most first and equal ones by name. rows: section, status."""
    counts = rows.where(~F.col("status").isin(*good)).groupBy("section").agg(F.count("*").alias("errors"))
    # One row a section is left, so that ranking all of them in one place is bounded.
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("errors"), "section")))


def company_summary(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """Each company's rows, outcomes and share of correct ones beside its calls, and a TOTAL row. rows: company, status; costs: company,
    calls, tokens_in, tokens_out, usd, with a TOTAL row of its own; a company without calls has none."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = rollup(rows, "company", n=F.count("*"), ok=is_("ok"), mismatch=is_("mismatch"), miss=is_("miss"), false_positive=is_("false_positive"))
    out = out.withColumn("errors", F.col("n") - F.col("ok")).withColumn("accuracy_pct", F.round(F.col("ok") * 100 / F.col("n"), 1))
    return out.join(costs, "company", "left").na.fill(0, ["calls", "tokens_in", "tokens_out", "usd"])
