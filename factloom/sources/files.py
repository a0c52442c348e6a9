"""Sources and sinks: text columns stay text until they are parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]), multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_rows(lines: DataFrame, by: list[str], order: str = "line_no", text: str = "line") -> DataFrame:
    """(by, order, heading, table_no, cells): rows of pipe tables of at least two rows and two columns, rules of dashes left out.

    A line that begins and ends with a pipe is a row. The heading is the last line before the table that is neither empty nor begins
    with a pipe, without #, * and colons around it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    is_row = t.startswith("|") & t.endswith("|")
    said = F.regexp_replace(F.regexp_replace(t, r"^[#* ]+", ""), r"[*: ]+$", "")
    out = lines.withColumn("__row", is_row).withColumn("heading", F.coalesce(F.last(F.when((t != "") & ~t.startswith("|"), said), ignorenulls=True).over(w), F.lit("")))
    starts = (F.col("__row") & ~F.coalesce(F.lag("__row").over(w), F.lit(False))).cast("int")
    out = out.withColumn("__s", starts).withColumn("table_no", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.transform(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(F.regexp_replace(F.trim(c), r"^\*+|\*+$", "")))
    out = out.where("__row").select(*by, order, "heading", "table_no", cells.alias("cells")).where(F.exists("cells", lambda c: ~c.rlike("^[-: ]*$")))
    # a page's rows are still in order, and a table's follow one another: its first row and whether it has another are told by their neighbours, without a second sort
    before, after = F.lag("table_no").over(w), F.lead("table_no").over(w)
    out = out.withColumn("__before", before).withColumn("__after", after)
    first = F.last(F.when(~F.col("__before").eqNullSafe(F.col("table_no")), F.size("cells")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__w", first)
    return out.where("(__before = table_no or __after = table_no) and __w >= 2").select(*by, order, "heading", "table_no", "cells")


def write_wide(facts: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A wide table as CSV; its files follow one another in the order of its reports."""
    write_csv(facts.orderBy(*order).select(*columns), path)


def write_workbook(tables: DataFrame, path: str) -> None:
    """Tables with their sheets (doc, sheet, page, n, scope, section, grid) as two folders.

    `index`: a sheet's pages, scope, section, tables, rows and columns. `cells`: doc, sheet, page, n, row, col, text from 1, in
    ranges of documents, so that reading one of them skips most files.
    """
    rows, columns = F.size("grid"), F.coalesce(F.array_max(F.transform("grid", F.size)), F.lit(0))
    index = tables.groupBy("doc", "sheet").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("scope").alias("scope"), F.min("section").alias("section"), F.count("*").alias("tables"), F.sum(rows).alias("rows"), F.max(columns).alias("cols"))
    write_csv(index, f"{path}/index")
    lines = tables.select("doc", "sheet", "page", "n", F.posexplode("grid").alias("row", "__cells"))
    cells = lines.select("doc", "sheet", "page", "n", (F.col("row") + 1).alias("row"), F.posexplode("__cells").alias("col", "text")).withColumn("col", F.col("col") + 1)
    cells.repartitionByRange("doc", "sheet", "row").sortWithinPartitions("doc", "sheet", "n", "row", "col").write.mode("overwrite").parquet(f"{path}/cells")


def write_error_report(rows: DataFrame, calls: DataFrame, path: str) -> None:
    """Compared rows (company, verdict, …) as JSON lines in `rows`, the call log in `calls`, counts by company and verdict in `summary`."""
    write_json(rows, f"{path}/rows")
    write_json(calls, f"{path}/calls")
    write_json(rows.groupBy("company", "verdict").agg(F.count("*").alias("n")), f"{path}/summary")
