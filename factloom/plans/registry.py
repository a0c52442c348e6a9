"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import FOLDER, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, *tables: str, recursive: bool = False):
    """Register a query; its SQL may go on from the WITH clause of the small tables, then it starts with a comma."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            before = FOLDER.set(sf_dir)
            try:
                return f(spark, sf_dir)
            finally:
                FOLDER.reset(before)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = (values(*tables, recursive=recursive) + " " if tables else "") + sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of reports: the source is the report, the id the page."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
