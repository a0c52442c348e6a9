"""Registries of what is asked for: items, indicators by format, profiles of companies. Files are JSON; each becomes a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from .files import read_json

ITEMS = "key string, scope string, value_type string, concept string, column_hint string, location_hint string, aliases array<string>"
INDICATORS = "format string, label string, kpis array<struct<key: string, q: string, also: array<string>>>"
PROFILES = "company string, name string, sector string, na_items array<string>"


def items(records: DataFrame) -> DataFrame:
    """(key, scope, meaning, selector, value_type, section, examples): texts trimmed, null ones empty, a missing type monetary, blank
    aliases left out, and the section by the route of key and location."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    examples = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), text), lambda a: a != "")
    section = T.route(F.col("key"), F.coalesce("location_hint", F.lit("")))
    return records.select("key", "scope", text("concept").alias("meaning"), text("column_hint").alias("selector"), F.coalesce("value_type", F.lit("monetary")).alias("value_type"), section.alias("section"), examples.alias("examples"))


def indicators(records: DataFrame) -> DataFrame:
    """(format, label, key, question, terms): an indicator a row; the label is the format's name if it has none, the terms are the question's
    and its synonyms."""
    one = records.select("format", F.coalesce("label", "format").alias("label"), F.inline("kpis"))
    return one.select("format", "label", "key", F.col("q").alias("question"), F.concat_ws(" ", "q", "also").alias("terms"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return items(read_json(spark, path, ITEMS))


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    return indicators(read_json(spark, path, INDICATORS))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Without a list of items that do not apply, every item does."""
    return read_json(spark, path, PROFILES).withColumn("na_items", F.coalesce("na_items", F.array().cast("array<string>")))
