"""Page retrieval: lines, term statistics, BM25, alias scores, ranked cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.sections import SECTIONS


def lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line), counted from 0. Lines end with \\n or \\r\\n; an empty text is one empty line, a null text has none."""
    return pages.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """The first k rows of each group, all if k is None; the order has to be total for the result to be one."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def postings(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, page, term, tf)."""
    return pages.select(doc, page, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(doc, page, "term").agg(F.count("*").alias("tf"))


def bm25(pages: DataFrame, terms: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", k: int | None = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, page, score, rank): pages with a positive score, best first, equal ones by page. terms: query, term; repeats add up.

    Only postings of query terms are shuffled: lengths come from the pages themselves, document frequencies from the
    postings left after a semi-join with the (small) table of terms.
    """
    sized = pages.select(doc, page, T.tokens(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))
    corpus = sized.groupBy(doc).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    weights = terms.groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = weights.select("term").distinct()
    tf = sized.select(doc, page, "length", F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy(doc, page, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(doc, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = tf.join(df, [doc, "term"]).join(corpus, doc).join(weights, "term").groupBy("query", doc, page).agg(F.sum(F.col("times") * one).alias("score")).where("score > 0")
    return top_k(scored, ["query", doc], [F.desc("score"), F.col(page)], k)


def numeric_density(s: Column) -> Column:
    return F.least(F.regexp_count(s, F.lit(r"\d[\d,]*\.?\d+")) / 25.0, F.lit(3.0))


def alias_score(text: Column, aliases: Column, hint: Column, column_hint: Column) -> Column:
    """Aliases found, 0.6 for each hint word, number density, 0.5 for each column word, -3 on a cash-flow page for income items; null if no candidate."""
    t = T.normal(text)
    found = F.size(F.filter(aliases, lambda a: (T.normal(a) != "") & t.contains(T.normal(a))))
    hints = F.size(F.filter(T.hint_terms(hint), lambda w: t.contains(w)))
    words = F.regexp_extract_all(T.normal(F.coalesce(column_hint, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    columns = F.size(F.filter(words, lambda w: (F.length(w) > 3) & t.contains(w)))
    h = F.lower(F.coalesce(hint, F.lit("")))
    income = ~h.contains("cash flow") & (h.contains("p&l") | h.contains("profit and loss") | h.contains("expense") | h.contains("finance cost"))
    score = found + 0.6 * hints + numeric_density(text) + 0.5 * columns - F.when(income & t.contains("cash flow from operating activities"), 3.0).otherwise(0.0)
    return F.when((found > 0) | (hints >= 2), score)


def scope_fallback(pages: DataFrame, doc: str, region: str, wanted: list[str]) -> DataFrame:
    """Pages in the wanted regions; in a document without any, those that are not front matter; else all."""
    w = Window.partitionBy(doc)
    level = F.when(F.col(region).isin(*wanted), 0).when(F.col(region) != "FRONT", 1).otherwise(2)
    return pages.withColumn("__level", level).withColumn("__best", F.min("__level").over(w)).where("__level <= __best").drop("__level", "__best")


def section_terms(spark: SparkSession, scope: str = "") -> DataFrame:
    """(query, term): the words that find each section's pages, with those of a scope."""
    known = spark.createDataFrame([(s, f"{words} {scope}") for s, (_, words) in SECTIONS.items()], "query string, words string")
    return known.select("query", F.explode(T.tokens(F.col("words"))).alias("term"))
