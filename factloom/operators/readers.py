"""Readers put together from the other operators: what a model returned (JSON text) is input; code checks, sums and chooses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as T, values as X
from . import reconcile as R, verify as V
from .matching import contained_aliases, table_row
from .pages import any_of, filled_lines
from .retrieval import top_k

PAYLOAD = "array<struct<key string, present boolean, value string, evidence string, addends array<string>>>"
BIG = r"\d[\d,]*\.\d+|\d{1,3}(?:,\d{2,3})+|\d{4,}"


def signature_run(pages: DataFrame, terms: tuple[str, ...], least: int = 2, after: int = 2) -> DataFrame:
    """(doc, page): the first page with at least two of the terms and the two pages after it."""
    t = F.lower("text")
    hits = sum((t.contains(w).cast("int") for w in terms), F.lit(0))
    first = pages.groupBy("doc").agg(F.min(F.when(hits >= least, F.col("page"))).alias("p"), F.max("page").alias("__n")).where("p is not null")
    return first.select("doc", F.explode(F.sequence(F.col("p"), F.least(F.col("p") + after, F.col("__n")))).alias("page"))


def number_tables(pages: DataFrame, signatures: tuple[str, ...], words: tuple[str, ...], k: int = 2) -> DataFrame:
    """(doc, page, hits, n_rows, rank): pages with a signature, one of the words and three lines of two numbers; most signatures, then rows, first."""
    t = F.lower("text")
    hits = sum((t.contains(w).cast("int") for w in signatures), F.lit(0))
    rows = F.size(F.filter(filled_lines(F.col("text")), lambda x: F.size(N.row_numbers(x)) >= 2))
    found = pages.where(any_of(t, words)).select("doc", "page", hits.alias("hits"), rows.alias("n_rows")).where("hits >= 1 and n_rows >= 3")
    return top_k(found, ["doc"], [F.desc("hits"), F.desc("n_rows"), F.col("page")], k)


def scanned(text: Column, has_image: Column, image_share: Column) -> Column:
    """A page of under 40 characters with an image, or one that an image covers by over 80 %."""
    return ((F.length(F.trim(F.coalesce(text, F.lit("")))) < 40) & has_image) | (F.coalesce(image_share, F.lit(0.0)) > 0.8)


def snippets(lines: DataFrame, by: list[str], order: str = "line_no", text: str = "line", reach: int = 12, size: int = 700) -> DataFrame:
    """lines with a snippet: the line alone if it has a figure, else on to where a figure and a total have been seen, at most
    12 lines, or 700 characters."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1, reach)
    start = X.strip(F.col(text))
    first = F.struct(F.array(start).alias("l"), F.lit(False).alias("v"), F.lit(False).alias("t"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        kept = F.concat(s.l, F.array(x))
        v, t = s.v | x.rlike(BIG), s.t | F.lower(x).contains("total")
        long = F.length(F.array_join(kept, "")) > size
        return F.when(s.done | (x == ""), s).otherwise(F.struct(kept.alias("l"), v.alias("v"), t.alias("t"), ((v & t) | long).alias("done")))

    ahead = F.transform(F.collect_list(text).over(w), X.strip)
    out = lines.withColumn("__a", ahead)
    return out.withColumn("snippet", F.when(start.rlike(BIG), start).otherwise(F.array_join(F.aggregate("__a", first, step).l, "\n"))).drop("__a")


def rescue_candidates(aliases: DataFrame, lines: DataFrame, read: DataFrame, k: int = 3) -> DataFrame:
    """(key, doc, page, line_no, rank): printed rows (a digit, 9 to 219 characters, at most ten words before it) that hold
    all words of an alias; longer aliases first, then pages that were read, then short labels. aliases: key, alias; read: doc, page."""
    words = F.size(F.filter(F.split(F.regexp_extract(F.trim("line"), r"^[^\d]*", 0), r"\s+"), lambda x: x != ""))
    rows = lines.where(table_row(F.col("line"))).withColumn("__w", words).dropDuplicates(["doc", "page", "line_no", "line"])
    hit = contained_aliases(aliases.select("alias").distinct(), rows, ["doc", "page", "line_no"])
    sized = hit.join(aliases.distinct().withColumn("__n", F.size(T.alias_tokens(F.col("alias")))), "alias").groupBy("key", "doc", "page", "line_no").agg(F.max("__n").alias("__n"))
    seen = read.select("doc", "page").distinct().withColumn("__r", F.lit(0))
    ranked = sized.join(rows.select("doc", "page", "line_no", "__w"), ["doc", "page", "line_no"]).join(seen, ["doc", "page"], "left")
    return top_k(ranked, ["key", "doc"], [F.desc("__n"), F.coalesce("__r", F.lit(1)), F.col("__w"), F.col("page"), F.col("line_no")], k).select("key", "doc", "page", "line_no", "rank")


def read_payloads(payloads: DataFrame) -> DataFrame:
    """(id, key, value, evidence, grounded, confidence): values from a model's JSON, cleaned, signed and held against the text read.

    payloads: id, payload, text. Two addends or more are summed by code, which wins over the model's own value. What is not
    JSON gives no rows; absent ones and nil values stay absent.
    """
    rows = payloads.select("id", "text", F.inline(F.from_json("payload", PAYLOAD)))
    summed = X.composite(F.coalesce("addends", F.array().cast("array<string>")), F.col("text"))
    rows = rows.withColumn("__c", F.when(F.col("present"), summed))
    clean = X.hygiene(F.col("value"), F.col("evidence"), F.lit(False))
    there = F.col("__c").isNotNull() | (F.coalesce("present", F.lit(False)) & ~F.coalesce("value", F.lit("")).isin("", "-"))
    value = F.when(there, F.coalesce(F.col("__c.value"), clean))
    grounded = F.when(there, F.coalesce(F.col("__c.grounded"), V.grounded(value, F.col("text")))).otherwise(False)
    return rows.select("id", "key", value.alias("value"), "evidence", grounded.alias("grounded")).withColumn("confidence", F.when(F.col("value").isNull(), "absent").when(F.col("grounded"), "grounded").otherwise("unverified"))


def best_window(targets: DataFrame, by: list[str], window: str = "window") -> DataFrame:
    """(…): the targets of the reconciled window that gives most of them, the earliest of equally good ones.

    targets: by, window, key, value, total, comps array, evidence, doc_year, wanted (the total is asked for), reconciled. A value
    whose evidence is all of earlier years, or that is its note's total by mistake, is absent.
    """
    v = N.statement_number(F.col("value"))
    old = F.coalesce(F.array_max(T.years(F.coalesce("evidence", F.lit("")))) < F.col("doc_year"), F.lit(False))
    wrong = old | R.refused(v, F.col("total"), F.col("comps"), F.col("wanted"))
    judged = targets.where("reconciled").withColumn("value", F.when(~wrong, F.col("value")))
    n = judged.groupBy(*by, window).agg(F.count("value").alias("__n"))
    best = top_k(n, by, [F.desc("__n"), F.col(window)], 1, "__r").select(*by, window)
    return judged.join(best, [*by, window], "left_semi").select(*by, window, "key", "value")


def call_costs(calls: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """(company, calls, tokens_in, tokens_out, usd) and a TOTAL row; prices are for a million tokens."""
    usd = F.sum(F.col("tokens_in") * input_price / 1e6 + F.col("tokens_out") * output_price / 1e6)
    out = calls.rollup("company").agg(F.grouping("company").alias("__g"), F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), usd.alias("usd"))
    return out.withColumn("company", F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("company"))).drop("__g")


def collapsed_scopes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups where the truth has something and nothing was found."""
    return rows.groupBy(*by).agg(F.count(F.when(F.col("expected"), 1)).alias("expected"), F.count(F.when(F.col("found"), 1)).alias("found")).where("expected > 0 and found = 0").select(*by, "expected")
