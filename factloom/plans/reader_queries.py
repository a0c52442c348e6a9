"""Queries of the composed readers, over small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import readers as D
from .fixtures import table
from .registry import query
from .queries import _stated

_HITS = "contains(lower(text), 'total equity')::INT + contains(lower(text), 'capital')::INT + contains(lower(text), 'deposits')::INT"


@query(f", h AS (SELECT doc, min(page) FILTER ({_HITS} >= 2) AS p, max(page) AS n FROM report_pages GROUP BY doc) SELECT doc, unnest(range(p, least(p + 2, n) + 1))::INTEGER AS page FROM h WHERE p IS NOT NULL", "report_pages")
def t9_signature_run(spark, sf_dir):
    return D.signature_run(table(spark, "report_pages"), ("total equity", "capital", "deposits"))


@query(r""", h AS (SELECT doc, page, contains(lower(text), 'trade')::INT + contains(lower(text), 'tax')::INT AS hits, len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\(?-?[\d,]*\.?\d+\)?')) >= 2))::INTEGER AS n_rows FROM face_pages WHERE contains(lower(text), 'total') OR contains(lower(text), 'associate'))
  SELECT doc, page, hits, n_rows, row_number() OVER (PARTITION BY doc ORDER BY hits DESC, n_rows DESC, page)::INTEGER AS rank FROM h WHERE hits >= 1 AND n_rows >= 3 QUALIFY rank <= 2""", "face_pages")
def t10_number_tables(spark, sf_dir):
    return D.number_tables(table(spark, "face_pages"), ("trade", "tax"), ("total", "associate"))


@query(" SELECT doc, page, length(trim(coalesce(text, ''))) < 40 AND page > 1 OR page = 9 AS scanned FROM report_pages", "report_pages")
def s14_scanned_pages(spark, sf_dir):
    return table(spark, "report_pages").select("doc", "page", D.scanned(F.col("text"), F.col("page") > 1, F.when(F.col("page") == 9, 0.9)).alias("scanned"))


@query("")
def w18_snippets(spark, sf_dir):
    return D.snippets(table(spark, "tax_lines"), ["page"]).select("page", "line_no", "snippet")


@query("")
def r14_rescue_candidates(spark, sf_dir):
    lines = table(spark, "report_lines").select(F.lit("r").alias("doc"), "page", "line_no", "line")
    return D.rescue_candidates(table(spark, "alias_keys"), lines, lines.where("page = 2").select("doc", "page"))


@query("")
def r7_read_payloads(spark, sf_dir):
    return D.read_payloads(table(spark, "payloads"))


@query(f""", j AS (SELECT *, CASE WHEN coalesce(list_max(list_transform(regexp_extract_all(coalesce(evidence, ''), '\\b(20\\d{{2}})\\b', 1), lambda y: y::INT)) < doc_year, false) OR coalesce(NOT wanted AND len(list_filter(comps, lambda x: abs(x) > greatest(abs(total) * 0.005, 0.5))) >= 2
    AND abs({_stated('value')} - total) < greatest(abs(total) * 0.005, 0.5), false) THEN NULL ELSE value END AS v FROM note_targets WHERE reconciled),
  b AS (SELECT doc, "window" FROM j GROUP BY doc, "window" QUALIFY row_number() OVER (PARTITION BY doc ORDER BY count(v) DESC, "window") = 1) SELECT doc, "window", key, v AS value FROM j JOIN b USING (doc, "window")""", "note_targets")
def r6_best_window(spark, sf_dir):
    return D.best_window(table(spark, "note_targets"), ["doc"])


@query(" SELECT coalesce(company, 'TOTAL') AS company, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(tokens_in * 0.75::DOUBLE / 1000000 + tokens_out * 4.5::DOUBLE / 1000000) AS usd FROM calls GROUP BY ROLLUP (company)", "calls")
def y20_call_costs(spark, sf_dir):
    return D.call_costs(table(spark, "calls"), 0.75, 4.5)


@query(" SELECT company, scope, count(*) AS expected FROM truth t LEFT JOIN (SELECT DISTINCT company, scope, key, true AS f FROM facts WHERE found AND ord = 1) USING (company, scope, key) GROUP BY company, scope HAVING count(f) = 0", "truth", "facts")
def a15_collapsed_scopes(spark, sf_dir):
    facts = table(spark, "facts").where("found and ord = 1").select("company", "scope", "key", F.lit(True).alias("found"))
    rows = table(spark, "truth").join(facts, ["company", "scope", "key"], "left").select("company", "scope", F.lit(True).alias("expected"), F.coalesce("found", F.lit(False)).alias("found"))
    return D.collapsed_scopes(rows, ["company", "scope"])
