"""Queries of values proven by arithmetic, of the choice among readers, of registries and sections, and of summaries of errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sections import SECTIONS
from ..operators import proven as Q, readers as D, reconcile as R, reports as P, retrieval as L
from ..sources import registries as S
from .fixtures import table
from .queries import _ROUTE, _TERMS
from .registry import query

ASSET_ITEMS = ["gross_block_land", "accumulated_depreciation_land", "gross_office equipment", "gross_vehicles", "gross_building", "accumulated_plant", "gross_computer", "gross_furniture", "net_land"]
TAX_ITEMS = ["x_Deferred tax liabilities_Accumulated Depreciation", "y_Deferred tax assets_Leave Encashment", "Leave Encashment", "z"]


@query("")
def r8_row_schedules(spark, sf_dir):
    return Q.row_schedules(table(spark, "schedule_pages"), table(spark, "schedule_lines"), ASSET_ITEMS)


@query("")
def r13_deferred_tax(spark, sf_dir):
    return Q.deferred_tax_values(table(spark, "tax_notes"), TAX_ITEMS)


@query(""", i AS (SELECT DISTINCT * FROM asked_items), r AS (SELECT s.*, section FROM section_readings s JOIN i USING (doc, key)),
  c AS (SELECT doc, key, arg_min(value, (value, confidence)) AS v, arg_min(confidence, (value, confidence)) AS trust FROM r WHERE value IS NOT NULL AND priority = (SELECT min(priority) FROM r o WHERE o.doc = r.doc AND o.section = r.section) GROUP BY doc, key),
  s AS (SELECT doc, key, min(value) AS s FROM second_readings WHERE grounded AND value IS NOT NULL GROUP BY doc, key),
  f AS (SELECT doc, arg_min(value, line_no) AS value FROM face_lines WHERE contains(lower(label), 'changes in inventor') AND value <> '' GROUP BY doc),
  p AS (SELECT doc, key, min(value) AS p FROM (SELECT * FROM proven_values WHERE value IS NOT NULL UNION ALL SELECT doc, key, value FROM i JOIN f USING (doc) WHERE section = 'pl_changes_inventory') GROUP BY doc, key),
  o AS (SELECT *, CASE WHEN p IS NOT NULL THEN 'proven' WHEN v IS NOT NULL THEN 'read' WHEN s IS NOT NULL AND coalesce(section, '') NOT IN ('investments', 'ppe', 'borrowings') THEN 'rescued' ELSE 'absent' END AS origin FROM i LEFT JOIN c USING (doc, key) LEFT JOIN s USING (doc, key) LEFT JOIN p USING (doc, key))
  SELECT doc, key, section, CASE origin WHEN 'proven' THEN p WHEN 'read' THEN v WHEN 'rescued' THEN s END AS value, origin,
  CASE WHEN section = 'investments' AND (origin = 'proven' OR trust IN ('reconciled', 'grounded')) THEN 'unverified' WHEN origin = 'read' THEN trust WHEN origin = 'absent' THEN 'absent' ELSE 'grounded' END AS confidence FROM o""",
       "asked_items", "section_readings", "second_readings", "proven_values", "face_lines")
def r15_datapoints(spark, sf_dir):
    items = table(spark, "asked_items")
    proven = table(spark, "proven_values").unionByName(R.face_answers(items, table(spark, "face_lines")))
    return R.datapoints(items, table(spark, "section_readings"), table(spark, "second_readings"), proven)


@query(f""" SELECT key, scope, trim(coalesce(concept, '')) AS meaning, trim(coalesce(column_hint, '')) AS selector, coalesce(value_type, 'monetary') AS value_type, {_ROUTE} AS section,
  list_filter(list_transform(coalesce(aliases, []), lambda a: trim(a)), lambda a: a <> '') AS examples FROM (SELECT *, lower(key || ' ' || coalesce(location_hint, '')) AS t FROM registry_items)""", "registry_items")
def s7_items(spark, sf_dir):
    return S.items(table(spark, "registry_items"))


@query(" SELECT format, coalesce(label, format) AS label, key, q AS question, array_to_string([q] || also, ' ') AS terms FROM registry_kpis", "registry_kpis")
def s7_indicators(spark, sf_dir):
    one = table(spark, "registry_kpis").groupBy("format", "label").agg(F.collect_list(F.struct("key", "q", "also")).alias("kpis"))
    return S.indicators(one)


_WORDS = ", ".join(f"('{s}', '{w} standalone')" for s, (_, w) in SECTIONS.items())


@query(f""", q AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({_TERMS}) AS term FROM (VALUES {_WORDS}) v(query, text)) GROUP BY ALL), g AS (SELECT doc, page, {_TERMS} AS terms FROM report_pages),
  d AS (SELECT doc, count(*) AS n, avg(coalesce(len(terms), 0)) AS mean FROM g GROUP BY doc), t AS (SELECT doc, page, len, term, count(*) AS tf FROM (SELECT doc, page, len(terms) AS len, unnest(terms) AS term FROM g) GROUP BY ALL),
  u AS (SELECT *, count(*) OVER (PARTITION BY doc, term) AS df FROM t)
  SELECT query, doc, page, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM u JOIN d USING (doc) JOIN q USING (term) GROUP BY query, doc, page""", "report_pages")
def t12_section_pages(spark, sf_dir):
    pages = table(spark, "report_pages").withColumn("text", F.coalesce("text", F.lit("")))  # a page without text is one of no terms
    found = L.bm25(pages, L.section_terms(spark, "standalone"), k=None)
    return found.select("query", "doc", "page", F.round("score", 6).alias("score"))


@query(" SELECT section, count(*) AS errors, row_number() OVER (ORDER BY count(*) DESC, section NULLS FIRST)::INTEGER AS place FROM checked_rows WHERE status <> 'ok' GROUP BY section", "checked_rows")
def a11_sections(spark, sf_dir):
    return P.error_sections(table(spark, "checked_rows"))


@query(""", k AS (SELECT coalesce(company, 'TOTAL') AS company, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(tokens_in * 0.75::DOUBLE / 1000000 + tokens_out * 4.5::DOUBLE / 1000000) AS usd FROM calls GROUP BY ROLLUP (company)),
  s AS (SELECT coalesce(company, 'TOTAL') AS company, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'miss') AS miss, count(*) FILTER (status = 'false_positive') AS false_positive FROM checked_rows GROUP BY ROLLUP (company))
  SELECT s.*, n - ok AS errors, round(ok * 100.0::DOUBLE / n, 1) AS accuracy_pct, coalesce(calls, 0) AS calls, coalesce(tokens_in, 0) AS tokens_in, coalesce(tokens_out, 0) AS tokens_out, coalesce(usd, 0) AS usd FROM s LEFT JOIN k USING (company)""", "checked_rows", "calls")
def a11_companies(spark, sf_dir):
    return P.company_summary(table(spark, "checked_rows"), D.call_costs(table(spark, "calls"), 0.75, 4.5))
