"""Queries of statements and categories that a model read, and of sections carried across pages, over small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statements as S
from .fixtures import table
from .queries import _stated
from .registry import query


def _json(field: str) -> str:
    return f"CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.{field}') END"


_ANCHOR = """CASE kind WHEN 'bs' THEN CASE WHEN grand_total_a <> 0 AND grand_total_b <> 0 AND abs(grand_total_a - grand_total_b) < greatest(abs(grand_total_a) * 0.005, 1.0) THEN grand_total_a END
  WHEN 'pl' THEN CASE WHEN abs(profit_before_tax - tax_total - profit_for_year) < greatest(abs(profit_for_year) * 0.005, 2) THEN profit_for_year WHEN abs(total_income - total_expenses - profit_before_tax) < greatest(abs(profit_before_tax) * 0.02, 5) THEN profit_before_tax END
  ELSE CASE WHEN abs(net_operating + net_investing + net_financing + coalesce(forex_effect, 0) - net_change) < greatest(abs(net_change) * 0.02, 5) THEN net_change WHEN abs(opening_cash + net_change + coalesce(forex_effect, 0) - closing_cash) < greatest(abs(closing_cash) * 0.02, 5) THEN closing_cash END END"""
_FIELDS = {to: of for fields in S.FIELDS.values() for to, of in fields.items()}
_PRINTED = ", ".join(f"{_json(to)} AS {to}" for to in _FIELDS)
_NUMBERS = ", ".join(f"{_stated(to)} AS {to}" for to in _FIELDS)


@query(f""", p AS (SELECT doc, kind, page, attempt, {_json('unit')} AS unit, {_json('scope')} AS scope, {_PRINTED} FROM statement_payloads), v AS (SELECT doc, kind, page, attempt, unit, scope, {_NUMBERS} FROM p), t AS (SELECT *, {_ANCHOR} AS anchor FROM v),
  j AS (SELECT c.doc, c.kind, c.page, c.rank, attempt, unit, scope, anchor, row_number() OVER (PARTITION BY c.doc, c.kind ORDER BY anchor IS NULL, rank, attempt) AS k FROM statement_candidates c LEFT JOIN t ON c.doc = t.doc AND c.kind = t.kind AND c.page = t.page),
  e AS (SELECT doc, unnest(['bs', 'pl', 'cf']) AS kind FROM reports)
  SELECT e.doc, e.kind, CASE WHEN j.doc IS NULL THEN 'no-candidate' WHEN anchor IS NULL THEN 'no-tie' ELSE 'tie' END AS status, page, CASE WHEN anchor IS NOT NULL THEN unit END AS unit, CASE WHEN anchor IS NOT NULL THEN scope END AS scope, anchor
  FROM e LEFT JOIN j ON e.doc = j.doc AND e.kind = j.kind AND k = 1""", "reports", "statement_candidates", "statement_payloads")
def r1_page_statements(spark, sf_dir):
    return S.page_statements(table(spark, "reports"), table(spark, "statement_candidates"), table(spark, "statement_payloads")).drop("data")


_WHOLE = ", ".join(f"{_json(of)} AS {to}" for to, of in _FIELDS.items())
_FILLED = " ".join(f"WHEN '{kind}' THEN " + " OR ".join(f"coalesce({to}, '') <> ''" for to in fields) for kind, fields in S.FIELDS.items())


@query(f""", p AS (SELECT doc, unnest(['bs', 'pl', 'cf']) AS kind, {_json('unit')} AS unit, {_json('scope')} AS scope, {_WHOLE} FROM whole_payloads), v AS (SELECT doc, kind, unit, scope, CASE kind {_FILLED} END AS filled, {_NUMBERS} FROM p), t AS (SELECT *, {_ANCHOR} AS anchor FROM v)
  SELECT doc, kind, CASE WHEN anchor IS NOT NULL THEN 'tie' WHEN filled THEN 'no-tie' ELSE 'absent' END AS status, CASE WHEN anchor IS NOT NULL THEN unit END AS unit, CASE WHEN anchor IS NOT NULL THEN scope END AS scope, anchor FROM t""", "whole_payloads")
def r3_whole_statements(spark, sf_dir):
    return S.whole_statements(table(spark, "whole_payloads")).drop("data")


@query("")
def r5_face_lines(spark, sf_dir):
    return S.face_lines(table(spark, "parsed_lines"), table(spark, "line_answers"))


@query("")
def r12_fullest_window(spark, sf_dir):
    return S.fullest_window(table(spark, "target_payloads"))


@query("")
def r12_category_values(spark, sf_dir):
    return S.category_values(table(spark, "category_payloads"))


@query(""", p AS (SELECT *, CASE WHEN scope IS NOT DISTINCT FROM lag(scope) OVER w AND lag(page) OVER w IS NOT NULL THEN 0 ELSE 1 END AS turn FROM section_pages WINDOW w AS (PARTITION BY doc ORDER BY page)),
  k AS (SELECT doc, page, scope, statement, sum(turn) OVER w AS run, last_value(units IGNORE NULLS) OVER w AS u FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)),
  e AS (SELECT doc, page, -1 AS kind, -1e9 AS y, statement AS t, NULL AS n FROM k UNION ALL SELECT doc, page, 0, y, heading, NULL FROM section_headings UNION ALL SELECT doc, page, 1, y, own, n FROM section_tables),
  h AS (SELECT e.doc, e.page, kind, n, scope, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY e.doc, run ORDER BY e.page, y, kind, n ROWS UNBOUNDED PRECEDING), '') AS section, coalesce(u, '') AS units FROM e JOIN k ON e.doc = k.doc AND e.page = k.page)
  SELECT doc, page, n, scope, section, units FROM h WHERE kind = 1""", "section_pages", "section_headings", "section_tables")
def w8_sections_in_force(spark, sf_dir):
    return S.sections_in_force(table(spark, "section_pages"), table(spark, "section_headings"), table(spark, "section_tables"))
