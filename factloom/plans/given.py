"""Tables in the shapes that the engine reads, derived from the given tables: figures, ids, texts and dates are those of orders, lines, parts and
documents; the words of statements, which the given tables lack, are chosen by their keys. One SQL for Spark and for any other engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _whole(x: str) -> str:
    """A number as a whole one with a comma before its last three digits."""
    x = f"({x})"
    n = f"CAST(floor{x} AS BIGINT)"
    return f"(CASE WHEN {x} >= 1000 THEN concat(CAST(CAST(floor({x} / 1000) AS BIGINT) AS STRING), ',', lpad(CAST({n} % 1000 AS STRING), 3, '0')) ELSE CAST({n} AS STRING) END)"


def _cents(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18, 2)) AS STRING)"


def _pick(key: str, values: list) -> str:
    """One of the values by a whole number."""
    lit = lambda v: "NULL" if v is None else v if str(v).startswith("~") else "'" + str(v).replace("'", "''") + "'"
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v).lstrip('~')}" for i, v in enumerate(values)) + " END)"


_PRICE = "o_totalprice"
_W, _C = _whole(_PRICE), _cents(_PRICE)
_ID = "CAST(o_orderkey AS INT)"
_COMPANY = "concat('c', CAST(o_custkey AS STRING))"
_SCOPE = "(CASE WHEN o_orderstatus = 'F' THEN 'consolidated' ELSE 'standalone' END)"
_KEYS = ["Share Premium", "Hedging Reserve", "Other CWIP", "Equity Issued", "Bad Debts"]
_KEY = _pick("CAST(substr(o_orderpriority, 1, 1) AS INT)", _KEYS)
_PRINTED = _pick("o_orderkey", ["~" + _W, f"~concat('(', {_C}, ')')", f"~concat('Rs ', {_W})", f"~concat('₹ ', {_C})", f"~concat({_C}, '*')", "nil", "-", "–", "Not disclosed", f"~concat('−', {_W})", f"~concat('12 ', {_W})", "", None, "abc"])
#: A page begins with lines like these and goes on with the document's own text.
_HEADS = [
    "Contents|Overview 4|Board report 12|Balance sheet 20|Notes 31|Ratios 44|Glossary 51|Index ..... 60|Notice 66", "Standalone Balance Sheet as at 31 March 2026|Non-current assets 10|Total assets 1,000|Equity and liabilities|Total equity and liabilities 1,000",
    "Statement of Profit and Loss for the year ended|Revenue from operations 9|Tax expense 1|Profit for the year 8", "Notes to the Standalone Financial Statements|Note 12. Other expenses|Power 5|Legal 6", "Company   Consolidated Balance Sheet as at 31 March 2026|Total equity 5|Capital & Liabilities 1|deposits 4",
    "Cash flow from operating activities 7|Net cash used in investing activities (3)|Cash and cash equivalents at the end", "Notes to the Consolidated Financial Statements|segments", "",
]
_HEAD = _pick("doc_id", _HEADS)

# Ten orders are a page, lines of one order follow each other, a thousand orders are a document.
_BOOK, _SHEET = "concat('b', CAST(CAST(floor(l_orderkey / 1000) AS INT) AS STRING))", "CAST(floor(l_orderkey / 10) AS INT)"
_LINE_Y = "CAST(l_orderkey % 10 * 120 + l_linenumber * 12 AS DOUBLE)"

#: Each line number of an order once, with its largest part and price.
_LINES_OF_ORDERS = "(SELECT l_orderkey, CAST(l_linenumber AS INT) AS n, max(l_partkey) AS part, max(l_extendedprice) AS price FROM <lineitem> GROUP BY l_orderkey, l_linenumber) l JOIN <orders> ON o_orderkey = l_orderkey"
_ORDER = "concat('o', CAST(o_orderkey AS STRING))"
_WINDOW = "`window`"


def _whole_answer() -> str:
    """A model's answer for a whole report, as JSON: each identity holds in some orders only."""
    figures = {
        "bs_total_assets": _W, "bs_total_equity_and_liabilities": _whole("o_totalprice + (o_orderkey % 3) * 900"),
        "pl_profit_before_tax": _whole("o_totalprice / 10"), "pl_tax_total": _whole("o_totalprice / 40"), "pl_profit_for_period": _whole("o_totalprice / 10 - o_totalprice / 40 + (o_orderkey % 4) * 400"),
        "cf_net_operating": _whole("o_totalprice / 8"), "cf_net_investing": f"concat('(', {_whole('o_totalprice / 16')}, ')')", "cf_net_financing": f"concat('(', {_whole('o_totalprice / 32')}, ')')", "cf_net_change": _whole("o_totalprice / 32 + (o_orderkey % 5) * 500"),
    }
    return f"concat('{{\"unit\": \"crore\", \"scope\": \"', {_SCOPE}, '\"', " + ", ".join(f"', \"{k}\": \"', {v}, '\"'" for k, v in figures.items()) + ", '}')"


GIVEN: dict[str, str] = {
    "printed": f"SELECT {_ID} AS id, {_PRINTED} AS raw FROM <orders>",
    "seen_cells": f"SELECT {_ID} AS id, {_pick('o_orderkey', ['~' + _W, 'Note 5', 'abc', '', None, f"~concat('(', {_C}, ')')", 'FY24 x9y', '12b', '~o_orderpriority'])} AS cell FROM <orders>",
    "facts": f"SELECT {_COMPANY} AS company, {_SCOPE} AS scope, {_KEY} AS key, o_orderkey % 7 <> 0 AS found, CASE WHEN o_orderkey % 7 <> 0 THEN {_PRINTED} END AS value, {_W} AS value_prior, {_ID} AS ord FROM <orders>",
    "truth": f"SELECT {_COMPANY} AS company, {_SCOPE} AS scope, {_KEY} AS key, max({_pick('o_orderkey', ['~' + _W, 'Not disclosed', '~' + _C, '-'])}) AS expected, 'ok' AS status FROM <orders> WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2, 3",
    "prior": f"SELECT {_COMPANY} AS company, {_SCOPE} AS scope, {_KEY} AS key, max({_W}) AS value FROM <orders> WHERE o_orderkey % 2 = 0 GROUP BY 1, 2, 3",
    "verified": f"SELECT {_COMPANY} AS company, {_SCOPE} AS scope, {_KEY} AS key, {_pick('o_orderkey', ['~' + _W, '~' + _C, None])} AS value, {_ID} AS ord FROM <orders> WHERE o_orderkey % 5 = 0",
    "reads": f"SELECT {_COMPANY} AS item, {_ID} AS n, o_orderstatus <> 'P' AS found, {_pick('o_orderkey', ['~CAST(CAST(floor(o_totalprice / 100000) AS INT) AS STRING)', "~concat(CAST(CAST(floor(o_totalprice / 100000) AS INT) AS STRING), '.00')", 'Nil ', 'nil', 'abc'])} AS value FROM <orders>",
    "page_tags": "SELECT source AS doc, CAST(doc_id AS INT) AS page, CASE WHEN doc_id % 5 = 0 THEN 'STANDALONE' WHEN doc_id % 7 = 0 THEN 'CONSOLIDATED' WHEN lang = 'es' THEN 'FRONT' END AS signal FROM <documents>",
    "report_pages": f"SELECT source AS doc, CAST(doc_id AS INT) AS page, concat(replace({_HEAD}, '|', chr(10)), chr(10), text) AS text FROM <documents>",
    "year_lines": f"SELECT {_COMPANY} AS doc, {_ID} AS ord, concat('As at 31 March ', CAST(year(o_orderdate) + 18 AS STRING), {_pick('o_orderkey', [' and again 2019', ' and 31 March 2016, lease to 2040', ''])}) AS txt FROM <orders>",
    "proposals": f"SELECT {_COMPANY} AS doc, {_ID} AS ord, CAST(CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate) END AS INT) AS year, o_orderpriority AS item FROM <orders>",
    "items": "SELECT CAST(o_custkey AS INT) AS page, CAST(o_orderkey AS INT) AS item, CAST(month(o_orderdate) * 10 AS DOUBLE) AS y, CAST(o_orderkey % 50 AS DOUBLE) AS x0, CAST(o_orderkey % 50 + 15 AS DOUBLE) AS x1 FROM <orders>",
    "headings": "SELECT CAST(o_custkey AS INT) AS page, CAST(o_orderkey AS INT) AS ord, CAST(day(o_orderdate) * 3 AS DOUBLE) AS hy, CAST(o_orderkey % 60 AS DOUBLE) AS hx0, CAST(o_orderkey % 60 + 9 AS DOUBLE) AS hx1, concat(o_orderpriority, ' ', CAST(o_orderkey AS STRING)) AS heading FROM <orders> WHERE o_orderkey % 3 = 0",
    "segments": "SELECT CAST(o_custkey AS INT) AS page, CAST(o_orderkey AS INT) AS segment, CAST(o_orderkey % 90 AS DOUBLE) AS x0, CAST(o_orderkey % 90 + 1 + o_orderkey % 16 AS DOUBLE) AS x1 FROM <orders>",
    "columns": "SELECT CAST(o_custkey AS INT) AS page, CAST(o_orderkey AS INT) AS col, CAST(o_orderkey % 80 AS DOUBLE) AS e0, CAST(o_orderkey % 80 + 20 AS DOUBLE) AS e1 FROM <orders> WHERE o_orderkey % 2 = 0",
    "marks": "SELECT CAST(o_custkey AS INT) AS page, CAST(o_orderkey AS INT) AS a, CAST(o_orderkey % 600 AS DOUBLE) AS x FROM <orders> WHERE o_orderkey % 2 = 0",
    "centres": "SELECT CAST(o_custkey AS INT) AS page, CAST(o_orderkey AS INT) AS b, CAST(o_orderkey % 500 AS DOUBLE) AS c FROM <orders> WHERE o_orderkey % 2 = 1",
    "moves": f"SELECT concat('s', CAST(o_custkey % 50 AS STRING)) AS item, {_ID} AS id, o_totalprice AS opening, o_totalprice + (o_orderkey % 100) * 1000 AS closing FROM <orders>",
    "components": "SELECT CAST(l_orderkey AS INT) AS note, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END AS value, total, CASE l_orderkey % 3 WHEN 0 THEN total WHEN 1 THEN total * 1.0050 ELSE total * 1.5 END AS parent FROM <lineitem> JOIN (SELECT l_orderkey AS k, CAST(CAST(sum(CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice ELSE 0 END) AS DECIMAL(18, 2)) AS DOUBLE) AS total FROM <lineitem> GROUP BY l_orderkey) s ON k = l_orderkey",
    "statements": f"SELECT {_ID} AS id, {_W} AS total_a, {_whole('o_totalprice + (o_orderkey % 5) * 900')} AS total_b, {_whole('o_totalprice / 10')} AS pbt, {_whole('o_totalprice / 40')} AS tax, {_whole('o_totalprice / 10 - o_totalprice / 40 + (o_orderkey % 3) * 400')} AS pat, {_W} AS income, {_whole('o_totalprice * 0.9')} AS expense, "
    f"{_whole('o_totalprice / 8')} AS op, concat('(', {_whole('o_totalprice / 16')}, ')') AS inv, concat('(', {_whole('o_totalprice / 32')}, ')') AS fin, {_pick('o_orderkey', [None, '2', '(1)'])} AS fx, {_whole('o_totalprice / 32 + (o_orderkey % 4) * 500')} AS net, '5' AS opening, {_whole('o_totalprice / 32 + 5')} AS closing FROM <orders>",
    "found_tables": "SELECT source AS doc, CAST(doc_id AS INT) AS page, 1 AS n, lang AS scope, CASE doc_id % 4 WHEN 0 THEN 'Balance Sheet' WHEN 1 THEN 'balance sheet ' WHEN 2 THEN 'A very long section title that has no end' ELSE 'Loans: long/short' END AS section, trim(substr(coalesce(text, ''), 1, 12)) AS title FROM <documents>",
    "reflows": "SELECT CAST(o_orderkey AS INT) AS page, concat('a ', " + _W + ", ' b 5 c 5') AS before, " + _pick("o_orderkey", ["~concat('b 5 a ', " + _W + ", ' c 5')", "b 5 c 5", None, ""]) + " AS after FROM <orders>",
    "read_values": f"SELECT {_ID} AS id, {_PRINTED} AS value, {_pick('o_orderkey', [f"~concat('(', {_C}, ')', ' ', {_W})", f"~concat({_W}, ' ', {_C})", None])} AS evidence, o_orderkey % 11 = 0 AS is_count FROM <orders>",
    "calls": f"SELECT {_COMPANY} AS company, CAST(floor(o_totalprice) AS INT) AS tokens_in, CAST(o_orderkey % 1000 AS INT) AS tokens_out FROM <orders>",
    "checked_rows": f"SELECT {_COMPANY} AS company, {_pick('o_orderkey', ['ppe', 'loans', 'equity', None])} AS section, {_pick('o_orderkey', ['ok', 'miss', 'mismatch', 'false_positive', 'ok'])} AS status FROM <orders>",
    "confidences": f"SELECT {_COMPANY} AS doc, {_ID} AS id, {_pick('o_orderkey', ['reconciled', 'grounded', 'absent', 'unverified'])} AS confidence, {_pick('o_orderkey', ['investments', 'ppe', 'tax'])} AS section, {_pick('o_orderkey', ['tie', 'absent', 'absent', 'no-tie', 'tie'])} AS status FROM <orders>",
    "asset_nets": "SELECT concat('s', CAST(l_suppkey AS STRING)) AS doc, CAST(l_orderkey AS INT) AS note, CASE WHEN l_linenumber % 6 <> 0 THEN l_extendedprice END AS net, parent FROM <lineitem> JOIN (SELECT l_suppkey AS s, l_orderkey AS k, CAST(CAST(sum(l_extendedprice) AS DECIMAL(18, 2)) AS DOUBLE) AS parent FROM <lineitem> GROUP BY 1, 2) p ON s = l_suppkey AND k = l_orderkey",
    "concepts": f"SELECT concat({_pick('p_partkey', ['Share Premium', 'Total Power & Fuel Expenses', 'Share Depreciation', 'Sundry Creditors', 'Bad Debts'])}, ' ', p_name) AS key, {_pick('p_partkey', ['other equity note', 'consolidated notes', 'trade payables note', None, 'P&L other expenses', 'note on ppe'])} AS hint, {_pick('p_partkey', ['both', 'standalone', 'consolidated'])} AS scope FROM <part>",
    "face_labels": f"SELECT CAST(p_partkey AS INT) AS id, concat({_pick('p_partkey', ['III Total ', 'Sub-total ', 'TOTAL ', 'Grand total ', ''])}, {_pick('p_partkey', ['income', 'non-current assets', '~p_name', 'ASSETS', 'Income (I+II)', 'expenses', 'equity and liabilities'])}) AS label FROM <part>",
    "definitions": f"SELECT CAST(p_partkey AS INT) AS id, {_pick('p_partkey', ["~concat(p_name, ' total')", 'the sub-total of x', None, '~p_name', 'Return the total'])} AS meaning, {_pick('p_partkey', [None, '', 'TOTAL trade payables', '~p_type', 'subtotal', 'totally', 'the note total'])} AS selector FROM <part>",
    "gap_tokens": f"SELECT {_COMPANY} AS doc, CAST(l_orderkey AS INT) AS page, {_pick('l_linenumber', ['~' + _whole('l_extendedprice'), '~' + _cents('l_extendedprice'), f"~concat('(', {_whole("l_extendedprice")}, ')', ';')", '12'])} AS token FROM <lineitem> JOIN <orders> ON o_orderkey = l_orderkey",
    "gap_cells": f"SELECT {_COMPANY} AS doc, concat('x ', {_pick('l_linenumber', ['~' + _whole('l_extendedprice'), '~' + _cents('l_extendedprice')])}) AS cell FROM <lineitem> JOIN <orders> ON o_orderkey = l_orderkey WHERE l_partkey % 4 = 0",
    "report_lines": f"SELECT CAST(l_orderkey AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no, {_pick('l_linenumber', [f"~concat('|', ' ', p_type, ' ', '|', ' ', {_whole("l_extendedprice")}, ' ', '|')", '|---|---|', '| item | value |', f"~concat(p_name, ' ', {_cents("l_extendedprice")}, ' ', '(', {_whole("l_extendedprice")}, ')')"])} AS line FROM <lineitem> JOIN <part> ON p_partkey = l_partkey",
    "cells": f"SELECT CAST(l_orderkey AS INT) AS page, {_pick('l_linenumber', ['~' + _whole('l_extendedprice'), '~' + _cents('l_extendedprice')])} AS cell FROM <lineitem> WHERE l_partkey % 3 = 0",
    "aliases": "SELECT DISTINCT p_name AS alias FROM <part> UNION ALL SELECT DISTINCT concat(p_type, ' and ', p_name) FROM <part>",
    "results": f"SELECT CASE WHEN o_custkey % 3 = 0 THEN upper({_COMPANY}) ELSE {_COMPANY} END AS company, {_SCOPE} AS scope, {_KEY} AS key, bool_or(o_orderkey % 7 <> 0) AS found, max({_PRINTED}) AS value, max({_pick('o_orderkey', [None, '', None, None, 'N/A (sector)'])}) AS status FROM <orders> GROUP BY 1, 2, 3",
    "gold": f"SELECT CASE WHEN o_custkey % 2 = 0 THEN upper({_COMPANY}) ELSE {_COMPANY} END AS company, concat({_SCOPE}, ' ') AS scope, concat(' ', {_KEY}) AS key, {_pick('o_orderkey', ['~' + _W, 'Not disclosed', '~' + _C, '-', None])} AS expected, {_ID} AS ord FROM <orders>",
    "adjudicated": f"SELECT {_KEY} AS key, {_SCOPE} AS scope, min({_pick('o_custkey', ['GT_WRONG', 'MATCH_BOTH', 'PIPELINE_WRONG', 'BOTH_NOT_DISCLOSED'])}) AS verdict, max({_W}) AS true_value FROM <orders> GROUP BY 1, 2",
    "note_refs": "SELECT DISTINCT source AS doc, '12' AS ref, 'other expenses' AS title FROM <documents> UNION ALL SELECT DISTINCT source, '7', 'letter to' FROM <documents>",
    "located": f"SELECT source AS doc, {_pick('doc_id', ['bs', 'bs', 'pl', 'cf'])} AS kind, CAST(doc_id AS INT) AS page FROM <documents> WHERE doc_id % 4 > 0",
    "questions": f"SELECT CAST(doc_id AS INT) AS id, source AS doc, {_pick('doc_id', ['What are total ASSETS and net profit?', 'Cash from operating activities', 'Earnings per share', 'Who audits?', 'Borrowings', None])} AS question FROM <documents>",
    "answers": f"SELECT CAST(doc_id AS INT) AS id, source AS doc, CAST(CASE WHEN doc_id % 3 > 0 THEN doc_id END AS INT) AS page, {_pick('doc_id', ['1,000', '7', '5', '8', None])} AS value, {_pick('doc_id', [None, 'Power 5', 'no such quote', 'Tax expense 1'])} AS quote FROM <documents>",
    "answer_pages": "SELECT CAST(doc_id AS INT) AS id, CAST(doc_id AS INT) AS page, 1 AS rank FROM <documents> UNION ALL SELECT CAST(doc_id AS INT), CAST(doc_id AS INT) + 20, 2 FROM <documents> WHERE doc_id % 2 = 0",
    "statement_candidates": f"SELECT doc, kind, page, CAST(row_number() OVER (PARTITION BY doc, kind ORDER BY page) AS INT) AS rank FROM (SELECT source AS doc, {_pick('doc_id', ['bs', 'pl', 'cf'])} AS kind, CAST(doc_id AS INT) AS page FROM <documents>) c",
    "image_pages": "SELECT CASE WHEN source = 'src0' THEN 'a' ELSE source END AS doc, CAST(doc_id AS INT) AS page, CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN text END AS text, doc_id % 4 <> 0 AS has_image FROM <documents>",
    "scan_pages": "SELECT source AS doc, CAST(doc_id AS INT) AS page FROM <documents> WHERE doc_id % 9 = 0",
    "absent_values": f"SELECT {_COMPANY} AS doc, {_KEY} AS key, max(CASE WHEN o_orderkey % 3 = 0 THEN {_W} END) AS value FROM <orders> GROUP BY 1, 2",
    "rescued_values": f"SELECT {_COMPANY} AS doc, {_KEY} AS key, {_pick('o_orderkey', ['~' + _C, '~' + _W, None])} AS value, o_orderkey % 4 <> 0 AS grounded FROM <orders>",
    "blocks": "SELECT CAST(l_orderkey AS INT) AS id, array_append(array_sort(array_agg(l_extendedprice)), CAST(CAST(sum(l_extendedprice) AS DECIMAL(18, 2)) AS DOUBLE) + l_orderkey % 2) AS nums FROM <lineitem> GROUP BY l_orderkey",
    "asset_rows": "SELECT CAST(l_orderkey AS INT) AS id, array_append(array_sort(array_agg(l_quantity)), sum(l_quantity)) AS nums FROM <lineitem> GROUP BY l_orderkey",
    "targets": "SELECT CAST(l_orderkey AS INT) AS id, CASE l_orderkey % 3 WHEN 0 THEN max(l_quantity) WHEN 1 THEN sum(l_quantity) END AS value, sum(l_quantity) + l_orderkey % 2 * 0.1 AS total, array_sort(array_agg(l_quantity)) AS comps, l_orderkey % 5 = 0 AS total_wanted FROM <lineitem> GROUP BY l_orderkey",
    "taxonomy": f"SELECT concat(p_name, ' ', CAST(p_partkey AS STRING)) AS key, p_type AS concept, {_pick('p_partkey', [None, 'closing', ''])} AS column_hint, split(p_name, ' ') AS aliases, {_pick('p_partkey', ['both', 'standalone', 'consolidated'])} AS scope FROM <part>",
    "audit": f"SELECT concat(upper(p_name), '  ', CAST(p_partkey AS STRING)) AS key, {_pick('p_partkey', ['major', 'ok', 'Minor', None])} AS severity, p_brand AS suggested_concept, {_pick('p_partkey', ['', 'year', None])} AS suggested_column_hint, concat(p_type, '; ', p_name, ' | ', p_brand) AS suggested_aliases FROM <part> WHERE p_partkey % 3 = 0",
    "summaries": f"SELECT {_ID} AS id, concat('Revenue rose 12% to ₹', {_C}, ' from (987)') AS summary, {_pick('o_orderkey', ['~' + _W, f"~concat('rev ', {_C}, ' then 987')", 'none'])} AS source, split({_C}, ';') AS cells FROM <orders>",
    "addends": f"SELECT {_ID} AS id, split(concat({_C}, {_pick('o_orderkey', [';(5)', '', ';x', ';7'])}), ';') AS adds, concat('a ', {_C}, ' b (5)') AS source FROM <orders>",
    "wanted_items": f"SELECT concat('p', CAST(p_partkey AS STRING)) AS key, {_pick('p_partkey', [None, 'Gross block', 'the ACCUMULATED column', '~p_type'])} AS selector, {_pick('p_partkey', ['monetary', None, 'count'])} AS value_type, split(p_name, ' ') AS examples FROM <part>",
    "words": " UNION ALL ".join(f"SELECT DISTINCT {_BOOK} AS doc, {_SHEET} AS page, {x} AS x0, {_LINE_Y} AS y0, {x} + 5.0 * length({w}) AS x1, {_LINE_Y} + 8.0 AS y1, {w} AS word FROM <lineitem>" for x, w in (("CAST(0 AS DOUBLE)", "l_returnflag"), ("CAST(90 AS DOUBLE)", _whole("l_extendedprice")), ("CAST(180 AS DOUBLE)", "CAST(CAST(l_quantity AS INT) AS STRING)"))),
    "asset_keys": f"SELECT DISTINCT concat({_pick('p_partkey', ['gross_block_', 'accumulated_depreciation_of_', 'net_block_', 'Gross_'])}, {_pick('p_partkey', ['office_equipment', 'Vehicles', 'land', '~p_name', 'Furniture', 'aircraft', 'computer'])}) AS key FROM <part>",
    "shown_aliases": f"SELECT {_pick('p_partkey', ['ppe', 'deferred_tax', 'loans'])} AS section, split(concat(p_name, ' ', lower(p_type), ' ', lower(p_brand)), ' ') AS aliases FROM <part>",
    "parent_lines": f"SELECT concat({_pick('o_orderkey', ['Trade payables ', 'Profit before ', 'Other trade payables and borrowings ', 'Borrowings ', 'Retained earnings ', ''])}, o_orderpriority) AS label, {_PRINTED} AS value, {_pick('o_orderkey', ['12', '3', None, '14'])} AS note_ref FROM <orders>",
    "printed_lines": f"SELECT {_ID} AS id, line, split(line, ' ') AS words FROM (SELECT o_orderkey, concat({_pick('o_orderkey', ['Note 12. ', 'Total ', '', 'As at 31 March 2026 ', '(Rs in crore) '])}, {_pick('o_orderkey', ['~o_orderpriority', 'Trade payables', ''])}, ' ', {_W}, {_pick('o_orderkey', ['', f"~concat(' ', {_C})", ' (5)', ' nil'])}) AS line FROM <orders>) w",
    "row_words": f"SELECT {_ID} AS id, split(concat({_W}, ' ', {_C}, ';', {_pick('o_orderkey', ['Total', '~' + _C, 'nil -'])}, ';', {_W}, ';(', {_C}, ');', {_pick('o_orderkey', ['label', '~' + _W])}), ';') AS rows FROM <orders>",
    "page_grids": "SELECT concat('s', CAST(l_suppkey AS STRING)) AS doc, CAST(l_orderkey AS INT) AS page, 1 AS n, array_sort(array_agg(split(concat(l_returnflag, ';', CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING), ';', CAST(CAST(l_quantity AS INT) AS STRING)), ';'))) AS grid FROM <lineitem> GROUP BY l_suppkey, l_orderkey",
    "tax_lines": f"SELECT CAST(l_orderkey AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS line_no, concat({_pick('l_linenumber', ['Deferred tax assets ', 'Deferred tax liabilities ', 'Leave ', 'Other ', 'Depreciation and ', 'Gross deferred tax liabilities '])}, {_cents('l_quantity')}, ' ', {_cents('l_quantity + l_linenumber')}) AS line FROM <lineitem>",
    "face_pages": f"SELECT {_COMPANY} AS doc, {_ID} AS page, concat({_pick('o_orderkey', ['Balance Sheet as at 31 March 2026', 'Statement of Profit and Loss for the year ended', 'Notes'])}, chr(10), 'Property, plant and equipment   3   ', {_C}, '   ', {_W}, chr(10), 'Goodwill   10.00   10.00', chr(10), 'TOTAL ASSETS   ', {_cents('o_totalprice + 10')}, '   ', {_cents('floor(o_totalprice) + 10')}, chr(10), 'Equity share capital   7   ', {_C}, '   ', {_W}, chr(10), 'Other equity   8   10.00   10.00', chr(10), 'TOTAL EQUITY AND LIABILITIES   ', {_cents('o_totalprice + 10')}, '   ', {_cents('floor(o_totalprice) + 10')}) AS text FROM <orders>",
    "section_pages": f"SELECT {_COMPANY} AS doc, {_ID} AS page, CASE WHEN o_orderkey % 13 <> 0 THEN {_SCOPE} END AS scope, {_pick('o_orderkey', ['Balance Sheet', None, None, None, 'Cash flow statement', None])} AS statement, {_pick('o_orderkey', ['crore', None, None, 'lakh', None, None, None])} AS units FROM <orders>",
    "section_headings": f"SELECT {_COMPANY} AS doc, {_ID} AS page, CAST(n * 30 AS DOUBLE) AS y, concat(CAST(n AS STRING), '. Note of part ', CAST(part AS STRING)) AS heading FROM {_LINES_OF_ORDERS} WHERE part % 3 = 0",
    "section_tables": f"SELECT {_COMPANY} AS doc, {_ID} AS page, n, CAST(n * 30 + CASE WHEN n % 2 = 0 THEN 0 ELSE 15 END AS DOUBLE) AS y, CASE WHEN part % 11 = 0 THEN 'Profit and loss' END AS own FROM {_LINES_OF_ORDERS}",
    "whole_payloads": f"SELECT {_ORDER} AS doc, CASE o_orderkey % 9 WHEN 7 THEN 'broken' WHEN 8 THEN NULL ELSE {_whole_answer()} END AS payload FROM <orders>",
    "target_payloads": f"SELECT {_ORDER} AS doc, n AS {_WINDOW}, CASE WHEN part % 17 = 0 THEN 'no JSON' ELSE concat('[{{\"key\": \"x\", \"present\": true, \"value\": \"` ', {_whole('price')}, '\", \"evidence\": \"x (', {_whole('price')}, ')\"}}, {{\"key\": \"y\", \"present\": ', {_pick('part', ['true', 'false', 'true'])}, ', \"value\": \"', {_cents('price')}, '\"}}]') END AS payload FROM {_LINES_OF_ORDERS}",
    "category_payloads": f"SELECT {_ORDER} AS doc, CASE o_orderkey % 9 WHEN 8 THEN NULL WHEN 7 THEN 'no JSON' ELSE concat('[{{\"key\": \"bonds\", \"present\": true, \"lines\": [{{\"label\": \"p\", \"value\": \"', {_W}, '\"}}, {{\"label\": \"q\", \"value\": \"(', {_whole('o_totalprice / 4')}, ')\"}}, {{\"label\": \"r\", \"value\": \"x\"}}]}}, {{\"key\": \"ventures\", \"present\": ', {_pick('o_orderkey', ['false', 'true'])}, ', \"lines\": [{{\"label\": \"p\", \"value\": \"', {_C}, '\"}}]}}]') END AS payload FROM <orders>",
    "line_answers": f"SELECT {_ORDER} AS doc, CASE o_orderkey % 9 WHEN 8 THEN NULL WHEN 7 THEN 'no JSON' ELSE concat('[{{\"label\": \"Loans\", \"note_ref\": \"4\", \"value\": \"(', {_W}, ')\"}}, {{\"label\": \"Cash\", \"value\": \"', {_C}, '\"}}]') END AS payload FROM <orders>",
    "parsed_lines": f"SELECT {_ORDER} AS doc, {_ID} AS page, n AS line_no, concat('Note of part ', CAST(part AS STRING)) AS label, {_pick('part', [None, '4', '12'])} AS ref, {_cents('price')} AS value FROM {_LINES_OF_ORDERS} WHERE o_orderkey % 3 = 0",
}


def names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"<(\w+)>", sql)))


def in_spark(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = GIVEN[name]
    for table in names(sql):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"given_{table}")
    return spark.sql(re.sub(r"<(\w+)>", r"given_\1", sql))


def as_sql(name: str) -> str:
    return re.sub(r"<(\w+)>", r"\1", GIVEN[name])
