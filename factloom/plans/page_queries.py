"""Queries of the page operators. Small reports stand in for the driver's documents, which hold no statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from .fixtures import table
from .registry import documents, query

_LINES = r"list_filter(list_transform(string_split_regex({0}, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_SQUEEZED = r"regexp_replace(lower({0}), '\s+', '', 'g')"
_TOPS = f""", lines AS (SELECT *, max(page) OVER (PARTITION BY doc) AS n, {_LINES.format('text')} AS ls, {_SQUEEZED.format('text')} AS c FROM report_pages),
  tops AS (SELECT *, {_SQUEEZED.format("array_to_string(ls[1:6], ' ')")} AS top FROM lines)"""


def _any(words, s: str = "c") -> str:
    return "(" + " OR ".join(f"contains({s}, '{w}')" for w in words) + ")"


_HITS = {
    "bs": f"contains(c, 'totalassets') AND {_any(P.LIABILITY_TOTALS + P.ASSET_SECTIONS)} OR contains(c, 'sourcesoffunds') AND contains(c, 'applicationoffunds') OR contains(c, 'capitalandliabilities') AND contains(c, 'deposits') OR regexp_matches(c, 'balancesheetas(at|on)')",
    "pl": f"{_any(P.REVENUE)} AND {_any(P.PROFIT)} OR {_any(P.INCOME_SECTIONS)}",
    "cf": _any(P.CASH),
}


def _candidates(where: str = "true") -> str:
    kinds = " UNION ALL ".join(f"SELECT doc, page, n, '{k}' AS kind, regexp_matches(top, '{P.TITLES[k]}') AS title, ({h}) OR regexp_matches(top, '{P.TITLES[k]}') AS hit FROM tops WHERE {where}" for k, h in _HITS.items())
    return f"SELECT doc, kind, page, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY title DESC, page::DOUBLE / n < 0.4::DOUBLE, page)::INTEGER AS rank FROM ({kinds}) WHERE hit) WHERE rank <= 8"


@query(_TOPS + _candidates(), "report_pages")
def f4_candidate_pages(spark, sf_dir):
    return P.candidate_pages(table(spark, "report_pages"))


@query(_TOPS + _candidates("page >= 6"), "report_pages")
def f4_candidates_of_a_scope(spark, sf_dir):
    return P.candidate_pages(table(spark, "report_pages"), allowed=F.col("page") >= 6)


@query(r""", t AS (SELECT doc, regexp_replace(replace(lower(text), '&', 'and'), '[\s\-]+', '', 'g') AS s FROM report_pages) SELECT doc, CASE WHEN bool_or(contains(s, 'capitalandliabilities')) THEN 'bank' WHEN bool_or(contains(s, 'policyholders')) THEN 'insurer'
  WHEN bool_or(contains(s, 'financialassets')) AND bool_or(contains(s, 'debtsecurities')) THEN 'nbfc' ELSE 'manufacturer' END AS format FROM t GROUP BY doc""", "report_pages")
def f8_statement_formats(spark, sf_dir):
    return P.statement_formats(table(spark, "report_pages"))


def _title(scope: str) -> str:
    s = r"regexp_replace(x, '\s+', '', 'g')"
    tests = " OR ".join(f"strpos(lower({s}), '{scope}{t}') = 1 OR (strpos(lower({s}), '{scope}{t}') > 1 AND NOT regexp_matches(substr({s}, strpos(lower({s}), '{scope}{t}') - 1, 1), '\\p{{Ll}}'))" for t in P.SCOPE_TITLES)
    return rf"len(list_filter(flatten(list_transform(ls[1:6], lambda y: string_split_regex(y, '\s{{3,}}'))), lambda x: {tests})) > 0"


def _section(scope: str, other: str) -> str:
    s = _SQUEEZED.format("x")
    tests = " OR ".join(f"(contains({s}, '{p}') AND length({s}) - {len(p)} <= 25)" for p in P.SCOPE_SECTIONS[scope])
    return f"len(list_filter(ls[1:6], lambda x: {tests})) > 0 AND NOT contains(top, '{other}')"


_TAGS = _TOPS + f""", flags AS (SELECT doc, page, top, {_title('consolidated')} AS ct, {_title('standalone')} AS st, {_section('consolidated', 'standalone')} AS cs, {_section('standalone', 'consolidated')} AS ss FROM tops),
  chosen AS (SELECT *, CASE WHEN ct OR st THEN ct ELSE cs END AS con, CASE WHEN ct OR st THEN st ELSE ss END AS std FROM flags),
  anchored AS (SELECT *, CASE WHEN con AND NOT std THEN 'consolidated' WHEN std AND NOT con OR NOT con AND NOT std AND NOT contains(top, 'consolidated') AND regexp_matches(top, '{P.PLAIN_TITLE}') THEN 'standalone' END AS a FROM chosen),
  tags AS (SELECT doc, page, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING), 'unknown') AS tag FROM anchored) """


@query(_TAGS + "SELECT * FROM tags", "report_pages")
def t4_scope_tags(spark, sf_dir):
    return P.scope_tags(table(spark, "report_pages"))


@query(_TAGS + "SELECT doc, page, tag FROM (SELECT *, bool_or(tag = 'consolidated') OVER (PARTITION BY doc) AS has FROM tags) WHERE tag IN ('consolidated', 'unknown') OR NOT has", "report_pages")
def f2_scope_pages(spark, sf_dir):
    return P.scope_pages(P.scope_tags(table(spark, "report_pages")), "consolidated")


@query(_TAGS + f"SELECT doc, kind, page, tag FROM (SELECT *, bool_or(tag = 'standalone') OVER (PARTITION BY doc, kind) AS has FROM ({_candidates()}) JOIN tags USING (doc, page)) WHERE tag = 'standalone' OR NOT has", "report_pages")
def f3_tagged_first(spark, sf_dir):
    pages = table(spark, "report_pages")
    return P.tagged_first(P.candidate_pages(pages).join(P.scope_tags(pages), ["doc", "page"]), "standalone", ["doc", "kind"]).select("doc", "kind", "page", "tag")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_HEADS = f"list_filter(ls, lambda x: length(x) <= 70 AND (regexp_matches(x, '{_quoted(P.HEADING)}') OR regexp_matches(x, '{_quoted(P.NOTES_HEADING)}') OR regexp_matches(x, '{_quoted(P.FOOTER)}')))"
_FIRST_HEAD = r"list_filter(ls, lambda x: length(x) <= 70 AND regexp_matches(x, '(?i)^(consolidated\s+|standalone\s+)?balance sheet\b'))[1]"
_MARKS = "(contains(t, 'equity and liabilities') OR contains(t, 'total equity') OR contains(t, 'total assets') AND contains(t, 'total liabilities')) AND (contains(t, 'as at') OR contains(t, 'as on'))"
_FLAGS = _TOPS + f""", marked AS (SELECT *, lower(text) AS t, {_HEADS} AS heads, {_FIRST_HEAD} AS h FROM tops),
  found AS (SELECT doc, page, CASE WHEN {_MARKS} AND h IS NOT NULL THEN CASE WHEN contains(lower(h), 'consolidated') THEN 'consolidated' ELSE 'standalone' END END AS anchor,
    len(list_filter(heads, lambda x: contains(lower(x), 'consolidated'))) > 0 AS con, len(list_filter(heads, lambda x: NOT contains(lower(x), 'consolidated'))) > 0 AS std,
    len(list_filter(ls, lambda x: length(x) < 70 AND regexp_matches(x, '{_quoted(P.STATEMENTS_START)}'))) > 0 AS start FROM marked) """


@query(_FLAGS + "SELECT doc, page, CASE WHEN con AND NOT std THEN 'CONSOLIDATED' WHEN std AND NOT con THEN 'STANDALONE' END AS signal FROM found", "report_pages")
def t5_scope_signals(spark, sf_dir):
    return table(spark, "report_pages").select("doc", "page", P.scope_signal(F.col("text")).alias("signal"))


@query(_FLAGS + "SELECT doc, min(page) FILTER (anchor = 'standalone') AS standalone, min(page) FILTER (anchor = 'consolidated') AS consolidated FROM found GROUP BY doc", "report_pages")
def t6_balance_anchors(spark, sf_dir):
    return P.balance_anchors(table(spark, "report_pages"))


@query(_FLAGS + """SELECT doc, page, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN page < least(a, b) THEN 'FRONT' WHEN (page < greatest(a, b)) = (a < b) THEN 'STANDALONE' ELSE 'CONSOLIDATED' END WHEN f IS NULL OR page < f THEN 'FRONT'
  ELSE coalesce(last_value(CASE WHEN page < f THEN NULL WHEN con AND NOT std THEN 'CONSOLIDATED' WHEN std AND NOT con THEN 'STANDALONE' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING), 'STANDALONE') END AS region
  FROM (SELECT *, min(page) FILTER (anchor = 'standalone') OVER w AS a, min(page) FILTER (anchor = 'consolidated') OVER w AS b, min(page) FILTER (start) OVER w AS f FROM found WINDOW w AS (PARTITION BY doc))""", "report_pages")
def w3_regions(spark, sf_dir):
    return P.regions(table(spark, "report_pages"))


_TOC = r"""len(ls) >= 8 AND (len(list_filter(ls, lambda x: length(x) < 80 AND regexp_matches(regexp_replace(x, '[. ]+$', ''), '(^|\s)\d+$'))) > 0.4::DOUBLE * len(ls)
  OR len(list_filter(ls, lambda x: contains(x, '...') OR length(x) - length(replace(x, '.', '')) > 8)) > 0.3::DOUBLE * len(ls))"""


@query(_TOPS + f" SELECT doc, page, {_TOC} AS contents FROM tops", "report_pages")
def f9_contents_pages(spark, sf_dir):
    return table(spark, "report_pages").select("doc", "page", P.contents_page(F.col("text")).alias("contents"))


@query(f"SELECT page, {_TOC} AS contents FROM (SELECT doc_id AS page, {_LINES.format('text')} AS ls FROM documents)")
def f9_contents_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("page", P.contents_page(F.col("text")).alias("contents"))


@query(r"""SELECT DISTINCT doc, ref, page FROM report_pages JOIN note_refs USING (doc) WHERE contains(lower(text), title) AND (regexp_matches(text, '(?mi)^\s*(note\s*)?' || ref || '[.)\s:]') OR regexp_matches(text, '(?i)\b' || ref || '\s*[.)]\s*' || title))""", "report_pages", "note_refs")
def j9_note_pages(spark, sf_dir):
    return P.note_pages(table(spark, "report_pages"), table(spark, "note_refs"))


_TERMS, _CORE = ["share", "capital", "authorised", "issued", "subscribed", "equity", "shares"], [["authorised", "authorized"], ["issued"], ["subscribed"]]
_COUNTS = f"SELECT doc, page, {' + '.join(_any(g, 'lower(text)') + '::INT' for g in _CORE)} AS core, {' + '.join(_any([w], 'lower(text)') + '::INT' for w in _TERMS)} AS hits, page <= 5 AS ok FROM report_pages"


@query(f"SELECT doc, page, core, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY core DESC, hits DESC, page)::INTEGER AS rank FROM (SELECT *, bool_or(ok) OVER (PARTITION BY doc) AS any_ok FROM ({_COUNTS}) WHERE hits >= 4) WHERE ok OR NOT any_ok) WHERE rank <= 2", "report_pages")
def t7_signature_pages(spark, sf_dir):
    return P.signature_pages(table(spark, "report_pages"), _TERMS, _CORE, F.col("page") <= 5)


@query("SELECT doc, string_agg('=== PAGE ' || page || ' ===' || chr(10) || text, chr(10) ORDER BY page) AS body FROM report_pages WHERE page <= 3 GROUP BY doc", "report_pages")
def s12_assemble(spark, sf_dir):
    return P.assemble(table(spark, "report_pages").where("page <= 3"))


@query(""", sized AS (SELECT *, max(page) OVER (PARTITION BY doc) AS n FROM report_pages) SELECT doc, n AS n_pages, n <= 50 AND sum(length(text)) / 4 <= 100000 AS small, n <= 60 AND sum(length(text)) // 4 <= 60000 AS one_call, sum(CASE WHEN (page - 1) % greatest(1, n // 60) = 0 THEN length(text) ELSE 0 END) < 1500 AS image_only FROM sized GROUP BY doc, n""", "report_pages")
def s13_routing(spark, sf_dir):
    return P.routing(table(spark, "report_pages"))


_NUMBERS = r"list_transform(regexp_extract_all({0}, '\d[\d,]*\.?\d*'), lambda x: replace(x, ',', ''))"


@query(f"SELECT page, after IS NULL OR len(list_filter(list_distinct(a), lambda t: len(list_filter(a, lambda x: x = t)) > len(list_filter(b, lambda x: x = t)))) > 0 AS loses FROM (SELECT *, {_NUMBERS.format('before')} AS a, {_NUMBERS.format('''coalesce(after, '')''')} AS b FROM reflows)", "reflows")
def u1_lost_numbers(spark, sf_dir):
    return table(spark, "reflows").select("page", P.loses_numbers(F.col("before"), F.col("after")).alias("loses"))
