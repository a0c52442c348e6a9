"""Queries of printed values, table identities, grounding and merging, over small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N, values as X
from ..operators import pages as P, reconcile as R, verify as V
from ..operators.lineage import cut, spread
from .fixtures import table
from .queries import _stated
from .registry import query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEANED = _STRIP.format(r"regexp_replace({0}, '" + X.MARKS + "', '', 'g')")


def _clean(c: str) -> str:
    v = _CLEANED.format(c)
    return rf"CASE WHEN regexp_matches({v}, '\d') THEN {v} ELSE {c} END"


def _digits(c: str) -> str:
    return rf"regexp_replace({c}, '\D', '', 'g')"


def _printed(x: str) -> str:
    a = f"abs({x})"
    body = f"CASE WHEN abs({a} - round_even({a}, 0)) < 0.005 THEN format('{{:,.0f}}', round_even({a}, 0)) WHEN abs({a} * 10 - round_even({a} * 10, 0)) < 0.05 THEN format('{{:,.1f}}', {a}) ELSE format('{{:,.2f}}', {a}) END"
    return f"CASE WHEN {x} < 0 THEN '(' || {body} || ')' ELSE {body} END"


# A place counts as bounded if neither neighbour is a digit or a dot; pieces between places of one number that touch are empty.
@query(", " + rf"""cleaned AS (SELECT *, {_clean('value')} AS v FROM read_values), found AS (SELECT *, {_STRIP.format('v')} AS s, regexp_extract({_STRIP.format('v')}, '\d[\d,]*\.?\d*') AS number FROM cleaned),
  parts AS (SELECT *, string_split(evidence, number) AS p FROM found), counted AS (SELECT *, len(list_filter(range(1, len(p)), lambda i: NOT regexp_matches(right(p[i], 1), '[\d.]') AND NOT regexp_matches(left(p[i + 1], 1), '[\d.]') AND (p[i] <> '' OR i = 1) AND (p[i + 1] <> '' OR i = len(p) - 1))) AS places,
    len(regexp_extract_all(evidence, '\(\s*' || replace(number, '.', '\.') || '\s*\)')) AS bracketed FROM parts)
  SELECT id, v AS cleaned, CASE WHEN NOT is_count AND number <> '' AND NOT starts_with(s, '(') AND NOT starts_with(s, '-') AND places > 0 AND places = bracketed THEN '(' || s || ')' ELSE v END AS value FROM counted""", "read_values")
def x6_value_hygiene(spark, sf_dir):
    v = F.col("value")
    return table(spark, "read_values").select("id", X.clean_value(v).alias("cleaned"), X.hygiene(v, F.col("evidence"), F.col("is_count")).alias("value"))


_WORD = r"length(regexp_replace(w, '[^0-9]', '', 'g')) >= 1 AND length(regexp_replace(w, '[^0-9]', '', 'g')) >= 0.5 * length(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'))"


@query(" " + rf"""SELECT id, coalesce(len(list_filter(string_split_regex(cell, '\s+'), lambda w: {_WORD})) > 0, false) AS numericish, regexp_matches(coalesce(cell, ''), '\d') OR {_STRIP.format("coalesce(cell, '')")} IN ('-', '–', '—', 'nil', 'Nil', 'NIL', '') AS acceptable,
  CASE WHEN length(cell) > 0 THEN len(list_filter(string_split(cell, ''), lambda c: contains('{X.ODD}', c) OR unicode(c) > 192))::DOUBLE / length(cell) ELSE 0 END AS odd FROM seen_cells""", "seen_cells")
def f10_cell_tests(spark, sf_dir):
    c = F.col("cell")
    return table(spark, "seen_cells").select("id", X.numericish(c).alias("numericish"), X.acceptable(c).alias("acceptable"), X.odd_share(c).alias("odd"))


_TOTAL_WORDS = " OR ".join(f"contains(m, '{w}') OR contains(s, '{w}')" for w in (t.replace("'", "''") for t in X.TOTAL_WORDS))


@query(rf", t AS (SELECT id, lower(coalesce(meaning, '')) AS m, lower(coalesce(selector, '')) AS s FROM definitions) SELECT id, regexp_matches(s, '^\s*total\b') OR regexp_matches(m, '(^|\s)[—–-]\s*total\b') OR {_TOTAL_WORDS} AS total FROM t", "definitions")
def f18_wants_total(spark, sf_dir):
    return table(spark, "definitions").select("id", X.wants_total(F.col("meaning"), F.col("selector")).alias("total"))


_ADD = _stated(f"({_clean('a')})")


@query(f""", kept AS (SELECT *, list_filter(adds, lambda a: {_ADD} IS NOT NULL) AS k FROM addends), summed AS (SELECT *, list_sum(list_transform(k, lambda a: {_ADD})) AS x FROM kept)
  SELECT id, CASE WHEN len(k) BETWEEN 2 AND 12 THEN {_printed('x')} END AS value, CASE WHEN len(k) BETWEEN 2 AND 12 THEN len(list_filter(k, lambda a: length({_digits('a')}) < 3 OR NOT contains({_digits('source')}, {_digits('a')}))) = 0 END AS grounded,
  CASE WHEN len(k) > 0 THEN CASE WHEN x < 0 THEN '(' ELSE '' END || CASE WHEN abs(x - round_even(x, 0)) < 0.5 THEN format('{{:,.0f}}', round_even(abs(x), 0)) ELSE format('{{:,.2f}}', abs(x)) END || CASE WHEN x < 0 THEN ')' ELSE '' END END AS category FROM summed""", "addends")
def a8_addends(spark, sf_dir):
    c = X.composite(F.col("adds"), F.col("source"))
    return table(spark, "addends").select("id", c["value"].alias("value"), c["grounded"].alias("grounded"), X.category_sum(F.col("adds")).alias("category"))


@query(r""", t AS (SELECT id, regexp_replace(regexp_replace(lower(label), '\([^)]*\)', '', 'g'), '[^a-z]', '', 'g') AS l FROM face_labels) SELECT id, l AS folded, ends_with(l, 'totalincome') AND length(l) - 11 <= 4 AND NOT ends_with(left(l, length(l) - 11), 'sub') AS total FROM t""", "face_labels")
def x8_face_totals(spark, sf_dir):
    l = F.col("label")
    return table(spark, "face_labels").select("id", X.face_label(l).alias("folded"), X.is_face_total(l, ("totalincome",)).alias("total"))


@query("")
def x7_face_rows(spark, sf_dir):
    lines = spread(table(spark, "face_pages")).select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc", "page", "line_no", F.inline(F.array_compact(F.array(X.face_row(F.col("line"))))))  # each line is read once


@query("")
def v4_results_tie(spark, sf_dir):
    return R.results_tie(table(spark, "results_grid"), ["sheet"])


@query("")
def v8_splits(spark, sf_dir):
    return table(spark, "asset_rows").select("id", F.inline(R.splits(F.col("nums"), V.block_closes)))


@query(" SELECT id, coalesce(NOT total_wanted AND len(list_filter(comps, lambda x: abs(coalesce(x, 0)) > greatest(abs(total) * 0.005, 0.5))) >= 2 AND abs(value - total) < greatest(abs(total) * 0.005, 0.5), false) AS refused FROM targets", "targets")
def v6_refusals(spark, sf_dir):
    return table(spark, "targets").select("id", R.refused(F.col("value"), F.col("total"), F.col("comps"), F.col("total_wanted")).alias("refused"))


_ROW = r"list_transform(regexp_extract_all(line, '\(?-?[\d,]*\.?\d+\)?'), lambda x: replace(x, ',', '')::DOUBLE)"
_TAX = r"deferred\s+tax\s+(asset|liabilit)"


@query(", " + rf"""d AS (SELECT page, line_no, lower(line) AS l, {_ROW} AS n, lag(lower(line), 1) OVER w AS p1, lag(lower(line), 2) OVER w AS p2 FROM tax_lines WINDOW w AS (PARTITION BY page ORDER BY line_no)),
  t AS (SELECT page, line_no AS total_no, n AS t, CASE WHEN contains(regexp_extract(l, '{_TAX}'), 'asset') THEN 'dta' ELSE 'dtl' END AS block FROM d WHERE regexp_matches(l, '^(gross|total)\s+{_TAX}') AND len(n) = 2),
  near AS (SELECT t.*, d.*, max(CASE WHEN CASE WHEN len(n) = 0 THEN regexp_matches(l, '{_TAX}') ELSE len(n) <> 2 OR contains(l, 'total') OR contains(l, 'gross') END THEN line_no END) OVER (PARTITION BY t.page, total_no) AS stop FROM t JOIN d ON t.page = d.page AND line_no BETWEEN greatest(total_no - 13, 1) AND total_no - 1),
  parts AS (SELECT * EXCLUDE (page_1), count(*) OVER w AS k, sum(n[1]) OVER w AS s1, sum(n[2]) OVER w AS s2 FROM near WHERE len(n) > 0 AND (stop IS NULL OR line_no > stop) WINDOW w AS (PARTITION BY page, total_no))
  SELECT page, total_no, line_no, concat_ws(' ', l, CASE WHEN NOT regexp_matches(p1, '\d') THEN p1 END, CASE WHEN NOT regexp_matches(p2, '\d') THEN p2 END) AS label, n[1] AS value, block FROM parts
  WHERE k >= 2 AND abs(s1 - t[1]) < greatest(abs(t[1]) * 0.001, 0.6) AND abs(s2 - t[2]) < greatest(abs(t[2]) * 0.001, 0.6)""", "tax_lines")
def v10_deferred_tax_tables(spark, sf_dir):
    return R.deferred_tax_tables(table(spark, "tax_lines"), ["page"])


_QUOTE = r"left(regexp_replace(lower(coalesce(quote, '')), '\s+', '', 'g'), 60)"


@query(f""", tried AS (SELECT id, page, min(rank) AS rank FROM (SELECT * FROM answer_pages UNION ALL SELECT id, page, 0 FROM answers WHERE page IS NOT NULL) GROUP BY id, page),
  seen AS (SELECT a.id, t.page, t.rank, CASE WHEN length({_digits("coalesce(value, '')")}) >= 3 AND contains({_digits('text')}, {_digits('value')}) THEN 1 WHEN {_QUOTE} <> '' AND contains(regexp_replace(lower(text), '\\s+', '', 'g'), {_QUOTE}) THEN 2 END AS way
    FROM answers a JOIN tried t USING (id) JOIN report_pages p ON p.doc = a.doc AND p.page = t.page)
  SELECT a.id, coalesce(s.page, a.page) AS page, s.page IS NOT NULL AS grounded FROM answers a LEFT JOIN (SELECT * FROM seen WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY way, rank, page) = 1) s USING (id)""", "answers", "answer_pages", "report_pages")
def g1_answer_grounding(spark, sf_dir):
    return R.answer_grounding(table(spark, "answers"), table(spark, "answer_pages"), table(spark, "report_pages"))


@query(rf""" SELECT id, list_sort(list_distinct(list_filter(regexp_extract_all(summary, '[₹$]?\(?-?[\d,]+(?:\.\d+)?\)?%?'), lambda x: length({_digits('x')}) >= 3 AND NOT contains({_digits('source')}, {_digits('x')})))) AS unfounded,
  len(list_filter(cells, lambda c: length({_digits("coalesce(c, '')")}) >= 3 AND NOT contains({_digits('source')}, {_digits('c')}))) = 0 AS row_grounded, NOT (length(source) >= 200 AND length({_digits("coalesce(cells[1], '')")}) >= 3 AND NOT contains({_digits('source')}, {_digits("coalesce(cells[1], '')")})) AS image_grounded FROM summaries""", "summaries")
def t14_unfounded_figures(spark, sf_dir):
    s = F.col("source")
    return table(spark, "summaries").select("id", R.unfounded(F.col("summary"), s).alias("unfounded"), R.row_grounding(F.col("cells"), s).alias("row_grounded"), R.image_grounding(F.get("cells", 0), s).alias("image_grounded"))


_OUTCOMES = f"""(SELECT company, key, CASE WHEN want IS NULL THEN CASE WHEN has THEN 'false_positive' ELSE 'ok' END WHEN NOT has THEN 'miss' WHEN coalesce(CASE WHEN abs(got) < 1e-9 THEN abs(want) < 0.5 ELSE abs(want - got) / abs(got) < 0.01 END, false) THEN 'ok' ELSE 'mismatch' END AS outcome
  FROM (SELECT t.company, t.key, {_stated('expected')} AS want, {_stated('value')} AS got, coalesce(found, false) AS has FROM truth t LEFT JOIN (SELECT * FROM facts WHERE ord <> 1) f ON t.company = f.company AND t.scope = f.scope AND t.key = f.key))"""


@query(f" SELECT company, key, arg_min(outcome, list_position(['mismatch', 'miss', 'false_positive', 'ok'], outcome)) AS outcome FROM {_OUTCOMES} GROUP BY company, key", "truth", "facts")
def j17_worst_outcome(spark, sf_dir):
    facts = table(spark, "facts").where("ord <> 1").drop("ord")
    rows = table(spark, "truth").join(facts, ["company", "scope", "key"], "left").select("company", "key", R.outcome(F.col("expected"), F.col("found"), F.col("value")).alias("outcome"))
    return R.worst_outcome(rows, ["company", "key"])


@query(" SELECT id, CASE WHEN section = 'investments' AND confidence IN ('reconciled', 'grounded') THEN 'unverified' ELSE confidence END AS confidence FROM confidences", "confidences")
def c4_capped_confidence(spark, sf_dir):
    return table(spark, "confidences").select("id", R.capped(F.col("confidence"), F.col("section")).alias("confidence"))


@query(" SELECT doc, bool_and(status IN ('tie', 'absent')) AND bool_or(status = 'tie') AS fully FROM confidences GROUP BY doc", "confidences")
def c6_validated(spark, sf_dir):
    return R.validated(table(spark, "confidences"), ["doc"])


@query(""", u AS (SELECT company, scope, key, found AS present, value, 1 AS priority, ord FROM facts WHERE ord % 2 = 0 UNION ALL SELECT company, scope, key, found, value, 2, ord FROM facts)
  SELECT company, scope, key, present, value, priority FROM u QUALIFY row_number() OVER (PARTITION BY company, scope, key ORDER BY present DESC, priority, ord) = 1""", "facts")
def r15_precedence(spark, sf_dir):
    f = table(spark, "facts").select("company", "scope", "key", F.col("found").alias("present"), "value", "ord")
    return R.precedence([(1, f.where("ord % 2 = 0")), (2, f)], ["company", "scope", "key"]).select("company", "scope", "key", "present", "value", "priority")


@query(""", x AS (SELECT company, has_consolidated AS h, key, coalesce(list_contains(na_items, key), false) AS na, CASE WHEN coalesce(list_contains(na_items, key), false) THEN ['both'] WHEN scope = 'both' THEN ['standalone', 'consolidated'] ELSE [scope] END AS s FROM profiles, taxonomy),
  y AS (SELECT company, h, key, na, unnest(s) AS scope FROM x) SELECT company, key, scope, CASE WHEN na THEN 'N/A (sector)' WHEN scope = 'consolidated' AND NOT h THEN 'N/A (no consolidated statements)' ELSE 'wanted' END AS status FROM y""", "profiles", "taxonomy")
def f17_applicability(spark, sf_dir):
    return R.applicability(table(spark, "taxonomy"), table(spark, "profiles"))


@query(r""", n AS (SELECT *, trim(regexp_replace(replace(lower(key), '&', ' and '), '\s+', ' ', 'g')) AS k FROM taxonomy), a AS (SELECT trim(regexp_replace(replace(lower(key), '&', ' and '), '\s+', ' ', 'g')) AS k, upper(trim(severity)) AS severity, nullif(trim(suggested_concept), '') AS c, nullif(trim(suggested_column_hint), '') AS h, coalesce(suggested_aliases, '') AS s FROM audit WHERE upper(trim(severity)) <> 'OK'),
  m AS (SELECT *, severity IS NOT NULL AND key <> 'Bad Debts' AS take, list_concat(coalesce(aliases, []), list_filter(list_transform(string_split_regex(coalesce(s, ''), '[;|]'), lambda x: trim(x)), lambda x: x <> '')) AS merged FROM n LEFT JOIN a USING (k))
  SELECT key, CASE WHEN take THEN coalesce(c, concept) ELSE concept END AS concept, CASE WHEN take THEN coalesce(h, column_hint) ELSE column_hint END AS column_hint, CASE WHEN take THEN list_filter(merged, lambda x, i: list_position(merged, x) = i) ELSE aliases END AS aliases,
    CASE WHEN severity IS NULL THEN NULL WHEN take THEN 'accepted' ELSE 'deferred' END AS review FROM m""", "taxonomy", "audit")
def j5_merge_audit(spark, sf_dir):
    return R.merge_audit(table(spark, "taxonomy"), table(spark, "audit"), ["Bad Debts"])


@query(rf""", f AS (SELECT doc, page, n, len(grid) AS len, left(array_to_string(list_filter(list_transform(flatten(grid[1:3]), lambda c: {_digits("coalesce(c, '')")}), lambda d: d <> ''), '|'), 80) AS sig FROM page_grids),
  k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc, page, sig ORDER BY len DESC, n) = 1) SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY len DESC, n)::INTEGER AS n, len::INTEGER AS n_rows FROM k""", "page_grids")
def o10_distinct_tables(spark, sf_dir):
    return R.distinct_tables(table(spark, "page_grids"), ["doc"]).select("doc", "page", "n", F.size("grid").alias("n_rows"))


@query("")
def r4_statement_faces(spark, sf_dir):
    pages = spread(table(spark, "face_pages"))
    found = cut(P.candidate_pages(pages))
    return R.statement_faces(pages, found, "bs").withColumn("kind", F.lit("bs")).unionByName(R.statement_faces(pages, found, "pl").withColumn("kind", F.lit("pl")))
