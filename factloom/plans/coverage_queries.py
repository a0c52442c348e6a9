"""Queries of what a reading left out and of what is put in its place, and of number parsers and targets that readers use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import coverage as C, reports as P, schedules as S
from .fixtures import table
from .queries import _FIRST
from .registry import query

_CAP = "cap AS (SELECT DISTINCT doc, d FROM (SELECT doc, regexp_replace(unnest(string_split_regex(coalesce(cell, ''), '\\s+')), '\\D', '', 'g') AS d FROM gap_cells) WHERE length(d) >= 4)"


@query(f""", {_CAP}, t AS (SELECT doc, page, regexp_replace(token, '^[.,;:()*]+|[.,;:()*]+$', '', 'g') AS c FROM gap_tokens), m AS (SELECT doc, page, count(*) AS missing FROM t WHERE length(regexp_replace(c, '\\D', '', 'g')) >= 4
  AND regexp_matches(c, '^\\(?-?\\d{{1,3}}(,\\d{{2,3}})+(\\.\\d+)?\\)?$|^\\(?-?\\d+\\.\\d+\\)?$') AND NOT EXISTS (SELECT 1 FROM cap WHERE cap.doc = t.doc AND cap.d = regexp_replace(c, '\\D', '', 'g')) GROUP BY doc, page HAVING count(*) >= 3)
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page)::INTEGER AS rank FROM m QUALIFY rank <= 4""", "gap_tokens", "gap_cells")
def y12_gap_pages(spark, sf_dir):
    return C.gap_pages(table(spark, "gap_tokens"), table(spark, "gap_cells"))


@query(f""", {_CAP}, t AS (SELECT doc, page, n, list(d) AS ds, row_number() OVER (PARTITION BY doc ORDER BY page, n) AS k FROM (SELECT doc, page, n, regexp_replace(unnest(string_split_regex(coalesce(cell, ''), '\\s+')), '\\D', '', 'g') AS d FROM (SELECT doc, page, n, unnest(flatten(grid)) AS cell FROM more_tables)) WHERE length(d) >= 4 GROUP BY doc, page, n),
  s AS (SELECT doc, 0::BIGINT AS k, 0 AS page, 0 AS n, coalesce((SELECT list(d) FROM cap WHERE cap.doc = x.doc), []::VARCHAR[]) AS taken, false AS ok FROM (SELECT DISTINCT doc FROM t) x UNION ALL
    SELECT doc, k, page, n, CASE WHEN new >= 3 THEN list_concat(taken, ds) ELSE taken END, new >= 3 FROM (SELECT t.doc, t.k, t.page, t.n, t.ds, s.taken, len(list_filter(t.ds, lambda x: NOT list_contains(s.taken, x))) AS new FROM s JOIN t ON t.doc = s.doc AND t.k = s.k + 1))
  SELECT doc, page, n FROM s WHERE ok""", "more_tables", "gap_cells", recursive=True)
def y12_worthwhile(spark, sf_dir):
    return C.worthwhile(table(spark, "more_tables"), table(spark, "gap_cells")).select("doc", "page", "n")


@query(""", u AS (SELECT doc, page, n, 'found' AS source FROM page_grids p WHERE NOT EXISTS (SELECT 1 FROM scan_pages s WHERE s.doc = p.doc AND s.page = p.page) UNION ALL SELECT doc, page, n, 'recovered' FROM more_tables WHERE doc = 'a' UNION ALL SELECT doc, page, n, 'filled' FROM more_tables)
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, n, source)::INTEGER AS place FROM u""", "page_grids", "more_tables", "scan_pages")
def u4_readings_together(spark, sf_dir):
    more = table(spark, "more_tables")
    return C.readings_together(table(spark, "page_grids"), more.where("doc = 'a'"), more, table(spark, "scan_pages"))


@query(" SELECT doc, page, 1 AS n, 'image page, not extracted' AS title FROM image_pages WHERE doc = 'a' AND has_image AND trim(coalesce(text, '')) = ''", "image_pages")
def y9_placeholders(spark, sf_dir):
    return C.placeholders(table(spark, "image_pages"), F.col("doc") == "a")


@query(""", g AS (SELECT doc, page, signal AS scope FROM page_tags WHERE signal IS NOT NULL) SELECT t.doc, t.page, t.n, coalesce(g.scope, 'unknown') AS scope FROM (SELECT doc, page, n FROM page_grids UNION ALL SELECT 'c', 1, 1) t LEFT JOIN g ON t.doc = g.doc AND t.page = g.page
  WHERE g.scope = 'STANDALONE' OR t.doc NOT IN (SELECT doc FROM g)""", "page_grids", "page_tags")
def y8_scoped(spark, sf_dir):
    tables = table(spark, "page_grids").select("doc", "page", "n").union(spark.createDataFrame([("c", 1, 1)], "doc string, page int, n int"))
    return C.scoped(tables, table(spark, "page_tags").withColumnRenamed("signal", "scope"), ("STANDALONE",))


@query(""" SELECT doc, bool_or(coalesce(region = 'CONSOLIDATED', false) OR regexp_matches(coalesce(text, ''), '(?i)consolidated\\s+balance sheet|forming part of the\\s+consolidated\\s+financial statements?')) AS has_consolidated, bool_or(region <> 'FRONT') AS has_standalone
  FROM (SELECT doc, page, coalesce(signal, 'FRONT') AS region, text FROM report_pages LEFT JOIN page_tags USING (doc, page)) GROUP BY doc""", "report_pages", "page_tags")
def y13_scopes_filed(spark, sf_dir):
    pages = table(spark, "report_pages").join(table(spark, "page_tags"), ["doc", "page"], "left").withColumn("region", F.coalesce("signal", F.lit("FRONT")))
    return C.scopes_filed(pages)


@query(" SELECT section, CASE WHEN section = 'deferred_tax' THEN aliases ELSE aliases[1:3] END AS aliases FROM shown_aliases", "shown_aliases")
def y26_examples(spark, sf_dir):
    return C.examples(table(spark, "shown_aliases"))


@query(""" SELECT a.doc, a.key, coalesce(a.value, f.value) AS value, a.value IS NULL AND f.value IS NOT NULL AS rescued FROM absent_values a LEFT JOIN (SELECT doc, key, min(value) AS value FROM rescued_values WHERE grounded AND value IS NOT NULL GROUP BY doc, key) f USING (doc, key)""", "absent_values", "rescued_values")
def r14_filled_absents(spark, sf_dir):
    return C.filled_absents(table(spark, "absent_values"), table(spark, "rescued_values"), ["doc"])


_PLAIN = _FIRST.format("translate(raw, '−–', '--')")
_VOTE = _FIRST.format("raw")


@query(f" SELECT id, CASE WHEN contains(raw, '(') AND contains(raw, ')') THEN -abs({_PLAIN}) ELSE {_PLAIN} END AS plain, CASE WHEN contains(raw, '(') AND contains(raw, ')') THEN -{_VOTE} ELSE {_VOTE} END AS vote FROM printed", "printed")
def n3_n5_number_parsers(spark, sf_dir):
    return table(spark, "printed").select("id", N.plain_statement_number(F.col("raw")).alias("plain"), N.vote_number(F.col("raw")).alias("vote"))


@query(""", k AS (SELECT key, CASE WHEN starts_with(lower(key), 'gross') THEN 'gross' WHEN starts_with(lower(key), 'accumulated') THEN 'dep' END AS block, list_filter(['office equip', 'furnitur', 'vehicle', 'building', 'plant', 'land', 'computer'], lambda w: contains(string_split(lower(key), '_')[-1], w))[1] AS stem FROM asset_keys)
  SELECT key, CASE WHEN stem IS NOT NULL THEN block END AS block, CASE WHEN block IS NOT NULL THEN stem END AS stem FROM k""", "asset_keys")
def x12_asset_targets(spark, sf_dir):
    t = S.asset_target(F.col("key"))
    return table(spark, "asset_keys").select("key", t.block.alias("block"), t.stem.alias("stem"))


@query(" SELECT coalesce(company, 'TOTAL') AS company, CASE WHEN company IS NOT NULL THEN scope END AS scope, count(*) AS n, count(*) FILTER (found) AS found FROM facts GROUP BY GROUPING SETS ((company, scope), ())", "facts")
def a11_rollup_by_section(spark, sf_dir):
    return P.rollup_all(table(spark, "facts"), ["company", "scope"], n=F.count("*"), found=F.count(F.when(F.col("found"), 1)))
