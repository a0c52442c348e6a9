"""Queries of the operators on words with coordinates, and of joins, fills and unions that the other modules leave."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import numbers as N
from ..operators import geometry as G, matching as M, ordered as O, regions as A, retrieval as T, verify as V
from .fixtures import table
from .queries import _parsed
from .registry import query


@query(" SELECT doc, page, round_even(y0 / 4, 0)::INTEGER AS line_no, string_agg(word, ' ' ORDER BY x0, word) AS line FROM words GROUP BY ALL", "words")
def s5_rebuilt_lines(spark, sf_dir):
    return G.rebuilt_lines(table(spark, "words"))


@query("")
def w9_word_rows(spark, sf_dir):
    return G.word_rows(table(spark, "words"))


# In these small tables words of a row are in one band of 15 points.
_BANDS = ", r AS (SELECT *, floor((y0 + y1) / 30)::BIGINT AS row FROM words), s AS (SELECT *, sum(coalesce((x0 - p > 8)::INT, 0)) OVER (PARTITION BY doc, page, row ORDER BY x0, x1, word)::BIGINT AS segment FROM (SELECT *, lag(x1) OVER (PARTITION BY doc, page, row ORDER BY x0, x1, word) AS p FROM r)) "


@query(_BANDS + "SELECT doc, page, row, segment, arg_min(x0, (x0, x1, word)) AS x0, arg_max(x1, (x0, x1, word)) AS x1, min(y0) AS y0, max(y1) AS y1, string_agg(word, ' ' ORDER BY x0, x1, word) AS txt FROM s GROUP BY doc, page, row, segment", "words")
def w10_row_segments(spark, sf_dir):
    return G.row_segments(table(spark, "words").withColumn("row", F.floor((F.col("y0") + F.col("y1")) / 30)))


@query(_BANDS + """, n AS (SELECT doc, page, row, min(y0) AS y0, max(y1) AS y1, count(DISTINCT segment) AS n FROM s GROUP BY doc, page, row), g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc, page ORDER BY row) AS gap, count(*) OVER (PARTITION BY doc, page) AS k FROM n),
  m AS (SELECT doc, page, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY doc, page) SELECT doc, page, row, sum(coalesce((k >= 4 AND gap > greatest(14.0, 2.5 * greatest(l[len(l) // 2 + 1], 1.0)))::INT, 0)) OVER (PARTITION BY doc, page ORDER BY row)::BIGINT AS part FROM g JOIN m USING (doc, page)""", "words")
def w11_vertical_parts(spark, sf_dir):
    rows = table(spark, "words").groupBy("doc", "page", F.floor((F.col("y0") + F.col("y1")) / 30).alias("row")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return G.vertical_parts(rows).select("doc", "page", "row", "part")


@query("""SELECT l_orderkey AS doc, 1 AS page, min(l_linenumber) AS first, max(l_linenumber) AS last, block FROM (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS block FROM (
  SELECT *, coalesce((l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 > 1)::INT, 0) AS s FROM lineitem WHERE l_quantity >= 20)) GROUP BY l_orderkey, block HAVING count(*) >= 2""")
def w12_table_blocks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").alias("row"), F.when(F.col("l_quantity") >= 20, 2).otherwise(1).alias("n_segments"))
    return G.table_blocks(rows, singles=1)


@query("")
def r16_page_grids(spark, sf_dir):
    return G.page_grids(table(spark, "words"))


@query("")
def r16_region_tables(spark, sf_dir):
    margins = spark.createDataFrame([("a", 1, "Statement of Reserves"), ("a", 1, "Annual Report of the whole company"), ("a", 1, " ")], "doc string, page int, text string")
    return A.region_tables(table(spark, "words"), margins)


@query("")
def j14_consensus(spark, sf_dir):
    grids = table(spark, "page_grids")
    return G.consensus(grids, grids.where("n < 3"))


@query(f""", o AS (SELECT company, scope, key, value FROM prior) SELECT t.company, t.scope, t.key, coalesce(o.value, t.expected) AS expected, f.value, {_parsed('coalesce(o.value, t.expected)')} AS want FROM truth t LEFT JOIN o USING (company, scope, key)
  LEFT JOIN (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY company, scope, key ORDER BY ord DESC) = 1) f ON t.company = f.company AND t.scope = f.scope AND t.key = f.key""", "truth", "prior", "facts")
def j1_truth_with_overlay(spark, sf_dir):
    keys = ["company", "scope", "key"]
    truth = M.overlay(table(spark, "truth"), table(spark, "prior"), keys, "expected", "value")
    return truth.join(M.last_per_key(table(spark, "facts"), keys, "ord").select(*keys, "value"), keys, "left").select(*keys, "expected", "value", N.parse_number(F.col("expected")).alias("want"))


@query(""", l AS (SELECT doc, page, coalesce(signal, 'FRONT') AS region, CASE coalesce(signal, 'FRONT') WHEN 'CONSOLIDATED' THEN 0 WHEN 'FRONT' THEN 2 ELSE 1 END AS level FROM page_tags) SELECT doc, page, region FROM l QUALIFY level <= min(level) OVER (PARTITION BY doc)""", "page_tags")
def f1_scope_fallback(spark, sf_dir):
    return T.scope_fallback(table(spark, "page_tags").select("doc", "page", F.coalesce("signal", F.lit("FRONT")).alias("region")), "doc", "region", ["CONSOLIDATED"])


@query(" SELECT doc, arg_max(year, (n, year)) AS year FROM (SELECT doc, year, count(*) AS n FROM proposals WHERE year IS NOT NULL GROUP BY doc, year) GROUP BY doc", "proposals")
def a6_mode_of_years(spark, sf_dir):
    n = table(spark, "proposals").where("year is not null").groupBy("doc", "year").agg(F.count("*").alias("n"))
    return n.groupBy("doc").agg(F.max_by("year", F.struct("n", "year")).alias("year"))


@query(" SELECT doc, item, min(ord) AS ord FROM proposals GROUP BY doc, item", "proposals")
def u3_ordered_union(spark, sf_dir):
    p = table(spark, "proposals")
    return p.where("ord <= 2").unionByName(p.where("ord > 1")).groupBy("doc", "item").agg(F.min("ord").alias("ord"))


@query("""SELECT user_id, event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM events""")
def w14_context(spark, sf_dir):
    return O.context(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 2, 2).drop("event_type")


@query("""SELECT a.o_custkey, len(list_intersect(a.p, b.p))::INTEGER AS shared, len(list_distinct(list_concat(a.p, b.p)))::INTEGER AS every FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey) a
  JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_totalprice <= 150000 GROUP BY o_custkey) b USING (o_custkey)""")
def u2_set_overlap(spark, sf_dir):
    big = F.col("o_totalprice") > 150000
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.collect_set(F.when(big, F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(~big, F.col("o_orderpriority"))).alias("b"))
    return o.where("size(a) > 0 and size(b) > 0").select("o_custkey", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("every"))


@query(" SELECT id, coalesce(length(d) >= 2 AND contains(regexp_replace(line, '\\D', '', 'g'), d), false) AS grounded FROM (SELECT id, regexp_replace(value, '\\D', '', 'g') AS d, evidence AS line FROM read_values)", "read_values")
def g3_rescue_grounding(spark, sf_dir):
    return table(spark, "read_values").select("id", V.grounded(F.col("value"), F.col("evidence"), 2).alias("grounded"))


@query(""", l AS (SELECT *, (line LIKE '%total%' OR line LIKE '%Total%') AS t FROM tax_lines) SELECT page, line_no, first_value(CASE WHEN t THEN line END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM l""", "tax_lines")
def w13_total_below(spark, sf_dir):
    total = F.when(F.col("line").contains("total") | F.col("line").contains("Total"), F.col("line"))
    return O.backward_fill(table(spark, "tax_lines"), ["page"], "line_no", total, "below").select("page", "line_no", "below")


@query(""", o AS (SELECT doc, page, n, title, row_number() OVER (ORDER BY CASE WHEN section = '' THEN 0 ELSE 1 END, section, title, doc, page, n)::INTEGER AS place FROM found_tables) SELECT * FROM o WHERE place <= 5""", "found_tables")
def o11_first_faults(spark, sf_dir):
    order = [F.when(F.col("section") == "", 0).otherwise(1), F.col("section"), F.col("title"), F.col("doc"), F.col("page"), F.col("n")]
    top = table(spark, "found_tables").orderBy(*order).limit(5)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select("doc", "page", "n", "title", "place")
