"""Registered queries of the engine's own operators: over the driver's tables where they have the data, else over small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers as N, text as T
from ..operators import matching as M, ordered as O, reports as P, retrieval as R, verify as V
from ..sources import files
from ..streaming.sessions import sessions
from .fixtures import table
from .registry import documents as _docs, query as _query

# Numbers and text

_NIL = "lower(trim(raw)) IN ('', 'not disclosed', 'na', 'n/a', 'nil', 'none', '-', '–', '—', '--')"
_FIRST = "TRY_CAST(replace(nullif(regexp_extract(replace({0}, ' ', ''), '-?\\d[\\d,]*\\.?\\d*'), ''), ',', '') AS DOUBLE)"


def _parsed(c: str) -> str:
    v = _FIRST.format(f"regexp_replace(trim({c}), '₹|`|Rs|rs', '', 'g')")
    return f"CASE WHEN {_NIL.replace('raw', c)} THEN NULL WHEN contains({c}, '(') AND contains({c}, ')') THEN -{v} ELSE {v} END"


def _stated(c: str) -> str:
    v = _FIRST.format(f"translate({c}, '−–—', '---')")
    return f"CASE WHEN contains({c}, '(') AND contains({c}, ')') THEN -abs({v}) ELSE {v} END"


@_query(f"SELECT id, {_parsed('raw')} AS parsed, {_stated('raw')} AS stated, regexp_replace(raw, '\\D', '', 'g') AS digits, regexp_replace(regexp_replace(raw, '[^\\d.]', '', 'g'), '^\\.+|\\.+$', '', 'g') AS money FROM printed", "printed")
def n1_number_parsers(spark, sf_dir):
    raw = F.col("raw")
    return table(spark, "printed").select("id", N.parse_number(raw).alias("parsed"), N.statement_number(raw).alias("stated"), N.digits(raw).alias("digits"), N.money_token(raw).alias("money"))


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(x - round_even(x, 0)) < 0.005 THEN format('{:,.0f}', round_even(x, 0))
  WHEN abs(x * 10 - round_even(x * 10, 0)) < 0.05 THEN format('{:,.1f}', x) ELSE format('{:,.2f}', x) END AS printed
  FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem)""")
def n10_format_number(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", N.format_number(F.col("l_extendedprice")).alias("printed"))


@_query("""SELECT o_orderkey, (a = b OR abs(a - b) / greatest(abs(a), abs(b), 1.0) <= 0.01) AS close_1pct,
  CASE WHEN a = 0 OR b = 0 THEN NULL WHEN abs(abs(a)/abs(b) - 10.0) / greatest(abs(a)/abs(b), 10.0) <= 0.02 THEN 10.0 WHEN abs(abs(a)/abs(b) - 100.0) / greatest(abs(a)/abs(b), 100.0) <= 0.02 THEN 100.0
  WHEN abs(abs(a)/abs(b) - 1000.0) / greatest(abs(a)/abs(b), 1000.0) <= 0.02 THEN 1000.0 WHEN abs(abs(a)/abs(b) - 0.1) / greatest(abs(a)/abs(b), 1.0) <= 0.02 THEN 0.1
  WHEN abs(abs(a)/abs(b) - 0.01) / greatest(abs(a)/abs(b), 1.0) <= 0.02 THEN 0.01 WHEN abs(abs(a)/abs(b) - 0.001) / greatest(abs(a)/abs(b), 1.0) <= 0.02 THEN 0.001 END::DOUBLE AS factor
  FROM (SELECT o_orderkey, o_totalprice AS a, c_acctbal AS b FROM orders JOIN customer ON o_custkey = c_custkey)""")
def n11_tolerances(spark, sf_dir):
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    a, b = F.col("o_totalprice"), F.col("c_acctbal")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", N.close(a, b).alias("close_1pct"), N.scale_factor(a, b).alias("factor"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9&/\\-]*'), lambda w: length(w) > 1 AND w NOT IN ({_STOPS}))"


@_query(f"SELECT doc_id AS page, len({_TERMS})::INTEGER AS n_terms, length(regexp_replace(lower(text), '\\s+', '', 'g'))::INTEGER AS n_collapsed, least(len(regexp_extract_all(text, '\\d[\\d,]*\\.?\\d+')) / 25.0::DOUBLE, 3.0::DOUBLE) AS density FROM documents")
def t1_tokens(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("page", F.size(T.tokens(t)).alias("n_terms"), F.length(T.collapse(t)).alias("n_collapsed"), R.numeric_density(t).alias("density"))


_ROUTE = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{s}'" for w, s in T.ROUTES) + f" ELSE '{T.DEFAULT_ROUTE}' END"


@_query(f"SELECT key, scope, {_ROUTE} AS section FROM (SELECT key, unnest(CASE scope WHEN 'both' THEN ['standalone', 'consolidated'] ELSE [scope] END) AS scope, lower(key || ' ' || coalesce(hint, '')) AS t FROM concepts)", "concepts")
def f21_routes(spark, sf_dir):
    scope = F.explode(F.when(F.col("scope") == "both", F.array(F.lit("standalone"), F.lit("consolidated"))).otherwise(F.array("scope")))
    return table(spark, "concepts").select("key", scope.alias("scope"), T.route(F.col("key"), F.col("hint")).alias("section"))


@_query(r"""SELECT doc, coalesce(max(CASE WHEN n >= 2 THEN y END), max(y), 0)::INTEGER AS year FROM (
  SELECT doc, y, count(y) AS n FROM (SELECT DISTINCT doc FROM year_lines) LEFT JOIN (SELECT doc, unnest(regexp_extract_all(txt, '\b(20\d{2})\b', 1))::INTEGER AS y FROM year_lines) USING (doc) GROUP BY ALL) GROUP BY doc""", "year_lines")
def a5_repeated_year(spark, sf_dir):
    joined = table(spark, "year_lines").groupBy("doc").agg(F.concat_ws("\n", F.collect_list("txt")).alias("txt"))
    return joined.select("doc", T.repeated_max_year(F.col("txt")).alias("year"))


# Retrieval

@_query(f"""SELECT 'q' AS query, doc, page, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page)::INTEGER AS rank FROM (
  SELECT doc, page, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM (
    SELECT *, count(*) OVER (PARTITION BY doc, term) AS df FROM (SELECT doc, page, len, term, count(*) AS tf FROM (SELECT source AS doc, doc_id AS page, len({_TERMS}) AS len, unnest({_TERMS}) AS term FROM documents) WHERE term IN ('license', 'released', 'apache') GROUP BY ALL))
  JOIN (SELECT source AS doc, count(*) AS n, avg(len({_TERMS})) AS mean FROM documents GROUP BY source) USING (doc)
  JOIN (VALUES ('license', 2), ('released', 1), ('apache', 1)) AS q(term, times) USING (term) GROUP BY doc, page)) WHERE rank <= 10""")
def t2_bm25(spark, sf_dir):
    terms = spark.createDataFrame([("q", t) for t in ("license", "released", "apache", "license")], "query string, term string")
    return R.bm25(_docs(spark, sf_dir), terms)


@_query("""SELECT source AS doc, doc_id AS page, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INTEGER AS rank FROM (
  SELECT *, (a + h * 0.6::DOUBLE + least(len(regexp_extract_all(text, '\\d[\\d,]*\\.?\\d+')) / 25.0::DOUBLE, 3.0::DOUBLE)) AS score FROM (
    SELECT *, contains(t, 'mit license')::INT + contains(t, 'gnu and co')::INT + contains(t, 'version')::INT AS a, contains(t, 'general')::INT + contains(t, 'public')::INT AS h FROM (
      SELECT *, trim(regexp_replace(replace(lower(text), '&', ' and '), '\\s+', ' ', 'g')) AS t FROM documents)) WHERE a > 0 OR h >= 2) QUALIFY rank <= 5""")
def t3_alias_locate(spark, sf_dir):
    score = R.alias_score(F.col("text"), F.array(F.lit("MIT License"), F.lit("GNU & Co"), F.lit("version")), F.lit("general public note"), F.lit(None).cast("string"))
    scored = _docs(spark, sf_dir).withColumn("score", score).where("score is not null").drop("text")
    return R.top_k(scored, ["doc"], [F.desc("score"), F.col("page")], 5)


# Order

@_query("""SELECT doc, page, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING), 'STANDALONE') AS region,
  first_value(signal IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM page_tags""", "page_tags")
def w1_forward_fill(spark, sf_dir):
    filled = O.forward_fill(table(spark, "page_tags"), ["doc"], "page", F.col("signal"), "STANDALONE", "region")
    return O.backward_fill(filled, ["doc"], "page", F.col("signal"), "ahead").drop("signal")


@_query("""SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (
  SELECT user_id, event_id, event_type, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS s FROM events)) GROUP BY user_id, event_type, island""")
def w4_spans(spark, sf_dir):
    return O.spans(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@_query("""SELECT o_custkey, o_orderkey, coalesce(sum((gap > 1000)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0)::BIGINT AS cluster FROM (
  SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders)""")
def w5_clusters(spark, sf_dir):
    return O.clusters(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 1000)


@_query("""SELECT DISTINCT doc, unnest(range(greatest(page - 1, 1), least(page + 1, 6) + 1))::INTEGER AS page FROM page_tags WHERE signal IS NOT NULL AND page <= 6""", "page_tags")
def w15_page_windows(spark, sf_dir):
    return O.page_windows(table(spark, "page_tags").where("signal is not null and page <= 6"), "doc", "page", F.lit(6))


@_query("""SELECT o_custkey, item, row_number() OVER (PARTITION BY o_custkey ORDER BY r, side)::INTEGER AS place FROM (SELECT o_custkey, o_orderkey AS item, min_at.r AS r, min_at.side AS side FROM (
  SELECT o_custkey, o_orderkey, min({'r': r, 'side': side}) AS min_at FROM (
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, 0 AS side FROM orders
    UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 1 FROM orders) WHERE r <= 5 GROUP BY o_custkey, o_orderkey))""")
def w17_interleave(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("item"), "o_totalprice")
    return O.interleave(R.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("item")], 5), R.top_k(o, ["o_custkey"], [F.col("item")], 5), ["o_custkey"], "item", "rank")


# Joins

@_query("""SELECT page, item, (SELECT arg_max(heading, (hy, ord)) FROM headings h WHERE h.page = i.page AND hy <= y + 2 AND least(x1, hx1) - greatest(x0, hx0) > 0) AS heading FROM items i""", "items", "headings")
def j10_nearest_heading(spark, sf_dir):
    return M.nearest_above(table(spark, "items"), table(spark, "headings"), ["page"])


@_query("""SELECT page, segment, arg_max(col, s - col * 1e-9) AS col, max(s) AS share FROM (SELECT s.page, segment, c.col, greatest(0.0::DOUBLE, least(x1, e1) - greatest(x0, e0)) / (x1 - x0) AS s FROM segments s JOIN columns c USING (page)) GROUP BY page, segment""", "segments", "columns")
def j11_widest_overlap(spark, sf_dir):
    return M.widest_overlap(table(spark, "segments"), table(spark, "columns"), ["page"])


@_query("""SELECT page, a, b, gap FROM (SELECT page, a, b, abs(x - c) AS gap, row_number() OVER (PARTITION BY page, a ORDER BY abs(x - c), b) AS ra, row_number() OVER (PARTITION BY page, b ORDER BY abs(x - c), a) AS rb
  FROM marks JOIN centres USING (page) WHERE abs(x - c) <= 30) WHERE ra = 1 AND rb = 1""", "marks", "centres")
def j12_mutual_nearest(spark, sf_dir):
    return M.mutual_nearest(table(spark, "marks"), table(spark, "centres"), ["page"], 30.0)


@_query(r"""SELECT page, token FROM (SELECT page, unnest(string_split(line, ' ')) AS token FROM report_lines) t WHERE regexp_matches(token, '^\(?-?\d{1,3}(,\d{2,3})+(\.\d+)?\)?$|^\(?-?\d+\.\d+\)?$')
  AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.page = t.page AND trim(regexp_replace(c.cell, '[^\d.]', '', 'g'), '.') = trim(regexp_replace(token, '[^\d.]', '', 'g'), '.'))""", "report_lines", "cells")
def j13_uncaptured(spark, sf_dir):
    tokens = table(spark, "report_lines").select("page", F.explode(F.split("line", " ")).alias("token"))
    return M.uncaptured(tokens, table(spark, "cells"), "page", "token", "cell")


@_query("""SELECT item, id, opening, closing FROM moves a WHERE NOT EXISTS (SELECT 1 FROM moves b WHERE a.item = b.item AND a.id <> b.id AND abs(a.closing - b.opening) < greatest(abs(a.closing) * 0.005, 0.02))""", "moves")
def j15_latest_year(spark, sf_dir):
    return M.without_earlier_year(table(spark, "moves"), ["item"])


_ALIAS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z&/\\-]+'), lambda w: length(w) > 2 AND w NOT IN ('of','and','on','for','the','to','in','from','with','a','an','net')), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN w[:-2] ELSE w END))"


@_query(f"SELECT DISTINCT alias, page, line_no FROM aliases, report_lines WHERE len({_ALIAS.format('alias')}) > 0 AND list_has_all({_ALIAS.format('line')}, {_ALIAS.format('alias')})", "aliases", "report_lines")
def j7_contained_aliases(spark, sf_dir):
    return M.contained_aliases(table(spark, "aliases"), table(spark, "report_lines"), ["page", "line_no"])


@_query("""SELECT section, sum(l_extendedprice)::DOUBLE AS total, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (VALUES ('a', ['STEEL', 'PROMO']), ('b', ['BRASS'])) r(section, words)
  ON len(list_filter(words, lambda w: contains(p_type, w))) > 0 WHERE NOT contains(p_type, 'ECONOMY') GROUP BY section""")
def j6_keyword_totals(spark, sf_dir):
    l, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_extendedprice", "p_type")
    rules = spark.createDataFrame([("a", "STEEL"), ("a", "PROMO"), ("b", "BRASS"), ("a", "STEEL")], "section string, word string")
    return M.keyword_totals(rows, rules, F.col("p_type"), F.col("l_extendedprice"), exclude=("ECONOMY",)).drop("refs")


@_query(f""", v AS (SELECT *, {_stated('value')} AS v FROM parent_lines) SELECT section, sum(v) AS total, count(*) AS n, list_sort(list(note_ref) FILTER (note_ref IS NOT NULL)) AS refs FROM v JOIN (SELECT section, list(word) AS words FROM parent_rules GROUP BY section)
  ON len(list_filter(words, lambda w: contains(lower(label), w))) > 0 WHERE NOT contains(lower(label), 'profit') AND NOT contains(lower(label), 'earning') GROUP BY section""", "parent_lines", "parent_rules")
def j6_parent_values(spark, sf_dir):
    return M.keyword_totals(table(spark, "parent_lines"), table(spark, "parent_rules"), F.lower("label"), N.statement_number(F.col("value")), F.col("note_ref"), ("profit", "earning"))


# Verification

_V = {c: _stated(c) for c in ("total_a", "total_b", "pbt", "tax", "pat", "income", "expense", "op", "inv", "fin", "fx", "net", "opening", "closing")}


@_query(f"""SELECT id, coalesce(total_a <> 0 AND total_b <> 0 AND abs(total_a - total_b) < greatest(abs(total_a) * 0.005, 1.0), false) AS balance,
  CASE WHEN abs(pbt - tax - pat) < greatest(abs(pat) * 0.005, 2) THEN pat WHEN abs(income - expense - pbt) < greatest(abs(pbt) * 0.02, 5) THEN pbt END AS profit,
  CASE WHEN abs(op + inv + fin + coalesce(fx, 0) - net) < greatest(abs(net) * 0.02, 5) THEN net WHEN abs(opening + net + coalesce(fx, 0) - closing) < greatest(abs(closing) * 0.02, 5) THEN closing END AS cash
  FROM (SELECT id, {", ".join(f"{v} AS {c}" for c, v in _V.items())} FROM statements)""", "statements")
def v1_v3_tie_out(spark, sf_dir):
    v = {c: N.statement_number(F.col(c)) for c in _V}
    return table(spark, "statements").select(
        "id", V.balance_ties(v["total_a"], v["total_b"]).alias("balance"), V.profit_anchor(v["pbt"], v["tax"], v["pat"], v["income"], v["expense"]).alias("profit"),
        V.cash_anchor(v["op"], v["inv"], v["fin"], v["fx"], v["net"], v["opening"], v["closing"]).alias("cash"))


@_query("""SELECT note, "sum", total, parent, coalesce(abs("sum" - total) < greatest(abs(total) * 0.01, 1) AND abs(total - parent) < greatest(abs(parent) * 0.01, 1), false) AS reconciled
  FROM (SELECT note, sum(coalesce(value, 0)) AS "sum", any_value(total) AS total, any_value(parent) AS parent FROM components GROUP BY note)""", "components")
def v5_components(spark, sf_dir):
    return V.components_reconcile(table(spark, "components"), ["note"])


@_query("""SELECT id, CASE WHEN len(nums) < 2 OR len(nums) > 10 THEN false ELSE len(list_filter(range((2 ** greatest(len(nums) - 2, 0))::BIGINT), lambda m:
  abs(nums[1] + coalesce(list_sum(list_transform(range(greatest(len(nums) - 2, 0)), lambda i: nums[i + 2] * (1 - 2 * ((m >> i::INT) & 1)))), 0) - nums[-1]) < 0.02)) > 0 END AS closes,
  len(nums) BETWEEN 3 AND 8 AND abs(coalesce(list_sum(nums[:-2]), 0) - nums[-1]) < greatest(abs(nums[-1]) * 0.001, 0.6) AS identity FROM blocks""", "blocks")
def v7_v9_row_identities(spark, sf_dir):
    return table(spark, "blocks").select("id", V.block_closes(F.col("nums")).alias("closes"), V.row_identity(F.col("nums")).alias("identity"))


def _close(a: str, b: str) -> str:
    return f"({a} = {b} OR abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0) <= 0.01)"


_FACTOR = " OR ".join(f"abs(abs(got) / nullif(abs(want), 0) - {f}) / greatest(abs(got) / nullif(abs(want), 0), {f}, 1.0) <= 0.02" for f in ("10.0", "100.0", "1000.0", "0.1", "0.01", "0.001"))
_VERDICTS = f"""SELECT company, scope, key, CASE WHEN want IS NULL AND NOT has THEN 'CORRECTLY_ABSENT' WHEN want IS NULL THEN 'SPURIOUS' WHEN NOT has THEN 'MISS'
  WHEN {_close('got', 'want')} THEN 'MATCH' WHEN got <> 0 AND want <> 0 AND ({_FACTOR}) THEN 'SCALE_MISMATCH' ELSE 'TRUE_ERROR' END AS verdict
  FROM (SELECT t.company, t.scope, t.key, {_parsed('expected')} AS want, {_parsed('value')} AS got, coalesce(found, false) AND {_parsed('value')} IS NOT NULL AS has
    FROM truth t LEFT JOIN (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY company, scope, key ORDER BY ord DESC) = 1) f ON t.company = f.company AND t.scope = f.scope AND t.key = f.key)"""


def _verdicts(spark: SparkSession) -> DataFrame:
    keys = ["company", "scope", "key"]
    facts = M.last_per_key(table(spark, "facts"), keys, "ord")
    return table(spark, "truth").join(facts, keys, "left").select(*keys, V.verdict(F.col("value"), F.col("found"), F.col("expected")).alias("verdict"))


@_query(_VERDICTS, "truth", "facts")
def c1_verdicts(spark, sf_dir):
    return _verdicts(spark)


@_query(f"""SELECT coalesce(company, 'TOTAL') AS company, count(*) AS n, count(*) FILTER (verdict IN ('MATCH', 'CORRECTLY_ABSENT')) AS good, count(*) FILTER (verdict = 'TRUE_ERROR') AS errors FROM ({_VERDICTS}) GROUP BY ROLLUP (company)""", "truth", "facts")
def a11_rollup(spark, sf_dir):
    is_ = lambda *v: F.count(F.when(F.col("verdict").isin(*v), 1))
    return P.rollup(_verdicts(spark), "company", n=F.count("*"), good=is_("MATCH", "CORRECTLY_ABSENT"), errors=is_("TRUE_ERROR"))


@_query(f"""SELECT company, count(*) AS applicable, count(*) FILTER (verdict IN ('MATCH', 'CORRECTLY_ABSENT')) AS correct, count(*) FILTER (verdict IN ('MATCH', 'CORRECTLY_ABSENT')) * 100.0::DOUBLE / count(*) AS accuracy_pct FROM ({_VERDICTS}) GROUP BY company""", "truth", "facts")
def a1_accuracy(spark, sf_dir):
    return V.accuracy(_verdicts(spark), ["company"], "verdict")


@_query(f"""SELECT company, scope, key, CASE WHEN a IS NULL OR b IS NULL THEN 'INSUFFICIENT' WHEN {_close('a', 'b')} THEN 'VERIFIED' ELSE 'RESTATEMENT_OR_ERROR' END AS verdict
  FROM (SELECT f.company, f.scope, f.key, {_parsed('f.value_prior')} AS a, {_parsed('p.value')} AS b FROM facts f LEFT JOIN prior p ON f.company = p.company AND f.scope = p.scope AND f.key = p.key)""", "facts", "prior")
def c3_cross_year(spark, sf_dir):
    keys = ["company", "scope", "key"]
    prior = table(spark, "prior").select(*keys, F.col("value").alias("before"))
    return table(spark, "facts").join(prior, keys, "left").select(*keys, V.cross_year(F.col("value_prior"), F.col("before")).alias("verdict"))


@_query(f"""SELECT item, value, coalesce(votes, 0)::BIGINT AS votes, round_even(coalesce(votes, 0) / n, 2) AS confidence FROM (SELECT item, count(*)::DOUBLE AS n FROM reads GROUP BY item) LEFT JOIN (
  SELECT item, value, votes FROM (SELECT item, coalesce(round_even({_parsed('value')}, 4)::VARCHAR, lower(trim(coalesce(value, '')))) AS k, count(*) AS votes, min(n) AS first, arg_min(value, n) AS value FROM reads WHERE found GROUP BY item, k)
  QUALIFY row_number() OVER (PARTITION BY item ORDER BY votes DESC, first) = 1) USING (item)""", "reads")
def a3_majority(spark, sf_dir):
    return V.majority(table(spark, "reads"), ["item"], "value", "found", "n")


@_query("""SELECT l.doc_id, contains(regexp_replace(text, '\\D', '', 'g'), d) AND length(d) >= 3 AS grounded FROM documents l JOIN (SELECT doc_id, (doc_id * 37 % 1000)::VARCHAR AS d FROM documents) USING (doc_id)""")
def g2_grounding(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", V.grounded((F.col("doc_id") * 37 % 1000).cast("string"), F.col("text")).alias("grounded"))


@_query("""SELECT o_custkey, coalesce(min(r) FILTER (ok), min(r))::INTEGER AS rank, CASE WHEN bool_or(ok) THEN 'tie' ELSE 'no-tie' END AS status FROM (
  SELECT o_custkey, o_totalprice > 300000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey""")
def o7_first_tie(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ranked = o.select("o_custkey", (F.col("o_totalprice") > 300000).alias("ok"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    return V.first_tie(ranked, ["o_custkey"], "rank", "ok")


@_query("""SELECT l_orderkey, value FROM (SELECT l_orderkey, min(l_quantity) AS value, count(DISTINCT round_even(l_quantity, 2)) AS n FROM lineitem GROUP BY l_orderkey) WHERE n = 1""")
def v11_sole_value(spark, sf_dir):
    return V.sole_value(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_quantity").alias("value")), ["l_orderkey"], "value")


# Reports

_WIDE = ["Share Premium", "Hedging Reserve", "Other CWIP", "Equity Issued"]


@_query(""", f AS (SELECT company, scope, key, CASE WHEN company = 'bolt' AND key = 'Equity Issued' THEN 'N/A' WHEN found THEN coalesce(value, '') ELSE 'Not disclosed' END AS cell, 0 AS tier, ord FROM facts
  UNION ALL SELECT company, scope, key, value, 1, ord FROM verified v WHERE value IS NOT NULL AND EXISTS (SELECT 1 FROM facts f WHERE f.company = v.company AND f.scope = v.scope))
  SELECT company, scope, """ + ", ".join(f"""coalesce(arg_max(cell, (tier, ord, cell)) FILTER (key = '{k}'), '') AS "{k}\"""" for k in _WIDE) + """ FROM f GROUP BY company, scope""", "facts", "verified")
def r24_wide(spark, sf_dir):
    status = F.when((F.col("company") == "bolt") & (F.col("key") == "Equity Issued"), "not applicable")
    return P.wide(table(spark, "facts"), ["company", "scope"], "key", "value", _WIDE, "ord", F.col("found"), status, table(spark, "verified"))


@_query("""SELECT o_custkey, max(y)::INTEGER AS year, 'FY' || (max(y) - 1) || '-' || lpad((max(y) % 100)::VARCHAR, 2, '0') AS label FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_custkey, year(o_orderdate)
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) <= 2) GROUP BY o_custkey""")
def a4_fiscal_year(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"))
    return P.fiscal_year(o, ["o_custkey"], "year", "o_orderkey")


@_query("""SELECT doc, page, n, title, CASE WHEN k = 1 THEN name ELSE rtrim(substr(name, 1, 31 - length(' (' || k || ')'))) || ' (' || k || ')' END AS sheet FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY doc, page, n, title) AS k FROM (SELECT *, rtrim(substr(CASE WHEN lab <> '' THEN 'p' || page || '_' || n || ' ' || lab ELSE 'p' || page || '_' || n END, 1, 31)) AS name FROM (
    SELECT *, trim(regexp_replace(coalesce(nullif(section, ''), title), '[][:*?/\\\\'']', ' ', 'g')) AS lab FROM found_tables)))""", "found_tables")
def k4_sheet_names(spark, sf_dir):
    return P.sheet_names(table(spark, "found_tables"), ["doc", "page", "n", "title"]).select("doc", "page", "n", "title", "sheet")


@_query("""SELECT doc, page, n, title, sum(new) OVER (PARTITION BY doc ORDER BY ord, title ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM (
  SELECT *, 1 - coalesce((s <> '' AND scope = lag(scope) OVER w AND s = lag(s) OVER w AND page - lag(page) OVER w <= 1)::INT, 0) AS new FROM (
    SELECT *, lower(trim(section)) AS s, page * 100 + n AS ord FROM found_tables) WINDOW w AS (PARTITION BY doc ORDER BY ord, title))""", "found_tables")
def w7_section_groups(spark, sf_dir):
    t = table(spark, "found_tables").withColumn("ord", F.expr("page * 100 + n"))
    return P.section_groups(t, ["doc"], ["ord", "title"]).select("doc", "page", "n", "title", "group_no")


# Sources, streams

@_query(r""", l AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM report_lines), r AS (SELECT *, starts_with(t, '|') AND ends_with(t, '|') AS row FROM l), m AS (SELECT *, (row AND NOT coalesce(lag(row) OVER w, false))::INT AS s,
  CASE WHEN t <> '' AND NOT starts_with(t, '|') THEN regexp_replace(regexp_replace(t, '^[#* ]+', ''), '[*: ]+$', '') END AS said FROM r WINDOW w AS (PARTITION BY page ORDER BY line_no)),
  n AS (SELECT *, coalesce(last_value(said IGNORE NULLS) OVER w, '') AS heading, (sum(s) OVER w)::BIGINT AS table_no, list_transform(string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|'), lambda x: trim(regexp_replace(trim(x), '^\*+|\*+$', '', 'g'))) AS cells
    FROM m WINDOW w AS (PARTITION BY page ORDER BY line_no ROWS UNBOUNDED PRECEDING)), k AS (SELECT * FROM n WHERE row AND len(list_filter(cells, lambda c: NOT regexp_matches(c, '^[-: ]*$'))) > 0)
  SELECT page, line_no, heading, table_no, cells FROM k QUALIFY count(*) OVER (PARTITION BY page, table_no) >= 2 AND first_value(len(cells)) OVER (PARTITION BY page, table_no ORDER BY line_no) >= 2""", "report_lines")
def s11_markdown_tables(spark, sf_dir):
    return files.markdown_rows(table(spark, "report_lines"), ["page"])


@_query(r"""SELECT source AS doc, doc_id AS page, (unnest(range(len(string_split_regex(text, '\r?\n')))))::INTEGER AS line_no, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents""")
def s12_lines(spark, sf_dir):
    return R.lines(_docs(spark, sf_dir), ["doc", "page"])


@_query("""SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, sum(value) AS value FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true))::INT AS s FROM events)) GROUP BY user_id, g""")
def x_sessions(spark, sf_dir):
    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
