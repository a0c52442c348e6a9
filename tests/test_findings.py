"""One small test for each finding of round 3 that was mended; each failed before."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import matching as M, retrieval as RT, rounds as R, verify as V


def test_all_pages_with_a_term_are_found(spark):
    pages = spark.range(1100).select(F.lit("a").alias("doc"), F.col("id").alias("page"), F.lit("loans given").alias("text"))
    terms = spark.createDataFrame([("q", "loans")], "query string, term string")
    assert RT.bm25(pages, terms, k=None).count() == 1100 and RT.bm25(pages, terms).count() == 10


def test_section_pages_are_not_cut(spark, monkeypatch):
    from factloom import plans as own
    from factloom.plans import proven_queries as Q

    pages = spark.range(1100).select(F.lit("a").alias("doc"), F.col("id").alias("page"), F.when(F.col("id") > 0, "loans standalone").alias("text"))
    monkeypatch.setattr(Q, "table", lambda spark, name: pages)
    got = own.queries()["t12_section_pages"](spark, "").groupBy("query").count().collect()
    assert got and {r["count"] for r in got} == {1099}


def test_signs_at_the_tolerance_are_those_of_adding_up(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(400):
        moves = [round(rnd.uniform(900, 90000), 2) for _ in range(4)]
        opening, signs = round(rnd.uniform(900, 90000), 2), [rnd.choice([1, -1]) for _ in moves]
        rows.append((opening, moves, round(opening + sum(s * m for s, m in zip(signs, moves)) + rnd.choice([50, -50]), 2)))
    rows += [(0.0, [1.0] * 17, 17.0)]

    def closes(o, m, c):
        sums = [0.0]
        for x in m:
            sums = [s + x for s in sums] + [s - x for s in sums]
        return any(abs(o + s - c) < 50.0 for s in sums)

    got = [r[0] for r in spark.createDataFrame(rows, "o double, m array<double>, c double").select(V.signs_close(F.col("o"), F.col("m"), F.col("c"), 50.0, most=40)).collect()]
    assert got == [closes(*r) for r in rows] and 0 < sum(got) < len(rows)


def test_unchained_rows_whose_sums_come_out_otherwise(spark):
    noisy = F.udf(lambda c: c + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.createDataFrame([("a", i, 100.0 * i, 100.0 * (i + 1)) for i in range(1, 40)], "g string, id int, opening double, closing double")
    assert [r.id for r in R.unchained(df.withColumn("closing", noisy("closing")), ["g"]).collect()] == [39]
    odd = [("a", None, 1.0, 5.0), ("a", 1, 5.0, float("inf")), ("a", 2, float("nan"), 0.0), ("a", 3, float("inf"), float("nan"))]
    assert R.unchained(spark.createDataFrame(odd, df.schema), ["g"]).count() == 4


def test_one_large_group_is_chained_without_pairs(spark):
    df = spark.range(60_000).select(F.lit("a").alias("item"), F.col("id"), (F.col("id") * 1e3).alias("opening"), (F.col("id") * 1e3 + 400).alias("closing"))
    text = M.without_earlier_year(df, ["item"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "hashpartitioning(coalesce(item" in text and "bucket" in text


def test_values_are_worked_out_once(spark):
    """As plain expressions a line's parts were worked out again at each place that used them: hundreds of patterns for a line."""
    from factloom.functions import values as X
    from factloom.operators import pages as P

    patterns = lambda c: str(spark.range(1).select(F.col("id").cast("string").alias("s")).select(c)._jdf.queryExecution().optimizedPlan()).count("regexp_")
    assert patterns(X.face_row(F.col("s"))) <= 45 and patterns(X.hygiene(F.col("s"), F.col("s"), F.lit(False))) <= 20
    assert patterns(P.marks(F.col("s"))) <= 6 and patterns(P.scope_anchor(F.col("s"))) <= 20


def test_fills_from_below_are_not_quadratic(spark):
    from factloom.operators import ordered as O

    df = spark.range(300).select(F.lit("a").alias("doc"), F.col("id").alias("page"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("signal"))
    filled = O.backward_fill(df, ["doc"], "page", F.col("signal"), "ahead")
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
    assert all(r.ahead == next((p for p in range(r.page, 300) if p % 7 == 3), None) for r in filled.collect())


def test_fullest_window_reads_answers_once(spark):
    from factloom.operators import statements as S

    df = spark.createDataFrame([("a", 1, '[{"key": "x", "present": true, "value": "10"}]'), (None, 1, "[]"), ("a", 2, '[{"key": "x", "present": true, "value": "1"}, {"key": "y", "present": true, "value": "2"}]')], "doc string, window int, payload string")
    got = S.fullest_window(df)
    assert sorted((r.window, r.key) for r in got.collect()) == [(2, "x"), (2, "y")]
    assert str(got._jdf.queryExecution().optimizedPlan()).count("from_json") == 1


def test_pages_of_words_are_read_in_streams(spark):
    """A call for each page cost more than its reading."""
    from factloom.operators import geometry as G, regions as A

    words = spark.createDataFrame([(d, p, 90.0 * x, 20.0 * y, 90.0 * x + 30, 20.0 * y + 8, f"{p},{x}{y}") for d in ("a", None) for p in range(60) for x in range(3) for y in range(5)], "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string").repartition(7)
    rows, grids = G.word_rows(words), G.page_grids(words)
    tables = A.region_tables(words, spark.createDataFrame([], "doc string, page int, text string"))
    for df in (rows, grids, tables):
        text = df._jdf.queryExecution().toString()
        assert "MapInArrow" in text and "FlatMapGroups" not in text
    assert all(r.row == round(r.y0 / 20) for r in rows.collect()) and rows.count() == 2 * 60 * 15
    want = {(d, p): [[f"{p},{x}{y}" for x in range(3)] for y in range(5)] for d in ("a", None) for p in range(60)}
    assert {(r.doc, r.page): r.grid for r in grids.collect()} == want == {(r.doc, r.page): r.grid for r in tables.collect()}


@pytest.mark.parametrize("whole", [1_000_000, 50])
def test_headings_above_with_few_steps(spark, monkeypatch, whole):
    from factloom.operators import intervals as I, lineage as L

    monkeypatch.setattr(L, "WHOLE", whole)
    rnd = random.Random(5)
    items = [(rnd.choice(["hot", "hot", "b", None]), i, float(rnd.randint(0, 30)), x := rnd.randint(0, 60), x + rnd.randint(1, 11)) for i in range(300)]
    df = spark.createDataFrame(items, "page string, item int, y double, x0 int, x1 int")
    heads = df.where("item % 3 = 0").selectExpr("page", "item AS ord", "y AS hy", "x0 AS hx0", "x1 AS hx1", "concat('h', item) AS heading")
    got = I.nearest_above(df, heads, ["page"])
    want = {(p, i): max(((hy, o) for q, o, hy, a, b in items if o % 3 == 0 and q == p and hy <= y and a < x1 and x0 < b), default=(0, None))[1] for p, i, y, x0, x1 in items}
    assert {(r.page, r.item): r.heading and int(r.heading[1:]) for r in got.collect()} == want
    assert "bin(" in str(spark.range(1).select(I._parts(F.col("id"), F.col("id") + 11))._jdf.queryExecution().optimizedPlan())


def test_aliases_are_looked_up_by_their_rarest_word(spark):
    aliases = spark.createDataFrame([(f"common word{i}",) for i in range(300)] + [("common",), ("of the",), (None,), ("common nowhere",), ("Word7s common",)], "alias string")
    lines = spark.createDataFrame([(i % 150, f"common text word{i % 40} {i}") for i in range(600)] + [(None, "common"), (1, None)], "page int, line string")
    df = aliases.select(F.translate("alias", "0123456789", "abcdefghij").alias("alias"))
    seen = lines.select("page", F.translate("line", "0123456789", "abcdefghij").alias("line"))
    got = {tuple(r) for r in M.contained_aliases(df, seen, ["page"]).collect()}
    stem = lambda w: w[:-1] if len(w) > 3 and w.endswith("s") else w
    words = lambda s: {stem(w) for w in s.lower().split() if len(w) > 2 and w not in ("the", "of")}
    want = {(a.alias, r.page) for a in df.collect() if a.alias and words(a.alias) for r in seen.collect() if r.line and words(a.alias) <= words(r.line)}
    assert got == want and len(want) > 100
    assert "min_by" in M.contained_aliases(df, seen, ["page"])._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_texts_are_found_by_a_table(spark):
    """Keys that no needle has are left out where texts are read: every run of a text was written and met a join."""
    import pyarrow as pa

    from factloom.operators import containment as C

    texts = ["ab cd😀ef", "", None, "a", "x cd😀e y cd😀e", "abcd"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["page", "key"])
    asked = ["w:cd😀e", "w:a", "4:d😀ef", "3:abc", "3:cd😀", "2:zz"]
    read = lambda *known: sorted((r["page"], r["key"]) for b in C.text_keys(["2", "3", "4", "w"], *known)([batch]) for r in b.to_pylist())
    got = read(asked)
    assert got == [(0, "3:cd😀"), (0, "4:d😀ef"), (3, "w:a"), (4, "3:cd😀"), (4, "w:cd😀e"), (5, "3:abc")]
    assert got == [r for r in read() if r[1] in asked]
    needles = spark.createDataFrame([("cd😀ef",), ("😀e y c",), ("d😀",), ("b cd",), ("nowhere",)], "alias string")
    pages = spark.createDataFrame(list(enumerate(texts)), "page int, text string")
    found = {tuple(r) for r in C.contained_phrases(needles, pages, ["page"]).collect()}
    assert found == {(n.alias, i) for n in needles.collect() for i, t in enumerate(texts) if t and n.alias in t}


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_alike_sets_without_a_join_by_tokens(spark, monkeypatch, share):
    """Pairs met once for each token of their first ones; no join by tokens may be left, and blocks and rare tokens give the same."""
    from factloom.operators import rounds as R

    rnd = random.Random(3)
    sides = {n: {i: {rnd.choice("abcdefghijklmnop") + str(rnd.choice((0, 0, 0, i % 7))) for _ in range(rnd.randint(1, 9))} | {f"{n}{i}"} for i in range(60)} for n in "ab"}
    sides["b"][7] = sides["a"][3]
    a, b = (spark.createDataFrame([(i, t) for i, ts in sides[n].items() for t in ts] * 2 + [(1, None), (None, "a0")], f"{n} long, token string") for n in "ab")
    want = {(i, j): len(x & y) / len(x | y) for i, x in sides["a"].items() for j, y in sides["b"].items() if x & y and len(x & y) / len(x | y) >= share}
    for block, rare in ((2000, 500), (25, 4)):
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "RARE", rare)
        rows = R.similar_sets(a, b, share).collect()
        assert len(rows) == len(want) and {(r.a, r.b): r.score for r in rows} == want
    assert "CoGroupsInArrow" in R.similar_sets(a, b, share)._jdf.queryExecution().toString()


def test_table_rows_are_sorted_once(spark):
    """Rows with their cells were sorted a second time by table, beside the first sort in the same task."""
    from factloom.sources import files

    pages = {1: ["# A:", "|a|b|", "|---|---|", "|1|2|", "x", "|only|one|", "**B**", "|c|", "|d|e|", "", "|f|g|", "|h|"], None: ["|a|b|", "|c|d|"], 2: ["|-|-|", "|k|l|", None, "|m|n|"]}
    df = files.markdown_rows(spark.createDataFrame([(p, i, t) for p, ts in pages.items() for i, t in enumerate(ts)], "page int, line_no int, line string"), ["page"])
    got = {(r.page, r.line_no, r.heading, r.table_no, tuple(r.cells)) for r in df.collect()}
    assert got == {(1, 1, "A", 1, ("a", "b")), (1, 3, "A", 1, ("1", "2")), (1, 10, "B", 4, ("f", "g")), (1, 11, "B", 4, ("h",)), (None, 0, "", 1, ("a", "b")), (None, 1, "", 1, ("c", "d"))}
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1


def test_pairs_of_one_report_are_many_tasks(spark):
    """All pages of a report met all its questions in one task."""
    from factloom.operators import comparison as B

    text = F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, "Total assets and profit").otherwise("the weather"))
    questions = spark.range(6000).select(F.when(F.col("id") != 7, F.col("id").cast("int")).alias("id"), F.when(F.col("id") % 50 > 0, "a").alias("doc"), text.alias("question"))
    located = spark.range(4000).select(F.when(F.col("id") % 7 > 0, "a").otherwise("b").alias("doc"), F.when(F.col("id") % 2 == 0, "bs").otherwise("pl").alias("kind"), F.when(F.col("id") != 8, F.col("id").cast("int")).alias("page"))
    found = located.unionByName(located.where("page = 10"))
    got = B.preferred_pages(questions, found)
    asked = questions.where("question like 'Total%'").select("id", "doc", F.explode(F.array(F.lit("bs"), F.lit("pl"))).alias("kind"))
    want = asked.join(found, ["doc", "kind"]).select("id", "page", F.when(F.col("kind") == "bs", 1).otherwise(2).alias("rank"))
    sums = lambda df: df.agg(F.count("*"), F.count("id"), F.count("page"), F.sum(F.xxhash64("id", "page", "rank").cast("decimal(20,0)"))).first()
    assert sums(got) == sums(want) and sums(got)[0] > sums(got)[1] > 0
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 0.6 * sum(tasks)


def test_postings_are_shuffled_once(spark):
    """Texts were parted three times, and all postings met their frequencies before they were written."""
    import uuid

    from factloom.operators import kept_index as K
    from factloom.operators.lineage import shared_folder

    texts = ["Loans a-b &c loans", "", None, "the of a", "İstanbul loans K/loans\nΣ x9", "loans tax", "loans tax", "tax"]
    rows = [("d", i, t) for i, t in enumerate(texts)] + [("d", 5, "tax loans"), ("d", 6, "tax"), ("e", None, "loans"), ("e", None, "loans"), ("e", 1, "tax x9"), (None, 1, "loans")]
    pages = spark.createDataFrame(rows, "doc string, page int, text string")
    terms = spark.createDataFrame([("q", t) for t in ("loans", "tax", "tax", "k/loans", "x9", "a-b", "")] + [("r", None), ("s", "nowhere")], "query string, term string")
    name = f"postings_{uuid.uuid4().hex}"
    K.write(pages, f"{shared_folder(spark)}/{name}", name, buckets=4)
    for batch in (terms, terms.unionByName(spark.range(K.LITERALS + 1).selectExpr("'t' as query", "concat('w', id) as term"))):
        got, want = (sorted((r["query"], r.doc, str(r.page), r["rank"], round(r.score, 9)) for r in df.collect()) for df in (K.bm25(spark, name, batch), RT.bm25(pages.fillna({"text": ""}), batch)))
        assert got == want and len(got) > 5
    assert set(spark.table(name).columns) == {"slot", "doc", "page", "length", "term", "tf"}


def test_parts_of_a_consensus_are_worked_out_once(spark):
    """A pair's marked cells were worked out at each place that reads them, and figures part by part."""
    from factloom.operators import geometry as G

    schema = "doc string, page int, n int, grid array<array<string>>"
    a = spark.createDataFrame([("a", 1, 1, [["x", None, "1,000 (23)4"], ["y", "2,00\t7000", "٣٤٥"]]), ("a", 1, 2, [["k", "111", "222"]]), (None, 1, 1, [["333"]]), ("b", 1, 1, None)], schema)
    b = spark.createDataFrame([("a", 1, 1, [["x", "", "1000 234"], ["z", "200 7000", None]]), ("a", 1, 2, [["111", "222"]]), ("a", 1, 3, [["444", "555", "666 111"]])], schema)
    df = G.consensus(a, b)
    got = {(r.doc, r.page, r.n): (r.grid, r.note) for r in df.collect()}
    assert got == {
        ("a", 1, 1): ([["x", None, "1,000 (23)4"], ["y", "2,00\t7000", "٣٤٥"]], ""), ("a", 1, 2): ([["k", "111", "222"]], ""),
        ("a", 1, 3): ([["444", "555", "666 111"]], "single-pass"), (None, 1, 1): ([["333"]], "single-pass"), ("b", 1, 1): (None, got[("b", 1, 1)][1]),
    }
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 5


def test_intervals_that_meet_none_are_not_dealt(spark):
    """Every interval was dealt for shorter and for longer others, whether the other side has any or not, with columns that follow from its ends."""
    from factloom.operators import intervals as I

    a = spark.createDataFrame([(None, -5, -3, 1), ("g", -5, -3, 2), ("g", 0, 100, 3), ("g", 3, 3, 4), ("g", 9, 10, 5), ("g", None, 4, 6), ("g", 40, 44, 7)] * 2, "k string, a0 int, a1 int, item int")
    b = spark.createDataFrame([(None, -4, 4, 1), ("g", -4, 4, 2), ("g", 8, 16, 3), ("g", 40, 48, 4)], "k string, b0 int, b1 int, ord int")
    got = sorted((r.k or "", r.item, r.ord, r.share) for r in I.widest_overlap(a, b, ["k"], "item", "ord").collect())
    assert got == [("", 1, 1, 0.5), ("g", 2, 2, 0.5), ("g", 3, 3, 0.08), ("g", 5, 3, 1.0), ("g", 7, 4, 1.0)]
    text = I.overlapping(a.where("item <> 3"), b, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__a0" not in text and "__bf" not in text
