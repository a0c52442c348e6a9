"""Joins, sweeps, rounds and selections against plain Python, with nulls, repeats, ties and a hot key."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from factloom.operators import containment as C, coverage, intervals as I, kept_index as K, matching as M, retrieval as RT, rounds as R, sweep as S, verify as V
from factloom.operators.lineage import ranged, running_sum, shared_folder
from oracle import SF


def plan(df):
    return df._jdf.queryExecution().toString()


def norm(s):
    return re.sub(r"\s+", " ", s.lower().replace("&", " and ")).strip(" ")


PAGES = [("a", 1, "Note 12: Trade  payables & accruals\nof the Group"), ("a", 2, "rade payables and accr"), ("a", 2, "x trade payables and accruals of y"), (None, 3, "Trade payables and accruals of the"), ("b", None, ""), ("b", 4, None), ("b", 5, "ABC ab.c é+é"), *[("hot", i, f"common words here number {i} é") for i in range(200)]]
ALIASES = ["trade payables and accruals of", "Trade payables & accruals", "trade payables", "payables", "ab", "c", "é", "", None, "common words here", "common words here", "number 7", "words nowhere here", "no such alias at all", "+"]


def test_phrases_in_pages(spark):
    pages = spark.createDataFrame(PAGES, "doc string, page int, text string")
    got = C.contained_phrases(spark.createDataFrame([(a,) for a in ALIASES], "alias string"), pages, ["doc", "page"])
    want = Counter((n, d, p) for n in {norm(a) for a in ALIASES if a} for d, p, t in PAGES if t is not None and n in norm(t))
    assert Counter(map(tuple, got.collect())) == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert C.contained_phrases(spark.createDataFrame([], "alias string"), pages, ["doc", "page"]).count() == 0


def test_figures_in_pages(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("0123456789,. x") for _ in range(rnd.randint(0, 60)))) for i in range(300)] + [(300, None), (301, "")]
    values = ["1,234", "12", "007", *[str(rnd.randint(0, 10**k)) for k in range(3, 10) for _ in range(40)], None, ""]
    got = C.contained_figures(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(texts, "page int, text string"), ["page"])
    digits = lambda s: re.sub(r"\D", "", s)
    want = {(n, p) for n in {digits(v) for v in values if v} if len(n) >= 3 for p, t in texts if t is not None and n in digits(t)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50 and "NestedLoop" not in plan(got)


def test_concepts_are_located_as_each_by_itself(spark):
    pages = spark.createDataFrame([(d or "n", 50 + i, t) for i, (d, _, t) in enumerate(PAGES)] + [("c", 9, "Cash flow from operating activities 1,234 5,678.9 finance costs trade payables")], "doc string, page int, text string")
    made = [(1, ["Trade payables", "accruals of", ""], "note on p&l expense payables", "gross payables"), (2, None, "finance costs common words", None), (3, ["nowhere"], None, None), (4, ["common"], "words here", None)]
    got = C.locate(spark.createDataFrame(made, "concept int, aliases array<string>, location_hint string, column_hint string"), pages)
    want = set()
    for c, aliases, hint, column in made:
        scored = pages.withColumn("score", RT.alias_score(F.col("text"), F.array(*[F.lit(a) for a in aliases or []]).cast("array<string>"), F.lit(hint).cast("string"), F.lit(column).cast("string"))).where("score is not null")
        want |= {(c, r.doc, r.page, round(r.score, 9), r["rank"]) for r in RT.top_k(scored, ["doc"], [F.desc("score"), F.col("page")], 5).collect()}
    assert {(r.concept, r.doc, r.page, round(r.score, 9), r["rank"]) for r in got.collect()} == want and len(want) >= 12


def in_turn(groups, least, covered=()):
    kept = set()
    for g, items in groups.items():
        taken = set(covered)
        for i in sorted(items):
            if len(items[i] - taken) >= least:
                taken |= items[i]
                kept.add((g, i))
    return kept


def test_accepted_in_order(spark):
    rnd = random.Random(5)
    rows = [(f"g{rnd.randint(0, 3)}", rnd.randint(0, 60), str(rnd.randint(0, 80))) for _ in range(900)] + [("hot", i, str(j)) for i in range(24) for j in range(i // 2, i // 2 + 4)]
    rows += [("two", 1, "a"), ("two", 1, "b"), ("two", 1, "c"), ("two", 2, "a"), ("two", 2, "b"), ("two", 2, "c"), (None, 1, "a"), (None, 1, "b"), (None, 1, "c"), (None, None, "x"), ("two", 3, None)]
    groups = defaultdict(lambda: defaultdict(set))
    for g, i, f in rows:
        if i is not None and f is not None:
            groups[g][i].add(f)
    df = spark.createDataFrame(rows * 2, "g string, i int, f string")
    got = [tuple(r) for r in R.accepted_in_order(df, ["g"], "i", "f").collect()]
    assert set(got) == in_turn(groups, 3) and len(got) == len(set(got)) and ("two", 1) in got and ("two", 2) not in got
    covered = spark.createDataFrame([("two", "a"), (None, "z")], "g string, f string")
    assert ("two", 1) not in {tuple(r) for r in R.accepted_in_order(df, ["g"], "i", "f", 3, covered).collect()}
    assert R.accepted_in_order(df.where("false"), ["g"], "i", "f").count() == 0


def test_worthwhile_tables_renew_what_is_covered(spark):
    tables = spark.createDataFrame([("a", 1, 1, [["x", "1111 2222"], ["y", "3333"]]), ("a", 1, 2, [["z", "1,111 2,222 3,333"]]), ("a", 2, 1, [["1111", "4444"], ["5555", "6666"]]), ("b", 1, 1, [["1111 2222"]])], "doc string, page int, n int, grid array<array<string>>")
    cells = spark.createDataFrame([("a", "6666")], "doc string, cell string")
    assert {tuple(r) for r in coverage.worthwhile(tables, cells).select("doc", "page", "n").collect()} == {("a", 1, 1)}
    assert {tuple(r) for r in coverage.worthwhile(tables, cells.where("false")).select("doc", "page", "n").collect()} == {("a", 1, 1), ("a", 2, 1)}


def test_coverage_by_counting_every_place(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), s := rnd.randint(0, 90), s + rnd.randint(-1, 12)) for _ in range(400)] + [("a", None, 3), ("a", 3, None)] + [("hot", 5, 9)] * 3000
    df = spark.createDataFrame(rows, "g string, s int, e int")
    steps = S.coverage(df, ["g"], "s", "e")
    at = Counter((g, x) for g, s, e in rows if s is not None and e is not None for x in range(s, e))
    got = Counter()
    for r in steps.collect():
        for x in range(r["from"], r["to"]):
            got[r.g, x] += r.n
    assert +got == at
    most = {r.g: (r.n, r["from"]) for r in S.most_covered(steps, ["g"]).collect()}
    assert most == {g: min((-n, x) for (h, x), n in at.items() if h == g)[::1] and (max(n for (h, _), n in at.items() if h == g), min(x for (h, x), n in at.items() if h == g and n == max(m for (k, _), m in at.items() if k == g))) for g in ("a", "b", None, "hot")}
    free = {(r.g, x) for r in S.gutters(steps, ["g"], most=3, width=1).collect() for x in range(r["from"], r["to"])}
    for g in ("a", "b", None):
        ends = [x for h, x in at if h == g]
        low = [x for x in range(min(ends), max(ends) + 1) if at[g, x] <= 3]
        want = {x for x in low if x - 1 in low or x + 1 in low}
        assert {x for h, x in free if h == g} == want


def test_sums_go_on_over_ranges(spark):
    df = spark.createDataFrame([("hot", i, i % 7) for i in range(5000)] + [("a", 1, 2)], "g string, x int, v int")
    ranges = ranged(df.repartition(9), ["g"], ["x"])
    got = {(r.g, r.x): r.s for r in running_sum(ranges, ["g"], ["x"], "v", "s").collect()}
    total = 0
    for i in range(5000):
        total += i % 7
        assert got["hot", i] == total


def test_last_of_another_kind(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["u", "v", "hot", None]), i, rnd.choice(["a", "b", None])) for i in range(700)] + [("hot", 1000 + i, "a") for i in range(800)]
    got = {r.i: r.before for r in S.last_of_another_kind(spark.createDataFrame(rows, "g string, i int, k string").repartition(6), ["g"], ["i"], "k", "i").collect()}
    last = defaultdict(list)
    for g, i, k in sorted(rows, key=lambda r: r[1]):
        assert got[i] == max((j for j, q in last[g] if q != k), default=None)
        last[g].append((i, k))


@pytest.fixture(scope="module")
def boxes(spark):
    rnd = random.Random(9)
    width = lambda: rnd.choice([0.5, 3, 17, 64, 200])
    items = [(rnd.randint(1, 3), i, float(rnd.randint(0, 40)), x := rnd.randint(0, 800) / 2, x + width()) for i in range(250)] + [(None, 900, 5.0, 1.0, 9.0), (1, 901, 5.0, 9.0, 9.0)]
    heads = [(rnd.randint(1, 3), i, float(rnd.randint(0, 40)), x := rnd.randint(0, 800) / 2, x + width(), f"h{i}") for i in range(120)] + [(None, 500, 4.0, 5.0, 6.0, "null page"), (1, 501, None, 0.0, 900.0, "no place")]
    return spark.createDataFrame(items, "page int, item int, y double, x0 double, x1 double"), spark.createDataFrame(heads, "page int, ord int, hy double, hx0 double, hx1 double, heading string"), items, heads


def test_nearest_above_without_pairs(boxes):
    items, heads, rows, known = boxes
    got = {(r.page, r.item): r.heading for r in I.nearest_above(items, heads.where("hy is not null"), ["page"], unit=0.5, slack=2.0).collect()}
    for p, i, y, x0, x1 in rows:
        best = max(((hy, o, h) for q, o, hy, a, b, h in known if q == p and hy is not None and hy <= y + 2 and min(x1, b) > max(x0, a)), default=(0, 0, None))
        assert got[p, i] == best[2]
    old = {(r.page, r.item): r.heading for r in M.nearest_above(items.where("page is not null"), heads, ["page"]).collect()}
    assert old == {k: v for k, v in got.items() if k[0] is not None}
    assert {r.heading for r in I.nearest_above(items, heads.where("false"), ["page"]).collect()} == {None}


def test_overlaps_by_bins(boxes):
    items, heads, rows, known = boxes
    a = items.select("page", "item", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = heads.select("page", "ord", F.col("hx0").alias("b0"), F.col("hx1").alias("b1"))
    got = Counter((r.page, r.item, r.ord) for r in I.overlapping(a, b, ["page"], unit=0.5).collect())
    assert got == Counter((p, i, o) for p, i, _, x0, x1 in rows for q, o, _, c, d, _ in known if p == q and min(x1, d) > max(x0, c))
    wide = {(r.page, r.item): (r.ord, r.share) for r in I.widest_overlap(a, b, ["page"], "item", "ord", unit=0.5).collect()}
    for p, i, _, x0, x1 in rows:
        best = min(((-(min(x1, d) - max(x0, c)) / (x1 - x0), o) for q, o, _, c, d, _ in known if p == q and min(x1, d) > max(x0, c)), default=None)
        assert wide.get((p, i)) == (best and (best[1], -best[0]))
    assert I.overlapping(a, b.where("false"), ["page"]).count() == 0


def test_unchained_rows(spark):
    rnd = random.Random(4)
    near = lambda x: x + rnd.choice([0, 0.01, -0.019, 0.021, 0.005 * x, 0.0049 * x, -0.0051 * x, 0.3 * x])
    rows = []
    for i in range(600):
        opening = rnd.choice([0.0, 3.99, 4.0, -2.5, 4.01, rnd.uniform(-9, 9), rnd.uniform(-1e6, 1e6)])
        rows.append((rnd.choice(["a", "b", None]), i, opening, near(rnd.choice(rows)[2]) if rows else 1.0))
    rows += [("own", 1, 5.0, 5.0), ("own2", 1, 5.0, 5.0), ("own2", 2, 5.0, 99.0), ("a", 9001, None, 4.0), ("a", 9002, 4.0, None)] + [("hot", 10_000 + i, 100.0, 100.0 + i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, id int, opening double, closing double")
    got = {r.id if r.g != "own2" else -r.id for r in R.unchained(df, ["g"]).collect()}
    opened = defaultdict(list)
    for g, i, o, _ in rows:
        if o is not None:
            opened[g].append((i, o))
    hot = {100.0, 101.0, 102.0}
    want = set()
    for g, i, _, c in rows:
        found = (c in hot and abs(c - 100.0) < c * 0.005) if g == "hot" else c is not None and any(j != i and abs(c - o) < max(abs(c) * 0.005, 0.02) for j, o in opened[g])
        if not found:
            want.add(i if g != "own2" else -i)
    assert got == want and 50 < len(want) < 4000


def test_matching_takes_the_best_first(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(0, 40), rnd.randint(0, 40), rnd.randint(1, 6) / 6) for _ in range(500)]
    best, used, want = sorted({(-s, a, b) for a, b, s in edges}), (set(), set()), set()
    for s, a, b in best:
        if a not in used[0] and b not in used[1]:
            used[0].add(a), used[1].add(b), want.add((a, b, -s))
    assert {tuple(r) for r in R.matched(spark.createDataFrame(edges * 2, "a int, b int, score double")).collect()} == want


def test_similar_sets(spark):
    rnd = random.Random(1)
    sets = {n: {i: {f"t{rnd.randint(0, 25)}" for _ in range(rnd.randint(1, 9))} for i in range(60)} for n in "ab"}
    frames = [spark.createDataFrame([(i, t) for i, ts in sets[n].items() for t in ts] * 2 + [(99, None)], f"{n} int, token string") for n in "ab"]
    got = {(r.a, r.b): r.score for r in R.similar_sets(*frames, 0.3).collect()}
    want = {(i, j): len(x & y) / len(x | y) for i, x in sets["a"].items() for j, y in sets["b"].items() if len(x & y) / len(x | y) >= 0.3}
    assert got == want and len(want) > 100


def test_upper_median_by_bins(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([rnd.random() * 1e6, 5.0, -1e300, 1e300])) for _ in range(3000)] + [("even", float(x)) for x in (4, 1, 3, 2)] + [(None, 7.0), ("same", 2.0), ("same", 2.0), ("none", None), ("nan", float("nan")), ("huge", -1.7e308), ("huge", 1.7e308), ("huge", 0.0)]
    got = {r.g: (r.n, r.median) for r in R.upper_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", pivots=8, few=40).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups[g].append(v)
    assert got == {g: (len(v), sorted(v)[len(v) // 2]) for g, v in groups.items()}


def test_signs_of_sixteen_movements(spark):
    rnd = random.Random(2)
    rows = []
    for n in (0, 1, 2, 5, 9, 16, 17):
        for _ in range(6):
            moves = [round(rnd.uniform(-90, 90), 2) for _ in range(n)]
            opening = round(rnd.uniform(-50, 50), 2)
            closing = opening + sum(rnd.choice([1, -1]) * m for m in moves)
            rows += [(opening, moves, closing), (opening, moves, closing + rnd.choice([0.01, 0.7, 1e4]))]
    rows += [(1.0, [None, 2.0], 3.0), (None, [1.0], 1.0), (1.0, None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "o double, m array<double>, c double").select(V.signs_close(F.col("o"), F.col("m"), F.col("c"))).collect()]
    for (o, m, c), closes in zip(rows, got):
        moves = [x for x in m or [] if x is not None]
        sums = {o} if o is not None and m is not None else set()
        for x in moves:
            sums = {s + x for s in sums} | {s - x for s in sums}
        assert closes == (len(moves) <= 16 and any(abs(s - c) < 0.02 for s in sums))


def test_index_is_pruned_and_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("source as doc", "doc_id as page", "text")
    folder = f"{shared_folder(spark)}/kept_index_test"
    K.write(docs, folder, "kept_index_test", buckets=32)
    terms = spark.createDataFrame([("q", "license"), ("q", "released"), ("q", "license"), ("r", "apache")], "query string, term string")
    for batch in (terms, terms.where("query = 'r'")):
        got, want = (sorted((r["query"], r.doc, r.page, r["rank"], round(r.score, 9)) for r in df.collect()) for df in (K.bm25(spark, "kept_index_test", batch), RT.bm25(docs, batch)))
        assert got == want and got
    text = plan(K.bm25(spark, "kept_index_test", terms.where("query = 'r'")))
    pruned = re.search(r"SelectedBucketsCount: (\d+) out of 32", text)
    assert pruned and int(pruned[1]) <= 8 and "Exchange hashpartitioning(query" in text and "Exchange hashpartitioning(term" not in text
    many = spark.createDataFrame([("q", f"word{i}") for i in range(K.LITERALS + 5)] + [("q", "license")], "query string, term string")
    assert K.bm25(spark, "kept_index_test", many).count() == K.bm25(spark, "kept_index_test", terms.where("term = 'license'")).count()
