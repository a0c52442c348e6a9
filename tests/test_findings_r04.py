"""One small test for each finding of round 4 that was mended; each failed before."""

import random

from factloom import plans as own


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_faces_are_joined_without_the_driver(spark):
    from factloom.operators import pages as P
    from factloom.plans.fixtures import table

    assert "Broadcast" not in plan(own.queries()["r4_statement_faces"](spark, ""))
    assert "Broadcast" not in plan(P.candidate_pages(table(spark, "face_pages")))


def test_headings_and_items_are_shuffled_once_each(spark, monkeypatch):
    from factloom.operators import intervals as I

    rnd = random.Random(4)
    box = lambda: (x := rnd.randint(0, 300), x + rnd.choice([1, 5, 40]))
    rows = [(rnd.choice([1, 2, None]), i // 2, rnd.randint(0, 30), *box()) for i in range(600)]  # two rows an item
    known = [(rnd.choice([1, 2, None]), f"{i}", rnd.randint(0, 30), *box()) for i in range(300)]
    items = spark.createDataFrame(rows, "page int, item int, y long, x0 long, x1 long")
    heads = spark.createDataFrame([(p, h, y, a, b, h) for p, h, y, a, b in known], "page int, ord string, hy long, hx0 long, hx1 long, heading string")
    want = {}
    for p, i, y, x0, x1 in rows:
        best = max(((hy, h) for q, h, hy, a, b in known if q == p and hy <= y and a < x1 and x0 < b), default=None)
        want[p, i] = max((x for x in (want.get((p, i)), best) if x), default=None)
    want = {(*k, v and v[1]) for k, v in want.items()}
    got = I.nearest_above(items, heads, ["page"])
    assert plan(got).count("Exchange") == 1 and "Generate" not in plan(got)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(I, "SWEPT", 100)
    assert {tuple(r) for r in I.nearest_above(items, heads, ["page"]).collect()} == want
    monkeypatch.setattr(I, "FEW", 250)
    parts = I.nearest_above(items, heads, ["page"])
    assert "Generate" in plan(parts) and {tuple(r) for r in parts.collect()} == want and parts.count() == len(want)


def test_sets_are_matched_without_copies_for_each_block(spark, monkeypatch):
    from factloom.operators import rounds as R

    rnd = random.Random(8)
    sets = {n: {i: {f"t{rnd.randint(0, 40)}" for _ in range(rnd.randint(1, 12))} | {f"{n}{i}"} for i in range(90)} for n in "ab"}
    sets["b"][5] = sets["a"][2]
    a, b = (spark.createDataFrame([(i, t) for i, ts in sets[n].items() for t in ts] * 2 + [(1, None), (None, "t1")], f"{n} long, token string") for n in "ab")
    pairs = sorted((-len(x & y) / len(x | y), i, j) for i, x in sets["a"].items() for j, y in sets["b"].items() if x & y and len(x & y) / len(x | y) >= 0.1)
    used, want = (set(), set()), set()
    for s, i, j in pairs:
        if i not in used[0] and j not in used[1]:
            used[0].add(i), used[1].add(j), want.add((i, j, -s))
    monkeypatch.setattr(R, "BLOCK", 25)
    seen = []
    kept = R.cut
    monkeypatch.setattr(R, "cut", lambda df: seen.append(df._jdf.queryExecution().toString()) or kept(df))
    got = [tuple(r) for r in R.matched_sets(a, b, 0.1).collect()]
    assert len(got) == len(want) and set(got) == want and min(s for *_, s in got) < 0.25 and len(seen) > 20
    assert not any("CoGroups" in x for x in seen) and sum("CartesianProduct" in x for x in seen) == 3
