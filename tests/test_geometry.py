import numpy as np

from factloom import plans as own
from factloom.operators import geometry as G
from factloom.plans.fixtures import TABLES


def run(spark, name):
    return own.queries()[name](spark, "").collect()


def test_word_rows(spark):
    rows = {}
    for r in run(spark, "w9_word_rows"):
        if r.doc == "a":
            rows.setdefault(r.row, []).append((r.x0, r.word))
    assert [" ".join(w for _, w in sorted(rows[k])) for k in sorted(rows)] == ["Schedule of assets", "Land 1,000 900", "Plant and tools 2,500.5 40", "Other", "Cars (7) 8", "Total 3,493.5 948", "Notes follow"]


def test_page_grids(spark):
    (grid,) = [r.grid for r in run(spark, "r16_page_grids")]
    assert grid == [["Land", "1,000", "900"], ["Plant and tools", "2,500.5", "40"], ["Other", "", ""], ["Cars", "(7)", "8"], ["Total", "3,493.5", "948"]]


def test_gutters_by_probe():
    rows = [[(0.0, 40.0), (60.0, 90.0)], [(0.0, 30.0), (62.0, 95.0)], [(5.0, 45.0), (70.0, 90.0)]]
    free = [x for x in np.arange(0.0, 95.0, 2.0) if sum(a < x < b for r in rows for a, b in r) <= 1]
    got = G.gutters(rows, 0.0, 95.0)
    assert got and all(any(a <= x <= b for a, b in got) for x in free if 46 <= x <= 60)
    assert all(b - a >= 5 for a, b in got)


def test_reflow(spark):
    two = [("a", 1, 20.0 + 45 * (i % 2) + 300 * side, 10.0 * (i // 2), 60.0 + 45 * (i % 2) + 300 * side, 10.0 * (i // 2) + 8, f"{'left' if side == 0 else 'right'}{i}", 600.0) for side in (0, 1) for i in range(30)]
    one = [("b", 1, 20.0, 1.0, 50.0, 9.0, "only", 600.0)]
    words = spark.createDataFrame(two + one, "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string, width double")
    got = {r.doc: r.reflow for r in G.reflowed_pages(words).collect()}
    left, right = got["a"].split("\n\n")
    assert got["b"] is None
    assert left.split() == [f"left{i}" for i in range(30)] and right.split() == [f"right{i}" for i in range(30)]


def test_consensus(spark):
    schema = "doc string, page int, n int, grid array<array<string>>"
    a = spark.createDataFrame([("a", 1, 1, [["x", "1,000"], ["y", "2,000"]]), ("a", 1, 2, [["q", "555"], ["r", "666"]]), ("b", 1, 1, [["words"]])], schema)
    b = spark.createDataFrame([("a", 1, 1, [["x", "1000"], ["y", "2,001"]]), ("a", 2, 1, [["k", "111"], ["l", "222"], ["m", "333"]])], schema)
    got = {(r.doc, r.page, r.n): (r.grid, r.note) for r in G.consensus(a, b).collect()}
    assert got[("a", 1, 1)] == ([["x", "1,000"], ["y", "⚠ 2,000 | 2,001"]], "1 cells differ")
    assert got[("a", 1, 2)][1] == "single-pass" and got[("b", 1, 1)][1] == "" and got[("a", 2, 1)][1] == "single-pass"


def test_words_of_no_page(spark):
    empty = spark.createDataFrame([], TABLES["words"][0])
    assert G.page_grids(empty).count() == G.word_rows(empty).count() == G.rebuilt_lines(empty).count() == 0
