from pyspark.sql import functions as F

from factloom import plans as own
from factloom.functions import headings as H
from factloom.operators import chapters, comparison, schedules
from factloom.plans.fixtures import table


def run(spark, name):
    return own.queries()[name](spark, "").collect()


def test_layouts(spark):
    got = {(r.doc, r.page): (r.classes_as_columns, r.layout, r.columns, r.n_columns) for r in run(spark, "f15_f16_layouts")}
    assert got == {
        ("a", 7): (True, "per_column", ["Land", "Buildings", "Plant & Machinery", "Vehicles", "Total"], 7),
        ("a", 6): (False, "per_column", ["Land", "Buildings", "Office Equipment", "Total"], 6),
        ("a", 9): (False, "per_row", [], 5),
        ("b", 1): (False, "shredded", [], 0), ("b", 2): (False, "shredded", [], 0), ("b", 3): (True, "shredded", [], 0), ("b", 4): (False, "shredded", [], 0), ("b", 5): (False, "shredded", [], 0),
    }


def test_closing_rows_are_the_first_of_the_latest_year(spark):
    got = {(r.page, r.block, r.label): r.value for r in run(spark, "r9_closing_rows")}
    assert len(got) == 27
    assert [got[(6, "gross", c)] for c in ("Land", "Buildings", "Office Equipment", "Total")] == ["5", "(6)", "7", "3"]
    assert [got[(7, "net", c)] for c in ("Land", "Buildings", "Plant & Machinery", "Vehicles", "Total")] == ["1", "2", "3", "4", "10"]


def test_schedules_by_columns(spark):
    got = {r.key: (r.page, r.value, r.confidence) for r in run(spark, "r9_column_schedules")}
    assert got == {
        "Gross_Land": (6, "5", "reconciled"), "Gross_Buildings": (6, "(6)", "reconciled"), "Gross_Office Equipment": (6, "7", "reconciled"),
        "Accumulated_Office Equipment": (6, "2", "reconciled"), "Net_Land": (6, None, "absent"), "Gross_Unknown": (6, None, "absent"),
    }
    apart = schedules.column_schedules(table(spark, "asset_pages"), spark.createDataFrame([("a", 99.0)], "doc string, parent double"), ["Gross_Land"]).collect()
    assert [(r.value, r.confidence) for r in apart] == [("5", "grounded")]


def test_labels_in_old_fonts(spark):
    got = {r.id: r.grid for r in run(spark, "x14_english_rows")}
    assert got[1] == [["Deposits", "10", ""], ["Loans", "5", "6"]]
    assert all(got[r.id] == r.grid for r in table(spark, "odd_grids").where("id > 1").collect())


def test_discussion_span(spark):
    got = {r.doc: (r.start, r.end, r.found_by) for r in run(spark, "w16_discussion_span")}
    assert got == {"title": (2, 4, "title"), "ribbon": (4, 7, "ribbon"), "heading": (3, 4, "heading"), "short": (1, 1, "short")}


def test_spans_stop_at_the_longest(spark):
    pages = spark.createDataFrame([("d", 1, "Management Discussion")] + [("d", i, "x") for i in range(2, 100)], "doc string, page int, text string")
    assert [(r.start, r.end) for r in chapters.discussion_span(pages).collect()] == [(1, 60)]
    assert [(r.start, r.end) for r in chapters.discussion_span(pages.where("page < 8")).collect()] == [(1, 7)]


def test_empty_tables(spark):
    none = lambda name: table(spark, name).where("false")
    assert chapters.discussion_span(none("chapter_pages")).count() == 0
    assert schedules.closing_rows(none("asset_pages"), ["doc", "page"]).count() == 0
    assert comparison.with_truth(none("results"), table(spark, "gold")).count() == 0
    assert comparison.with_truth(table(spark, "results"), none("gold")).where("gt_value <> ''").count() == 0
    assert comparison.disputed(none("adjudicated"), none("results").withColumnsRenamed({"value": "extracted_value", "status": "gt_value"}), table(spark, "taxonomy")).count() == 0
    assert none("printed_lines").select(H.note_heading(F.col("line"))).count() == 0
