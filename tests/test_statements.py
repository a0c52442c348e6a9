from pyspark.sql import functions as F

from factloom import plans as own
from factloom.operators import statements
from factloom.plans.fixtures import table
from factloom.sources import files


def run(spark, name):
    return own.queries()[name](spark, "").collect()


def test_a_statement_keeps_what_tied(spark):
    got = statements.page_statements(table(spark, "reports"), table(spark, "statement_candidates"), table(spark, "statement_payloads"))
    data = {(r.doc, r.kind): r.data for r in got.collect()}
    assert data[("a", "bs")]["grand_total_b"] == "2,000" and data[("c", "bs")] is None and len(data) == 9


def test_whole_statements_keep_their_fields(spark):
    data = {(r.doc, r.kind): r.data for r in statements.whole_statements(table(spark, "whole_payloads")).collect()}
    assert data[("a", "pl")]["total_income"] == "5" and data[("d", "cf")]["net_investing"] == "(20)"


def test_a_parsed_face_wins(spark):
    got = [(r.doc, r.ord, r.label, r.ref, r.value, r.parsed) for r in run(spark, "r5_face_lines")]
    assert sorted(got) == [("a", 1, "Loans", "4", "3", True), ("a", 2, "Total assets", None, "10", True), ("e", 1, "Loans", "4", "(5)", False), ("e", 2, "Cash", None, "7", False)]


def test_fullest_window(spark):
    assert {(r.doc, r.window, r.key, r.value) for r in run(spark, "r12_fullest_window")} == {("a", 2, "x", "12"), ("a", 2, "y", "3"), ("b", 1, "x", None)}


def test_category_values(spark):
    assert {(r.doc, r.key, r.value) for r in run(spark, "r12_category_values")} == {("a", "bonds", "750"), ("a", "ventures", None), ("a", "none", None)}


def test_empty_tables(spark):
    none = lambda name: table(spark, name).where("false")
    assert statements.page_statements(table(spark, "reports"), none("statement_candidates"), none("statement_payloads")).where("status = 'no-candidate'").count() == 9
    assert statements.whole_statements(none("whole_payloads")).count() == 0
    assert statements.sections_in_force(none("section_pages"), table(spark, "section_headings"), table(spark, "section_tables")).count() == 0


def test_sinks(spark, tmp_path):
    grids = spark.createDataFrame([("a", "s1", 1, 1, "x", "Loans", [["k", "1"], ["m"]]), ("a", "s1", 2, 1, "x", "Loans", [["q", "2", "3"]]), ("b", "s2", 1, 1, None, "", [])], "doc string, sheet string, page int, n int, scope string, section string, grid array<array<string>>")
    files.write_workbook(grids, str(tmp_path / "book"))
    index = {(r.doc, r.sheet): (r.first_page, r.last_page, r.tables, r.rows, r.cols) for r in spark.read.csv(str(tmp_path / "book/index"), header=True).collect()}
    assert index == {("a", "s1"): ("1", "2", "2", "3", "3"), ("b", "s2"): ("1", "1", "1", "0", "0")}
    cells = {(r.doc, r.page, r.row, r.col, r.text) for r in spark.read.parquet(str(tmp_path / "book/cells")).collect()}
    assert cells == {("a", 1, 1, 1, "k"), ("a", 1, 1, 2, "1"), ("a", 1, 2, 1, "m"), ("a", 2, 1, 1, "q"), ("a", 2, 1, 2, "2"), ("a", 2, 1, 3, "3")}
    facts = table(spark, "facts")
    files.write_wide(facts, str(tmp_path / "wide"), ["company", "key"], ["ord"])
    assert spark.read.csv(str(tmp_path / "wide"), header=True).count() == facts.count()
    files.write_error_report(table(spark, "results").withColumn("verdict", F.lit("MATCH")), table(spark, "calls"), str(tmp_path / "report"))
    assert {(r.company, r.n) for r in spark.read.json(str(tmp_path / "report/summary")).collect()} == {("acme", 3), ("Acme", 1), ("bolt", 3)}
