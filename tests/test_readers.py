from factloom import plans as own


def run(spark, name):
    return own.queries()[name](spark, "").collect()


def test_payloads(spark):
    got = {(r.id, r.key): (r.value, r.grounded, r.confidence) for r in run(spark, "r7_read_payloads")}
    assert got == {
        (1, "x"): ("(1,234)", True, "grounded"), (1, "y"): ("750", True, "grounded"), (1, "z"): (None, False, "absent"),
        (2, "x"): (None, False, "absent"), (2, "w"): ("777", False, "unverified"),
    }


def test_rescue_candidates(spark):
    assert {(r.key, r.page, r.line_no, r.rank) for r in run(spark, "r14_rescue_candidates")} == {("lp", 1, 2, 1), ("lp", 1, 3, 2), ("rs", 2, 2, 1), ("tp", 1, 1, 1)}


def test_snippets(spark):
    got = {(r.page, r.line_no): r.snippet for r in run(spark, "w18_snippets")}
    assert got[(1, 10)] == "x\nLosses 3.0 2.0\nTotal deferred tax assets 3.0 2.0"
    assert got[(2, 0)] == "A 1.0 2.0"
    assert got[(1, 6)].splitlines()[-1] == "Total deferred tax assets 7.5 7.0"


def test_lines_of_all_documents(spark, tmp_path):
    texts = ["a\r\nb\r\n", "c\nd", "e\rf", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.page, r.line_no, r.line) for r in own.queries()["s12_lines"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, "a"), (0, 1, "b"), (0, 2, ""), (1, 0, "c"), (1, 1, "d"), (2, 0, "e\rf"), (3, 0, "")]
