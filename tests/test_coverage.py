from factloom.operators import coverage as C, geometry as G, schedules as S


def test_coordinate_cells(spark):
    heads = [("Land", 200), ("Buildings", 300), ("Plant", 400), ("Vehicles,", 500), ("Office", 505)]
    words = [(t, x, 50.0) for t, x in heads] + [("2026", 20.0, 20.0)]
    for y, label, nums in ((80.0, "Gross carrying value as at April 1, 2025", [1, 2, 3, 4]), (120.0, "Additions", [5, 6, 7, 8]), (180.0, "Gross carrying value as at March 31, 2026", ["1,000", "2,000", "(3,000)", "4"]), (240.0, "Accumulated depreciation as at March 31, 2026", ["–", "20", "30", "40"])):
        words += [(w, 10.0 + 12 * i, y) for i, w in enumerate(label.split())] + [(str(n), x, y) for n, (_, x) in zip(nums, heads)]
    df = spark.createDataFrame([("a", 1, float(x), y, x + 10.0, y + 8.0, t) for t, x, y in words] + [("b", 1, 0.0, 0.0, 5.0, 5.0, "alone")], "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string")
    targets = spark.createDataFrame([("gross_land", "Land", True), ("gross_plant", "Plant", True), ("accumulated_buildings", "Buildings", False), ("gross_vehicles", "Vehicles", True), ("gross_computer", "Computer", True)], "key string, head string, gross boolean")
    got = {r.key: r.value for r in S.coordinate_cells(df, targets).collect()}
    assert got == {"gross_land": "1,000", "gross_plant": "(3,000)", "accumulated_buildings": "20"}  # vehicles and office are too near


def test_dense_columns():
    grid = [[f"r{i}", "", "x" if i == 3 else "", str(i), str(2 * i)] for i in range(8)]
    assert G.dense_columns(grid) == [[f"r{i}", f"{'x ' if i == 3 else ''}{i}", str(2 * i)] for i in range(8)]
    assert G.dense_columns([["a", "1"], ["b", ""]]) == [["a", "1"], ["b", ""]]


def test_reading_frame(spark):
    schema = "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string, dx double, dy double, height double, width double"
    level = [("a", 1, 10.0 * i, 5.0, 10.0 * i + 8, 15.0, f"w{i}", 1.0, 0.0, 800.0, 600.0) for i in range(5)] + [("a", 1, 1.0, 1.0, 2.0, 9.0, "margin", 0.0, -1.0, 800.0, 600.0)]
    turned = [("b", 1, 50.0, 700.0 - 20 * i, 60.0, 715.0 - 20 * i, f"t{i}", 0.0, -1.0, 800.0, 600.0) for i in range(12)] + [("b", 1, 0.0, 0.0, 5.0, 5.0, "foot", 1.0, 0.0, 800.0, 600.0)]
    rows = G.reading_frame(spark.createDataFrame(level + turned, schema)).collect()
    assert {r.word for r in rows if r.doc == "a"} == {f"w{i}" for i in range(5)}
    b = sorted((r for r in rows if r.doc == "b"), key=lambda r: r.x0)
    assert [r.word for r in b] == [f"t{i}" for i in range(12)] and {r.y0 for r in b} == {50.0} and b[0].x0 == 85.0 and all(r.x1 - r.x0 == 15 for r in b)


def test_grounded_section(spark):
    pages = spark.createDataFrame([("a", 1, "letter to members"), ("a", 2, "borrowings secured loan 1,234 and unsecured 777"), ("b", 1, "nothing")], "doc string, page int, text string")
    terms = spark.createDataFrame([("loans", "borrowings"), ("loans", "loan")], "query string, term string")
    payload = '[{"key": "secured", "present": true, "value": "1,234", "evidence": "secured loan 1,234"}, {"key": "bond", "present": true, "value": "9,999", "evidence": ""}]'
    found = C.grounded_section(pages, terms, spark.createDataFrame([("loans", "a", payload), ("loans", "b", payload)], "query string, doc string, payload string"))
    assert sorted((r.doc, r.key, r.value, r.confidence) for r in found.collect()) == [("a", "bond", "9,999", "unverified"), ("a", "secured", "1,234", "grounded")]
