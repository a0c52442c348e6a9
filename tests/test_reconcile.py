import itertools

import pytest

from factloom import plans as own
from factloom.plans.fixtures import TABLES


def run(spark, name):
    return own.queries()[name](spark, "").collect()


def test_results_tie(spark):
    got = {r.sheet: (r.ok, r.failed, r.n_checks) for r in run(spark, "v4_results_tie")}
    assert got == {1: (True, "", 4), 2: (False, "income less expenses", 2), 3: (True, "", 0), 4: (True, "", 1)}


def test_splits_equal_brute_force(spark):
    def closes(block):
        moves = block[1:-1]
        if not 2 <= len(block) <= 10:
            return False
        return any(abs(block[0] + sum(s * m for s, m in zip(signs, moves)) - block[-1]) < 0.02 for signs in itertools.product((1, -1), repeat=len(moves)))

    want = []
    for i, v in TABLES["asset_rows"][1]:
        for a in range(2, len(v)):
            for b in range(a + 2, len(v)):
                if abs(v[a - 1] - v[b - 1] - v[b]) <= 0.02 and closes(v[:a]) and closes(v[a:b]):
                    want.append((i, v[a - 1], v[b - 1], v[b]))
    assert sorted(tuple(r) for r in run(spark, "v8_splits")) == sorted(want) and want


def test_faces_whose_identities_hold(spark):
    got = run(spark, "r4_statement_faces")
    assert {(r.doc, r.kind) for r in got} == {("a", "bs"), ("a", "pl"), ("b", "bs"), ("c", "bs")}
    assert {r.page for r in got if r.doc == "c"} == {1, 2}


@pytest.mark.parametrize("label, ref, value", [("Trade payables", None, "200.00"), ("Deferred tax assets (net)", "5", None), ("III Total Income (I+II)", None, "1,050.00"), ("Finance costs", "21", "50.00"), ("Total", None, "100.00")])
def test_face_rows(spark, label, ref, value):
    assert (label, ref, value) in {(r.label, r.ref, r.value) for r in run(spark, "x7_face_rows")}
