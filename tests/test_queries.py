import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.operators import ordered as O, verify as V
from factloom import plans as own
from factloom.streaming.sessions import sessions
from oracle import SF, by_sql, rows


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got, want = own.queries()[name](spark, SF).toPandas(), by_sql(own.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # counts and numbers in either engine's width
        if got[c].dtype != want[c].dtype and got[c].dtype.kind in "if" and want[c].dtype.kind in "if":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_golden_numbers(spark):
    df = spark.createDataFrame([("(-5)",), ("204.80 103.52 308.32",), ("- 12 ( 3 ) - 4",)], "s string")
    got = df.select(N.parse_number(F.col("s")), N.statement_number(F.col("s")), N.row_numbers(F.col("s"))).collect()
    assert got[0][0] == 5 and got[0][1] == -5
    assert got[1][2] == [204.80, 103.52, 308.32]
    assert 0.0 in got[2][2]


@pytest.mark.parametrize("nums, closes", [([100.0, 20.0, 5.0, 115.0], True), ([100.0, 20.0, 99.0], False), ([51.9], False)])
def test_block_closes(spark, nums, closes):
    assert spark.createDataFrame([(nums,)], "n array<double>").select(V.block_closes(F.col("n"))).first()[0] is closes


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc string, page int, signal string")
    assert O.forward_fill(empty, ["doc"], "page", F.col("signal"), "X", "r").count() == 0
    assert O.spans(empty, ["doc"], "page", "signal").count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream).writeStream.outputMode("append").format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    closed = spark.table("s")
    assert 0 < closed.count() <= sessions(events).count()
    assert closed.exceptAll(sessions(events)).count() == 0
