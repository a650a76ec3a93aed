import importlib
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skarn.operators import relational as rel
from skarn.sources import tables as sources
from skarn.streaming import windows

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_relational_helpers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "É"), (2, "e"), (None, "E")], "k int, v string")
    b = spark.createDataFrame([(2, 10), (3, 30), (None, 5)], "k int, w int")
    assert sorted((r[0], r[3]) for r in rel.using(a, b, ["k"]).collect()) == [(2, 10), (2, 10)]
    assert rel.semi(a, b, a["k"] == b["k"]).count() == 2 and rel.anti(a, b, a["k"] == b["k"]).count() == 2
    assert [r.k for r in a.orderBy(rel.asc("k"), "v").collect()] == [1, 2, 2, None] and a.orderBy(rel.desc("k")).first().k is None
    assert rel.limit(a.orderBy("v"), "2", 1).count() == 2
    with pytest.raises(ValueError):
        rel.limit(a, -1)
    assert sorted(r.v for r in rel.distinct_folded(a.select("v"), ["v"]).collect()) == ["E", "x"]
    assert {r.v: r.n for r in rel.group_folded(a, "v", F.count("*").alias("n")).collect()} == {"E": 3, "x": 1}
    assert sorted(map(tuple, rel.salted_join(a, b, "k", 4).select("k", "v", "w").collect())) == [(2, "e", 10), (2, "É", 10)]
    assert rel.salted_join(a, b, "k", 4, "left").count() == 4
    joined = a.groupBy("k").agg(rel.group_concat("v", "|", order="v").alias("g"), rel.first_row_value("v", "v").alias("f"))
    assert {r.k: (r.g, r.f) for r in joined.collect()}[2] == ("e|É", "e")
    assert spark.range(1).select(rel.real_divide(F.lit(1.0), F.lit(0.0)).alias("x"), rel.int_divide("-7", "2").alias("y")).first() == (float("inf"), -3)


def test_scan_pushes_down(spark):
    frame = sources.table(spark, SF, "orders").filter("o_orderkey = 5").select("o_totalprice")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_sorted_layout(spark, tmp_path):
    sources.write_sorted(sources.table(spark, SF, "orders"), f"{tmp_path}/o", ["o_orderkey"])
    assert spark.read.parquet(f"{tmp_path}/o").count() == sources.table(spark, SF, "orders").count()


@pytest.mark.parametrize("make", [windows.tumbling_totals, windows.sessions])
def test_streams_equal_batches(spark, tmp_path, make):
    events = sources.table(spark, SF, "events").filter("user_id < 200")
    last = spark.createDataFrame([(-1, "2030-01-01 00:00:00", -1, "end", 0.0, "")], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = make(windows.event_stream(spark, f"{tmp_path}/in"), lateness="40 days").writeStream.format("memory").queryName(make.__name__).outputMode("append").start()
    query.processAllAvailable()
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    batch = make(events.withColumn("ts", F.col("ts").cast("timestamp")))
    got, want = spark.table(make.__name__), batch
    assert got.agg(F.sum("n"), F.count("*")).first() == want.agg(F.sum("n"), F.count("*")).first()


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_subpackage():
    code = "import sys; sys.modules['skarn.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_not_in_has_no_forced_broadcast(spark):
    from skarn.session import Session

    session = Session(spark).attach(SF, ("orders", "lineitem"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = session.query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and "Broadcast" not in plan


def test_equal_rows_of_a_hot_key_are_dealt(spark):
    large = spark.createDataFrame([(1, "same", 0)] * 1000, "k int, v string, __salt int").repartition(4)
    small = spark.createDataFrame([(1, 5)], "k int, w int")
    joined = rel.salted_join(large, small, "k", 16)
    assert joined.count() == 1000 and joined.columns == ["k", "v", "__salt", "w"]
    place = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(16))
    assert large.select(place.alias("s")).distinct().count() == 16


def test_inserts_append_and_vacuum_removes_old_versions(spark, tmp_path):
    from skarn.session import Affected, Session

    s = Session(spark, f"file://{tmp_path}")
    s.run("CREATE TABLE t (a INT PRIMARY KEY); INSERT INTO t VALUES (1), (2), (3); INSERT INTO t VALUES (4)")
    written = {p.name: sum(1 for f in p.glob("*.parquet")) for p in tmp_path.iterdir()}
    assert len(written) == 2 and spark.read.parquet(f"file://{tmp_path}/*").count() == 4
    with pytest.raises(Exception):  # noqa: B017
        s.execute("INSERT INTO t VALUES (4)")
    assert len([*tmp_path.iterdir()]) == 2
    s.execute("DELETE FROM t WHERE a < 3")
    assert s.execute("VACUUM") == Affected(2) and sorted(r.a for r in s.query("SELECT a FROM t").collect()) == [3, 4]
    s.execute("ALTER TABLE t REBUILD")
    assert len(s._state.tables["default.public.t"].paths) == 1


def test_two_sessions_keep_their_tables_apart(spark):
    from skarn.session import Session

    a, b = Session(spark), Session(spark)
    a.run("CREATE TABLE t (x INT); INSERT INTO t VALUES (1)")
    b.run("CREATE TABLE t (x INT); INSERT INTO t VALUES (2)")
    lazily = a.query("SELECT x FROM t")
    a.execute("UPDATE t SET x = 9")
    assert [r.x for r in lazily.collect()] == [1] and a.query("SELECT x FROM t").first().x == 9 and b.query("SELECT x FROM t").first().x == 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_skarn")]
