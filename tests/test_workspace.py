import pytest
from pyspark.sql import functions as F

from tidemark.operators.workspace import change_confidence, folder_heat, heat, history, hotspots, layer_impact


def test_history_is_filtered_before_it_is_cut(spark):
    rows = [(k, f"2024-01-{k % 28 + 1:02d} 23:59:59.5", ["scan", "audit"][k % 2], k, 100 - k, k * 7 % 50, {"critical": k % 3} if k % 4 else {"high": k}) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "id int, at string, tool string, findings int, health int, duration_ms int, severities map<string,int>").withColumn("ts", F.to_timestamp("at"))
    ids = lambda **kw: [r["id"] for r in history(df, **kw).collect()]
    assert set(ids(start="2024-01-03", end="2024-01-04", most=99)) == {k for k in range(1, 60) if k % 28 + 1 in (3, 4)}
    assert set(ids(severities=["critical"], most=99)) == {k for k in range(1, 60) if k % 4 and k % 3} and set(ids(tool="scan", most=99)) == set(range(2, 60, 2)) and len(ids(tool="all")) == 50
    assert ids(sort_by="findings", most=3) == [59, 58, 57] and ids(sort_by="health", descending=False, most=2) == [59, 58] and ids(sort_by="duration", descending=False, most=1) == [50]
    assert ids(sort_by="severity", most=2) == [56, 52]
    with pytest.raises(ValueError):
        history(df, sort_by="nothing")


def test_heat_of_files_and_folders(spark):
    found = spark.createDataFrame([("a/b/x.py", "low"), ("a/b/x.py", "critical"), ("a/y.py", "medium"), ("z.py", "info"), (None, "high"), ("", "high")], "file string, severity string")
    churn = spark.createDataFrame([("a/b/x.py", 3), ("z.py", 9)], "file string, commits long")
    sizes = spark.createDataFrame([("a/y.py", 51_200)], "file string, bytes long")
    files = heat(found, churn, sizes)
    assert [tuple(r) for r in hotspots(files).collect()] == [("z.py", 28.0, "info"), ("a/b/x.py", 26.0, "critical"), ("a/y.py", 15.0, "medium")]
    assert len(hotspots(files, 1).collect()) == 1
    assert {tuple(r) for r in folder_heat(files).collect()} == {("", 3, 4, 69.0), ("a", 2, 3, 41.0), ("a/b", 1, 2, 26.0)}


def test_layers_and_confidence(spark):
    layers = spark.createDataFrame([("db", "d.py"), ("core", "c.py"), ("web", "w.py"), ("cli", "x.py")], "layer string, file string")
    depends = spark.createDataFrame([("core", "db"), ("web", "core"), ("db", "web"), ("ghost", "db")], "src string, dst string")
    got = {tuple(r) for r in layer_impact(layers, depends, spark.createDataFrame([("d.py",), ("new.py",)], "file string")).collect()}
    assert got == {("db", "affected"), ("core", "impacted"), ("web", "impacted")}
    df = spark.createDataFrame([(1.0, False, True, False), (0.5, True, False, True), (0.0, True, False, True), (None, None, None, None), (0.96, False, True, False)], "c double, p boolean, t boolean, m boolean")
    assert [r[0] for r in df.select(change_confidence(F.col("c"), F.col("p"), F.col("t"), F.col("m"))).collect()] == [100, 50, 40, 100, 100]
