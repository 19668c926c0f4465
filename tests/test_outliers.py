import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import outliers as o
from tidemark.operators.windows import entries
from tidemark.streaming.learned import learned

SF = "/root/testdata/sf0.001"


def walk(tree, x, at=0):
    f, t, left, right, d = tree[at]
    return d if f < 0 else walk(tree, x, left if x[f] < t else right)


def brute(forest, x):
    """One row, one tree after the other."""
    return -(2 ** (-sum(walk(t, x) for t in forest.trees) / len(forest.trees) / forest.unit)) - forest.offset


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "event_id long, us long, status int, path string, method string, score string, ip string")


def sample(n=600, seed=1):
    r = np.random.default_rng(seed)
    return [(i, i * 1000, int(r.choice([200, 200, 200, 404])), "/" + "a" * int(r.integers(3, 9)) + "/b" * int(r.integers(0, 3)), str(r.choice(["GET", "POST"])), "old", "1.1.1.1") for i in range(n)]


def test_columns_score_as_the_trees_do(spark):
    df = rows_of(spark, sample() + [(600, 0, None, None, None, "", ""), (601, 0, 500, "/x?" + "q" * 400, "PUT", "", ""), (602, 0, 200, "?", "POST", "", "")])
    forest = o.grow(o.last_rows(df, ["us", "event_id"]))
    got = df.select("event_id", o.features().alias("x")).withColumn("d", o.decision(forest, F.col("x"))).collect()
    assert len(got) == 603
    for r in got:
        assert abs(r["d"] - brute(forest, r["x"])) < 1e-9
    scores = {r["event_id"]: r["d"] for r in got}
    assert sorted(scores, key=scores.get)[0] in (600, 601) and scores[601] < -0.05
    # Five in a hundred of the sample lie below 0.
    assert 0 < sum(s < 0 for s in scores.values()) <= 0.06 * 603
    assert o.Forest.loads(forest.dumps()).dumps() == forest.dumps()


def test_seeds_small_and_uniform_samples(spark):
    x = np.array([[200.0, 5, 1, 0, 0, 0, 0]] * 40)
    df = rows_of(spark, [(1, 1, 200, "/abcd", "GET", "", ""), (2, 2, 500, "/x?y", "POST", "", "")])
    for s in (x[:0], x[:1], x[:2], x):
        assert o.outliers(df.where("event_id = 1"), o.grow(s)).count() == 0
    r = np.random.default_rng(0).normal(size=(50, 7))
    assert o.grow(r).dumps() == o.grow(r).dumps() != o.grow(r, seed=1).dumps()
    assert o.outliers(df.limit(0), o.grow(r)).count() == 0


def test_all_events_are_judged(spark):
    e = entries(spark.read.parquet(f"{SF}/events.parquet"))
    forest = o.grow(o.last_rows(e, ["us", "event_id"]))
    want = {r["event_id"] for r in e.select("event_id", o.features().alias("x")).collect() if round(brute(forest, r["x"]), 9) < 0}
    assert {r["event_id"] for r in o.learned_outliers(spark, SF).collect()} == want


def test_a_stream_agrees_with_batches_and_survives_a_restart(spark, tmp_path):
    rows = sample(1500, 7)
    rows[1210] = (1210, 1_210_000, 500, "/z?" + "q" * 900, "PUT", "", "6.6.6.6")
    folder, found = str(tmp_path / "in"), {}
    schema = rows_of(spark, []).schema

    def put(k):
        rows_of(spark, rows[k * 150 : k * 150 + 150]).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        sink = lambda df, epoch: found.__setitem__(epoch, {(r["event_id"], r["score"]) for r in df.select("event_id", "score").collect()})
        learned(stream, sink, str(tmp_path / "state"), str(tmp_path / "cp"), every=400, fit=500, least=100, cut=0.02).trigger(availableNow=True).start().awaitTermination()

    for k in range(10):
        put(k)
        if k % 4 == 3 or k == 9:
            run()  # each run goes on where the last one ended
    forest, since, want = None, 0, {}
    for k in range(10):
        own, before = rows[k * 150 : k * 150 + 150], rows[: k * 150 + 150]
        if forest is not None:
            want[k] = {(r["event_id"], r["score"]) for r in o.outliers(rows_of(spark, own), forest, 0.02).select("event_id", "score").collect()}
        since += 150
        if forest is None or since >= 400:
            forest, since = o.grow(o.last_rows(rows_of(spark, before), ["us", "event_id"], 500)), 0
    assert found == want and 1210 in {i for i, _ in found[8]} and any(want[k] for k in want if k != 8)
