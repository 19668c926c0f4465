from pyspark.sql import functions as F

from tidemark.llm.sampling import smallest_hashes


def test_smallest_hashes(spark):
    rows = spark.range(5000)
    want = {r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(100).collect()}
    assert {r["id"] for r in smallest_hashes(rows, "id", 100).collect()} == want
    assert {r["id"] for r in smallest_hashes(rows.repartition(7), "id", 100).collect()} == want
    assert smallest_hashes(rows, "id", 5000).count() == 5000 and smallest_hashes(rows.limit(0), "id", 5).count() == 0
