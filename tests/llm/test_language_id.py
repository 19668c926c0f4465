import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.language_id import document_vectors, held_out, identify, learn, trigrams, SYMBOLS, _vectors

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert got.count() == truth.count() and len(rows) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bundles_are_sums_of_bound_letters():
    first, second, third = _vectors()
    text = "Aé, b"
    want = sum(first[t // SYMBOLS**2].astype(int) * second[t // SYMBOLS % SYMBOLS] * third[t % SYMBOLS] for t in trigrams(text).tolist())
    assert (document_vectors([None, text, "12"])[1] == want).all() and not document_vectors([None, "12"]).any()


def test_cases(spark):
    rows = [(1, "und so weiter der die das", "de"), (2, "the and of that with", "en"), (3, None, "en"), (4, "123 !!", None), (5, "the and that", None), (5, "the and that", None), (None, "der die das " * 20_000, None), (7, "中文字", "zz"), (8, "中文字", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = identify(df, learn(df), ["doc_id"]).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 9 and by[3] == by[4] == ("und", 0.0) and by[5][0] == "en" and by[None][0] == "de" and by[8][0] == "zz"
    assert identify(df.limit(0), learn(df), ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in identify(df, learn(df.limit(0)), ["doc_id"]).collect()} == {"und"}
    assert spark.range(3).select(held_out(F.col("id"))).count() == 3


def test_rare_languages_are_learned_and_predictions_are_the_nearest_prototype(spark):
    """One document of a rare language beside many; every prediction against cosines computed one by one."""
    common = [(i, f"the and of that with word{i} and this", "en") for i in range(400)] + [(1000 + i, f"der die das und mit wort{i} nicht", "de") for i in range(300)]
    rows = [*common, (5000, "ett och att det som en på är av för", "sv"), (5001, "och det är en att på", None), (5002, "and that the", None), (5003, "und nicht die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = learn(df, sample=50)
    assert list(learned) == ["de", "en", "sv"]
    got = {r["doc_id"]: r for r in identify(df, learned, ["doc_id"]).collect()}
    assert got[5001]["lang_pred"] == "sv" and got[5002]["lang_pred"] == "en" and got[5003]["lang_pred"] == "de"
    vectors = document_vectors([t for _, t, _ in rows]).astype(float)
    for (i, _, _), v in zip(rows, vectors, strict=True):
        cosines = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in learned.items()}
        assert got[i]["lang_pred"] == max(cosines, key=cosines.get) and abs(got[i]["score"] - max(0, max(cosines.values()))) < 1e-5
    # The rare language's prototype is the unit vector of its one document.
    assert np.allclose(learned["sv"], vectors[700] / np.linalg.norm(vectors[700]), atol=1e-5)
    # A sample takes the smallest hashes of ids, so it does not depend on partitions.
    again = learn(df.repartition(7), sample=50)
    assert all(np.allclose(learned[k], again[k]) for k in learned)
