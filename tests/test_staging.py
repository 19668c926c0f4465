import os
import time

import pytest

import corpus_pipeline
from tidemark.plans.staging import CLEAN_SHUFFLES, scratch, shared_dir, stage

SF = "/root/testdata/sf0.001"


def tables(spark):
    top = shared_dir(spark).removeprefix("file:")
    return {t for d in os.listdir(top) if d.startswith("tidemark-") for t in os.listdir(f"{top}/{d}")}


def shuffles(spark):
    """Shuffle files that are on disk."""
    names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in names.split("\n") if "/shuffle_" in x}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before, rows = shuffles(spark), spark.range(10_000).repartition(7, "id")
    written = stage(rows, "dealt")
    for _ in range(100):  # they go in the background
        if not shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - before and spark.conf.get(CLEAN_SHUFFLES, None) in (None, "false")
    assert written.count() == rows.count() == stage(rows, "dealt-again").count() == 10_000


def test_scratch_keeps_what_it_is_told_to(spark):
    before = tables(spark)
    with scratch() as outer:
        with scratch() as keep:
            gone = stage(spark.range(5), "gone")
            inner = keep(gone.where("id > 1"), "inner")
        assert {x.split("-")[0] for x in tables(spark) - before} == {"inner"}
        kept = outer(inner.where("id > 2"), "kept")
    assert {x.split("-")[0] for x in tables(spark) - before} == {"kept"} and kept.count() == 2
    with pytest.raises(ZeroDivisionError), scratch():
        stage(spark.range(5), "gone")
        raise ZeroDivisionError
    assert stage(spark.range(5), "free").count() == 5 and len(tables(spark) - before) == 2


def test_steps_leave_only_what_they_decide(spark):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), tables(spark)
    for step in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.substrings):
        docs = step(spark, docs, SF)
        assert docs.count() > 0
    left = sorted(x.rsplit("-", 1)[0] for x in tables(spark) - before)
    assert left == ["one-of-alike", "one-of-equals", "passages", "shared-ids"]
