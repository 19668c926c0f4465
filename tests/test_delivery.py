import os
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.plans.versions import Conflict, VersionedTable, append_chain
from tidemark.sources.tail import TailReader, TailSource
from tidemark.streaming.sinks import deliver_once, verify_chain


def lines_of(reader, start, end):
    return [x[0] for p in reader.partitions(start, end) for x in reader.read(p)]


def test_a_tail_loses_and_repeats_no_line(tmp_path, monkeypatch):
    """Growth, half lines, rotation, two rotations, truncation, rewriting: each line once, in order."""
    import tidemark.sources.tail as tail

    log = tmp_path / "access.log"
    reader, seen = TailReader(str(log), True), []
    offset = reader.initialOffset()

    def poll():
        nonlocal offset
        now = TailReader(str(log), True).latestOffset()  # a restarted driver knows the offsets only
        got = lines_of(reader, offset, now)
        assert lines_of(reader, offset, now) == got  # a repeated batch
        offset = now
        seen.extend(got)
        return got

    assert poll() == []
    log.write_text("one\ntw")
    assert poll() == ["one"]
    log.write_text("one\ntwo\n\nfour\r\n")
    assert poll() == ["two", "", "four"]
    with log.open("a") as f:
        f.write("five\n")
    os.rename(log, tmp_path / "access.log.1")
    assert poll() == ["five"]  # nothing is at the path just now
    log.write_text("six\n")
    assert poll() == ["six"]
    with log.open("a") as f:
        f.write("seven\n")
    os.rename(log, tmp_path / "access.log.2")
    log.write_text("eight\n")
    os.utime(log, ns=(os.stat(tmp_path / "access.log.2").st_mtime_ns + 10**6,) * 2)
    os.rename(log, tmp_path / "access.log.3")
    log.write_text("nine\n")
    assert poll() == ["seven", "eight", "nine"]
    log.write_text("cut\n")  # shorter, the same file
    assert poll() == ["cut"]
    log.write_text("another beginning, longer than before\n")
    assert poll() == ["another beginning, longer than before"]
    monkeypatch.setattr(tail, "MOST", 7)
    text = [f"line {k}" for k in range(40)]
    with log.open("a") as f:
        f.write("\n".join(text) + "\n")
    assert poll() == text
    assert TailReader(str(log), False).initialOffset() == offset


def test_the_tail_as_a_stream_over_a_restart(spark, tmp_path):
    spark.dataSource.register(TailSource)
    log, out = tmp_path / "a.log", tmp_path / "out"

    def run():
        q = spark.readStream.format("tail").option("path", str(log)).load().writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["value"] for r in spark.read.parquet(str(out)).collect())

    log.write_text("a\nb\n")
    assert run() == ["a", "b"]
    with log.open("a") as f:
        f.write("c\n")
    os.rename(log, tmp_path / "a.log.1")
    log.write_text("d\n")
    assert run() == ["a", "b", "c", "d"]


def test_two_writers_lose_no_update(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.version() == 0
    table.write(spark.createDataFrame([("n", 0)], "k string, v long"), 0)
    with pytest.raises(Conflict):
        table.write(spark.createDataFrame([("n", 5)], "k string, v long"), 0)

    def add(times):
        for _ in range(times):
            VersionedTable(spark, str(tmp_path / "t")).update(lambda df: df.withColumn("v", F.col("v") + 1))

    writers = [threading.Thread(target=add, args=(4,)) for _ in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert table.version() == 13 and table.read().first()["v"] == 12 and table.read(1).first()["v"] == 0
    with pytest.raises(Conflict):  # whoever is second to claim a version is told so
        table._claim(13, ["x"])


def test_appending_keeps_the_chain(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "audit"))
    entries = lambda a, b: spark.createDataFrame([(k, f"entry {k}" if k % 3 else None) for k in range(a, b)], "nth long, body string")
    append_chain(table, entries(0, 5))
    writers = [threading.Thread(target=append_chain, args=(table, entries(a, a + 4))) for a in (10, 20)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    rows = table.read().withColumn("log", F.lit("l"))
    assert verify_chain(rows).count() == 0 and sorted(r["seq"] for r in rows.collect()) == list(range(13))
    assert table.read(1).count() == 5


def test_deliveries_over_a_restart(spark, tmp_path):
    sent, ledger = tmp_path / "sent", str(tmp_path / "ledger")
    sent.mkdir()

    def post(hook, rows, key):
        if "down" in hook:
            raise OSError("no route")
        with open(sent / key, "a") as f:
            f.write("".join(f"{r['id']}\n" for r in rows))
        return True

    batch = spark.range(10).repartition(3)
    each = deliver_once(post, "http://ok", ledger)
    each(batch, 0)
    each(batch, 0)
    deliver_once(post, "http://ok", ledger)(batch, 0)  # another driver repeats the epoch
    assert sorted(x for f in sent.iterdir() for x in f.read_text().split()) == sorted(str(k) for k in range(10))
    deliver_once(post, "http://ok", ledger)(spark.range(10, 12), 1)
    assert sum(len(f.read_text().split()) for f in sent.iterdir()) == 12
    for epoch in range(7):  # failures outlive the driver; the stream goes on
        deliver_once(post, "http://down", ledger, most_failures=3)(batch, epoch)
    down = [spark.read.parquet(str(p.path)) for p in os.scandir(ledger)]
    assert sorted(d.count() for d in down) == [2, 3]
