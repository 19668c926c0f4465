import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa

from tidemark.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string, pos string, key int, node string"


def towards_zero(c):
    return c - (abs(c) % 20) * (1 if c >= 0 else -1)


def brute(turns):
    own = defaultdict(list)
    for c, t, r, x, *_ in turns:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0, r.encode(), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()), (r, x)))
    own = {c: [v for _, v in sorted(rows)] for c, rows in own.items()}
    paths = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(towards_zero(c), [])[:h] + rows[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, subtree = defaultdict(int), defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]] += 1
        for d in range(len(k) + 1):
            subtree[k[:d]].append(k)
    saving = lambda k: (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[x] for x in subtree[k]), sum(map(saving, subtree[k])),
         hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == k))).encode()).hexdigest())
        for k, m in members.items()
    )


def found(spark, turns, parts=None):
    df = spark.createDataFrame(turns, TURNS)
    rows = pt.prefix_trie(pt.forked(pt.turn_keys(df.repartition(parts) if parts else df))).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in rows)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pt, "FAN", 2)
    r = random.Random(8)
    turns = []
    for c in r.sample(range(-60, 140), 130):
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            turns.append((c, r.choice([t, t, t, None, 1]), r.choice(["user", "assistant", None]), r.choice(["a", "a b", " \x0bc\x85d ", None, "", "x y z"])))
    turns += turns[:20]  # rows that repeat
    turns += [(200, t, "user", f"t {t % 7}") for t in range(300)] + [(201, t, "user", f"t {t % 7}") for t in range(290)]  # long ones
    turns += [(None, 0, "user", "no conversation"), (900_000_000_000, 0, "user", "far"), (77_777_777, 5, None, "w " * 100_000)]
    turns = [(*x, "clash", 1, "clash") for x in turns]
    assert found(spark, turns) == brute(turns)


def test_one_conversation_many_times_and_none(spark):
    turns = [(c, t, "user", f"same {t}", "", 0, "") for c in range(0, 100_000, 250) for t in range(4)]
    assert found(spark, turns) == brute(turns)
    assert found(spark, turns[:0]) == [] and found(spark, [(None, 1, "a", "b", "", 0, "")]) == []


def test_partial_tries_hold_few_nodes(monkeypatch):
    monkeypatch.setattr(pt, "HELD", 5)
    rows = [(c, k, 1) for c in range(40) for k in (None, b"a", bytes([c % 3]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 7], strict=True)], ["conv", "key", "words"]) for i in range(0, len(rows), 7)]
    out = [x for b in pt._partial(iter(batches)) for x in b.to_pylist()]
    roots = [x for x in out if x["node"] == pt.ROOT and x["block"] is None]
    assert len(roots) > 5 and sum(x["n"] for x in roots) == 40
    assert sorted(i for x in out if x["block"] is not None for i in x["ids"]) == list(range(40))
