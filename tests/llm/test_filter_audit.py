import random
import re
from collections import Counter
from itertools import permutations

from tidemark.llm.filter_audit import audit, failures

DOCS = "doc_id long, text string, lang string, mask int, n string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every order applied to every document, one after the other."""
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(kept), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    got = audit(failures(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))).collect()
    want = brute(docs, labels)
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == want


def test_against_every_order_applied(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "#", "A B", "w " * 250, "x\x0by\x0cz\rq " * 70, "Ä é ß " * 100, "word\x85word word " * 99]
    texts += [" ".join(r.choice(["a", "B", "Cd", "e#", f"w{r.randrange(400)}"][2 * (k % 2) :]) for _ in range(r.choice([150, 220, 400]))) for k in range(25)]
    texts += [" ".join(f"w{j}" for j in range(k * 3, k * 3 + 240)) for k in range(8)] + [" ".join(f"long{j}" for j in range(60_000))]
    docs = [(r.choice([None, r.randrange(120)]) if k % 9 == 0 else k, r.choice(texts), r.choice(["en", "de", None, ""]), 7, "other") for k in range(220)]
    docs += docs[:15]
    labels = [(r.choice([None, r.randrange(260)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)]
    check(spark, docs, labels)


def test_a_hot_text_and_empty_tables(spark):
    text = " ".join(f"w{j}" for j in range(210))
    check(spark, [(k, text, "en" if k % 3 else "de", 0, "") for k in range(300)], [(k, 1, k % 2) for k in range(0, 300, 2)])
    check(spark, [], [(1, 1, 1)])
    check(spark, [(1, "a", "en", 0, "")], [])
