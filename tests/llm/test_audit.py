"""The audit of filters against SQL, brute force over orders, and odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import filter_audit, oracles, queries


def test_equals_sql(equal_to_oracle):
    equal_to_oracle(queries.op12_filter_audit, oracles.ORACLES["op12_filter_audit"])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows and ids, a long text, and columns that clash with internal names."""
    words = " ".join(f"w{k}" for k in range(250))
    rows = [
        (1, words, "en"), (2, words, "en"), (2, words, "en"), (3, words, "de"), (4, None, "en"), (5, "", None), (6, "a b c $", None), (None, words, "en"), (None, "x", ""),
        (7, "ÀB" * 300, "de"), (8, "same " * 400, "de"), (9, "long " * 300_000 + words, "en"), (9, "é\x1c\x85 " + words, "en"), (2, words, "de"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("mask", "n", "part", "digest", "low", "cells", "own", "step", "good", "quality"):
        docs = docs.withColumn(name, F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (4, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("mask", F.lit(3))
    return docs, labels


def _brute(docs, labels):
    def flag(i, k):
        return any(x["doc_id"] == i and x[k] == 1 for x in labels) if i is not None else False

    least = {}
    for r in docs:
        t = r["text"] or ""
        if r["doc_id"] is not None:
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    cells = []
    for r in docs:
        t = r["text"] or ""
        words = t.encode().split()
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": r["doc_id"] is not None and r["doc_id"] > least[t],
        }
        cells.append((r["lang"] or "", fails, flag(r["doc_id"], "quality"), flag(r["doc_id"], "toxic")))
    out = {}
    for part in {c[0] for c in cells}:
        for order in filter_audit.ORDERS:
            left = [c for c in cells if c[0] == part]
            for step, f in enumerate(order, 1):
                gone = [c for c in left if c[1][f]]
                before = [c for c in cells if c[0] == part and c not in left and c[1][f]]
                left = [c for c in left if not c[1][f]]
                only = [c for c in cells if c[0] == part and [k for k, v in c[1].items() if v] == [f]]
                out[part, order, step] = (len(left), len(gone), len(before), len(only), sum(c[2] for c in gone), sum(c[3] for c in gone))
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: v + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_odd_rows_equal_brute_force(odd):
    docs, labels = odd
    found = filter_audit.audit(docs, labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found}
    own = docs.select("doc_id", "text", "lang").collect()
    # rows that are the same in every respect must still be counted one by one
    want = _brute([dict(r.asDict(), nth=k) for k, r in enumerate(own)], labels.collect())
    assert len(found) == len(got) and set(got) == set(want)
    kept = {k: v[0] for k, v in got.items() if k[2] == 5}
    assert all(want[k][0] == v for k, v in kept.items())
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[3:] for k, v in got.items()} == {k: v[3:] for k, v in want.items()}


def test_empty_tables(odd):
    docs, labels = odd
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_counts_of_random_bytes():
    draw = random.Random(5)
    texts = ["".join(draw.choice("aAbB \n\t\x0b\x1fé$|漢") for _ in range(draw.choice([0, 1, 5, 90, 4000]))) for _ in range(300)] + [None]
    made = filter_audit.scan(pa.array(texts).slice(1), filter_audit.Scanner())
    for k, t in enumerate(texts[1:]):
        t = t or ""
        words = t.encode().split()
        assert [int(c[k]) for c in made] == [len(words), len(set(words)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With a base of 1 words of the same letters collide; bytes decide then."""
    monkeypatch.setattr(filter_audit, "_BASE", 1)
    scanner = filter_audit.Scanner()
    data = "ab ba ab abcdefghij abcdefghji ab".encode()
    assert int(scanner.count(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))[1][0]) == 4
