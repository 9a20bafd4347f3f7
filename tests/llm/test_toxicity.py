"""Toxicity: automata against edit distances by hand, held-out labels, misspellings, quotation and odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import toxicity as tox
from fathom.llm.queries import op11_toxicity


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _fewest(word: str, term: tox.Term) -> int:
    if term.stem:
        return min(_distance(term.text, word[:k]) for k in range(1, len(word) + 1))
    return _distance(term.text, word)


def test_automata_equal_edit_distances():
    draw = random.Random(3)
    terms = (tox.Term("moron"), tox.Term("disgusting"), tox.Term("scum"), tox.Term("oaf"), tox.Term("réeux", True), tox.Term("mob", True))
    words = ["moron", "disgust", "é", "a" * 60, "mobs", "disgusting" + "x" * 30]
    for _ in range(3000):
        w = list(draw.choice(terms).text + draw.choice(["", "s", "ment"]))
        for _ in range(draw.randint(0, 3)):
            i, c = draw.randrange(len(w) + 1), draw.choice("abmorundisgté")
            w[i : i + draw.choice([0, 1, 1])] = draw.choice([[c], []])
        words.append("".join(w) or "x")
    of, edits = tox.Matcher(terms).find(words)
    for word, k, e in zip(words, of, edits):
        near = {n: _fewest(word, t) for n, t in enumerate(terms) if _fewest(word, t) <= t.edits and len(word) <= tox.WIDTH}
        stems = {n: _fewest(word, t) for n, t in enumerate(terms) if t.stem and _fewest(word, t) <= t.edits}
        near |= stems
        assert (k < 0) == (not near), word
        if near:
            assert int(e) == near[int(k)] == min(near.values()), word


def _predicted(spark, model, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in tox.predict(docs, model).collect()}


@pytest.fixture(scope="module")
def labelled(spark):
    """Small talk, with terms of abuse in every fifth document."""
    draw = random.Random(7)
    plain = [a + b for a in ("ta", "no", "mel", "ri", "sov") for b in ("ran", "ki", "lot", "me", "du", "sten")]
    plain += [a + b for a in plain for b in ("ve", "lis", "on")]
    rows, labels = [], []
    for i in range(600):
        words = [draw.choice(plain) for _ in range(draw.randint(20, 60))]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(["blockhead", "grublick", "nastor" + draw.choice(plain)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("term", F.lit(1))
    return docs, spark.createDataFrame([*labels, (9999, 1), (None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("blockhead"))


@pytest.fixture(scope="module")
def model(labelled):
    return tox.fit(*labelled)


def test_lexicon_is_found(model):
    assert {(t.text, t.stem) for t in model.terms} >= {("blockhead", False), ("grublick", False), ("nastor", True)} and len(model.terms) < 6


def test_held_out_labels(labelled, model):
    docs, labels = labelled
    rows = tox.predict(docs, model).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").where("held_out and label is not null").collect()
    assert len(rows) > 100 and np.mean([r["predicted"] == r["label"] for r in rows]) > 0.98


def test_misspellings_and_quotation(spark, model):
    plain = "tame noki melran rilot sovdu tasten " * 3
    got = _predicted(spark, model, [
        plain, plain + "you blockhead you grublick", plain + "you blokhead you grubblick nastorme", plain + "you bl*ckhead, you g.r.u.b.l.i.c.k!",
        plain + 'he said "blockhead grublick" and wrote', "", None, " \x85 ",
    ])
    assert [got[k]["predicted"] for k in (0, 1, 2, 3, 5, 6, 7)] == [0, 1, 1, 1, 0, 0, 0]
    assert got[5]["score"] == got[6]["score"] == got[7]["score"] == got[0]["score"]
    assert got[1]["score"] > got[4]["score"] and max(h["factor"] for h in got[4]["hits"]) < 0.5
    assert [(h["term"], h["edits"]) for h in got[2]["hits"]] == [("blockhead", 1), ("grublick", 1), ("nastor", 0)]


def test_factors():
    at = lambda text, word: round(tox.factor(text.split(), text.split().index(word)), 6)
    assert at("a plain fool here", "fool") == 1
    assert at("you fool", "fool") == 1.25
    assert at('they said "what a fool" then', 'fool"') == 0.25
    assert at('"what a day" fool', "fool") == 1
    assert at("«fool», dit elle", "«fool»,") == 0.25


def test_labels_decide_alone(spark, labelled):
    docs, labels = labelled
    assert not tox.fit(docs, labels.where("false")).terms and _predicted(spark, tox.fit(docs, labels.where("false")), ["x"])[0]["score"] == 0
    one = tox.fit(docs, labels.where("toxic = 1"))
    assert not one.terms and _predicted(spark, one, ["x"])[0]["score"] > 0.99
    assert tox.fit(docs.where("false"), labels).terms == ()
    held = labels.where(tox.held_out(F.col("doc_id")))
    assert held.count() > 100 and tox.fit(docs, held).coefficients[0] == -np.inf


def test_table(spark, sf_dir):
    rows = op11_toxicity(spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_empty_and_long(spark, model):
    assert tox.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    got = _predicted(spark, model, ["tame " * 400_000 + "you blockhead you grublick"])
    assert [h["word"] for h in got[0]["hits"]] == [400_001, 400_003]
