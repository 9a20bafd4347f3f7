"""Ranges of documents from which the blocks of an index are made."""

from collections import Counter

from pyspark.sql import functions as F

from fathom.operators import search_index


def _written(spark, rows, path):
    search_index.write_index(spark.createDataFrame(rows, "doc_id long, text string"), path)
    return search_index.open_index(spark, path)


def test_ranges_hold_about_as_many_entries_though_documents_differ(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "RANGE", 5_000, raising=False)
    monkeypatch.setattr(search_index, "ROW", 32, raising=False)
    words = [20] * 1000 + [1500] * 20  # the long documents stand together at the end of the order
    rows = [(k, "the the " + " ".join(f"w{(k * 7 + j) % 4000}" for j in range(n))) for k, n in enumerate(words)]
    index = _written(spark, rows, f"file://{tmp_path}/index")
    held = [r[1] for r in index.blocks.groupBy(F.shiftright("segment", 33)).agg(F.sum("docs")).collect()]
    assert sum(held) == sum(words) + len(words)
    assert len(held) >= 9 and max(held) < 2 * 5_000
    most = index.blocks.groupBy("segment").agg(F.max("docs").alias("n")).agg(F.max("n")).first()[0]
    assert most == search_index.SEGMENT  # every document has "the", and a segment so many documents


def test_odd_documents_count_as_they_did(spark, tmp_path):
    rows = [(1, "a b a"), (1, "a b a"), (2, None), (3, ""), (4, "!!"), (None, "a z"), (5, "B c"), (6, " ".join(f"t{j}" for j in range(600)))]
    index = _written(spark, rows, f"file://{tmp_path}/index")
    want = Counter({"a": 2, "b": 3, "c": 1} | {f"t{j}": 1 for j in range(600)})
    assert {r["term"]: r["df"] for r in index.terms.collect()} == want
    assert (index.n, index.repeats) == (8, True)
    found = {tuple(sorted(zip(r["ids"], r["tfs"], r["dls"]))) for r in index.blocks.where("term in ('a', 'c', 't7')").collect()}
    assert found == {((1, 2, 3), (1, 2, 3)), ((5, 1, 2),), ((6, 1, 600),)}
    empty = _written(spark, [], f"file://{tmp_path}/empty")
    assert empty.terms.count() == 0 and empty.n == 0
