"""Scans, sinks and small functions that no query uses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fathom import schemas
from fathom.functions import text as T
from fathom.operators import evaluation as E
from fathom.operators import search_index
from fathom.sources import files, pdf


def test_listing_is_in_order_and_names_all(spark, tmp_path):
    for name in ("b.txt", "a b.PDF", "c.docx", "noend"):
        (tmp_path / name).write_text("x")
    rows = files.manual_listing(spark, str(tmp_path)).orderBy("nth").collect()
    assert [(r["nth"], r["name"], r["kind"]) for r in rows] == [(0, "a b.PDF", "pdf"), (1, "b.txt", "txt"), (2, "c.docx", "unsupported"), (3, "noend", "unsupported")]


def test_manuals_of_both_kinds(spark, tmp_path, caplog):
    (tmp_path / "m.pdf").write_bytes(pdf.made_pdf(["one  two", "three"], [("Teil", None, 2), ("tief", 0, 2)]))
    (tmp_path / "t.txt").write_text("=== PAGE 4 ===\n=== OUTLINE_SECTION: S ===\nbody\n")
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    (tmp_path / "x.csv").write_text("a")
    rows = files.manual_pages(spark, str(tmp_path)).collect()
    assert sorted((r["source"], r["page_index"], r["text"], r["outline_section"] or "") for r in rows) == [("m.pdf", 1, "one two", ""), ("m.pdf", 2, "three", "tief"), ("t.txt", 4, "body", "S")]
    assert "x.csv" in caplog.text and "bad.pdf" in caplog.text


def test_export_keeps_other_manuals(spark, tmp_path):
    page = lambda source, text: spark.createDataFrame([(source, 1, text, None)], "source string, page_index int, text string, outline_section string")
    folder = str(tmp_path / "out")
    files.write_manuals(page("a", "first").unionByName(page("b", "first")), folder)
    files.write_manuals(page("a", "ignored"), folder)
    files.write_manuals(page("b", "second"), folder, overwrite=True)
    read = {r["source"]: r["value"] for r in spark.read.text(folder, wholetext=True).collect()}
    assert "first" in read["a"] and "second" in read["b"] and len(read) == 2


def test_saved_index(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "rotor blade"), ("c2", "tower")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    search_index.save(str(tmp_path / "i"), chunks, vectors, {"model": "m"})
    kept, index, v, config = search_index.load(spark, str(tmp_path / "i"))
    assert kept.count() == 2 and v.count() == 1 and config == {"model": "m"}
    asks = spark.createDataFrame([(1, "blade")], "query_id int, query_text string")
    assert [r["chunk_id"] for r in search_index.search(index, asks, 2)[0].collect()] == ["c1"]
    search_index.save(str(tmp_path / "j"), chunks)
    assert search_index.load(spark, str(tmp_path / "j"))[2:] == (None, {})


def test_json_scans(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"query_id": "q1", "query_text": "x", "relevant_chunk_ids": ["a"]}\n\nnot json\n')
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "gold.jsonl")).select("query_id", "relevant_chunk_ids").collect()] == [("q1", ["a"])]
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1, "b": {"c": ["x"]}}, {"a": 2}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"items": [{"a": 3, "b": {"c": []}}]}))
    form = "a int, b struct<c: array<string>>"
    assert sorted(r["a"] for r in files.json_documents(spark, str(tmp_path / "list.json"), form).collect()) == [1, 2]
    assert [r["a"] for r in files.json_documents(spark, str(tmp_path / "wrapped.json"), form, "items").collect()] == [3]
    files.write_json(spark.range(3).withColumn("p", F.col("id") % 2), str(tmp_path / "out"), "p")
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_event_info(spark, tmp_path):
    head = schemas.EVENT_INFO.replace(" STRING", "").replace(" string", "").split(", ")
    row = {"event_id": "7.0", "asset": "10", "event_label": "anomaly", "event_start_id": "5", "event_end_id": "x"}
    (tmp_path / "e.csv").write_text(";".join(head) + "\n" + ";".join(row.get(c, "") for c in head) + "\n")
    r = files.event_info(spark, str(tmp_path / "e.csv")).first()
    assert (r["event_id"], r["event_label"], r["event_description"], r["first_id"], r["last_id"]) == (7, "anomaly", "nan", 5, None)


def test_paths_and_lists(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jpg").write_bytes(b"1")
    assert [r["path"].rsplit("/", 2)[1:] for r in files.file_paths(spark, str(tmp_path)).collect()] == [["d", "x.jpg"]]
    (tmp_path / "names.txt").write_text(" a.jpg \n\n  \nb.jpg\n")
    assert [r["name"] for r in files.listed_names(spark, str(tmp_path / "names.txt")).collect()] == ["a.jpg", "b.jpg"]
    files.write_labels(spark.createDataFrame([("f", ["b", "a", "b"])], "filename string, pred_labels array<string>"), str(tmp_path / "labels"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "labels")).collect()] == [("f", "a|b")]


def test_small_functions(spark):
    one = spark.createDataFrame([("A b/c.pdf", "key", ["x"], "the leading edge crack")], "name string, k string, items array<string>, text string")
    r = one.select(
        T.source_id(F.col("k"), F.col("name")).alias("id"), T.at_least(F.col("items"), 1, F.col("text")).alias("enough"), T.at_least(F.col("items"), 3, F.col("text")).alias("more"),
        T.first_filled(F.lit(None), F.lit(" \u3000"), F.lit(" z ")).alias("first"), T.strip(F.lit("\u2003\x85 a b\u00a0\n")).alias("bare"),
    ).first()
    assert r["id"].startswith("A_b_c.pdf-") and len(r["id"]) == 18
    assert r["enough"] == ["x"] and r["more"][:2] == ["x", "leading edge"] and r["first"] == "z" and r["bare"] == "a b"
    known = list(E.LABEL_ORDER)
    names = spark.createDataFrame([("zzz",), *((x,) for x in reversed(known)), ("aaa",)], "label string")
    assert [x["label"] for x in names.orderBy(E.label_order(F.col("label"))).collect()] == [*known, "aaa", "zzz"]
