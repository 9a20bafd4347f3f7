"""Small cases of the semantics that are easy to get wrong."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import evaluation, geometry, ingest, retrieval, timeseries
from fathom.operators import timeseries as X
from fathom.plans import timeseries_queries as TQ
from fathom.sources import files
from fathom.streaming import rolling


def values(spark, expression, items, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v"))).collect()]


def test_headings(spark):
    lines = ["12 rotor blades", "3.1 Scope", "IV. Tools", "A. Parts", "Tab. 1 values", "Table 1 values", "Fig. 2", "SAFETY FIRST", "ABCDEF", "2020-01-02 log", "Page 3 of 9", "12345678", "AB-CD-EF", "Contents ..... 7", "plain words", "", None]
    want = [True, True, True, True, True, False, True, True, False, False, False, False, False, False, False, False]
    assert values(spark, lambda c: T.is_heading(F.coalesce(c, F.lit(""))), lines)[:16] == want


def test_normalize(spark):
    assert values(spark, T.normalize, [" a\r\n\r\nb \u007f c\t\td ", None, ""]) == ["a\nb c d", "", ""]


def test_terms_keep_order_and_priority(spark):
    assert values(spark, lambda c: T.simple_terms(c, 4), ["The blade and leading edge erosion"]) == [["leading edge", "blade leading", "edge erosion", "blade"]]


def test_angles(spark):
    rows = spark.createDataFrame([(350.0, 10.0), (20.0, 360.0), (-340.0, 20.0)], "a double, b double")
    assert [r[0] for r in rows.select(timeseries.angle_diff(F.col("a"), F.col("b"))).collect()] == [20.0, 20.0, 0.0]


def test_numbers(spark):
    assert values(spark, timeseries.whole, ["7", "7.9", "x", None, "NaN"]) == [7, 7, None, None, None]


@pytest.mark.parametrize("n,want", [(100, [(0, 100)]), (450, [(0, 450)]), (1000, [(0, 450), (380, 450), (760, 240)]), (830, [(0, 450), (380, 450)])])
def test_sliding_chunks_cover_their_block(spark, n, want):
    text = " ".join(f"w{k}" for k in range(n))
    blocks = spark.createDataFrame([("m", 0, 1, 1, None, text)], "source string, block_no int, page_index int, page_end int, heading string, text string")
    chunks = [r["text"].split() for r in ingest.chunk_blocks(blocks).orderBy("chunk_index").collect()]
    assert [(int(c[0][1:]), len(c)) for c in chunks] == want


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        ingest.chunk_blocks(None, size=10, overlap=10)


def test_clean_pages(spark):
    pages = spark.createDataFrame([("m", k, f"Running title\nPage {k} of 9\nbody {k}") for k in range(5)] + [("n", 0, "Running title")], "source string, page_index int, text string")
    assert sorted((r["source"], r["text"]) for r in ingest.clean_pages(pages).collect()) == [("m", f"body {k}") for k in range(5)] + [("n", "Running title")]


def test_pages_and_outline(spark):
    raw = "lost\nSOURCE_PDF: a.pdf\n=== OUTLINE_SECTION: lost ===\n=== PAGE 1 ===\n=== OUTLINE_SECTION: One ===\nfirst\n=== PAGE 2 ===\nsecond"
    manuals = spark.createDataFrame([("m", raw), ("n", "no pages")], "source string, text string")
    got = sorted((r["source"], r["page_index"], r["text"], r["outline_section"], r["source_pdf"]) for r in ingest.parse_pages(manuals).fillna(-1, ["page_index"]).collect())
    assert got == [("m", 1, "first", "One", "a.pdf"), ("m", 2, "second", None, "a.pdf"), ("n", -1, "no pages", None, None)]
    pages = ingest.parse_pages(manuals).where("source = 'm'")
    blocks = ingest.outline_blocks(pages, ingest.page_outline(pages)).collect()
    assert [(b["page_index"], b["page_end"], b["heading"], b["text"]) for b in blocks] == [(1, 2, "One", "first second")]


def test_merge_carries_until_full(spark):
    blocks = spark.createDataFrame([("m", k, k, k, h, t) for k, (h, t) in enumerate([(None, "a b"), ("H", "c d"), ("I", "e"), ("J", "1 2 3 4 5")])], "source string, block_no int, page_index int, page_end int, heading string, text string")
    got = [(r["heading"], r["text"], r["page_index"], r["page_end"]) for r in ingest.merge_blocks(blocks, least_tokens=3).orderBy("block_no").collect()]
    assert got == [("H", "a b c d", 0, 1), ("I", "e 1 2 3 4 5", 2, 3)]


def test_constant_wind_has_a_flat_model(spark):
    rows = spark.createDataFrame([(1, 5.0, 10.0), (1, 5.0, 20.0), (2, 1.0, None), (3, 1.0, 3.0), (3, 2.0, 5.0)], "dataset_id int, wind double, power double")
    got = {r["dataset_id"]: (round(r["slope"], 6), round(r["intercept"], 6)) for r in timeseries.power_model(rows).collect()}
    assert got == {1: (0.0, 15.0), 2: (0.0, 0.0), 3: (2.0, 1.0)}


def test_windows_are_reused_when_classes_run_short(spark):
    rows = [(1, 10, {c: 1.0 for c in timeseries.CLASSES}), (2, 20, {c: 0.5 for c in timeseries.CLASSES})]
    scored = spark.createDataFrame(rows, "dataset_id int, end_id int, scores map<string,double>")
    got = timeseries.window_ids(timeseries.select_windows(scored, 1)).orderBy("class_no").collect()
    assert [r["window_id"] for r in got] == ["WF-A-1-10", "WF-A-2-20", "WF-A-1-10-1", "WF-A-1-10-2", "WF-A-1-10-3"]


def test_grids(spark):
    one = spark.createDataFrame([(2500,), (900,)], "w int")
    got = [list(r) for r in one.select(geometry.stride_positions(F.col("w"), 1024, 1024), geometry.plain_positions(F.col("w"), 1024), geometry.fixed_positions(F.col("w"), 1000, 3, True), geometry.overlapping_positions(F.col("w"))).collect()]
    assert got == [[[0, 1024, 1476], [0, 1024], [0, 750, 1500], [0, 819, 1476]], [[0], [0], [0, -50, 0], [0, 0, 0]]]


def test_scores_of_sets(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "x", 1)], "query_id int, item string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y"), (3, "z")], "query_id int, item string")
    got = {r["query_id"]: (r["recall"], r["precision"], r["mrr"], round(r["ndcg"], 4)) for r in evaluation.ir_metrics(hits, gold).collect()}
    assert got == {1: (0.5, 0.5, 0.5, 0.3869), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_label_sets_of_the_recorded_run(spark):
    rows = [(1, ["a"], ["a"]), (2, ["a", "b"], ["a", "Uncertain"]), (3, ["a"], ["Uncertain"]), (4, None, [" ", "b"])]
    prepared = evaluation.abstain(spark.createDataFrame(rows, "id int, gold_labels array<string>, pred_labels array<string>"))
    got = {r["mode"]: (r["num_samples"], r["skipped"], r["exact"]) for r in evaluation.set_metrics(prepared).collect()}
    assert got == {"strict": (4, 0, 0.25), "abstain_penalize": (4, 0, 0.25), "abstain_skip": (3, 1, 1 / 3)}
    pairs = {(r["gold"], r["pred"]): r["n"] for r in evaluation.confusion_labels(prepared).where("mode = 'abstain_penalize'").collect()}
    assert pairs == {("a", "a"): 2, ("b", "a"): 1, ("a", "<none>"): 1}


def test_few_shot_choice():
    e = lambda kind, *c: {"example_type": kind, "findings": [{"category_name": x} for x in c]}
    pool = [e("damage", "x", "y"), e("no_damage"), e("no_damage"), e("no_damage"), e("invalid"), e("damage", "z"), e("damage", "x")]
    assert evaluation.pick_examples(pool, 6) == [pool[1], pool[2], pool[4], pool[5], pool[6], pool[0]]


def test_ranking_ties_and_empty_queries(spark):
    docs = spark.createDataFrame([(2, "wind power"), (1, "wind power"), (3, ""), (4, None)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "Wind wind"), (2, "none")], "query_id long, query_text string")
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.top(retrieval.bm25(docs, asks), 5, "bm25").orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_sensor_files(spark, tmp_path):
    (tmp_path / "7.csv").write_text("time_stamp;asset_id;id;train_test;status_type_id;wind;more\n2020-01-01 00:10:00;1;5;train;0.0;3.5;x\nbad;1;6;prediction;;oops;x\n")
    got = [(r["dataset_id"], r["id"], str(r["ts"]), r["status_type_id"], r["wind"]) for r in files.sensor_rows(spark, str(tmp_path), ["wind"]).orderBy("id").collect()]
    assert got == [(7, 5, "2020-01-01 00:10:00", 0, 3.5), (7, 6, "None", None, None)]


def test_coco_namespaces(spark, tmp_path):
    one = {"images": [{"id": 1, "file_name": "x/A.jpg", "width": 9, "height": 9}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1], "area": 1}], "categories": [{"id": 2, "name": "c"}]}
    two = {"images": [{"id": 1, "file_name": "B.jpg", "width": 9, "height": 9}, {"id": 2, "file_name": "a.JPG", "width": 9, "height": 9}], "annotations": [{"id": 2, "image_id": 2, "category_id": 2, "bbox": [0, 0, 1, 1], "area": 1}], "categories": []}
    (tmp_path / "1.json").write_text(json.dumps(one))
    (tmp_path / "2.json").write_text(json.dumps(two))
    images, boxes, categories = files.coco(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in images.collect()) == ["B.jpg", "x/A.jpg"]
    assert [r["ann_id"] for r in boxes.collect()] == [1] and [r["name"] for r in categories.collect()] == ["c"]


def test_manuals_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("m", 1, "one", "S"), ("m", 2, "two", None)], "source string, page_index int, text string, outline_section string")
    files.write_manuals(pages, str(tmp_path / "out"))
    back = ingest.parse_pages(files.manuals(spark, str(tmp_path / "out")))
    assert sorted((r["page_index"], r["text"], r["outline_section"]) for r in back.collect()) == [(1, "one", "S"), (2, "two", None)]


def test_stream_of_running_means(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rolling.running_mean(stream, "user_id", "event_id", "value", 5).writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    s = timeseries.Sensors(dataset="user_id", pos="event_id")
    want = {r["event_id"]: r["roll"] for r in timeseries.rolling(events, 5, s, "value").collect()}
    got = {r["event_id"]: r["roll"] for r in spark.table("rolled").collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def test_blend_without_positive_scores(spark):
    """A side whose greatest score is not positive counts nothing, and documents without a common term fill up the hits."""
    docs = spark.createDataFrame([(k,) for k in range(1, 7)], "doc_id long")
    dense = spark.createDataFrame([(1, 3, -0.5), (1, 4, -0.1)], "query_id long, doc_id long, dense double")
    lexical = spark.createDataFrame([(1, 5, 2.0), (1, 6, 1.0)], "query_id long, doc_id long, bm25 double")
    hits = retrieval.blend(dense, lexical, docs, 5).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in hits] == [(5, 0.3), (6, 0.15), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_dense_top_of_odd_vectors(spark):
    vectors = spark.createDataFrame([(2**53 + 1, [1.0, 0.0]), (2**53 + 3, [0.0, 2.0]), (7, None)], "vec_id long, embedding array<float>")
    asks = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"], r["dense"], r["rank"]) for r in retrieval.dense_top(vectors, asks, 2).orderBy("rank").collect()]
    assert got == [(1, 2**53 + 3, 2.0, 1), (1, 2**53 + 1, 1.0, 2)] and retrieval.dense_top(vectors, asks.limit(0), 2).count() == 0


def test_many_asked_terms_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([("a",), ("c",)], "term string")
    read = lambda: sorted((r["doc_id"], r["dl"], sorted((h["term"], h["tf"]) for h in r["hits"])) for r in retrieval.indexed(docs, asked).collect())
    few = read()
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    assert few == read() == [(1, 3, [("a", 2)]), (2, 0, []), (3, 0, []), (4, 1, [("c", 1)])]


def test_scans_of_documents(spark, sf_dir):
    """One scan of the documents for scores, and one of the pages for cleaning."""
    from fathom.plans import retrieval_queries, text_queries

    for query in (retrieval_queries.bm25_topk, text_queries.clean_pages, text_queries.merge_small_blocks):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan, query


def test_noise_of_whole_texts_is_that_of_lines(spark):
    lines = ["Page 3 of 9", "  12 / 40 ", "1234567", "see www.a.org 3/7", "text", "\u00a0page 2\u2003", "12/", "www.a.org", "  indented 5 / 6", "", "x page 3"]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    kept = df.select(T.normalize(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~T.is_noise(x)), "\n")).alias("a"), T.normalize(T.without_noise(F.col("text"))).alias("b")).first()
    assert kept["a"] == kept["b"]


def test_hashed_vectors(spark):
    import math

    from fathom.operators import embedding

    texts = ["Blade crack, blade!", "yaw", None, "yaw crack"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = embedding.hashed_model(docs, size=64)
    tf = model.stages[0]
    counts = []
    for text in texts:
        own = {}
        for w in (text or "").lower().replace(",", " ").replace("!", " ").split():
            own[tf.indexOf(w)] = own.get(tf.indexOf(w), 0) + 1
        counts.append(own)
    idf = {k: math.log((len(texts) + 1) / (sum(k in c for c in counts) + 1)) for c in counts for k in c}
    for r in embedding.hashed_vectors(docs, model).collect():
        want = [counts[r["doc_id"]].get(k, 0) * idf.get(k, 0) for k in range(64)]
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(r["embedding"], want))
    lengths = embedding.embed(docs, lambda: lambda batch: [[len(t), 0.0] for t in batch]).collect()
    assert [list(r["embedding"]) for r in lengths] == [[1, 0], [1, 0], [0, 0], [1, 0]]


def test_metrics_are_rounded_as_in_sql(spark, duck):
    """Ties in decimal form, which lie beside them as doubles, and negative numbers that become zero."""
    cells = [k * 0.00036 / 36 + 0.00005 for k in range(0, 40_000, 7)] + [-0.00004, -0.0, 0.0, 0.00004, -0.00005, -2.00005, 1e12 + 0.5, float("nan"), None]
    want = [r[0] for r in duck.execute("SELECT round(unnest(?::DOUBLE[]), 4)::VARCHAR", [cells]).fetchall()]
    got = values(spark, lambda c: X.rounded(c, 4), cells, "double")
    assert [repr(g) if g is not None else None for g in got] == [repr(float(w)) if w is not None else None for w in want]


def test_prompts_keep_the_sign_of_zero(spark, duck, tmp_path):
    """A series of sf0.1 whose mean residual is a little less than zero."""
    spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_suppkey = 41").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in TQ.summary_prompts(spark, str(tmp_path)).collect()]
    sql = TQ.ORACLES["summary_prompts"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == duck.execute(sql).fetchall() and "power_residual_mean=-0.0," in got[0][1]


def test_cards_of_payloads(spark, tmp_path):
    """A card from embedded text equals one from rows, and lists with its class."""
    import json
    from datetime import datetime, timedelta

    from fathom.operators import cards

    names = [n for n in dict.fromkeys([*X.Sensors().features, "wind_dir", "nacelle_dir"])]
    start = datetime(2024, 1, 1)
    rows = [(1, k, start + timedelta(minutes=10 * k), k % 3, *(float((k * (j + 3)) % 17) for j in range(len(names)))) for k in range(120)]
    df = spark.createDataFrame(rows, "dataset_id long, id long, ts timestamp_ntz, status_type_id int, " + ", ".join(f"{n} double" for n in names))
    ends = spark.createDataFrame([("WF-A-1-110-1", 1, start + timedelta(minutes=1100))], "window_id string, dataset_id long, end_time timestamp_ntz")
    payloads = cards.window_payloads(df, ends, ["ts", "status_type_id", *names], 10, 2)
    meta = F.create_map(F.lit("asset_id"), F.lit("7"), F.lit("event_label"), F.lit("x"))
    card = json.loads(cards.payload_cards(payloads.withColumn("meta", meta), "ts").first()["card"])
    near = df.where("id between 50 and 110")
    model = X.power_model(near)
    want = X.tags(X.window_metrics(near.where("id >= 98"), X.baseline(near, model), model)).first()
    assert card["window"] == {"end_time": "2024-01-01 18:20:00", "start_time": "2024-01-01 16:20:00", "row_count": 13, "baseline_hours": 10, "window_hours": 2}
    assert card["stats"] == {k: want[k] for k in X.STATS if want[k] is not None} and card["tags"] == want["tags"] and card["source"] == {"asset_id": "7"}
    assert card["derived"]["power_residual_mean"] == want["power_residual_mean"] and card["derived"]["status_10min_interval_counts"] == want["status_counts"]
    folder = str(tmp_path / "cards")
    files.write_records(spark.createDataFrame([("WF-A-1-110-1", json.dumps(card))], "window_id string, card string"), folder, "card", "_card")
    assert json.loads(spark.read.text(f"{folder}/window=WF-A-1-110-1_card").first()[0]) == card
    read = spark.createDataFrame([("WF-A-1-110-1", None, {"window_hours": 2.0, "end_time": "2024-01-01 18:20:00"}, ["t"]), ("W-2", {"event_label": "stop", "window_end": "e"}, {}, [])], "window_id string, source struct<window_end: string, event_label: string, event_description: string>, window struct<start_time: string, end_time: string, window_hours: double>, tags array<string>")
    classes = spark.createDataFrame([("LE;ER", "WF-A-1-110")], "class_code string, window_id string")
    got = {r["id"]: r for r in cards.listing(read, classes).collect()}
    assert got["WF-A-1-110-1"][1:4] == ("LE;ER", "2024-01-01 16:20:00", "2024-01-01 18:20:00") and got["WF-A-1-110-1"]["event_label_display"] == "no recorded anomaly"
    assert got["W-2"][1:4] == ("", "", "e") and got["W-2"]["event_label_display"] == "stop"


def test_class_maps_and_confusions(spark, tmp_path):
    import json

    from fathom.operators import cards

    picked = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (1, 1, "c")], "class_no int, nth int, window_id string")
    by = cards.by_class(picked).withColumn("class_code", F.concat(F.lit("C"), "class_no"))
    files.write_class_map(by, str(tmp_path / "map"))
    assert json.loads(spark.read.text(str(tmp_path / "map")).first()[0]) == {"C0": ["a", "b"], "C1": ["c"]}
    rows = cards.manifest(picked, spark.createDataFrame([("a", 7)], "window_id string, asset_id int")).collect()
    assert [(r["window_id"], r["file"], r["meta"]["asset_id"]) for r in rows] == [("a", "a.json", 7)]
    cells = spark.createDataFrame([("x", "y", 2), ("y", "y", 1)], "gold string, pred string, n long")
    files.write_confusion(cells, ["x", "y"], str(tmp_path / "m"), spark.createDataFrame([("y", 1, 2, 0, 0)], "label string, tp long, fp long, fn long, tn long"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert text[0].replace("\\", "").replace('"', "") == "goldpred,x,y,TP,FP,FN,TN" and text[1:] == ["x,0,2,0,0,0,0", "y,0,1,1,2,0,0"]


def test_errors_stay_with_their_case(spark):
    cases = spark.createDataFrame([(1, "q", "A", ["g"]), (2, " ", "A", ["g"]), (3, "q", "B", []), (4, "q", "B", ["g"])], "query_id int, query_text string, class_label string, gold array<string>")
    metrics = spark.createDataFrame([(1, 1.0), (2, 0.5)], "query_id int, recall double")
    got = {r["query_id"]: (r["error"], r["recall"]) for r in evaluation.isolated(cases, metrics).collect()}
    assert got == {1: (None, 1.0), 2: ("no query text", None), 3: ("no gold", None), 4: ("no metrics", None)}
    assert spark.createDataFrame([(" a ",), ("",), (None,)], "l string").select(evaluation.label_set(evaluation.one_label(F.col("l")))).collect() == [(["a"],), ([],), ([],)]


def test_description_prompts(spark):
    from fathom.operators import prompts

    examples = spark.createDataFrame([(1, "a.jpg", [("LE;ER", "worn edge"), ("LE;CR", "")], "A worn edge."), (2, "b.jpg", [], "")], "nth int, path string, findings array<struct<category_name: string, image_description: string>>, gold_text string")
    asks = spark.createDataFrame([("q", "q.jpg", ["t1", "t2"]), ("r", "r.jpg", None)], "image string, path string, tiles array<string>")
    got = {r["image"]: r for r in prompts.description_prompts(asks, examples, "Describe.", ["Be exact."], ["LE;ER"], "JSON only.").collect()}
    assert got["q"]["prompt"] == "\n".join([
        "Describe.", "", "Categories:", "- 0: LE;ER", "", "Rules:", "- Be exact.", "", "Example 1:", "- Image: <example_1>", "Findings:", "- LE;ER: worn edge", "- LE;CR", "Expected output:", '{"description":"A worn edge."}', "",
        "Example 2:", "- Image: <example_2>", "", "Query:", "- <query_full>", "- <query_tile_1>", "- <query_tile_2>", "", "JSON only.",
    ])
    assert [(a["label"], a["path"]) for a in got["r"]["attachments"]] == [("example_1", "a.jpg"), ("example_2", "b.jpg"), ("query_full", "r.jpg")]
    answers = ['{"description": "x"}', "[1]", "no json", '{"other": 1}', '{"description": 3}', None]
    errors = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").select("k", prompts.answer_errors(F.col("a")).alias("e")).orderBy("k").collect()
    assert [r["e"] for r in errors] == [[], ["answer: not an object"], ["answer: not an object"], ["description: missing"], ["description: not a text"], ["answer: not an object"]]
