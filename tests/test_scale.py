"""What spreads long groups, prunes by bounds or keeps state: against plain versions, and by the form of the plans."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import dense_blocks, geometry, ingest, ordered, outline, retrieval, search_index
from fathom.operators import evaluation as E
from fathom.operators import timeseries as X
from fathom.plans import scoring_queries
from fathom.sources import files, pdf
from fathom.streaming import online, rolling


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


# A searched index


@pytest.fixture(scope="module")
def indexed(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path_factory.mktemp("index") / "x")
    search_index.write_index(docs, path, segment=8)
    return docs, search_index.open_index(spark, path)


def test_search_opens_few_blocks_and_no_text(spark, sf_dir, indexed):
    docs, index = indexed
    asks = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits, opened = search_index.search(index, asks, 3)
    assert "documents.parquet" not in plan(hits)
    want = retrieval.top(retrieval.bm25(docs, asks), 3, "bm25")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["bm25"], 6)) for r in df.collect())
    assert rows(hits) == rows(want)
    counts = opened.collect()
    assert len(counts) == asks.count() and all(0 < r["opened"] <= r["blocks"] for r in counts)
    assert sum(r["opened"] for r in counts) < 0.75 * sum(r["blocks"] for r in counts)


def test_index_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "..."), (4, "beta beta"), (4, "gamma"), (None, "alpha")], "doc_id long, text string")
    search_index.write_index(docs, str(tmp_path / "i"))
    index = search_index.open_index(spark, str(tmp_path / "i"))
    asks = spark.createDataFrame([(1, "beta"), (2, "nothing known"), (3, None), (4, "gamma beta")], "query_id long, query_text string")
    hits, _ = search_index.search(index, asks, 5)
    want = retrieval.top(retrieval.bm25(docs, asks), 5, "bm25").where("doc_id is not null")
    assert sorted((r["query_id"], r["doc_id"], round(r["bm25"], 9)) for r in hits.collect()) == sorted((r["query_id"], r["doc_id"], round(r["bm25"], 9)) for r in want.collect())
    assert index.n == 6 and {r["term"]: r["df"] for r in index.terms.collect()} == {"alpha": 1, "beta": 2, "gamma": 1}
    search_index.write_index(docs.where("false"), str(tmp_path / "e"))
    assert search_index.search(search_index.open_index(spark, str(tmp_path / "e")), asks, 5)[0].count() == 0


def test_blocks_are_not_taken_apart(spark, indexed):
    """No row for each entry of a term, a document and a query is made: blocks meet at their segments."""
    index = indexed[1]
    asks = spark.createDataFrame([(1, "the of"), (2, "of and tion")], "query_id long, query_text string")
    asked = search_index.weighed(index, asks)
    wanted = search_index.bounds(index, asked).select("query_id", "segment")
    found = search_index.score_segments(index, asked, wanted)
    assert "Generate" not in plan(found) and "inline" not in plan(found)
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["bm25"], 6)) for r in df.collect())
    assert rows(found) == rows(retrieval.bm25(indexed[0], asks))
    assert rows(search_index.score_segments(index, asked, wanted.where("query_id = 2"))) == [r for r in rows(found) if r[0] == 2]


def test_ids_that_repeat_in_other_segments_add_up(spark, tmp_path):
    docs = spark.createDataFrame([(k % 5, f"alpha beta {'gamma ' * (k % 4)}") for k in range(12)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "gamma alpha"), (2, "beta")], "query_id long, query_text string")
    search_index.write_index(docs, str(tmp_path / "r"), segment=1)
    index = search_index.open_index(spark, str(tmp_path / "r"))
    hits, _ = search_index.search(index, asks, 9)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["bm25"], 6)) for r in df.collect())
    assert index.repeats and rows(hits) == rows(retrieval.top(retrieval.bm25(docs, asks), 9, "bm25"))


def test_counts_equal_the_joined_form(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    asked = spark.createDataFrame([("the",), ("tion",), ("e1",), ("absent",)], "term string")
    rows = lambda: sorted((r["doc_id"], r["dl"], sorted((h["term"], h["tf"]) for h in r["hits"])) for r in retrieval.indexed(docs, asked).collect())
    few = rows()
    monkeypatch.setattr(retrieval, "FEW_TERMS", 2)
    assert rows() == few


# Dense blocks


def test_best_scores_are_those_of_a_whole_sort():
    draw = np.random.default_rng(2)
    score, ids = np.round(draw.normal(size=(40, 300)), 1), draw.permutation(300)
    score[3], score[4, :7] = 0.0, np.nan
    for k in (1, 10, 300, 400):
        n, at = retrieval._best(score, ids, k)
        want = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, :k]
        assert n.tolist() == np.repeat(np.arange(40), min(k, 300)).tolist() and np.array_equal(ids[at].reshape(want.shape), ids[want])


def test_dense_blocks_are_exact_and_skip(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16)) * 4
    vectors = [(i, (centres[i % 12] + draw.normal(size=16) * 0.3).astype("float32").tolist()) for i in range(3000)] + [(9000, None), (9001, [0.0] * 16), (9002, [0.0] * 16)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asks = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = dense_blocks.build(table, block=64, pivots=24)
    hits, opened = dense_blocks.search(blocks, asks, 5)
    want = retrieval.dense_top(table, asks, 5)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["dense"], 6)) for r in df.collect())
    assert rows(hits) == rows(want)
    n, seen = blocks.count(), [r["opened"] for r in opened.collect()]
    assert n > 40 and np.mean(seen) < 0.4 * n
    assert dense_blocks.search(dense_blocks.build(table.where("false")), asks, 5)[0].count() == 0


# Ordered passes


@pytest.fixture(scope="module")
def uneven(spark):
    """One group holds most rows; keys and values may be null."""
    draw = random.Random(4)
    rows = [(i, draw.choice(["big"] * 20 + ["a", "b", None]), draw.randint(0, 50), draw.choice([None, None, None, draw.randint(0, 9)])) for i in range(4000)]
    return spark.createDataFrame(rows, "id long, g string, at int, v long").repartition(7)


def test_numbers_are_dense(uneven):
    got = ordered.numbered(uneven, ["g", "at", "id"])
    key = lambda r: (r["g"] is not None, r["g"] or "", r["at"], r["id"])
    rows = sorted(got.collect(), key=lambda r: r["number"])
    assert [r["number"] for r in rows] == list(range(4000)) and rows == sorted(rows, key=key)
    assert "Window" not in plan(got) and ordered.numbered(uneven.where("false"), ["id"]).count() == 0


def test_prefix_sums(uneven):
    rows = sorted(ordered.prefix_sums(uneven, ["at", "id"], "v").collect(), key=lambda r: (r["at"], r["id"]))
    total = 0
    for r in rows:
        assert r["before"] == total
        total += r["v"] or 0
    assert len(rows) == 4000


def test_values_are_carried_over_ranges(spark, uneven):
    for parts in ("4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = ordered.carried(uneven.withColumn("v", F.when(F.col("id") % 97 == 0, F.col("v"))), "g", ["at", "id"], "v", "last").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        held: dict = {}
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            held[r["g"]] = r["v"] if r["v"] is not None else held.get(r["g"])
            assert r["last"] == held[r["g"]]


# Long series


def test_chunks_of_one_series_equal_the_plain_form(spark):
    draw = random.Random(6)
    rows = spark.createDataFrame([(draw.choice([1, 1, 1, 1, 2]), i * 3, draw.choice([0.0, 1.0, draw.random()])) for i in range(900)] + [(3, 1, 0.5)], "dataset_id int, id long, anomaly double")
    for n, size in ((36, 50), (7, 7), (1, 100), (60, 10)):
        plain = {(r["dataset_id"], r["id"]): r["roll"] for r in X.rolling(rows, n).collect()}
        got = {(r["dataset_id"], r["id"]): r["roll"] for r in X.rolling_chunked(rows, n, size=size).collect()}
        assert got.keys() == plain.keys() and all((a is None) == (got[k] is None) and (a is None or abs(a - got[k]) < 1e-12) for k, a in plain.items())
        for calm in (False, True):
            key = lambda df: sorted((r["dataset_id"], r["id"], round(r["window_score"], 9)) for r in df.collect())
            assert key(X.best_window_chunked(rows, n, calm, size=size)) == key(X.best_window(rows, n, calm))


def test_one_series_goes_to_many_tasks(spark):
    long_ = spark.range(200_000).select(F.lit(1).alias("dataset_id"), "id", F.rand(1).alias("anomaly"))
    spread = X.rolling_chunked(long_, size=5000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) >= 2 and max(r["count"] for r in spread) < 120_000  # adaptive execution joins small tasks


# Tiles, bands, sections, merging, samples


def test_overlaps_make_few_rows(spark):
    images = spark.createDataFrame([(1, 20_000, 20_000)], "image_id long, width int, height int")
    tiles = geometry.tiles(images, geometry.stride_positions(F.col("width"), 1024, 768), geometry.stride_positions(F.col("height"), 1024, 768))
    draw = random.Random(8)
    boxes = [(1, k, 0, draw.uniform(-50, 20_000), draw.uniform(-50, 20_000), draw.choice([0.0, 5.0, 800.0]), draw.choice([-1.0, 30.0, 2500.0])) for k in range(300)]
    table = spark.createDataFrame(boxes, "image_id long, ann_id long, category_id int, bx double, by double, bw double, bh double")
    grid = [(r["x"], r["y"]) for r in tiles.collect()]
    want = {(k, x, y) for _, k, _, bx, by, bw, bh in boxes for x, y in grid if min(bx + bw, x + 1024) > max(bx, x) and min(by + bh, y + 1024) > max(by, y)}
    met = geometry.overlapping(tiles, table, 1024)
    assert sorted((r["ann_id"], r["x"], r["y"]) for r in met.select("ann_id", "x", "y").collect() if (r["ann_id"], r["x"], r["y"]) in want) == sorted(want)
    assert met.count() < 0.1 * len(grid) * len(boxes) and "CartesianProduct" not in plan(met) and "NestedLoop" not in plan(met)


def test_tiles_are_not_sent_through_the_driver(spark, sf_dir):
    for query in (scoring_queries.bbox_clip, scoring_queries.bbox_shift):
        assert "BroadcastExchange" not in plan(query(spark, sf_dir))


def test_boxes_are_cut_once(spark, sf_dir, monkeypatch):
    seen, real = [], geometry.numbered
    monkeypatch.setattr(geometry, "numbered", lambda rows, *more: seen.append(plan(rows)) or real(rows, *more))
    scoring_queries.bbox_renumber(spark, sf_dir)
    assert ["Generate" in p for p in seen] == [True, False] and "BroadcastExchange" not in seen[0]


def test_pages_within_a_tolerance_meet_by_equality(spark):
    hits = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 9, 2), (1, None, 5, 3), (1, "a", None, 4)], "query_id int, source string, page int, rank int")
    gold = spark.createDataFrame([(1, "a", 4, 2), (1, "a", 6, 1), (1, "a", 8, 3)], "query_id int, source string, page int, gold_no int")
    near, keys = E.page_keys(hits, gold)
    assert sorted((r["rank"], r["item"]) for r in near.collect()) == [(1, "a::p6"), (2, "a::p8")] and keys.count() == 3
    assert "abs(" not in plan(near).split("Physical")[-1]


def test_gold_of_groups_is_that_of_their_queries(spark):
    """Measures with gold by group equal those with gold by query, also for queries of two groups, of an unknown one or of none."""
    draw = random.Random(4)
    asks = spark.createDataFrame([(q, q % 3) for q in range(12)] + [(3, 1), (12, 9), (13, None), (4, 1)], "query_id int, label int")
    members = [(m % 4, draw.randrange(40), draw.choice(["procedure", "changelog", "other", None]), m, f"s{m % 2}", draw.randrange(9)) for m in range(60)]
    few = spark.createDataFrame(members, "label int, item int, kind string, gold_no int, source string, page int")
    hits = spark.createDataFrame([(q, draw.randrange(40), r, f"s{r % 2}", draw.randrange(9)) for q in range(14) for r in range(1, 8)], "query_id int, item int, rank int, source string, page int")
    of, shared = E.gold_groups(asks, few)
    each = asks.distinct().join(few, "label").drop("label")
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(E.ir_metrics(hits, shared, of=of)) == rows(E.ir_metrics(hits, each))
    assert rows(E.simple_metrics(hits, shared, 5, of=of)) == rows(E.simple_metrics(hits, each, 5))
    near, keys = E.page_keys(hits, shared, of=of)
    near_each, keys_each = E.page_keys(hits, each)
    assert rows(near) == rows(near_each) and rows(E.ir_metrics(near, keys, of=of)) == rows(E.ir_metrics(near_each, keys_each))


def test_gold_of_neighbours_grows_with_the_vectors(spark, sf_dir):
    _, gold, of = scoring_queries._neighbours(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert gold.count() == vectors.count() and of.count() == vectors.where("vec_id % 20 = 0").count()


def test_sections_by_one_pass(spark):
    pages = spark.createDataFrame([("m", k, f"t{k}") for k in range(1, 9)] + [("n", 1, "x"), ("n", None, "lost")], "source string, page_index int, text string")
    entries = spark.createDataFrame([("m", 3, "A", 0), ("m", 3, "B", 1), ("m", 6, "C", 2), ("m", 0, "bad", 3), ("n", 5, "late", 0)], "source string, page_index int, title string, entry_no int")
    made = ingest.outline_blocks(pages, entries)
    assert sorted((r["source"], r["block_no"], r["page_index"], r["page_end"], r["heading"], r["text"]) for r in made.collect()) == [("m", 0, 3, 5, "B", "t3 t4 t5"), ("m", 1, 6, 8, "C", "t6 t7 t8")]


def test_merging_streams_over_a_long_manual(spark):
    """Many blocks of one manual: groups end where a fold over them says, with constant state."""
    n = 300_000
    sizes = spark.range(n).select(F.lit("m").alias("source"), F.col("id").alias("block_no"), (F.col("id") % 7 + 1).alias("n"), F.lit(9).alias("letters"), F.when(F.col("id") % 11 == 0, 90).otherwise(10).alias("alnum"))
    got = ingest.merge_groups(sizes).groupBy("group").agg(F.count("*").alias("c"), F.min("block_no").alias("low")).orderBy("group").collect()
    group, tokens, letters, alnum, lows = 0, 0, 0, 0, [0]
    for k in range(n):
        tokens, letters, alnum = tokens + k % 7 + 1, letters + 9, alnum + (90 if k % 11 == 0 else 10)
        if tokens >= 60 and letters / alnum >= 0.6:
            group, tokens, letters, alnum = group + 1, 0, 0, 0
            lows.append(k + 1)
    assert [r["low"] for r in got] == lows[: len(got)] and sum(r["c"] for r in got) == n


def test_samples_sort_no_stratum(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    for total in (0, 1, 37, 10_000):
        taken = {r["p_brand"]: r["taken"] for r in geometry.allocate(parts.groupBy("p_brand").agg(F.count("*").alias("n")), total, "p_brand").collect()}
        got = geometry.stratified_sample(parts, total, "p_partkey", "p_brand", "z")
        rows: dict = {}
        for r in parts.select("p_partkey", "p_brand", F.md5(F.concat(F.lit("z"), F.col("p_partkey").cast("string"))).alias("h")).collect():
            rows.setdefault(r["p_brand"], []).append((r["h"], r["p_partkey"]))
        want = sorted(k for b, own in rows.items() for _, k in sorted(own)[: max(0, taken[b])])
        assert sorted(r["p_partkey"] for r in got.collect()) == want


# Outlines and PDF files


def test_outline_is_depth_first(spark):
    rows = [("a", 1, None, 0, "I", 1), ("a", 2, 1, 0, "I.1", 2), ("a", 3, 2, 0, "I.1.1", 2), ("a", 4, 1, 1, "I.2", 4), ("a", 5, None, 1, "II", 6), ("a", 6, 99, 0, "lost", 7), ("b", 1, None, 0, "only", 1)]
    tree = outline.outline_tree(spark.createDataFrame(rows, "source string, entry int, parent int, nth int, title string, page_index int"))
    got = [(r["title"], r["level"]) for r in sorted(tree.where("source = 'a'").collect(), key=lambda r: r["path"])]
    assert got == [("I", 1), ("I.1", 2), ("I.1.1", 3), ("I.2", 2), ("II", 1)] and tree.count() == 6
    pages = spark.createDataFrame([("a", k, f"p{k}") for k in range(1, 8)], "source string, page_index int, text string")
    blocks = ingest.outline_blocks(pages, outline.outline_sections(tree))
    assert [r["heading"] for r in blocks.orderBy("page_index").collect()] == ["I", "I.1.1", "I.2", "II"]


def test_pdf_files(spark, tmp_path):
    texts = ["Ännern\nsecond (line) \\", "", "漢字 😀\n\nafter a gap"]
    (tmp_path / "good.pdf").write_bytes(pdf.made_pdf(texts, [("Teil 1", None, 1), ("1.1", 0, 2), ("Teil 2", None, 3)]))
    (tmp_path / "broken.PDF").write_bytes(b"no pdf at all")
    (tmp_path / "cut.pdf").write_bytes(pdf.made_pdf(["first", "second"])[:700])
    (tmp_path / "other.txt").write_text("not read")
    found = pdf.pdf_files(spark, str(tmp_path))
    rows = {}
    for r in pdf.pages_of(found).collect():
        rows.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["page_index"], r["text"], r["error"]))
    assert [t for _, t, _ in sorted(rows["good.pdf"])] == texts and len(rows) == 3
    assert rows["broken.PDF"][0][1] is None and "no PDF" in rows["broken.PDF"][0][2]
    marks = sorted(tuple(r)[1:] for r in pdf.outline_of(found).where("path like '%good.pdf'").collect())
    assert marks == [(1, None, 0, "Teil 1", 1), (2, 1, 0, "1.1", 2), (3, None, 1, "Teil 2", 3)]


def test_pdf_syntax():
    """Literal strings, arrays of text with gaps, nested page trees, fonts without a map, inherited resources, object streams."""
    content = b"BT /F1 9 Tf 1 0 0 1 50 700 Tm (A \\(b\\) \\101\\n\\344) Tj [(Wo) -20 (rd) -300 (next)] TJ 0 -12 Td <48 69> Tj (x) ' ET % done"
    packed = b"6 0 7 41 " + b"<< /Kids [8 0 R] /Type /Pages /Count 1 >>" + b"<< /Font << /F1 9 0 R >> >>"
    body = zlib.compress(packed)
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [6 0 R] /Resources 7 0 R >> endobj",
        b"3 0 obj << /Length 4 0 R >> stream\r\n" + content + b"\r\nendstream endobj", b"4 0 obj %d endobj" % len(content),
        b"5 0 obj << /Type /ObjStm /N 2 /First 9 /Filter [/FlateDecode] /Length %d >> stream\n" % len(body) + body + b"\nendstream endobj",
        b"8 0 obj << /Type /Page /Contents [3 0 R] >> endobj", b"9 0 obj << /Type /Font /Subtype /Type1 >> endobj", b"trailer << /Root 1 0 R >>",
    ]
    file = pdf.File(b"%PDF-1.5\n" + b"\n".join(parts))
    assert [file.text(p) for _, p in file.pages()] == ["A (b) A\näWord next\nHi\nx"]
    with pytest.raises(ValueError):
        pdf.File(b"%PDF-1.5\ntrailer << /Encrypt 1 0 R >>")


# Streams


def test_windows_while_readings_arrive(spark, tmp_path):
    """Out of order within the watermark, over many micro-batches; two events of one dataset; an event that never fills a window."""
    draw = random.Random(9)
    hour = 3600
    rows = [(1, k, k * hour, draw.choice([1.0, 2.0, draw.random()])) for k in range(60)] + [(2, k, k * hour, float(k % 5)) for k in range(3)] + [(1, 1000 + k, (400 + k) * hour, draw.random()) for k in range(20)]
    rows += [(9, 1, 5000 * hour, 0.0)]  # moves the watermark
    rows = sorted(rows, key=lambda r: r[2] + draw.randint(0, 90) * 60)
    source = tmp_path / "in"
    for k in range(0, len(rows), 8):
        part = spark.createDataFrame(rows[k : k + 8], "dataset_id int, id long, s long, anomaly double").select("dataset_id", "id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "anomaly")
        part.coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set(*online.STATE_STORE)
    stream = spark.readStream.schema("dataset_id int, id long, ts timestamp, anomaly double").option("maxFilesPerTrigger", 2).parquet(str(source))
    found = online.best_windows(stream, n=5, close_after_hours=48, late="2 hours")
    query = found.writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = {(r["dataset_id"], r["first"]): (r["last"], r["n_rows"], r["score"]) for r in spark.table("events").collect()}
    for dataset, low, high in ((1, 0, 1000), (1, 1000, 2000)):
        own = spark.createDataFrame([(d, i, v) for d, i, _, v in rows if d == dataset and low <= i < high], "dataset_id int, id long, anomaly double")
        best = X.best_window(own, 5).orderBy("id").collect()
        last, n, score = got[dataset, best[0]["id"]]
        assert (last, n) == (best[-1]["id"], own.count()) and abs(score - best[0]["window_score"]) < 1e-9
    assert got[2, None] == (None, 3, None) and len(got) == 3


def test_windowed_sums_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, 1.0), ("a", 1800, 3.0), ("b", 0, 5.0), ("a", 7300, 7.0), ("z", 10**6, 0.0)], "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("t"), "v").write.parquet(source)
    stream = spark.readStream.schema("k string, t timestamp, v double").parquet(source)
    found = rolling.windowed(stream, "k", "t", "v", "1 hour", "1 hour")
    query = found.writeStream.format("memory").queryName("sums").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r["k"], r["n"], r["mean"], r["greatest"]) for r in spark.table("sums").collect()) == [("a", 1, 7.0, 7.0), ("a", 2, 2.0, 3.0), ("b", 1, 5.0, 5.0)]


def test_embedded_csv_of_one_line(spark):
    rows = spark.createDataFrame([("w", "a;b", ";"), ("v", "a;b\n1;2\n", ";"), ("u", None, ";")], "window_id string, csv string, csv_sep string")
    assert [tuple(r) for r in files.embedded_csv(rows, ["a", "b"]).collect()] == [("v", 0, "1", "2")]
