"""Queries over evaluation, geometry and query packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import evaluation as E
from fathom.operators import geometry as G
from fathom.operators import querypack as Q
from fathom.operators import retrieval as R
from fathom.plans import sql_text as S
from fathom.sources.tables import table

_MEASURES = ("recall", "precision", "hit", "mrr", "ndcg", "weighted_recall")


def _neighbours(spark, sf_dir):
    """Neighbours of the vectors whose id is divisible by 20; gold is all vectors of its label, kept by label."""
    v = table(spark, sf_dir, "embeddings")
    asks = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    hits = R.dense_top(v, asks, 10).select("query_id", F.col("vec_id").alias("item"), "rank")
    kind = F.when(F.col("vec_id") % 3 == 0, "procedure").when(F.col("vec_id") % 3 == 1, "changelog").otherwise("other")
    few = v.select("label", F.col("vec_id").alias("item"), kind.alias("kind"), F.col("vec_id").alias("gold_no"))
    of, gold = E.gold_groups(asks, few)
    return hits, gold, of


_NEAR = """
hits AS (SELECT query_id, item, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 10),
few AS (SELECT * FROM (SELECT label, vec_id AS item, CASE vec_id % 3 WHEN 0 THEN 'procedure' WHEN 1 THEN 'changelog' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS gold_no FROM embeddings)),
gold AS (SELECT q.vec_id AS query_id, few.item, kind, gold_no FROM embeddings q JOIN few USING (label) WHERE q.vec_id % 20 = 0)"""


def _metrics_sql(hits: str, gold: str, weight: str, digits: int | None = 6) -> str:
    """Measures of deduplicated hits and gold (query_id, item[, rank]), rounded unless digits is None."""
    shown = _MEASURES if digits is None else [f"round({m}, {digits}) AS {m}" for m in _MEASURES]
    return f"""
fh AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank, item) AS place FROM (SELECT query_id, item, min(rank) AS rank FROM {hits} GROUP BY ALL)),
fg AS (SELECT query_id, item, max({weight}) AS w FROM {gold} GROUP BY ALL),
nh AS (SELECT query_id, count(*) AS n_got FROM fh GROUP BY ALL),
mm AS (SELECT fg.query_id, count(*) AS n_gold, count(place) AS n_hits, min(place) AS best, sum(1 / log2(place + 1)) AS dcg, sum(w) AS wa, sum(w) FILTER (place IS NOT NULL) AS wh
  FROM fg LEFT JOIN fh USING (query_id, item) GROUP BY fg.query_id),
rs AS (SELECT query_id, n_hits, n_hits / n_gold AS recall, coalesce(n_hits / nullif(n_got, 0), 0) AS precision, (n_hits > 0)::INT::DOUBLE AS hit, coalesce(1 / best, 0) AS mrr,
  coalesce(dcg / list_sum(list_transform(range(1, greatest(least(n_gold, coalesce(n_got, 0)), 1) + 1), lambda k: 1 / log2(k + 1))), 0) AS ndcg, coalesce(wh, 0) / wa AS weighted_recall FROM mm LEFT JOIN nh USING (query_id))
SELECT query_id, n_hits, {', '.join(shown)} FROM rs"""


def _shown(metrics):
    return metrics.select("query_id", "n_hits", *(F.round(m, 6).alias(m) for m in _MEASURES))


def ir_metrics_strict(spark, sf_dir):
    hits, gold, of = _neighbours(spark, sf_dir)
    return _shown(E.ir_metrics(hits, gold, of=of))


def ir_metrics_group(spark, sf_dir):
    """Vectors' source is their id by 25: hits and gold count by source."""
    hits, gold, of = _neighbours(spark, sf_dir)
    by = F.floor(F.col("item") / 25)
    return _shown(E.ir_metrics(hits.withColumn("item", by), gold.drop("kind").withColumn("item", by), of=of))


def ir_metrics_proximity(spark, sf_dir):
    """Source is the id by 25 and page its remainder; a page off still counts."""
    hits, gold, of = _neighbours(spark, sf_dir)
    placed = {"source": F.floor(F.col("item") / 25).cast("string"), "page": F.col("item") % 25}
    return _shown(E.ir_metrics(*E.page_keys(hits.withColumns(placed), gold.withColumns(placed), of=of), of=of))


def ir_metrics_section(spark, sf_dir):
    """Vectors stand for chunks of a source and a section."""
    place = [F.concat(F.lit("m"), F.floor(F.col("item") / 25).cast("string")).alias("source"), F.concat(F.lit("S"), (F.col("item") % 5).cast("string")).alias("section")]
    hits, gold, of = _neighbours(spark, sf_dir)
    return _shown(E.ir_metrics(E.section_keys(hits.select("query_id", "rank", *place)), E.section_keys(gold.select("label", *place)), of=of))


def simple_metrics(spark, sf_dir):
    hits, gold, of = _neighbours(spark, sf_dir)
    m = E.simple_metrics(hits, gold, 5, of=of)
    return m.select(F.round("precision_at_k", 6).alias("precision_at_k"), F.round("mrr", 6).alias("mrr"))


def mean_metrics(spark, sf_dir):
    hits, gold, of = _neighbours(spark, sf_dir)
    m = E.ir_metrics(hits, gold, of=of).withColumn("class_label", (F.col("query_id") % 30).cast("string"))
    out = E.mean_metrics(m, ["recall", "mrr"])
    return out.select("class_label", "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def _label_rows(spark, sf_dir):
    """Labels against a guess from the text's length and the label's own rest, with some abstentions."""
    lb, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lb.join(d, "doc_id")
    gold = F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic "), F.when(F.col("doc_id") % 7 == 0, "SF;PO"))
    pred = F.array(F.when(F.col("n_chars") > 900, "good"), F.when(F.col("n_chars") % 5 == 0, "toxic"), F.when(F.col("doc_id") % 4 == 0, "Uncertain"), F.lit(""))
    return j.select(F.col("doc_id").alias("id"), F.array_compact(gold).alias("gold_labels"), F.array_compact(pred).alias("pred_labels"))


_PREPARED = """
r AS (SELECT doc_id AS id, list_sort(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 7 = 0 THEN 'SF;PO' END], lambda x: x IS NOT NULL)) AS gold,
  list_sort(list_filter([CASE WHEN n_chars > 900 THEN 'good' END, CASE WHEN n_chars % 5 = 0 THEN 'toxic' END, CASE WHEN doc_id % 4 = 0 THEN 'Uncertain' END], lambda x: x IS NOT NULL)) AS raw FROM labels JOIN documents USING (doc_id)),
m AS (SELECT *, unnest(['strict', 'abstain_penalize', 'abstain_skip']) AS mode, list_filter(raw, lambda x: x <> 'Uncertain') AS sure FROM r),
p AS (SELECT mode, id, gold, CASE WHEN mode = 'strict' THEN raw ELSE sure END AS pred, mode = 'abstain_skip' AND list_contains(raw, 'Uncertain') AND len(sure) = 0 AS skipped FROM m),
k AS (SELECT * FROM p WHERE NOT skipped),
c AS (SELECT mode, label, count(*) FILTER (g AND q) AS tp, count(*) FILTER (q AND NOT g) AS fp, count(*) FILTER (g AND NOT q) AS fn FROM
  (SELECT mode, label, list_contains(gold, label) AS g, list_contains(pred, label) AS q FROM (SELECT mode, gold, pred, unnest(list_distinct(list_concat(gold, pred))) AS label FROM k)) GROUP BY ALL),
s AS (SELECT c.*, n - tp - fp - fn AS tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c JOIN (SELECT mode, count(*) AS n FROM k GROUP BY mode) USING (mode)),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM s)"""


def abstain_modes(spark, sf_dir):
    p = E.abstain(_label_rows(spark, sf_dir))
    return p.select("mode", "id", F.array_join("gold", "|").alias("gold"), F.array_join("pred", "|").alias("pred"), "skipped")


def label_counts(spark, sf_dir):
    c = E.label_counts(E.abstain(_label_rows(spark, sf_dir)))
    return c.select("mode", "label", "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


def multilabel_metrics(spark, sf_dir):
    m = E.set_metrics(E.abstain(_label_rows(spark, sf_dir)))
    return m.select("mode", "num_samples", "skipped", *(F.round(x, 6).alias(x) for x in ("coverage", "exact", "micro_precision", "micro_recall", "micro_f1", "macro_f1")))


def confusion_sets(spark, sf_dir):
    return E.confusion_sets(E.abstain(_label_rows(spark, sf_dir)))


def confusion_labels(spark, sf_dir):
    return E.confusion_labels(E.abstain(_label_rows(spark, sf_dir)))


def confusion_matrix(spark, sf_dir):
    one = E.confusion_labels(E.abstain(_label_rows(spark, sf_dir))).where("mode = 'strict'")
    wide = E.as_matrix(one, ["SF;PO", "good", "toxic", "Uncertain", "<none>"])
    return wide.select("gold", F.col("`SF;PO`").alias("p_sfpo"), F.col("good").alias("p_good"), F.col("toxic").alias("p_toxic"), F.col("Uncertain").alias("p_uncertain"), F.col("`<none>`").alias("p_none"))


def _images(spark, sf_dir):
    """Parts play images of some thousand pixels."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 60 + 900).cast("int").alias("width"), (F.col("p_partkey") % 1500 + 1100).cast("int").alias("height"))


def _boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ann = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(
        F.col("l_partkey").alias("image_id"), ann.alias("ann_id"), (F.col("l_linenumber") % 5).cast("int").alias("category_id"), (F.col("l_orderkey") % 2000).cast("double").alias("bx"),
        (F.col("l_suppkey") * 13 % 1500).cast("double").alias("by"), (F.col("l_quantity") * 8 + 0.5).alias("bw"), (F.col("l_linenumber") * 40).cast("double").alias("bh"),
    )


_SHAPES = """
images AS (SELECT p_partkey AS image_id, (p_size * 60 + 900)::INT AS width, (p_partkey % 1500 + 1100)::INT AS height FROM part),
boxes AS (SELECT l_partkey AS image_id, l_orderkey * 10 + l_linenumber AS ann_id, (l_linenumber % 5)::INT AS category_id, (l_orderkey % 2000)::DOUBLE AS bx, (l_suppkey * 13 % 1500)::DOUBLE AS by_,
  l_quantity * 8 + 0.5 AS bw, (l_linenumber * 40)::DOUBLE AS bh FROM lineitem),
xs AS (SELECT image_id, x, row_number() OVER (PARTITION BY image_id ORDER BY x) - 1 AS col FROM (SELECT image_id, unnest(range(0, greatest(width - 1024, 0) + 1, 768)) AS x FROM images
  UNION SELECT image_id, width - 1024 FROM images WHERE (greatest(width - 1024, 0) // 768) * 768 + 1024 < width)),
ys AS (SELECT image_id, y, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS row_ FROM (SELECT image_id, unnest(range(0, greatest(height - 1024, 0) + 1, 768)) AS y FROM images
  UNION SELECT image_id, height - 1024 FROM images WHERE (greatest(height - 1024, 0) // 768) * 768 + 1024 < height)),
tiles AS (SELECT images.*, row_, col, x, y FROM images JOIN xs USING (image_id) JOIN ys USING (image_id)),
hit AS (SELECT image_id, row_, col, ann_id, category_id, greatest(bx, x) AS x1, greatest(by_, y) AS y1, least(bx + bw, x + 1024) AS x2, least(by_ + bh, y + 1024) AS y2, x, y FROM tiles JOIN boxes USING (image_id)
  WHERE x + 1024 <= width AND y + 1024 <= height),
cut AS (SELECT image_id, row_::INT AS "row", col::INT AS col, ann_id, category_id, x1 - x AS bx, y1 - y AS "by", x2 - x1 AS bw, y2 - y1 AS bh, (x2 - x1) * (y2 - y1) AS area FROM hit WHERE x2 > x1 AND y2 > y1)"""


def _tiles(spark, sf_dir):
    return G.tiles(_images(spark, sf_dir), G.stride_positions(F.col("width"), 1024, 768), G.stride_positions(F.col("height"), 1024, 768))


def tile_grid(spark, sf_dir):
    return _tiles(spark, sf_dir).select("image_id", "row", "col", "x", "y")


def tile_positions(spark, sf_dir):
    """The other grids, each as the sum of its positions and their number."""
    w = F.col("width")
    grids = {"plain": G.plain_positions(w, 512), "top_left": G.fixed_positions(w, 1024, 5), "spread": G.fixed_positions(w, 800, 3, True), "overlapping": G.overlapping_positions(w)}
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return _images(spark, sf_dir).select("image_id", *(total(a).cast("long").alias(f"{n}_sum") for n, a in grids.items()), *(F.size(a).cast("long").alias(f"{n}_n") for n, a in grids.items()))


def tile_names(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    name = lambda **k: G.tile_name(F.concat(F.lit("DJI_"), F.col("image_id").cast("string")), F.lit(".JPG"), F.col("row") * 10 + F.col("col"), F.col("row"), F.col("col"), **k)
    named = t.select("image_id", name().alias("by_index"), name(style="index_zero_pad").alias("padded"), name(style="grid_rc", order="row_col").alias("grid"))
    back = G.tile_of(F.col("grid"))
    return named.select("image_id", "by_index", "padded", "grid", back["row"].alias("row"), back["col"].alias("col"))


def bbox_clip(spark, sf_dir):
    return G.clip_boxes(_tiles(spark, sf_dir), _boxes(spark, sf_dir), 1024)


def bbox_renumber(spark, sf_dir):
    clipped = G.clip_boxes(_tiles(spark, sf_dir), _boxes(spark, sf_dir), 1024)
    return G.renumber(clipped).select("image_id", "row", "col", "ann_id", "tile_no", "new_ann_id")


def bbox_shift(spark, sf_dir):
    clipped = G.clip_boxes(_tiles(spark, sf_dir), _boxes(spark, sf_dir), 1024)
    return G.to_full(clipped).select("image_id", "row", "col", "ann_id", "bx", "by")


def bbox_clamp(spark, sf_dir):
    j = _boxes(spark, sf_dir).join(_images(spark, sf_dir), "image_id")
    args = [F.col(c) for c in ("bx", "by", "bw", "bh", "width", "height")]
    return j.select("ann_id", G.clamp_box(*args).alias("a"), G.crop_box(*args, 20).alias("b")).select("ann_id", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("x1", "y1", "x2", "y2")))


def boxes_by_original(spark, sf_dir):
    """Every tile name is an image of its own whose boxes go back to the original."""
    boxes = _boxes(spark, sf_dir)
    images = _images(spark, sf_dir).select("image_id", F.concat(F.lit("DJI_"), (F.col("image_id") % 300).cast("string"), F.lit("_"), (F.col("image_id") % 3).cast("string"), F.lit("_"), (F.col("image_id") % 5).cast("string"), F.lit(".jpg")).alias("file_name"))
    grouped = G.group_by_original(images, boxes)
    return grouped.select("original", F.size("boxes").cast("long").alias("n"), F.round(F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["bx"] + b["by"]), 4).alias("total"))


def category_counts(spark, sf_dir):
    return G.category_counts(_boxes(spark, sf_dir))


def primary_category(spark, sf_dir):
    return G.primary_category(_boxes(spark, sf_dir))


def largest_remainder(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return G.allocate(counts, 137, "p_brand")


def stratified_sample(spark, sf_dir):
    return G.stratified_sample(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), 137, "p_partkey", "p_brand", "7-")


def subset_export(spark, sf_dir):
    """Wanted names are asked for in the order of orders; some are unknown, some come again."""
    images = _images(spark, sf_dir).select("image_id", F.concat(F.lit("a/IMG"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("img"), F.col("o_custkey").cast("string"), F.lit(".JPG")).alias("file_name"))
    return G.subset(images, _boxes(spark, sf_dir), wanted)


def category_images(spark, sf_dir):
    return G.with_category(_images(spark, sf_dir), _boxes(spark, sf_dir), 3, 50).select("image_id", "width")


def path_resolution(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("/F"), (F.col("p_partkey") % 1500).cast("string"), F.lit(".jpg")).alias("path"))
    wanted = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("1/f"), F.col("c_custkey").cast("string"), F.lit(".JPG"))).otherwise(F.concat(F.lit("f"), (F.col("c_custkey") + 300).cast("string"), F.lit(".jpg"))).alias("name"))
    return G.resolve_paths(wanted, files)


def query_pack(spark, sf_dir):
    """Conversations play incidents; every third turn is of the summary, of the images or of the notes."""
    c = table(spark, sf_dir, "conversations")
    said = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 3 == k, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    turns = c.groupBy("conv_id").agg(said(0).alias("summary"), said(1).alias("fault_images_description"), said(2).alias("mechanic_notes"))
    cases = turns.select(
        F.format_string("case-%d", "conv_id").alias("case_id"), F.when(F.col("conv_id") % 2 == 0, "VG;MT").alias("class_label"), F.when(F.col("conv_id") % 3 == 0, "nan").otherwise("pitch fault").alias("event_description"),
        F.array(F.lit("high_wind"), F.lit("case-1")).alias("tags"), "summary", "fault_images_description", "mechanic_notes", *(F.when(F.col("conv_id") % (k + 2) == 0, F.lit(k + 0.5)).alias(m) for k, m in enumerate(Q.METRICS)),
    )
    p = Q.fallback_pack(cases).select("case_id", "pack.*")
    return p.select("case_id", "query", F.array_join("must_terms", "|").alias("must"), F.array_join("should_terms", "|").alias("should"), F.size("extracted_facts.key_metrics").cast("long").alias("n_metrics"))


QUERIES = {
    f.__name__: f
    for f in (
        ir_metrics_strict, ir_metrics_section, ir_metrics_group, ir_metrics_proximity, simple_metrics, mean_metrics, abstain_modes, label_counts, multilabel_metrics, confusion_sets, confusion_labels, confusion_matrix, tile_grid,
        tile_positions, tile_names, bbox_clip, bbox_renumber, bbox_shift, bbox_clamp, boxes_by_original, category_counts, primary_category, largest_remainder, stratified_sample, subset_export, category_images,
        path_resolution, query_pack,
    )
}

_W = "CASE kind WHEN 'procedure' THEN 1.3 WHEN 'changelog' THEN 0.5 ELSE 1.0 END"
_ALLOC = """
n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), r AS (SELECT *, n / sum(n) OVER () * 137 AS raw FROM n),
a AS (SELECT p_brand, n, (floor(raw) + (row_number() OVER (ORDER BY raw - floor(raw) DESC, p_brand DESC) <= 137 - sum(floor(raw)) OVER ())::INT)::BIGINT AS taken FROM r)"""
_SYN = "[" + ", ".join(S.quoted(x) for x in Q.SYNONYMS[: Q.SYNONYM_QUOTA]) + "]"
_PACK = f"""
WITH src AS (SELECT conv_id AS id, ['summary', 'image', 'notes'][turn % 3 + 1] AS kind, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY ALL), {S.term_tables('src')},
c AS (SELECT conv_id AS id, 'case-' || conv_id AS case_id, list_filter(['case-' || conv_id, CASE WHEN conv_id % 2 = 0 THEN 'VG;MT' END, CASE WHEN conv_id % 3 <> 0 THEN 'pitch fault' END, 'high_wind', 'case-1'],
  lambda x: x IS NOT NULL) AS raw FROM (SELECT DISTINCT conv_id FROM conversations)),
k AS (SELECT c.*, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS codes, coalesce(s.terms, [])[1:10] AS scada, coalesce(m.terms, [])[1:10] AS image, coalesce(n.terms, [])[1:10] AS notes FROM c
  LEFT JOIN tt s ON s.id = c.id AND s.kind = 'summary' LEFT JOIN tt m ON m.id = c.id AND m.kind = 'image' LEFT JOIN tt n ON n.id = c.id AND n.kind = 'notes'),
a AS (SELECT *, list_concat(list_concat(list_concat(scada, image), notes), {_SYN}) AS every FROM k)
SELECT case_id, array_to_string(list_filter(['CODES: ' || array_to_string(codes, ' | '), CASE WHEN len(scada) > 0 THEN 'SCADA: ' || array_to_string(scada, ' ; ') END,
  CASE WHEN len(image) > 0 THEN 'VISUAL: ' || array_to_string(image, ' ; ') END, CASE WHEN len(notes) > 0 THEN 'NOTES: ' || array_to_string(notes, ' ; ') END, 'SYNONYMS: ' || array_to_string({_SYN}, ' ; ')],
  lambda x: x IS NOT NULL), '  ||  ') AS query,
  array_to_string(list_filter(codes, lambda x: contains(x, ';') AND length(x) <= 10)[1:3], '|') AS must, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i)[1:20], '|') AS should,
  {' + '.join(f'(id % {k + 2} = 0)::BIGINT' for k in range(len(Q.METRICS)))} AS n_metrics FROM a"""
ORACLES = {
    "query_pack": _PACK,
    "ir_metrics_section": f"""WITH {_NEAR}, h3 AS (SELECT query_id, 'm' || item // 25 || '::S' || item % 5 AS item, rank FROM hits), g3 AS (SELECT query_id, 'm' || item // 25 || '::S' || item % 5 AS item FROM gold),
{_metrics_sql('h3', 'g3', '1.0')}""",
    "ir_metrics_strict": f"WITH {_NEAR}, {_metrics_sql('hits', 'gold', _W)}",
    "ir_metrics_group": f"WITH {_NEAR}, h2 AS (SELECT query_id, item // 25 AS item, rank FROM hits), g2 AS (SELECT query_id, item // 25 AS item FROM gold), {_metrics_sql('h2', 'g2', '1.0')}",
    "ir_metrics_proximity": f"""WITH {_NEAR},
g2 AS (SELECT query_id, (item // 25) || '::p' || (item % 25) AS item, item // 25 AS src, item % 25 AS gp, gold_no FROM gold),
h2 AS (SELECT hits.query_id, arg_min(g2.item, gold_no) AS item, rank FROM hits JOIN g2 ON hits.query_id = g2.query_id AND hits.item // 25 = src AND abs(hits.item % 25 - gp) <= 1 GROUP BY hits.query_id, hits.item, rank),
{_metrics_sql('h2', 'g2', '1.0')}""",
    "simple_metrics": f"""WITH {_NEAR}, p AS (SELECT gold.query_id, count(rank) AS n, min(rank) AS best FROM gold LEFT JOIN (SELECT * FROM hits WHERE rank <= 5) h USING (query_id, item) GROUP BY gold.query_id)
SELECT round(avg(n / 5), 6) AS precision_at_k, round(avg(coalesce(1 / best, 0)), 6) AS mrr FROM p""",
    "mean_metrics": f"""WITH base AS (WITH {_NEAR}, {_metrics_sql('hits', 'gold', _W, None)})
SELECT (query_id % 30)::VARCHAR AS class_label, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM base GROUP BY GROUPING SETS ((), (class_label))""",
    "abstain_modes": f"WITH {_PREPARED} SELECT mode, id, array_to_string(gold, '|') AS gold, array_to_string(pred, '|') AS pred, skipped FROM p",
    "label_counts": f"WITH {_PREPARED} SELECT mode, label, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "multilabel_metrics": f"""WITH {_PREPARED},
t AS (SELECT mode, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS macro_f1 FROM f GROUP BY mode),
u AS (SELECT mode, count(*) FILTER (NOT skipped) AS num_samples, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND gold = pred) AS same FROM p GROUP BY mode),
v AS (SELECT *, tp / (tp + fp) AS mp, tp / (tp + fn) AS mr FROM t JOIN u USING (mode))
SELECT mode, num_samples, skipped, round(num_samples / (num_samples + skipped), 6) AS coverage, round(same / num_samples, 6) AS exact, round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall,
  round(2 * mp * mr / (mp + mr), 6) AS micro_f1, round(macro_f1, 6) AS macro_f1 FROM v""",
    "confusion_sets": f"WITH {_PREPARED} SELECT mode, coalesce(nullif(array_to_string(gold, '|'), ''), '<none>') AS gold, coalesce(nullif(array_to_string(pred, '|'), ''), '<none>') AS pred, count(*) AS n FROM k GROUP BY ALL",
    "confusion_labels": f"""WITH {_PREPARED}, g AS (SELECT mode, unnest(gold) AS gold, CASE WHEN len(pred) = 0 THEN ['<none>'] ELSE pred END AS pred FROM k)
SELECT mode, gold, pred, count(*) AS n FROM (SELECT mode, gold, unnest(pred) AS pred FROM g) GROUP BY ALL""",
    "confusion_matrix": f"""WITH {_PREPARED}, g AS (SELECT unnest(gold) AS gold, CASE WHEN len(pred) = 0 THEN ['<none>'] ELSE pred END AS pred FROM k WHERE mode = 'strict'),
x AS (SELECT gold, unnest(pred) AS pred FROM g), names AS (SELECT unnest(['SF;PO', 'good', 'toxic', 'Uncertain', '<none>']) AS gold)
SELECT names.gold, count(*) FILTER (pred = 'SF;PO') AS p_sfpo, count(*) FILTER (pred = 'good') AS p_good, count(*) FILTER (pred = 'toxic') AS p_toxic, count(*) FILTER (pred = 'Uncertain') AS p_uncertain, count(*) FILTER (pred = '<none>') AS p_none
FROM names LEFT JOIN x USING (gold) GROUP BY names.gold""",
    "tile_grid": f'WITH {_SHAPES} SELECT image_id, row_::INT AS "row", col::INT AS col, x, y FROM tiles',
    "tile_positions": f"""WITH {_SHAPES}, g AS (SELECT image_id, range(0, greatest(width - 512, 0) + 1, 512) AS plain, [0, 1024, 2048, 3072, 4096] AS top_left,
  [0, trunc((width - 800) / 2)::INT, greatest(width - 800, 0)] AS spread, [least(0, greatest(width - 1024, 0)), least(819, greatest(width - 1024, 0)), least(1638, greatest(width - 1024, 0))] AS overlapping FROM images)
SELECT image_id, {', '.join(f'list_sum({n})::BIGINT AS {n}_sum, len({n})::BIGINT AS {n}_n' for n in ('plain', 'top_left', 'spread', 'overlapping'))} FROM g""",
    "tile_names": f"""WITH {_SHAPES} SELECT image_id, 'DJI_' || image_id || '_' || (row_ * 10 + col) || '.JPG' AS by_index, 'DJI_' || image_id || '_' || lpad((row_ * 10 + col)::VARCHAR, 3, '0') || '.JPG' AS padded,
  'DJI_' || image_id || '_' || row_ || '_' || col || '.JPG' AS grid, row_::INT AS "row", col::INT AS col FROM tiles""",
    "bbox_clip": f"WITH {_SHAPES} SELECT * FROM cut",
    "bbox_renumber": f"""WITH {_SHAPES} SELECT image_id, "row", col, ann_id, dense_rank() OVER (ORDER BY image_id, "row", col) - 1 AS tile_no, row_number() OVER (ORDER BY image_id, "row", col, ann_id) - 1 AS new_ann_id FROM cut""",
    "bbox_shift": f"""WITH {_SHAPES} SELECT image_id, "row", col, ann_id, bx + col * 1024 AS bx, "by" + "row" * 1024 AS "by" FROM cut""",
    "bbox_clamp": f"""WITH {_SHAPES}, j AS (SELECT * FROM boxes JOIN images USING (image_id))
SELECT ann_id, greatest(round_even(bx, 0), 0)::INT AS a_x1, greatest(round_even(by_, 0), 0)::INT AS a_y1, least(round_even(bx + bw, 0), width)::INT AS a_x2, least(round_even(by_ + bh, 0), height)::INT AS a_y2,
  greatest(trunc(bx - 20), 0)::INT AS b_x1, greatest(trunc(by_ - 20), 0)::INT AS b_y1, least(trunc(bx + bw + 20), width)::INT AS b_x2, least(trunc(by_ + bh + 20), height)::INT AS b_y2 FROM j""",
    "boxes_by_original": f"""WITH {_SHAPES} SELECT 'DJI_' || (image_id % 300) AS original, count(*) AS n, round(sum(bx + image_id % 5 * 1024 + by_ + image_id % 3 * 1024), 4) AS total FROM boxes JOIN images USING (image_id) GROUP BY 1""",
    "category_counts": f"WITH {_SHAPES} SELECT category_id, count(*) AS n FROM boxes GROUP BY 1",
    "primary_category": f"""WITH {_SHAPES}, c AS (SELECT image_id, category_id, count(*) AS n, min(ann_id) AS f FROM boxes GROUP BY ALL)
SELECT image_id, category_id FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) = 1""",
    "largest_remainder": f"WITH {_ALLOC} SELECT * FROM a",
    "stratified_sample": f"""WITH {_ALLOC}, p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7-' || p_partkey), p_partkey) AS k FROM part)
SELECT p_partkey, p_brand FROM p JOIN a USING (p_brand) WHERE k <= taken""",
    "subset_export": f"""WITH {_SHAPES}, w AS (SELECT o_orderkey AS pos, 'img' || o_custkey || '.JPG' AS file_name, o_custkey AS image, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
b AS (SELECT image_id, count(*) AS n FROM boxes GROUP BY 1)
SELECT pos, file_name, CASE WHEN images.image_id IS NULL THEN 'missing' WHEN k > 1 THEN 'duplicate' ELSE 'found' END AS status, images.image_id, coalesce(b.n, 0) AS n_boxes
FROM w LEFT JOIN images ON image = images.image_id LEFT JOIN b ON b.image_id = images.image_id""",
    "category_images": f"WITH {_SHAPES} SELECT image_id, width FROM images WHERE image_id IN (SELECT image_id FROM boxes WHERE category_id = 3) ORDER BY image_id LIMIT 50",
    "path_resolution": """WITH f AS (SELECT (p_partkey % 3) || '/F' || (p_partkey % 1500) || '.jpg' AS path FROM part), e AS (SELECT lower(path) AS p, min(path) AS exact FROM f GROUP BY 1),
b AS (SELECT lower(string_split(path, '/')[-1]) AS b, min(path) AS one, count(*) AS n FROM f GROUP BY 1),
w AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN '1/f' || c_custkey || '.JPG' ELSE 'f' || (c_custkey + 300) || '.jpg' END AS name FROM customer),
j AS (SELECT name, coalesce(exact, CASE WHEN n = 1 THEN one END) AS path, n FROM w LEFT JOIN e ON lower(name) = p LEFT JOIN b ON lower(string_split(name, '/')[-1]) = b)
SELECT name, path, CASE WHEN path IS NOT NULL THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS reason FROM j""",
}
