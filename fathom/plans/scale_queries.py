"""Queries over what spreads one long group over many tasks, prunes by bounds or keeps state: searched indexes, chunks of one
series, prefix sums, as-of merges, outlines, PDF files and online windows."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from fathom.operators import dense_blocks, ordered, outline, search_index
from fathom.operators import timeseries as X
from fathom.plans import retrieval_queries as RQ
from fathom.plans import timeseries_queries as TQ
from fathom.sources import pdf
from fathom.sources.tables import table
from fathom.staging import workspace
from fathom.streaming import online


def _index(spark, sf_dir):
    path = f"{workspace(spark)}/index-{uuid.uuid4().hex}"
    search_index.write_index(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return search_index.open_index(spark, path)


def index_search(spark, sf_dir):
    """The index of all documents is written, opened again and searched for the benchmark's items."""
    hits, _ = search_index.search(_index(spark, sf_dir), RQ._asks(spark, sf_dir), 10)
    return hits.select("query_id", "doc_id", "rank", F.round("bm25", 5).alias("bm25"))


def index_terms(spark, sf_dir):
    """Document frequencies as the index keeps them."""
    return _index(spark, sf_dir).terms.select("term", "df")


def dense_pruned(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asks = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits, _ = dense_blocks.search(dense_blocks.build(v), asks, 10)
    return hits.select("query_id", "vec_id", "rank", F.round("dense", 5).alias("dense"))


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _series(spark, sf_dir):
    """All line items as one series, numbered in an order that tells them apart."""
    li = ordered.numbered(table(spark, sf_dir, "lineitem").select(*_ORDER), _ORDER, "id")
    return li.select(F.lit(1).alias("dataset_id"), "id", F.sqrt("l_extendedprice").alias("anomaly"))


def long_rolling(spark, sf_dir):
    return X.rolling_chunked(_series(spark, sf_dir), size=5000).select("id", F.round("roll", 4).alias("roll"))


def long_best_window(spark, sf_dir):
    hot, calm = (X.best_window_chunked(_series(spark, sf_dir), calm=c, size=5000).select(F.lit(c).alias("calm"), "id", F.round("window_score", 6).alias("window_score")) for c in (False, True))
    return hot.unionByName(calm)


def running_totals(spark, sf_dir):
    """The quantity shipped before each line item, over the whole table."""
    li = table(spark, sf_dir, "lineitem").select(*_ORDER, F.col("l_quantity").cast("long").alias("quantity"))
    return ordered.prefix_sums(li, _ORDER, "quantity").select("l_orderkey", "l_linenumber", "before")


def last_values(spark, sf_dir):
    """The value of a user's last purchase at each of the user's events, as of its time."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
    return ordered.carried(ev, "user_id", ["ts", "event_id"], "paid", "last_paid").select("event_id", F.round("last_paid", 6).alias("last_paid"))


def outline_tree(spark, sf_dir):
    """Conversations as outlines: turn t hangs below turn (t - 1) // 2."""
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2).cast("long"))
    nth = F.when(F.col("turn") > 0, (F.col("turn") - 1) % 2).otherwise(0).cast("int")
    entries = c.select(F.col("conv_id").alias("source"), F.col("turn").alias("entry"), parent.alias("parent"), nth.alias("nth"), F.substring("text", 1, 20).alias("title"), F.col("turn").alias("page_index"))
    path = F.array_join(F.transform("path", lambda p: p["nth"].cast("string")), ".")
    return outline.outline_tree(entries).select("source", "entry", "level", path.alias("path"), "title")


def _made_pdfs(spark, sf_dir):
    """A PDF file for each conversation, a page for each turn, with the users' turns as bookmarks."""
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))

    def run(batches):
        for b in batches:
            made = []
            for turns in b.column(1).to_pylist():
                marks = [(t["text"][:30], None, k) for k, t in enumerate(turns, 1) if t["role"] == "user"]
                made.append(pdf.made_pdf([t["text"] for t in turns], marks))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def pdf_pages(spark, sf_dir):
    return pdf.pages_of(_made_pdfs(spark, sf_dir)).select(F.col("path").cast("long").alias("conv_id"), "page_index", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "error")


def pdf_outline(spark, sf_dir):
    return pdf.outline_of(_made_pdfs(spark, sf_dir)).select(F.col("path").cast("long").alias("conv_id"), "entry", "parent", "nth", "title", "page_index")


def online_best_window(spark, sf_dir):
    """The best windows of all datasets by the stateful operator, which here reads the table as one batch."""
    spark.conf.set(*online.STATE_STORE)
    found = online.best_windows(TQ._parts(spark, sf_dir)[3], close_after_hours=24 * 365 * 100)
    return found.select("dataset_id", "first", "last", "n_rows", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        index_search, index_terms, dense_pruned, long_rolling, long_best_window, running_totals, last_values, outline_tree, pdf_pages, pdf_outline, online_best_window,
    )
}

_SERIES = f"""
s AS (SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS id, sqrt(l_extendedprice) AS anomaly FROM lineitem),
n AS (SELECT *, row_number() OVER (ORDER BY id) AS nth FROM s),
r AS (SELECT *, CASE WHEN nth >= 36 THEN avg(anomaly) OVER (ORDER BY nth ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) END AS roll FROM n)"""
_PDF_TEXT = "regexp_replace(regexp_replace(coalesce(text, ''), '^\\n+', ''), '\\n+$', '')"
ORACLES = {
    "index_search": RQ.ORACLES["bm25_batch"],
    "index_terms": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({RQ.S.terms('text')}) AS term FROM documents) GROUP BY term",
    "dense_pruned": RQ.ORACLES["dense_batch"],
    "long_rolling": f"WITH {_SERIES} SELECT id, round(roll, 4) AS roll FROM r",
    "long_best_window": f"""WITH {_SERIES},
e AS (SELECT false AS calm, nth AS last, roll FROM r WHERE roll IS NOT NULL QUALIFY row_number() OVER (ORDER BY round(roll, 9) DESC, nth) = 1
  UNION ALL SELECT true, nth, roll FROM r WHERE roll IS NOT NULL QUALIFY row_number() OVER (ORDER BY round(roll, 9), nth) = 1)
SELECT calm, id, round(e.roll, 6) AS window_score FROM e JOIN r ON nth BETWEEN last - 35 AND last""",
    "running_totals": f"""SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::BIGINT) OVER (ORDER BY {', '.join(_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM lineitem""",
    "last_values": """SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS last_paid FROM events""",
    "outline_tree": """WITH RECURSIVE e AS (SELECT conv_id AS source, turn AS entry, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, CASE WHEN turn > 0 THEN (turn - 1) % 2 ELSE 0 END AS nth, substr(text, 1, 20) AS title FROM conversations),
t AS (SELECT source, entry, 1 AS level, nth::VARCHAR AS path, title FROM e WHERE parent IS NULL
  UNION ALL SELECT e.source, e.entry, level + 1, path || '.' || e.nth, e.title FROM e JOIN t ON e.source = t.source AND e.parent = t.entry)
SELECT * FROM t""",
    "pdf_pages": f"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS page_index, md5({_PDF_TEXT}) AS text_md5, NULL::VARCHAR AS error FROM conversations""",
    "pdf_outline": """WITH p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations)
SELECT conv_id, (row_number() OVER w)::INT AS entry, NULL::INT AS parent, (row_number() OVER w - 1)::INT AS nth, substr(coalesce(text, ''), 1, 30) AS title, page::INT AS page_index FROM p WHERE role = 'user'
WINDOW w AS (PARTITION BY conv_id ORDER BY page)""",
    "online_best_window": f"WITH {TQ._HOT} SELECT dataset_id, min(id) AS first, max(id) AS last, any_value(c) AS n_rows, round(any_value(score), 6) AS score FROM wi JOIN (SELECT dataset_id, count(*) AS c FROM an GROUP BY dataset_id) USING (dataset_id) GROUP BY dataset_id",
}
