"""Queries over vectors by a caller's model, cases with errors and the listing of cards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fathom.operators import cards as C
from fathom.operators import embedding as M
from fathom.operators import evaluation as E
from fathom.sources.tables import table

_LETTERS = "ñéßw"


def _letter_model():
    """A model for a query: which of a few letters a text has."""
    return lambda texts: np.array([[c in t for c in _LETTERS] for t in texts], dtype=np.float64).reshape(len(texts), len(_LETTERS))


def embedded_texts(spark, sf_dir):
    docs = M.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), _letter_model)
    return docs.select("doc_id", *(F.round(F.col("embedding")[k].cast("double"), 4).alias(f"v{k}") for k in range(len(_LETTERS))))


def isolated_cases(spark, sf_dir):
    """Orders as cases: some without a text, some without gold, some without metrics; the others go on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), "o_orderpriority", "o_totalprice")
    k = F.col("query_id")
    gold = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 11 == 0, F.lit(None)).otherwise(F.array(F.lit("g")))
    cases = o.select(k, F.when(k % 7 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("query_text"), F.substring("o_orderpriority", 1, 1).alias("class_label"), gold.alias("gold"))
    metrics = o.where(k % 3 != 0).select(k, F.round("o_totalprice", 2).alias("recall"))
    return E.isolated(cases, metrics).select("query_id", "class_label", "error", "recall")


def card_listing(spark, sf_dir):
    """Suppliers as cards; every other one has a class, of itself or of its base id, some lack a start or an end."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    id_ = F.concat(F.lit("W-F-A-"), (k % 40).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("-"), k.cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string"))))
    at = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + k * 3600), "yyyy-MM-dd HH:mm:ss")
    window = F.struct(F.when(k % 3 != 0, at).alias("end_time"), F.when(k % 5 != 0, at).otherwise("").alias("start_time"), F.lit(6).alias("window_hours"))
    source = F.struct(
        F.when(k % 4 != 0, at).alias("window_end"), F.when(k % 6 == 0, "anomaly").when(k % 6 == 1, "normal").alias("event_label"),
        F.when(k % 2 == 0, "nan").when(k % 7 == 0, none).otherwise(F.col("s_name")).alias("event_description"),
    )
    cards = table(spark, sf_dir, "supplier").select(id_.alias("window_id"), window.alias("window"), source.alias("source"), F.array("s_name").alias("tags"))
    classes = spark.range(0, 40, 3).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("class_code"), F.concat(F.lit("W-F-A-"), F.col("id").cast("string")).alias("window_id"))
    return C.listing(cards, classes).select("id", "class_code", "window_start", "window_end", F.col("tags")[0].alias("tag"), "event_label", "event_label_display", "event_description")


QUERIES = {f.__name__: f for f in (embedded_texts, isolated_cases, card_listing)}

_COUNTS = ", ".join(f"contains(t, '{c}')::INT AS c{k}" for k, c in enumerate(_LETTERS))
_NORM = "sqrt(" + " + ".join(f"c{k} * c{k}" for k in range(len(_LETTERS))) + ")"
ORACLES = {
    "embedded_texts": f"""WITH d AS (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, {', '.join(f"round(coalesce(c{k} / nullif({_NORM}, 0), 0), 4) AS v{k}" for k in range(len(_LETTERS)))} FROM d""",
    "isolated_cases": """WITH c AS (SELECT o_orderkey AS query_id, left(o_orderpriority, 1) AS class_label, o_totalprice AS p, CASE WHEN o_orderkey % 7 = 0 THEN 'no query text'
  WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'no gold' WHEN o_orderkey % 3 = 0 THEN 'no metrics' END AS error FROM orders)
SELECT query_id, class_label, error, CASE WHEN error IS NULL THEN round(p, 2) END AS recall FROM c""",
    "card_listing": """WITH s AS (SELECT s_suppkey AS k, s_name, strftime(to_timestamp(1600000000 + s_suppkey * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS t,
  strftime(to_timestamp(1600000000 + (s_suppkey - 6) * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS early FROM supplier)
SELECT 'W-F-A-' || k % 40 || CASE WHEN k % 2 = 0 THEN '-' || k ELSE 'x' || k END AS id, CASE WHEN k % 2 = 0 AND k % 40 % 3 = 0 THEN 'c' || k % 40 ELSE '' END AS class_code,
  CASE WHEN k % 5 <> 0 THEN t WHEN k % 3 <> 0 OR k % 4 <> 0 THEN early ELSE '' END AS window_start, CASE WHEN k % 3 <> 0 OR k % 4 <> 0 THEN t ELSE '' END AS window_end, s_name AS tag,
  CASE WHEN k % 6 = 0 THEN 'anomaly' ELSE 'normal' END AS event_label, CASE WHEN k % 6 = 0 THEN 'anomaly' ELSE 'no recorded anomaly' END AS event_label_display,
  CASE WHEN k % 2 = 0 OR k % 7 = 0 THEN '' ELSE s_name END AS event_description FROM s""",
}
