"""Queries over retrieval: benchmark items ask for documents, vectors for vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import retrieval as R
from fathom.plans import sql_text as S
from fathom.sources.tables import table
from fathom.staging import staged

_ONE = "the power deficit of the onand therein and the tion tion"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _asks(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def bm25_stats(spark, sf_dir):
    return R.corpus_stats(_docs(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_postings(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    asked = R.query_terms(_asks(spark, sf_dir)).select("term").distinct()
    return R.term_idf(R.postings(R.indexed(docs, asked)), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    one = spark.createDataFrame([(0, _ONE)], "query_id long, query_text string")
    hits = R.top(R.bm25(_docs(spark, sf_dir), one), 20, "bm25")
    return hits.select("doc_id", "rank", F.round("bm25", 5).alias("bm25"))


def bm25_batch(spark, sf_dir):
    hits = R.top(R.bm25(_docs(spark, sf_dir), _asks(spark, sf_dir)), 10, "bm25")
    return hits.select("query_id", "doc_id", "rank", F.round("bm25", 5).alias("bm25"))


def _bm25_sql(asks: str) -> str:
    return f"""
asks AS ({asks}),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.terms('query_text')}) AS term FROM asks) GROUP BY ALL),
d AS (SELECT doc_id, {S.terms('text')} AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n),
sc AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM p JOIN i USING (term) JOIN q USING (term), st GROUP BY ALL)"""


_BATCH = "SELECT item_id AS query_id, text AS query_text FROM benchmark"
_TOP = "(row_number() OVER (PARTITION BY query_id ORDER BY round({0}, 9) DESC, {1}))::INT AS rank"


def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = R.dense_top(v, v.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding"), 20)
    return hits.select("vec_id", "rank", F.round("dense", 5).alias("dense"))


def dense_batch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = R.dense_top(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return hits.select("query_id", "vec_id", "rank", F.round("dense", 5).alias("dense"))


def dense_expression(spark, sf_dir):
    """The same product as an expression, for callers that join a few vectors themselves."""
    v = table(spark, sf_dir, "embeddings")
    one = v.where("vec_id = 7").select(F.col("embedding").alias("q"))
    return v.join(F.broadcast(one)).select("vec_id", F.round(R.dot(R.unit(F.col("embedding")), R.unit(F.col("q"))), 5).alias("cosine"))


def _dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _sides(spark, sf_dir):
    """Vectors are dealt out to documents and to benchmark items by their ids."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = F.lit(v.count())
    docs = _docs(spark, sf_dir).withColumn("vec_id", F.col("doc_id") % n).join(v, "vec_id").drop("vec_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "safety").when(F.col("doc_id") % 3 == 1, "definition").otherwise("other")
    source = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Synthetic "), "source")).otherwise(F.col("source"))
    docs = staged(docs.select("doc_id", source.alias("source"), kind.alias("chunk_kind"), "embedding"), "documents")
    asks = _asks(spark, sf_dir)
    asked = asks.withColumn("vec_id", F.col("query_id") % n).join(v, "vec_id").select("query_id", "embedding")
    dense = R.dense_top(docs, asked, 50, "doc_id")
    return docs, dense, R.bm25(_docs(spark, sf_dir), asks.select("query_id", "query_text"))


def _hybrid(spark, sf_dir, preset, *columns):
    docs, dense, lexical = _sides(spark, sf_dir)
    hits = R.blend(dense.drop("rank"), lexical, docs.select("doc_id", *columns), 10, preset)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, R.LIBRARY)


def hybrid_weighted(spark, sf_dir):
    return _hybrid(spark, sf_dir, R.Preset(synthetic=0.6, boosts=R.SERVICE.boosts), "source", "chunk_kind")


def hybrid_kind_filter(spark, sf_dir):
    return _hybrid(spark, sf_dir, R.Preset(kinds=("safety", "inspection")), "chunk_kind")


def _hybrid_sql(weight: str = "1.0", where: str = "true") -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding, count(*) OVER () AS n FROM embeddings),
documents2 AS (SELECT d.doc_id, v.embedding FROM documents d JOIN v ON vec_id = d.doc_id % n),
{_bm25_sql(_BATCH)},
qa AS (SELECT query_id, embedding AS q FROM asks JOIN v ON vec_id = query_id % n),
dn AS (SELECT query_id, doc_id, {_dot_sql('embedding', 'q')} AS dense FROM documents2, qa),
dt AS (SELECT * FROM (SELECT *, {_TOP.format('dense', 'doc_id')} FROM dn) WHERE rank <= 50),
ds AS (SELECT query_id, doc_id, CASE WHEN max(dense) OVER w > 0 THEN dense / max(dense) OVER w ELSE 0 END AS d FROM dt WINDOW w AS (PARTITION BY query_id)),
bs AS (SELECT query_id, doc_id, bm25, CASE WHEN max(bm25) OVER w > 0 THEN bm25 / max(bm25) OVER w ELSE 0 END AS b FROM sc WINDOW w AS (PARTITION BY query_id)),
al AS (SELECT qa.query_id, d.doc_id, coalesce(bs.bm25, 0) AS bm25 FROM qa CROSS JOIN documents d LEFT JOIN bs ON bs.query_id = qa.query_id AND bs.doc_id = d.doc_id),
bt AS (SELECT query_id, doc_id FROM (SELECT *, {_TOP.format('bm25', 'doc_id')} FROM al) WHERE rank <= 50),
c AS (SELECT query_id, doc_id FROM ds UNION SELECT query_id, doc_id FROM bt),
k AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'safety' WHEN 1 THEN 'definition' ELSE 'other' END AS kind FROM c),
s AS (SELECT query_id, doc_id, (0.7 * coalesce(d, 0) + 0.3 * coalesce(b, 0)) * {weight} AS score FROM k LEFT JOIN ds USING (query_id, doc_id) LEFT JOIN bs USING (query_id, doc_id) WHERE {where}),
r AS (SELECT *, {_TOP.format('score', 'doc_id')} FROM s)
SELECT query_id, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10"""


def must_exclude(spark, sf_dir):
    hits = R.top(R.bm25(_docs(spark, sf_dir), _asks(spark, sf_dir)), 10, "bm25").join(_docs(spark, sf_dir), "doc_id")
    hits = hits.withColumn("section", F.concat(F.lit("Part "), "source"))
    return R.must_exclude(hits, ["PART", "the"], ["course", "src1 "]).select("query_id", "doc_id", "rank")


def prompt_text(spark, sf_dir):
    hits = R.top(R.bm25(_docs(spark, sf_dir), _asks(spark, sf_dir)), 10, "bm25").join(_docs(spark, sf_dir), "doc_id")
    hits = hits.withColumn("section", F.lit(None).cast("string")).withColumn("page", F.col("doc_id")).withColumn("page_end", F.lit(None).cast("long"))
    return R.prompt_lines(hits, 3).select("query_id", F.md5("prompt").alias("prompt_md5"))


def query_text_assembly(spark, sf_dir):
    """query, must and should terms joined by spaces."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    terms = T.simple_terms(F.col("text"), 6)
    return c.select("conv_id", "turn", R.query_text(F.col("text"), F.slice(terms, 1, 3), F.slice(terms, 4, 3)).alias("query"))


def chunk_lookup(spark, sf_dir):
    """Documents as chunks, asked for by the ids of benchmark items, of which one is unknown."""
    docs, asks = _docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), F.col("item_id") * 7).alias("chunk_id"))
    chunks = docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "source", F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1).alias("page_end"), F.lit(None).cast("string").alias("section"), F.lit("other").alias("chunk_kind"), "text")
    return R.chunk_details(chunks, asks.unionByName(spark.createDataFrame([("none",)], "chunk_id string"))).select("chunk_id", "found", "source", "page", "page_end", "chunk_kind", F.md5("text").alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_stats, bm25_postings, bm25_topk, bm25_batch, dense_topk, dense_batch, dense_expression, hybrid_topk, hybrid_weighted, hybrid_kind_filter, must_exclude, prompt_text,
        query_text_assembly, chunk_lookup,
    )
}

_BOOST = "CASE kind WHEN 'safety' THEN 1.2 WHEN 'definition' THEN 0.5 ELSE 1.0 END"
ORACLES = {
    "bm25_stats": f"SELECT count(*) AS n, round(avg(len({S.terms('text')})), 6) AS avgdl FROM documents",
    "bm25_postings": f"WITH {_bm25_sql(_BATCH)} SELECT term, df, round(idf, 6) AS idf FROM i",
    "bm25_topk": f"WITH {_bm25_sql(f'SELECT 0 AS query_id, {S.quoted(_ONE)} AS query_text')}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} FROM sc) SELECT doc_id, rank, round(bm25, 5) AS bm25 FROM r WHERE rank <= 20",
    "bm25_batch": f"WITH {_bm25_sql(_BATCH)}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} FROM sc) SELECT query_id, doc_id, rank, round(bm25, 5) AS bm25 FROM r WHERE rank <= 10",
    "query_text_assembly": f"""WITH src AS (SELECT conv_id * 1000 + turn AS id, '' AS kind, text FROM conversations WHERE role = 'user'), {S.term_tables('src')}
SELECT id // 1000 AS conv_id, id % 1000 AS turn, {S.strip('text')} || CASE WHEN len(terms) > 0 THEN ' ' || array_to_string(terms[1:6], ' ') ELSE '' END AS query FROM src JOIN tt USING (id)""",
    "chunk_lookup": """WITH a AS (SELECT DISTINCT 'c' || item_id * 7 AS chunk_id FROM benchmark UNION SELECT 'none')
SELECT chunk_id, doc_id IS NOT NULL AS found, coalesce(source, '') AS source, coalesce(doc_id, 0) AS page, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 ELSE coalesce(doc_id, 0) END AS page_end,
CASE WHEN doc_id IS NOT NULL THEN 'other' END AS chunk_kind, md5(coalesce(text, '')) AS text_md5 FROM a LEFT JOIN documents ON chunk_id = 'c' || doc_id""",
    "dense_topk": f"""WITH s AS (SELECT 7 AS query_id, e.vec_id, {_dot_sql('e.embedding', 'q.embedding')} AS dense FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
r AS (SELECT *, {_TOP.format('dense', 'vec_id')} FROM s) SELECT vec_id, rank, round(dense, 5) AS dense FROM r WHERE rank <= 20""",
    "dense_batch": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_dot_sql('e.embedding', 'q.embedding')} AS dense FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q),
r AS (SELECT *, {_TOP.format('dense', 'vec_id')} FROM s) SELECT query_id, vec_id, rank, round(dense, 5) AS dense FROM r WHERE rank <= 10""",
    "dense_expression": f"""SELECT e.vec_id, round({_dot_sql('e.embedding', 'q.embedding')} / sqrt({_dot_sql('e.embedding', 'e.embedding')}) / sqrt({_dot_sql('q.embedding', 'q.embedding')}), 5) AS cosine
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q""",
    "hybrid_topk": _hybrid_sql(),
    "hybrid_weighted": _hybrid_sql(f"CASE WHEN doc_id % 4 = 0 THEN 0.6 ELSE 1.0 END * {_BOOST}"),
    "hybrid_kind_filter": _hybrid_sql(where="kind IN ('safety', 'inspection')"),
    "must_exclude": f"""WITH {_bm25_sql(_BATCH)}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} FROM sc)
SELECT query_id, doc_id, rank FROM r JOIN documents USING (doc_id) WHERE rank <= 10 AND contains(lower('part ' || source || ' ' || text), 'the')
AND NOT contains(lower('part ' || source || ' ' || text), 'course') AND NOT contains(lower('part ' || source || ' ' || text), 'src1 ')""",
    "prompt_text": f"""WITH {_bm25_sql(_BATCH)}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} FROM sc),
l AS (SELECT query_id, rank, '[' || source || ' p.' || doc_id || '-? ]' || chr(10) || substr(text, 1, 1800) AS line FROM r JOIN documents USING (doc_id) WHERE rank <= 3)
SELECT query_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY rank)) AS prompt_md5 FROM l GROUP BY query_id""",
}
