"""Lexical, dense and blended retrieval; all queries of a table are answered in one plan.

Ties are broken by the document's id, ascending. Ranks are partitioned by query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.staging import sized, staged

K1, B = 1.5, 0.75
#: Asked terms that are literals, and blocks of queries that are broadcast, at most.
FEW_TERMS, FEW_BLOCKS = 5_000, 200


@dataclass(frozen=True)
class Preset:
    """How the two rankings are blended and weighed. kinds, if given, are the only ones that may be returned."""

    alpha: float = 0.7
    multiplier: int = 5
    synthetic: float = 0.6
    boosts: dict[str, float] = field(default_factory=dict)
    kinds: tuple[str, ...] = ()


# The weights of the two configurations.
LIBRARY = Preset()
SERVICE = Preset(
    synthetic=1.0,
    boosts={"procedure": 1.3, "checklist": 1.3, "troubleshooting": 1.3, "safety": 1.2, "inspection": 1.1, "training_admin": 0.7, "definition": 0.5, "changelog": 0.5},
)


def _counted(docs: DataFrame, asked: frozenset[str], id: str, text: str) -> DataFrame:
    """id, dl, hits of every document, counted over Arrow batches; a word is what fathom.functions.text.terms() says."""
    kind, word = docs.schema[id].dataType.simpleString(), re.compile("[a-z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [word.findall((t or "").lower()) for t in b.column(1).to_pylist()]
            hits = [[{"term": t, "tf": n} for t, n in Counter(filter(asked.__contains__, words)).items()] for words in found]
            columns = [b.column(0), pa.array(map(len, found), pa.int32()), pa.array(hits, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=[id, "dl", "hits"])

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, dl int, hits array<struct<term: string, tf: bigint>>")


def indexed(docs: DataFrame, asked: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, dl (terms of the document) and hits, an array of (term, tf) for the asked terms (term, distinct) in it.

    One pass over the documents: if few terms are asked for, they go along with the task, which counts them in each text,
    so that only hits leave it. Beyond FEW_TERMS of them they are joined.
    """
    few = [r[0] for r in asked.limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        return _counted(docs, frozenset(few), id, text)
    words = docs.select(id, T.terms(F.col(text)).alias("_words"))
    numbered = words.select(id, "_words", F.size("_words").alias("dl"), F.monotonically_increasing_id().alias("_row"))  # before a row becomes several
    rows = numbered.select(id, "dl", "_row", F.explode_outer("_words").alias("term"))
    kept = rows.join(asked.withColumn("_asked", F.lit(True)), "term", "left").groupBy("_row", id, "dl", "term").agg(F.count_if("_asked").alias("tf"))
    pair = F.when(F.col("tf") > 0, F.struct("term", "tf"))
    return kept.groupBy("_row", id, "dl").agg(F.collect_list(pair).alias("hits")).drop("_row")


def corpus_stats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: n and avgdl; empty documents count."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.terms(F.col(text)))).alias("avgdl"))


def postings(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """term, id, tf, dl from what indexed() has found."""
    return found.select(id, "dl", F.explode("hits").alias("_hit")).select("_hit.term", id, "_hit.tf", "dl")


def term_idf(posts: DataFrame, n: int) -> DataFrame:
    """term, df, idf in a corpus of n documents."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "query_text") -> DataFrame:
    """query, term, qtf: repeats in the query count."""
    return queries.select(query, F.explode(T.terms(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """query, id, bm25 of every document that shares a term with a query. What one pass has found in the documents is
    staged; lengths, document frequencies and scores are made from it."""
    asked = query_terms(queries, query, query_text)
    found = staged(indexed(docs, asked.select("term").distinct(), id, text), "bm25")
    n, avgdl = found.agg(F.count("*"), F.avg("dl")).first()
    posts = postings(found, id)
    tf = F.col("tf")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = posts.join(term_idf(posts, n), "term").select("term", id, weight.alias("w"))
    return scored.join(asked, "term").groupBy(query, id).agg(F.sum(F.col("w") * F.col("qtf")).alias("bm25"))


def top(scores: DataFrame, k: int, score: str, id: str = "doc_id", query: str = "query_id", digits: int = 9) -> DataFrame:
    """The k best of each query with their rank. Scores are compared as rounded, so that ties do not hang on the order of
    additions; nulls come last."""
    order = F.round(score, digits).desc_nulls_last()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(order, F.col(id)))).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _blocks(rows: DataFrame, id: str, vector: str, size: int) -> DataFrame:
    """ids, matrix (binary, rows of doubles) of blocks of at most size vectors; rows without a vector drop out."""
    kind = rows.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            for k in range(0, b.num_rows, size):
                part = vectors.slice(k, size)
                data = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids.slice(k, size).to_pylist()], pa.list_(ids.type)), pa.array([data])], names=["ids", "matrix"])

    return rows.where(F.col(vector).isNotNull()).select(id, vector).mapInArrow(run, f"ids array<{kind}>, matrix binary")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row of score, as rounded, of equals those with the smallest ids: only what
    reaches a row's k-th best is sorted."""
    own = np.nan_to_num(np.round(score, 9), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    floor = np.partition(own, -k, axis=1)[:, -k, None] if own.shape[1] > k else -np.inf
    n, at = np.nonzero(own >= floor)
    order = np.lexsort((ids[at], -own[n, at], n))
    n, at = n[order], at[order]
    first = np.searchsorted(n, np.arange(len(score)))
    kept = np.arange(len(n)) - first[n] < k
    return n[kept], at[kept]


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", query: str = "query_id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """query, id, dense, rank by exact inner product; rows without a vector have no hits.

    Vectors and queries are packed into blocks, and every block of queries meets every block of vectors: queries in
    few blocks are broadcast, so that vectors are read once and not shuffled. Of each pair of blocks the k best of each
    query are kept, and the shuffle sees these alone.
    """
    id_type, query_type = vectors.schema[id].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    asked = staged(_blocks(queries, query, vector, block).select(F.col("ids").alias("asks"), F.col("matrix").alias("asked")), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, asks = np.array(row["ids"]), row["asks"]
                score = np.frombuffer(row["asked"]).reshape(len(asks), -1) @ np.frombuffer(row["matrix"]).reshape(len(ids), -1).T
                n, at = _best(score, ids, k)
                columns = [pa.array([asks[x] for x in n]), pa.array(ids[at]), pa.array(score[n, at])]
                yield pa.RecordBatch.from_arrays(columns, names=[query, id, "dense"])

    pairs = _blocks(vectors, id, vector, 2048).crossJoin(sized(asked, FEW_BLOCKS))
    return top(pairs.mapInArrow(run, f"{query} {query_type}, {id} {id_type}, dense double"), k, "dense", id, query)


def blend(dense: DataFrame, lexical: DataFrame, docs: DataFrame, k: int, preset: Preset = LIBRARY, id: str = "doc_id", query: str = "query_id", total: int | None = None) -> DataFrame:
    """query, id, score, rank of the k best of both rankings.

    dense has query, id, dense; lexical has query, id, bm25; docs has id and, if weights ask for them, source and
    chunk_kind. Each side gives its max(k, k * multiplier) best; a side is divided by its maximum, the lexical one by its
    maximum over the corpus, and counts 0 if that is not positive; a candidate outside the dense list has a dense score
    of 0. Queries are those that dense has. Both sides are staged, so each is searched once.
    """
    dense, lexical, docs = staged(dense, "dense"), staged(lexical, "lexical"), staged(docs, "sides")
    each = max(k, k * preset.multiplier)
    each = each if total is None else min(each, total)
    most = Window.partitionBy(query)
    scaled = lambda c: F.when(F.max(c).over(most) > 0, F.col(c) / F.max(c).over(most)).otherwise(F.lit(0.0))
    d = top(dense, each, "dense", id, query).withColumn("d", scaled("dense")).select(query, id, "d")
    # The lexical maximum is that of the whole corpus, so it is taken before the cut. Documents without a common term
    # have a score of 0 and fill up the candidates, the smallest ids first: of so many one or another is not a hit.
    lex = lexical.withColumn("b", scaled("bm25"))
    first = [r[0] for r in docs.select(id).distinct().orderBy(id).limit(2 * each).collect()]
    fill = dense.select(query).distinct().select(query, F.explode(F.lit(first)).alias(id)).join(lex.select(query, id), [query, id], "left_anti")
    near = top(lex.select(query, id, "bm25").unionByName(fill.withColumn("bm25", F.lit(0.0))), each, "bm25", id, query).select(query, id)
    both = d.select(query, id).unionByName(near).distinct()
    joined = both.join(d, [query, id], "left").join(lex.select(query, id, "b"), [query, id], "left").join(docs, id)
    score = preset.alpha * F.coalesce("d", F.lit(0.0)) + (1 - preset.alpha) * F.coalesce("b", F.lit(0.0))
    if "source" in docs.columns:
        score = score * F.when(F.lower("source").contains("synthetic"), preset.synthetic).otherwise(1.0)
    if preset.boosts:
        boost = F.create_map(*(F.lit(x) for pair in preset.boosts.items() for x in pair))
        score = score * F.coalesce(F.try_element_at(boost, F.col("chunk_kind")), F.lit(1.0))
    joined = joined.where(F.col("chunk_kind").isin(list(preset.kinds))) if preset.kinds else joined
    return top(joined.withColumn("score", score), k, "score", id, query)


def chunk_details(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks that ids (chunk_id) ask for: source, page (0 if null), page_end (page if null), section, chunk_kind and
    text; a chunk that is not there has found = false. Chunks sorted by id are skipped by row group."""
    met = ids.select("chunk_id").distinct().join(chunks.withColumn("found", F.lit(True)), "chunk_id", "left")
    page = F.coalesce("page", F.lit(0))
    return met.select(
        "chunk_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("source", F.lit("")).alias("source"), page.alias("page"), F.coalesce("page_end", page).alias("page_end"), "section", "chunk_kind",
        F.coalesce("text", F.lit("")).alias("text"),
    )


def query_text(query: Column, must: Column, should: Column) -> Column:
    """The text that is searched for: the query, then its must and should terms, joined by spaces; blanks drop out."""
    parts = F.concat(F.array(query), must, should)
    return F.array_join(F.filter(F.transform(parts, lambda p: T.strip(F.coalesce(p, F.lit("")))), lambda p: p != ""), " ")


def must_exclude(hits: DataFrame, must: list[str], exclude: list[str], section: str = "section", text: str = "text") -> DataFrame:
    """Hits that hold all of must and none of exclude. Applied after the cut; nothing is refilled."""
    return hits.where(T.allowed(F.col(section), F.col(text), must, exclude)) if must or exclude else hits


def prompt_lines(hits: DataFrame, most: int = 10, size: int = 1800) -> DataFrame:
    """query_id, prompt: the first hits, each with its source, pages and section, text cut to size."""
    line = F.format_string("[%s p.%s-%s %s]\n%s", "source", F.coalesce(F.col("page").cast("string"), F.lit("?")), F.coalesce(F.col("page_end").cast("string"), F.lit("?")), F.coalesce("section", F.lit("")), F.substring("text", 1, size))
    rows = hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return rows.select("query_id", F.array_join(F.col("lines.line"), "\n\n").alias("prompt"))
