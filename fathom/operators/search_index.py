"""A lexical index that is kept as Parquet and searched without the texts.

Documents are put in order of their most frequent term and of their length, so that those alike stand together, and cut
into segments of so many, within the ranges in which they are sorted; for each term and segment there is one
block, a row with the documents' ids, term counts and lengths and, beside these, the largest impact of the block: what
the term adds to a score at most, but for its weight. Blocks of a term lie in one folder of BUCKETS, sorted by
term in each file.

Search is exact and opens few blocks (block-max pruning). The bound of a query in a segment is the sum of its
terms' largest impacts there times their weights. The segments with the highest bounds are scored first; the k-th
best score found then is a threshold, and of all other segments only those whose bound reaches it are opened. Bounds are
made from the small columns alone, so that blocks which are not opened cost nothing of their arrays.

Edge cases: a document without text or terms is in no block but counts in the corpus; rows that repeat an id add up, as
they do in a scan; a query without a known term has no hits; nulls as ids drop out.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators import retrieval as R
from fathom.staging import discard, sized, staged

#: Documents of a segment, folders of terms, segments that are scored before there is a threshold.
SEGMENT, BUCKETS, FIRST = 32, 64, 2
#: Entries (a term of a document) of a range, about; those from which another task is worth its files; those that weigh as a row.
RANGE, LEAST, ROW = 2_000_000, 150_000, 256
#: Bounds are sums in another order than scores are; so much is added to them.
_SLACK = 1e-6
_TERM = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Index:
    """The tables of an index, where they are, and the name of its ids, and whether ids repeat."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    id: str
    path: str
    repeats: bool


def _bucket(term) -> F.Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def _counted(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, common (the most frequent term), dl, size (distinct terms), words (these, joined by spaces) and times (their counts, binary)."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(_TERM.findall((t or "").lower())) for t in b.column(1).to_pylist()]
            common = [min((-n, t) for t, n in c.items())[1] if c else "" for c in found]
            times = [np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in found]
            columns = [b.column(0), pa.array(common, pa.string()), pa.array([c.total() for c in found], pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(" ".join, found), pa.string()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id, "common", "dl", "size", "words", "times"])

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, common string, dl long, size long, words string, times binary")


def _ranged(counted: DataFrame, id: str, entries: int) -> DataFrame:
    """id, dl, words, times in sorted ranges of about as many entries each, so that no task holds much more than RANGE of them.

    Ranges are cut by rows, so a document with many terms comes as several, of which all but one only weigh and have no words."""
    spark, order = counted.sparkSession, ["common", "dl", id]
    ranges = max(-(-entries // RANGE), min(spark.sparkContext.defaultParallelism, entries // LEAST), 1)
    rows = counted.withColumn("_nth", F.explode(F.sequence(F.lit(0), F.expr(f"int(size div {ROW})"))))
    whole = [F.when(F.col("_nth") == 0, F.col(c)).alias(c) for c in ("words", "times")]
    return rows.select(*order, *whole).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(id, "dl", "words", "times")


def _blocks(counted: DataFrame, id: str, segment: int, avgdl: float, entries: int) -> DataFrame:
    """term, segment, docs, most, ids, tfs, dls: a segment's documents stand together in a sorted range, so the task that reads
    them makes its blocks, and no entry of a term and a document is shuffled. Ranges end segments."""
    names = ["term", "segment", "docs", "most", "ids", "tfs", "dls"]

    def block(number: int, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r[0])
        code: dict[str, int] = {}
        terms = np.array([code.setdefault(t, len(code)) for r in rows for t in r[2].split()], dtype=np.int64)
        tf = np.frombuffer(b"".join(r[3] for r in rows), np.int32)
        of = np.repeat(np.arange(len(rows)), [len(r[3]) // 4 for r in rows])
        by = np.argsort(terms, kind="stable")
        of, tf = of[by], tf[by]
        dl = np.array([r[1] for r in rows], dtype=np.int64)[of]
        impact = tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / avgdl))
        docs = np.bincount(terms, minlength=len(code))
        ends = np.concatenate([[0], np.cumsum(docs)])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array([r[0] for r in rows], kind).take(pa.array(of)), pa.array(tf), pa.array(dl))]
        return pa.RecordBatch.from_arrays([pa.array(list(code), pa.string()), pa.array([number] * len(code), pa.int64()), pa.array(docs, pa.int64()), pa.array(np.maximum.reduceat(impact, ends[:-1])), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = [], itertools.count(TaskContext.get().partitionId() << 33)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)):
                    if row[0] is not None and row[2]:
                        held.append(row)
                    if len(held) == segment:
                        yield block(next(numbers), held, b.column(0).type)
                        held = []
        if held:
            yield block(next(numbers), held, b.column(0).type)

    kind = counted.schema[id].dataType.simpleString()
    return _ranged(counted, id, entries).mapInArrow(run, f"term string, segment long, docs long, most double, ids array<{kind}>, tfs array<int>, dls array<long>")


def write_index(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", segment: int = SEGMENT, mode: str = "errorifexists") -> None:
    """Writes the index of docs: blocks, terms with their document frequencies, and the corpus' numbers."""
    spark = docs.sparkSession
    counted = staged(_counted(docs, id, text), "counted")
    n, avgdl, entries = counted.agg(F.count("*"), F.avg("dl"), F.coalesce(F.sum("size"), F.lit(0))).first()
    repeats = bool(counted.where(F.col(id).isNotNull()).groupBy(id).agg(F.count("*").alias("n")).where("n > 1").take(1))
    rows = _blocks(counted, id, segment, avgdl or 1.0, entries).withColumn("bucket", _bucket(F.col("term")))
    # Each task writes its segments' share of every folder: terms come sorted in the files, so that their statistics tell them apart.
    rows.sortWithinPartitions("bucket", "term", "segment").write.mode(mode).partitionBy("bucket").parquet(f"{path}/blocks")
    discard(counted)
    kept = spark.read.schema(rows.schema).parquet(f"{path}/blocks")
    kept.groupBy("bucket", "term").agg(F.sum("docs").alias("df"), F.max("most").alias("most")).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/terms")
    about = json.dumps({"n": n, "repeats": repeats, "avgdl": avgdl or 1.0, "id": id, "kind": docs.schema[id].dataType.simpleString()})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/about")


def open_index(spark: SparkSession, path: str) -> Index:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    blocks = f"term string, segment long, docs long, most double, ids array<{about['kind']}>, tfs array<int>, dls array<long>, bucket int"
    terms = "term string, df long, most double, bucket int"
    return Index(spark.read.schema(blocks).parquet(f"{path}/blocks"), spark.read.schema(terms).parquet(f"{path}/terms"), about["n"], about["id"], path, about.get("repeats", True))


def _avgdl(index: Index) -> float:
    return json.loads(index.blocks.sparkSession.read.text(f"{index.path}/about").first()[0])["avgdl"]


def weighed(index: Index, queries: DataFrame, query: str = "query_id", text: str = "query_text") -> DataFrame:
    """query, term, bucket, w: the terms of queries that the index has, with their weight; staged."""
    asked = R.query_terms(queries, query, text).withColumn("bucket", _bucket(F.col("term")))
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return staged(index.terms.select("term", "bucket", "df").join(sized(staged(asked, "asked")), ["bucket", "term"]).select(query, "term", "bucket", (idf * F.col("qtf")).alias("w")), "weighed")


def bounds(index: Index, asked: DataFrame, query: str = "query_id") -> DataFrame:
    """query, segment, bound, blocks, docs (at least so many have a term): from the small columns of the blocks."""
    small = index.blocks.select("term", "bucket", "segment", "docs", "most")
    bound = F.sum(F.col("w") * F.col("most")) + _SLACK
    met = small.join(sized(asked), ["bucket", "term"])
    return met.groupBy(query, "segment").agg(bound.alias("bound"), F.count("*").alias("blocks"), F.max("docs").alias("docs"))


def score_segments(index: Index, asked: DataFrame, wanted: DataFrame, query: str = "query_id", avgdl: float | None = None) -> DataFrame:
    """query, id, bm25 of all documents of the segments wanted (query, segment) that share a term with the query.

    A block goes to its segment's task once, with all queries that ask for its term; scores are a product of weights and
    impacts there. A row of a segment is an id; rows of other segments that repeat it are not added yet."""
    avgdl = avgdl or _avgdl(index)
    asks = sized(staged(asked.groupBy("bucket", "term").agg(F.collect_list(F.struct(query, "w")).alias("asks")), "asks"))
    wants = staged(wanted.groupBy("segment").agg(F.collect_set(query).alias("wants")), "wants")
    met = index.blocks.join(asks, ["bucket", "term"]).join(sized(wants.select("segment")), "segment").select("segment", "ids", "tfs", "dls", "asks")
    kinds, id = {f.name: f.dataType.simpleString() for f in asked.schema}, index.id

    def score(blocks: pa.Table, wanting: pa.Table) -> pa.Table:
        ids, tfs, dls, pairs = (blocks.column(c).combine_chunks() for c in ("ids", "tfs", "dls", "asks"))
        docs, every = ids.flatten().dictionary_encode(), pairs.flatten()
        who = every.field(query).dictionary_encode()
        tf, dl = tfs.flatten().to_numpy(), dls.flatten().to_numpy()
        impact = np.zeros((len(ids), len(docs.dictionary)))
        np.add.at(impact, (np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy())), docs.indices.to_numpy()), tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / avgdl)))
        of, at, w = np.repeat(np.arange(len(pairs)), np.diff(pairs.offsets.to_numpy())), who.indices.to_numpy(), every.field("w").to_numpy()
        wants_ = set(wanting.column("wants").combine_chunks().flatten().to_pylist())
        asking = np.array([k for k, q in enumerate(who.dictionary.to_pylist()) if q in wants_], dtype=np.int64)
        found: list[list] = [[], [], []]
        for k in range(0, len(asking), 256):  # so many queries at once
            place = np.full(len(who.dictionary), -1)
            place[asking[k : k + 256]] = np.arange(len(asking[k : k + 256]))
            own = place[at] >= 0
            weights = np.zeros((len(asking[k : k + 256]), len(ids)))
            weights[place[at[own]], of[own]] = w[own]
            total = weights @ impact
            q, d = np.nonzero(total)
            for out, values in zip(found, (asking[k + q], d, total[q, d])):
                out.append(values)
        q, d, v = (np.concatenate(x) if x else np.array([], dtype=np.int64) for x in found)
        return pa.table({query: who.dictionary.take(pa.array(q)), id: docs.dictionary.take(pa.array(d)), "bm25": pa.array(v, pa.float64())})

    id_kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    return met.groupBy("segment").cogroup(wants.groupBy("segment")).applyInArrow(score, f"{query} {kinds[query]}, {id} {id_kind}, bm25 double")


def search(index: Index, queries: DataFrame, k: int, query: str = "query_id", text: str = "query_text", first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The k best documents (query, id, bm25, rank) of each query, and what was opened for it: query, blocks, opened."""
    asked = weighed(index, queries, query, text)
    bound = staged(bounds(index, asked, query), "bounds")
    avgdl = _avgdl(index)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "segment"))
    early = staged(bound.withColumn("place", place).where(F.col("place") <= first).select(query, "segment"), "early")
    found = staged(score_segments(index, asked, early, query, avgdl), "early-scores")
    added = lambda scores: scores.groupBy(query, index.id).agg(F.sum("bm25").alias("bm25")) if index.repeats else scores
    kth = R.top(added(found), k, "bm25", index.id, query).groupBy(query).agg(F.count("*").alias("n"), F.min("bm25").alias("kth"))
    kth = kth.select(query, F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(0.0)).alias("kth"))
    late = bound.join(sized(early).withColumn("done", F.lit(True)), [query, "segment"], "left").where("done is null").join(sized(staged(kth, "kth")), query)
    late = staged(late.where(F.col("bound") >= F.col("kth")).select(query, "segment", "blocks"), "late")
    every = added(found.unionByName(score_segments(index, asked, late, query, avgdl)))
    opened = early.join(bound, [query, "segment"]).select(query, "blocks").unionByName(late.select(query, "blocks")).groupBy(query).agg(F.sum("blocks").alias("opened"))
    return R.top(every, k, "bm25", index.id, query), bound.groupBy(query).agg(F.sum("blocks").alias("blocks")).join(opened, query)


def save(folder: str, chunks: DataFrame, vectors: DataFrame | None = None, config: dict | None = None, id: str = "chunk_id", mode: str = "errorifexists") -> None:
    """A whole index: chunks sorted by id, the lexical index of their texts, and vectors (id, embedding) and settings if given."""
    chunks.repartitionByRange(id).sortWithinPartitions(id).write.mode(mode).parquet(f"{folder}/chunks")
    write_index(chunks, f"{folder}/lexical", id, "text", mode=mode)
    if vectors is not None:
        vectors.write.mode(mode).parquet(f"{folder}/vectors")
    chunks.sparkSession.createDataFrame([(json.dumps({"settings": config or {}, "vectors": vectors is not None}),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/config")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, Index, DataFrame | None, dict]:
    """chunks, lexical index, vectors (None if there are none) and settings of a saved index; a missing part is an error."""
    about = json.loads(spark.read.text(f"{folder}/config").first()[0])
    vectors = spark.read.parquet(f"{folder}/vectors") if about["vectors"] else None
    return spark.read.parquet(f"{folder}/chunks"), open_index(spark, f"{folder}/lexical"), vectors, about["settings"]
