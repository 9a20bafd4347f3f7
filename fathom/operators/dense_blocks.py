"""Exact inner-product search that skips blocks of vectors by a bound.

Vectors are grouped by the nearest of some sampled pivots, put in order of their distance to it and cut into blocks; a block
keeps its pivot and the greatest distance r from it. Since q.v = q.p + q.(v - p), no product of a query q in a block
exceeds q.p + |q| r. The blocks with the highest bounds of each query are searched first, the k-th best product found is
a threshold, and of the others only blocks whose bound reaches it are opened. A pivot that is near to a third of all vectors
only means more blocks; the order is by ranges of (pivot, distance), so no task holds a pivot's vectors.

Edge cases: rows without a vector or with a null in it have no hits; a zero query ties with everything and opens all blocks;
ties go by id; fewer vectors than k give what there is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import retrieval as R
from fathom.staging import sized, staged

#: Pivots at most, vectors of a block, blocks that are searched before there is a threshold, queries of a block.
PIVOTS, BLOCK, FIRST, ASKS = 64, 256, 2, 256
#: Bounds are computed in another order than products are; so much of them is added.
_SLACK = 1e-6


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _whole(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))


def build(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """block, ids, matrix (binary, rows of doubles), pivot (array), radius: the blocks of vectors, staged."""
    own = _whole(vectors, vector).select(id, vector)
    chosen = own.orderBy(F.xxhash64(F.lit("pivot"), id), id).limit(pivots).collect()  # so many rows at most
    centres = np.array([r[vector] for r in chosen], dtype=np.float64)
    kind, list_kind = vectors.schema[id].dataType.simpleString(), vectors.schema[vector].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), b.num_rows)
            far = np.maximum((v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1), 0)
            best = far.argmin(axis=1)
            exact = np.sqrt(((v - centres[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32()), pa.array(exact)], names=[id, vector, "pivot", "far"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, rows, of, far = (list(c) for c in zip(*held))
            held.clear()
            columns = [[ids], [np.array(rows, dtype=np.float64).tobytes()], [centres[of[0]].tolist()], [max(far)]]
            kinds = pa.list_(id_type), pa.binary(), pa.list_(pa.float64()), pa.float64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ids", "matrix", "pivot", "radius"])

        for b in batches:
            id_type = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (len(held) == block or held[0][2] != row[2]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    order = ["pivot", "far", id]
    near = own.mapInArrow(nearest, f"{id} {kind}, {vector} {list_kind}, pivot int, far double") if chosen else own.select(id, vector, F.lit(0).alias("pivot"), F.lit(0.0).alias("far"))
    blocks = staged(near, "near").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, f"ids array<{kind}>, matrix binary, pivot array<double>, radius double")
    return staged(blocks.withColumn("block", F.monotonically_increasing_id()), "dense-blocks")


def _bounds(blocks: DataFrame, asks: DataFrame, query: str, kind: str, floor: bool) -> DataFrame:
    """query, block, bound for every query and block, or only where the bound reaches the query's floor. asks are blocks of
    queries; the small columns of the vectors' blocks meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q = np.frombuffer(row["asked"]).reshape(len(row["asks"]), -1)
                norm = np.sqrt((q**2).sum(axis=1))
                bound = q @ np.array(row["pivots"]).T + norm[:, None] * np.array(row["radii"])
                bound = bound + _SLACK * (1 + np.abs(bound))
                a, k = np.nonzero(bound >= np.array(row["floors"])[:, None]) if floor else np.indices(bound.shape).reshape(2, -1)
                asks_, names = row["asks"], row["blocks"]
                if len(a):
                    columns = [pa.array([asks_[n] for n in a]), pa.array([names[n] for n in k], pa.int64()), pa.array(bound[a, k])]
                    yield pa.RecordBatch.from_arrays(columns, names=[query, "block", "bound"])

    small = blocks.groupBy(F.floor(F.col("block").bitwiseAND((1 << 33) - 1) / 512).alias("_g"), F.shiftright("block", 33).alias("_h"))
    metas = small.agg(F.collect_list(F.struct("block", "pivot", "radius")).alias("m")).select(F.col("m.block").alias("blocks"), F.col("m.pivot").alias("pivots"), F.col("m.radius").alias("radii"))
    return metas.crossJoin(sized(asks, R.FEW_BLOCKS)).mapInArrow(run, f"{query} {kind}, block long, bound double")


def _asks(queries: DataFrame, query: str, vector: str, floors: DataFrame | None = None) -> DataFrame:
    """Blocks of queries: asks, asked (binary), floors."""
    rows = queries.withColumn("floor", F.lit(0.0)) if floors is None else queries.join(sized(floors), query)
    kind = rows.schema[query].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ASKS):
                part = b.slice(k, ASKS)
                data = _matrix(part.column(1), part.num_rows).tobytes()
                columns = [pa.array([part.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([data]), pa.array([part.column(2).to_pylist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["asks", "asked", "floors"])

    return staged(_whole(rows, vector).select(query, vector, "floor").mapInArrow(run, f"asks array<{kind}>, asked binary, floors array<double>"), "asks")


def _products(blocks: DataFrame, pairs: DataFrame, queries: DataFrame, k: int, id: str, query: str, vector: str) -> DataFrame:
    """query, id, dense: the k best of each pair of query and block."""
    id_type, query_type = blocks.schema["ids"].dataType.elementType.simpleString(), queries.schema[query].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = np.array(row["ids"])
                q = np.array(row["vectors"], dtype=np.float64)
                score = q @ np.frombuffer(row["matrix"]).reshape(len(ids), -1).T
                best = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                asks = [row["asks"][n] for n in np.repeat(np.arange(len(q)), best.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(asks), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], names=[query, id, "dense"])

    split = F.floor(F.row_number().over(Window.partitionBy("block").orderBy(query)) / ASKS)  # a block that very many ask for
    asked = pairs.join(queries.select(query, F.col(vector).alias("_v")), query).withColumn("_part", split)
    grouped = asked.groupBy("block", "_part").agg(F.collect_list(F.struct(query, "_v")).alias("a")).select("block", F.col(f"a.{query}").alias("asks"), F.col("a._v").alias("vectors"))
    return blocks.select("block", "ids", "matrix").join(grouped, "block").mapInArrow(run, f"{query} {query_type}, {id} {id_type}, dense double")


def search(blocks: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", query: str = "query_id", vector: str = "embedding", first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The k best (query, id, dense, rank) of each query, and the number of blocks that were opened for it: query, opened."""
    own = staged(_whole(queries, vector).select(query, vector), "queries")
    kind = own.schema[query].dataType.simpleString()
    bound = _bounds(blocks, _asks(own, query, vector), query, kind, False)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "block"))
    early = staged(bound.withColumn("place", place).where(F.col("place") <= first).select(query, "block"), "early")
    found = staged(_products(blocks, early, own, k, id, query, vector), "early-products")
    kth = R.top(found, k, "dense", id, query).groupBy(query).agg(F.count("*").alias("n"), F.min("dense").alias("kth"))
    floors = staged(kth.select(query, F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("floor")), "floors")
    late = _bounds(blocks, _asks(own, query, vector, floors), query, kind, True).select(query, "block").join(early, [query, "block"], "left_anti")
    late = staged(late, "late")
    every = found.unionByName(_products(blocks, late, own, k, id, query, vector))
    return R.top(every, k, "dense", id, query), early.unionByName(late).groupBy(query).agg(F.count("*").alias("opened"))
