"""Ordered passes over whole tables: numbering, prefix sums, carried values. No window lacks a partition key.

Each stages its rows in the order wanted, cut into ranges (a group of any size is spread over many), makes one small row
of every range, and combines these in order; there are as many as the session has shuffle partitions. Rows of equal keys
are put in the order in which they were staged, so keys should be unique where that matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fathom.staging import staged

#: monotonically_increasing_id() keeps a row's place within its partition in so many bits.
_PLACE = 33


def _in_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _at, staged in order: the range in the high bits, the place in it in the low ones."""
    return staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")


def _range(at: Column) -> Column:
    return F.shiftright(at, _PLACE)


def numbered(rows: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """rows with a number from 0 that is dense over the whole table, in that order (nulls first)."""
    placed = _in_ranges(rows, [F.col(c) if isinstance(c, str) else c for c in order])
    offsets, total = {}, 0
    for r in sorted(placed.groupBy(_range(F.col("_at")).alias("r")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["r"]):  # a row for each range
        offsets[r["r"]] = total
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(list(offsets.items()), "_r long, _start long")
    joined = placed.join(F.broadcast(starts), _range(F.col("_at")) == F.col("_r"))
    return joined.select(*(placed[c] for c in rows.columns), (F.col("_start") + F.col("_at").bitwiseAND((1 << _PLACE) - 1)).alias(name))


def prefix_sums(rows: DataFrame, order: list[str | Column], value: str, name: str = "before") -> DataFrame:
    """rows with the sum of value (whole numbers, null counts 0) over all rows before them in that order."""
    placed = _in_ranges(rows, [F.col(c) if isinstance(c, str) else c for c in order])
    offsets, total = {}, 0
    for r in sorted(placed.groupBy(_range(F.col("_at")).alias("r")).agg(F.sum(value).cast("long").alias("n")).collect(), key=lambda r: r["r"]):  # a row for each range
        offsets[r["r"]] = total
        total += r["n"] or 0
    schema, columns = StructType([*rows.schema.fields, StructField(name, LongType())]), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}  # a task may read several ranges, each in order
        for b in batches:
            at, own = b.column("_at").to_numpy(), b.column(value).cast(pa.int64()).fill_null(0).to_numpy()
            frame = pd.DataFrame({"r": at >> _PLACE, "v": own})
            sums = frame.groupby("r", sort=False)["v"].cumsum()
            first = frame["r"].map({r: held.get(r, offsets[r]) for r in frame["r"].unique().tolist()})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array((sums - frame["v"] + first).to_numpy(), pa.int64())], names=schema.names)
            for r, v in frame.groupby("r")["v"].sum().items():
                held[r] = held.get(r, offsets[r]) + int(v)

    # The file's rows are read in their order; a file that is read in pieces would break it, so each range is sorted anew.
    return placed.repartition(_range(F.col("_at"))).sortWithinPartitions("_at").select(*columns, "_at").mapInArrow(run, schema)


def carried(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the last value that is not null, of the same group, at or before them in that order: an as-of merge if
    the rows are a union of what asks and what answers.

    Ranges are filled by themselves; then each range's first group gets what the ranges before it have left over.
    """
    keys = [F.col(c) for c in (group, *order)]
    placed = _in_ranges(rows, keys)
    of = _range(F.col("_at"))
    per = placed.groupBy(of.alias("r"), group).agg(F.max("_at").alias("_end"), F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("v"))
    ends = per.groupBy("r").agg(F.max_by(F.struct(group, "v"), "_end").alias("last"), F.min_by(group, "_end").alias("first"))
    carry, held = [], None
    for r in sorted(ends.collect(), key=lambda r: r["r"]):  # a row for each range
        if held is not None and held[0] == r["first"]:
            carry.append((r["r"], held[0], held[1]))
        # a value passes through a range that holds one group and none of its values
        passed = held[1] if held is not None and held[0] == r["last"][0] == r["first"] else None
        held = (r["last"][0], passed if r["last"][1] is None else r["last"][1])
    kinds = rows.schema[group].dataType.simpleString(), rows.schema[value].dataType.simpleString()
    before = rows.sparkSession.createDataFrame([c for c in carry if c[2] is not None], f"_r long, _g {kinds[0]}, _v {kinds[1]}")
    local = placed.withColumn("_r", of).join(F.broadcast(before.withColumnRenamed("_r", "_q")), (F.col("_r") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    w = Window.partitionBy("_r", group).orderBy("_at")
    return local.select(*(placed[c] for c in rows.columns), F.coalesce(F.last(value, ignorenulls=True).over(w), "_v").alias(name))
