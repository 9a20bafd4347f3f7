"""What the operators of this subpackage share: staged tables, Arrow batches, joins of checked size and the word pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fathom.staging import discard, sized, staged, workspace

__all__ = ["WORD", "computed", "discard", "fresh", "join_groups", "prepare", "same", "sized", "staged", "text_or_empty", "workspace"]

#: A word, as every contract of this subpackage has it: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bounds of an Arrow batch, by rows and, as texts may be long, by bytes; a row beyond the bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session; the settings are read when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def computed(df: DataFrame, keep: list[str], inputs: list[str], schema: str, worker: Callable[[], Callable[..., dict[str, list]]]) -> DataFrame:
    """The columns keep of df, untouched, and those of schema, which worker()(*inputs) makes for the rows of a batch.

    Columns to keep stay in Arrow, so that no null turns a batch of 64-bit ids into floats. inputs come as lists.
    """
    kept = [df.schema[c] for c in keep]
    made = StructType.fromDDL(schema).fields
    whole = StructType(kept + made)
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = worker()
        for b in batches:
            out = make(*(b.column(c).to_pylist() for c in inputs))
            arrays = [b.column(c) for c in keep] + [pa.array(out[f.name], arrow.field(f.name).type) for f in made]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    prepare(df.sparkSession)
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, whole)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Those names, changed where df has a column of that name (in any case) itself."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def same(left: Column, right: Column) -> Column:
    """Null-safe equality; Spark hashes it like plain equality."""
    return left.eqNullSafe(right)


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


#: At most this many groups can each hold more than 1/HEAVY of all rows.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """rows joined with the one row that groups has for each key; size is the column with the group's number of rows.

    The groups that hold more than 1/HEAVY of all rows are HEAVY at most, so these alone are broadcast; the rows of all
    others meet their group in a shuffled join in which no key is large. Keys must not be null.
    """
    heavy = groups[size] > total / HEAVY + 1
    hot = F.broadcast(groups.where(heavy))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(groups.where(~heavy), key))
