"""Tables that a job writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that are broadcast, at most: some tens of MB. Beyond that a join shuffles.
FEW_ROWS = 2_000_000


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="fathom-")


def workspace(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir as the session has it. Only a local session, as in
    tests, may do without; then it is a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or _own_folder()).rstrip('/')}/fathom"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage so that a lost executor costs no more than the running stage, it gives Spark the true size
    for its choice of joins, and a table that is used twice is computed once.
    """
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables whose consumers have been written.

    Shuffle files of finished jobs go when the driver collects their plans, so it is asked to."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def sized(small: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """small, with the hint to broadcast if it has few rows; it should be staged, for they are counted."""
    return F.broadcast(small) if small.count() <= most else small
