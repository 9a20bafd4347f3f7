"""Nested outlines: entries with parents become sections in depth-first order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.staging import staged

#: Levels of an outline at most; a deeper one, or a circle of entries, is an error and not a cut.
LEVELS = 100


def outline_tree(entries: DataFrame, manual: str = "source", levels: int = LEVELS) -> DataFrame:
    """manual, entry, level (from 1), path, title, page_index of all entries that a root leads to. entries has manual, entry (an id
    inside the manual), parent (null for roots), nth (order among siblings, from 0), title and page_index. path holds the
    places from the root down, so that ordering by it is depth first.

    A recursive query: each step joins the level before with its children on (manual, parent). Entries below a missing parent
    are lost, as bookmarks of a broken outline are; of siblings with one nth both stay, in the order of their ids.
    """
    spark, name = entries.sparkSession, f"outline_{uuid.uuid4().hex}"
    staged(entries.select(F.col(manual).alias("manual"), "entry", "parent", "nth", "title", "page_index"), "outline").createOrReplaceTempView(name)
    limit, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    try:
        spark.conf.set(limit, "-1")  # the number of entries is the table's, not a fault
        found = spark.sql(f"""
            WITH RECURSIVE tree(manual, entry, level, path, title, page_index) MAX RECURSION LEVEL {levels} AS (
                SELECT manual, entry, 1, array(struct(nth, entry)), title, page_index FROM {name} WHERE parent IS NULL
                UNION ALL
                SELECT e.manual, e.entry, level + 1, concat(path, array(struct(e.nth, e.entry))), e.title, e.page_index
                FROM {name} AS e JOIN tree ON e.manual = tree.manual AND e.parent = tree.entry)
            SELECT * FROM tree""")
        out = staged(found, "tree")
    finally:
        spark.catalog.dropTempView(name)
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)
    return out.withColumnRenamed("manual", manual)


def outline_sections(tree: DataFrame, manual: str = "source") -> DataFrame:
    """Entries in the form that outline_blocks() takes: of the entries of one page the last one in depth-first order names it."""
    return tree.select(manual, "page_index", "title", F.col("path").alias("entry_no"))
