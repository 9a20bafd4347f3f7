"""Mixing sources to target weights by hash-threshold histograms.

Sources share the size of the whole corpus by weight; no source gives more than max_repeat times its own size, and what
that leaves over goes to the others by weight. A target is met by whole passes over the source and one partial pass:
the documents whose hash lies below a threshold. The threshold comes from histograms: sizes are summed by source and
hash bucket, the bucket in which the sum crosses the target is split by the next digits of the hash, and so on, until a
bucket holds one hash. Nothing is sorted and no more than one bucket of a source is refined.

Edge cases: a null text has size 0; texts of any length are counted whole; the null source comes last; documents without words are never taken in part; rows
with equal ids have equal hashes and are taken together; an empty table gives an empty result; other columns are
ignored. Reruns agree, for the hash is MD5 of the seed and the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, computed, fresh, same, staged

#: Hex digits of the hash that each histogram splits by, and in all.
DIGITS, LEVELS = 3, 5


def hash_of(doc_id: Column, seed: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, DIGITS * LEVELS)


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size and hash of every row."""

    def worker():
        return lambda texts: {"size": [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts]}

    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    rows = computed(own, ["doc_id", "source"], ["text"], "size long", worker)
    return rows.withColumn("hash", hash_of(F.col("doc_id"), seed))


def targets(rows: DataFrame, weights: list[int], max_repeat: int) -> DataFrame:
    """source, source_size, target. One row per source enters the windows, summed before the shuffle."""
    own = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    # Filling up by weight: sources reach their bound in the order of bound / weight; those before the first that is
    # not full give their bound, the others share the rest.
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.col("source_size") * max_repeat
    level = weighed.select(
        "*",
        (F.sum("source_size").over(all_) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("share"),
    )
    open_ = F.col("left") * F.col("weight") < cap * F.col("share")
    first = level.withColumn("_open", open_).withColumn("_n", F.row_number().over(full))
    least = F.min(F.when(F.col("_open"), F.struct("_n", "left", "share"))).over(all_)
    target = F.when(least.isNull() | (F.col("_n") < least["_n"]), cap.cast("double")).otherwise(
        least["left"].cast("double") * F.col("weight") / least["share"]
    )
    return staged(first.select("source", "source_size", target.alias("target")), "targets")


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, below: a document belongs to the partial pass if its hash is at most below (null: none does).

    goals has source and goal, the size of the partial pass. Each level sums the open bucket of each source by the next
    digits; a window runs over at most 16**DIGITS sums of a source.
    """
    open_ = goals.select("source", "goal", F.lit("").alias("prefix"), F.lit(None).cast("string").alias("below"))
    for level in range(1, LEVELS + 1):
        at = open_.select(F.col("source").alias("_s"), "goal", "prefix", "below")
        inside = rows.select("source", "size", F.substring("hash", 1, DIGITS * level).alias("bucket"))
        sums = staged(
            inside.join(at.select("_s", "prefix"), same(F.col("source"), F.col("_s")) & (F.substring("bucket", 1, DIGITS * (level - 1)) == F.col("prefix")))
            .groupBy("source", "bucket")
            .agg(F.sum("size").alias("size"), F.count("*").alias("n")),
            "sums",
        )
        w = Window.partitionBy("source").orderBy("bucket")
        run = sums.withColumn("upto", F.sum("size").over(w)).withColumn("start", F.col("upto") - F.col("size"))
        joined = run.join(at, same(F.col("source"), F.col("_s")))
        # Whole buckets that fit, and the first that does not.
        last = F.max(F.when(F.col("upto") <= F.col("goal"), F.struct("bucket", "upto")))
        cross = F.min(F.when((F.col("upto") > F.col("goal")) & (F.col("size") > 0), F.struct("bucket", "start", "upto")))
        found = joined.groupBy("source", "goal", "below").agg(last.alias("last"), cross.alias("cross"))
        taken = F.coalesce("last.upto", F.lit(0))
        below = F.coalesce(F.concat("last.bucket", F.lit("~")), F.col("below"))
        if level < LEVELS:
            open_ = found.select(
                "source", (F.col("goal") - F.coalesce("cross.start", taken)).alias("goal"), F.coalesce("cross.bucket", F.lit("none")).alias("prefix"), below.alias("below")
            )
        else:  # the hash itself crosses: it goes to the nearer side
            nearer = F.col("cross").isNotNull() & (F.col("cross.upto") - F.col("goal") < F.col("goal") - F.col("cross.start"))
            open_ = found.select("source", F.lit(0.0).alias("goal"), F.lit("").alias("prefix"), F.when(nearer, F.concat("cross.bucket", F.lit("~"))).otherwise(below).alias("below"))
        # A source whose open bucket is settled has no rows on the next level; it keeps what it has.
        done = at.join(open_.select(F.col("source").alias("_o")), same(F.col("_s"), F.col("_o")), "left_anti")
        open_ = staged(open_.unionByName(done.select(F.col("_s").alias("source"), "goal", "prefix", "below")), "open")
    return open_.select("source", "below")


def plan_of(rows: DataFrame, weights: list[int], max_repeat: int) -> DataFrame:
    """source (as _p), source_size, target, whole passes and the threshold of the partial pass; rows are of sizes()."""
    want = targets(rows, list(weights), max_repeat)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    want = staged(want.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    cut = thresholds(rows, want.where("goal > 0").select("source", "goal")).withColumnRenamed("source", "_c")
    plan = want.join(cut, same(F.col("source"), F.col("_c")), "left")
    return staged(plan.select(F.col("source").alias("_p"), "source_size", "target", "whole", "below"), "plan")


def _passes(hashed: Column, has_words: Column, whole: str = "whole", below: str = "below") -> Column:
    return F.col(whole) + F.coalesce((hashed < F.col(below)) & has_words, F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, passes (how often the mix takes the document), taken."""
    rows = staged(sizes(docs, seed), "sizes")
    joined = rows.join(plan_of(rows, list(weights), max_repeat), same(F.col("source"), F.col("_p")))
    joined = joined.withColumn("passes", _passes(F.col("hash"), F.col("size") > 0))
    return joined.select("doc_id", "source", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix-1") -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns. The texts are not shuffled."""
    own, whole, below, nth = fresh(docs, "of_source", "whole", "below", "nth")
    plan = plan_of(staged(sizes(docs, seed), "sizes"), list(weights), max_repeat).select(F.col("_p").alias(own), F.col("whole").alias(whole), F.col("below").alias(below))
    joined = docs.join(plan, same(docs["source"], plan[own]))
    has_words = F.coalesce(docs["text"].rlike(WORD), F.lit(False))
    often = F.array_repeat(F.lit(1), _passes(hash_of(docs["doc_id"], seed), has_words, whole, below).cast("int"))
    return joined.select(*(docs[c] for c in docs.columns), F.explode(often).alias(nth)).drop(nth)
