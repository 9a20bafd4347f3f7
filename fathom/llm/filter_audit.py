"""Audit of how filters interact: what each removes, in any order, and what is lost by it.

Texts are scanned in the buffers of Arrow batches. A table of byte classes marks white space, capitals, symbols and
bytes that continue a code point; prefix sums of the marks, read at the texts' ends, are the counts of each text. Words are
hashed by prefix sums too (a polynomial over their bytes), the hashes are sorted by text, and neighbours of equal hash are
compared byte by byte, so that distinct words are counted exactly; a text in which two words share a hash is counted by
a set. The filters a document fails are a bit mask. Masks are counted by part, and every number of the audit, for
each of the 120 orders, is a sum over the at most 32 masks of a part.

Equal texts are those of one SHA-256. Rows are counted by (digest, id), then by (digest, part, mask, labels), before
the smallest id of a digest is looked up, so a group of copies of any size is a few rows by then.

Edge cases: a null text is empty, a null lang is the part ''; a null doc_id has no smaller one and is not smaller than
any, and has no labels; rows that repeat an id are counted one by one and do not make each other copies; labels that
repeat count if one of them says so, null labels count as 0; a text longer than CHUNK_BYTES is scanned alone, in memory
that is a multiple of it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare, text_or_empty

#: The filters, in the order of their bits; the last one is the filter of copies.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Texts are scanned in pieces of about so many bytes.
CHUNK_BYTES = 1 << 20
_SPACE, _CAPITAL, _SYMBOL, _INNER = 1, 2, 4, 8
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")


@dataclass(frozen=True)
class Limits:
    """A document fails A below min_words, B below min_distinct (percent of its words), C above max_capitals (percent of
    its code points), D with any symbol, and E if a smaller id has its text."""

    min_words: int = 200
    min_distinct: int = 50
    max_capitals: int = 3

    def mask(self) -> Column:
        """The bits of the filters A to D that a document's counts fail."""
        c = F.col
        fails = [
            c("n_words") < self.min_words,
            100 * c("n_distinct") < self.min_distinct * c("n_words"),
            100 * c("n_capitals") > self.max_capitals * c("n_points"),
            c("n_symbols") > 0,
        ]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class bits of each byte."""
    out = np.zeros(256, dtype=np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[ord("A") : ord("Z") + 1] = _CAPITAL
    out[list(b"#$%&*|")] = _SYMBOL
    out[0x80:0xC0] = _INNER
    return out


class Scanner:
    """Counts of texts that stand back to back in a buffer."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def count(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The five counts of each text; text k is data[bounds[k] : bounds[k + 1]], and bounds start at 0."""
        texts = len(bounds) - 1
        if not len(data):
            return [np.zeros(texts, dtype=np.int64)] * len(_COUNTS)
        kinds = _classes()[data]
        summed = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[bounds])
        inside = (kinds & _SPACE) == 0
        first = np.zeros(len(data) + 1, dtype=bool)
        first[bounds] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        opens = inside & (~before | first[:-1])
        starts, ends = np.flatnonzero(opens), np.flatnonzero(inside & (~after | first[1:])) + 1
        n_words = summed(opens)
        distinct = self._distinct(data, starts, ends, n_words, bounds)
        marks = [(kinds & m) > 0 for m in (_CAPITAL, _SYMBOL, _INNER)]
        return [n_words, distinct, summed(marks[0]), summed(marks[1]), np.diff(bounds) - summed(marks[2])]

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        upto = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=upto[1:])
        hashes = (upto[ends] - upto[starts]) * self.inverses[starts]
        of = np.repeat(np.arange(len(n_words)), n_words)
        order = np.lexsort((hashes, of))
        a, b = order[:-1], order[1:]
        twins = np.flatnonzero((hashes[a] == hashes[b]) & (of[a] == of[b]))
        repeats = np.bincount(of[a[twins]], minlength=len(n_words))
        distinct = n_words - repeats
        for k in np.unique(of[a[twins]][~_equal(data, starts, ends, a[twins], b[twins])]):  # texts with a collision
            distinct[k] = len(set(data[bounds[k] : bounds[k + 1]].tobytes().split()))
        return distinct


def _equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, by number, have the same bytes; eight bytes are compared at once."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    same = size[a] == size[b]
    open_, at = np.flatnonzero(same), 0
    while len(open_):
        left = np.minimum(size[a[open_]] - at, 8)
        cut = np.uint64(64) - left.astype(np.uint64) * np.uint64(8)
        differ = ((eight[starts[a[open_]] + at] ^ eight[starts[b[open_]] + at]) << cut) != 0
        same[open_[differ]] = False
        at += 8
        open_ = open_[~differ & (size[a[open_]] > at)]
    return same


def scan(texts: pa.Array, scanner: Scanner) -> list[np.ndarray]:
    """The counts of an Arrow array of texts, from its buffers."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    parts, k = [], 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + CHUNK_BYTES, side="right")) - 1)
        parts.append(scanner.count(whole[bounds[k] : bounds[end]], bounds[k : end + 1] - bounds[k]))
        k = end
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * len(_COUNTS)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and the counts of every document: words, distinct words, capitals, symbols, code points."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text_or_empty(docs).cast("binary"), 256)).alias("digest"), text_or_empty(docs).alias("text"),
    )
    schema = StructType(own.schema.fields[:3] + StructType.fromDDL(", ".join(f"{c} long" for c in _COUNTS)).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:3] + [pa.array(c) for c in scan(b.column(3), scanner)], names=schema.names)

    prepare(docs.sparkSession)
    return own.mapInArrow(run, schema)


def masks(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail, and those of them with either label."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = measure(docs).withColumn("mask", limits.mask()).join(marked, "doc_id", "left")
    rows = rows.select("doc_id", "part", "digest", "mask", flag(F.col("good")).alias("good"), flag(F.col("toxic")).alias("toxic"))
    cell = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *cell).agg(F.count("*").alias("n"))
    without = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    cells = by_id.groupBy(cell).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), without.alias("n_null"))
    least = F.min("low").over(Window.partitionBy("digest"))
    first = F.col("n_null") + F.when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    both = cells.withColumn("least", least).withColumn("first", first).select("part", "good", "toxic", F.inline(split))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return both.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, filter_order, step and the counts of that step; a row for each part, order and step, zeros included."""
    cells = masks(docs, labels, limits).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = cells.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda f: F.instr("filter_order", f)
    steps = steps.withColumn("earlier", sum((F.when(place(f) < F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0)))
    steps = steps.withColumn("own", sum((F.when(place(f) == F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0)))

    def total(count, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c["mask"]), count(c)).otherwise(F.lit(0).cast("long")))

    earlier, own = F.col("earlier"), F.col("own")
    n = lambda c: c["n"]
    here = lambda m: (m.bitwiseAND(own) > 0) & (m.bitwiseAND(earlier) == 0)
    share = lambda c: c["n"] * (F.lit(len(ORDERS)) / F.bit_count(c["mask"])).cast("long")
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(n, lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: (m.bitwiseAND(own) > 0) & (m.bitwiseAND(earlier) > 0)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(share, lambda m: m.bitwiseAND(own) > 0).alias("shapley"),
    )
