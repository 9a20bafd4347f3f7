"""Exact deduplication by a cuckoo-filter index of live digests.

Every text is reduced to its SHA-256 digest and its length. Rows of one digest are first summed by (digest, salt), so
that a text which a third of all rows share arrives at its bucket as a few partial sums. Buckets are hash partitions of
the digests, as many as keep a task's index small; each holds a cuckoo filter of 16-bit fingerprints over packed keys in
buckets. A miss inserts, a hit is verified against its bucket's content, deletion removes the fingerprint and the key, and
a full table doubles and refills from the stored keys.

Edge cases: a null text counts as empty; among equal texts the largest doc_id stays (a null one only if all are null);
of rows that also share the doc_id one stays; a text of any length is digested whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_groups, prepare, same, sized, staged, text_or_empty

#: Partial sums that a digest may send to its bucket; keys that one task indexes, about.
SALTS, TASK_KEYS = 16, 200_000


class CuckooIndex:
    """Live digests with a value each: a cuckoo filter of fingerprints over content in buckets.

    A key whose fingerprint the filter lacks is new without a look at the content; only hits are searched for, in the
    one bucket that could hold them. Keys are packed bytes of one length.
    """

    SLOTS, KICKS, PAGE = 4, 200, 64

    def __init__(self, buckets: int = 1024):
        self.width = self.size = self.resizes = self.false_hits = 0
        self._clear(buckets)
        self._spread([])

    def __len__(self) -> int:
        return self.size

    def items(self) -> Iterator[tuple[bytes, object]]:
        for keys, values in self.pages:
            for k, value in enumerate(values):
                yield bytes(keys[k * self.width : (k + 1) * self.width]), value

    def maybe(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return mark in self._slots(a) or mark in self._slots(b)

    def get(self, key: bytes):
        """The value of a live digest, or None."""
        at = self._found(key)
        return None if at is None else at[1][at[2]]

    def put(self, key: bytes, value) -> None:
        at = self._found(key)
        if at is not None:
            at[1][at[2]] = value
            return
        self.width = len(key)
        keys, values = self._page(key)
        keys += key
        values.append(value)
        self.size += 1
        if not self._place(key):
            self._resize()

    def remove(self, key: bytes) -> bool:
        at = self._found(key)
        if at is None:
            return False
        keys, values, k = at
        keys[k * self.width : (k + 1) * self.width] = keys[-self.width :]  # the last one takes the place
        values[k] = values[-1]
        del keys[-self.width :], values[-1]
        self.size -= 1
        mark, a, b = self._places(key)
        place = a if mark in self._slots(a) else b
        self.marks[place * self.SLOTS + self._slots(place).index(mark)] = 0
        return True

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * self.SLOTS * buckets))  # 0 is a free slot

    def _spread(self, items: list[tuple[bytes, object]]) -> None:
        self.pages = [(bytearray(), []) for _ in range(max(1, (self.mask + 1) * self.SLOTS // self.PAGE))]
        for key, value in items:
            keys, values = self._page(key)
            keys += key
            values.append(value)

    def _slots(self, place: int) -> array:
        return self.marks[place * self.SLOTS : (place + 1) * self.SLOTS]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def _page(self, key: bytes) -> tuple[bytearray, list]:
        return self.pages[int.from_bytes(key[8:14], "little") % len(self.pages)]

    def _found(self, key: bytes) -> tuple[bytearray, list, int] | None:
        """The bucket of a live key and its number there."""
        if not self.maybe(key):
            return None
        keys, values = self._page(key)
        at = keys.find(key)
        while at >= 0 and at % self.width:
            at = keys.find(key, at + 1)
        if at < 0:
            self.false_hits += 1
            return None
        return keys, values, at // self.width

    def _place(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for place in (a, b):
            if self._take(place, mark):
                return True
        place = b
        for kick in range(self.KICKS):
            at = place * self.SLOTS + kick % self.SLOTS
            self.marks[at], mark = mark, self.marks[at]
            place = self._other(place, mark)
            if self._take(place, mark):
                return True
        return False

    def _take(self, place: int, mark: int) -> bool:
        own = self._slots(place)
        if 0 not in own:
            return False
        self.marks[place * self.SLOTS + own.index(0)] = mark
        return True

    def _resize(self) -> None:
        items = list(self.items())
        while True:
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            if all(self._place(k) for k, _ in items):
                self._spread(items)
                return


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (binary SHA-256) and length of every row; made by Spark's own functions."""
    text = text_or_empty(docs)
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def live_index(rows: DataFrame) -> DataFrame:
    """digest, bytes, keep_id and group_size of every live digest, from rows of digests()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for b in batches:
            for digest, size, keep, n in zip(*(b.column(c).to_pylist() for c in ("digest", "bytes", "keep_id", "n"))):
                key = digest + size.to_bytes(8, "little")
                old = index.get(key)
                if old is not None:  # the newer document takes the older one's place
                    index.remove(key)
                    keep, n = old[0] if keep is None or (old[0] is not None and old[0] > keep) else keep, n + old[1]
                index.put(key, (keep, n))
        items = index.items()
        while part := list(islice(items, 10_000)):
            columns = [[k[:32] for k, _ in part], [int.from_bytes(k[32:], "little") for k, _ in part], [v[0] for _, v in part], [v[1] for _, v in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([("digest", pa.binary()), ("bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    partial = rows.groupBy("digest", "bytes", salt.alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    tasks = max(1, -(-rows.count() // TASK_KEYS))
    return partial.drop("salt").repartition(tasks, "digest").mapInArrow(run, "digest binary, bytes long, keep_id long, group_size long")


def mark_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest; one row per document."""
    prepare(docs.sparkSession)
    rows = staged(digests(docs), "digests")
    index = staged(live_index(rows), "live")
    marked = join_groups(rows, index, ["digest", "bytes"], "group_size", rows.count())
    # Only rows that could stay are numbered, so that of repeated doc_ids one stays.
    last = same(F.col("doc_id"), F.col("keep_id"))
    nth = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("bytes"))
    stays = marked.filter(last).withColumn("kept", nth == 1)
    cols = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    return stays.select(cols).unionByName(marked.filter(~last).withColumn("kept", F.lit(False)).select(cols))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns. Of rows with one id and one text that stays whose columns, as JSON,
    come first.

    Only ids are joined: those of rows that go are taken out, so texts are not shuffled unless very many go. Rows whose
    id is null or comes again are told apart by their texts; of these alone digests are joined.
    """
    again, gone_id, id_, digest, own, as_json, nth = fresh(docs, "again", "gone", "id", "digest", "own", "as_json", "nth")
    marked = staged(mark_copies(docs), "marked")
    repeated = staged(marked.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(again)), "repeated")
    gone = staged(marked.where("not kept and doc_id is not null").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    any_repeated = not repeated.isEmpty()
    once = docs
    if any_repeated:
        once = docs.join(sized(repeated), same(docs["doc_id"], F.col(again)), "left_anti")
    kept = once.join(sized(gone), once["doc_id"] == F.col(gone_id), "left_anti")
    if not any_repeated:
        return kept
    rows = docs.join(sized(repeated), same(docs["doc_id"], F.col(again)), "left_semi")
    rows = rows.withColumns({own: F.unhex(F.sha2(text_or_empty(rows), 256)), as_json: F.to_json(F.struct(*(rows[c] for c in docs.columns)))})
    stays = marked.where("kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest))
    rows = rows.join(stays, same(rows["doc_id"], F.col(id_)) & (rows[own] == F.col(digest)), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(as_json))
    return kept.unionByName(rows.withColumn(nth, first).where(F.col(nth) == 1).select(docs.columns))
