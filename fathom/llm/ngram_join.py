"""Jaccard self-join of word n-grams by a token-group matrix, and its connected components.

A document is the set of hashes of its n-word shingles. Documents with one set are a class and take part once.

1. Order. Shingles that tasks meet in several of their documents are counted, and every set is ordered from rare to
   common by a table of the commonest of them, of fixed size. Two sets that reach the threshold share a token among the
   first n - ceil(t n) + 1 of each: its prefix. Any order is lossless; this one keeps passages that many documents share
   out of the prefixes.
2. Tokens of prefixes that two sets share are kept with their sets. Tasks send prefixes in packed slices of the range of
   tokens; rows of a token that many sets of a task hold are kept as they are, and only one of them is sent on.
3. Each token names two leaders among its sets: the set in whose prefix it stands first, and one by hash. Edits of a text
   make new, rare tokens, which stand before those of the text; so of a text and its edited copies the first is the text.
   Leaders are groups of one: a set queries the two leaders that its tokens name best. This finds most components.
4. Tokens that still occur in different components are left. Their sets are partitioned into bounded groups of similar
   sets: parts of one component, or sets without links that share a leader and are of about one size. The matrix holds
   which tokens occur in which groups. A set queries the groups that share enough prefix tokens with it, for their sizes,
   and hold a set of another component, from the smaller component to the larger.
5. Each group stores the union of its tokens as a bitmap of some bits a token. Every bit of the set that the union lacks
   is a token less that they can share, which bounds their overlap from above; only groups whose bound reaches what the
   threshold asks of the set are opened. Full sets are made for the members and queries of these alone, and compared
   exactly, for components with members of an already linked component left out.

Links between components are all found, since every pair of sets of different components with enough common prefix
tokens is compared or bounded; links inside a component are not needed for components. near_links and link_counts find
those too: there every set asks the groups of its own component, and all members are compared.

Edge cases: a null or empty text has an empty set and is linked with nothing; a text with fewer than n words has one
token; rows that repeat a doc_id are one document; rows with a null doc_id are linked with nothing, their component is
null; texts of any length are one set, made in memory that is a small multiple of the text; an empty table gives an empty
result; other columns are ignored. Sets are of 64-bit hashes, classes are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, join_groups, prepare, same, sized, staged
from .components import components

#: The table of common tokens has 2**ORDER bytes; sets and tokens of a group, about.
ORDER, GROUP_SETS, GROUP_TOKENS = 22, 32, 16_384
#: Tokens that a task counts or packs at once, and rows of prefixes that one task joins, about.
CHUNK, PACKED = 500_000, 1_000_000
#: Sets of a chunk with one token beyond which the task keeps them itself.
HOT = 32
#: Bits of a bitmap for each token, at least.
BITS_A_TOKEN = 4
#: Queries of a group that one task takes, about.
QUERIES = 500

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_TURN = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Threshold:
    """Similarity percent / 100 and words of a shingle."""

    percent: int = 75
    words: int = 5

    def least(self, n):
        """Tokens that a set of n must share with any that it links to."""
        return -(-self.percent * n // 100)

    def prefix(self, n):
        """Length of a set's prefix."""
        return n - self.least(n) + 1

    def early(self, n):
        """Length of the part of a prefix in which the smaller of two linked sets has a token of the larger's prefix."""
        return n + -2 * self.percent * n // (100 + self.percent) + 1

    def fit(self, n: Column, m: Column) -> Column:
        """Whether sets of n and m can be linked."""
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def common(self, n: Column, m: Column) -> Column:
        """A bound from below on the tokens that the prefixes of linked sets of n and m share."""
        whole = F.floor(self.percent * (n + m) / (100 + self.percent))
        return whole - F.ceil(F.lit(self.percent / 100) * F.greatest(n, m))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, by a rolling sum over the bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if len(data) > len(word_hashes.up):
        word_hashes.up, word_hashes.down = _powers(_STEP, 2 * len(data)), _powers(_BACK, 2 * len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * word_hashes.up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * word_hashes.down[starts] + (ends - starts).astype(np.uint64))


word_hashes.up, word_hashes.down = _powers(_STEP, 1 << 16), _powers(_BACK, 1 << 16)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    own = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(own):
        return own
    size = min(words, len(own))
    total = np.zeros(len(own) - size + 1, dtype=np.uint64)
    for k in range(size):
        total += own[k : k + len(total)] * _TURN[k % 64]
    return np.unique(_mix(total + np.uint64(size)))


def set_key(own: np.ndarray) -> tuple[int, int]:
    """A hash of a set, as two signed numbers of 64 bits."""
    sums = [_mix(own * _TURN[a] + _TURN[b]).sum(dtype=np.uint64) + np.uint64(len(own)) for a, b in ((7, 9), (11, 13))]
    return tuple(_mix(np.array(sums, dtype=np.uint64)).astype(np.int64).tolist())


def bitmap(own: np.ndarray) -> bytes:
    """Which low bits of the hashes occur; the number of bits is a power of two, so that a bitmap folds into a smaller one."""
    size = max(64, 1 << (BITS_A_TOKEN * len(own) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(data: np.ndarray, size: int) -> np.ndarray:
    return data if len(data) == size else np.bitwise_or.reduce(data.reshape(-1, size), axis=0)


def union_of(bitmaps: list[bytes]) -> bytes:
    """The bitmap of a union, as long as the shortest."""
    rows = [np.frombuffer(b, dtype=np.uint8) for b in bitmaps]
    size = min(map(len, rows))
    return np.bitwise_or.reduce([_fold(r, size) for r in rows]).tobytes()


def most_common(n: int, own: bytes, other: bytes) -> int:
    """A bound from above on the tokens that a set of n shares with another set, or union, by their bitmaps."""
    a, b = np.frombuffer(own, dtype=np.uint8), np.frombuffer(other, dtype=np.uint8)
    size = min(len(a), len(b))
    return n - int(np.bitwise_count(_fold(a, size) & ~_fold(b, size)).sum())


def _repeated(pool: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that several of the sets hold, and how many do."""
    found, times = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *pool]), return_counts=True)
    return found[times > 1].astype(np.int64), times[times > 1].astype(np.int32)


def _sets(docs: DataFrame, t: Threshold) -> DataFrame:
    """doc_id, hi and lo (the set's key) and n of each document; its bitmap where the task first meets the set in a
    document with an id; and in some rows the tokens that a chunk of the task's sets holds more than once, with times."""
    schema = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("tokens", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        pool: list[np.ndarray] = []
        last, pooled = None, 0

        def made(columns: list, repeated: tuple | None) -> pa.RecordBatch:
            rows = len(columns[0])
            more = [[None] * (rows - 1) + [part] for part in repeated] if repeated else [[None] * rows] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *more], schema)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            if last:  # a batch is held back until it is known whether it is the last
                full = pooled >= CHUNK
                yield made(last, _repeated(pool) if full else None)
                pool, pooled = ([], 0) if full else (pool, pooled)
            hi, lo, sizes, bits = [], [], [], []
            ids = b.column("doc_id")
            for text, doc_id in zip(b.column("text").to_pylist(), ids):
                own = shingles(text, t.words)
                key = set_key(own)
                hi.append(key[0])
                lo.append(key[1])
                sizes.append(len(own))
                new = len(own) > 0 and doc_id.is_valid and key not in met
                bits.append(bitmap(own) if new else None)
                if new:
                    met.add(key)
                    pool.append(own)
                    pooled += len(own)
            last = [ids, hi, lo, sizes, bits]
        if last:
            yield made(last, _repeated(pool))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, hi long, lo long, n long, bits binary, tokens array<long>, times array<int>")


def _order(sets: DataFrame) -> np.ndarray:
    """A level for each bucket of hashes: 0, or one that grows with how often tasks have met its commonest token again.

    As many of the commonest tokens are in it as fill an eighth of the buckets, whatever the corpus.
    """
    pairs = sets.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "times")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.times").alias("times"))
    level = F.least(F.floor(8 * F.log2("times")), F.lit(255)).cast("int").alias("level")
    met = staged(pairs.groupBy("token").agg(F.sum("times").alias("times")).select("token", level), "repeated")
    room, least = (1 << ORDER) // 8, 256
    for r in sorted(met.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # 256 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    bucket = F.shiftrightunsigned("token", 64 - ORDER).cast("int").alias("bucket")
    kept = met.where(F.col("level") >= least).groupBy(bucket).agg(F.max("level").alias("level")).toPandas()  # an eighth of the buckets at most
    out = np.zeros(1 << ORDER, dtype=np.uint8)
    out[kept["bucket"].to_numpy(dtype=np.int64)] = kept["level"].to_numpy(dtype=np.uint8)
    discard(met)
    return out


#: A packed row's mark: twice the token's place in the set's prefix (the last places count as one), 1 more if it is in
#: the early part; _SENT is added to a row that the task has kept itself and sends on for its leader.
_PLACES, _SENT = 1 << 14, 1 << 15


def _leaders(tokens: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by token: the number of each row's token, and the rows of each token's two leaders."""
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    hashed = _mix(keys.view(np.uint64))
    place = (marks & np.uint16(_SENT - 1)) >> np.uint16(1)
    return run, np.lexsort((hashed, place, run))[first], np.lexsort((hashed, run))[first]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Which of ordered values differ from the one before."""
    return np.concatenate([np.ones(min(1, len(ordered)), dtype=bool), ordered[1:] != ordered[:-1]])


def _named(keys: np.ndarray, marks: np.ndarray, run: np.ndarray, best: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, lead, margin: of the first leaders of each key's tokens the one with the greatest margin, which is how many
    places earlier a token stands in the leader; and with margin -1 one of the other leaders. None leads itself."""
    place = ((marks & np.uint16(_SENT - 1)) >> np.uint16(1)).astype(np.int32)
    lead, margin = keys[best][run], place - place[best][run]
    at = np.lexsort((lead, -margin, keys))
    at = at[(lead != keys)[at]]
    at = at[_firsts(keys[at])]
    aside = keys[other][run]
    by = np.lexsort((_mix(aside.view(np.uint64)), keys))
    by = by[(aside != keys)[by]]
    by = by[_firsts(keys[by])]
    return np.concatenate([keys[at], keys[by]]), np.concatenate([lead[at], aside[by]]), np.concatenate([margin[at], np.full(len(by), -1, dtype=np.int32)])


_KINDS = (np.uint64, np.int64, np.uint16)


def _packed(tokens: np.ndarray, keys: np.ndarray, marks: np.ndarray, parts: int, spare: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Rows (part, tokens, keys, marks) of a chunk: slices of the range of tokens, and one with part below 0 of those
    tokens that many of the chunk's sets hold; of each of these the slices have one row, that of the chunk's leader."""
    at = np.argsort(tokens, kind="stable")
    tokens, keys, marks = tokens[at], keys[at], marks[at]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    times = np.diff(np.append(first, len(tokens)))
    out, hot = [], times > HOT
    if hot.any():
        own = np.repeat(hot, times)
        kept = tokens[own], keys[own], marks[own]
        out.append((-1 - spare, *(x.tobytes() for x in kept)))
        best = _leaders(*kept)[1]
        rows = [(tokens, kept[0][best]), (keys, kept[1][best]), (marks, kept[2][best] | np.uint16(_SENT))]
        tokens, keys, marks = (np.concatenate([x[~own], sent]) for x, sent in rows)
        at = np.argsort(tokens, kind="stable")
        tokens, keys, marks = tokens[at], keys[at], marks[at]
    part = (tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    ends = np.searchsorted(part, np.arange(parts, dtype=np.uint64), side="right")
    for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
        if a < b:
            out.append((k, *(x[a:b].tobytes() for x in (tokens, keys, marks))))
    return out


def _met_again(tokens: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows, each once, those whose token two sets have or a task has kept, sorted by token."""
    at = np.lexsort((keys, tokens))
    tokens, keys, marks = tokens[at], keys[at], marks[at]
    sent = marks >= _SENT
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    once = new | np.concatenate([[True], (keys[1:] != keys[:-1]) | (sent[1:] != sent[:-1])])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    good = once & (np.add.reduceat((once | sent).astype(np.int64) + sent, first) > 1)[run]
    return tokens[good], keys[good], marks[good]


def _shared(docs: DataFrame, order: np.ndarray, parts: int, t: Threshold) -> DataFrame:
    """token, key (lo of the sets' keys) and early of those tokens of prefixes that two sets share; and rows without a
    token that have key, lead and margin, which name leaders. Either may be repeated."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        tokens, keys, marks, held, chunk = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal tokens, keys, marks, held, chunk
            spare = hash((TaskContext.get().partitionId(), chunk)) % parts
            rows = _packed(np.concatenate(tokens), np.concatenate(keys), np.concatenate(marks), parts, spare)
            tokens, keys, marks, held, chunk = [], [], [], 0, chunk + 1
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "tokens", "keys", "marks"])

        for b in batches:
            for text in b.column("text").to_pylist():
                own = shingles(text, t.words)
                if not len(own) or (key := set_key(own)) in met:
                    continue
                met.add(key)
                size = t.prefix(len(own))
                at = np.argsort(order[(own >> np.uint64(64 - ORDER)).astype(np.int64)], kind="stable")[:size]
                tokens.append(own[at])
                keys.append(np.full(size, key[1], dtype=np.int64))
                place = np.arange(size)
                marks.append((2 * np.minimum(place, _PLACES - 1) + (place < t.early(len(own)))).astype(np.uint16))
                held += size
                if held >= CHUNK:
                    yield flush()
        if held:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(columns: dict, size: int) -> Iterator[pa.RecordBatch]:
            for k in range(0, size, 100_000):
                n = min(size - k, 100_000)
                arrays = [pa.array(columns[f.name][k : k + n], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        def made(tokens: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, lead, margin = _named(keys, marks, *_leaders(tokens, keys, marks))
            yield from rows({"key": key, "lead": lead, "margin": margin}, len(key))
            own = marks < _SENT
            yield from rows({"token": tokens[own].view(np.int64), "key": keys[own], "early": (marks[own] & np.uint16(1)) > 0}, int(own.sum()))

        held: list[tuple[bytes, bytes, bytes]] = []
        for b in batches:
            for part, *blobs in zip(*(b.column(c).to_pylist() for c in ("part", "tokens", "keys", "marks"))):
                if part < 0:
                    yield from made(*(np.frombuffer(x, dtype=kind) for x, kind in zip(blobs, _KINDS)))
                else:
                    held.append(blobs)
        if held:
            found = _met_again(*(np.frombuffer(b"".join(x), dtype=kind) for x, kind in zip(zip(*held), _KINDS)))
            if len(found[0]):
                yield from made(*found)

    schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("early", pa.bool_()), ("lead", pa.int64()), ("margin", pa.int32())])
    own = docs.where("doc_id is not null").select("text")
    packed = own.mapInArrow(pack, "part long, tokens binary, keys binary, marks binary")
    return packed.repartition(-(-parts // 4), "part").mapInArrow(join, "token long, key long, early boolean, lead long, margin int")


def _full(docs: DataFrame, wanted: DataFrame, t: Threshold) -> DataFrame:
    """cid, n and tokens (binary, sorted 64-bit) of the sets of the documents that wanted (cid) names. Few ids are
    broadcast, so that no texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(text, t.words) for text in b.column("text").to_pylist()]
            arrays = [b.column("cid"), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["cid", "n", "tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").join(sized(wanted), "cid", "left_semi")
    return own.mapInArrow(run, "cid long, n long, tokens binary")


def _qualified(queries: DataFrame, members: DataFrame, keys: DataFrame, t: Threshold) -> DataFrame:
    """The queries (gid, cid, comp, rank) whose bound with the union of the group's tokens reaches what they need."""

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"gid": pdf["gid"], "union": [union_of(list(b)) for b in pdf["all"]]})

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [most_common(n, own, union) >= t.least(n) for n, own, union in zip(pdf["n"], pdf["bits"], pdf["union"])]
            yield pdf.loc[np.array(good, dtype=bool), ["gid", "cid", "comp", "rank"]]

    bits = keys.select("cid", "n", "bits")
    unions = members.join(bits, "cid").groupBy("gid").agg(F.collect_list("bits").alias("all")).mapInPandas(unite, "gid long, union binary")
    asked = queries.join(bits, "cid").join(unions, "gid")
    return staged(asked.mapInPandas(bound, "gid long, cid long, comp long, rank long"), "qualified")


def _open(docs: DataFrame, queries: DataFrame, members: DataFrame, keys: DataFrame, t: Threshold) -> DataFrame:
    """a, b: linked cids, staged. queries and members: gid, cid, comp, rank. A set is compared with members of a higher
    rank, or of the same rank and a smaller comp. A group with many queries is opened by several tasks."""
    queries = _qualified(queries, members, keys, t)
    members = staged(members.join(queries.select("gid").distinct(), "gid", "left_semi"), "members")
    wanted = staged(queries.select("cid").unionByName(members.select("cid")).distinct(), "wanted")
    full = staged(_full(docs, wanted, t), "full")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, group, union = None, [], np.zeros(0, dtype=np.uint64)
        for pdf in batches:
            links = []
            for gid, salt, kind, cid, comp, rank, blob in zip(*(pdf[c] for c in ("gid", "salt", "kind", "cid", "comp", "rank", "tokens"))):
                own = np.frombuffer(blob, dtype=np.uint64)
                if at != (gid, salt):
                    at, group, union = (gid, salt), [], np.zeros(0, dtype=np.uint64)
                if kind == 0:
                    group.append((cid, comp, rank, own))
                    union = np.zeros(0, dtype=np.uint64)
                    continue
                if not group:
                    continue
                if not len(union):
                    union = np.unique(np.concatenate([g[3] for g in group]))
                if _common(own, union) < t.least(len(own)):
                    continue
                done = set()
                for other, its_comp, its_rank, tokens in group:
                    if its_comp in done or its_comp == comp or (-its_rank, its_comp) >= (-rank, comp):
                        continue
                    small, large = sorted((len(own), len(tokens)))
                    if 100 * small < t.percent * large:
                        continue
                    both = _common(own, tokens)
                    if 100 * both >= t.percent * (small + large - both):
                        done.add(its_comp)
                        links.append((cid, other))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    asked = queries.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    ask = queries.join(asked, "gid").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int")).drop("salts").withColumn("kind", F.lit(1))
    show = members.join(asked, "gid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumn("kind", F.lit(0))
    columns = ["gid", "salt", "kind", "cid", "comp", "rank"]
    both = ask.select(columns).unionByName(show.select(columns)).join(full.select("cid", "tokens"), "cid")
    links = staged(both.repartition("gid", "salt").sortWithinPartitions("gid", "salt", "kind").mapInPandas(run, "a long, b long"), "links")
    discard(queries, members, wanted, full)
    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(edges: DataFrame) -> DataFrame:
    """cid, comp of the classes that edges (a, b) bind; comp is the smallest cid."""
    ids = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return staged(components(ids).select(F.col("node").alias("cid"), F.col("root").alias("comp")), "linked")


def _placed(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """key, cid, n, comp, rank (sets of the component) and weight (their tokens)."""
    info = keys.select("key", "cid", "n").join(linked, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    return staged(info.join(info.groupBy("comp").agg(F.count("*").alias("rank"), F.sum("n").alias("weight")), "comp"), "info")


def _leads(shared: DataFrame, keys: DataFrame) -> DataFrame:
    """cid, n, gid, m: each set and the leaders that its tokens name best; first marks the first of the two."""
    margin = F.col("margin")
    best = F.max(F.when(margin >= 0, F.struct(margin.alias("margin"), F.col("lead").alias("lead"))))["lead"]
    other = F.min(F.when(margin < 0, F.struct(F.xxhash64("lead").alias("hash"), F.col("lead").alias("lead"))))["lead"]
    named = shared.where("token is null").groupBy("key").agg(best.alias("best"), other.alias("other"))
    both = named.select("key", F.explode(F.array(F.struct(F.col("best").alias("lead"), F.lit(True).alias("first")), F.struct(F.col("other").alias("lead"), F.lit(False).alias("first")))).alias("x"))
    own, its = keys.select("key", "cid", "n"), keys.select(F.col("key").alias("lead"), F.col("cid").alias("gid"), F.col("n").alias("m"))
    return staged(both.select("key", "x.*").where("lead is not null").join(own, "key").join(its, "lead").select("cid", "n", "gid", "m", "first"), "leads")


def _stars(docs: DataFrame, leads: DataFrame, keys: DataFrame, t: Threshold) -> DataFrame:
    """Links of sets with their leaders; a leader is a group of one and of a higher rank."""
    fit = leads.where((F.col("cid") != F.col("gid")) & t.fit(F.col("n"), F.col("m")))
    stars = staged(fit.select("gid", "cid").distinct(), "stars")
    queries = stars.select("gid", "cid", F.col("cid").alias("comp"), F.lit(0).cast("long").alias("rank"))
    members = stars.select("gid").distinct().select("gid", F.col("gid").alias("cid"), F.col("gid").alias("comp"), F.lit(1).cast("long").alias("rank"))
    links = _open(docs, queries, members, keys, t)
    discard(stars)
    return links


@dataclass
class Joined:
    """Tables of a join: sets (doc_id, hi, lo, n), classes (hi, lo, cid, n, rows; cid is the smallest doc_id), shared (see
    _shared), keys (key, cid, n, bits) of the sets in shared, linked (cid, comp)."""

    sets: DataFrame
    classes: DataFrame
    shared: DataFrame
    keys: DataFrame
    linked: DataFrame

    def drop(self) -> None:
        """Deletes what is not needed to answer for documents."""
        discard(self.shared, self.keys)


def _left(shared: DataFrame, info: DataFrame) -> DataFrame:
    """token, early and what info has of the sets of those tokens that occur in different components."""
    rows, info = shared.where("token is not null").select("token", "key", "early"), sized(info)
    several = rows.join(info.select("key", "comp"), "key").groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return staged(rows.join(several, "token", "left_semi").join(info.drop("weight"), "key").drop("key"), "left")


def _join(docs: DataFrame, t: Threshold) -> Joined:
    prepare(docs.sparkSession)
    sets = staged(_sets(docs, t), "sets")
    order = _order(sets)
    some = sets.where("n > 0 and doc_id is not null")
    classes = staged(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n"), F.count("*").alias("rows")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    shared = staged(_shared(docs, order, 4 * max(1, -(-t.prefix(total) // PACKED)), t), "shared")

    # Sets of which 64 bits of the key are equal get each other's tokens; comparing the full sets tells them apart.
    # Every set with a shared token is led by another or leads one.
    star = shared.where("token is null")
    in_shared = classes.join(star.select(F.col("key").alias("lo")).unionByName(star.select(F.col("lead").alias("lo"))).distinct(), "lo", "left_semi").select("hi", "lo", "cid", "n")
    bits = sets.where("bits is not null").select("hi", "lo", "bits")
    keys = in_shared.join(bits, ["hi", "lo"]).groupBy("hi", "lo").agg(*(F.first(c).alias(c) for c in ("cid", "n", "bits")))
    keys = staged(keys.select(F.col("lo").alias("key"), "cid", "n", "bits"), "keys")

    leads = _leads(shared, keys)
    edges = _stars(docs, leads, keys, t)
    linked = _linked(edges)
    info = _placed(keys, linked)
    left = _left(shared, info)
    if not left.isEmpty():
        edges = edges.unionByName(_open_groups(docs, left, leads, info, keys, t))
        linked = _linked(edges)
    discard(left, info, leads)
    return Joined(sets.drop("bits", "tokens", "times"), classes, shared, keys, linked)


def near_components(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per document."""
    j = _join(docs, t)
    j.drop()
    out = j.classes.join(j.linked, "cid", "left").select("hi", "lo", F.coalesce("comp", "cid").alias("component_id"), "rows")
    rows = j.sets.select("doc_id", "hi", "lo", "n")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    met = join_groups(rows.where("n > 0 and doc_id is not null"), staged(out, "components"), ["hi", "lo"], "rows", j.sets.count())
    met = met.select("doc_id", "n", "component_id").unionByName(alone)
    return met.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_links(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """a, b: the cids, a below b, of every two different sets that reach the threshold; a cid is the smallest doc_id with
    the set."""
    return _all_links(docs, _join(docs, t), t)


def link_counts(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """doc_id, class_id (null without a set or an id) and n_links, the number of documents with another set that a
    document is linked with; one row per document."""
    j = _join(docs, t)
    links = staged(_all_links(docs, j, t), "all_links")
    j.drop()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = j.sets.where("n > 0 and doc_id is not null").select("doc_id", "hi", "lo")
    weights = rows.distinct().groupBy("hi", "lo").agg(F.count("*").alias("docs")).join(j.classes.select("hi", "lo", "cid"), ["hi", "lo"])
    n = both.join(weights.select(F.col("cid").alias("b"), "docs"), "b").groupBy("a").agg(F.sum("docs").alias("n_links"))
    out = j.classes.join(n, F.col("cid") == F.col("a"), "left").select("hi", "lo", F.col("cid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "rows")
    met = join_groups(rows, staged(out, "link_counts"), ["hi", "lo"], "rows", j.sets.count()).select("doc_id", "class_id", "n_links")
    alone = j.sets.where("n = 0 or doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return met.unionByName(alone)


def _matrix(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Of each token and group (columns by): the sizes of the group's sets that have the token, and of those that have it early."""
    n = F.col("n")
    return rows.groupBy("token", *by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.when(F.col("early"), n)).alias("least_early"), *more)


def _meets(t: Threshold) -> Column:
    """Whether a set of n with a token can be linked with one that the row of the matrix stands for. Of two linked sets
    the smaller has a shared token in its early part."""
    n = F.col("n")
    early = (F.col("least_early") <= n) | (F.col("early") & (F.col("most") >= n))
    return (100 * n >= t.percent * F.col("least")) & (100 * F.col("most") >= t.percent * n) & F.coalesce(early, F.lit(False))


def _all_links(docs: DataFrame, j: Joined, t: Threshold) -> DataFrame:
    # Linked sets are in one component, so a set asks the groups of its own component that have a token with it and a
    # set of a smaller cid. Each set counts as a component of its own in the comparison, so none is left out.
    info = _placed(j.keys, j.linked).where("rank > 1")  # with keys, by which shared names the sets
    parts = F.ceil(F.greatest(F.col("rank") / GROUP_SETS, F.col("weight") / GROUP_TOKENS))
    gid = F.xxhash64("comp", F.pmod(F.xxhash64("cid", F.lit("g")), parts))
    own = staged(info.select("key", "cid", "n", F.col("comp").alias("of"), gid.alias("gid")), "link_groups")
    rows = staged(j.shared.where("token is not null").select("token", "key", "early").join(own, "key").drop("key"), "link_tokens")
    matrix = staged(_matrix(rows, ["of", "gid"], F.min("cid").alias("first")), "link_matrix")
    asks = rows.drop("gid").join(matrix, ["token", "of"]).where((F.col("first") < F.col("cid")) & _meets(t))
    each = [F.col("cid").alias("comp"), F.lit(0).cast("long").alias("rank")]
    asks = staged(asks.select("gid", "cid", *each).distinct(), "link_asks")
    members = own.select("gid", "cid", *each).join(asks.select("gid").distinct(), "gid", "left_semi")
    found = _open(docs, asks, members, j.keys, t)
    discard(rows, matrix, asks, own)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open_groups(docs: DataFrame, left: DataFrame, leads: DataFrame, info: DataFrame, keys: DataFrame, t: Threshold) -> DataFrame:
    """Links between components, over tokens (left: token, early and what info has) that occur in several."""
    # A component is cut into groups by hash; sets without links are grouped with those that share a leader and have
    # about their size, and these groups are cut by hash too.
    parts = F.ceil(F.greatest(F.col("rank") / GROUP_SETS, F.col("weight") / GROUP_TOKENS))
    cut = lambda *by: F.xxhash64(*by, F.pmod(F.xxhash64("cid", F.lit("g")), parts))
    info = info.join(left.select("cid").distinct(), "cid", "left_semi").select("cid", "n", "comp", "rank", "weight")
    linked = info.where("rank > 1").select("cid", "comp", "rank", cut("comp").alias("gid"))
    band = F.floor(F.log(F.col("n").cast("double")) * 10).alias("band")
    kin = info.where("rank = 1").join(leads.where("first").select("cid", F.col("gid").alias("leader")), "cid", "left")
    kin = staged(kin.select("cid", "comp", "n", F.coalesce("leader", "cid").alias("leader"), band), "kin")
    size = kin.groupBy("leader", "band").agg(F.count("*").alias("rank"), F.sum("n").alias("weight"))
    alone = kin.join(size, ["leader", "band"]).select("cid", "comp", F.lit(1).cast("long").alias("rank"), cut("leader", "band").alias("gid"))
    own = staged(linked.unionByName(alone), "grouped")

    # From the smaller component to the larger; place tells which is which.
    place = F.struct(F.col("rank").alias("rank"), (-F.col("comp")).alias("comp"))
    matrix = staged(_matrix(left.join(sized(own).select("cid", "gid"), "cid"), ["gid"], F.max(place).alias("best")), "matrix")
    asks = left.join(matrix, "token").where(F.col("best") > place)
    n, hits = F.col("n"), F.sum(_meets(t).cast("int")) > 0
    enough = F.count("*") >= F.least(t.common(n, F.min("least")), t.common(n, F.max("most")))
    asks = asks.groupBy("gid", "cid", "comp", "rank", "n").agg(hits.alias("hits"), enough.alias("enough")).where("hits and enough")
    asks = staged(asks.select("gid", "cid", "comp", "rank"), "asks")
    links = _open(docs, asks, own.join(asks.select("gid").distinct(), "gid", "left_semi").select("gid", "cid", "comp", "rank"), keys, t)
    discard(kin, own, matrix, asks)
    return links


def drop_near_copies(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """The rows of docs, with their columns, of which one document of each component stays: that with the smallest id.
    Rows that repeat this id are the same document and stay; so do rows with a null id. Texts are not shuffled unless
    very many documents go."""
    (gone_id,) = fresh(docs, "gone")
    gone = near_components(docs, t).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(sized(staged(gone, "gone")), docs["doc_id"] == F.col(gone_id), "left_anti")
