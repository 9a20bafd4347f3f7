"""Token ids in a store of static range asymmetric numeral systems (rANS).

A store is a folder with two Parquet tables, so that any file system Spark knows can hold it:

* table: id, freq. The shared frequencies of all ids, scaled to a sum of 2**BITS.
* blocks: shard, block, first (ids of the shard before it), n_ids, states, words, payload_crc32, ids_crc32 and the pieces
  of documents inside (doc_ids, nth, lengths, whole). Blocks hold BLOCK ids (the last of a shard fewer) and are coded
  independently: LANES interleaved coders each take every LANES-th id. states are the checkpoint from which a decoder
  starts, the CRCs are checked on reading, and a decoder must end in the coders' first state.

Shards are ranges of doc_id in ascending order (null first; equal ids by their token ids). Tokens are counted over the
whole corpus before any block is written.

Edge cases: a null or empty text has the end id alone; a text of any length is encoded whole and cut into blocks; an empty table makes a store without blocks and an empty result;
repeated rows are stored each; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import computed, discard, prepare, same, staged, workspace

BITS, BLOCK, LANES = 20, 65_536, 64
LOW = np.uint64(1 << 31)
#: Blocks that are coded side by side, which only saves calls of numpy.
SIDE = 64
#: Ids of a shard, about; shards are tasks.
SHARD_IDS, MAX_SHARDS = 4_000_000, 20_000
#: Words and parts of words whose ids a worker keeps; beyond that it starts anew.
MEMO = 800_000
#: Texts that are encoded together; more would leave the processor's caches.
STEP = 100

_ODD_SPACES = tuple("\x1c\x1d\x1e\x1f")  # Python takes them for white space, the tokenizer does not


#: How a tokenizer that this class may take apart cuts lower-cased text (a fixed pattern of its file).
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ASCII_CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ALL_CUTS = regex.compile(_CUTS)
#: The last character of the Latin, Greek and Cyrillic blocks. Of those beyond, the versions of Unicode that libraries
#: know do not all have the same letters, so words with them are left to the tokenizer whole.
_SETTLED = "\u052f"
#: The same cuts for texts in Latin-1, which composition of characters leaves alone, as bytes in lower case.
_LATIN_LOWER = bytes(ord(chr(k).lower()) for k in range(256))
_LETTER, _DIGIT, _SPACE = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_LATIN_CUTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%b]+|[%b]|[^%b%b%b]+" % (_LETTER, _DIGIT, _SPACE, _LETTER, _DIGIT))


def _latin_parts(text: str) -> list[bytes] | None:
    """The parts of a text in Latin-1, in lower case; None for others and if it could hold a token of the tokenizer's own."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if b"<|" in data else _LATIN_CUTS.findall(data.translate(_LATIN_LOWER))


class WordTokenizer:
    """Encodes texts; if the tokenizer drops white space and never looks across it, each part of a word is encoded once.

    Texts in Latin-1 are put in lower case and cut into parts as the tokenizer itself does it, so its model alone is asked, and
    ids of parts are kept. Of other texts the ids of words are kept, which are cut further alike. The ids of
    parts that are encoded together fall apart after each id that ends a word. Words that case folding or composition of
    characters could treat by context, or that have letters of newer blocks, are left to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 65_536 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        config = json.loads(self.tokenizer.to_str())
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        cut = steps[0].get("pattern", {}).get("Regex") == _CUTS and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        #: Whether texts may be taken apart; texts of a tokenizer of another kind are encoded whole.
        self.by_words = cut and config["model"].get("end_of_word_suffix") == "</w>"
        #: The model without the steps before it, for parts that are cut already.
        self.inner = self.tokenizer
        if self.by_words:
            own = [{"type": "CharDelimiterSplit", "delimiter": " "}, *steps[1:]]
            bare = {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": own}}
            self.inner = Tokenizer.from_str(json.dumps(config | bare))
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items() if token.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of dtype."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; parts and words that are new are learnt together."""
        if not self.by_words:
            return [self._bytes(found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = []
        for k in range(0, len(texts), STEP):
            if len(self.memo) + len(self.parts) > MEMO:
                self.memo, self.parts = {}, {}
            out += self._by_parts(texts[k : k + STEP])
        return out

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, from those of its parts, or of its words where it is not in Latin-1."""
        cuts = list(map(_latin_parts, texts))
        rest = [k for k, own in enumerate(cuts) if own is None]
        known = self.parts.get
        found = [list(map(known, own or ())) for own in cuts]
        gaps = [[k for k, ids in enumerate(own) if ids is None] for own in found]
        if new := list({cuts[k][at] for k, own in enumerate(gaps) for at in own}):
            self.parts.update(zip(new, self._encode_parts([part.decode("latin-1") for part in new])))
            for own, ids, places in zip(cuts, found, gaps):
                for at in places:
                    ids[at] = self.parts[own[at]]
        out = list(map(b"".join, found))
        for k, ids in zip(rest, self._by_words([texts[k] for k in rest])):
            out[k] = ids
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, from those of its words."""
        whole = {k for k, t in enumerate(texts) if any(c in t for c in _ODD_SPACES)}
        split = [[] if k in whole else t.split() for k, t in enumerate(texts)]
        memo = self.memo
        if new := set().union(*split).difference(memo):
            self._learn(new)
        out = [b"".join(map(memo.__getitem__, own)) for own in split]
        for k in whole:
            out[k] = self._bytes(self.tokenizer.encode(texts[k], add_special_tokens=False).ids)
        return out

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each of parts, which are cut and in lower case."""
        ids = np.array(self.inner.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts) or stops[-1] != len(ids):  # a part that the vocabulary has no end for
            return [self._bytes(self.tokenizer.encode(p, add_special_tokens=False).ids) for p in parts]
        data, at = ids.tobytes(), [0, *(stops * ids.itemsize).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, words: set[str]) -> None:
        memo, parts = self.memo, {}
        plain, others = [], []
        for w in words:
            (plain if w.isascii() and w.isalpha() else others).append(w)
        low = " ".join(plain).lower().split(" ") if plain else []
        cuts: dict[str, list[str]] = {}
        whole: list[str] = []
        for w in others:
            if w.isascii():
                if "<|" in w:
                    whole.append(w)
                else:
                    cuts[w] = _ASCII_CUTS.findall(w.lower())
            elif max(w) > _SETTLED or "Σ" in w or "<|" in w or not unicodedata.is_normalized("NFC", w):
                whole.append(w)
            elif w.isalpha() and (own := w.lower()).isalpha():
                cuts[w] = [own]
            else:
                cuts[w] = _ALL_CUTS.findall(w.lower())
        if new := list(set(low).union(*cuts.values())):
            parts = dict(zip(new, self._encode_parts(new)))
        memo.update(zip(plain, map(parts.__getitem__, low)))
        for w, own in cuts.items():
            memo[w] = b"".join([parts[p] for p in own])
        if whole:
            for word, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
                memo[word] = self._bytes(found.ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, ids (binary, little-endian 16 or 32 bits as the vocabulary needs) of every whole text, with the end id."""

    def worker():
        own = _tokenizer(path)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        return lambda texts: {"ids": [ids + end for ids in own.encode_all([t or "" for t in texts])]}

    return computed(docs, ["doc_id"], ["text"], "ids binary", worker)


def scale(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies with sum 2**bits; every id that occurs has 1 at least."""
    total, goal = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * goal // total), 0)
    order = np.argsort(-freq, kind="stable")
    rest, k = goal - int(freq.sum()), 0
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:  # the ones that were raised to 1 are taken from the most frequent
        take = min(-rest, int(freq[order[k]]) // 2)
        freq[order[k]] -= take
        rest, k = rest + take, k + 1
    return freq.astype(np.int64)


class Coder:
    """Interleaved rANS over equal-length blocks; numpy advances all lanes of all blocks together."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.top = self.freq << np.uint64(63 - BITS)
        self.pad = int(np.argmax(freq)) if len(freq) else 0
        self._slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> list[tuple[bytes, bytes]]:
        """ids: (blocks, length). For each block its final states and the words in the order in which they are read."""
        n, length = ids.shape
        steps = -(-length // LANES)
        grid = np.full((n, steps * LANES), self.pad, dtype=np.int64)
        grid[:, :length] = ids
        grid = grid.reshape(n, steps, LANES)
        x = np.full((n, LANES), LOW, dtype=np.uint64)
        words, out = np.zeros((n, steps, LANES), dtype="<u4"), np.zeros((n, steps, LANES), dtype=bool)
        shift, bits, low = np.uint64(32), np.uint64(BITS), np.uint64(0xFFFFFFFF)
        for t in range(steps - 1, -1, -1):
            s = grid[:, t]
            f = self.freq[s]
            full = x >= self.top[s]
            out[:, t] = full
            words[:, t] = x & low
            x = np.where(full, x >> shift, x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.start[s]
        return [(x[b].astype("<u8").tobytes(), words[b][out[b]].tobytes()) for b in range(n)]

    def decode(self, states: list[bytes], words: list[bytes], length: int) -> np.ndarray:
        """ids: (blocks, length). Raises if a lane does not end where the encoder began."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        n, steps = len(states), -(-length // LANES)
        x = np.frombuffer(b"".join(states), dtype="<u8").reshape(n, LANES).astype(np.uint64)
        flat = np.append(np.frombuffer(b"".join(words), dtype="<u4").astype(np.uint64), np.uint64(0))
        at = np.cumsum([0] + [len(w) // 4 for w in words[:-1]], dtype=np.int64)
        ids = np.zeros((n, steps, LANES), dtype=np.uint32)
        mask, bits, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
        for t in range(steps):
            slot = x & mask
            s = self._slots[slot.astype(np.int64)]
            ids[:, t] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            need = x < LOW
            rank = np.cumsum(need, axis=1)
            new = flat[np.minimum(at[:, None] + rank - 1, len(flat) - 1)]
            x = np.where(need, (x << shift) | new, x)
            at = at + rank[:, -1]
        if (x != LOW).any():
            raise ValueError("a block does not end in the first state")
        return ids.reshape(n, -1)[:, :length]


#: Columns of the blocks, in Arrow and as Spark reads them.
_BLOCK_COLUMNS = pa.schema(
    [(c, pa.int32()) for c in ("shard", "block")] + [("first", pa.int64()), ("n_ids", pa.int32())] + [(c, pa.binary()) for c in ("states", "words")]
    + [(c, pa.int64()) for c in ("payload_crc32", "ids_crc32")] + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "nth", "lengths")] + [("whole", pa.list_(pa.bool_()))]
)
_BLOCK_DDL = (
    "shard int, block int, first long, n_ids int, states binary, words binary, payload_crc32 long, ids_crc32 long, "
    "doc_ids array<long>, nth array<long>, lengths array<long>, whole array<boolean>"
)


def _blocks(batches: Iterator[pa.RecordBatch], freq: np.ndarray, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    """The block rows of a shard, from its documents in order."""
    coder, shard = Coder(freq), TaskContext.get().partitionId()
    waiting, held, pieces, first, block, nth = [], 0, deque(), 0, 0, 0

    def pack(ids: np.ndarray, length: int) -> pa.RecordBatch:
        nonlocal first, block
        coded, rows = coder.encode(ids.reshape(-1, length)), []
        for k, (states, words) in enumerate(coded):
            own, left = [], length
            while left:
                doc, number, size, total = pieces.popleft()
                take = min(size, left)
                own.append((doc, number, take, total))
                left -= take
                if take < size:
                    pieces.appendleft((doc, number, size - take, total))
            rows.append(
                {
                    "shard": shard, "block": block, "first": first, "n_ids": length, "states": states, "words": words,
                    "payload_crc32": zlib.crc32(words, zlib.crc32(states)), "ids_crc32": zlib.crc32(ids[k * length : (k + 1) * length].astype("<u4").tobytes()),
                    "doc_ids": [p[0] for p in own], "nth": [p[1] for p in own], "lengths": [p[2] for p in own], "whole": [p[2] == p[3] for p in own],
                }
            )
            first, block = first + length, block + 1
        return pa.RecordBatch.from_pylist(rows, schema=_BLOCK_COLUMNS)

    for b in batches:
        for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
            size = len(ids) // dtype.itemsize
            pieces.append((doc, nth, size, size))
            waiting.append(ids)
            held, nth = held + size, nth + 1
        if held >= SIDE * BLOCK:
            rest = np.frombuffer(b"".join(waiting), dtype=dtype)
            n = held // BLOCK
            for k in range(0, n, SIDE):
                yield pack(rest[k * BLOCK : min(k + SIDE, n) * BLOCK], BLOCK)
            waiting, held = [rest[n * BLOCK :].tobytes()], held - n * BLOCK
    rest = np.frombuffer(b"".join(waiting), dtype=dtype)
    for length in (BLOCK, held % BLOCK):
        n = held // BLOCK if length == BLOCK else 1
        if n * length:
            yield pack(rest[: n * length], length)
            rest = rest[n * length :]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Tokenizes docs and writes the store at path."""
    spark = docs.sparkSession
    size, dtype = WordTokenizer(tokenizer).size, np.dtype(WordTokenizer(tokenizer).dtype)
    tokens = staged(tokenize(docs, tokenizer, end_id), "tokens")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size, dtype=np.int64)
        for pdf in batches:
            seen += np.bincount(np.frombuffer(b"".join(pdf["ids"]), dtype=dtype), minlength=size)
        yield pd.DataFrame({"id": np.flatnonzero(seen), "n": seen[seen > 0]})

    counts = np.zeros(size, dtype=np.int64)
    for r in tokens.select("ids").mapInPandas(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]  # a row for each id of the vocabulary at most
    freq, total = scale(counts), int(counts.sum())
    spark.createDataFrame(pd.DataFrame({"id": np.flatnonzero(freq), "freq": freq[freq > 0]}), "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shards = min(MAX_SHARDS, max(1, -(-total // SHARD_IDS)))
    ordered = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(lambda batches: _blocks(batches, freq, dtype), _BLOCK_DDL).write.parquet(f"{path}/blocks")
    discard(tokens)


def _times(matrix: tuple[int, ...], v: int) -> int:
    out = 0
    for k, column in enumerate(matrix):
        out ^= column if v >> k & 1 else 0
    return out


@lru_cache(maxsize=None)
def _zero_bits(k: int) -> tuple[int, ...]:
    """What 2**k zero bits do to a CRC-32 register, as a matrix of columns."""
    if k == 0:
        return 0xEDB88320, *(1 << j for j in range(31))
    half = _zero_bits(k - 1)
    return tuple(_times(half, x) for x in half)


def _crc_shift(crc: int, zeros: int) -> int:
    """The CRC-32 register crc after so many zero bytes."""
    for k in range(zeros.bit_length()):
        if zeros >> k & 1:
            crc = _times(_zero_bits(k + 3), crc)
    return crc


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a whole from (crc, bytes) of its parts in order."""
    out = 0
    for crc, size in parts:
        out = _crc_shift(out, size) ^ crc
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks; blocks are decoded independently."""
    prepare(spark)
    rows = spark.read.parquet(f"{path}/table").collect()  # a row for each id of the vocabulary at most
    freq = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            by_length: dict[int, list[dict]] = {}
            for row in b.to_pylist():
                if zlib.crc32(row["words"], zlib.crc32(row["states"])) != row["payload_crc32"]:
                    raise ValueError("a block's payload does not match its checksum")
                by_length.setdefault(row["n_ids"], []).append(row)
            for length, rows in by_length.items():
                for k in range(0, len(rows), SIDE):
                    part = rows[k : k + SIDE]
                    ids = coder.decode([r["states"] for r in part], [r["words"] for r in part], length)
                    yield from map(inside, part, ids)

    def inside(row: dict, own: np.ndarray) -> pa.RecordBatch:
        """A row for each piece of a document in a block."""
        data = memoryview(own.astype("<u4").tobytes())
        if zlib.crc32(data) != row["ids_crc32"]:
            raise ValueError("a block's ids do not match their checksum")
        lengths = np.array(row["lengths"], dtype=np.int64)
        ends = np.cumsum(lengths)
        crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), row["lengths"])]
        count = len(lengths)
        arrays = [
            pa.array(np.full(count, row["shard"], dtype=np.int32)), pa.array(row["nth"], pa.int64()), pa.array(np.full(count, row["block"], dtype=np.int32)),
            pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(row["whole"]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "nth", "block", "doc_id", "at", "n", "crc", "whole"])

    blocks = spark.read.parquet(f"{path}/blocks")
    pieces = staged(blocks.mapInArrow(run, "shard int, nth long, block int, doc_id long, at long, n long, crc long, whole boolean"), "pieces")

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([join_crcs([(p["crc"], 4 * p["n"]) for p in own]) for own in parts], dtype="int64")

    # A document in several blocks has as many pieces as its length asks for.
    split = pieces.where(~F.col("whole")).groupBy("shard", "nth", "doc_id")
    split = split.agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("parts"))
    split = split.select("shard", "doc_id", "at", "n", joined("parts").alias("crc"))
    docs = pieces.where("whole").select("shard", "doc_id", "at", "n", "crc").unionByName(split)
    totals = staged(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")), "totals")  # a row for each shard
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(totals.select(F.col("shard").alias("_shard"), before.alias("_before")), "offsets")
    out = docs.join(offsets, same(docs["shard"], offsets["_shard"]))
    return out.select("doc_id", (F.col("at") + F.col("_before")).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs to a store in the shared folder and reads them back from it."""
    path = f"{workspace(docs.sparkSession)}/store-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer, end_id)
    return read_store(docs.sparkSession, path)
