"""SentencePiece encoding and decoding by batched numpy Viterbi.

Words of equal length advance together through the lattice of pieces: rolling hashes of all substrings that end at a
position are looked up among the sorted hashes of the pieces, every hit is compared letter by letter, and the best
candidate's length is the backpointer.

* A unigram model maximises the sum of the scores.
* In a BPE model that sum is not what its encoder maximises. There, a path is right exactly if each two neighbouring
  pieces are what merging their joint text gives, so a candidate weighs 1 if it fits the last piece of the best path to
  its start, else 0, and the maximum is taken; one fits. This gives the ids of the merge procedure itself, without
  merging words.

Texts are cut before every run of spaces, where no piece of the model may reach across. Encoded words are kept.

Edge cases: a null or empty text has no ids and decodes to an empty text; characters without a piece become their UTF-8
bytes' pieces, or the unknown id if the model has none; an empty table gives an empty result; repeated rows are encoded
each; texts of any length are cut into words, so memory is a small multiple of a batch, and words longer than a piece
cost as they are long; other columns are kept by encode_rows and ignored else.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed, fresh, prepare

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words whose ids, and pairs of pieces whose fit, a worker keeps, some 100 MB; beyond that it starts anew. 2**SLOTS pairs are kept in
#: an array besides, and GROUP words advance together.
MEMO, PAIRS, SLOTS, GROUP = 300_000, 400_000, 20, 8_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        scores, kinds, self.bpe, charsmap, self.prefix, self.squeeze = [], [], False, b"", True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, 1))  # 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if charsmap:
            raise ValueError("models with a character map are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("models whose pieces reach across words are not supported")
        self.kinds, self.scores = np.array(kinds), np.array(scores)
        self.unknown = kinds.index(2)
        self.byte_ids = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if kinds[k] == 6}
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 65_536 else "<u4")
        usable = [k for k, kind in enumerate(kinds) if kind in (1, 4)]
        self.score_of = {self.pieces[k]: scores[k] for k in usable}
        self.longest = max(len(self.pieces[k]) for k in usable)
        self.letters = np.zeros((len(kinds), self.longest), dtype=np.uint32)
        keys = np.zeros(len(usable), dtype=np.uint64)
        for n, k in enumerate(usable):
            codes = np.array([ord(c) for c in self.pieces[k]], dtype=np.uint32)
            self.letters[k, : len(codes)] = codes
            keys[n] = _hashes(codes[None, :])[0, -1]
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.keys, self.ids = keys[order], np.array(usable)[order]
        self.output = [bytes([int(p[1:-1], 16)]) if kinds[k] == 6 else b"" if kinds[k] == 3 else " ⁇ ".encode() if kinds[k] == 2 else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by the merge procedure: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score_of.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of rows of code points: (rows, length + 1)."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + mixed[:, k]
    return out


class Codec:
    def __init__(self, path: str):
        self.model = Model(path)
        self.memo: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.powers = np.ones(self.model.longest + 1, dtype=np.uint64)
        self.powers[1:] = np.cumprod(np.full(self.model.longest, BASE))
        # The pairs of pieces that were asked for last, by a hash, so that most are answered without the dict.
        self.asked, self.answers = np.full(1 << SLOTS, -1, dtype=np.int64), np.zeros(1 << SLOTS, dtype=bool)
        self.lengths = np.array([len(x) for x in self.model.output], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.model.output), dtype=np.uint8)

    def _found(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each size, from 1, the piece that each row has at each start, -1 if none."""
        m, (n, length), out = self.model, codes.shape, []
        hashes = _hashes(codes)
        for size in range(1, min(m.longest, length) + 1):
            key = hashes[:, size:] - hashes[:, :-size] * self.powers[size]
            at = np.minimum(np.searchsorted(m.keys, key.ravel()), len(m.keys) - 1)
            found = np.where(m.keys[at] == key.ravel(), m.ids[at], -1)
            hit = np.flatnonzero(found >= 0)
            row, start = np.divmod(hit, length - size + 1)
            letters = m.letters[found[hit]]
            same = letters[:, size] == 0 if size < m.longest else np.ones(len(hit), dtype=bool)
            for k in range(size):
                same &= letters[:, k] == codes[row, start + k]
            found[hit[~same]] = -1
            out.append(found.reshape(n, -1))
        return out

    def _fit(self, last: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Whether piece new may follow piece last (-1: at the start of a word, -2: after an unknown character)."""
        m = self.model
        pairs = (last + 2) * len(m.pieces) + new
        slot = (pairs.astype(np.uint64) * BASE >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.answers[slot]
        rest = np.flatnonzero(self.asked[slot] != pairs)
        if len(rest):
            unknown, at = np.unique(pairs[rest], return_inverse=True)
            answers = np.zeros(len(unknown), dtype=bool)
            for k, pair in enumerate(unknown.tolist()):
                known = self.fits.get(pair)
                if known is None:
                    a, b = divmod(pair, len(m.pieces))
                    want = [m.pieces[a - 2], m.pieces[b]] if a > 1 else [m.pieces[b]]
                    known = self.fits[pair] = m.merge("".join(want)) == want
                answers[k] = known
            out[rest] = answers[at]
            self.asked[slot[rest]], self.answers[slot[rest]] = pairs[rest], answers[at]
        return out

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers (sizes of the last piece) and pieces for each row and end: at each end the candidates of all sizes
        are weighed together, and the best is kept. Of a BPE model a candidate weighs 1 if it fits, which one does."""
        m, (n, length) = self.model, codes.shape
        found, rows = self._found(codes), np.arange(n)
        back, piece = np.ones((n, length + 1), dtype=np.int64), np.full((n, length + 1), -1, dtype=np.int64)
        worst = m.scores[m.ids].min() - 10
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, length + 1):
            sizes = np.arange(min(m.longest, end), 0, -1)
            here = np.stack([found[k - 1][:, end - k] for k in sizes], axis=1)
            if m.bpe:
                weight = np.zeros(here.shape)
                row, column = np.nonzero(here >= 0)
                weight[row, column] = self._fit(piece[row, end - sizes[column]], here[row, column])
                at = weight.argmax(axis=1)
                known = weight[rows, at] > 0
            else:
                weight = np.where(here >= 0, m.scores[here], -np.inf)
                weight[:, -1] = np.where(here[:, -1] >= 0, weight[:, -1], worst)
                weight += best[:, end - sizes]
                at = weight.argmax(axis=1)
                best[:, end] = weight[rows, at]
                known = here[rows, at] >= 0
            back[:, end] = np.where(known, sizes[at], 1)
            piece[:, end] = np.where(known, here[rows, at], -2)
        return back, piece

    def _learn(self, words: list[str], keys: list[str]) -> None:
        """Encodes new words, those of one length together, and keeps their ids under their keys."""
        m, by_length = self.model, {}
        for w, key in zip(words, keys):
            by_length.setdefault(len(w), []).append((w, key))
        for length, both in by_length.items():
            for start in range(0, len(both), GROUP):
                self._learn_group(both[start : start + GROUP], length)

    def _learn_group(self, both: list[tuple[str, str]], length: int) -> None:
        m, n = self.model, len(both)
        codes = np.frombuffer("".join([w for w, _ in both]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, length)
        back, piece = self._viterbi(codes)
        # All words are traced back together, from their ends.
        rows, end, steps = np.arange(n), np.full(n, length), []
        while (end > 0).any():
            steps.append(np.where(end > 0, piece[rows, end], -1))
            end = np.where(end > 0, end - back[rows, end], 0)
        ids = np.stack(steps[::-1], axis=1)
        counts = (ids != -1).sum(axis=1)
        data = ids[ids != -1].astype(m.dtype).tobytes()
        ends = (np.cumsum(counts) * m.dtype.itemsize).tolist()
        odd = set(np.flatnonzero((ids == -2).any(axis=1)).tolist())
        a = 0
        for row, (b, (word, key)) in enumerate(zip(ends, both)):
            self.memo[key] = data[a:b] if row not in odd else self._with_unknown(word, ids[row][ids[row] != -1].tolist())
            a = b

    def _with_unknown(self, word: str, ids: list[int]) -> bytes:
        """The ids of a word with characters (-2) that no piece has: their bytes' pieces, or the unknown id once a run."""
        m, out, at = self.model, [], 0
        for k in ids:
            if k >= 0:
                out.append(k)
                at += len(m.pieces[k])
                continue
            if m.byte_ids:
                out += [m.byte_ids[x] for x in word[at].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != m.unknown:
                out.append(m.unknown)
            at += 1
        return np.array(out, dtype=m.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of the model's dtype."""
        m, split = self.model, []
        if len(self.memo) > MEMO:
            self.memo = {}
        if len(self.fits) > PAIRS:
            self.fits = {}
        for text in texts:
            text = text or ""
            if m.squeeze:
                text = re.sub(" +", " ", text.strip(" "))
            if m.prefix and text and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
                split.append(text.split(" "))  # each word stands for itself behind a space
                continue
            text = text.replace(" ", SPACE)
            split.append([w if w[0] == SPACE else " " + w for w in _WORDS.findall(SPACE + text if m.prefix and text else text)])
        new = sorted(w for w in set().union(*split) if w not in self.memo)
        # A key with a space in front is a word without one, a key that starts with SPACE is as it is.
        self._learn([w[1:] if w[:1] == " " else w if w[:1] == SPACE else SPACE + w for w in new], new)
        return [b"".join(map(self.memo.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        own = np.frombuffer(ids, dtype=self.model.dtype).astype(np.int64)
        sizes = self.lengths[own]
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[own] - (np.cumsum(sizes) - sizes), sizes)
        text = self.bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_rows(docs: DataFrame, model: str) -> DataFrame:
    """The rows of docs with their columns, piece_ids (array<int>) and decoded (from these ids) in place of any of that name."""
    kind = "struct<piece_ids: array<int>, decoded: string>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for texts in batches:
            coded = own.encode(list(texts))
            yield pd.DataFrame({"piece_ids": [np.frombuffer(c, dtype=own.model.dtype).astype(np.int32) for c in coded], "decoded": [own.decode(c) for c in coded]})

    prepare(docs.sparkSession)
    (coded,) = fresh(docs, "coded")
    made = docs.withColumn(coded, run(docs["text"]))
    kept = [made[c] for c in docs.columns if c.lower() not in ("piece_ids", "decoded")]
    return made.select(*kept, f"{coded}.piece_ids", f"{coded}.decoded")


def digest_rows(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_sha256; one row per document."""

    def worker():
        own = codec(model)

        def make(texts: list[str | None]) -> dict[str, list]:
            coded = own.encode(texts)
            ids = [np.frombuffer(c, dtype=own.model.dtype).astype("<u4") for c in coded]
            decoded = [hashlib.sha256(own.decode(c).encode("utf-8", "surrogatepass")).hexdigest() for c in coded]
            return {"n_pieces": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids], "decoded_sha256": decoded}

        return make

    return computed(docs, ["doc_id"], ["text"], "n_pieces long, ids_crc32 long, decoded_sha256 string", worker)
