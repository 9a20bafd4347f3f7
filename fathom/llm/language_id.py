"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of a language's most frequent character n-grams, n from 1 to 3, in order of rank. A document's
own most frequent n-grams are ranked too, and each language is charged the distance between the two ranks, or the
largest distance for an n-gram that its profile lacks. The language with the smallest sum is predicted.
n-grams are numbers made of their code points, so that a text's n-grams are counted by sorting one array; a word's ends
count as a character, and n-grams of equal frequency are in the order of their numbers.

Profiles are fitted on the whole texts of all labelled documents that are not held out. Who wants a bounded fit gives
fit_docs; then those whose hash is lowest are taken, about fit_docs of each language. Predictions read whole texts. score is
1 less the smallest distance over the largest possible.

Edge cases: texts of any length are read whole, in memory that is a multiple of a text; a null text, or one without a
letter, is und with score 0; ties go to the language that sorts first; with
no labelled rows everything is und; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import computed, prepare, sized, staged

#: n-grams of a profile and of a document; the languages' profiles are this long whatever the corpus.
PROFILE = 400
#: The least score with which a language counts as found: words of a profile's language, even single ones, score 0.29 and more,
#: texts in other scripts with a few Latin words 0.14 at most.
MIN_SCORE = 0.2
#: n-grams that a task adds up, and characters of texts that are counted together when profiles are fitted.
HELD, CHUNK = 300_000, 1 << 15
#: Marks of numbers that stand for one and two characters; those of three need no mark.
_ONE, _TWO = np.uint64(3 << 62), np.uint64(1 << 63)
_PLACE = np.uint64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's words, n from 1 to 3, and how often each occurs; what is no letter ends a word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.zeros(len(codes) + 2, dtype=np.uint64)
    c[1:-1] = np.where(_letters()[codes], codes, 0)
    a, b, z = c[:-2], c[1:-1], c[2:]
    inner = b > 0
    one = b[inner] | _ONE
    two = (c[:-1] << _PLACE | c[1:])[(c[:-1] | c[1:]) > 0] | _TWO
    three = (a << _PLACE << _PLACE | b << _PLACE | z)[inner]
    found = np.sort(np.concatenate([one, two, three]))
    if not len(found):
        return found, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[at], np.diff(np.append(at, len(found)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _labelled(docs: DataFrame, fit_docs: int | None) -> DataFrame:
    """Labelled rows for fitting; about fit_docs of each language if given, by the hash of the id. Counts are small; texts of
    other rows are not kept."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if fit_docs is None:
        return labelled.select("lang", "text")
    rank = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1_000_000))
    counts = staged(labelled.groupBy("lang").agg((F.lit(1e6 * fit_docs) / F.count("*")).alias("_below")), "labels")
    return labelled.select("lang", "text", rank.alias("_rank")).join(sized(counts), "lang").where("_rank < _below").select("lang", "text")


def _chunks(langs: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """Texts of a language joined by line ends, about CHUNK characters at once."""
    held: dict[str, tuple[list[str], list[int]]] = {}
    for lang, text in zip(langs, texts):
        own, size = held.setdefault(lang, ([], [0]))
        own.append(text)
        size[0] += len(text)
        if size[0] >= CHUNK:
            yield lang, "\n".join(held.pop(lang)[0])
    for lang, (own, _) in held.items():
        yield lang, "\n".join(own)


def _added(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and their counts, of two such pairs together."""
    found, n = map(np.concatenate, zip(one, other))
    order = np.argsort(found, kind="stable")
    found, n = found[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[at], np.add.reduceat(n, at)


def fit_profiles(docs: DataFrame, fit_docs: int | None = None, size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language: at most size n-grams, most frequent first, ties by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (found, n) in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            counts.clear()

        for b in batches:
            for lang, text in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = grams(text)
                if len(own[0]):
                    counts[lang] = _added(counts[lang], own) if lang in counts else own
                if sum(len(found) for found, _ in counts.values()) > HELD:
                    yield from out()
        yield from out()

    prepare(docs.sparkSession)
    counted = _labelled(docs, fit_docs).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):  # size rows a language at most
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranker:
    """Predicts by out-of-place distance."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        ranked = [np.array(profiles[lang], dtype=np.int64) for lang in self.langs]
        self.known = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *ranked]))
        self.place = np.full((len(self.langs), len(self.known) + 1), -1, dtype=np.int64)
        for k, own in enumerate(ranked):
            self.place[k, np.searchsorted(self.known, own)] = np.arange(len(own))

    def top(self, text: str) -> np.ndarray:
        """The text's most frequent n-grams, most frequent first."""
        found, n = grams(text)
        if len(found) > self.size:  # ties at the end of the list are kept until they are put in order
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            found, n = found[n >= least], n[n >= least]
        found = found.astype(np.int64)
        return found[np.lexsort((found, -n))[: self.size]]

    def predict(self, text: str | None) -> tuple[str, float]:
        own = self.top(text) if text else np.zeros(0, dtype=np.int64)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        place = self.place[:, np.where(self.known[at] == own, at, len(self.known))]
        far = np.where(place < 0, self.size, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is an input of the prediction."""

    def worker():
        ranker = Ranker(profiles, size)

        def make(texts: list[str | None]) -> dict[str, list]:
            found = [ranker.predict(t) for t in texts]
            return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return make

    own = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return computed(own, ["doc_id", "held_out"], ["text"], "lang_pred string, score double", worker)


def identify(docs: DataFrame, fit_docs: int | None = None) -> DataFrame:
    """Fits profiles on the labelled documents and predicts the language of every document."""
    return predict(docs, fit_profiles(docs, fit_docs))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, fit_docs: int | None = None) -> DataFrame:
    """The rows of docs, with their columns, whose text has a language of the profiles with at least min_score."""
    ranked = fit_profiles(docs, fit_docs)

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranker = Ranker(ranked)
        for texts in batches:
            found = [ranker.predict(t) for t in texts]
            yield pd.Series([lang != "und" and score >= min_score for lang, score in found])

    prepare(docs.sparkSession)
    return docs.where(known(docs["text"]))
