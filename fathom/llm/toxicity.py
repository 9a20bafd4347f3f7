"""Toxicity by a learned lexicon whose misspellings are found by Levenshtein automata.

Learning. Of labelled documents a bounded sample is taken, at most about fit_docs of each class, by the hash of the id.
Words and stems (beginnings of words) are counted by the different words that stand before them, so that copies of a text
count once; those that toxic text has far more often, by their likelihood ratio G2, become the lexicon, of several that
contain each other the strongest alone.
Then the lexicon is matched against the sample, and each term gets a weight for each edit distance: the log ratio of
its rates in toxic and in clean text. A misspelling that clean text has as well thus weighs nothing.

Matching. The lexicon is a trie. Every distinct word of a batch has a Levenshtein automaton, held as the bits of an
integer for each number of edits; one walk through the trie advances the automata of all words at once, and words whose
automaton dies leave the walk. Words of four letters and more may have one edit, those of eight and more two,
stems of five and more one. A word that matches several terms goes to the heaviest.

Context. Each hit is weighed by the words within radius of it: quotation marks around it and words of reporting lower its
weight, words of address raise it. A document's sums, all hits and the heaviest window, less what clean text of
its length has by chance, enter a logistic regression that is fitted on the same sample.

Edge cases: a null or empty text has no hits and gets the score of such texts; without labels of both classes the lexicon
is empty, and the score is the share of toxic labels (0 without labels); null labels and labels without a document are
ignored, of labels that repeat for an id the largest counts; a null doc_id is not held out; repeated rows are scored one
by one; terms of equal strength go by length, then text; texts of any length are matched whole, in memory that is a
multiple of a batch; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import prepare, staged, text_or_empty

#: Documents of each class that the model is fitted on, about, and terms of the lexicon, at most.
FIT_DOCS, LEXICON = 4000, 300
#: A term is met so often in toxic text at least, so many times as often as in clean text, and with such a G2.
MIN_TIMES, MIN_RATIO, MIN_G2 = 8, 8.0, 40.0
#: Letters of a stem, and of a word that are looked at.
SHORTEST_STEM, LONGEST_STEM, WIDTH = 3, 10, 32
#: Hits below this weight do not count.
LEAST_WEIGHT = 1.0
#: A misspelling is taken to be so rare, for each edit, against the word itself, unless the sample says otherwise.
RARE = 0.1
#: Distinct words that walk through the trie together.
TOGETHER = 50_000

OPENING, CLOSING = "\"'“”„«»‘’‹›", "\"'“”„«»‘’‹›"
REPORTING = frozenset("said says wrote writes called quote quoted quotes reported according sagte schrieb zitat laut dit écrit selon citation dijo escribió según cita".split())
ADDRESSING = frozenset("you your you're youre ur du dein deine ihr euch tu ton ta toi vous votre tú tus usted ustedes eres".split())
_RUN = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W_]+(?:[*@$!.\-][^\W_]+)+")


@dataclass(frozen=True)
class Context:
    """Words on either side of a hit, and what is added to its factor of 1; the factor is floor at least."""

    radius: int = 8
    quoted: float = -0.5
    reported: float = -0.25
    addressed: float = 0.25
    floor: float = 0.1


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool = False

    @property
    def edits(self) -> int:
        if self.stem:
            return int(len(self.text) >= 5)
        return 2 if len(self.text) >= 8 else int(len(self.text) >= 4)


@dataclass(frozen=True)
class Model:
    """terms, weights (term, edits), noise (weight of hits in a word of clean text), and the regression's coefficients for
    a constant, the sum of all hits and that of the heaviest window."""

    terms: tuple[Term, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    noise: float = 0.0
    coefficients: tuple[float, float, float] = (-math.inf, 0.0, 0.0)
    context: Context = Context()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Matcher:
    """Levenshtein automata of many words, walked through the trie of a lexicon."""

    def __init__(self, terms: tuple[Term, ...], weights: np.ndarray | None = None):
        self.terms, self.weights = terms, np.ones((len(terms), 3)) if weights is None else weights
        self.root: dict = {"next": {}, "ends": [], "edits": 0}
        for k, t in enumerate(terms):
            node = self.root
            node["edits"] = max(node["edits"], t.edits)
            for c in t.text:
                node = node["next"].setdefault(c, {"next": {}, "ends": [], "edits": 0})
                node["edits"] = max(node["edits"], t.edits)
            node["ends"].append(k)

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the term that it is, or -1, and the number of edits."""
        found = [self._walk(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *part]) for part in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2

    def _walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.of, self.edits, self.best = np.full(len(words), -1), np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        self.codes, self.masks = codes, {}
        self.size = size
        self.room = (np.uint64(2) << np.minimum(size, WIDTH).astype(np.uint64)) - np.uint64(1)  # states 0 to the word's length
        alive = np.arange(len(words))
        # after e edits, before any letter of the term: up to e letters of the word may have been skipped
        start = [np.full(len(words), (2 << e) - 1, dtype=np.uint64) & self.room for e in range(self.root["edits"] + 1)]
        self._visit(self.root, alive, start)
        return self.of, self.edits

    def _mask(self, letter: str) -> np.ndarray:
        """The places of a letter in each word, as bits."""
        if letter not in self.masks:
            self.masks[letter] = np.packbits(self.codes == ord(letter), axis=1, bitorder="little").view("<u4").ravel().astype(np.uint64)
        return self.masks[letter]

    def _visit(self, node: dict, alive: np.ndarray, states: list[np.ndarray]) -> None:
        for k in node["ends"]:
            self._accept(k, alive, states)
        one = np.uint64(1)
        for letter, child in node["next"].items():
            met, room = self._mask(letter)[alive], self.room[alive]
            after: list[np.ndarray] = []
            for e in range(child["edits"] + 1):
                s = (states[e] & met) << one  # the letter is there
                if e:  # it is missing, another stands for it, or the word has a letter more
                    s = s | states[e - 1] | states[e - 1] << one | after[e - 1] << one
                after.append(s & room)
            live = np.flatnonzero(after[-1])  # fewer edits reach no more states
            if len(live):
                self._visit(child, alive[live], [s[live] for s in after])

    def _accept(self, k: int, alive: np.ndarray, states: list[np.ndarray]) -> None:
        term = self.terms[k]
        for e in range(term.edits, -1, -1):  # the fewest edits are written last
            if term.stem:
                ok = states[e] > np.uint64(1)
            else:
                ok = (states[e] >> np.minimum(self.size[alive], WIDTH).astype(np.uint64) & np.uint64(1) > 0) & (self.size[alive] <= WIDTH)
            at = alive[ok]
            weight = self.weights[k, e]
            better = (self.of[at] == k) | (self.of[at] < 0) | (weight > self.best[at]) | ((weight == self.best[at]) & (e < self.edits[at]))
            at = at[better]
            self.of[at], self.edits[at], self.best[at] = k, e, weight


def spellings(token: str) -> list[str]:
    """The words of a token with punctuation in it; signs inside a word may stand for a letter or hide it."""
    out = _RUN.findall(token)
    for m in _MASKED.findall(token):
        out += [m, "".join(_RUN.findall(m))]
    return out


class Scorer:
    """Hits and scores of the texts of a batch."""

    def __init__(self, model: Model, weighed: bool = True):
        self.model, self.weighed = model, weighed
        self.matcher = Matcher(model.terms, model.weights if weighed else None)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int, int, float]]]:
        """Tokens of each text, and (text, token, term, edits, factor) of each hit, in order."""
        tokens = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        bounds, flat = tokens.offsets.to_numpy().astype(np.int64), tokens.flatten()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        bare = pc.utf8_trim(distinct, characters=" .,;:!?()[]{}<>\"'“”„«»‘’‹›…-–—*_/")
        broken = np.flatnonzero(pc.match_substring_regex(bare, r"[^\p{L}\p{N}]").to_numpy(zero_copy_only=False))
        words = bare.to_pylist()
        parts = [(k, w) for k in broken for w in spellings(words[k])]
        of, edits = self.matcher.find(words + [w for _, w in parts])
        at = np.concatenate([np.arange(len(bare)), np.fromiter((k for k, _ in parts), dtype=np.int64, count=len(parts))])
        term, cost = np.full(len(bare), -1), np.zeros(len(bare), dtype=np.int64)
        weight = self.matcher.weights[of, edits] * (of >= 0) if len(self.model.terms) else np.zeros(len(of))
        met = np.flatnonzero((of >= 0) & (weight >= (LEAST_WEIGHT if self.weighed else 0)))
        for k in met[np.argsort(weight[met], kind="stable")]:  # the heaviest is written last
            term[at[k]], cost[at[k]] = of[k], edits[k]
        codes = coded.indices.to_numpy()
        places = np.flatnonzero(term[codes] >= 0) if len(codes) else np.zeros(0, dtype=np.int64)
        out: list[tuple[int, int, int, int, float]] = []
        texts_hit = np.searchsorted(bounds, places, side="right") - 1
        for k in np.unique(texts_hit):
            own = flat.slice(int(bounds[k]), int(bounds[k + 1] - bounds[k])).to_pylist()
            for p in places[np.searchsorted(texts_hit, k) : np.searchsorted(texts_hit, k, side="right")]:
                i = int(p - bounds[k])
                out.append((int(k), i, int(term[codes[p]]), int(cost[codes[p]]), factor(own, i, self.model.context)))
        return np.diff(bounds), out

    def features(self, texts: pa.Array) -> tuple[np.ndarray, list]:
        """A constant, the sum of all hits and that of the heaviest window of each text, the latter two over 10; and the
        hits."""
        n, hits = self.hits(texts)
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1
        reach, window, total, last = self.model.context.radius, [], 0.0, -1
        for k, i, term, edits, by in hits:
            if k != last:
                window, total, last = [], 0.0, k
            w = self.model.weights[term, edits] * by
            out[k, 1] += w
            window.append((i, w))
            total += w
            while window[0][0] < i - reach:
                total -= window.pop(0)[1]
            out[k, 2] = max(out[k, 2], total)
        chance = self.model.noise * n
        for c in (1, 2):
            out[:, c] = np.clip(out[:, c] - (chance if c == 1 else self.model.noise * (reach + 1)), 0, 40) / 10
        return out, hits

    def scores(self, features: np.ndarray) -> np.ndarray:
        c = self.model.coefficients
        if math.isinf(c[0]):
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ np.array(c), -30, 30)))


def factor(tokens: list[str], i: int, context: Context = Context()) -> float:
    """How much the hit at token i counts, by the tokens around it."""
    low, high = max(0, i - context.radius), i + context.radius + 1
    ends = lambda t: t.rstrip(".,;:!?)")[-1:]
    opened = False
    for j in range(i, low - 1, -1):
        if j < i and ends(tokens[j]) and ends(tokens[j]) in CLOSING:
            break
        if tokens[j][:1] and tokens[j].lstrip("(")[:1] in OPENING and tokens[j].lstrip("("):
            opened = True
            break
    closed = opened and any(ends(t) and ends(t) in CLOSING for t in tokens[i:high])
    near = {t.strip(".,;:!?()\"'“”«»") for t in tokens[low:high]}
    out = 1 + context.quoted * closed + context.reported * bool(near & REPORTING) + context.addressed * bool(near & ADDRESSING)
    return max(context.floor, out)


def _sampled(docs: DataFrame, labels: DataFrame, fit_docs: int) -> tuple[DataFrame, dict[bool, int]]:
    """text, toxic of the sample, staged, and the number of labels of each class. The sample's ids are about fit_docs of
    each class, whatever the number of labels, so they are broadcast."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = staged(own.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic")), "toxic-labels")
    classes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rank = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1_000_000))
    below = F.when(F.col("toxic"), 1e6 * fit_docs / classes.get(True, 1)).otherwise(1e6 * fit_docs / classes.get(False, 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return staged(texts.join(F.broadcast(marked.where(rank < below)), "doc_id").select("text", "toxic"), "toxic-sample"), classes


def _mapped(sample: DataFrame, schema: str, rows) -> DataFrame:
    """rows(texts, classes) of every batch, a list for each column of schema."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows(b.column(0), b.column(1).to_pylist()), arrow)], names=arrow.names)

    prepare(sample.sparkSession)
    return sample.select("text", "toxic").mapInArrow(run, kind)


def _pairs(texts: pa.Array, classes: list[bool]) -> list[list]:
    """The words of a batch with the word before each, every pair once for each class."""
    pairs: set[tuple[str, str, bool]] = set()
    for text, toxic in zip(texts.to_pylist(), classes):
        words = _RUN.findall(text.lower())
        pairs.update(zip(words, ["", *words], [toxic] * len(words)))
    return [list(c) for c in zip(*pairs)] if pairs else [[], [], []]


def choose_terms(sample: DataFrame) -> tuple[Term, ...]:
    """The lexicon: terms by G2, without those that contain, or are contained in, a stronger one at their beginning."""
    pairs = _mapped(sample, "word string, before string, toxic boolean", _pairs).distinct()
    words = staged(pairs.groupBy("word").agg(F.count_if("toxic").alias("in_toxic"), F.count_if(~F.col("toxic")).alias("in_clean")), "toxic-words")
    toxic, clean = words.agg(F.coalesce(F.sum("in_toxic"), F.lit(0)), F.coalesce(F.sum("in_clean"), F.lit(0))).first()
    if not toxic or not clean:
        return ()
    size = F.length("word")
    stems = F.transform(F.sequence(F.lit(SHORTEST_STEM), F.least(size, F.lit(LONGEST_STEM))), lambda k: F.struct(F.substring("word", F.lit(1), k).alias("term"), F.lit(True).alias("stem")))
    every = F.concat(stems, F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))))
    a, b, share = F.col("in_toxic"), F.col("in_clean"), toxic / (toxic + clean)
    counted = words.where(size >= SHORTEST_STEM).select(a, b, F.inline(every)).groupBy("term", "stem").agg(F.sum(a).alias("in_toxic"), F.sum(b).alias("in_clean"))
    part = lambda n, of: F.when(n > 0, n * F.log(n / ((a + b) * of))).otherwise(0.0)
    strong = counted.where((a >= MIN_TIMES) & (a * clean >= MIN_RATIO * b * toxic)).withColumn("g2", F.round(2 * (part(a, share) + part(b, 1 - share)), 6)).where(F.col("g2") >= MIN_G2)
    best = strong.orderBy(F.desc("g2"), "stem", F.desc(F.length("term")), "term").limit(50 * LEXICON).collect()
    out: list[Term] = []
    heads: dict[str, None] = {}  # every beginning of a chosen term
    for r in best:
        t = r["term"]
        if t in heads or any(t[:k] in {x.text for x in out} for k in range(1, len(t) + 1)):
            continue
        out.append(Term(t, r["stem"]))
        heads |= {t[:k]: None for k in range(1, len(t) + 1)}
        if len(out) == LEXICON:
            break
    return tuple(out)


def _regressed(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method; a slope below 0 is set to 0 and the others are fitted anew."""
    use = list(range(x.shape[1]))
    while True:
        c = np.zeros(len(use))
        penalty = np.diag([0.0] + [ridge] * (len(use) - 1))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ c, -30, 30)))
            curve = x[:, use].T @ (x[:, use] * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + penalty + 1e-9 * np.eye(len(use))
            step = np.linalg.solve(curve, x[:, use].T @ (weight * (y - p)) - penalty @ c)
            c = c + step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        negative = [u for u, v in zip(use, c) if u and v < 0]
        if not negative:
            out = np.zeros(x.shape[1])
            out[use] = c
            return out
        use = [u for u in use if u not in negative[:1]]


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, context: Context = Context()) -> Model:
    """A model from the labels that are not held out."""
    sample, classes = _sampled(docs, labels, fit_docs)
    seen = {r["toxic"]: (r["n"], r["size"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("size")).collect()}
    (toxic, toxic_words), (clean, clean_words) = seen.get(True, (0, 0)), seen.get(False, (0, 0))
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        return Model(coefficients=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)) if share else -math.inf, 0.0, 0.0), context=context)
    terms = choose_terms(sample)
    bare = Model(terms, np.ones((len(terms), 3)), context=context)

    def counted(texts: pa.Array, own: list[bool]) -> list[list]:
        n = Counter((term, edits, own[k]) for k, _, term, edits, _ in Scorer(bare, False).hits(texts)[1])
        return [[k[0] for k in n], [k[1] for k in n], [k[2] for k in n], list(n.values())]

    times = np.zeros((2, len(terms), 3))  # at most six rows a term
    for r in _mapped(sample, "term int, edits int, toxic boolean, n long", counted).groupBy("term", "edits", "toxic").agg(F.sum("n").alias("n")).collect():
        times[int(r["toxic"]), r["term"], r["edits"]] = r["n"]
    rare = RARE ** np.arange(3)
    expected = times + np.where(np.arange(3) > 0, times[:, :, :1] * rare, 0)
    weights = np.maximum(np.log((expected[1] + 0.5) / (toxic_words + 1)) - np.log((expected[0] + 0.5) / (clean_words + 1)), 0) if len(terms) else np.zeros((0, 3))
    counts = weights >= LEAST_WEIGHT
    noise = float((weights * counts * times[0]).sum() / max(clean_words, 1))
    model = Model(terms, weights, noise, (0.0, 0.0, 0.0), context)

    def featured(texts: pa.Array, own: list[bool]) -> list[list]:
        x, _ = Scorer(model).features(texts)
        return [x[:, 1].tolist(), x[:, 2].tolist(), own]

    rows = sorted((r["every"], r["heaviest"], r["toxic"]) for r in _mapped(sample, "every double, heaviest double, toxic boolean", featured).collect())  # the sample's numbers
    found = np.array(rows, dtype=float)
    y = found[:, 2]
    weight = np.where(y > 0, classes[True] / toxic, classes[False] / clean)
    c = _regressed(np.column_stack([np.ones(len(found)), found[:, :2]]), y, weight / weight.mean())
    return Model(terms, weights, noise, tuple(map(float, c)), context)


def predict(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and hits (word from 0, term, stem, edits, factor) of every row; only the text
    is an input of the score."""
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty(docs).alias("text"))
    made = "score double, predicted int, hits array<struct<word: int, term: string, stem: boolean, edits: int, factor: double>>"
    schema = StructType(own.schema.fields[:2] + StructType.fromDDL(made).fields)
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, terms = Scorer(model), model.terms
        for b in batches:
            x, hits = scorer.features(b.column(2))
            scored, of = scorer.scores(x), [[] for _ in range(b.num_rows)]
            for k, i, term, edits, by in hits:
                of[k].append({"word": i, "term": terms[term].text, "stem": terms[term].stem, "edits": edits, "factor": by})
            made = [pa.array(scored), pa.array((scored >= threshold).astype(np.int32)), pa.array(of, kinds[-1])]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], names=schema.names)

    prepare(docs.sparkSession)
    return own.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, threshold: float = 0.3) -> DataFrame:
    """Fits a model on the labels that are not held out and scores every document."""
    return predict(docs, fit(docs, labels, fit_docs), threshold)
