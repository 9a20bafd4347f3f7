"""Collocations by Suffix-sigma: phrases that occur more often than their parts would by chance.

Texts are split at punctuation and line ends into pieces and these into words; only A to Z are lower-cased. A suffix is
what begins at a word of a piece, cut to max_words. One shuffle brings suffixes with the same language and first words
together, in reverse lexicographic order; then one stack holds the words of the current suffix, and when a word leaves
it the count of the phrase that ends there is complete and is added to its prefix's. Scores need the counts of the
phrases' parts, which are joined afterwards.

Three things keep this small. A phrase has no more occurrences than each of its words, pairs, triples and quadruples of words,
so suffixes end before the first of these that is rare in its language. Words are counted as they are, pairs of frequent
words, triples of frequent pairs and quadruples of frequent triples by numbers that stand for them, of which two may share
one. Each then passes a filter of FILTER_BITS bits at most. Shared numbers and filters may take what is rare for frequent,
which costs rows and changes no result, but never the reverse. And suffixes are added up in each task. A task hands on one
row for nearly every frequent phrase, so splits are joined into tasks of up to WORDS_EACH words, as long as every core has
one. Texts are scanned as arrays of bytes: words get their numbers by prefix sums.
Hot first words are split: the shuffle is by ranges of whole suffixes, so a range may begin or end anywhere inside a
word's suffixes. The phrases on which a range begins or ends may be incomplete; they are kept whatever their
count, and summed over ranges before the threshold applies.

Edge cases: a null text has no words and a null lang counts as und; repeated rows count again; a text without a phrase that
is frequent adds to n alone; phrases of equal score and count go by their UTF-8 bytes; words may hold any character but
the separators, controls included; a text is split as a whole, in memory that is a multiple of it; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_groups, prepare, sized, staged, text_or_empty

#: Words of a phrase at most, its occurrences at least, and phrases of a language that are reported.
MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Counts that a task adds up, grams that it counts at once, and bytes of texts that are scanned together.
HELD, GRAMS, CHUNK_BYTES = 300_000, 1 << 21, 1 << 20
#: Words of the longest grams that are filtered, and words that a task adds suffixes up over.
GRAM_WORDS, WORDS_EACH = 4, 1 << 26
#: Bits of a filter for each entry, all of them at most (64 MB), and places of an entry; numbers of grams have so many bits
#: more than the number of words.
BITS_EACH, FILTER_BITS, PLACES, SPARE_BITS = 32, 1 << 29, 4, 6
#: Multipliers that make the places of an entry.
ODDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5)
_LETTERS = bytes(range(0x41, 0x5B))
#: Lower-cases A to Z; pieces end at full stops, which no word holds, and words at spaces.
_PLAIN = bytes.maketrans(_LETTERS + b",;:!?\n\x0b\x0c\r\t", _LETTERS.lower() + b"." * 9 + b" ")
#: Words of a suffix are joined by zero bytes, so zero bytes of a word are written as others.
_HIDDEN = re.compile(rb"\x01[\x01\x02]")


def _hidden(word: bytes) -> bytes:
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in word or b"\x01" in word else word


def _shown(word: bytes) -> bytes:
    return _HIDDEN.sub(lambda m: b"\x00" if m[0] == b"\x01\x01" else b"\x01", word) if b"\x01" in word else word


def _plain_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty(docs).cast("binary").alias("text"))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _rows(counts: dict[str, Counter]) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    for lang, own in counts.items():
        if own:
            yield [lang] * len(own), list(own), list(own.values())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n; the row without a word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        sums: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words, n in _rows(counts):
                yield pa.RecordBatch.from_arrays([pa.array(lang), _strings(words), pa.array(n)], names=["lang", "word", "n"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text.translate(_PLAIN).replace(b".", b" ").split()
                counts.setdefault(lang, Counter()).update(words)
                sums[lang] += len(words)
            if sum(map(len, counts.values())) > HELD:
                yield from out()
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.nulls(len(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "word", "n"])

    prepare(docs.sparkSession)
    return _plain_texts(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Filter:
    """A set of 64-bit numbers as bits: every number put in is in it, and few others. Sizes are powers of two."""

    def __init__(self, size: int, pages: dict[int, bytes]):
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.bits = np.zeros(size // 8, dtype=np.uint8)
        for k, page in pages.items():
            self.bits[k * 4096 : (k + 1) * 4096] = np.frombuffer(page, dtype=np.uint8)

    @staticmethod
    def places(numbers: np.ndarray, shift: np.uint64) -> list[np.ndarray]:
        return [numbers * np.uint64(odd) >> shift for odd in ODDS[:PLACES]]

    def has(self, numbers: np.ndarray) -> np.ndarray:
        left = np.arange(len(numbers))  # those found at all places so far
        for odd in ODDS[:PLACES]:
            at = numbers[left] * np.uint64(odd) >> self.shift
            left = left[self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]
        out = np.zeros(len(numbers), dtype=bool)
        out[left] = True
        return out


def filter_of(rows: DataFrame, columns: list[str], numbers: Callable[..., np.ndarray]) -> Filter:
    """The filter of numbers(*columns) of rows, made of bitmaps of 4096 bytes; FILTER_BITS come to the driver at most."""
    size, n = 1 << 15, rows.count()
    while size < min(BITS_EACH * n, FILTER_BITS):
        size *= 2
    shift = np.uint64(64 - size.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = numbers(*(b.column(c) for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at.astype(np.int64) for at in Filter.places(own, shift)]))], names=["place"])

    places = rows.select(*columns).mapInArrow(run, "place long")
    page, bit = F.shiftright("place", 15), F.col("place").bitwiseAND((1 << 15) - 1)
    pages = places.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    return Filter(size, {r["page"]: bytes(r["bits"]) for r in pages.toLocalIterator()})


class Scanner:
    """Words of texts and their numbers, from arrays of bytes."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            base = 0x9E3779B97F4A7C15
            for name, step in (("powers", base), ("inverses", pow(base, -1, 1 << 64))):
                steps = np.full(size, step, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def scan(self, lang: str, plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where words of a plain text start and end, their numbers (never 0), and of each but the last whether the next one is
        in the same piece."""
        data = np.frombuffer(plain, dtype=np.uint8)
        stop = data == 0x2E
        inside = ~(stop | (data == 0x20))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        self._grow(len(data))
        upto = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=upto[1:])
        numbers = (upto[ends] - upto[starts]) * self.inverses[starts] + np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        pieces = np.cumsum(stop, dtype=np.int32)[starts] if len(data) else np.zeros(0, dtype=np.int32)
        return starts, ends, _mixed(numbers) | np.uint64(1), pieces[1:] == pieces[:-1]


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ numbers >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (numbers ^ numbers >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _listed(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """Numbers of single words."""
    scanner, words = Scanner(), words.cast(pa.binary()).to_pylist()
    return np.concatenate([np.zeros(0, dtype=np.uint64), *(scanner.scan(lang, w)[2] for lang, w in zip(langs.to_pylist(), words))])


def longer(grams: np.ndarray, together: np.ndarray, bits: int) -> np.ndarray:
    """Numbers, of so many bits, of grams one word longer, from those of neighbours; 0 where either is 0 or they are apart."""
    a, b = grams[:-1], grams[1:]
    made = _mixed(a * np.uint64(0x9E3779B97F4A7C15) + b) >> np.uint64(64 - bits)
    return np.where((a > 0) & (b > 0) & together[: len(a)], made | np.uint64(1), np.uint64(0))


def _shared(docs: DataFrame, filters: list[Filter]):
    return docs.sparkSession.sparkContext.broadcast([(f.shift, f.bits) for f in filters])


def _opened(shared) -> list[Filter]:
    out = []
    for shift, bits in shared.value:
        own = Filter.__new__(Filter)
        own.shift, own.bits = shift, bits
        out.append(own)
    return out


def _scanned(batches: Iterator[pa.RecordBatch], filters: list[Filter], bits: int):
    """lang, plain text, starts and ends of its words, and numbers of its grams of 1, 2, ... words, 0 for those that the filter of
    their length lacks; the last ones are one word longer than there are filters. Texts of a language are joined by full stops."""
    scanner = Scanner()

    def out(lang: str, texts: list[bytes]):
        plain = b".".join(texts).translate(_PLAIN)
        starts, ends, numbers, together = scanner.scan(lang, plain)
        grams = []
        for f in filters:
            grams.append(np.where(f.has(numbers), numbers, np.uint64(0)) if len(numbers) else numbers)
            numbers = longer(grams[-1], together, bits) if len(numbers) else numbers
        return lang, plain, starts, ends, [*grams, numbers]

    held: dict[str, tuple[list[bytes], list[int]]] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts, size = held.setdefault(lang, ([], [0]))
            texts.append(text)
            size[0] += len(text)
            if size[0] >= CHUNK_BYTES:
                yield out(lang, held.pop(lang)[0])
    for lang, (texts, _) in held.items():
        yield out(lang, texts)


def gram_counts(docs: DataFrame, filters: list[Filter], bits: int) -> DataFrame:
    """gram, n: how often the grams one word longer than there are filters occur, by their numbers."""
    shared = _shared(docs, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int32))], names=["gram", "n"])

        for *_, grams in _scanned(batches, _opened(shared), bits):
            held.append(grams[-1][grams[-1] > 0])
            size += len(held[-1])
            if size > GRAMS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    prepare(docs.sparkSession)
    return _plain_texts(docs).mapInArrow(run, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_filter(docs: DataFrame, filters: list[Filter], bits: int, least: int) -> Filter:
    """The filter of frequent grams one word longer than there are filters."""
    often = staged(gram_counts(docs, filters, bits).where(F.col("n") >= least).select("gram"), "grams")
    out = filter_of(often, ["gram"], lambda g: g.to_numpy().astype(np.uint64))
    discard(often)
    return out


def merged(docs: DataFrame, words: int) -> DataFrame:
    """docs, which have so many words, in as few tasks as leave every core one and none more than about WORDS_EACH words."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-words // WORDS_EACH)))


def suffixes(docs: DataFrame, filters: list[Filter], bits: int, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, suffix, n: suffixes that begin with a frequent pair, up to the first rare gram, counted in each task. filters are those of
    words, pairs, triples and so on."""
    shared = _shared(docs, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found, n in _rows(counts):
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(found, pa.binary()), pa.array(n)], names=["lang", "suffix", "n"])
            counts.clear()

        for lang, plain, starts, ends, grams in _scanned(batches, _opened(shared), bits):
            size = np.ones(len(starts), dtype=np.int64)  # words of the suffix at each place
            for k, own in enumerate(grams[1:-1], 2):
                size[: len(own)][own > 0] = k
            last = np.flatnonzero(grams[-2] > 0)
            for k in range(len(filters) + 1, max_words + 1):  # k words wherever a longest gram stands and k - 1 words follow from the next place
                size[last[size[last + 1] >= k - 1]] = k
            at = np.flatnonzero(size > 1)
            found = [plain[a:b] for a, b in zip(starts[at].tolist(), ends[at + size[at] - 1].tolist())]
            if b"  " in plain:
                found = [re.sub(b" +", b" ", f) if b"  " in f else f for f in found]
            own = Counter(found)
            counts.setdefault(lang, Counter()).update({b"\x00".join(map(_hidden, f.split(b" "))): n for f, n in own.items()})
            if sum(map(len, counts.values())) > HELD:
                yield from out()
        yield from out()

    prepare(docs.sparkSession)
    return _plain_texts(docs).mapInArrow(run, "lang string, suffix binary, n long")


def count_prefixes(rows: Iterator[tuple[str, list[bytes], int]], least: int) -> Iterator[tuple[str, list[bytes], int]]:
    """lang, phrase, n of the phrases of two words and more that begin suffixes in descending order, n being least or more;
    phrases that begin the first or the last suffix come whatever their n."""
    lang, stack, counts, edge = None, [], [], 0  # edge: so many words of the stack stem from the first suffix
    for own, words, n in rows:
        same = 0
        if own == lang:
            for a, b in zip(stack, words):
                if a != b:
                    break
                same += 1
        else:
            first = lang is None
        while len(stack) > same:
            done = counts.pop()
            if len(stack) > 1 and (done >= least or len(stack) <= edge):
                yield lang, list(stack), done
            stack.pop()
            if counts:
                counts[-1] += done
        edge = min(edge, same)
        if own != lang:
            lang, edge = own, len(words) if first else 0
        stack += words[same:]
        counts += [0] * (len(words) - same)
        counts[-1] += n
    while stack:
        done = counts.pop()
        if len(stack) > 1:
            yield lang, list(stack), done
        stack.pop()
        if counts:
            counts[-1] += done


def frequent_phrases(found: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, size, n of the phrases of two words and more that occur least times or more. found should be staged: it is
    read once for the ranges and once for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, list[bytes], int]]:
            for b in batches:
                for lang, suffix, n in zip(*(c.to_pylist() for c in b.columns)):
                    yield lang, suffix.split(b"\x00"), n

        held: list[tuple[str, bytes, int, int]] = []

        def out() -> pa.RecordBatch:
            lang, phrase, size, n = zip(*held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang), _strings(list(phrase)), pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "size", "n"])

        for lang, words, n in count_prefixes(rows(), least):
            held.append((lang, b" ".join(map(_shown, words)), len(words), n))
            if len(held) >= 10_000:
                yield out()
        if held:
            yield out()

    order = [F.desc("lang"), F.desc("suffix")]
    ranges = found.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = ranges.mapInArrow(run, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def _score(k: int) -> Column:
    """floor(1000 n n_words / (l r)) at cut k, exactly: products have up to 38 digits."""
    return F.expr(
        f"(cast(1000 * n as decimal(19, 0)) * cast(n_words as decimal(18, 0))) div (cast(l{k} as decimal(19, 0)) * cast(r{k} as decimal(18, 0)))"
    )


def best_cuts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases with l and r, the counts of their parts at the cut of lowest score, n_words of the language, and the score.
    words has lang, word, n; the row without a word has the number of all. Parts that many phrases share are broadcast."""
    cut = lambda k: F.array(*(
        F.struct(F.lit(k).alias("cut"), F.lit(side).alias("side"), F.array_join(part, " ").alias("part"))
        for side, part in enumerate((F.slice("ws", 1, k), F.slice("ws", F.lit(k + 1), F.col("size") - k)))
    ))
    cuts = F.flatten(F.filter(F.array(*(F.when(F.col("size") > k, cut(k)) for k in range(1, MAX_WORDS))), lambda c: c.isNotNull()))
    parts = staged(phrases.withColumn("ws", F.split("phrase", " ")).select("lang", "phrase", F.inline(cuts)), "cuts")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times")).unionByName(words.where("word is not null").select("lang", F.col("word").alias("part"), F.col("n").alias("times")))
    asked = parts.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    groups = staged(known.join(asked, ["lang", "part"]), "parts")
    met = join_groups(parts, groups, ["lang", "part"], "asked", parts.count())
    of = lambda k, side: F.max(F.when((F.col("cut") == k) & (F.col("side") == side), F.col("times"))).alias(f"{'lr'[side]}{k}")
    wide = met.groupBy("lang", "phrase").agg(*(of(k, side) for k in range(1, MAX_WORDS) for side in (0, 1)))
    totals = sized(words.where("word is null").select("lang", F.col("n").alias("n_words")))
    rows = phrases.join(wide, ["lang", "phrase"]).join(totals, "lang")
    scored = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(_score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    least = F.array_min(F.filter(F.array(*map(scored, range(1, MAX_WORDS))), lambda c: c.isNotNull()))
    return rows.withColumn("cut", least).select("lang", "phrase", "size", "n", "n_words", "cut.l", "cut.r", "cut.score")


def without_contained(phrases: DataFrame, of: DataFrame) -> DataFrame:
    """Those of phrases that no longer phrase of of contains as often as they occur."""
    spans = lambda n: [(i, k) for k in range(2, n) for i in range(1, n - k + 2)]
    inner = F.flatten(F.filter(F.array(*(F.when(F.col("size") == n, F.array(*(F.array_join(F.slice("ws", i, k), " ") for i, k in spans(n)))) for n in range(3, MAX_WORDS + 1))), lambda x: x.isNotNull()))
    covered = of.where("size > 2").withColumn("ws", F.split("phrase", " ")).select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("around"))
    most = covered.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    return phrases.join(most, ["lang", "phrase"], "left").where("around is null or around < n").drop("around")


def mine(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a (its count), l, r (its parts' at the weakest cut), n (words of the language), score."""
    words = staged(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    total = words.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(62, int(total).bit_length() + SPARE_BITS)
    filters = [filter_of(words.where("word is not null"), ["lang", "word"], _listed)]
    while len(filters) < GRAM_WORDS:
        filters.append(gram_filter(docs, filters, bits, least))
    found = staged(suffixes(merged(docs, total), filters, bits), "suffixes")
    phrases = staged(frequent_phrases(found, least), "phrases")
    scored = without_contained(best_cuts(phrases, words), phrases)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("n_words").alias("n"), "score")
