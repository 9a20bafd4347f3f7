"""Collocations against SQL, brute force on odd inputs, ranges that split a word, and exact scores."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import collocations as col
from fathom.llm import oracles, queries
from fathom.llm.common import staged


def test_equals_sql(equal_to_oracle):
    equal_to_oracle(queries.op13_collocations, oracles.ORACLES["op13_collocations"])


def _brute(rows, least, top):
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, ws), a in found.items():
        k = min(range(1, len(ws)), key=lambda k: (1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k))
        around = [b for (other, longer), b in found.items() if other == lang and len(longer) > len(ws) and any(longer[i : i + len(ws)] == ws for i in range(len(longer)))]
        if not any(b >= a for b in around):
            l, r = f[lang, ws[:k]], f[lang, ws[k:]]
            out.append((lang, " ".join(ws), a, l, r, n[lang], 1000 * a * n[lang] // (l * r)))
    final = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        final += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(final)


@pytest.fixture(scope="module")
def odd(spark):
    """Few words, so that phrases are frequent; controls, other alphabets, nulls, repeated rows, one very long text."""
    draw = random.Random(11)
    words = ["a", "A", "b", "c", "the", "é", "É", "x\x00y", "x\x01", "x", "\x1c", "漢字", "\x85"]
    rows = []
    for i in range(120):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b"]) for _ in range(draw.randint(0, 40)))
        rows.append((i, draw.choice([None, "und", "en", "de"]), text))
    rows += [(1, "en", None), (2, "en", ""), (2, "en", "the a the a the a"), (2, "en", "the a the a the a"), (3, "xx", "one two"), (4, "en", "the b c " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("n", F.lit("x")).withColumn("word", F.lit(1)).withColumn("phrase", F.lit(None).cast("int"))


@pytest.mark.parametrize(("least", "top"), [(3, 5000), (12, 7)])
def test_odd_rows_equal_brute_force(odd, least, top):
    got = sorted(tuple(r) for r in col.mine(odd, least, top).collect())
    assert got == _brute([(r["lang"], r["text"]) for r in odd.collect()], least, top) and got


def test_empty(spark, odd):
    assert col.mine(odd.where("false")).count() == 0
    assert col.mine(odd.where("lang = 'xx'")).count() == 0


def test_ranges_that_split_a_word():
    """Whatever the borders between ranges, sums over ranges are the counts."""
    draw = random.Random(2)
    suffixes = Counter(tuple(draw.choice("aab") for _ in range(draw.randint(2, 5))) for _ in range(400))
    want: Counter = Counter()
    for s, n in suffixes.items():
        for k in range(2, len(s) + 1):
            want[s[:k]] += n
    rows = sorted(((b"\x00".join(w.encode() for w in s), n) for s, n in suffixes.items()), reverse=True)
    for _ in range(50):
        borders = sorted(draw.sample(range(len(rows) + 1), 3))
        got: Counter = Counter()
        for low, high in zip([0, *borders], [*borders, len(rows)]):
            for _, phrase, n in col.count_prefixes(iter(("en", s.split(b"\x00"), n) for s, n in rows[low:high]), 30):
                got[tuple(w.decode() for w in phrase)] += n
        assert {k: v for k, v in got.items() if v >= 30} == {k: v for k, v in want.items() if v >= 30}


def test_filter_knows_every_word(spark):
    words = [f"w{k}" for k in range(5000)]
    made = col.filter_of(spark.createDataFrame([("en", w) for w in words], "lang string, word string"), ["lang", "word"], col._listed)
    numbers = lambda lang: col.Scanner().scan(lang, " ".join(words).encode())[2]
    assert made.has(numbers("en")).all() and made.has(numbers("de")).sum() < 250


def test_full_filters_change_nothing(odd):
    """Filters and shared numbers only save rows: with filters that let everything pass, phrases are the same."""
    words = col.word_counts(odd).where("n >= 3 and word is not null")
    own, full = col.filter_of(words, ["lang", "word"], col._listed), col.Filter(1 << 15, {0: b"\xff" * 4096})
    pairs, few = col.gram_filter(odd, [own], 40, 3), col.gram_filter(odd, [own], 3, 3)
    triples = col.gram_filter(odd, [own, pairs], 40, 3)
    sets = (([own, pairs, triples], 40), ([own, pairs, full], 40), ([own, few, full], 3), ([own, full, full], 40), ([full] * 3, 40))
    counted = [staged(col.suffixes(odd, *f), "suffixes") for f in sets]
    rows = [f.count() for f in counted]
    assert 0 < rows[0] < rows[1] <= rows[3] < rows[4] and rows[2] <= rows[3]
    got = [sorted(tuple(r) for r in col.frequent_phrases(f, 3).collect()) for f in counted]
    assert all(g == got[0] for g in got) and got[0]


@pytest.fixture
def suffix_rows(monkeypatch):
    """What mine() stages as suffixes."""
    seen = []

    def watched(df, name):
        out = staged(df, name)
        if name == "suffixes":
            seen.append(out)
        return out

    monkeypatch.setattr(col, "staged", watched)
    return seen


def test_rows_of_suffixes_do_not_follow_splits(spark, suffix_rows):
    """Splits are joined before suffixes are added up: each of 40 splits handed on its own count of every phrase."""
    docs = spark.createDataFrame([("en", f"a b c d{k}") for k in range(400)], "lang string, text string")
    for splits in (4, 40):
        got = [(r["phrase"], r["a"]) for r in col.mine(docs.repartition(splits), 100, 50).collect()]
        assert got == [("a b c", 400)]
    assert [f.count() for f in suffix_rows] == [8, 8]


def test_tasks_grow_with_words(odd):
    split = odd.repartition(40)
    parts = lambda words: col.merged(split, words).rdd.getNumPartitions()
    assert parts(0) == parts(4 * col.WORDS_EACH) == 4 and parts(9 * col.WORDS_EACH + 1) == 10 and parts(99 * col.WORDS_EACH) == 40


def test_suffixes_end_at_rare_quadruples(spark, suffix_rows):
    rows = [("en", "a b c")] * 5 + [("en", "b c d")] * 5 + [("en", "a b c d")]
    got = {r["phrase"]: r["a"] for r in col.mine(spark.createDataFrame(rows, "lang string, text string"), 3, 50).collect()}
    assert got == {"a b c": 6, "b c d": 6, "b c": 11}
    assert max(bytes(r["suffix"]).count(b"\x00") for r in suffix_rows[0].collect()) == 2


def test_filters_take_few_rare_grams_for_frequent(spark):
    words = [f"w{k}" for k in range(5000)]
    made = col.filter_of(spark.createDataFrame([("en", w) for w in words], "lang string, word string"), ["lang", "word"], col._listed)
    others = col.Scanner().scan("en", " ".join(f"v{k}" for k in range(200_000)).encode())[2]
    assert made.has(others).mean() < 0.001


def test_scores_beyond_64_bits(spark):
    n = 10**17
    phrases = spark.createDataFrame([("en", "a b c", 3, 900_000_000_000_007)], "lang string, phrase string, size int, n long")
    phrases = phrases.unionByName(spark.createDataFrame([("en", "a b", 2, 900_000_000_000_011), ("en", "b c", 2, 900_000_000_000_013)], phrases.schema))
    words = spark.createDataFrame([("en", None, n), ("en", "a", 3 * 10**15 + 1), ("en", "b", 2 * 10**15 + 3), ("en", "c", 10**15 + 7)], "lang string, word string, n long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in col.best_cuts(phrases, words).collect()}
    a = 900_000_000_000_007
    cuts = [(3 * 10**15 + 1, 900_000_000_000_013), (900_000_000_000_011, 10**15 + 7)]
    want = min((1000 * a * n // (l * r), l, r) for l, r in cuts)
    assert got["a b c"] == (want[1], want[2], want[0])


def test_hidden_words():
    for w in (b"", b"a", b"\x00", b"\x01\x00\x01", b"\x01\x01\x02", b"x\x02"):
        assert b"\x00" not in col._hidden(w) and col._shown(col._hidden(w)) == w
