"""Language profiles of all labelled documents, and a pipeline stage that goes by their distances."""

from __future__ import annotations

import random
import zlib

import numpy as np

import corpus_pipeline
from fathom.llm import language_id


def test_all_labelled_documents_make_the_profile(spark):
    draw = random.Random(8)
    rows = [(k, "en" if k % 2 else "de", " ".join("".join(draw.choices("abcdefghijkl", k=3)) for _ in range(6))) for k in range(9000)]
    got = language_id.fit_profiles(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    for lang in ("en", "de"):
        found, n = language_id.grams("\n".join(t for d, own, t in rows if own == lang and zlib.crc32(str(d).encode()) % 3 != 1))
        found = found.astype(np.int64)
        assert got[lang] == found[np.lexsort((found, -n))[:400]].tolist()


def test_pipeline_drops_texts_of_no_known_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text", "source")
    sunny = "Сегодня хорошая погода и мы идём гулять в парк, потому что светит солнце. "
    odd = [(10**9 + k, None, text, None) for k, text in enumerate([sunny, sunny * 5 + "http://www.example.com/a", "漢字テスト の 文章 です OK", "the", "of the"])]
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), sf_dir)
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in docs.collect()} | {10**9 + 3, 10**9 + 4}
