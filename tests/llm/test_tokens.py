"""Parts of texts in Latin-1: their ids are the tokenizer's, and each is encoded once."""

from __future__ import annotations

import random

import numpy as np

from fathom.llm import queries, token_store


def _own():
    return token_store.WordTokenizer(queries.tokenizer_path("word_bpe_49k.json"))


def test_texts_in_latin_1():
    """All pairs of characters, and texts full of cuts."""
    own, draw = _own(), random.Random(4)
    signs = [chr(k) for k in range(256)] + list("'''''strvemld<| aA.") * 12
    texts = [chr(a) + chr(b) for a in range(256) for b in range(256)] + ["".join(draw.choice(signs) for _ in range(60)) for _ in range(500)]
    texts += ["a <|endoftext|> b", "“A” b", ""]
    want = own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(texts)] == [w.ids for w in want]


def test_parts_are_encoded_once():
    own, asked = _own(), []
    encode = own._encode_parts
    own._encode_parts = lambda parts: asked.extend(parts) or encode(parts)
    own.encode_all(["Alpha beta."])
    own.encode_all(["ALPHA. Beta beta;alpha"])
    assert sorted(asked) == [".", ";", "alpha", "beta"]
