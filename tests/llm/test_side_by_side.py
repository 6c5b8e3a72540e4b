"""Pieces of many texts, merged side by side, are those of one text at a time."""

from __future__ import annotations

import random

import pytest

from axisweave.llm import sentencepieces


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.3, 0.9])
def test_many_texts_are_encoded_as_one_at_a_time(dropout):
    rnd = random.Random(8)
    odd = ["", " ", "  two  spaces \n\n x", "12345 é€😀 x", "a\tb\x00", "▁ ▁▁x", "x" * 300, " " * 70 + "y", "日本語 テスト", "😀ab" * 30, "internationalisation-" * 5]
    made = [" ".join("".join(rnd.choices("thequickbrownin'é-", k=rnd.randint(1, 49))) for _ in range(60)) for _ in range(20)]
    texts = odd + made + odd[::-1]
    model = sentencepieces.load()
    many, one = sentencepieces.Encoder(model, 1, dropout), sentencepieces.Encoder(model, 1, dropout)
    want = [one.encode(t, k).tolist() for k, t in enumerate(texts)]
    assert [x.tolist() for x in many.encode_many(texts, list(range(len(texts))))] == want
    # what is remembered by then changes nothing
    assert [x.tolist() for x in many.encode_many(texts, list(range(len(texts))))] == want and many.encode_many([], []) == []
    for x in (many, one):
        assert all(len(c) < 64 for c in x.plain)
    assert many.plain == one.plain and many.varied == one.varied
