"""The word table gives the tokenizer's own ids."""

import numpy as np
import pytest

from stockweave.llm import tokens

TEXTS = [
    "", " \t", "Foo foo, FOO foo,BAR.12 a1b2 don't ... --", "naïve l'été ÀÉ ÆØ123 Straße", "K Å ẞ İx ﬁ",
    "日本語 x　y \x1cz", "<|im_end|>x foo<|bar <|endoftext|>", "A" * 3000 + " " + "b," * 2000,
]


@pytest.mark.parametrize("cap", [2, 150_000])
def test_ids_are_the_tokenizers(monkeypatch, cap):
    monkeypatch.setattr(tokens, "WORD_CAP", cap)
    enc = tokens.Encoder(tokens.default_tokenizer())
    for text in TEXTS * 2:
        assert np.frombuffer(enc.ids_of(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.ids_of(None) == b""
