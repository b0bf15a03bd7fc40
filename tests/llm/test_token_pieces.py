"""Plain texts are cut into pieces before the word table is asked: a piece takes one place, whatever signs stand beside it."""

import random

import numpy as np

from stockweave.llm import tokens


def ids(enc, text):
    return np.frombuffer(enc.ids_of(text), "<u4").tolist()


def test_the_table_holds_pieces_once():
    enc = tokens.Encoder(tokens.default_tokenizer())
    tokenized = []
    real = enc._piece
    enc._piece = lambda piece: tokenized.append(piece) or real(piece)
    enc.ids_of("Foo (foo) FOO, 'foo' foo's foo... ÀÉ, àé!")
    assert sorted(tokenized) == sorted(["foo", "(", ")", ",", "'", "'s", "...", "àé", "!"]) and set(enc.words) == set(tokenized)


def test_one_odd_word_leaves_the_others_to_the_table_of_pieces():
    enc = tokens.Encoder(tokens.default_tokenizer())
    for text in ("foo, (bar) — foo. 日本 語foo bar!", "　foo，\xa0bar's ’s foo's"):
        assert ids(enc, text) == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"—", "日本", "語foo", "foo，", "’s", "foo", "bar", "'s"} <= set(enc.words) and not {"foo,", "(bar)", "bar's", "foo's"} & set(enc.words)


def test_random_texts_agree_with_the_tokenizer():
    enc, rng = tokens.Encoder(tokens.default_tokenizer()), random.Random(5)
    odd = [chr(c) for c in range(0x180)] + list("́’—中　 İﬁKẞЖ٣²") * 2 + ["<|", "|>", "<|endoftext|>", "<|EndOfText|>"]
    plain = list("''''  \t\n\r stremvldSTREMVLD09..,,--") * 6 + ["'s", "'LL", "'Re", "'ve"] * 8
    for k in range(4000):
        text = "".join(rng.choices(plain + odd if k % 2 else plain, k=rng.randrange(60)))
        assert ids(enc, text) == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_cutting_is_linear_in_the_text():
    enc = tokens.Encoder(tokens.default_tokenizer())
    texts = ("a" * 500_000, "a" * 500_000 + "中", "é中" * 200_000, "中 a " * 200_000, "x" * 5000 + "— " * 5000)
    assert [len(enc._parts(t)) for t in texts] == [1, 1, 1, 400_000, 5000]
