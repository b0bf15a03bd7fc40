"""Word-level encoding with a public tokenizer file.

The tokenizer's pre-tokenizer never joins characters across white space, so a text's ids are the ids of its
white-space-separated words in a row, and a plain word's ids those of its pieces: runs of letters or signs, single digits.
Plain stretches of a text are cut into pieces at once. Each worker keeps a bounded table of pieces, and of words that are not
plain, already encoded.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Words kept per worker and generation: a full table becomes the older one, from which words still met are taken over.
WORD_CAP = 150_000
#: Characters of plain words: here the letters, digits and signs are surely those of the tokenizer.
_PLAIN = r"!-~À-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"[{_PLAIN}]+")
_SIMPLE_TEXT = re.compile(rf"[{_PLAIN}\t-\r ]*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")
#: A run of words that are not plain; nothing is tried twice, so time is linear in the text.
_OTHERS = re.compile(rf"(?<!\S)(?:[{_PLAIN}]*+[^\s{_PLAIN}]\S*+\s*+)++")
#: White space to Python's split(), but not to the tokenizer.
_ODD = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word):
        if len(self) >= WORD_CAP:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        out = self[word] = self.encode(word) if out is None else out
        return out


class Encoder:
    """ids_of(text): the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.simple_ok = self._plain_words_agree()
        self.symbols = byte_symbols()
        self.words = _Words(self._word)

    def _plain_words_agree(self) -> bool:
        """The short way for plain words holds for lower-casing, word-splitting byte-level BPE only; probe for it."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE"

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else "".join(map(self.symbols.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """A word's ids; its pieces are words of the table themselves."""
        if not self.simple_ok or "<|" in word:
            return self._full(word)
        if _PIECE.fullmatch(word):
            return self._piece(word)
        if not _SIMPLE.fullmatch(word):
            return self._full(word)
        return b"".join(map(self.words.__getitem__, _PIECE.findall(word.lower())))

    def _parts(self, text: str) -> list[str]:
        """The text's pieces and other words, in a row."""
        if not self.simple_ok or "<|" in text:
            return text.split()
        if _SIMPLE_TEXT.fullmatch(text):
            return _PIECE.findall(text.lower())
        parts, at = [], 0
        for others in _OTHERS.finditer(text):
            parts += _PIECE.findall(text[at : others.start()].lower())
            parts += others[0].split()
            at = others.end()
        return parts + _PIECE.findall(text[at:].lower())

    def ids_of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _ODD):
            return self._full(text)
        return b"".join(map(self.words.__getitem__, self._parts(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the worker's encoders, and their words, before work that needs none."""
    _ENCODERS.clear()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
