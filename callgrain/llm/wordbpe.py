"""The parts of a lower-casing word-end BPE tokenizer that its encoders share.

Reads a ``tokenizers`` JSON file of the kind NFC + white space + lower case,
split by letters / digits / rest, byte level, BPE with an end-of-word suffix.
Special tokens in a text are matched first, as the library does by default.
White space never reaches a token, so a text is a sequence of *chunks* (runs
without white space) and a chunk's ids depend on the chunk alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: The white-space characters and the split pattern of the tokenizer file.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+"

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ANY = regex.compile(SPLIT)
_SPACE = re.compile(f"[{SPACES}]+")
#: str.split() also splits at these, which the tokenizer keeps.
_ODD = re.compile("[\x1c-\x1f]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Vocabulary, merge table and splitting rules of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-casing word-end BPE file")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        end, chars = model["end_of_word_suffix"], byte_chars()
        self.first = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = PairTable((left << 20) | right, made)
        born = np.full(max(self.tokens) + 1, -1, np.int64)
        twice = len(np.unique(made)) < len(made)
        born[made] = np.arange(len(made))
        #: A merge's parts exist before it: then all places of a pair can merge at once.
        self.in_order = not twice and bool((born[left] < np.arange(len(made))).all() and (born[right] < np.arange(len(made))).all())
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text in order; a special token is a chunk of its own."""
        if self._cut is not None and any(t in text for t in self.special) and (parts := self._cut.split(text))[1:]:
            return [c for p in parts for c in ([p] if p in self.special else self._split(p))]
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        return text.split() if not _ODD.search(text) else [c for c in _SPACE.split(text) if c]

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk: normalised, then split."""
        if chunk.isascii():
            return _ASCII.findall(chunk.lower())
        if max(chunk) > "\u024f":  # beyond Latin letters two libraries' Unicode tables may differ
            return self._library_pieces(chunk)
        chunk = unicodedata.normalize("NFC", chunk)
        return _ANY.findall(chunk.lower())

    def _library_pieces(self, chunk: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._byte = {c: b for b, c in enumerate(byte_chars())}
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))
        return [bytes(map(self._byte.__getitem__, p)).decode() for p, _ in found]


class PairTable:
    """Pair -> (rank, merged id) in an open-addressing table that whole arrays probe at once."""

    def __init__(self, keys: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.rank = np.full(size, -1, np.int64), np.full(size, 1 << 40, np.int64)
        self.made = made
        todo, at = np.arange(len(keys)), self._home(keys)
        self.longest = 0
        while len(todo):
            free = self.keys[at] < 0
            got = np.flatnonzero(free)
            self.keys[at[got]] = keys[todo[got]]  # of equal slots the last writer stays
            won = self.keys[at] == keys[todo]
            self.rank[at[won]] = todo[won]
            todo, at = todo[~won], (at[~won] + 1) & (size - 1)
            self.longest += 1

    @classmethod
    def over(cls, keys: np.ndarray, rank: np.ndarray) -> PairTable:
        """A table over slots that are filled already (mapped from a file)."""
        self = cls.__new__(cls)
        self.bits, self.keys, self.rank = len(keys).bit_length() - 1, keys, rank
        return self

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; 1 << 40 where it never merges."""
        return self.find((left << 20) | right)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.rank[at], 1 << 40)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One tokenizer a worker process."""
    return WordBpe(path)
