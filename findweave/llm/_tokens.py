"""Byte-level BPE through a rank file: pre-token splitting, ids of pre-tokens, pieces of ids."""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import regex

#: Default vocabulary of the public tokenizers package.
VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens (fixed values of the vocabulary): contractions, letters, numbers, other, white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PATTERN = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Vocabulary:
    """Ranks, special tokens and pieces of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        assert spec["model"]["type"] == "BPE" and spec["pre_tokenizer"]["type"] == "ByteLevel", "a byte-level BPE file is needed"
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.pieces = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if piece not in self.specials}
        self._cut = regex.compile(PATTERN).findall
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self._ranks = lambda: {piece: i for i, piece in self.pieces.items() if i not in self.specials.values()}
        self.pieces |= {i: text.encode() for text, i in self.specials.items()}

    @cached_property
    def encoding(self):
        """Encodes single pre-tokens: its pattern takes each as a whole."""
        import tiktoken

        return tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=self._ranks(), special_tokens={})

    @cached_property
    def whole(self):
        """Splits and merges whole texts; its ids equal those of ``ids`` over ``split``."""
        import tiktoken

        return tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=self._ranks(), special_tokens=self.specials)

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order. Special tokens come first: what lies between them is split on its own."""
        if self._special is None or not any(s in text for s in self.specials):
            return self._cut(text)
        out = []
        for part in self._special.split(text):
            out += [part] if part in self.specials else self._cut(part)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, special tokens in it included."""
        return np.asarray(self.whole.encode_to_numpy(text, allowed_special="all", disallowed_special=()), "<u4")

    def ids(self, pretoken: str) -> list[int]:
        special = self.specials.get(pretoken)
        return [special] if special is not None else self.encoding.encode_ordinary(pretoken)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level file, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
