"""Encoders for the public ``tokenizers`` vocabularies, and their pre-tokens.

Texts of common Latin characters take a quicker way that gives the same ids; any
other text, and any that may hold a special string, goes through the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which the library's letter, number and space classes equal the ranges below.
PLAIN = re.compile(r"[\t\n\r !-~À-ÖØ-öø-ɏ]*\Z")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def is_plain(text: str) -> bool:
    return "<|" not in text and PLAIN.match(text) is not None


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelIds:
    """Ids of whole texts under a byte-level vocabulary, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        self.library = load(path)
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        # Ids in the order of their merges: the id is the rank.
        self.ranked = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if is_plain(text):
            return np.asarray(self.ranked.encode_ordinary(text), "<u4").tobytes()
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, ByteLevelIds] = {}


def byte_level(path: str) -> ByteLevelIds:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ByteLevelIds(path)
    return _encoders[path]
