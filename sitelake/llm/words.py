"""Words of many texts at once, as arrays.

A word is a run of bytes other than the six ASCII white-space characters. Words
get a 64-bit polynomial hash of their bytes (random value per byte value, odd
base, arithmetic modulo 2^64), scrambled at the end; it depends on the bytes
alone, so it is the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from sitelake.llm.frames import LOWER_TABLE, SPACES, mix64, utf8

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
#: Texts are taken together up to this many bytes; a longer text stands alone.
GROUP = 1 << 20
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP + (GROUP >> 2))
        steps = [np.full(size, b, np.uint64) for b in (BASE, pow(BASE, -1, 2**64))]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.multiply.accumulate(s) for s in steps]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a group of texts: byte ranges in ``data``, text number and hash of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    n_texts: int
    #: First byte of each text in ``data``.
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)


def words_of(texts: Sequence[bytes]) -> Words:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = IS_SPACE[data]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes, len(texts), offsets)


def groups(texts: Sequence[str | None], lower: bool = True) -> Iterator[tuple[int, list[bytes]]]:
    """``(first, texts)``: consecutive texts as bytes, A-Z lower-cased if asked, about a megabyte at a time."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        b = utf8(t)
        held.append(b.translate(LOWER_TABLE) if lower else b)
        size += len(b)
        if size >= GROUP:
            yield first, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, held


def shingles(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words of one text, and their text numbers; texts of fewer words give their whole as one."""
    n = len(hashes)
    if not n:
        return hashes, text
    # Rolling combination: position matters, and so does the number of words.
    out = hashes.copy()
    for i in range(1, k):
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        if i < n:
            out[: n - i] += np.where(text[i:] == text[: n - i], hashes[i:], np.uint64(0))
    last = np.zeros(n, bool)
    last[max(0, n - k + 1) :] = True
    if n >= k:
        last[: n - k + 1] = text[k - 1 :] != text[: n - k + 1]
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    keep = ~last | first
    return mix64(out[keep]), text[keep]
