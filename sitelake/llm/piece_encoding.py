"""Exact encoding and decoding for merge-type (BPE) piece models, by backtracking.

A sequence of pieces is what the merge procedure gives if and only if every two
neighbours are: merging the two strings again from single characters must give
back just these two pieces. So a text is covered from the left with the longest
pieces; a piece that does not go with its left neighbour is replaced by its next
shorter prefix piece, and where none is left the position is marked as failed and
the last piece is taken back. Failed positions are never entered again, which
bounds the work by the length of the text times the number of prefixes.

Where no piece spans a border the two sides are independent: before white space,
and between Latin letters or digits and other characters. Texts are cut there and a
stretch is encoded once for as long as it stays in the worker's cache; loading a
model checks that none of its pieces spans such a border.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PLAIN = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
STRETCH = re.compile(f"{SPACE}*[{PLAIN}]+|{SPACE}*[^{PLAIN}{SPACE}]+|{SPACE}+")
#: Entries of each of the two halves of the stretch cache, and of the cache of pairs.
CACHE = 300_000
PAIRS = 1_000_000


class PieceModel:
    """Vocabulary of a piece model; only the pieces and their scores come from the model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.end_id = model.eos_id()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.surface: dict[int, str] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.byte_of[i] = i, value
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece], self.rank[piece], self.surface[i] = i, model.get_score(i), piece
        bad = [p for p in self.ids if STRETCH.match(p).group() != p]
        if bad:
            raise ValueError(f"pieces that span a border: {bad[:3]}")
        self.letters = frozenset("".join(self.ids))
        # A piece that merging its own characters does not give can never be in a result.
        whole = [p for p in self.ids if self.merge(p) == [p]]
        self.finder = ahocorasick.Automaton()
        for p in whole:
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()
        known = set(whole)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in whole}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.exact = True

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself: again and again the best pair of neighbours, of equals the leftmost."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces can stand side by side: re-merging must give them back."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """Pieces of a string of known characters."""
        longest = [0] * len(text)
        for end, n in self.finder.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        found: list[str] = []
        at, failed = 0, 0
        piece: str | None = text[: longest[0]]
        while at < len(text):
            while piece:
                end = at + len(piece)
                if not failed >> end & 1 and (not found or self.fits(found[-1], piece)):
                    break
                piece = self.shorter[piece]
            if piece:
                found.append(piece)
                at += len(piece)
                piece = text[at : at + longest[at]] if at < len(text) else None
            else:
                if not found:
                    raise ValueError(f"no pieces for {text!r}")
                failed |= 1 << at
                piece = found.pop()
                at -= len(piece)
        return found

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a stretch; characters outside the vocabulary become the ids of their UTF-8 bytes."""
        ids: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.letters:
                if start < i:
                    ids += [self.ids[p] for p in self.pieces(text[start:i])]
                ids += [self.bytes[b] for b in c.encode()]
                start = i + 1
        if start < len(text):
            ids += [self.ids[p] for p in self.pieces(text[start:])]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes are put together to characters, the leading space is dropped, control ids are silent."""
        surface = self._surface(ids)
        return surface.removeprefix(SPACE).replace(SPACE, " ")

    def _surface(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.surface.get(i, ""))
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def _lookup(self, stretch: str) -> str:
        """Ids of a stretch as decimal text; the cache keeps what was used since it was last turned over."""
        ids = self.old.get(stretch)
        if ids is None:
            numbers = self.encode_stretch(stretch)
            ids = " ".join(map(str, numbers))
            back = self._surface(numbers)
            if back != stretch:  # never happens with byte fallback; then the text is decoded from its ids
                self.exact = False
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[stretch] = ids
        return ids

    def encode_text(self, text: str) -> tuple[str, str]:
        """``(ids, decoded)`` of a whole text: ids as decimal text with the end id, and the text that they decode to."""
        if not text:
            return str(self.end_id), ""
        stretches = STRETCH.findall(SPACE + text.replace(" ", SPACE))
        get, lookup = self.young.get, self._lookup
        parts = []
        for s in stretches:
            ids = get(s)
            if ids is None:
                ids = lookup(s)
                get = self.young.get
            parts.append(ids)
        parts.append(str(self.end_id))
        ids = " ".join(parts)
        if not self.exact:
            return ids, self.decode(list(map(int, ids.split())))
        return ids, "".join(stretches).replace(SPACE, " ")[1:]


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The worker's model of a vocabulary file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``, one row per row of ``docs``: ids as decimal text, and the text they decode to.

    Null and empty texts hold the end id only and decode to the empty text.
    """

    def encode(batches):
        m = piece_model(model)
        for pdf in batches:
            done = [m.encode_text(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": [d[0] for d in done], "decoded": [d[1] for d in done]})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(encode, "doc_id long, ids string, decoded string")


def encode_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the encoding of every row, made where the row is."""

    def digest(batches):
        m = piece_model(model)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                ids, decoded = m.encode_text(t or "")
                rows.append((i, ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
