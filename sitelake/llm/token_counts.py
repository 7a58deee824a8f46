"""Token counts of whole texts from the counts of their distinct pre-tokens.

A pre-token is a stretch of text that no token crosses, so a document has as many
tokens as its pre-tokens have together. Ids are never made per document:

1. every block of documents is turned into frequencies over the block's own list
   of pre-tokens (a dictionary, as in a dictionary-encoded column);
2. equal pre-tokens of all blocks meet, and each distinct one is encoded once;
3. their counts are joined back to the blocks' lists, and each document sums
   frequency times count.

Only the lists move between machines, not the documents' frequencies.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.core import durable
from sitelake.llm import pretokens as P
from sitelake.llm.frames import utf8

BLOCKS = (
    "block long, doc_ids array<long>, null_ids array<boolean>, n_bytes array<long>, fixed array<long>, ends array<int>, at binary, freq binary, words array<string>"
)
#: A block ends once it has this many bytes of text.
BLOCK_BYTES = 32 << 20

_libraries: dict[str, object] = {}


def _library(path: str):
    if path not in _libraries:
        _libraries[path] = P.load(path)
    return _libraries[path]


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Small numbers in as few bytes as a quick compression makes of their byte planes."""
    flat = np.concatenate([np.zeros(0, "<u4"), *arrays]).astype("<u4")
    return zlib.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def special_strings(library) -> list[str]:
    return [t.content for t in library.get_added_tokens_decoder().values()]


def split_words(library, specials: list[str], text: str) -> tuple[list[str], int]:
    """Normalised pre-tokens of a text, and the number of special tokens that stand in it."""
    if P.is_plain(text):
        return P.WORD_LEVEL.findall(text.lower()), 0
    pieces, found = [text], 0
    for s in specials:
        pieces = [p for piece in pieces for p in piece.split(s)]
    found = len(pieces) - 1
    words: list[str] = []
    for p in pieces:
        normal = library.normalizer.normalize_str(p)
        words += [normal[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(normal)]
    return words, found


def to_blocks(docs: DataFrame, tokenizer: str, doc_id: str, text: str) -> DataFrame:
    """One row per block of documents: ids, sizes and frequencies over the block's own word list."""

    def build(batches):
        from pyspark import TaskContext

        library = _library(tokenizer)
        specials = special_strings(library)
        base, made = TaskContext.get().partitionId() << 32, 0

        def fresh():
            return {}, [], [], [], [], [], []

        words, ids, sizes, fixed, ends, at, freq = fresh()
        size = total = 0

        def block():
            return pd.DataFrame({
                "block": [base + made], "doc_ids": [[0 if pd.isna(i) else int(i) for i in ids]], "null_ids": [[bool(pd.isna(i)) for i in ids]],
                "n_bytes": [sizes], "fixed": [fixed], "ends": [ends],
                "at": [_packed(at)], "freq": [_packed(freq)],
                "words": [list(words)],
            })

        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                t = t or ""
                found, extra = split_words(library, specials, t)
                counts = Counter(found)
                places = np.fromiter((words.setdefault(w, len(words)) for w in counts), np.int64, len(counts))
                order = places.argsort()
                at.append(np.diff(places[order], prepend=0).astype("<u4"))
                freq.append(np.fromiter(counts.values(), "<u4", len(counts))[order])
                total += len(counts)
                ids.append(i)
                sizes.append(len(utf8(t)))
                fixed.append(extra)
                ends.append(total)
                size += sizes[-1]
                if size >= BLOCK_BYTES or len(ids) >= 50_000:
                    yield block()
                    made += 1
                    words, ids, sizes, fixed, ends, at, freq = fresh()
                    size = total = 0
        if ids:
            yield block()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(build, BLOCKS)


def count_pieces(listed: DataFrame, tokenizer: str) -> DataFrame:
    """``(block, pos, pieces)`` with arrays as bytes, from ``listed(block, pos, word)``.

    Equal words meet in one task, sorted, so that the library's model encodes each
    distinct word once. A word is there once per block, however common it is.
    """

    def encode(batches):
        library = _library(tokenizer)
        last_word, last_pieces, held = None, 0, []

        def flush():
            all_rows = pd.concat(held)
            held.clear()
            groups = all_rows.groupby("block", sort=False)
            return pd.DataFrame([(k, g["pos"].to_numpy("<u4").tobytes(), g["pieces"].to_numpy("<u4").tobytes()) for k, g in groups], columns=["block", "pos", "pieces"])

        for pdf in batches:
            words = pdf["word"].to_numpy()
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            new[0] = words[0] != last_word
            # Words hold no special string: those were cut out before.
            encoded = library.encode_batch_fast(words[new].tolist(), add_special_tokens=False) if new.any() else []
            known = np.array([last_pieces, *[len(e.ids) for e in encoded]], "<u4")
            pieces = known[np.cumsum(new)]
            last_word, last_pieces = words[-1], pieces[-1]
            held.append(pd.DataFrame({"block": pdf["block"], "pos": pdf["pos"], "pieces": pieces}))
            if sum(map(len, held)) >= 500_000:
                yield flush()
        if held:
            yield flush()

    return listed.repartition("word").sortWithinPartitions("word").mapInPandas(encode, "block long, pos binary, pieces binary")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    Null and empty texts have no tokens. Copies and repeated ids are counted row
    by row. A special string in a text counts as the one token it is for the
    library. An empty table gives no rows.
    """
    blocks = durable(to_blocks(docs, tokenizer, doc_id, text), "blocks")
    counts = count_pieces(blocks.select("block", F.posexplode("words").alias("pos", "word")), tokenizer)
    # A block's list is bounded by the block's bytes, and so is what is put together again here.
    back = counts.groupBy("block").agg(F.collect_list(F.struct("pos", "pieces")).alias("known"))

    def sums(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                known = [] if row.known is None else list(row.known)
                pos = np.frombuffer(b"".join(k["pos"] for k in known), "<u4")
                pieces = np.zeros(len(pos), np.int64)
                pieces[pos] = np.frombuffer(b"".join(k["pieces"] for k in known), "<u4")
                ends = np.asarray(row.ends, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                # Places are differences within a document.
                upto = np.concatenate([[0], np.cumsum(_unpacked(row.at))])
                places = upto[1:] - np.repeat(upto[starts], ends - starts)
                total = np.concatenate([[0], np.cumsum(pieces[places] * _unpacked(row.freq))])
                n = total[ends] - total[starts] + np.asarray(row.fixed, np.int64)
                ids = pd.array(np.asarray(row.doc_ids, np.int64), dtype="Int64")
                ids[np.asarray(row.null_ids, bool)] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "n_bytes": np.asarray(row.n_bytes, np.int64), "n_tokens": n, "over_limit": n > limit})

    return (
        blocks.drop("words").join(back, "block", "left")
        .mapInPandas(sums, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    )
