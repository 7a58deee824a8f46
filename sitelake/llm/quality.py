"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; a gated attention
(tanh and sigmoid branches, multiplied) learns from document labels alone how
much each passage counts, and the weighted sum of the passages is scored:

    h_i = tanh(x_i W + b),  a = softmax_i((tanh(h_i V) * sigmoid(h_i U)) w),  p = sigmoid(sum_i a_i h_i . c + d)
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.core import DataContractError
from sitelake.llm.frames import add_from_text
from sitelake.llm.words import Words, groups, words_of

#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 64
HASHED = 32
#: Expected number of labelled documents that the model is fitted on, and a bound on their passages.
SAMPLE = 6000
MAX_PASSAGES = 120_000
#: Byte classes: upper, lower, digit, space, line end, stop, comma, other marks one by one, bytes above ASCII.
MARKS = b"!?|#$%&*@/\\<>{}[]()=+_-:;\"'~^`"
_KIND = np.full(256, 7, np.int64)
_KIND[ord("A") : ord("Z") + 1] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[32, 9, 11, 12, 13]] = 3
_KIND[10] = 4
_KIND[ord(".")] = 5
_KIND[ord(",")] = 6
_KIND[128:] = 8
for _i, _b in enumerate(MARKS):
    _KIND[_b] = 9 + _i
KINDS = 9 + len(MARKS)
WIDTH = KINDS + 9 + HASHED


def encode_passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the text that it is part of; a text without words has one passage of zeros."""
    counts = w.counts()
    per_text = np.maximum(1, -(-counts // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per_text)])
    n = int(base[-1])
    owner = np.repeat(np.arange(w.n_texts), per_text)
    first_word = np.concatenate([[0], np.cumsum(counts)])[:-1]
    passage = base[w.text] + (np.arange(len(w.text)) - first_word[w.text]) // PASSAGE
    x = np.zeros((n, WIDTH), np.float32)
    if not len(w.text):
        return x, owner
    # Bytes belong to the passage of the last word that starts at or before them.
    length = len(w.data)
    mark = np.zeros(length, np.int64)
    mark[w.starts] = 1
    word_at = np.cumsum(mark) - 1
    inside = word_at >= 0
    inside[w.offsets[1:] - 1] = False  # what joins two texts is part of neither
    of_byte = passage[np.maximum(word_at, 0)]
    kinds = _KIND[w.data]
    size = np.bincount(of_byte[inside], minlength=n).astype(np.float64)
    table = np.bincount(of_byte[inside] * KINDS + kinds[inside], minlength=n * KINDS).reshape(n, KINDS)
    x[:, :KINDS] = np.sqrt(table / np.maximum(size, 1.0)[:, None])
    n_words = np.bincount(passage, minlength=n).astype(np.float64)
    safe = np.maximum(n_words, 1.0)
    chars = (w.ends - w.starts).astype(np.float64)
    upper = np.concatenate([[0], np.cumsum(kinds == 0)])
    lower = np.concatenate([[0], np.cumsum((kinds == 1) | (kinds == 8))])
    ups, lows = upper[w.ends] - upper[w.starts], lower[w.ends] - lower[w.starts]
    final = w.data[w.ends - 1]
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (passage[1:] == passage[:-1])
    pairs = np.unique(np.stack([passage.astype(np.uint64), w.hash >> np.uint64(16)]).T.copy().view([("p", "<u8"), ("h", "<u8")]).ravel())
    distinct = np.bincount(pairs["p"].astype(np.int64), minlength=n)

    def share(weights: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=weights, minlength=n) / safe

    extra = [
        n_words / PASSAGE, share(chars) / 10.0, np.sqrt(share(chars**2)) / 10.0, distinct / safe, share(same),
        share((ups > 1) & (lows == 0)), share((ups == 1) & (lows > 0)), share((final == ord(".")) | (final == ord(","))), share(chars <= 3),
    ]
    for i, e in enumerate(extra):
        x[:, KINDS + i] = e
    hashed = np.bincount(passage * HASHED + (w.hash % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    x[:, KINDS + 9 :] = np.sqrt(hashed / safe[:, None])
    return x, owner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


@dataclass
class AttentionModel:
    """Weights of the network; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, x: np.ndarray, hidden: int, attention: int, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        shapes = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "w": (attention,), "c": (hidden,), "d": (1,)}
        weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
        return cls(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), weights)

    def forward(self, x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        """``starts`` is the first passage of each document, ``owner`` the document of each passage."""
        p, s = self.weights, {}
        s["x"] = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["t"], s["g"] = np.tanh(s["h"] @ p["V"]), _sigmoid(s["h"] @ p["U"])
        e = (s["t"] * s["g"]) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        s["a"] = e / np.add.reduceat(e, starts)[owner]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], starts, axis=0)
        s["p"] = _sigmoid(s["z"] @ p["c"] + p["d"])
        return s

    def step(self, x, starts, owner, y) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        p, s = self.weights, self.forward(x, starts, owner)
        err = (s["p"] - y) / len(y)
        dz = err[:, None] * p["c"]
        up = dz[owner]
        da = (up * s["h"]).sum(axis=1)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, starts)[owner])
        dt, dg = de[:, None] * p["w"] * s["g"], de[:, None] * p["w"] * s["t"]
        dt, dg = dt * (1 - s["t"] ** 2), dg * s["g"] * (1 - s["g"])
        dh = s["a"][:, None] * up + dt @ p["V"].T + dg @ p["U"].T
        dh *= 1 - s["h"] ** 2
        return {
            "W": s["x"].T @ dh, "b": dh.sum(axis=0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": (s["t"] * s["g"]).T @ de,
            "c": s["z"].T @ err, "d": np.array([err.sum()]),
        }

    def score(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, part in groups(texts, lower=False):
            x, owner = encode_passages(words_of(part))
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            out[first : first + len(part)] = self.forward(x, starts, owner)["p"]
        return out


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam over batches of documents; ``sizes`` is the number of passages of each."""
    m = AttentionModel.start(x, hidden, attention, seed)
    rng, begin = np.random.default_rng(seed), np.concatenate([[0], np.cumsum(sizes)])
    first, second = ({k: np.zeros_like(v) for k, v in m.weights.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            rows = np.concatenate([np.arange(begin[j], begin[j + 1]) for j in pick])
            starts = np.concatenate([[0], np.cumsum(sizes[pick])[:-1]])
            grads = m.step(x[rows], starts, np.repeat(np.arange(len(pick)), sizes[pick]), y[pick])
            t += 1
            for k, g in grads.items():
                g = g + decay * m.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m.weights[k] = m.weights[k] - lr * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_passages: int = MAX_PASSAGES, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionModel:
    """Model fitted on about ``sample`` labelled documents, drawn by a hash of their id.

    Labels other than 0 and 1 and labels of one id that differ are left out. The
    sampled ids (a bounded number) are sent to the scan of ``docs``, the passages
    are encoded there, and about ``max_passages`` of them reach the driver: a
    document gives at most its share, ``max_passages // sample``, drawn from all of
    its passages by a hash of its id, so no text pushes out another. Of an id's rows
    the one with the smallest hash of its text is taken. Without labels, or with one
    class only, every text scores that class's share; labelled documents of which
    none is in the sample raise.
    """
    known = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y", F.pmod(F.xxhash64("k"), F.lit(1_000_000)).alias("h"))
    n_known = known.count()
    rate = min(1.0, sample / max(1, n_known))
    # About ``sample`` rows by the rate above.
    drawn = known.where(F.col("h") < math.ceil(rate * 1_000_000))
    named = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text"))
    rows = named.join(F.broadcast(drawn), "k").groupBy("k", "h", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    share = max(1, max_passages // max(1, sample))

    def encode(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for first, part in groups(pdf["text"].tolist(), lower=False):
                x, owner = encode_passages(words_of(part))
                ends = np.cumsum(np.bincount(owner, minlength=len(part)))
                rows = pdf.iloc[first : first + len(part)]
                taken = []
                for h, a, b in zip(rows["h"], np.append(0, ends[:-1]), ends):
                    mine = np.arange(a, b)
                    taken.append(mine if len(mine) <= share else np.sort(np.random.default_rng(h).choice(mine, share, replace=False)))
                yield pd.DataFrame({
                    "k": rows["k"], "h": rows["h"], "y": rows["y"], "n": [len(t) for t in taken], "x": [x[t].astype("<f4").tobytes() for t in taken],
                })

    got = rows.select("k", "h", "y", "text").mapInPandas(encode, "k long, h long, y int, n long, x binary").orderBy("h", "k").toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) and n_known and not named.join(known, "k", "left_semi").isEmpty():
        raise DataContractError("labelled documents, but none in the sample; enlarge it")
    if not len(y) or y.min() == y.max():
        m = AttentionModel.start(np.zeros((1, WIDTH)), 24, 12, 7)
        m.weights = {k: np.zeros_like(v) for k, v in m.weights.items()}
        p = (y.sum() + 1) / (len(y) + 2)
        m.weights["d"][:] = np.log(p / (1 - p))
        return m
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, WIDTH).astype(np.float64)
    return fit(x, got["n"].to_numpy(), y)


def score_documents(docs: DataFrame, model: AttentionModel, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of label 1; the text alone decides.

    Null and empty texts are one passage without words and get the model's score
    for it. The model has a fixed size and is sent to every executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_from_text(docs, text, {name: "double"}, lambda texts: [shared.value.score(texts)])
