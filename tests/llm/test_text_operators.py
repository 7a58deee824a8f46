"""Tokens, packing, languages, quality and language-model scores against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sitelake.llm import katz, langid, quality
from sitelake.llm.cutting_stock import best_fit, plan
from sitelake.llm.frames import id_crc
from sitelake.llm.packing import pack_documents
from sitelake.llm.piece_encoding import PieceModel, encode_digests, encode_documents
from sitelake.llm.pretokens import byte_level, load
from sitelake.llm.queries import prepare
from sitelake.llm.token_counts import count_tokens, special_strings, split_words
from sitelake.llm.words import shingles, words_of

ODD = ["", " ", "\n\n", "a", "The  end.\n", "ÄÖÜ ß éè", "日本 語", "x" * 5000, "<|endoftext|> a<|startoftext|>", "it's 'sand we're 12345", "▁a ▁", "tab\tx\r\ny", "😀 é \x00"]
ALPHABET = "aaab  ▁'sS té́Éßİ\n\t日本ñ·ʼ’😀_<s>/ethein012²½!|"


def noise(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def mixed(spark, docs_of):
    prepare(spark)
    texts = ODD + noise(60)
    rows = [*enumerate(texts), (7, None), (None, "no id"), (3, ODD[3]), (3, "same id, other text")]
    return rows, docs_of(rows).withColumn("digest", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("part", F.lit(0))


def keyed(rows, columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_piece_model_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    library, model = SentencePieceProcessor(model_file=path), PieceModel(path)
    for t in ODD + noise(1500) + ["a" * 700, " " * 300 + "x", "<s></s><0x41>"]:
        ids, decoded = model.encode_text(t)
        expected = library.encode(t, add_eos=True)
        assert list(map(int, ids.split())) == expected
        assert decoded == library.decode(expected) == model.decode(expected)
        assert model.pieces("▁the") == ["▁the"]


def test_piece_documents(spark, mixed, empty_docs):
    from sentencepiece import SentencePieceProcessor

    rows, docs = mixed
    path = P.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    expected = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert keyed(encode_digests(docs, path).collect(), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == expected
    assert encode_documents(docs, path).count() == len(rows)
    assert encode_digests(empty_docs, path).count() == 0


def test_token_counts(spark, mixed, empty_docs):
    rows, docs = mixed
    path = P.path("word_bpe_49k.json")
    library = load(path)
    expected = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[i, len((t or "").encode()), n, n > 20] += 1
    assert keyed(count_tokens(docs, path, limit=20).collect(), ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == expected
    assert count_tokens(empty_docs, path).count() == 0
    specials = special_strings(library)
    for t in noise(500, 3):
        words, extra = split_words(library, specials, t)
        assert sum(len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)) + extra == len(library.encode(t, add_special_tokens=False).ids)


def test_byte_level_ids():
    path = P.path("byte_bpe_50k.json")
    library, ours = load(path), byte_level(path)
    for t in ODD + noise(500, 2):
        assert ours.encode(t) == np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_cutting_stock_covers_and_is_near_the_bound():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 400, 30_000):
        h = Counter(int(x) for x in rng.integers(1, 129, n))
        rows, sequences = plan(h, 128)
        fill = Counter()
        for length, a, b, first, copies, _ in rows:
            for r in range(a, b):
                fill[first + (r - a) // copies] += length
        ranks = defaultdict(list)
        for length, a, b, *_ in rows:
            ranks[length] += range(a, b)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in h.items()}
        assert len(fill) == sequences and max(fill.values(), default=0) <= 128
        if n == 30_000:
            assert sequences <= 1.01 * math.ceil(sum(k * v for k, v in h.items()) / 128)
    assert all(sum(b) <= 10 for b in best_fit([7, 6, 5, 3, 2, 2], 10))


def test_packing(spark, mixed, empty_docs):
    rows, docs = mixed
    path = P.path("byte_bpe_50k.json")
    got = pack_documents(docs, path, capacity=64).collect()
    library = load(path)
    expected = Counter()
    for i, t in rows:
        expected[i, len(library.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == expected
    ids = {i: np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows if i not in (3, 7)}
    for r in got:
        if r.doc_id in ids:
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, v in ids.items():
        assert sorted((r.start, r.length) for r in got if r.doc_id == i)[-1] == (len(v) - 1 - (len(v) - 1) % 64, (len(v) - 1) % 64 + 1)
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(empty_docs, path).count() == 0


LANGS = {"xx": "the of and that with for was his they this have from", "yy": "der die und nicht mit sich auf für werden eine aber nur", "zz": "que los para una con del las por más como pero sus"}


def _sentences(seed, n, lang):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(LANGS[lang].split()) for _ in range(30)) for _ in range(n)]


def test_language_filters(spark, empty_docs):
    prepare(spark)
    rows = [(i * 3 + k, t, lang) for k, lang in enumerate(LANGS) for i, t in enumerate(_sentences(k, 40, lang))]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "", None), (902, "12 !!", "yy"), (903, _sentences(9, 1, "zz")[0] * 20000, None), (None, "und nicht", "yy")], "doc_id long, text string, lang string")
    docs = docs.withColumn("lang_pred", F.lit("clash"))
    filters = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(docs, filters, names=("p", "s")).collect()}
    assert all(got[i].p == lang for i, _, lang in rows)
    assert [got[i].p for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "zz", "yy"]
    assert all(0 <= r.s <= 1 for r in got.values())
    assert langid.identify(empty_docs, filters).count() == 0
    none = langid.learn(empty_docs)
    assert none.predict(["abc"])[0] == ["und"]


def test_segments_keep_every_gram(monkeypatch):
    text = " ".join(_sentences(1, 3, "xx"))
    whole = Counter(np.concatenate([langid.gram_hashes(c, o)[0] for c, o in langid.segments([text])]).tolist())
    monkeypatch.setattr(langid, "SEGMENT", 50)
    parts = Counter(np.concatenate([langid.gram_hashes(c, o)[0] for c, o in langid.segments([text])]).tolist())
    assert set(whole) == set(parts)


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, sizes = rng.normal(size=(9, 6)), np.array([2, 3, 4])
    starts, owner, y = np.array([0, 2, 5]), np.repeat(np.arange(3), sizes), np.array([1.0, 0.0, 1.0])
    m = quality.AttentionModel.start(x, 4, 3, 1)
    grads = m.step(x, starts, owner, y)

    def loss():
        p = m.forward(x, starts, owner)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        w, eps = m.weights[k], 1e-6
        w[at] += eps
        up = loss()
        w[at] -= 2 * eps
        assert abs((up - loss()) / (2 * eps) - g[at]) < 1e-6
        w[at] += eps


def test_quality_learns(spark, empty_docs):
    prepare(spark)
    rnd = random.Random(2)
    good = [t.capitalize() + "." for t in _sentences(5, 120, "xx")]
    bad = [" ".join(w + rnd.choice(["###", "$$$"]) for w in t.split()) for t in _sentences(6, 60, "xx")]
    rows = [(i, t, i % 3) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (1000, None, 0), (1001, "", 0), (None, "the", 0), (1002, good[0] * 3000, 0)], "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame([(i, int(i < 120)) for i, _, k in rows if k] + [(5, 1), (5, None), (None, 1), (7, 0), (7, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score_documents(docs, model, name="s").collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 180 and r.doc_id % 3 == 0]
    assert np.mean([(r.s >= 0.5) == (r.doc_id < 120) for r in held]) > 0.95
    assert len(got) == 184 and all(0 <= r.s <= 1 for r in got)
    assert quality.score_documents(empty_docs, model).count() == 0
    assert quality.learn(docs, labels.limit(0)).score(["a", None]).tolist() == [0.5, 0.5]


def brute_katz(rows):
    """The same model by plain counting."""
    low = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows]
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", t), "</s>"]) for i, t in low]
    train = [t for i, t in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["<s>", *t], t))
    before = Counter(a for a, _ in two.elements())
    n_r = [np.array([0.0, *[sum(c == r for c in x.values()) for r in range(1, 7)]]) for x in (one, two)]
    d1, d2 = (katz.discounts(x) for x in n_r)
    factor = lambda d, c: d[c] if c <= katz.CUT else 1.0
    n = sum(one.values())
    unknown = 1 - sum(factor(d1, c) * c / n for c in one.values())
    lower = lambda w: factor(d1, one[w]) * one[w] / n if w in one else unknown
    after = defaultdict(list)
    for a, b in two:
        after[a].append(b)

    def probability(a, b):
        if a not in after:
            return lower(b)
        left = 1 - sum(factor(d2, two[a, w]) * two[a, w] / before[a] for w in after[a])
        scale = 1.0
        if left < 1e-12:
            scale = before[a] / (before[a] + len(after[a]))
            left = 1 - scale
        if two[a, b]:
            return scale * factor(d2, two[a, b]) * two[a, b] / before[a]
        return left / (1 - sum(map(lower, after[a]))) * lower(b)

    base = lambda w: math.log10((one[w] + 1) / (n + len(one) + 1))
    out = [(i, len(t), sum(w in one for w in t), n, sum(map(base, t)), sum(math.log10(probability(a, b)) for a, b in zip(["<s>", *t], t))) for i, t in tokens]
    return out, probability, one


@pytest.mark.parametrize("hot", [5, 10**6])
def test_katz(spark, docs_of, empty_docs, hot):
    prepare(spark)
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(4000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + rnd.randint(0, 40)])) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "The THE the"), (None, "w1 w2"), (3, rows[3][1]), (203, "ünknown Ünknown 日本"), (204, "w1 " * 3000)]
    expected, probability, one = brute_katz(rows)
    got = katz.score_documents(docs_of(rows), id_crc(F.col("doc_id")) % 7 != 2, part_size=700, hot_count=hot).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    mine = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    assert len(mine) == len(rows)
    for a, b in zip(mine, sorted(expected, key=key)):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    for context in ("<s>", "w1", "w2", "never"):
        assert sum(probability(context, w) for w in [*one, "unseen"]) == pytest.approx(1.0)
    assert katz.score_documents(empty_docs, F.lit(True)).count() == 0
    assert {r.score for r in katz.score_documents(docs_of(rows), F.lit(False)).collect()} == {0.0}


def test_word_hashes_depend_on_the_word_alone():
    w = words_of([b"alpha beta", b"", b"  beta\talpha gamma"])
    by_word = defaultdict(set)
    for a, b, h in zip(w.starts, w.ends, w.hash):
        by_word[bytes(w.data[a:b])].add(int(h))
    assert all(len(v) == 1 for v in by_word.values()) and len({x for v in by_word.values() for x in v}) == 3
    assert w.counts().tolist() == [2, 0, 3]
    grams, of = shingles(w.hash, w.text, 2)
    assert of.tolist() == [0, 2, 2]
    assert len(set(grams.tolist())) == 3


def test_katz_numbers_bigrams_in_little_memory():
    """Finding of round 3: sorting a block's bigrams held three arrays of eight bytes a token at once."""
    import tracemalloc

    import numpy as np

    n, words = 1 << 21, 200
    b = katz.Block.__new__(katz.Block)
    b.tokens = (np.arange(n, dtype=np.int64) ** 2 % 199 % words).astype(np.int32)
    b.words, b.count, b.starts = np.arange(1, words + 1, dtype="<u8"), np.ones(words, np.int64), np.arange(0, n, 64)
    tracemalloc.start()
    b.bigrams(4, 1, 1_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 21 * n
    before = np.concatenate([[0], b.tokens[:-1]])
    before[b.starts] = words
    assert (b.left[b.pair_of] == before).all() and (b.right[b.pair_of] == b.tokens).all()
