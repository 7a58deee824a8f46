"""Language filters and passage features recomputed one by one, and samples that no single row can empty."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.core import DataContractError
from sitelake.llm import langid, quality
from sitelake.llm.queries import prepare

WORDS = {"aa": ["lorem", "ipsum", "dolor", "sit", "amét"], "bb": ["quick", "brown", "foxes", "jump", "über"], "cc": ["quick", "lorem", "zzz", "привет"]}


def grams(text):
    """All n-grams of letters and single spaces, counted in plain Python."""
    squeezed = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    return [squeezed[i : i + n] for n in langid.SIZES for i in range(len(squeezed) - n + 1)]


def texts_of(seed, per=40):
    rnd = random.Random(seed)
    return [(k * per + i, " ".join(rnd.choice(w) for _ in range(rnd.randint(3, 30))) + rnd.choice(["", "!", " 12-x", "\n\t"]), lang) for k, (lang, w) in enumerate(WORDS.items()) for i in range(per)]


def test_language_filters_equal_plain_counting(spark):
    """Which n-grams belong to which language, their bits, and every text's hits less chance hits."""
    prepare(spark)
    rows = texts_of(1) + [(None, None, "aa"), (500, "", "bb"), (501, "lorem", None)]
    positions = 1 << 12
    filters = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), positions=positions)
    n, d = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in rows:
        if t is not None and lang is not None:
            n[lang].update(grams(t))
            d[lang].update(set(grams(t)))
    total = {lang: sum(c.values()) for lang, c in n.items()}
    table, member = np.zeros(positions, np.int64), defaultdict(int)
    place_of = lambda g: [int(p[0]) for p in langid.places(langid.gram_hashes(np.array([ord(c) for c in g], np.uint32), np.zeros(len(g), int))[0][-1:], positions)]
    for g in {g for c in n.values() for g in c}:
        most = max(n[lang][g] / total[lang] for lang in total)
        for k, lang in enumerate(sorted(total)):
            if n[lang][g] / total[lang] >= 0.4 * most and d[lang][g] >= 2:
                member[g] |= 1 << k
        for p in place_of(g) if member[g] else []:
            table[p] |= member[g]
    assert filters.languages == sorted(total) and (filters.masks == table).all()
    chance = np.array([((table >> k) & 1).mean() for k in range(3)]) ** langid.HASHES
    assert filters.chance == pytest.approx(chance)
    texts = [t for _, t, _ in texts_of(2, 8)] + ["", None, "12 3", "lorem", "quick lorem " * 300]
    names, scores, shares, counts = filters.predict(texts)
    for t, name, score, share, count in zip(texts, names, scores, shares, counts):
        if not t or not any(map(str.isalpha, t)):
            assert (name, score) == ("und", 0)
            continue
        own = grams(t)
        hits = np.array([sum(all(table[p] >> k & 1 for p in place_of(g)) for g in own) for k in range(3)])
        real = np.maximum(0, (hits - len(own) * chance) / (1 - chance))
        best = int(real.argmax())  # of equal languages the first name
        assert (name, count) == (filters.languages[best], len(own))
        assert score == pytest.approx(real[best] / (real[best] + np.delete(real, best).max())) and share == pytest.approx(real[best] / len(own))


def plain_features(words, between):
    """Features of one passage: shares of byte kinds, word shapes, hashed words."""
    data = between
    kinds = np.bincount(quality._KIND[np.frombuffer(data, np.uint8)], minlength=quality.KINDS)
    up = lambda w: sum(65 <= b <= 90 for b in w)
    low = lambda w: sum(97 <= b <= 122 or b >= 128 for b in w)
    n = len(words)
    extra = [
        n / 64, sum(map(len, words)) / n / 10, math.sqrt(sum(len(w) ** 2 for w in words) / n) / 10, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(up(w) > 1 and low(w) == 0 for w in words) / n, sum(up(w) == 1 and low(w) > 0 for w in words) / n, sum(w[-1:] in b".," for w in words) / n, sum(len(w) <= 3 for w in words) / n,
    ]
    return [*np.sqrt(kinds / len(data)), *extra]


def test_passage_features_and_scores_equal_plain_code():
    from sitelake.llm.words import words_of

    rnd = random.Random(3)
    pool = [b"the", b"The", b"CAPS", b"end.", b"a,", "é".encode(), b"x1!", b"the", b"long-word-here"]
    words = [rnd.choice(pool) for _ in range(150)]
    text = b" ".join(words)
    x, owner = quality.encode_passages(words_of([text, b""]))
    assert owner.tolist() == [0, 0, 0, 1] and not x[3].any()
    for p in range(3):
        part = words[64 * p : 64 * p + 64]
        bytes_of = b"".join(w + b" " for w in part) if p < 2 else b" ".join(part)
        assert x[p, : quality.KINDS + 9] == pytest.approx(plain_features(part, bytes_of), abs=1e-6)
        assert (x[p, quality.KINDS + 9 :] ** 2).sum() == pytest.approx(1, abs=1e-5)
    m = quality.AttentionModel.start(x, 5, 4, 2)
    w, h = m.weights, []
    for row in x[:3]:
        z = np.clip((row - m.mean) / m.scale, -6, 6)
        h.append([math.tanh(sum(z * w["W"][:, k]) + w["b"][k]) for k in range(5)])
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    e = [math.exp(sum(w["w"][k] * math.tanh(sum(hi * w["V"][:, k])) * sigmoid(sum(hi * w["U"][:, k])) for k in range(4))) for hi in map(np.array, h)]
    mixed = sum(np.array(hi) * ei for hi, ei in zip(h, e)) / sum(e)
    assert m.score([text.decode()])[0] == pytest.approx(sigmoid(sum(mixed * w["c"]) + w["d"][0]), abs=1e-6)


def test_one_long_text_does_not_empty_the_sample(spark):
    """Whichever labelled text is far beyond the bound, the others teach the model; so do other texts than those of a repeated id."""
    prepare(spark)
    rnd = random.Random(5)
    good = lambda k: " ".join(rnd.choice(["The", "river", "ran", "slowly", "home."]) for _ in range(k))
    bad = lambda k: " ".join(rnd.choice(["BUY", "$$$", "now!!", "click", "here>>"]) for _ in range(k))
    rows = [(i, (good if i % 2 else bad)(80)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    first = labels.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))).first().doc_id
    rows[first] = (first, (good if first % 2 else bad)(40_000))
    rows += [(first, bad(3))] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learn(docs, labels, sample=60, max_passages=300)
    assert model.score([good(80)])[0] > 0.8 and model.score([bad(80)])[0] < 0.2
    none = quality.learn(docs.where("doc_id > 1000"), labels)
    assert none.score(["a"])[0] == 0.5
    with pytest.raises(DataContractError):
        quality.learn(docs, labels, sample=0)


def test_floors_are_exact_medians_of_all_labelled_texts(spark):
    import inspect

    import numpy as np
    from sitelake.llm import langid

    assert "per_language" not in inspect.signature(langid.floors).parameters
    words = {"en": "the water over green hills and", "de": "das wasser auf den gruenen bergen"}
    rows = [(i, " ".join([w] * 4) + " " + chr(98 + i % 20) * (i % 17), lang) for lang, w in words.items() for i in range(301)]
    docs = spark.createDataFrame([*rows, (999, "no label here", None)], "doc_id long, text string, lang string").repartition(5)
    filters = langid.learn(docs)
    got = langid.floors(docs, filters)
    for lang in words:
        mine = [t for _, t, l in rows if l == lang]
        shares, total = filters.predict(mine)[2:4]
        assert got[lang] == pytest.approx(0.5 * np.median(np.array(shares)[np.array(total) > 0]), abs=1e-12)
