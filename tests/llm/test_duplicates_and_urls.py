"""Copies, near copies, fingerprints, alias components and the pipeline against plain code."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelake.llm import ngram_join, simhash
from sitelake.llm.components import components
from sitelake.llm.exact_dedup import PerfectHash, exact_dedup, text_digest
from sitelake.llm.queries import prepare
from sitelake.llm.url_filter import judge_urls, rule_table


def lower_az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    again = PerfectHash.load(h.dump())
    assert (again.slots(keys) == h.slots(keys)).all()
    assert len(PerfectHash.build(keys[:0]).slots(keys)) == len(keys)


def test_exact_dedup(spark, docs_of, empty_docs):
    prepare(spark)
    rnd = random.Random(1)
    pool = ["", None, "A b", "a B", "É", "é", "x" * 9000] + [f"text {i}" for i in range(40)]
    rows = [(i, rnd.choice(pool)) for i in range(300)] + [(None, "a b"), (None, "only nameless"), (None, "only nameless"), (5, "again"), (5, "again")]
    docs = docs_of(rows).withColumn("digest", F.lit(1)).withColumn("row", F.lit(2))
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(lower_az(t).encode()).digest()].append(i)
    for history in (F.col("doc_id") < 150, F.lit(False), F.lit(True)):
        got = exact_dedup(docs, history).collect()
        assert Counter((r.doc_id, bytes(r.digest)) for r in got) == Counter((i, d) for d, ids in groups.items() for i in ids)
        for r in got:
            ids = groups[bytes(r.digest)]
            assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
        assert Counter(bytes(r.digest) for r in got if r.kept) == Counter(groups.keys())
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(empty_docs, F.lit(True)).count() == 0
    assert text_digest("ABC") == text_digest("abc") != text_digest("ÀBC")


def near_rows():
    """A chain and a star of near copies, copies, shared passages, odd texts."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    rows, n = [], 0
    for k in range(60):
        w = base.copy()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(200)] = word()
        rows.append((n := n + 1, " ".join(w)))
    w = [word() for _ in range(150)]
    for _ in range(12):
        w[rnd.randrange(150)] = word()
        w[rnd.randrange(150)] = word()
        rows.append((n := n + 1, " ".join(w)))
    passage = [word() for _ in range(60)]
    rows += [(n := n + 1, " ".join(passage + [word() for _ in range(60)])) for _ in range(30)]
    rows += [(n := n + 1, " ".join(word() for _ in range(rnd.randint(1, 30)))) for _ in range(30)]
    rows += [(500, ""), (501, None), (502, " \n "), (503, "one two"), (504, "ONE  two"), (505, "one two three"), (None, rows[0][1]), (1, rows[0][1]), (506, " ".join(word() for _ in range(30_000)))]
    return rows


def brute_near(rows, threshold=0.8):
    sets = defaultdict(list)
    for k, ((i, _), g) in enumerate(zip(rows, ngram_join.gram_sets([t for _, t in rows]))):
        sets[frozenset(g.tolist())].append((i is None, i, k))
    keys = list(sets)
    links = [(a, b) for a, b in itertools.combinations(range(len(keys)), 2) if keys[a] and keys[b] and len(keys[a] & keys[b]) >= threshold * len(keys[a] | keys[b])]
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    degree = Counter(x for p in links for x in p)
    members = defaultdict(list)
    for k in range(len(keys)):
        members[root(k)] += sets[keys[k]]
    out = Counter()
    for k, key in enumerate(keys):
        head = min(members[root(k)])
        for _, i, row in sets[key]:
            out[i, head[1], degree[k], min(sets[key])[1], len(sets[key])] += 1
    return out, len(members)


def test_near_copies(spark, docs_of, empty_docs, monkeypatch):
    prepare(spark)
    rows = near_rows()
    expected, n_classes = brute_near(rows)
    docs = docs_of(rows).withColumn("digest", F.lit(1)).withColumn("rep", F.lit(2))
    for block in (256, 8):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.similar_documents(docs).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links, r.copy_of, r.n_copies) for r in got) == expected
        assert sum(r.kept for r in got) == n_classes
    assert ngram_join.similar_documents(empty_docs).count() == 0
    assert ngram_join.similar_documents(docs_of([(1, "a b c")])).count() == 1


def test_pruning_bound():
    needs = ngram_join.least_matches(0.8, 1e-5)
    rng = np.random.default_rng(5)
    draws = rng.random((20_000, ngram_join.VALUES)) < 0.8
    lost = np.zeros(len(draws), bool)
    for k, need in enumerate(needs):
        lost |= draws[:, : (k + 1) * ngram_join.STEP].sum(axis=1) < need
    assert lost.mean() < 1e-3
    assert (rng.random((2000, ngram_join.VALUES)) < 0.4).sum(axis=1).max() < needs[-1]


def test_simhash(spark, docs_of, empty_docs):
    prepare(spark)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += [texts[3], texts[3], "", "é😀 x", "w " * 40_000, " ".join(texts[5].split()[:-1] + ["zz"]), "\n"]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "null id"), (7, "same id"), (9999, None)]
    docs = docs_of(rows).withColumn("bucket", F.lit(1)).withColumn("place", F.lit(1))
    got = simhash.fingerprint_documents(docs, radius=3).collect()
    order = sorted([(i if i is not None else -(2**63), t or "") for i, t in rows])
    expected = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        expected[None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id != 7}
    assert prints[21] == prints[80 * 7] == prints[81 * 7]
    distinct = {int(r.fingerprint, 16) for r in got}
    for r in got:
        own, edited = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        assert r.near_edited == pytest.approx(1 - (own ^ edited).bit_count() / 128)
        assert r.n_near == sum(x != own and (x ^ own).bit_count() <= 3 for x in distinct)
    by_place = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_chars), r) for r in got if r.doc_id != 7)
    long = [r for _, r in by_place if r.n_chars == 80_000]
    assert len(long) == 1
    assert simhash.fingerprint_documents(empty_docs).count() == 0
    assert simhash.fingerprint_documents(docs_of([(1, "alone here")])).first().near_next == 1.0


def test_near_fingerprints_finds_all(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    rows = {(b ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))), int(rng.integers(0, 2)) << 5) for b in base for _ in range(12)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    frame = spark.createDataFrame([(signed(a), b) for a, b in rows], "f0 long, f1 long")
    for radius, blocks in ((3, 4), (2, 4), (3, 8)):
        got = Counter(frozenset([(r.a0, r.a1), (r.b0, r.b1)]) for r in simhash.near_fingerprints(frame, radius, blocks).collect())
        want = {frozenset([(signed(a), b), (signed(c), d)]) for (a, b), (c, d) in itertools.combinations(rows, 2) if (a ^ c).bit_count() + (b ^ d).bit_count() <= radius}
        assert set(got) == want and set(got.values()) <= {1}


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(30)] + [(7, 7)]
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "u int, v int")).collect()}
    joined = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in joined}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_filter(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    rows = [
        (1, "http://a.example.org/es/x", ""), (2, "HTTP://B.Example.ORG/en/12?q#f", None), (3, "https://c.net/p", link("/de/q")),
        (4, "https://c.net/de/q", link("http://shop.com/de/blocked")), (5, "https://d.net/", '<META http-equiv=refresh content="0; url=https://c.net/p">'),
        (6, "http://x.com/fr/y", link("http://shop.com/de/blocked")), (7, None, link("http://shop.com/de/z")), (8, "no scheme", ""), (9, "", ""),
        (10, "http://f.net/a", link("http://g.org/b")), (None, "https://c.net/p#again", ""), (11, "http://com/de/", ""), (12, "http://xcom/de/", ""),
        (13, "ftp://h.net", ""), (14, "http://i.net?x=http://q.com/de/", ""), (15, "http://j.net/" + "p" * 5000, "<p>" * 5000), (1, "http://a.example.org/es/x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.path[:9]): (r.host, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark)).collect()}
    assert got[1, "/es/x"] == ("a.example.org", "example.org/es/", "block")
    assert got[2, "/en/12"] == ("b.example.org", "example.org/en/1", "block")
    assert got[3, "/p"] == ("c.net", None, "block") and got[None, "/p"][2] == "block"
    assert got[4, "/de/q"][1:] == (None, "block") and got[5, "/"][2] == "block"
    assert got[6, "/fr/y"] == ("x.com", "com/fr/", "allow")
    assert got[7, ""] == got[8, ""] == got[9, ""] == ("", None, "allow")
    assert got[10, "/a"] == ("f.net", None, "allow")
    assert got[11, "/de/"] == ("com", "com/de/", "block") and got[12, "/de/"] == ("xcom", None, "allow")
    assert got[13, ""] == ("h.net", None, "allow") and got[14, ""] == ("i.net", None, "allow")
    assert judge_urls(pages, rule_table(spark)).count() == len(rows)
    extra = spark.createDataFrame([("http://f.net/a", "http://shop.com/de/q"), (None, "http://f.net/a")], "from_url string, to_url string")
    more = {r.page_id: r.verdict for r in judge_urls(pages, rule_table(spark), redirects=extra).collect()}
    assert more[10] == "block"
    assert judge_urls(pages.limit(0), rule_table(spark)).count() == 0
    assert {r.verdict for r in judge_urls(pages, rule_table(spark, [])).collect()} == {"allow"}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against plain code on a small corpus with all kinds of rows."""
    prepare(spark)
    rnd = random.Random(11)
    words = "the of and that with for was his they this have from are which one had".split()
    text = lambda n=60: " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "ed", "ing"]) for _ in range(n)) + "."
    rows = [(i, text(), "en") for i in range(150)]
    junk = [(200 + i, " ".join(w + "###$$$" for w in text().split()), "en") for i in range(50)]
    near = []
    for i in range(5):
        w = rows[i][1].split()
        w[30] = "changed"
        near.append((300 + i, " ".join(w), "en"))
    rows += junk + near + [(400, rows[9][1].upper()[:1] + rows[9][1][1:].lower(), "en"), (401, None, None), (402, "", "en"), (403, "12 34 !!", "en"), (404, rows[9][1], "en"), (404, rows[9][1], "en"), (None, text(), None)]
    full = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    full.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _, _ in rows if i is not None and i < 250], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = Counter(r.doc_id for r in docs.collect())
        assert not Counter(docs.collect()) - Counter(before)
    ids = Counter(i for i, _, _ in rows)
    assert ids - kept["language"] == Counter([401, 402, 403])
    assert set(kept["language"] - kept["quality"]) >= {i for i, _, _ in junk} - {None}
    assert len(set(kept["language"] - kept["quality"]) - {i for i, _, _ in junk}) <= 3
    assert kept["quality"] - kept["exact_dedup"] == Counter([9, 400, 404])
    assert kept["exact_dedup"] - kept["near_dedup"] == Counter([300 + i for i in range(5)])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == kept["near_dedup"]


def test_language_stage_rejects_texts_that_were_not_learned(spark):
    """Long texts of another script, and such texts with a few known words or an address in them."""
    prepare(spark)
    rnd = random.Random(5)
    words = {"en": "the of and that with for was his they this have from", "de": "der die und nicht mit sich auf werden eine aber nur"}
    known = [(i, " ".join(rnd.choice(words[lang].split()) for _ in range(40)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    script = lambda lo, n: "".join(chr(lo + rnd.randrange(30)) if rnd.random() > 0.15 else " " for _ in range(n))
    foreign = [(1000 + i, script(lo, n), None) for i, (lo, n) in enumerate((lo, n) for lo in (0x430, 0x3B1, 0x4E00) for n in (300, 3000, 10000) for _ in range(5))]
    mixed = [(2000 + i, f"{script(0x430, n)} {w} {script(0x430, n)}", None) for i, (n, w) in enumerate((n, w) for n in (150, 1500) for w in ("the", "und nicht", "https://the.org/with"))]
    short = [(3000, "the", None), (3001, "und nicht", None), (3002, "they have \u0434\u0430", None)]
    docs = spark.createDataFrame([*known, *foreign, *mixed, *short], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in [*known, *short]}


@pytest.mark.parametrize("radius", [4, 11, 17, 20])
def test_close_fingerprints_finds_all(spark, radius):
    """Pairs at every distance around the radius, a group of many, and the borders of the halves."""
    rnd, prints = random.Random(radius), {0, (1 << 128) - 1, 1 << 63, 1 << 64, 1 << 127}
    for d in range(1, radius + 4):
        for _ in range(6):
            base = rnd.getrandbits(128)
            prints |= {base, base ^ sum(1 << i for i in rnd.sample(range(128), d))}
    base = rnd.getrandbits(128)
    prints |= {base ^ sum(1 << i for i in rnd.sample(range(128), rnd.randrange(radius))) for _ in range(80)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pair = lambda p: (signed(p & (1 << 64) - 1), signed(p >> 64))
    frame = spark.createDataFrame([pair(p) for p in sorted(prints)], "f0 long, f1 long")
    got = Counter(frozenset([(r.a0, r.a1), (r.b0, r.b1)]) for r in simhash.close_fingerprints(frame, radius).collect())
    assert got == Counter(frozenset([pair(p), pair(q)]) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= radius)


def test_simhash_counts_near_copies(spark, docs_of):
    """A text in which one word of a hundred is another has its near copy counted."""
    rnd = random.Random(3)
    text = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
    got = simhash.fingerprint_documents(docs_of([(1, " ".join(text)), (2, " ".join([*text[:50], "changed", *text[51:]])), (3, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(100)))])).collect()
    assert {r.doc_id: r.n_near for r in got} == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("members", [512, 4])
def test_near_counts_equal_brute_force(spark, members):
    """Counts per fingerprint for several radii, buckets of one list and of many; a group far from all others has none."""
    prepare(spark)
    rnd = random.Random(1)
    values = {rnd.getrandbits(128) for _ in range(30)}
    for b in sorted(values):
        for _ in range(20):
            values.add(b ^ sum(1 << i for i in rnd.sample(range(128), rnd.randrange(1, 20))))
    values |= {0, 1, 1 << 63, 1 << 64, (1 << 128) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda v: (signed(v & (1 << 64) - 1), signed(v >> 64))
    frame = spark.createDataFrame([halves(v) for v in sorted(values)], "f0 long, f1 long")
    for radius in (0, 3, 17):
        want = {halves(v): n for v in values if (n := sum((u ^ v).bit_count() <= radius for u in values) - 1)}
        assert {(r.f0, r.f1): r.n_near for r in simhash.near_counts(frame, radius, members).collect()} == want


def test_near_counts_between_small_and_full_buckets(spark):
    """Large groups of near copies, a crowd of unlike ones and copies one bit from a full bucket equal brute force; small buckets are joined by row."""
    prepare(spark)
    rng = np.random.default_rng(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda v: (signed(v & (1 << 64) - 1), signed(v >> 64))
    values = {int.from_bytes(rng.bytes(16), "little") for _ in range(300)}
    for group, bits in ((120, 3), (60, 12)):
        base = int.from_bytes(rng.bytes(16), "little")
        values |= {base ^ sum(1 << int(i) for i in rng.choice(128, rng.integers(0, bits), replace=False)) for _ in range(group)}
    base = int.from_bytes(rng.bytes(16), "little")
    values |= {base ^ (i << 100) for i in range(40)} | {base ^ (1 << b) ^ (i << 100) for b in (0, 20, 90) for i in range(3)}
    frame = spark.createDataFrame([halves(v) for v in sorted(values)], "f0 long, f1 long")
    for radius in (5, 17):
        want = {halves(v): n for v in values if (n := sum((u ^ v).bit_count() <= radius for u in values) - 1)}
        counts = simhash.near_counts(frame, radius)
        assert {(r.f0, r.f1): r.n_near for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "bit_count" in line for line in plan.splitlines())


def test_fingerprint_bits_equal_a_plain_vote(spark, docs_of):
    """Every bit is the majority of the term hashes, counted one by one in Python."""
    prepare(spark)
    texts = ["one two  three\tone two", "", "A b A b A b c", "é " * 50 + "x", " ".join(f"w{i % 37}" for i in range(3000))]
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprint_documents(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        words = ["\u0002", *[w for w in re.split("[ \t\n\x0b\f\r]+", text) if w], None]
        pairs = Counter(zip(words, words[1:]))
        rows = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a string, b string, n long")
        term = F.xxhash64("a", "b")
        hashes = rows.select("n", *[F.xxhash64(term, F.lit(h)).alias(f"h{h}") for h in (0, 1)]).collect()
        total, bits = sum(pairs.values()), []
        for h in ("h0", "h1"):
            bits.append(sum(1 << k for k in range(64) if 2 * sum(r.n for r in hashes if r[h] >> k & 1) > total))
        assert got[i] == "".join(f"{b:016x}" for b in bits)
