import random

import numpy as np
import pytest

from waymill.llm import leaks
from waymill.llm.words import WordHashes, words


def test_words():
    text = "<p>Der&nbsp;Zug​ A­bc ﬁx</p>1,5 <b>X</b>Y ＡＢ &amp; ÀÉ_z"
    assert words(text) == ["der", "zug", "abc", "fix", "1", "5", "x", "y", "ab", "àé", "z"]


@pytest.mark.parametrize("radius", [3, 15])
def test_index_finds_everything_within_the_radius(radius):
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**64, 300, dtype=np.uint64)
    probes = []
    for p in prints[:200].tolist():
        for k in r.choice(64, r.integers(0, radius + 3), replace=False).tolist():
            p ^= 1 << k
        probes.append(p)
    probes = np.array(probes, np.uint64)
    left, right = leaks.HammingIndex(prints, radius).within(probes)
    want = {(i, j) for i in range(len(probes)) for j in range(len(prints)) if int(probes[i] ^ prints[j]).bit_count() <= radius}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


@pytest.mark.parametrize("n", [5, 6, 12, 13, 60, 300])
def test_fingerprints_like_a_plain_sum(n):
    h = np.random.default_rng(2).integers(0, 2**64, 700, dtype=np.uint64)
    got, s = leaks.fingerprints(h, n), leaks.shingles(h, 5)
    each = n - 4
    for i in (0, 7, len(h) - n):
        bits = [[int(x) >> (63 - k) & 1 for k in range(64)] for x in s[i : i + each]]
        want = 0
        for k in range(64):
            ones = sum(b[k] for b in bits)
            want = want << 1 | (2 * ones > each or (2 * ones == each and bits[0][k]))
        assert int(got[i]) == want


def test_similar_windows_have_near_fingerprints():
    r = random.Random(3)
    h = WordHashes()
    same = [str(r.random()) for _ in range(40)]
    a = leaks.fingerprints(h.of(same), 40)[0]
    b = leaks.fingerprints(h.of([*same[:39], "other"]), 40)[0]
    c = leaks.fingerprints(h.of([str(r.random()) for _ in range(40)]), 40)[0]
    assert int(a ^ b).bit_count() < int(a ^ c).bit_count()


def test_weighted_similarity():
    one = np.ones(3)
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)
    assert leaks.weighted_similarity(a, one, b, one) == 0.5
    assert leaks.weighted_similarity(a, one, a, one) == 1.0


def brute(docs, items):
    out = set()
    for i, t in items:
        w = words(t or "")
        n = min(12, len(w))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            v = words(text or "")
            if any(tuple(v[k : k + n]) in own for k in range(len(v) - n + 1)):
                out.add((i, d))
    return out


def test_like_brute_force_with_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 50)
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 40)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 11, 12, 13, 30, 40, 12])] + [(50, None), (51, ""), (52, "<p> ... </p>")]
    items.append(items[9])
    docs = [(d, " ".join(r.choices(vocabulary, k=r.choice([0, 3, 60, 300])))) for d in range(30)]
    for d in range(30, 50):
        i = r.choice(items[:12])[1].split()
        at = r.randint(0, max(0, len(i) - 12))
        docs.append((d, " ".join([*r.choices(vocabulary, k=r.randint(0, 120)), *i[at : at + r.randint(8, 30)], *r.choices(vocabulary, k=r.randint(0, 60))])))
    docs += [(60, None), (61, ""), (None, items[9][1])]
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.item_id, x.doc_id) for x in leaks.leaks(dd, ii).collect()}
    assert got == brute([x for x in docs if x[0] is not None], items)


def similar_brute(docs, items):
    """(item, document) -> best weighted similarity of an item-sized window, by comparing every window that shares a
    shingle with the item."""
    hashes, out = WordHashes(), {}
    own = {}
    for i, t in items:
        if w := words(t or ""):
            own[i] = (w, hashes.of(w))
    for d, t in docs:
        v = words(t or "")
        h = hashes.of(v)
        for i, (w, g) in own.items():
            n, size = len(w), min(5, len(w))
            at = np.flatnonzero(np.isin(leaks.shingles(h, size), leaks.shingles(g, size)))
            for p in {x for k in at.tolist() for x in range(k - n + size, k + 1) if 0 <= x <= len(v) - n}:
                s = leaks.similarity(h[p : p + n], v[p : p + n], g, w)
                if s >= 0.8:
                    out[i, d] = max(out.get((i, d), 0.0), s)
    return out


def test_recall_of_similar_items(spark):
    """Items of all lengths with words changed, dropped or added: at least nine of ten similar pairs are found."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(8, 90)))) for i in range(150)]
    docs = []
    for d in range(500):
        w = r.choice(items)[1].split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([["another"], [], [w[k], "some"]])
        docs.append((d, " ".join([*r.choices(vocabulary, k=r.randint(0, 60)), *w, *r.choices(vocabulary, k=r.randint(0, 60))])))
    want = similar_brute(docs, items)
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.item_id, x.doc_id): x.similarity for x in leaks.leaks(dd, ii, exact=False).collect()}
    changed = {k for k, s in want.items() if s < 1}
    assert len(changed) > 100
    assert set(got) <= set(want)
    assert len(changed & set(got)) >= 0.9 * len(changed)
    assert {k for k, s in want.items() if s == 1} <= set(got)


def test_blocks_of_items(spark, monkeypatch):
    """Items beyond one block are looked for block by block, with the same result."""
    r = random.Random(12)
    items = [(i, " ".join(r.choices("abcdefgh", k=20))) for i in range(30)]
    docs = [(d, " ".join([*r.choices("abcdefgh", k=30), *r.choice(items)[1].split(), "z"])) for d in range(40)]
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    once = sorted(map(tuple, leaks.leaks(dd, ii, exact=False).collect()))
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 11)
    assert sorted(map(tuple, leaks.leaks(dd, ii, exact=False).collect())) == once


def test_whole_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs, items).collect()} == want
