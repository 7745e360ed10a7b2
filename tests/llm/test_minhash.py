"""Near-duplicate groups against all pairs of exact shingle sets."""

from __future__ import annotations

import random

import numpy as np

from tessera.llm import minhash
from tests.llm.test_ops import AWKWARD, prose, table, words_of

FOLD = str.maketrans(minhash.UPPER, minhash.LOWER)


def shingles(text):
    w = words_of((text or "").translate(FOLD))
    return {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()


def brute(texts, ids=None):
    ids = ids or list(range(len(texts)))
    held = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for j in range(len(texts)):
        for k in range(j):
            both = len(held[j] & held[k])
            if both and 100 * both >= 80 * len(held[j] | held[k]):
                root[find(j)] = find(k)
    smallest = {}
    for k in range(len(texts)):
        smallest[find(k)] = min(smallest.get(find(k), ids[k]), ids[k])
    return sorted((ids[k], len(held[k]), smallest[find(k)], ids[k] == smallest[find(k)]) for k in range(len(texts)))


def found(spark, texts, **columns):
    return sorted(map(tuple, minhash.groups(table(spark, texts, **columns).repartition(5)).collect()))


def edited(text, rng, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng.random(), 1).upper()
    return " ".join(w)


def unlike(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_groups_equal_all_pairs(spark):
    rng = random.Random(1)
    texts = [unlike(k, rng.randint(1, 150)) for k in range(60)]
    texts += [edited(texts[rng.randrange(60)], rng, rng.randint(1, 9)) for _ in range(120)] + [texts[3].upper(), texts[4], texts[4]]
    assert found(spark, texts) == brute(texts)


def test_short_texts_equal_all_pairs(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert found(spark, texts) == brute(texts)


def test_links_that_no_hub_sees_are_found(spark, monkeypatch):
    """Chains of texts, each like the next only: a bucket's hub is unlike most of its sets, and blocks are small."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    texts = []
    for k in range(8):
        text = unlike(k, 80)
        for _ in range(25):
            text = edited(text, rng, 3)
            texts.append(text)
    assert found(spark, texts) == brute(texts)
    docs = table(spark, texts).select("doc_id", "text")
    rows = minhash.sets(docs).where("n > 0").selectExpr("doc_id as cid", "bins")
    links = minhash.unfinished(minhash.buckets(rows), spark.createDataFrame([], "node long, root long"))
    assert links.where("n_rest > 8").count() > 0


def test_many_near_copies_share_a_hub(spark):
    rng = random.Random(4)
    base = unlike(99, 120)
    texts = [edited(base, rng, 2) for _ in range(400)] + [unlike(k, 50) for k in range(20)]
    assert found(spark, texts) == brute(texts)


def test_awkward_rows(spark):
    assert found(spark, AWKWARD) == brute(AWKWARD)
    assert found(spark, []) == []
    rows = minhash.groups(spark.createDataFrame([(None, "a b c"), (7, "A b C"), (7, "a b c"), (None, "x"), (9, None), (9, None)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 1, None, True), (9, 0, 9, True), (9, 0, 9, True)], key=str)


def test_densified_bins_agree_as_often_as_sets(spark):
    rng = random.Random(5)
    orders = minhash._orders(minhash.BINS)
    for size in (3, 10, 60, 500):
        alike = []
        for _ in range(60):
            values = np.array([rng.getrandbits(64) for _ in range(size + size // 3)], dtype=np.uint64)
            a, b = values[:size], values[size // 3 :]
            made = minhash.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, orders)
            assert (made != minhash._EMPTY).all()
            alike.append((made[0] == made[1]).mean())
        true = (size - size // 3) / (size + size // 3)
        assert abs(np.mean(alike) - true) < 0.08
    assert minhash.miss() < 5e-5
