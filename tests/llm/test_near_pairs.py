"""Near-duplicates of the pipeline against plain Jaccard likeness, whatever the fingerprints."""

import hashlib
import random

import numpy as np

from veriseam.llm import jaccard_join, minhash, simhash

from .test_documents import groups_of, words


def by_jaccard(texts, least=0.8):
    sets = {d: set(minhash.shingles(t).tolist()) for d, t in texts.items()}
    alike = lambda x, y: len(x & y) >= least * len(x | y)
    return groups_of([(a, b) for a in texts for b in texts if a < b and alike(sets[a], sets[b])], texts)


def found(spark, texts):
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(table).collect()}


def bits(a, b):
    return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()


def test_pairs_beyond_the_distance(spark):
    rnd = random.Random(21)
    texts = {}
    while len(texts) < 40:
        own = words(rnd.randint(60, 150), rnd)
        longer = own + words(len(own) // 5, rnd)
        if bits(" ".join(own), " ".join(longer)) > 12:
            texts |= {len(texts): " ".join(own), len(texts) + 1: " ".join(longer)}
    want = by_jaccard(texts)
    assert len(set(want.values())) <= 25
    assert found(spark, texts) == want


def test_pairs_in_a_dense_group(spark):
    rnd = random.Random(22)
    line = words(12, rnd)
    texts = {}
    for _ in range(120):
        own = words(40, rnd)
        for more in (0, 6):
            texts[len(texts)] = " ".join(line * 4 + own + words(more, rnd))
    near = [sum(bits(texts[a], texts[b]) <= 12 for b in texts) for a in list(texts)[:20]]
    assert min(near) > 10
    want = by_jaccard(texts)
    assert len(set(want.values())) == 120
    assert found(spark, texts) == want


def test_pairs_of_one_fingerprint(spark):
    rnd = random.Random(23)
    line = words(5, rnd)
    texts = {0: " ".join(line * 60 + words(40, rnd))}
    for _ in range(20):
        own = words(40, rnd)
        texts |= {len(texts): " ".join(line * 60 + own), len(texts) + 1: " ".join(line * 60 + own + words(3, rnd))}
    assert len({simhash.fingerprint(t) for t in texts.values()}) == 1
    want = by_jaccard(texts)
    assert len(set(want.values())) == 21
    assert found(spark, texts) == want


def test_rows_that_share_an_id(spark):
    rnd = random.Random(24)
    a, b, c = (" ".join(words(80, rnd)) for _ in range(3))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (7, c, 4), (7, c + " more", 5), (None, a, 6), (None, a, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect())) == sorted([(False, 1, a), (False, 5, b), (False, 7, min((c, c + " more"), key=lambda t: hashlib.md5(t.encode()).digest())), (True, 0, a), (True, 0, a)])


def test_profiles_bound_what_is_shared():
    rng = np.random.default_rng(25)
    profile, bound = jaccard_join.profile, jaccard_join.overlap_bound
    for n, m in ((0, 5), (1, 1), (10, 300), (300, 310), (5000, 4500), (20, 40_000)):
        pool = np.unique(rng.integers(0, 1 << 63, size=2 * (n + m), dtype=np.uint64))
        rng.shuffle(pool)
        x, y = np.unique(pool[:n]), np.unique(np.r_[pool[n // 2 : n], pool[n : n + m]][:m])
        assert bound(profile(x), profile(y)) >= len(np.intersect1d(x, y))
    crowd = (np.arange(300, dtype=np.uint64) << np.uint64(20)) + np.uint64(3)
    assert profile(crowd) == b"" and bound(b"", profile(crowd[:8])) >= 300


def test_recall_of_planted_pairs(spark):
    rnd = random.Random(26)
    texts = {}
    for _ in range(60):
        own = words(rnd.randint(40, 300), rnd)
        texts[len(texts)] = " ".join(own)
        for kind in rnd.sample(["append", "cut", "block", "scatter"], 2):
            near, k = own[:], max(1, int(len(own) * rnd.uniform(0.02, 0.12)))
            if kind == "append":
                near += words(k, rnd)
            elif kind == "cut":
                near = near[k:]
            elif kind == "block":
                at = rnd.randrange(len(near) - k)
                near[at : at + k] = words(k, rnd)
            else:
                for at in rnd.sample(range(len(near)), max(1, k // 5)):
                    near[at] = "changed"
            texts[len(texts)] = " ".join(near)
    assert found(spark, texts) == by_jaccard(texts)


def test_texts_that_meet_under_a_band_are_dealt_together(spark):
    """Fingerprints of these are near in pairs alone, so each pair would be asked for a passage that all share."""
    far = [0, 1, -1, -2, 0x5555555555555555, 0x5555555555555554]
    rows = [(i, f, [7 if j == 5 else 100 * i + j for j in range(jaccard_join.BANDS)]) for i, f in enumerate(far)]
    nodes = spark.createDataFrame([*rows, (6, 0x0F0F0F0F0F0F0F0F, list(range(1000, 1000 + jaccard_join.BANDS))), (7, 0x0F0F0F0F0F0F0F0E, list(range(2000, 2000 + jaccard_join.BANDS)))], "node long, also long, bands array<long>")
    labels = {r["node"]: r["one"] for r in simhash.fingerprint_labels(nodes, 12).collect()}
    assert labels == {i: 0 for i in range(6)} | {6: 6, 7: 6}
