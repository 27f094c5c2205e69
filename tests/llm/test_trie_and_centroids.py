"""The prefix trie and centroid clustering against their definitions in plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np

from veriseam.llm import centroids, prefix_trie


def trie_by_definition(rows):
    """{(owner, depth): (parent, members, children, leaves, saved, ends)} by following every sequence of turns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (*t[:3], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))
    own = {c: [t[2:] for t in turns] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = {}
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None,
            len(convs),
            len(children.get(node, [])),
            sum(x not in children for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def trie_found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'a' as x0", "2 as n", "3 as mark")
    return {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie.rebuilt_trie(df).collect()}


def test_trie_of_shared_prefixes(spark):
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 130), 200, 305, 405, -1, -100, -101]:
        for t in range(rnd.choice([1, 1, 2, 3, 7])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "Ünï🙂"])))
    want = trie_by_definition(rows)
    assert max(v[1] for k, v in want.items() if k[1]) > 20
    assert trie_found(spark, rows) == want


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "", ""), (1, 3, "user", None), (1, 3, "user", "tie"), (1, 3, "assistant", "tie"), (1, 3, "user", "tie"),
        (None, 0, "user", "lost"), (2, 0, "a", "b"), (3, 0, "", "ab"), (4, 0, "user", "x" * 100_000), (100, 0, "u", "t"), (100, 0, "u", "t"), (107, 5, None, "z"), (700, 0, "only", "base"),
    ]
    assert trie_found(spark, rows) == trie_by_definition(rows)
    assert trie_found(spark, []) == {}


def test_many_conversations_that_end_at_one_node(spark, monkeypatch):
    rows = [(100 * c, 0, "user", "same") for c in range(1, 3000)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 100)
    assert trie_found(spark, rows) == trie_by_definition(rows)


def clusters_by_definition(rows, k=16, rounds=3):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [n * 64 // d for n, d in (float(x).as_integer_ratio() for x in v)]))
    rank = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    at = [v for _, v in sorted(kept, key=rank)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    made = [(i, *nearest(v)) for i, v in kept]
    least = (1 << 63) - 1
    total = {j: sum(d for _, d, o in made if o == j) for j in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((repr(i), j, min(d, least), min(total[j], least), min(sum(total.values()), least), sha[j]) for i, d, j in made)


def clusters_found(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as width", "2 as ints", "'x' as cluster")
    return sorted((repr(r[0]), *r[1:]) for r in centroids.cluster(df).collect())


def test_centroids_against_the_definition(spark):
    rng = np.random.default_rng(3)
    around = rng.normal(size=(9, 64))
    x = around[rng.integers(0, 9, 400)] + 0.3 * rng.normal(size=(400, 64))
    rows = [(i, [float(v) for v in np.round(r, 2)]) for i, r in enumerate(x)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (900, rows[3][1])]
    rows += [(901, None), (902, []), (903, [1.0] * 63), (904, [1.0] * 65), (905, [None] + [1.0] * 63), (906, [float("nan")] + [1.0] * 63), (907, [float("inf")] + [1.0] * 63)]
    assert clusters_found(spark, rows) == clusters_by_definition(rows)


def test_centroids_with_ties_and_few_vectors(spark):
    rows = [(i, [0.25 * (i % 3 - 1)] * 64) for i in range(40)]
    assert clusters_found(spark, rows) == clusters_by_definition(rows)
    assert clusters_found(spark, rows[:3]) == clusters_by_definition(rows[:3])
    assert clusters_found(spark, []) == [] == clusters_found(spark, [(1, [1.0])])


def test_centroids_of_very_large_components(spark):
    rnd = random.Random(8)
    size = [1e-3, 1.0, 300.0, 1e5, 3e6, 1e9, 1e20, 1e300, 1.7e308]
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * size[i % len(size)] for _ in range(64)]) for i in range(60)]
    assert clusters_found(spark, rows) == clusters_by_definition(rows)


def test_bounds_spare_distances_and_never_change_the_nearest():
    rng = np.random.default_rng(4)
    c = rng.integers(-60, 60, (16, 64))
    x = c[rng.integers(0, 16, 500)] * rng.integers(1, 3, (500, 1)) + rng.integers(-3, 4, (500, 64))
    label, d, taken = centroids.nearest(x, centroids._norms(x, 8), c)
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (label == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    assert taken < 16 * 500 / 2
