"""SimHash fingerprints, the trie join and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import simhash
from tessella.operators.graph import least_reachable


def direct_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def direct_components(prints):
    """prints: (id, fingerprint); the component id of each row, by all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    ids = {}
    for i, (own, _) in enumerate(prints):
        ids.setdefault(root(i), []).append(own)
    return [min((x for x in ids[root(i)] if x is not None), default=None) for i in range(len(prints))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBé \n\t Z", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == direct_fingerprint(text)


def near_values(rng, n, bits=64):
    """Values of which many are a few bits apart."""
    centres = [rng.getrandbits(bits) for _ in range(max(1, n // 8))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(bits)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
@pytest.mark.parametrize("chunk", [5, 1 << 18])
def test_trie_join_finds_all_links(monkeypatch, budget, chunk):
    monkeypatch.setattr(simhash, "_CHUNK", chunk)
    monkeypatch.setattr(simhash, "_BRUTE", 2)
    rng = random.Random(budget)
    for n in (1, 2, 60, 300):
        a, b = near_values(rng, n), near_values(rng, n, 20)
        own = {tuple(map(int, p)) for p in zip(*simhash.linked_pairs(a, None, budget), strict=True)}
        assert own == {(int(x), int(y)) for x in a for y in a if x < y and int(x ^ y).bit_count() <= budget}
        both = {tuple(map(int, p)) for p in zip(*simhash.linked_pairs(a, b, budget), strict=True)}
        assert both == {(int(x), int(y)) for x in a for y in b if int(x ^ y).bit_count() <= budget}


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_some_view_has_near_values_together(budget):
    rng = random.Random(budget)
    for depth in (0, 21, 43, 60, 63):
        x = np.array([rng.getrandbits(64) for _ in range(200)], dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for _ in range(budget):
                y[i] ^= np.uint64(1) << np.uint64(rng.randrange(64 - depth))
        together = np.zeros(len(x), dtype=bool)
        for (u, d), (v, e) in zip(simhash.views(x, depth, budget), simhash.views(y, depth, budget), strict=True):
            assert d == e and (np.bitwise_count(u ^ v) == np.bitwise_count(x ^ y)).all()
            together |= (u >> np.uint64(64 - d) if d else u * np.uint64(0)) == (v >> np.uint64(64 - d) if d else v * np.uint64(0))
        assert together.all()


@pytest.mark.parametrize("most", [4, 30, 1 << 20])
def test_links_are_whole_on_either_side_of_the_split(spark, most):
    rng = random.Random(most)
    values = np.unique(np.concatenate([near_values(rng, 400), near_values(rng, 300, 12), np.arange(64, dtype=np.uint64)]))
    classes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(5)
    roots = {r["u"]: r["v"] for r in least_reachable(simhash.linked(classes, 2, most)).collect()}
    left, right = simhash.linked_pairs(values, None)
    assert len(set(zip(left.tolist(), right.tolist(), strict=True))) == sum(int(a ^ b).bit_count() <= 2 for i, a in enumerate(values) for b in values[:i])
    u, v = simhash.stars(left, right)
    name = lambda pairs: {frozenset(g) for g in pairs}
    groups = {}
    for x, root in zip(u.tolist(), v.tolist(), strict=True):
        groups.setdefault(root, {root}).add(x)
    mine = {}
    for x, root in roots.items():
        mine.setdefault(root, {root % 2**64}).add(x % 2**64)
    assert name(mine.values()) == name(groups.values())


def test_a_dense_group_is_held_as_a_forest():
    """All fingerprints within three bits of one: each has many links."""
    values = np.unique(np.array([0] + [1 << i | 1 << j | 1 << k for i in range(40) for j in range(i) for k in range(j)], dtype=np.uint64))
    u, v = simhash.forest(simhash.walked_links(values, None, 2), 1000)
    left, right = simhash.linked_pairs(values, None, 2)
    a, b = simhash.stars(left, right)
    assert len(left) > 20 * len(values) and len(u) < len(values)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == dict(zip(a.tolist(), b.tolist(), strict=True))


def test_copies_of_a_fingerprint_do_not_depend_on_their_number(spark):
    rng = np.random.default_rng(2)
    for n in (200, 20_000):
        classes = spark.createDataFrame([(int(v),) for v in rng.integers(-(2**63), 2**63 - 1, n)], "fp long")
        zero = F.lit(0).cast("long")
        rows = classes.select(zero.alias("path"), zero.alias("depth"), F.col("fp").alias("value"), "fp").mapInArrow(simhash._viewed(2), "path long, depth long, value long, fp long")
        assert rows.count() == 3 * n


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 - i, 99 - i) for i in range(20)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["u"]: r["v"] for r in least_reachable(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 80 for i in range(81, 101)} | {201: 200}


def test_near_groups(spark, awkward, no_docs, monkeypatch):
    monkeypatch.setattr(simhash.linked, "__defaults__", (2, 8))
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(2, 60))] for _ in range(40)]
    texts = []
    for _ in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    rows = [(1000 + i, t, "en", "a", 1) for i, t in enumerate(texts)] + [tuple(r) for r in awkward.collect()]
    docs = spark.createDataFrame(rows, awkward.schema).withColumns({"fp": F.lit(1), "root": F.lit(2), "u": F.lit(3)})
    prints = [(r[0], direct_fingerprint(r[1])) for r in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, direct_components(prints), strict=True))
    got = simhash.near_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({int(c) for _, _, c in want})
    assert simhash.near_groups(no_docs).count() == 0 and simhash.drop_near_copies(no_docs).count() == 0
