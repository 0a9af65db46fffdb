import random

import numpy as np
import pytest
import xxhash

from tessera.llm import graph, simhash

BREAKS = " \t\n\x0b\x0c\r"


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in BREAKS:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdÉñ") for _ in range(4))
    texts = [None, "", " \t\n", "One", "one", "one\x1ftwo", "a b c", "A  B c d\x0be f", "long " * 30000]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = word()
            texts.append(rng.choice([" ", "\n"]).join(base).upper())
    return list(zip(rng.sample(range(10_000), len(texts)), texts))


@pytest.mark.parametrize("seed,members", [(1, 1 << 17), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rows = corpus(seed)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = {d: (format(f, "016x"), c) for (d, _), f, c in zip(rows, fps, brute_components([d for d, _ in rows], fps))}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("distance,blocks", [(4, 3), (5, 3), (3, 2), (4, 2)])
def test_coverings_miss_no_pair(distance, blocks):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for _ in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, distance + 1), replace=False)) for _ in a], np.uint64)
        met = np.zeros(len(a), bool)
        for code in simhash.coverings(distance, blocks):
            home = code.homes(a)
            assert (np.bitwise_count(home ^ code.values(a)) <= 1).all()
            who, anchor = code.near(a ^ flips)
            assert (np.bitwise_count(anchor ^ code.values(a ^ flips)[who]) <= 1 + distance // blocks).all()
            met[who[anchor == home[who]]] = True
        assert met.all()


@pytest.mark.parametrize("members", [1 << 17, 4])
def test_clusters_of_near_fingerprints(spark, monkeypatch, members):
    """Chains and balls of close fingerprints, in few anchors."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng = random.Random(8)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                x ^= 1 << b
        fps |= {x ^ (1 << rng.randrange(64)) for _ in range(20)}
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long"))
    got = {r.node % 2**64: r.rep for r in graph.components(edges).collect()}
    want = brute_components(range(len(fps)), fps)
    for (f, w), (g, v) in zip(zip(fps, want), zip(fps[1:], want[1:])):
        assert (got.get(f, f) == got.get(g, g)) == (w == v)
    assert len({got.get(f, f) for f in fps}) == len(set(want))


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5000, 5000), (-3, -9)]
    got = {r.node: r.rep for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 201 + 150 + 1 + 2
    assert len({got[i] for i in range(201)}) == len({got[1000 + i] for i in range(150)}) == 1
    assert len(set(got.values())) == 4


def test_empty_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "same words here now again"), (7, "same words here now again"), (7, "same words here now again")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [7, 7, 7]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
