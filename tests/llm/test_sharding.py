import hashlib
import random
import zlib

import pytest

from tessera.llm import sharding


def best(sizes, shards):
    """The smallest capacity, by trying them all in turn, and the greedy cuts at it."""

    def cut(capacity):
        out, left = [0], capacity
        for i, s in enumerate(sizes):
            if s > left:
                out.append(i)
                left = capacity
            left -= s
        return out

    capacity = max(sizes)
    while len(cut(capacity)) > shards:
        capacity += 1
    return capacity, cut(capacity)


def brute(rows, shards):
    groups = {}
    for doc_id, text in rows:
        g = groups.setdefault(text or "", [doc_id, 0])
        g[0], g[1] = min(g[0], doc_id), g[1] + len((text or "").encode()) + 1
    order = sorted(groups, key=lambda t: groups[t][0])
    _, cuts = best([groups[t][1] for t in order], shards)
    shard = {t: sum(i >= c for c in cuts) - 1 for i, t in enumerate(order)}
    out, slots = [], {}
    for doc_id, text in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        t = text or ""
        s = shard[t]
        out.append((doc_id, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", s, slots.get(s, 0), None))
        slots[s] = slots.get(s, 0) + 1
    return sorted(out)


@pytest.mark.parametrize("seed,cells,slot_rows", [(1, 4096, 50_000), (2, 16, 3), (3, 16, 10)])
def test_against_brute_force(spark, monkeypatch, seed, cells, slot_rows):
    monkeypatch.setattr(sharding, "CELLS", cells)
    monkeypatch.setattr(sharding, "SLOT_ROWS", slot_rows)
    rng = random.Random(seed)
    texts = ["é" * rng.randrange(0, 90) + str(rng.randrange(40)) for _ in range(90)] + [None, "", ""] + ["copy of one text " * 3] * 40
    rng.shuffle(texts)
    rows = list(zip(rng.sample(range(10**6 if seed == 3 else 500), len(texts)), texts))
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, shard string, size int")
    for shards in (1, 4, 16):
        assert sorted(map(tuple, sharding.shard_documents(docs, shards).collect())) == brute(rows, shards)


def test_few_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert [(r.shard, r.slot) for r in sharding.shard_documents(docs).orderBy("slot").collect()] == [(0, 0), (0, 1)]
    assert sharding.shard_documents(docs.limit(0)).collect() == []


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "b"), (4, "c"), (4, "c"), (4, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
