import random

import numpy as np
import pytest
import xxhash

from tessera.llm import neardup

MASK = 2**64 - 1


def shingles(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_fingerprint(text):
    """128 bits, the second word from a second mix of the shingles' hashes."""
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    out = 0
    for k in range(2):
        mixed = []
        for h in hashes:
            z = (h + 0x9E3779B97F4A7C15 * (k + 1)) & MASK
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
            z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
            mixed.append(z ^ z >> 31)
        out |= sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in mixed) > len(mixed)) << 64 * k
    return out


def alike(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def meet(x, y):
    return (x ^ y).bit_count() <= 36 and any(((x ^ y) >> 16 * k & 0xFFFF).bit_count() <= 1 for k in range(8))


def brute_kept(rows, by_bits=True):
    """The doc_ids that stay, by all pairs."""
    sets, fps = [shingles(t) for _, t in rows], [brute_fingerprint(t) for _, t in rows]
    linked = lambda i, j: sets[i] == sets[j] or alike(sets[i], sets[j]) and (not by_bits or meet(fps[i], fps[j]))
    todo, kept = set(range(len(rows))), []
    while todo:
        reach, queue = set(), [min(todo)]
        while queue:
            i = queue.pop()
            if i not in reach:
                reach.add(i)
                queue += [j for j in todo - reach if linked(i, j)]
        todo -= reach
        kept.append(min((rows[i][0] for i in reach), key=lambda d: (d is None, d)))
    return sorted(kept, key=lambda d: (d is None, d))


def run(spark, rows):
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((r.doc_id for r in got.collect()), key=lambda d: (d is None, d))


def family(seed, size, words, edits):
    """A text and ``size`` edited copies, the text's doc_id the largest."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    rows = [(1000, " ".join(base))]
    for d in range(size):
        copy = list(base)
        for at in rng.sample(range(words), rng.randrange(*edits)):
            copy[at] = word()
        rows.append((d, " ".join(copy)))
    return rows


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdÉñ") for _ in range(4))
    texts = [None, "", " \t\n", "One", "one", "a b c", "A  B c d\x0be f", "a b c d e", "long " * 30000]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(3, 160))]
        texts += [" ".join(base), "\n".join(base).upper()]
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    return [*zip(rng.sample(range(10_000), len(texts)), texts), (None, "nobody knows who this text is by"), (None, None)]


@pytest.mark.parametrize("seed,thick,members", [(1, 2, 1 << 20), (2, 0, 1 << 20), (3, 2, 4)])
def test_against_brute_force(spark, monkeypatch, seed, thick, members):
    monkeypatch.setattr(neardup, "THICK", thick)
    monkeypatch.setattr(neardup, "MEMBERS", members)
    rows = corpus(seed)
    assert run(spark, rows) == brute_kept(rows)


@pytest.mark.parametrize("edits,members,side", [((2, 7), 1 << 20, 1 << 12), ((2, 9), 1 << 20, 40), ((4, 6), 60, 1 << 12)])
def test_families_of_edited_copies(spark, monkeypatch, edits, members, side):
    """Copies that are close by bits and like the text, but often not like each other."""
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "SIDE", side)
    rows = family(3, 250, 200, edits)
    assert run(spark, rows) == brute_kept(rows)


def test_recall_of_near_copies():
    """Pairs of similarity 0.8 to 0.85, the hardest: nine of ten meet."""
    rng = np.random.default_rng(5)
    met = []
    for _ in range(400):
        n = int(rng.integers(60, 900))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        edits = int(n * rng.uniform(0.075, 0.111))
        b = np.concatenate([a[edits:], rng.integers(0, 2**64, edits, dtype=np.uint64)])
        fps = [[neardup.fingerprint(neardup.mixed(x, k)) for k in range(2)] for x in (a, b)]
        x, y = (f[0] | f[1] << 64 for f in fps)
        met.append(meet(x, y))
    assert np.mean(met) >= 0.9


@pytest.mark.parametrize("dense", [1, 100, 1 << 21])
def test_links_of_an_anchor_do_not_depend_on_blocks(monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    rng = np.random.default_rng(7)
    f = rng.integers(0, 2**64, (6, 2), dtype=np.uint64)[rng.integers(0, 6, 80)]
    f[:, 1] ^= np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)
    sizes, ids = rng.integers(80, 130, 80), rng.permutation(80)
    anchor = int(neardup.covering().homes(neardup.lanes(f[:1])[:, 0].astype(np.uint64))[0])
    m = neardup.Members.of(anchor, ids, f, sizes)
    got = {(int(m.ids[a]), int(m.ids[b])) for i, j, _ in m.links(0, 0.8) for a, b in zip(i, j)}
    value = lambda k: int(m.f[k, 0]) | int(m.f[k, 1]) << 64
    want = set()
    for a in range(80):
        for b in range(80):
            x = value(a) ^ value(b)
            if m.home[a] and m.ids[a] < m.ids[b] and x.bit_count() <= 36 and (x & 0xFFFF).bit_count() <= 1 and min(m.sizes[a], m.sizes[b]) >= 0.8 * max(m.sizes[a], m.sizes[b]):
                want.add((int(m.ids[a]), int(m.ids[b])))
    assert got == want and want


def test_repeats_nulls_and_no_rows(spark):
    text = "same words here now again and some more of them"
    rows = [(7, text), (7, text), (8, text), (None, text), (7, "quite another text under the same number"), (9, None), (3, ""), (None, " ")]
    assert run(spark, rows) == [3, 7, 7]
    assert run(spark, [(None, text), (None, text)]) == [None]
    assert neardup.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_fingerprints_are_no_link_by_themselves():
    assert not neardup.similar(np.arange(10, dtype="<u4"), np.arange(5, 20, dtype="<u4"), 0.8)
    assert neardup.similar(np.arange(8, dtype="<u4"), np.arange(10, dtype="<u4"), 0.8)
    assert neardup.similar(np.zeros(0, "<u4"), np.zeros(0, "<u4"), 0.8)


def test_sketches_drop_no_similar_sets_and_most_others():
    rng = np.random.default_rng(11)
    dropped = []
    for _ in range(1500):
        n = int(rng.integers(1, 3000))
        a = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        edits = int(n * rng.uniform(0, 0.3))
        a, b = np.unique(a), np.unique(np.concatenate([a[edits:], rng.integers(0, 2**32, rng.integers(0, edits + 1), dtype=np.uint64).astype("<u4")]))
        other = np.unique(rng.integers(0, 2**32, len(a), dtype=np.uint64).astype("<u4"))
        assert neardup.differ(neardup.sketch(a), neardup.sketch(b)) <= len(np.setxor1d(a, b))
        dropped.append(neardup.differ(neardup.sketch(a), neardup.sketch(other)) > (len(a) + len(other)) / 9)
    assert np.mean(dropped) > 0.98


def test_a_group_of_near_copies_tells_few_links_a_member():
    """Of a thick anchor each home tells its closest; a member is home at eight anchors, though it comes to 69."""
    rng = np.random.default_rng(13)
    n = 400
    f = np.repeat(rng.integers(0, 2**64, (1, 2), dtype=np.uint64), n, axis=0)
    for _ in range(12):
        f[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    ids, sizes, rows = rng.permutation(n), rng.integers(95, 105, n), 0
    for block in range(neardup.BLOCKS):
        who, anchors = neardup.covering().near(neardup.lanes(f)[:, block].astype(np.uint64))
        for anchor in np.unique(anchors):
            at = who[anchors == anchor]
            m = neardup.Members.of(int(anchor) | block << neardup.WIDTH, ids[at], f[at], sizes[at])
            if sum(len(i) for i, _, _ in m.links(block, 0.8)) > neardup.THICK * len(at):
                told, linked = m.told(block, 0.8)
                rows += sum(len(a) for a, _ in told) + len(linked)
    assert 0 < rows <= 2 * neardup.BLOCKS * n


def test_texts_that_stay_are_not_moved(spark):
    """With joins too large to be broadcast, as at size."""
    rng = random.Random(17)
    rows = [(d, "".join(rng.choice("abcdefgh ") for _ in range(4000))) for d in range(300)]
    rows += [(1000 + d, rows[d][1]) for d in range(9)] + [rows[0]] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neardup.keep_one(docs)
        last = max(written())
        assert sorted(r.doc_id for r in got.select("doc_id", "text").collect()) == list(range(300))
        moved = sum(n for k, n in written().items() if k > last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < moved < 300 * 4000 / 4
