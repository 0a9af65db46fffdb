import random

import numpy as np
import pytest

from tessera.llm import decontam

VOCABULARY = [f"w{i}" for i in range(400)]


def brute_align(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_alignment_is_smith_watermans(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(-1, 6, rng.integers(0, 60))
    assert decontam.align(a, b)[0] == brute_align(a, b)


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "ab", "ba", "été", "x,y", "Long" * 9, "z" * 300]) for _ in range(rng.randrange(400))) for _ in range(30)]
    seen = {}
    for stretch in (1 << 16, 64):
        monkeypatch.setattr(decontam, "STRETCH", stretch)
        decontam._powers.cache_clear()
        for t in texts:
            own, hashes = decontam.words(t), decontam.read(t).tolist()
            assert len(own) == len(hashes)
            for w, h in zip(own, hashes):
                assert seen.setdefault((w, stretch if len(w) >= 63 else 0), h) == h
    decontam._powers.cache_clear()
    short = {w: h for (w, _), h in seen.items()}
    assert len(set(short.values())) == len(short) and len(decontam.read(None)) == len(decontam.read(" ,.")) == 0


def corpus():
    rng = random.Random(4)
    text = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(i, text(rng.randrange(12, 40))) for i in range(12)]
    docs, want = [], set()

    def edited(words, share):
        out = []
        for w in words:
            x = rng.random()
            out += [] if x < share / 3 else [w, rng.choice(VOCABULARY)] if x < 2 * share / 3 else [rng.choice(VOCABULARY)] if x < share else [w]
        return out

    for d in range(120):
        words = text(rng.randrange(30, 200))
        if d % 3 == 0:
            i, item = items[d % len(items)]
            at = rng.randrange(len(words))
            words[at:at] = edited(item, [0, 0.1, 0.2][d // 3 % 3])
            want.add((d, i))
        docs.append((d, (", ".join(words[:20]).upper() + "\n" + " ".join(words[20:]))))
    return [(i, " ".join(t)) for i, t in items], docs, want


def test_copies_and_edits_are_found_and_others_left(spark):
    items, docs, want = corpus()
    docs += [(500, None), (501, ""), (502, "w1 " * 30000), (None, items[3][1]), (0, docs[0][1])]
    items += [(90, None), (91, ""), (92, "w1 w2"), (93, items[5][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(d, b).collect()
    tokens = {i: decontam.words(t) for i, t in items if len(decontam.words(t)) >= 3}
    brute = sorted(((x, i, round(brute_align(a, w) / 2 / len(a), 9)) for x, t in docs if x != 502 and t for w in [decontam.words(t)] for i, a in tokens.items() if set(a) & set(w) and brute_align(a, w) >= 1.2 * len(a)), key=str)
    assert sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in got), key=str) == brute
    assert want <= {(r.doc_id, r.item_id) for r in got}
    left = decontam.decontaminate(d, b)
    assert left.columns == d.columns
    hit = {r.doc_id for r in got}
    assert sorted(r.doc_id for r in left.collect()) == sorted(x for x, _ in docs if x not in hit)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    items, docs, _ = corpus()
    d, b = spark.createDataFrame(docs[:40], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(d, b).collect()))
    full = decontam.Filter(np.full(decontam.FILTER_BITS // 8, 255, np.uint8))
    monkeypatch.setattr(decontam.Filter, "build", classmethod(lambda cls, held: full))
    monkeypatch.setattr(decontam, "COUNTED", 50)
    assert sorted(map(tuple, decontam.contaminated(d, b).collect())) == whole


def test_the_filter_holds_what_it_is_given(spark):
    rng = np.random.default_rng(2)
    held, others = rng.integers(-(2**63), 2**63, 3000), rng.integers(-(2**63), 2**63, 3000)
    f = decontam.Filter.build(spark.createDataFrame([(int(x),) for x in held], "code long"))
    assert f.may_hold(held.view(np.uint64)).all() and f.may_hold(others.view(np.uint64)).mean() < 0.01


def test_an_item_copied_everywhere_is_found(spark):
    items, _, _ = corpus()
    d = spark.createDataFrame([(i, items[0][1]) for i in range(200)], "doc_id long, text string")
    assert decontam.contaminated(d, spark.createDataFrame(items[:1], "item_id long, text string")).count() == 200


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert decontam.contaminated(d.limit(0), b).collect() == [] and decontam.contaminated(d, b.limit(0)).collect() == []
    assert decontam.decontaminate(d, b.limit(0)).collect() == d.collect()
