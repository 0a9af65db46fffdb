import random
import zlib

import numpy as np
import pytest

from tessera.llm import quality


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.8
    right = np.array([0.95, 0.85, 0.7, 0.9, 0.8])
    said = np.where(rng.random((6000, 5)) < right, truth[:, None], ~truth[:, None])
    votes = np.where(rng.random((6000, 5)) < 0.3, quality.ABSTAIN, np.where(said, quality.GOOD, quality.BAD))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    assert model.table[0, :, quality.GOOD] == pytest.approx(right, abs=0.04)
    assert model.table[1, :, quality.BAD] == pytest.approx(right, abs=0.06)
    better = np.mean((model.posterior(votes) >= 0.5) == truth)
    majority = np.mean(((votes == quality.GOOD).sum(axis=1) >= (votes == quality.BAD).sum(axis=1)) == truth)
    assert better > majority


def test_label_model_against_brute_force():
    """Expectation and maximisation written out, document by document."""
    rng = np.random.default_rng(8)
    rows = [tuple(r) for r in rng.integers(0, 3, (60, 3)).tolist()]
    prior, table = 0.5, {(g, k, v): (0.9 if v == 0 else 0.1) if g else (0.4 if v == 0 else 0.6) for g in (0, 1) for k in range(3) for v in (0, 1)}
    for _ in range(40):
        good = []
        for r in rows:
            like = [1.0, 1.0]
            for g in (0, 1):
                for k, v in enumerate(r):
                    like[g] *= table[g, k, v] if v != quality.ABSTAIN else 1
            good.append(prior * like[1] / (prior * like[1] + (1 - prior) * like[0]))
        for g in (0, 1):
            for k in range(3):
                seen = [0.5 + sum(p if g else 1 - p for p, r in zip(good, rows) if r[k] == v) for v in (0, 1)]
                for v in (0, 1):
                    table[g, k, v] = seen[v] / sum(seen)
        prior = sum(good) / len(rows)
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float), rounds=40)
    assert model.prior == pytest.approx(prior, abs=1e-4)
    assert all(model.table[1 - g, k, v] == pytest.approx(table[g, k, v], abs=1e-4) for g, k, v in table)


def test_scorer_against_brute_force(spark):
    """Scores of whole texts, word by word."""
    rng = np.random.default_rng(3)
    scorer = quality.Scorer(rng.normal(size=quality.WORDS).astype(np.float32), rng.normal(size=quality.SHAPES).astype(np.float32), 0.25)
    texts = ["One one one TWO2!! été", None, "", "  \n", "a b  b\nc " * 3000]

    def shape(w):
        kinds = ["a" if c >= 128 or chr(c).islower() else "A" if chr(c).isupper() else "0" if chr(c).isdigit() else chr(c) for c in w]
        return "".join(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1])

    def direct(text):
        words = (text or "").encode().split()
        if not words:
            return 0.0
        z = 0.25
        for i, w in enumerate(words):
            again = i and words[i - 1] == w and (zlib.crc32(w.lower()) % 4096) == (zlib.crc32(words[i - 1].lower()) % 4096)
            z += (scorer.words[zlib.crc32(w.lower()) % 4096] + scorer.shapes[1023 if again else zlib.crc32(shape(w).encode()) % 1023]) / len(words)
        return 1 / (1 + np.exp(-z))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_documents(docs, scorer).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([direct(t) for t in texts], abs=1e-4)


def test_rules_do_not_depend_on_length():
    """A long text of the same stuff gets the votes of a shorter one, or more of them."""
    stuff = "Der Hund lief heute in den Wald und kam nicht mehr nach Hause, sagte man. Viele suchten ihn dort noch lange.\n"
    other = "".join(c if c not in "aeiou" else "aeiou"["uoiea".index(c)] for c in stuff)
    short, long = quality.votes((stuff + other).encode()), quality.votes(((stuff + other) * 50).encode())
    assert all(a == b for k, (a, b) in enumerate(zip(short, long)) if quality.ABSTAIN not in (a, b) and quality.LABELLERS[k] != "repeated lines")
    for n in (40, 4000):
        words = " ".join(f"wort{i % 37 * 7}{'.' if i % 11 == 0 else ''}" for i in range(n))
        assert quality.votes(words.encode())[4] == quality.GOOD and quality.votes(words.encode())[8] == quality.GOOD


def test_without_documents():
    model = quality.fit_labels(np.zeros((0, len(quality.LABELLERS)), np.int64), np.zeros(0))
    assert 0 <= model.posterior(np.full((1, len(quality.LABELLERS)), quality.ABSTAIN))[0] <= 1


def corpus(n=300):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["on", "the", "ra", "lé", "in", "a"]) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 300))]
        kind = i % 10
        text = " ".join(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))
        if kind == 0:
            text = " | ".join(words)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 2:
            text = " ".join(w + "$$$" for w in words)
        out.append((i, text, kind > 2))
    return out


def test_junk_goes_and_prose_stays(spark):
    rows = corpus()
    odd = [(900, None), (901, ""), (902, " \n"), (903, "the on ra in. " * 30000), (None, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(*o, 1.0) for o in odd], "doc_id long, text string, score double")
    got = quality.score_documents(docs, quality.train(docs)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.keep for r in got}
    assert np.mean([by[i] == good for i, _, good in rows]) > 0.98
    assert all(by[i] for i, _, good in rows if good)
    assert [by[i] for i in (900, 901, 902, None)] == [False, False, False, True]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score_documents(docs, quality.train(docs)).collect() == []
    blank = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [r.score for r in quality.score_documents(blank, quality.train(blank)).collect()] == [0.0]


def test_agrees_with_the_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(r.keep, labels[r.doc_id] == 1) for r in quality.op3_quality(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels]
    assert np.mean([a == b for a, b in got]) > 0.9
    assert np.mean([a for a, b in got if b]) > 0.97
    assert docs.count() == 1000
