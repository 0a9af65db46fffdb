import random
import zlib

import numpy as np
import pytest

from tessera.llm import birnn, langid

WORDS = {"aa": ["zu", "ung", "der", "schön"], "bb": ["the", "ing", "was", "of"], "cc": ["les", "été", "que", "ñ"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(20, 120))), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = birnn.ByteTagger(3, 4, seed=1)
    for p in net.parameters():
        p[...] = p * 0.7
    x, y, w = rng.integers(0, 5, (6, 7)).astype(np.uint8), rng.integers(0, 3, 7), rng.random((6, 7)).astype(np.float32)
    _, grads = net.gradients(x, y, w)
    for p, g in zip(net.parameters(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, min(s, 5)) for s in p.shape)
            was, eps = p[at], 1e-2
            p[at] = was + eps
            up, _ = net.gradients(x, y, w)
            p[at] = was - eps
            down, _ = net.gradients(x, y, w)
            p[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_fast_run_agrees_with_the_training_pass():
    net = birnn.ByteTagger(3, 4, seed=1)
    x = np.random.default_rng(0).integers(0, 256, (9, 5)).astype(np.uint8)
    hl, _ = net.left.forward(x)
    hr, _ = net.right.forward(x[::-1])
    logits = net.weight @ np.concatenate([hl[1:], hr[:0:-1]], axis=1) + net.bias
    p = np.exp(logits)
    assert np.allclose(net.probabilities(x), p / p.sum(axis=1, keepdims=True), atol=1e-5)


def direct(net, text):
    """The mean over bytes of the label probabilities: gates, states and output, byte by byte, of each segment and what is around it."""
    f = lambda v: 1 / (1 + np.exp(-2 * v))

    def states(d, row):
        k, h, out = d.hidden, np.zeros(d.hidden), []
        for byte in row:
            g, a = d.table[:, byte].astype(float), d.rec.astype(float) @ h
            r, z = f(g[:k] + a[:k]), f(g[k : 2 * k] + a[k : 2 * k])
            new = np.tanh(g[2 * k :] + r * a[2 * k :])
            h = new + z * (h - new)
            out.append(h)
        return out

    total = np.zeros(len(net.bias))
    for at in range(0, len(text), 128):
        low = max(0, at - 32)
        row = text[low : at + 160].ljust(192, b"\0")
        left, right = states(net.left, row), states(net.right, row[::-1])[::-1]
        for i in range(at - low, at - low + min(128, len(text) - at)):
            e = np.exp(net.weight.astype(float) @ np.concatenate([left[i], right[i]]) + net.bias[:, 0])
            total += e / e.sum()
    return total / len(text)


def test_pooled_probabilities_against_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 3)
    model = langid.LanguageModel(("aa", "bb", "cc"), birnn.ByteTagger(3, 4, seed=6))
    texts = [rng.encode() for rng in ("a", "schön " * 60, "x" * 128, "été que " * 33, "of")]
    got = langid.pooled(model, texts)
    assert np.allclose(got, [direct(model.net, t) for t in texts], atol=1e-5)


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus() + [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, "zu ung der " * 20000, None), (904, "½ ²", "bb"), (None, "the was of ing the was of ing", None), (5, "x", "aa"), (5, "x", "aa")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902, 904)] == [("und", 0.0)] * 4
    assert by[903].lang_pred == "aa" and by[None].lang_pred == "bb"
    held = [(by[i].lang_pred, lang) for i, _, lang in corpus() if by[i].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).collect() == []


def test_accuracy_on_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.op9_language_id(spark, sf).collect() if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
