"""Quality classifier: a label model over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, prepare, table, utf8

GOOD, BAD, ABSTAIN = 0, 1, 2
#: Documents the scorer learns from at most: the bound of its training sample.
TRAIN_DOCUMENTS = 2000
#: Buckets of words and of their shapes.
WORDS, SHAPES = 1 << 12, 1 << 10
#: The bucket of a word that follows itself, in place of its shape.
AGAIN = SHAPES - 1
#: Words whose buckets a worker remembers.
CACHE = 500_000
#: Words of a stretch whose distinct words are counted.
STRETCH = 64

_KIND = np.zeros(256, np.int8)  # 0: other, 1: lower, 2: upper, 3: digit, 4: space, 5: mark
_KIND[128:] = 1
for _c in range(128):
    _KIND[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 4 if chr(_c).isspace() else 5
_KINDS = np.eye(6, dtype=np.int64)[_KIND]
_LETTERLESS = re.compile(rb"(?<!\S)[^\sA-Za-z\x80-\xff]+(?!\S)")
_SENTENCE = re.compile(rb"[.!?](?=\s|$)")
_SHAPE = bytes(ord("a") if k == 1 else ord("A") if k == 2 else ord("0") if k == 3 else c for c, k in enumerate(_KIND.tolist()))
_ODD = b"|#$%&*<>{}[]=_^~\\@"
_RUN = re.compile(rb"(.)\1+", re.S)


def _between(x: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    return BAD if x < bad_below or x > bad_above else GOOD if good_from <= x <= good_to else ABSTAIN


def votes(text: bytes) -> tuple[int, ...]:
    """What each labeller says of a text: good, bad or nothing; nothing of a text without a word.

    Thresholds are shares of the whole text. Shares of few words are drawn towards a neutral value by
    some words that are added, so one rule holds for texts of any length.
    """
    words = text.split()
    n = len(words)
    if not n:
        return (ABSTAIN,) * len(LABELLERS)
    _, lower, upper, digit, _, mark = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS).tolist()
    solid, letters = lower + upper + digit + mark, max(1, lower + upper)
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(map(eq, words, words[1:]))
    short = sum(len(w) <= 4 for w in words)
    odd = len(text) - len(text.translate(None, _ODD)) + text.count(b"!!") + text.count(b"??")
    distinct = sum(len(set(words[i : i + STRETCH])) for i in range(0, n, STRETCH))
    return (
        _between(mark / solid, 0, 0, 0.08, 0.14),
        _between(upper / letters, 0, 0, 0.15, 0.4),
        _between(len(_LETTERLESS.findall(text)) / n, 0, 0, 0.05, 0.15),
        _between(odd / n, 0, 0, 0.05, 0.15),
        _between((len(_SENTENCE.findall(text)) + 0.25) / (n + 15), 0.008, 0.03, 0.5, 0.8),
        _between((short + 2) / (n + 10), 0.1, 0.22, 0.9, 0.97),
        _between(again / (n + 5), 0, 0, 0.03, 0.1),
        _between((len(set(lines)) + 2) / (len(lines) + 2), 0.6, 0.8, 1, 1),
        _between(distinct / n, 0.3, 0.5, 1, 1),
    )


#: What the labellers look at, in the order of their votes.
LABELLERS = ("marks", "capitals", "words without letters", "odd marks", "sentence ends", "short words", "words said again", "repeated lines", "distinct words")


@dataclass
class LabelModel:
    """Share of good documents and, by class, labeller and vote, the probability of the vote if there is one."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes (rows) are good."""
        logs = np.log(self.table[:, :, GOOD]) @ (patterns == GOOD).T + np.log(self.table[:, :, BAD]) @ (patterns == BAD).T
        logs += np.log([[self.prior], [1 - self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct patterns of votes and how many documents have each.

    A document is good or bad; given that, labellers that say something vote independently, each
    right with its own probability for either class; silence tells nothing. The start takes every
    labeller to be right more often than not. Without any document the prior stays near one half.
    """
    k = patterns.shape[1]
    model = LabelModel(0.5, np.stack([np.tile([0.9, 0.1], (k, 1)), np.tile([0.4, 0.6], (k, 1))]))
    said = np.stack([patterns == GOOD, patterns == BAD], axis=2).astype(float)
    for _ in range(rounds):
        good = model.posterior(patterns)
        new = []
        for p in (good, 1 - good):
            seen = np.einsum("i,ikv->kv", p * counts, said) + 0.5
            new.append(seen / seen.sum(axis=1, keepdims=True))
        prior = float(np.clip((good * counts).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3))
        moved = abs(prior - model.prior) + np.abs(np.stack(new) - model.table).max()
        model = LabelModel(prior, np.stack(new))
        if moved < 1e-7:
            break
    return model


class Buckets:
    """The buckets of words: one of the lower-cased word, one of its shape (runs collapsed) or of being said again."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        words = text.split()
        for w in set(words).difference(known):
            shape = _RUN.sub(rb"\1", w.translate(_SHAPE))
            known[w] = zlib.crc32(w.lower()) % WORDS << 16 | zlib.crc32(shape) % AGAIN
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        again = np.flatnonzero(out[1:] == out[:-1]) + 1
        out[again] = out[again] >> 16 << 16 | AGAIN
        return out


_buckets = Buckets()


@dataclass
class Scorer:
    """A linear scorer of the shares of hashed words and shapes in a text."""

    words: np.ndarray
    shapes: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        """The probability that a text of these buckets is good; 0 without any."""
        if not len(buckets):
            return 0.0
        z = self.bias + float(self.words[buckets >> 16].mean() + self.shapes[buckets & 0xFFFF].mean())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def shares(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, share) of the buckets that a text has: those of words first, then those of shapes."""
    both = np.concatenate([buckets >> 16, (buckets & 0xFFFF) + WORDS])
    at, count = np.unique(both, return_counts=True)
    return at.astype("<u2"), (count / max(1, len(buckets))).astype("<f4")


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Scorer:
    """Logistic regression of posterior labels on ``shares``, by Adam over all rows; classes weigh alike."""
    x = np.zeros((len(rows), WORDS + SHAPES), np.float32)
    for i, (at, share) in enumerate(rows):
        x[i, at] = share
    x = np.hstack([x, np.ones((len(rows), 1), np.float32)])
    weight = target / max(target.sum(), 1e-6) + (1 - target) / max((1 - target).sum(), 1e-6)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    target, weight = target.astype(np.float32), weight.astype(np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ ((p - target) * weight) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Scorer(w[:WORDS].astype(np.float32), w[WORDS:-1].astype(np.float32), float(w[-1]))


def label_documents(docs: DataFrame) -> LabelModel:
    """The label model of all of ``docs``: votes are counted by pattern before they are moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(["".join(map(str, votes(t or b""))) for t in utf8(b.column(0))], pa.string())})

    # At most one row for each pattern of votes, 3 ** 9 of them.
    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "pattern string").groupBy("pattern").count().orderBy("pattern").collect()
    patterns = np.array([[int(c) for c in r.pattern] for r in rows], np.int64).reshape(-1, len(LABELLERS))
    return fit_labels(patterns, np.array([r["count"] for r in rows], float))


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Scorer:
    """The scorer of ``docs`` (doc_id, text), from the posterior labels of at most ``documents`` rows."""
    prepare(docs.sparkSession)
    model = label_documents(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in utf8(b.column(1))]
            own = [shares(_buckets(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(map(str, votes(t))) for t in texts], pa.string()), *(pa.array([x[k].tobytes() for x in own], pa.binary()) for k in (0, 1))], names=["h", "pattern", "at", "share"])

    sample = bounded_sample(docs.where(F.length("text") > 0), documents, "doc_id").select("h", F.col("text").cast("string"))
    # At most ``documents`` rows of WORDS + SHAPES shares, however long the texts are.
    rows = sample.mapInArrow(read, "h long, pattern string, at binary, share binary").orderBy("h", "at", "share").limit(documents).collect()
    if not rows:
        return Scorer(np.zeros(WORDS, np.float32), np.zeros(SHAPES, np.float32), 0.0)
    target = model.posterior(np.array([[int(c) for c in r.pattern] for r in rows]))
    return fit_scorer([(np.frombuffer(bytes(r["at"]), "<u2"), np.frombuffer(bytes(r["share"]), "<f4")) for r in rows], target)


def score_documents(docs: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) of each row of ``docs`` (doc_id, text), whole texts read.

    ``keep`` is whether the score is ``least`` or more. Null texts and texts without a word score 0.
    A map over rows: repeated rows stay, other columns are ignored, no rows give none.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([scorer.score(_buckets(t or b"")) for t in utf8(b.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(scores >= least)], names=["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, keep boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs))
