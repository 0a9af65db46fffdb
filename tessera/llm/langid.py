"""Language identification by a bidirectional recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.birnn import ByteTagger
from tessera.llm.common import bounded_sample, prepare, table

#: Bytes of a segment that are labelled, and bytes around it that the network reads too. Every byte of a text is labelled.
SEGMENT, CONTEXT = 128, 32
SPAN = SEGMENT + 2 * CONTEXT
#: Documents the network learns from at most: the bound of the training sample. Their texts are read whole.
TRAIN_DOCUMENTS = 1500
HIDDEN, STEPS = 8, 200
#: Segments that run through the network together.
TOGETHER = 2048
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: tuple[str, ...]
    net: ByteTagger | None


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang): rows not held out, with text and lang.

    The sample is the ``documents`` rows that come first by a hash of doc_id (ties: by lang and a
    hash of the text), so it is bounded at any size; it is read row by row, and of each text every
    segment with a letter is learned from. Positions are weighted so that each language counts
    alike. Without any such row nothing is learned, and every text is unknown.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = bounded_sample(usable, documents, "doc_id").orderBy("h", "lang", F.xxhash64("text")).limit(documents).select("text", "lang").collect()
    found = [(r["lang"], s) for r in rows for s in segments(r["text"].encode()) if has_letter(s[0].decode("utf-8", "ignore"))]
    languages = tuple(sorted({lang for lang, _ in found}))
    if not languages:
        return LanguageModel((), None)
    y = np.array([languages.index(lang) for lang, _ in found])
    x, weight = pack([s for _, s in found])
    weight *= (1 / np.bincount(y))[y]
    net = ByteTagger(len(languages), hidden, seed)
    net.fit(x, y, weight, steps, seed=seed)
    return LanguageModel(languages, net)


def segments(text: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes read, where the labelled ones start, their number) of the segments of a text, end to end."""
    for at in range(0, len(text), SEGMENT):
        low = max(0, at - CONTEXT)
        yield text[low : at + SEGMENT + CONTEXT], at - low, min(SEGMENT, len(text) - at)


def pack(held: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(SPAN, n) bytes, zeros after the end, and 1 where a byte is labelled."""
    joined = np.frombuffer(b"".join(s.ljust(SPAN, b"\0") for s, _, _ in held), np.uint8).reshape(-1, SPAN)
    first, n = (np.array([s[k] for s in held]) for k in (1, 2))
    at = np.arange(SPAN)[:, None]
    return np.ascontiguousarray(joined.T), ((at >= first) & (at < first + n)).astype(np.float32)


def pooled(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean of the probabilities of all positions of each text."""
    sums = np.zeros((len(texts), len(model.languages)))
    held, owner = [], []

    def flush() -> None:
        x, here = pack(held)
        p = model.net.probabilities(x)
        p *= here[:, None, :]
        np.add.at(sums, np.array(owner), p.sum(axis=0).T)
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for segment in segments(text):
            held.append(segment)
            owner.append(i)
            if len(held) == TOGETHER:
                flush()
    if held:
        flush()
    return sums / np.maximum([[len(t)] for t in texts], 1)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text), whole texts read.

    A null text, one without a letter, and any text where nothing was learned, is ``und`` with score
    0. The score is the pooled probability of the predicted language; ties go to the first by name.
    A map over rows: repeated rows stay, other columns are ignored, no rows give none.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if model.net is not None and has_letter(t)]
            p = pooled(model, [texts[i].encode() for i in known]) if known else np.zeros((0, 1))
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, row in zip(known, p):
                k = int(row.argmax())
                pred[i], score[i] = model.languages[k], min(1.0, float(row[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def keep_known(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, as they are."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if model.net is not None and has_letter(t)]
            keep = np.zeros(len(texts), bool)
            if known:
                keep[known] = pooled(model, [texts[i].encode() for i in known]).max(axis=1) >= least
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
