"""Benchmark decontamination: rare n-gram seeds joined to test items, then Smith-Waterman alignment.

1. Each item is cut into word n-grams. A Bloom filter of fixed size tells which n-grams of a document
   may be an item's, and these are counted, in how many documents each, before anything is moved.
2. An item's rare n-grams are its seeds. Documents send the seeds they hold, again behind a filter of
   fixed size, and the seeds join the items'.
3. Each document and item that share a seed are aligned around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, prepare, release, settle, table

#: Words of a seed, and the least share of an item's words that an alignment must be worth.
SEED_WORDS, THRESHOLD = 3, 0.6
#: An n-gram is rare in this share of the documents at most, or in so many. Of an item that is copied
#: more often, those are seeds that are at most this many times as frequent as its median n-gram.
RARE_SHARE, RARE_DOCUMENTS, OF_MEDIAN = 0.001, 50, 2
#: Scores of a word that matches, of one that does not, and of one left out on either side.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a filter, whatever the benchmark, bits of one page of it, and bits set for an n-gram.
FILTER_BITS, PAGE_BITS, PROBES = 1 << 25, 1 << 15, 4
#: Bytes that are hashed at once, n-grams that a task counts before it passes the counts on.
STRETCH, COUNTED = 1 << 16, 1_000_000

_MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs without white space and ASCII marks."""
    return (text or "").lower().encode().translate(_MARKS).split()


@lru_cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, the powers of an odd one, and of its inverse modulo 2 ** 64."""
    byte = np.random.default_rng(42).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
    ones = np.ones(STRETCH, np.uint64)
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    return byte, *(np.cumprod(np.concatenate([ones[:1], ones[1:] * np.uint64(x)])) for x in (base, inverse))


def _hashed(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each run of ``raw`` between spaces: differences of the prefix sums of one polynomial."""
    byte, power, inverse = _powers()
    text = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[0], (text != 32).view(np.int8), [0]])
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if (stop - start).max(initial=0) >= STRETCH - 1:  # no other word is in this stretch
        return np.array([xxhash.xxh64_intdigest(raw[a:z]) for a, z in zip(start.tolist(), stop.tolist())], np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[text] * power[: len(text)])])
    return (sums[stop] - sums[start]) * inverse[start]


def read(text: str | None) -> np.ndarray:
    """The :func:`words` of a text as 64-bit hashes, a stretch of whole words at a time; words of about ``STRETCH`` bytes and over by XXH64."""
    raw, out, i = (text or "").lower().encode().translate(_MARKS), [np.zeros(0, np.uint64)], 0
    while i < len(raw):
        j = len(raw)
        if j - i > STRETCH:
            j = raw.rfind(b" ", i, i + STRETCH)
            if j <= i:
                j = raw.find(b" ", i + 1)
                j = len(raw) if j < 0 else j
        out.append(_hashed(raw[i:j]))
        i = j
    return np.concatenate(out)


def codes(t: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """The code of the n-gram at each place of a text that has one."""
    out = np.zeros(max(0, len(t) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + t[k : k + len(out)]
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, where it ends in ``b``) by Smith and Waterman, a row at a time."""
    j = np.arange(len(b) + 1) * -GAP
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + j) - j
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def align_around(a: np.ndarray, t: np.ndarray, starts: list[int], threshold: float) -> tuple[float, int] | None:
    """(score, end) of item ``a`` in text ``t`` around seeds that put its start at ``starts``; None below ``threshold``.

    A gap costs half a match, so an alignment strays from its seed by no more than twice the item.
    Before, words are counted: a stretch that holds too few of the item's words cannot reach the
    threshold, so nothing is lost.
    """
    reach = 2 * len(a)
    starts = sorted(set(starts))
    best, i = (0, 0), 0
    while i < len(starts):
        low, high = starts[i] - reach, starts[i] + len(a) + reach
        while i < len(starts) and starts[i] - reach <= high:
            high = starts[i] + len(a) + reach
            i += 1
        low = max(low, 0)
        b = t[low:high]
        if np.isin(a, b).sum() >= threshold * len(a):
            score, end = align(a, b)
            best = max(best, (score, low + end))
    return (best[0] / (MATCH * len(a)), best[1]) if best[0] >= threshold * MATCH * len(a) else None


class Filter:
    """A Bloom filter of 64-bit codes; its size does not grow with what it holds."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(code: np.ndarray) -> np.ndarray:
        """(PROBES, n): the bits of each code."""
        step = code >> np.uint64(32) | np.uint64(1)
        return (code + np.arange(PROBES, dtype=np.uint64)[:, None] * step) % np.uint64(FILTER_BITS)

    @classmethod
    def build(cls, held: DataFrame) -> Filter:
        """Of the column ``code``; the driver gets one page for each ``PAGE_BITS`` bits, no more."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(cls.places(b.column(0).to_numpy().view(np.uint64))).astype(np.int64))], names=["bit"])

        def page(key: tuple, t: pa.Table) -> pa.Table:
            bits = np.zeros(PAGE_BITS, np.uint8)
            bits[t["bit"].to_numpy() % PAGE_BITS] = 1
            return pa.table({"page": [key[0].as_py()], "data": [np.packbits(bits, bitorder="little").tobytes()]})

        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        pages = held.select("code").mapInArrow(spread, "bit long").distinct().withColumn("page", F.expr(f"bit div {PAGE_BITS}"))
        for r in pages.groupBy("page").applyInArrow(page, "page long, data binary").collect():
            bits[r.page * PAGE_BITS // 8 : (r.page + 1) * PAGE_BITS // 8] = np.frombuffer(bytes(r.data), np.uint8)
        return cls(bits)

    def may_hold(self, code: np.ndarray) -> np.ndarray:
        """Marks the codes that may be held; all that are held are marked."""
        out = np.zeros(len(code), bool)
        left = np.flatnonzero(self._set(code % np.uint64(FILTER_BITS)))
        out[left] = self._set(self.places(code[left])).all(axis=0)
        return out

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _numbers() -> Iterator[int]:
    """Numbers for the rows of this task, apart from those of other tasks."""
    n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    while True:
        yield n
        n += 1


def cut_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens, codes) of the items of at least SEED_WORDS words; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers()
        for b in batches:
            cut = [(i, read(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cut = [(next(numbers), i, t.view(np.int64), codes(t).view(np.int64)) for i, t in cut if len(t) >= SEED_WORDS]
            columns = list(zip(*cut)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "item_id", "tokens", "codes"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item long, item_id long, tokens array<long>, codes array<long>")


def frequencies(docs: DataFrame, held: Filter) -> DataFrame:
    """(code, docs): in how many rows of ``docs`` (text) an n-gram is, of those that ``held`` may hold. Summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def sums() -> pa.RecordBatch:
            code, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(count)], names=["code", "docs"])

        for b in batches:
            for text in b.column(0).to_pylist():
                found = codes(read(text))
                parts.append(np.unique(found[held.may_hold(found)]))
                n += len(parts[-1])
            if n > COUNTED:
                yield sums()
                parts, n = [], 0
        yield sums()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))


def pick_seeds(grams: DataFrame, counts: DataFrame, documents: int, most_grams: int | None = None) -> DataFrame:
    """(item, place, code) of ``grams`` that seed a search: the rare ones, and of each item those near its median or below.

    Only n-grams that occur in the corpus count. ``most_grams`` is the number of ``grams``.
    """
    found = settle(grams.join(counts, "code"), "found", most_grams)
    most = F.greatest(OF_MEDIAN * F.median("docs"), F.lit(RARE_SHARE * documents), F.lit(float(RARE_DOCUMENTS)))
    return found.join(found.groupBy("item").agg(most.alias("most")), "item").where("docs <= most").select("item", "place", "code")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, end_word): each document and item that align well enough.

    The score is that of the best local alignment of words over that of a full match; ``end_word`` is
    where it ends. Seeds are n-grams of three words that few documents of ``docs`` hold, or, of an
    item that was copied often, those that are not far more frequent than most of it. Null and empty
    texts match nothing; nor do items of fewer than three words, which have no n-gram. Repeated rows
    and items give a row each. Other columns are ignored. Two passes over the documents, whatever the
    size of the benchmark; texts move only of documents that hold a seed.
    """
    return _aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, threshold).select("doc_id", "item_id", "score", "end_word")


def _aligned(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """As of :func:`contaminated`, with ``code``, the XXH64 of the document's text."""
    prepare(docs.sparkSession)
    items = settle(cut_items(benchmark), "items")
    grams = items.select("item", F.posexplode("codes").alias("place", "code"))
    counts = frequencies(docs, Filter.build(grams))
    n = items.select(F.sum(F.size("codes"))).first()[0] or 0
    seeds = settle(pick_seeds(grams, counts, docs.count(), n), "seeds", n)
    rare = Filter.build(seeds)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = codes(read(text))
                at = np.flatnonzero(rare.may_hold(found))
                if len(at):
                    out.append((next(numbers), doc_id, text, at, found[at].view(np.int64)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "doc_id", "text", "at", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, code, text, item_id, tokens, starts in zip(*(c.to_pylist() for c in b.columns)):
                found = align_around(np.array(tokens, np.int64).view(np.uint64), read(text), starts, threshold)
                if found:
                    out.append((doc_id, code, item_id, *found))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "code", "item_id", "score", "end_word"])

    holding = settle(docs.select("doc_id", "text").mapInArrow(hold, "row long, doc_id long, text string, at array<long>, codes array<long>"), "holding")
    hits = holding.select("row", F.explode(F.arrays_zip("at", "codes")).alias("z")).select("row", F.col("z.at").alias("at"), F.col("z.codes").alias("code"))
    met = hits.join(seeds, "code").groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
    pairs = met.join(holding.select("row", "doc_id", "text"), "row").join(items.select("item", "item_id", "tokens"), "item")
    pairs = pairs.select("doc_id", F.xxhash64("text").alias("code"), "text", "item_id", "tokens", "starts")
    out = settle(pairs.mapInArrow(run, "doc_id long, code long, item_id long, score double, end_word long"), "aligned")
    release(items, seeds, holding)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that align with an item, as :func:`contaminated` finds them.

    Columns are those of ``docs``, whatever their names; null doc_ids and texts stay as they are.
    """
    key, code = fresh(docs, "key"), fresh(docs, "code")
    own = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(code, F.xxhash64(F.col("text").cast("string")))
    found = _aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, threshold).select("doc_id", "code").distinct()
    return own.join(found, own[key].eqNullSafe(found["doc_id"]) & (own[code] == found["code"]), "left_anti").select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
