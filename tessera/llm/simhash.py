"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks. Of two fingerprints that differ in at most ``distance`` bits, some
block differs in at most ``distance // blocks`` bits. Each block's values are covered by a code (a
Hamming code on the first 15 bits, all values of the rest): every value lies within the covering
radius 1 of its own anchor. A fingerprint is sent to every anchor within radius plus threshold, so it
meets, at the anchor of any fingerprint close to it, that fingerprint; there the two are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, prepare, settle, table, utf8
from tessera.llm.graph import components

SEED = 42
HAMMING = 15
RADIUS = 1
#: Members of an anchor that one task compares; larger anchors are cut into squares of this side.
MEMBERS = 1 << 17
KEY_BITS = 40


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each run of ``k`` words (fewer: of all; none: empty), A-Z lower-cased, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if n <= k:
        return np.array([one(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter([one(line[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64, n - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where it is set in over half of ``hashes``."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number. Null and empty texts have 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t or b"", words)) for t in utf8(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Covering:
    """The anchors of one block of ``width`` bits: codewords of the code, and masks that lead to them."""

    def __init__(self, shift: int, width: int, threshold: int):
        self.shift, self.width = shift, width
        syndrome = np.zeros(1 << HAMMING, np.uint8)
        for bit in range(HAMMING):
            syndrome ^= np.where(np.arange(1 << HAMMING) >> bit & 1, bit + 1, 0).astype(np.uint8)
        self.syndrome = syndrome
        reach = RADIUS + threshold
        masks: list[list[int]] = [[] for _ in range(16)]
        for weight in range(min(reach, width) + 1):
            for bits in combinations(range(width), weight):
                mask = sum(1 << b for b in bits)
                masks[syndrome[mask & ((1 << HAMMING) - 1)]].append(mask)
        #: By syndrome: what turns a value into the codewords within reach of it.
        self.masks = [np.array(m, np.uint64) for m in masks]

    def values(self, fps: np.ndarray) -> np.ndarray:
        return fps >> np.uint64(self.shift) & np.uint64((1 << self.width) - 1)

    def homes(self, fps: np.ndarray) -> np.ndarray:
        """The anchor of each value: it, or it with the one bit flipped that its syndrome names."""
        v = self.values(fps)
        s = self.syndrome[v & np.uint64((1 << HAMMING) - 1)].astype(np.uint64)
        return np.where(s > 0, v ^ (np.uint64(1) << (np.maximum(s, 1) - np.uint64(1))), v)

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the fingerprint, anchor) of all anchors within radius plus threshold."""
        v = self.values(fps)
        s = self.syndrome[v & np.uint64((1 << HAMMING) - 1)]
        who, anchor = [], []
        for k, masks in enumerate(self.masks):
            at = np.flatnonzero(s == k)
            who.append(np.repeat(at, len(masks)))
            anchor.append((v[at, None] ^ masks[None, :]).reshape(-1))
        return np.concatenate(who), np.concatenate(anchor)


@lru_cache
def coverings(distance: int, blocks: int) -> tuple[Covering, ...]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    if min(b - a for a, b in zip(edges, edges[1:])) < HAMMING:
        raise ValueError(f"blocks must have {HAMMING} bits at least")
    return tuple(Covering(a, b - a, distance // blocks) for a, b in zip(edges, edges[1:]))


class Near:
    """Which fingerprints a home links to in a block: those within ``distance`` that no earlier block shows.

    Two fingerprints meet in every block in which they differ in no more than the threshold, at the
    home of either. The first such block tells of the pair, and of two homes the smaller value.
    """

    def __init__(self, distance: int, codes: tuple[Covering, ...], block: int):
        self.distance = distance
        self.earlier = [(np.uint64(((1 << c.width) - 1) << c.shift), distance // len(codes)) for c in codes[:block]]

    def __call__(self, x: np.ndarray, ys: np.ndarray) -> np.ndarray:
        return np.bitwise_count(ys ^ x) <= self.distance

    def first(self, x: np.ndarray, ys: np.ndarray) -> np.ndarray:
        out = np.ones(len(ys), bool)
        for mask, threshold in self.earlier:
            out &= np.bitwise_count((ys ^ x) & mask) > threshold
        return out

    def hits(self, x: np.uint64, ys: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self(x, ys))
        return at[self.first(x, ys[at])] if len(at) else at


def forest(homes: np.ndarray, others: np.ndarray, near: Near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links from ``homes`` to both arrays, as few as keep connected what is linked here.

    Homes are searched in their order. Within one search each member is linked once; a home that was
    reached is not searched for again, other members are, since another component may link to them.
    """
    out, left = [], homes
    while len(left):
        queue, left, rest = [left[0]], left[1:], others
        while queue:
            x = queue.pop()
            hit = near.hits(x, left)
            if len(hit):
                out.append((np.full(len(hit), x), left[hit]))
                queue.extend(left[hit])
                left = np.delete(left, hit)
            hit = near.hits(x, rest)
            hit = hit[rest[hit] > x]
            if len(hit):
                out.append((np.full(len(hit), x), rest[hit]))
                rest = np.delete(rest, hit)
    return out


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64)
    a, b = (np.concatenate([none, *(p[i] for p in pairs)]).view(np.int64) for i in (0, 1))
    return a, b


def _batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, members, whole) of rows sorted by key; a key of over MEMBERS rows comes in several parts."""
    key, held, n, parts = None, [], 0, 0
    for b in batches:
        keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        cut = np.flatnonzero(np.diff(keys)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
            if i == j:
                continue
            if keys[i] != key:
                if n:
                    yield key, np.concatenate(held), not parts
                key, held, n, parts = int(keys[i]), [], 0, 0
            held.append(fps[i:j])
            n += j - i
            if n > MEMBERS:
                yield key, np.concatenate(held), False
                held, n, parts = [], 0, parts + 1
    if n:
        yield key, np.concatenate(held), not parts


def links(fps: DataFrame, distance: int = 4, blocks: int = 3) -> DataFrame:
    """(a, b) of fingerprints that differ in at most ``distance`` bits, as few as keep them connected.

    ``fps`` holds distinct fingerprints in a column ``fp``. No pair within ``distance`` is missed in
    its connectivity. Anchors of over ``MEMBERS`` members are set aside, cut into squares and
    compared square by square, so no task holds more.
    """
    spark = prepare(fps.sparkSession)
    codes = coverings(distance, blocks)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for n, code in enumerate(codes):
                who, anchor = code.near(x)
                yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(n << KEY_BITS)).view(np.int64)), pa.array(x[who].view(np.int64))], names=["anchor", "fp"])

    def at_home(key: int, members: np.ndarray) -> np.ndarray:
        return codes[key >> KEY_BITS].homes(members) == np.uint64(key & ((1 << KEY_BITS) - 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for key, members, whole in _groups(batches):
            if not whole or len(members) > MEMBERS:
                yield _batch(1, np.full(len(members), key), members.view(np.int64))
                continue
            home = at_home(key, members)
            if home.any() and len(members) > 1:
                found = forest(members[home], members[~home], Near(distance, codes, key >> KEY_BITS))
                out += found
                n += sum(len(f[0]) for f in found)
                if n > 1 << 16:
                    yield _batch(0, *_edges(out))
                    out, n = [], 0
        if out:
            yield _batch(0, *_edges(out))

    spread = fps.select("fp").mapInArrow(replicate, "anchor long, fp long").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    first = settle(spread.mapInArrow(compare, "kind byte, a long, b long"), "links")
    large = first.where("kind = 1").select(F.col("a").alias("anchor"), F.col("b").alias("fp"))
    edges = first.where("kind = 0").select("a", "b")
    return edges if large.isEmpty() else edges.unionByName(_squares(large, at_home, distance, codes))


def _sides(members: DataFrame, most: int) -> DataFrame:
    """(anchor, i, j, fp, home): members cut into sides of about ``most``, every two sides together.

    Rows of side i are at home in (i, j); those of j are not. Of (i, i) rows are there once.
    """
    sides = members.groupBy("anchor").agg((F.floor(F.count("*") / F.lit(most)) + 1).cast("int").alias("sides"))
    own = members.join(sides, "anchor").withColumn("side", F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    as_home = own.select("anchor", F.col("side").alias("i"), every.alias("j"), "fp", F.lit(True).alias("home"))
    as_other = own.select("anchor", every.alias("i"), F.col("side").alias("j"), "fp", F.lit(False).alias("home"))
    return as_home.unionByName(as_other.where("i <> j")).repartition(partitions(members.sparkSession), "anchor", "i", "j")


def _squares(large: DataFrame, at_home, distance: int, codes: tuple[Covering, ...]) -> DataFrame:
    """Links within large anchors, square by square.

    The last rows of an anchor may come in a part that is no longer than MEMBERS but not whole; the
    sides are counted from what was set aside, which is all of it.
    """

    def square(key: tuple, rows: pa.Table) -> pa.Table:
        anchor, fps, side = key[0].as_py(), rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy()
        own = fps[side]
        home = at_home(anchor, own)
        others = np.concatenate([own[~home], fps[~side]])
        a, b = _edges(forest(own[home], others, Near(distance, codes, anchor >> KEY_BITS)))
        return pa.table({"a": a, "b": b})

    return _sides(large, MEMBERS).groupBy("anchor", "i", "j").applyInArrow(square, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints are linked share a component.

    A fingerprint has the majority bits of the XXH64 of all ``words``-word shingles; fingerprints
    link at ``distance`` or fewer differing bits; component_id is the smallest doc_id reachable over
    links, the document's own included. Null and empty texts, and texts of white space, have the
    fingerprint zero and link like any other. Equal fingerprints are compared once, so groups of
    copies cost nothing. A null doc_id is kept; it is no component_id unless its component has no
    other. Repeated rows stay; no rows give none; other columns are ignored.
    """
    marked = settle(fingerprints(docs, words), "fingerprints")
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    named = _named(distinct, components(links(distinct, distance, blocks)))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(distinct: DataFrame, reps: DataFrame) -> DataFrame:
    """(fp, component_id) from the smallest doc_id of each fingerprint and the components of fingerprints."""
    rooted = distinct.join(reps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("rep", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "first", "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
