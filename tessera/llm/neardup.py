"""Near-duplicates by SimHash candidates and exact similarity of shingle sets.

A text is its set of shingles, and a set has a fingerprint of 128 bits in eight blocks. Of sets with
a Jaccard similarity of 0.8 a bit differs with probability 0.15, so some block differs in at most one
bit in 93 of 100 such pairs, and in nearly all pairs above 0.9. The values of a block are covered by a
Hamming code on 15 of its bits. A fingerprint is sent to every anchor within covering radius plus one,
where it meets every fingerprint that is within one bit in that block. There those that are close over
all bits, and near enough in size, are candidates. A sketch of each set tells of most unlike candidates
that they differ too much, and of no others; the shingle sets of the rest are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, partitions, prepare, release, settle, utf8
from tessera.llm.graph import components
from tessera.llm.simhash import SEED, Covering, fingerprint, shingle_hashes

WORDS, BLOCKS, WIDTH, THRESHOLD = 2, 8, 16, 1
#: Bits of 128 that candidates may differ in: four standard deviations above the mean at similarity 0.8.
DISTANCE = 36
#: Comparisons made at once. Where most of them are links, each takes some 200 bytes on the way.
DENSE = 1 << 18
#: Links a member beyond which an anchor is thick; of a thick anchor the closest few of each home are told first.
THICK, CLOSEST = 2, 2
#: Members that one task compares; those of larger anchors, and with their sets those of thick ones, go in squares of sides of so many.
MEMBERS, SIDE = 1 << 20, 1 << 10
#: Bits of the filters that tell which rows a join can need, before these are moved.
FILTER_BITS = 1 << 24
GOLDEN, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """A second, third, ... hash of what ``hashes`` are of."""
    z = hashes + np.uint64(GOLDEN * (k + 1) & (1 << 64) - 1)
    for shift, by in zip((30, 27), MIX):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(by)
    return z ^ z >> np.uint64(31)


def sketch(numbers: np.ndarray) -> bytes:
    """How many of a set's numbers fall into each of 2^k buckets of four to eight, modulo 16, two to a byte."""
    n = 1 << max(4, (len(numbers) // 4).bit_length() - 1)
    counts = np.bincount(numbers & np.uint32(n - 1), minlength=n).astype(np.uint8) & 15
    return (counts[::2] | counts[1::2] << 4).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """At least so many numbers are in one only of the two sets that ``a`` and ``b`` are sketches of."""
    both = []
    for x in (a, b):
        packed = np.frombuffer(x, np.uint8)
        both.append(np.stack([packed & 15, packed >> 4], axis=1).ravel())
    n = min(map(len, both))
    x, y = (c.reshape(-1, n).sum(axis=0, dtype=np.uint8) for c in both)
    apart = (x - y) & 15
    return int(np.minimum(apart, 16 - apart).sum())


def signature(text: bytes, words: int) -> tuple[int, list[int], np.ndarray]:
    """(identity, fingerprint words, shingle set as sorted 32-bit numbers) of a text."""
    hashes = np.unique(shingle_hashes(text, words))
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED), [fingerprint(mixed(hashes, k)) for k in range(WORDS)], np.unique((hashes >> np.uint64(32)).astype("<u4"))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more; two empty sets are alike."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return False
    both = n + m - len(np.union1d(a, b)) if n and m else 0
    return both >= least * (n + m - both)


@lru_cache
def covering() -> Covering:
    return Covering(0, WIDTH, THRESHOLD)


def lanes(f: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints (rows of words), a column each."""
    return np.ascontiguousarray(f.astype("<u8")).view("<u2")


@dataclass
class Members:
    """Fingerprints that meet at an anchor, by size of their sets."""

    ids: np.ndarray
    f: np.ndarray
    sizes: np.ndarray
    home: np.ndarray
    reps: np.ndarray | None = None

    @classmethod
    def of(cls, anchor: int, ids: np.ndarray, f: np.ndarray, sizes: np.ndarray, reps: np.ndarray | None = None) -> Members:
        home = covering().homes(lanes(f)[:, anchor >> WIDTH].astype(np.uint64)) == np.uint64(anchor & ((1 << WIDTH) - 1))
        order = np.lexsort((ids, sizes))
        return cls(ids[order], f[order], sizes[order], home[order], None if reps is None else reps[order])

    def links(self, block: int, least: float, side: np.ndarray | None = None, once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(index of a home, index, bits apart) of candidates; a pair is told at the first block that shows it, by its smaller id.

        Not ``once``: by either id. Members of equal ``reps`` are no candidates. ``side`` marks the rows
        that may tell, all by default. A home is compared with the members whose size allows the
        similarity, ``DENSE`` comparisons at a time; all links of a home come together.
        """
        homes = np.flatnonzero(self.home if side is None else self.home & side)
        low = np.searchsorted(self.sizes, np.ceil(least * self.sizes[homes] - 1e-9))
        high = np.searchsorted(self.sizes, np.floor(self.sizes[homes] / least + 1e-9), "right")
        k = 0
        while k < len(homes):
            n = max(1, min(len(homes) - k, DENSE // max(1, int(high[k] - low[k]))))
            while n > 1 and n * int(high[k + n - 1] - low[k]) > DENSE:
                n //= 2
            at, a, b = homes[k : k + n], int(low[k]), int(high[k + n - 1])
            apart = np.bitwise_count(self.f[at, None, 0] ^ self.f[None, a:b, 0])
            for w in range(1, WORDS):
                apart = apart + np.bitwise_count(self.f[at, None, w] ^ self.f[None, a:b, w])
            i, j = np.nonzero(apart <= DISTANCE)
            d, i, j = apart[i, j], at[i], j + a
            keep = self.ids[i] < self.ids[j] if once else self.ids[i] != self.ids[j]
            if self.reps is not None:
                keep &= self.reps[i] != self.reps[j]
            i, j, d = i[keep], j[keep], d[keep]
            shown = np.bitwise_count(lanes(self.f[i] ^ self.f[j])) <= THRESHOLD
            keep = shown[:, block] & (shown.argmax(axis=1) == block)
            keep &= np.minimum(self.sizes[i], self.sizes[j]) >= least * np.maximum(self.sizes[i], self.sizes[j])
            if keep.any():
                yield i[keep], j[keep], d[keep]
            k += n

    def told(self, block: int, least: float, side: np.ndarray | None = None) -> tuple[list, np.ndarray | None]:
        """([(ids, ids)] of links, None); of too many links some, and the ids of members that must be compared with their sets.

        Where no ``reps`` are known these are the links of each home with its closest, which are
        likeliest to hold, and no ids: what they join is to be found first. Else no links, and all
        members that have any.
        """
        out, n = [], 0
        for i, j, _ in self.links(block, least, side):
            out.append((i, j))
            n += len(i)
            if n > THICK * len(self.ids):
                break
        else:
            return [(self.ids[i], self.ids[j]) for i, j in out], None
        if self.reps is not None:
            linked = np.zeros(len(self.ids), bool)
            for i, j, _ in self.links(block, least, side):
                linked[i] = linked[j] = True
            return [], self.ids[linked]
        best = []
        for i, j, d in self.links(block, least, side, once=False):
            order = np.lexsort((j, d, i))
            i, j = i[order], j[order]
            near = np.arange(len(i)) - np.searchsorted(i, i) < CLOSEST
            best.append((self.ids[i[near]], self.ids[j[near]]))
        return best, self.ids[:0]

    def joined(self, block: int, least: float, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
        """Links of similar sets, as few as join what they join; members of equal ``reps`` are joined already."""
        names, of = np.unique(self.reps, return_inverse=True)
        root, out = list(range(len(names))), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j, _ in self.links(block, least, side):
            now = np.array([find(k) for k in range(len(names))])[of]
            cross = now[i] != now[j]
            for m, n in zip(i[cross].tolist(), j[cross].tolist()):
                p, q = find(of[m]), find(of[n])
                if p != q and similar(sets[m], sets[n], least):
                    root[p] = q
                    out.append((int(self.ids[m]), int(self.ids[n])))
        return out


LINKS = "kind byte, a long, b long"


def _rows(told: tuple[list, np.ndarray | None], anchor: int) -> Iterator[pa.RecordBatch]:
    """Links as kind 0; a thick anchor as kind 3 and its members that must be compared as kind 2 (anchor, id)."""
    links, linked = told
    more = [] if linked is None else [(2, np.full(len(linked), anchor), linked)] if len(linked) else [(3, np.array([anchor]), np.array([0]))]
    for kind, a, b in [*((0, x, y) for x, y in links), *more]:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """(anchor, [size, id, words, rep], whole) of rows sorted by key; an anchor of over MEMBERS rows comes in parts."""
    anchor, held, n, parts = None, [], 0, 0
    for b in batches:
        columns = [c.to_numpy() for c in b.columns]
        anchors = columns[0] >> 32
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if anchors[i] != anchor:
                if n:
                    yield anchor, [np.concatenate(c) for c in zip(*held)], not parts
                anchor, held, n, parts = int(anchors[i]), [], 0, 0
            held.append([c[i:j] for c in columns])
            n += j - i
            if n > MEMBERS:
                yield anchor, [np.concatenate(c) for c in zip(*held)], False
                held, n, parts = [], 0, parts + 1
    if n:
        yield anchor, [np.concatenate(c) for c in zip(*held)], not parts


def candidates(distinct: DataFrame, least: float, at: np.ndarray | None = None) -> DataFrame:
    """(kind, a, b) of ``distinct`` (id, size, f0, f1): links as kind 0, thick anchors (a) as kind 3.

    Every link of an anchor that is not thick is told, of a thick one the closest of each home. With
    ``at``, a sorted array of anchors, and a column ``rep`` only links at these anchors between
    members of different reps count, and of anchors that are thick even so the members with links
    are told as (anchor, id), kind 2. Anchors of over ``MEMBERS`` members are set aside, cut into
    squares and compared square by square.
    """
    spark = prepare(distinct.sparkSession)
    words = [f"f{k}" for k in range(WORDS)]
    more = [*words, *(["rep"] if at is not None else [])]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, *rest = (c.to_numpy() for c in b.columns)
            blocks = lanes(np.stack(rest[:WORDS], axis=1).view(np.uint64))
            for k in range(BLOCKS):
                who, anchor = covering().near(blocks[:, k].astype(np.uint64))
                anchor = anchor.astype(np.int64) | k << WIDTH
                if at is not None:
                    stay = np.isin(anchor, at)
                    who, anchor = who[stay], anchor[stay]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor << 32 | sizes[who], ids[who], *(w[who] for w in rest))], names=["key", "id", *more])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, (key, ids, *rest), whole in _anchors(batches):
            if not whole or len(ids) > MEMBERS:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids), np.int8)), pa.array(np.full(len(ids), anchor)), pa.array(ids)], names=["kind", "a", "b"])
            elif len(ids) > 1:
                members = Members.of(anchor, ids, np.stack(rest[:WORDS], axis=1).view(np.uint64), key & 0xFFFFFFFF, *rest[WORDS:])
                yield from _rows(members.told(anchor >> WIDTH, least), anchor)

    copies = distinct.select("id", F.col("size").cast("long"), *more).mapInArrow(replicate, f"key long, id long, {', '.join(f'{w} long' for w in more)}")
    first = settle(copies.repartition(partitions(spark), F.shiftright("key", 32)).sortWithinPartitions("key").mapInArrow(compare, LINKS), "told")
    large = first.where("kind = 1").select(F.col("a").alias("anchor"), F.col("b").alias("id"))
    if large.isEmpty():
        return first

    def square(key: tuple, rows: pa.Table) -> pa.Table:
        anchor = key[0].as_py()
        members, side, _ = _square(anchor, rows)
        return pa.Table.from_batches(_rows(members.told(anchor >> WIDTH, least, side), anchor), schema=pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())]))

    sides = _sides(large.join(distinct, "id"), MEMBERS // 2, "size", *more)
    out = settle(first.where("kind <> 1").unionByName(sides.groupBy("anchor", "i", "j").applyInArrow(square, LINKS)), "told")
    release(first)
    return out


def _sides(members: DataFrame, most: int, *columns: str) -> DataFrame:
    """(anchor, i, j, id, home, columns): members cut into sides of about ``most``, every two sides together.

    Rows of side i may tell in (i, j), those of j may not. Of (i, i) rows are there once. Squares are
    dealt out one by one, not anchor by anchor.
    """
    sides = members.groupBy("anchor").agg((F.floor(F.count("*") / F.lit(most)) + 1).cast("int").alias("sides"))
    own = members.join(sides, "anchor").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    as_home = own.select("anchor", F.col("side").alias("i"), every.alias("j"), "id", F.lit(True).alias("home"), *columns)
    as_other = own.select("anchor", every.alias("i"), F.col("side").alias("j"), "id", F.lit(False).alias("home"), *columns)
    return as_home.unionByName(as_other.where("i <> j")).repartition(partitions(members.sparkSession), "anchor", "i", "j")


def _square(anchor: int, rows: pa.Table) -> tuple[Members, np.ndarray, np.ndarray]:
    """The members of a square, which of them may tell, and their places in ``rows``."""
    ids, sizes = rows["id"].to_numpy(), rows["size"].to_numpy().astype(np.int64)
    reps = rows["rep"].to_numpy() if "rep" in rows.column_names else None
    members = Members.of(anchor, ids, np.stack([rows[f"f{k}"].to_numpy() for k in range(WORDS)], axis=1).view(np.uint64), sizes, reps)
    order = np.lexsort((ids, sizes))
    return members, rows["home"].to_numpy()[order], order


def hits(rows: DataFrame, code: str, held: DataFrame) -> DataFrame:
    """``rows`` with a column that tells whether ``held`` (code) may hold their ``code``: true for all that it holds.

    The codes are hashes. What is broadcast does not grow with ``held``: FILTER_BITS bits, in words of
    64. The column's name is ``code`` and ``_hit``.
    """
    word, bit = f"({{0}} & {FILTER_BITS - 1}) >> 6", "shiftleft(1L, cast({0} & 63 as int))"
    names = [f"{code}_word", f"{code}_bits"]
    words = held.groupBy(F.expr(word.format("code")).alias(names[0])).agg(F.bit_or(F.expr(bit.format("code"))).alias(names[1]))
    joined = rows.withColumn(names[0], F.expr(word.format(code))).join(F.broadcast(words), names[0], "left")
    return joined.withColumn(f"{code}_hit", F.expr(f"coalesce({names[1]}, 0L) & {bit.format(code)} <> 0")).drop(*names)


def near_enough(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) but those whose sketches in ``distinct`` (id, size, sketch) tell that they are less alike than ``least``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column(2).to_numpy() + b.column(3).to_numpy()) * (1 - least) / (1 + least) + 1e-9
            keep = [differ(x, y) <= m for x, y, m in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), most.tolist())]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        pairs = pairs.join(distinct.select(F.col("id").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"of_{end}")), end)
    return pairs.select("a", "b", "size_a", "size_b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (id, set) have a similarity of ``least`` or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("set").alias(f"of_{end}")), end)
    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def similar_links(distinct: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of candidates with a similarity of ``least`` or more, enough to connect all that such links connect.

    ``distinct`` is (id, size, f0, f1, sketch), ``sets`` (id, set) with each id once or with equal
    sets. Told links are confirmed. Then links at thick anchors are told between members that these
    left apart, and where those are too many too, their members are compared with their sets, in
    squares of ``SIDE`` by ``SIDE``; only pairs that are still apart are.
    """

    def of(ids: DataFrame) -> DataFrame:
        wanted = hits(sets, "id", ids.withColumnRenamed("id", "code")).where("id_hit").select("id", "set")
        return wanted.join(ids.distinct(), "id", "left_semi").groupBy("id").agg(F.min("set").alias("set"))

    def links(told: DataFrame) -> DataFrame:
        pairs = settle(told.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        close = settle(near_enough(pairs, distinct, least), "close")
        near = settle(confirmed(close, of(close.select(F.col("a").alias("id")).union(close.select("b"))), least), "near")
        release(pairs, close)
        return near

    told = candidates(distinct, least)
    near = links(told)
    # there are 8 x 4,096 anchors at all
    thick = np.array(sorted(r.a for r in told.where("kind = 3").select("a").distinct().collect()), np.int64)
    release(told)
    if not len(thick):
        return near
    reps = components(near).withColumnRenamed("node", "id")
    placed = settle(distinct.drop("sketch").join(reps, "id", "left").withColumn("rep", F.coalesce("rep", "id")), "placed")
    told = candidates(placed, least, thick)
    near = near.unionByName(links(told))
    members = settle(told.where("kind = 2").select(F.col("a").alias("anchor"), F.col("b").alias("id")).distinct(), "apart")
    release(told)
    if members.isEmpty():
        release(placed, members)
        return near
    rows = _sides(members.join(placed, "id").join(of(members.select("id")), "id"), SIDE, "rep", "size", "f0", "f1", "set")

    def square(key: tuple, rows: pa.Table) -> pa.Table:
        members, side, order = _square(key[0].as_py(), rows)
        sets = rows["set"].to_pylist()
        links = members.joined(key[0].as_py() >> WIDTH, least, [np.frombuffer(sets[k], "<u4") for k in order.tolist()], side)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    out = settle(near.unionByName(rows.groupBy("anchor", "i", "j").applyInArrow(square, "a long, b long")), "near")
    release(placed, members)
    return out


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest doc_id.

    Documents are linked if their sets of ``words``-word shingles (A-Z lower-cased; fewer words: the
    whole text) have a Jaccard similarity of ``least`` or more and their fingerprints meet, as the
    module says; no link rests on fingerprints alone. Groups are what links connect. Null texts and
    texts without a word are alike. Equal sets are compared once. Of a group whose smallest doc_id
    recurs one row stays; a null doc_id stays only where its group has no other. No rows give none.
    Texts of rows that stay are not moved, but for the few that a filter takes for others and for
    rows that recur, of which one is picked in a pass of its own.
    Columns are those of ``docs``, whatever their names.
    """
    prepare(docs.sparkSession)
    code, key, row, away_key, away_code = (fresh(docs, n) for n in ("code", "key", "row", "away_key", "away_code"))
    own = docs.withColumn(code, F.xxhash64(F.col("text").cast("string"))).withColumn(key, F.col("doc_id").cast("long"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = [signature(t or b"", words) for t in utf8(b.column(2))]
            ids = np.fromiter((s[0] for s in signed), np.uint64, b.num_rows).view(np.int64)
            f = np.array([s[1] for s in signed], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids), pa.array([len(s[2]) for s in signed], pa.int32()), *(pa.array(f[:, k]) for k in range(WORDS)), *(pa.array([x(s[2]) for s in signed], pa.binary()) for x in (sketch, np.ndarray.tobytes))],
                names=["doc_id", "code", "id", "size", "f0", "f1", "sketch", "set"],
            )

    texts = own.select(F.col(key).alias("doc_id"), F.col(code).alias("code"), F.col("text").cast("string").alias("text"))
    marked = settle(texts.mapInArrow(mark, "doc_id long, code long, id long, size int, f0 long, f1 long, sketch binary, set binary"), "marked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code")).alias("first")
    distinct = settle(marked.groupBy("id").agg(*(F.min(c).alias(c) for c in ("size", "f0", "f1", "sketch")), first), "distinct")
    near = similar_links(distinct.drop("first"), marked.select("id", "set"), least)
    reps = components(near).withColumnRenamed("node", "id")
    groups = distinct.join(reps, "id", "left").groupBy(F.coalesce("rep", "id")).agg(F.min("first").alias("first"))
    kept = groups.select(F.col("first.doc_id").alias("kept_id"), F.col("first.code").alias("kept_code"))
    each = marked.groupBy("doc_id", "code").agg(F.count("*").alias("n")).join(kept, (F.col("code") == F.col("kept_code")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left")
    stays = F.col("kept_code").isNotNull()
    away = settle(each.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias(away_key), F.col("code").alias(away_code), stays.alias("stays")), "away")
    release(marked, distinct)
    at = (F.col(code) == F.col(away_code)) & F.col(key).eqNullSafe(F.col(away_key))
    own = hits(own.withColumn(row, F.xxhash64(key, code)), row, away.select(F.xxhash64(away_key, away_code).alias("code")))
    out = own.where(~F.col(f"{row}_hit")).select(*docs.columns).unionByName(own.where(f"{row}_hit").join(away, at, "left_anti").select(*docs.columns))
    again = away.where("stays")
    if again.isEmpty():
        return out
    return out.unionByName(own.where(f"{row}_hit").join(again, at, "left_semi").dropDuplicates([code, key]).select(*docs.columns))
