"""Sharding by minimax contiguous partition; DataFrame operations only on the main path."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import blank, settle, table

#: Cells one refinement asks for; bounds what the driver holds of the groups at a time.
CELLS = 4096
#: Documents a slot window holds on average.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Cell:
    """Neighbouring groups: the range of their order key, their number, bytes and largest one."""

    low: int
    high: int
    groups: int
    bytes: int


class Ladder:
    """Ordered group sizes, known as cells that are split where a cut may fall.

    The driver holds at most ``CELLS`` cells and those of the ranges that cuts fell into, however
    many groups there are.
    """

    def __init__(self, groups: DataFrame, shards: int):
        """``groups`` is (first, bytes) with each ``first`` once."""
        self.groups, self.shards = groups, shards
        low, high, self.largest, self.total = groups.agg(F.min("first"), F.max("first"), F.max("bytes"), F.sum("bytes")).first()
        self.cells = self._split([(low, high)]) if low is not None else []

    def _split(self, ranges: list[tuple[int, int]]) -> list[Cell]:
        """One job: each range cut into cells of equal width in the order key."""
        each = max(16, CELLS // len(ranges))
        first, cell = F.col("first"), F.lit(None).cast("long")
        for i, (low, high) in enumerate(ranges):
            width = (high - low) // each + 1
            cell = F.when(first.between(low, high), F.floor((first - F.lit(low)) / F.lit(width)).cast("long") + i * (each + 1)).otherwise(cell)
        inside = reduce(lambda a, b: a | b, [first.between(low, high) for low, high in ranges])
        rows = self.groups.where(inside).groupBy(cell.alias("cell")).agg(F.min("first").alias("low"), F.max("first").alias("high"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
        return sorted((Cell(r.low, r.high, r.n, r.bytes) for r in rows), key=lambda c: c.low)

    def _refine(self, at: set[int]) -> None:
        new = self._split([(self.cells[i].low, self.cells[i].high) for i in sorted(at)])
        self.cells = sorted([c for i, c in enumerate(self.cells) if i not in at] + new, key=lambda c: c.low)

    def _greedy(self, capacity: int, whole: bool) -> tuple[bool, list[int], set[int]]:
        """Fill shard after shard; a cell that a cut may fall into goes whole to the next (or to this) shard.

        Returns whether the shards hold all, the cells at which shards begin, and the doubtful cells.
        """
        ends = list(accumulate(c.bytes for c in self.cells))
        at, doubtful, starts = 0, set(), []
        for _ in range(self.shards):
            starts.append(at)
            if at == len(ends):
                continue
            base = ends[at - 1] if at else 0
            to = bisect_right(ends, base + capacity)
            if to < len(ends) and self.cells[to].groups > 1:
                doubtful.add(to)
                to += whole
            at = to
        return at == len(ends), starts, doubtful

    def cuts(self) -> tuple[int, list[int]]:
        """The smallest capacity that suffices, and the order key at which each shard after the first begins."""
        if not self.cells:
            return 0, []
        low = max(self.largest, -(-self.total // self.shards))
        high = low + self.largest
        while low < high:
            mid = (low + high) // 2
            fits, _, a = self._greedy(mid, whole=False)
            if fits:  # even if cells are not split
                high = mid
                continue
            may, _, b = self._greedy(mid, whole=True)
            if not may:  # even if a shard takes more than it can
                low = mid + 1
            elif a | b:
                self._refine(a | b)
            else:
                low = mid + 1
        while True:
            fits, starts, doubtful = self._greedy(low, whole=False)
            if not doubtful:
                beyond = self.cells[-1].high + 1
                return low, [self.cells[i].low if i < len(self.cells) else beyond for i in starts[1:]]
            self._refine(doubtful)


def group_sizes(sized: DataFrame) -> DataFrame:
    """(digest, first, bytes) of each group of equal texts; ``first`` is its smallest place."""
    return sized.groupBy("digest").agg(F.min("place").alias("first"), F.sum("size").alias("bytes"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` of near equal bytes, equal texts together.

    Groups of equal texts, in the order of their smallest doc_id, are cut into contiguous shards of
    the smallest possible largest size. Returns doc_id, size, text_crc32, law, shard, slot,
    grown_shard. Size is the UTF-8 length plus 1. A null text counts as an empty one and is grouped
    with those; a null doc_id takes its place from the hash of the text. Texts whose smallest doc_id is the
    same (a doc_id that recurs) stay together too. Slots count from 0 in each shard, by the MD5
    of doc_id, then doc_id, size and digest; rows equal in all of these are alike. No rows: none.
    Groups too large for a share make their shard the largest; the rest is still dealt as evenly as
    the order permits. Other columns are ignored.
    """
    text = blank("text")
    place = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) - F.lit(2**62))
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest")), "sized")
    firsts = settle(group_sizes(sized).repartitionByRange("first").sortWithinPartitions("first"), "groups")
    _, cuts = Ladder(firsts.groupBy("first").agg(F.sum("bytes").alias("bytes")), shards).cuts()
    shard = reduce(lambda a, b: a + b, [(F.col("first") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    dealt = sized.join(firsts.select("digest", shard.alias("shard")), "digest")
    buckets = sized.count() // SLOT_ROWS // shards + 1
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    dealt = dealt.withColumn("order", order).withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets, 32))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", "doc_id", "size", "digest")) - 1
    return (
        dealt.withColumn("within", within)
        .join(counts.select("shard", "bucket", before.alias("before")), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op7_sql(shards: int = 16) -> str:
    """The binary search and the greedy fill as recursions; CRC-32 by its table of remainders."""
    step = "CASE WHEN {0} % 2 = 1 THEN xor(3988292384::UBIGINT, {0} >> 1) ELSE {0} >> 1 END"
    remainder = "i::UBIGINT"
    for _ in range(8):
        remainder = f"list_transform([{remainder}], lambda v: {step.format('v')})[1]"
    byte = "('0x' || substr(h, 2 * i + 1, 2))::UBIGINT"
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
groups AS (SELECT t, min(doc_id) AS least, sum(size)::BIGINT AS bytes FROM docs GROUP BY t),
sums AS (SELECT least, bytes, (sum(bytes) OVER (ORDER BY least))::BIGINT AS upto FROM groups),
facts AS (SELECT sum(bytes)::BIGINT AS total, max(bytes) AS largest, greatest(max(bytes), ceil(sum(bytes) / {shards}))::BIGINT AS low FROM sums),
search(low, high, shard, base) AS (
  SELECT low, (low + largest)::BIGINT, 0, 0::BIGINT FROM facts
  UNION ALL
  SELECT CASE WHEN shard < {shards} OR base >= total THEN s.low ELSE (s.low + s.high) // 2 + 1 END,
    CASE WHEN base >= total THEN (s.low + s.high) // 2 ELSE s.high END,
    CASE WHEN shard < {shards} AND base < total THEN shard + 1 ELSE 0 END,
    CASE WHEN shard < {shards} AND base < total THEN coalesce((SELECT max(upto) FROM sums WHERE upto <= s.base + (s.low + s.high) // 2), s.base) ELSE 0 END
  FROM search s, facts WHERE s.low < s.high),
best AS (SELECT min(high) AS capacity FROM search WHERE low >= high),
fill(shard, base) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT shard + 1, coalesce((SELECT max(upto) FROM sums WHERE upto <= f.base + capacity), f.base) FROM fill f, best WHERE shard < {shards}),
placed AS (SELECT least, (SELECT min(shard) FROM fill WHERE base >= upto) - 1 AS shard FROM sums),
remainders AS (SELECT list_transform(range(256), lambda i: {remainder}) AS tab),
crcs AS (SELECT t, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: {byte})), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS crc
  FROM (SELECT t, hex(encode(t)) AS h FROM groups), remainders)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM docs JOIN groups USING (t) JOIN placed USING (least) JOIN crcs USING (t)"""
