"""URL filters over a sorted array of 64-bit digests."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fetch, filesystem, prepare, publish, release, settle, shared_path, table

MAGIC = b"UDIG0002"
#: Entries of one file of the index, about.
FILE_ENTRIES = 1 << 20
#: Files of an index that a worker keeps open; they are mapped where the folder is mounted.
OPEN_FILES = 16
#: What an entry does. A rule decides alone, the longest first; a listed entry blocks where no rule fits.
LISTED, ALLOW, BLOCK = 0, 1, 2
SEED = 42
#: What the key of a host starts with; no host and no entry holds it.
HOST = "/"


def digests(keys: Sequence[bytes]) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(k, SEED) for k in keys), np.uint64, len(keys))


@dataclass(frozen=True)
class UrlIndex:
    """A folder of files by the leading ``bits`` of the digest.

    A key is an entry, whose value is its action, or the host of some entries, whose value is the
    lengths of their paths. So a url is looked up by the hosts it is below, and with each that is
    held by paths of just these lengths.
    """

    folder: str
    bits: int


def build_index(entries: DataFrame) -> UrlIndex:
    """Write ``entries`` (entry string, action int) as sorted digest arrays below the shared folder.

    An entry is a host and a path, such as ``example.org/es/``; without a slash it has no path and
    fits every url of its host. Null and empty entries are left out. Of equal entries the one of the
    largest action stays, so a rule wins over a listing and ``BLOCK`` over ``ALLOW``.
    """
    spark = prepare(entries.sparkSession)
    folder = shared_path(spark, "urls")
    rows = settle(entries.where(F.length("entry") > 0).groupBy("entry").agg(F.max("action").cast("int").alias("action")), "entries")
    bits = (rows.count() // FILE_ENTRIES).bit_length()
    host = F.split_part("entry", F.lit("/"), F.lit(1))
    hosts = rows.groupBy(F.concat(F.lit(HOST), host).alias("key")).agg(F.array_sort(F.collect_set(F.length("entry") - F.length(host))).alias("value"))
    keyed = rows.select(F.col("entry").alias("key"), F.array("action").alias("value")).unionByName(hosts)
    file = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits).cast("int") if bits else F.lit(0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for n, key, value in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(n, []).append((key.encode(), value))
        for n, own in held.items():
            publish(f"{folder}/{n:06d}.udig", pack(own))
            yield pa.RecordBatch.from_pydict({"file": pa.array([n], pa.int32())})

    keyed.select(file.alias("file"), "key", "value").repartition(1 << bits, "file").mapInArrow(write, "file int").count()
    release(rows)
    return UrlIndex(folder, bits)


def pack(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """A file of keys and values: sorted digests, offsets of strings and of values, values, strings."""
    keys = digests([e for e, _ in entries])
    order = np.argsort(keys, kind="stable")
    strings, values = [entries[i][0] for i in order], [entries[i][1] for i in order]
    ends = lambda own: np.cumsum([0, *map(len, own)]).astype("<u8").tobytes()
    return b"".join([MAGIC, struct.pack("<Q", len(strings)), keys[order].astype("<u8").tobytes(), ends(strings), ends(values), np.array([x for v in values for x in v], "<u4").tobytes(), *strings])


class DigestFile:
    """One file of the index, memory-mapped where its folder is mounted, else read."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        data = np.memmap(path, np.uint8, "r") if fs.type_name == "local" else np.frombuffer(fetch(uri), np.uint8)
        if data[:8].tobytes() != MAGIC:
            raise ValueError(f"{uri} is no digest file")
        n, at = int(data[8:16].view("<u8")[0]), 16
        self.keys, at = data[at : at + 8 * n].view("<u8"), at + 8 * n
        self.offsets, at = data[at : at + 8 * n + 8].view("<u8"), at + 8 * n + 8
        self.starts, at = data[at : at + 8 * n + 8].view("<u8"), at + 8 * n + 8
        self.values, at = data[at : at + 4 * int(self.starts[-1])].view("<u4"), at + 4 * int(self.starts[-1])
        self.strings = data[at:]

    def find(self, keys: np.ndarray, strings: Sequence[bytes]) -> list[list[int] | None]:
        """The value of each string, None where it is not held: a binary search, then the stored string."""
        at = np.searchsorted(self.keys, keys)
        last = len(self.keys)
        out: list[list[int] | None] = [None] * len(keys)
        for i in np.flatnonzero((at < last) & (self.keys[np.minimum(at, last - 1)] == keys)) if last else ():
            j = int(at[i])
            while j < last and self.keys[j] == keys[i]:
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == strings[i]:
                    out[i] = self.values[self.starts[j] : self.starts[j + 1]].tolist()
                    break
                j += 1
        return out


@lru_cache(OPEN_FILES)
def _file(uri: str) -> DigestFile | None:
    fs, path = filesystem(uri)
    # No entry has such a digest where there is no file.
    return None if fs.get_file_info(path).type.name == "NotFound" else DigestFile(uri)


def lookup(index: UrlIndex, strings: Sequence[bytes]) -> list[list[int] | None]:
    """The value of each string, None where it is not held."""
    keys = digests(strings)
    which = (keys >> np.uint64(64 - index.bits)).astype(np.int64) if index.bits else np.zeros(len(keys), np.int64)
    out: list[list[int] | None] = [None] * len(keys)
    for n in np.unique(which):
        file = _file(f"{index.folder}/{n:06d}.udig")
        if file:
            at = np.flatnonzero(which == n).tolist()
            for i, value in zip(at, file.find(keys[at], [strings[i] for i in at])):
                out[i] = value
    return out


def _cut(s: str, marks: str) -> int:
    return min([i for i in map(s.find, marks) if i >= 0], default=len(s))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host ends at ``/``, ``?`` or ``#`` and has A-Z lower-cased; the path at ``?`` or ``#``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    n = _cut(rest, "/?#")
    host = rest[:n].encode().lower().decode()
    return host, rest[n : n + _cut(rest[n:], "?#")]


def judge(index: UrlIndex, parts: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
    """(rule, verdict) of each (host, path)."""
    below = {host: [host[i:] for i in [0, *(k + 1 for k, c in enumerate(host) if c == ".")]] for host in {h for h, _ in parts if h}}
    hosts = sorted({x for own in below.values() for x in own})
    lengths = dict(zip(hosts, lookup(index, [(HOST + x).encode() for x in hosts])))
    keys, owner = [], []
    for i, (host, path) in enumerate(parts):
        for x in below.get(host, ()):
            for length in lengths[x] or ():
                if length <= len(path):
                    keys.append(x + path[:length])
                    owner.append(i)
    rule: list[tuple] = [(-1, -1, None, 0)] * len(parts)
    listed = [False] * len(parts)
    for i, text, value in zip(owner, keys, lookup(index, [k.encode() for k in keys])):
        if value is None:
            continue
        if value[0] == LISTED:
            listed[i] = True
        else:
            rule[i] = max(rule[i], (len(text), len(text.partition("/")[0]), text, value[0]))
    return [(r[2], "block" if (r[3] == BLOCK if r[2] is not None else bad) else "allow") for r, bad in zip(rule, listed)]


def judge_urls(pages: DataFrame, index: UrlIndex) -> DataFrame:
    """page_id, host, path, rule, verdict of each url of ``pages`` (page_id, url).

    An entry fits its host and all subdomains if the path starts with the entry's path; the longest
    rule decides (of equal length the longer host); where none fits, a listed entry blocks; else the
    url is allowed. A null url, or one without ``://``, has an empty host and path and is allowed.
    Rows are judged one by one: repeated rows stay, other columns are ignored, no rows give none.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            judged = judge(index, parts)
            columns = [[p[0] for p in parts], [p[1] for p in parts], [j[0] for j in judged], [j[1] for j in judged]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the query, and the hosts its list blocks.
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))
BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([*RULES, *((h, LISTED) for h in BLOCKED_HOSTS)], "entry string, action int")
    return judge_urls(table(spark, sf_dir, "pages"), build_index(entries))


def op6_sql() -> str:
    rules = ", ".join(f"('{e}', '{e.partition('/')[0]}', '{e[len(e.partition('/')[0]) :]}', '{'block' if a == BLOCK else 'allow'}')" for e, a in RULES)
    listed = " OR ".join(f"('.' || host) LIKE '%.{h}'" for h in BLOCKED_HOSTS)
    return f"""
WITH rules(rule, rule_host, rule_path, act) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
heads AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM heads),
fits AS (
  SELECT p.*, r.rule, r.act, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS n
  FROM parts p LEFT JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.rule_host) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict
FROM fits WHERE n = 1"""
