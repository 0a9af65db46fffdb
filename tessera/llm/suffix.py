"""Removal of repeated byte strings, by suffix structures over pieces that could repeat.

One transform of a whole corpus would be one task. Here every window of ``least`` bytes is sent where
its minimizer (the smallest hash of its 20-byte substrings) sends it, so equal windows meet and a
bucket's transform is of bounded size. Three steps, each with its sums made before the shuffle:

1. which minimizers more than one document has; only hashes are moved, and of those that documents
   read together share one each, so a minimizer that all documents have is as many rows as tasks read;
2. of windows with such a minimizer, the pieces of text, equal pieces once; at each bucket the
   transform's intervals tell which windows of different pieces are equal, and the smallest doc_id of
   each. A minimizer that only one piece is left of has nothing to be compared with;
3. the spans of each document are joined to its text and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bwt import boundaries, suffix_order
from tessera.llm.common import blank, prepare, table, utf8

GRAM = 20
#: Bytes of text of a bucket on average, of texts that are hashed at a time, and of pieces of one transform.
BUCKET_BYTES, CHUNK_BYTES, TRANSFORM_BYTES = 16 << 20, 1 << 20, 1 << 17
#: Fewest bits of a text's number among those read together; what 32 bits of hash and the bucket leave of 64 are used.
OWNER_BITS = 8
NO_ID = -(2**63)


def minimizers(text: np.ndarray, least: int) -> np.ndarray:
    """For each window of ``least`` bytes of ``text``, the smallest hash of its ``GRAM``-byte substrings."""
    n = len(text) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = text.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] << np.uint64(8 * k) | x[k:]
    m = len(text) - GRAM + 1
    h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
    for shift, k in ((8, 0xC2B2AE3D27D4EB4F), (GRAM - 8, 0x165667B19E3779F9)):
        h ^= h >> np.uint64(29)
        h += x[shift : m + shift] * np.uint64(k)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width, have = least - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h[:n]


def runs(texts: list[bytes], least: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text number, start in these, start in the text, windows, hash) of the runs of windows with one minimizer.

    Some whole texts at a time, end to end; runs are cut at ``least - GRAM + 1`` windows.
    """
    most = least - GRAM + 1
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
            size += len(texts[j])
            j += 1
        joined = b"".join(texts[i:j])
        text = np.frombuffer(joined, np.uint8)
        lengths = np.array([len(t) for t in texts[i:j]], np.int64)
        begins = np.cumsum(lengths) - lengths
        hashes = minimizers(text, least)
        owner = np.repeat(np.arange(j - i), lengths)[: len(hashes)]
        inside = np.arange(len(hashes)) + least <= (begins + lengths)[owner]
        at = np.flatnonzero(inside)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (hashes[at[1:]] != hashes[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(at)))
            pieces = -(-sizes // most)
            head = np.repeat(heads, pieces)
            turn = np.arange(len(head)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            windows = np.minimum(most, np.repeat(sizes, pieces) - turn * most)
            start = at[head] + turn * most
            yield joined, owner[start] + i, start, start - begins[owner[start]], windows, hashes[start]
        i = j


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 more bits) of hashes."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), h.astype(np.uint32)


def _owner_bits(buckets: int) -> int:
    """Bits that are left for a text's number beside those of one of ``buckets``."""
    bits = 32 - (buckets - 1).bit_length()
    if bits < OWNER_BITS:
        raise ValueError(f"{buckets} buckets are too many; raise BUCKET_BYTES")
    return bits


def _held(batches: Iterator[pa.RecordBatch], columns: int, most: int) -> Iterator[list[list]]:
    """The first ``columns`` of some MB of rows at a time, ``most`` rows at most, texts as bytes; documents' rows stay in order."""
    for held in _read(batches, columns):
        for i in range(0, len(held[0]), most):
            yield [x[i : i + most] for x in held]


def _read(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    held, size = None, 0
    for b in batches:
        new = [list(utf8(b.column(i))) if pa.types.is_string(b.column(i).type) or pa.types.is_large_string(b.column(i).type) else b.column(i).to_pylist() for i in range(columns)]
        held = new if held is None else [x + y for x, y in zip(held, new)]
        size += b.nbytes
        if size > 4 * CHUNK_BYTES:
            yield held
            held, size = None, 0
    if held is not None and held[0]:
        yield held


def _first_pass(least: int, buckets: int):
    bits = _owner_bits(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _held(batches, 3, 1 << bits):
            found = [(owner, h) for _, owner, _, _, _, h in runs(texts, least)]
            if not found:
                continue
            owner, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            bucket, low = _split(h, buckets)
            packed = np.unique(bucket.astype(np.uint64) << np.uint64(32 + bits) | owner.astype(np.uint64) << np.uint64(32) | low)
            bucket, low = (packed >> np.uint64(32 + bits)).astype(np.int32), packed.astype(np.uint32)
            owner = (packed >> np.uint64(32)).astype(np.int64) & ((1 << bits) - 1)
            ids, keys = np.array(ids, np.int64), np.array(keys, np.int32)
            code = bucket.astype(np.uint64) << np.uint64(32) | low
            _, first, which, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            # What texts read together share, they are told; one of them stands for all elsewhere.
            here = np.flatnonzero(times[which] > 1)
            here = here[np.argsort(owner[here], kind="stable")]
            cuts = np.flatnonzero(np.diff(owner[here], prepend=-1))
            docs = [(int(ids[owner[own[0]]]), int(keys[owner[own[0]]]), code[own].tobytes()) for own in np.split(here, cuts[1:]) if len(own)]
            out = [(row[0], *row) for row in _told(LOCAL, buckets, docs)]
            sent = np.sort(first)
            bucket, low, owner = bucket[sent], low[sent], owner[sent]
            for part in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(bucket)) + 1):
                heads = np.flatnonzero(np.diff(owner[part], prepend=-1))
                who = owner[part[heads]]
                count = np.diff(np.append(heads, len(part))).astype(np.int32)
                number = int(bucket[part[0]])
                out.append((number, None, number, _z(ids[who].tobytes()), _z(keys[who].tobytes()), _z(count.tobytes()), low[part].tobytes()))
            yield _rows(out, FIRST)

    return run


#: What many documents of one part are told: ids, keys and how many bytes of ``data`` are each one's.
TOLD = [("part", pa.int32()), ("bucket", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())]
#: As TOLD, by part; or, without a part, the hashes of one bucket: how many are each document's.
FIRST = [("at", pa.int32()), *TOLD]
#: The bucket of what is told with buckets.
LOCAL = -1
ONE = [("id", pa.int64()), ("key", pa.int64()), ("data", pa.binary())]
#: Pieces of a bucket (text, sizes, 32 bits of the minimizer, all compressed; which piece, id, key and start of each place), or spans of documents.
PIECES = [("bucket", pa.int32()), ("text", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("which", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("spans", pa.binary())]
SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def _z(data: bytes) -> bytes:
    """Compressed, the length before."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _un(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _schema(fields: list) -> str:
    return ", ".join(f"{n} {SQL[t]}" for n, t in fields)


def _rows(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _column(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(_un, t[name].to_pylist()) if name != "data" else t[name].to_pylist()), kind)


def _told(bucket: int, parts: int, docs: list[tuple[int, int, bytes]]) -> list[tuple]:
    """Rows of TOLD for what ``docs`` (id, key, data) are told, a row for each part they lie in."""
    by: dict[int, list] = {}
    for d in docs:
        by.setdefault(d[1] % parts, []).append(d)
    pack = lambda values, kind: _z(np.array(values, kind).tobytes())
    return [(part, bucket, pack([d[0] for d in own], "<i8"), pack([d[1] for d in own], "<i4"), pack([len(d[2]) for d in own], "<i4"), b"".join(d[2] for d in own)) for part, own in by.items()]


def _shared(parts: int):
    """Of one bucket, for each document the hashes that another document has too; what is told already is passed on."""

    def run(t: pa.Table) -> pa.Table:
        told = t.filter(pc.is_valid(t["part"])).select([n for n, _ in TOLD])
        t = t.filter(pc.is_null(t["part"]))
        if not len(t):
            return told
        ids, keys, counts, hashes = _column(t, "ids", "<i8"), _column(t, "keys", "<i4"), _column(t, "sizes", "<i4"), _column(t, "data", "<u4")
        order = np.argsort(hashes)
        ranked = hashes[order]
        twice = np.zeros(len(hashes), bool)
        same = ranked[1:] == ranked[:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        ends = np.cumsum(counts)
        kept = np.concatenate([[0], np.cumsum(twice)])
        data, bucket = hashes[twice].tobytes(), t["bucket"][0].as_py()
        low, high = 4 * kept[ends - counts], 4 * kept[ends]
        at = np.flatnonzero(high > low)
        docs = [(i, k, data[a:b]) for i, k, a, b in zip(ids[at].tolist(), keys[at].tolist(), low[at].tolist(), high[at].tolist())]
        return pa.concat_tables([told, pa.Table.from_batches([_rows(_told(bucket, parts, docs), TOLD)]).cast(told.schema)])

    return run


def _gather(codes: bool):
    """Of one part, a row for each document with all it was told; hashes with their bucket if ``codes``."""

    def run(t: pa.Table) -> pa.Table:
        by: dict[tuple[int, int], list[bytes]] = {}
        for r in t.to_pylist():
            data, sizes = r["data"], np.frombuffer(_un(r["sizes"]), "<i4")
            if codes and r["bucket"] != LOCAL:
                data, sizes = (np.frombuffer(data, "<u4") | np.uint64(r["bucket"] << 32)).tobytes(), sizes * 2
            ends = np.cumsum(sizes)
            for i, k, a, b in zip(np.frombuffer(_un(r["ids"]), "<i8").tolist(), np.frombuffer(_un(r["keys"]), "<i4").tolist(), (ends - sizes).tolist(), ends.tolist()):
                by.setdefault((i, k), []).append(data[a:b])
        return pa.Table.from_batches([_rows([(*doc, b"".join(own)) for doc, own in by.items()], ONE)])

    return run


class Gathered:
    """Equal pieces once: of the smallest id its places, of all others spans, since they repeat it whole."""

    def __init__(self):
        self.least: dict[bytes, list] = {}
        self.codes: dict[bytes, int] = {}
        self.spans: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def cover(self, doc: tuple[int, int], start: int, stop: int) -> None:
        own = self.spans.setdefault(doc, [])
        if own and own[-1][0] <= start <= own[-1][1]:
            own[-1] = (own[-1][0], max(stop, own[-1][1]))
        else:
            own.append((start, stop))

    def add(self, piece: bytes, code: int, doc: tuple[int, int], start: int) -> None:
        held = self.least.get(piece)
        if held is None:
            self.least[piece] = [(doc, start)]
            self.codes[piece] = code
        elif doc[0] > held[0][0][0]:
            self.cover(doc, start, start + len(piece))
        elif doc[0] == held[0][0][0]:
            held.append((doc, start))
        else:
            for other, at in held:
                self.cover(other, at, at + len(piece))
            self.least[piece] = [(doc, start)]


def _blob(spans: list[tuple[int, int]]) -> bytes:
    return np.array(spans, "<i4").tobytes()


def _second_pass(least: int, buckets: int):
    bits = _owner_bits(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts, shared in _held(batches, 4, 1 << bits):
            own, docs = {}, list(zip(ids, keys))
            counts = [len(x) // 8 for x in shared]
            wanted = np.frombuffer(b"".join(shared), "<u8")
            wanted = np.unique(wanted | np.repeat(np.arange(len(texts), dtype=np.uint64), counts) << np.uint64(64 - bits))
            spans = Gathered()
            for joined, owner, start, local, windows, h in runs(texts, least):
                bucket, low = _split(h, buckets)
                code = owner.astype(np.uint64) << np.uint64(64 - bits) | bucket.astype(np.uint64) << np.uint64(32) | low
                found = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                at = np.flatnonzero(wanted[found] == code)
                for n, c, d, i, j, size in zip(bucket[at].tolist(), low[at].tolist(), owner[at].tolist(), start[at].tolist(), local[at].tolist(), (windows[at] + least - 1).tolist()):
                    if n not in own:
                        own[n] = Gathered()
                        own[n].spans = spans.spans
                    own[n].add(joined[i : i + size], c, docs[d], j)
            out = []
            for n, g in own.items():
                pieces = list(g.least)
                which = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(g.least[p]) for p in pieces])
                places = [x for p in pieces for x in g.least[p]]
                blob = lambda values, kind: _z(np.array(values, kind).tobytes())
                out.append((n, _z(b"".join(pieces)), blob(list(map(len, pieces)), "<i4"), blob([g.codes[p] for p in pieces], "<u4"), _z(which.tobytes()), blob([d[0] for d, _ in places], "<i8"), blob([d[1] for d, _ in places], "<i4"), blob([a for _, a in places], "<i4"), None))
            for part, _, i, k, sizes, data in _told(0, buckets, [(*doc, _blob(found)) for doc, found in spans.spans.items()]):
                out.append((part, None, sizes, None, None, i, k, None, data))
            yield _rows(out, PIECES)

    return run


def _comparable(g: Gathered) -> Iterator[list[bytes]]:
    """The pieces whose minimizer another piece has too, those of one minimizer together, some at a time."""
    by: dict[int, list[bytes]] = {}
    for piece, code in g.codes.items():
        by.setdefault(code, []).append(piece)
    held, size = [], 0
    for own in by.values():
        if len(own) > 1:
            held += own
            size += sum(map(len, own))
            if size > TRANSFORM_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _transform(g: Gathered, pieces: list[bytes], least: int) -> None:
    """Cover the windows of ``pieces`` that a piece of a smaller id has, by the intervals of their transform."""
    sizes = np.array(list(map(len, pieces)), np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    left = np.repeat(ends, sizes) - np.arange(len(text))
    owner = np.repeat(np.array([g.least[p][0][0][0] for p in pieces], np.int64), sizes)
    order = suffix_order(text, left)
    heads = np.flatnonzero(boundaries(text, left, order, least))
    smallest = np.empty(len(text), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(text))))
    repeated = (smallest < owner) & (left >= least)
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Windows of two pieces are apart: the last bytes of a piece start none.
    piece = np.searchsorted(ends, low, "right")
    base = (ends - sizes)[piece]
    for n, a, b in zip(piece.tolist(), (low - base).tolist(), (high - 1 - base + least).tolist()):
        for doc, start in g.least[pieces[n]]:
            g.cover(doc, start + a, start + b)


def _expand(least: int, parts: int):
    """What a bucket adds to the spans of documents: equal pieces, then windows by the transform's intervals."""

    def run(t: pa.Table) -> pa.Table:
        g, out = Gathered(), []
        for r in t.to_pylist():
            if r["spans"] is not None:
                out.append((int(t["bucket"][0].as_py()), 0, r["ids"], r["keys"], r["sizes"], r["spans"]))
                continue
            ends = np.cumsum(np.frombuffer(_un(r["sizes"]), "<i4")).tolist()
            text, codes = _un(r["text"]), np.frombuffer(_un(r["codes"]), "<u4").tolist()
            pieces = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            for n, i, k, a in zip(*(np.frombuffer(_un(r[c]), x).tolist() for c, x in (("which", "<i4"), ("ids", "<i8"), ("keys", "<i4"), ("starts", "<i4")))):
                g.add(pieces[n], codes[n], (i, k), a)
        for pieces in _comparable(g):
            _transform(g, pieces, least)
        out += _told(0, parts, [(*doc, _blob(found)) for doc, found in g.spans.items()])
        return pa.Table.from_batches([_rows(out, TOLD)])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "key", "n_bytes", "n_removed", "n_spans", "kept"]
    for b in batches:
        rows = []
        for i, k, text, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist()):
            spans = np.frombuffer(told or b"", "<i4").reshape(-1, 2)
            kept, at, removed, n = [], 0, 0, 0
            for a, z in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
                if a > at or not n:
                    kept.append(text[at:a])
                    n, removed = n + 1, removed - a
                    at = z
                    removed += z
                elif z > at:
                    removed += z - at
                    at = z
            kept.append(text[at:])
            rows.append((i, k, len(text), removed, n, b"".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, [pa.int64()] * 5 + [pa.binary()])], names=names)


def remove_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text of ``docs`` without its repeated bytes.

    A byte goes if a string of ``least`` bytes that covers it also starts in a document of a smaller
    doc_id; strings are those of the input and end with their document. ``n_spans`` counts maximal
    runs of removed bytes; ``kept`` holds the other bytes (which may cut a UTF-8 sequence). A null
    text is empty. A null doc_id comes before all others. Rows of one doc_id do not remove each
    other's bytes; repeated rows stay. No rows give none; other columns are ignored.
    """
    if least < GRAM:
        raise ValueError(f"least must be {GRAM} or more")
    prepare(docs.sparkSession)
    text = blank(F.col("text").cast("string"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.shiftrightunsigned(F.xxhash64("doc_id", text), 33).alias("key"), text.alias("text"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // BUCKET_BYTES + 4)
    first = rows.mapInArrow(_first_pass(least, buckets), _schema(FIRST))
    shared = first.groupBy("at").applyInArrow(_shared(buckets), _schema(TOLD)).groupBy("part").applyInArrow(_gather(True), _schema(ONE))
    pieces = rows.join(shared.hint("merge"), ["id", "key"]).select("id", "key", "text", "data").mapInArrow(_second_pass(least, buckets), _schema(PIECES))
    spans = pieces.groupBy("bucket").applyInArrow(_expand(least, buckets), _schema(TOLD)).groupBy("part").applyInArrow(_gather(False), _schema(ONE))
    joined = rows.join(spans.hint("merge"), ["id", "key"], "left").select("id", "key", "text", "data")
    cut = joined.mapInArrow(_cut, "id long, key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), 50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sql() -> str:
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 49)) AS i, h FROM d WHERE n >= 50),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM w),
m AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM s JOIN m USING (s) WHERE least < doc_id),
f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY 1, 2),
gaps AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM spans),
cut AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS stop, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY k) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""
