"""Media columns: index ISO media bytes and carry texts as such."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import isomedia
from tessera.llm.common import prepare, table, utf8

INDEX = "handler string, codec string, timescale long, duration long, seconds double, samples long, keyframes array<struct<offset:long,size:long>>, error string"
RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
FRAME = 8 * 8 * 3


def _track(data: bytes) -> isomedia.Track:
    found = isomedia.tracks(data)
    if not found:
        raise isomedia.BrokenMedia("no track")
    return next((t for t in found if t.handler == "vide"), found[0])


def _index(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 8
    try:
        track = _track(data)
        keys = [{"offset": a, "size": b} for a, b in track.keyframes().tolist()]
        return track.handler, track.codec, track.timescale, track.duration, track.seconds, track.samples(), keys, None
    except isomedia.BrokenMedia as e:
        return (None,) * 7 + (str(e),)


def index_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Add codec, duration and keyframe byte ranges of the first video (else first) track of ``media``.

    Adds the columns of ``INDEX``; columns of those names in ``df`` are replaced. Null bytes give
    nulls; bytes that are no whole media file give nulls and say why in ``error``. The payload is
    not decoded. A map over rows: no shuffle.
    """
    prepare(df.sparkSession)
    added = [f.split()[0] for f in INDEX.replace("struct<offset:long,size:long>", "x").split(", ")]
    kept = df.select(*[c for c in df.columns if c not in added])
    names = [*kept.columns, *added]
    at = names.index(media)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + INDEX

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), RANGES, pa.string()]
        for b in batches:
            found = list(zip(*[_index(x) for x in utf8(b.column(at))])) or [()] * 8
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, k in zip(found, kinds))], names=names)

    return kept.mapInArrow(run, schema)


def text_file(text: bytes | None) -> bytes:
    """A text as raw 8x8 RGB frames in an ISO media file; bytes 32 fill the last frame, and an empty text is one frame."""
    text = text or b""
    return isomedia.write(text.ljust(max(1, -(-len(text) // FRAME)) * FRAME))


def texts_as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as :func:`text_file`.

    A null text counts as empty. Equal texts give equal files.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(map(text_file, texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
KINDS = {pa.int64(): "long", pa.string(): "string"}


def digest(data: bytes | None) -> tuple:
    """What :func:`media_digest` says of one file, from its stored bytes alone."""
    if data is None:
        return (None,) * len(DIGEST)
    stored = (len(data), hashlib.sha256(data).hexdigest())
    try:
        track = _track(data)
        back, keys = isomedia.payload(data, track), track.keyframes()
    except isomedia.BrokenMedia as e:
        return None, None, None, *stored, f"error={e}"
    spans = ",".join(f"{a}+{n}" for a, n in keys.tolist())
    feature = f"codec={track.codec.strip()};duration={track.duration}/{track.timescale};samples={track.samples()};keyframes={len(keys)};ranges={zlib.crc32(spans.encode()):08x}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), *stored, feature


def media_digest(stored: DataFrame, media: str = "media") -> DataFrame:
    """(doc_id, and the columns of ``DIGEST``) of the files in ``media``: the payload read back, the file, and its index in short.

    Null bytes give nulls; of bytes that are no whole media file the size and digest stay, and
    ``feature`` says why. A map over rows: no shuffle; repeated rows stay.
    """
    return _digests(stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(media).cast("binary")), lambda data: data, "")


def _digests(rows: DataFrame, file, more: str) -> DataFrame:
    """``digest`` of ``file`` of the second column; with ``more`` the length of that column too."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = list(utf8(b.column(1)))
            columns = list(zip(*(digest(file(x)) for x in held))) or [()] * len(DIGEST)
            lengths = {"n_bytes": pa.array([len(x or b"") for x in held], pa.int64())} if more else {}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), **lengths, **{n: pa.array(c, k) for c, (n, k) in zip(columns, DIGEST)}})

    return rows.mapInArrow(run, "doc_id long, " + more + ", ".join(f"{n} {KINDS[k]}" for n, k in DIGEST))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is written as a file, and what is told is read from the file; one map, so files do not leave the task."""
    docs = table(spark, sf_dir, "documents")
    return _digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), text_file, "n_bytes long, ")
