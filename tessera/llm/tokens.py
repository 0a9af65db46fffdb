"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

A corpus is a folder of shards in ascending ``doc_id`` order and a manifest. A shard holds

    "TIDS0001" | ids, little-endian, 2 or 4 bytes each | Elias-Fano end offsets |
    Elias-Fano doc_ids | JSON footer | footer length (8 bytes) | "TIDS0001"

Ids take 2 bytes where the vocabulary fits. Null ``doc_id`` sort first; the footer counts them.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import filesystem, prepare, publish, publishing, shared_path, table, utf8
from tessera.llm.eliasfano import EliasFano

MAGIC = b"TIDS0001"
#: Chunks of text whose ids a worker remembers, and the longest of them in bytes.
CACHE_CHUNKS, CACHE_BYTES = 700_000, 64
#: Texts that are encoded together.
TEXTS = 16
#: ASCII marks that a pre-tokenizer of letters, digits and runs of other marks cuts from the letters before them.
TAIL = b".,!?;:&*#$%()-"
#: Bytes of text of a shard, about; a row counts as some bytes more, so that empty texts are bounded too.
SHARD_BYTES, ROW_BYTES = 32 << 20, 64
#: Documents whose boundaries a reader selects at once, and bytes of ids that one read asks for.
READ_DOCUMENTS, READ_BYTES = 4096, 16 << 20


class ChunkEncoder:
    """Encodes texts as the tokenizers library does, remembering the ids of chunks between white space.

    Valid for tokenizers that lower-case, and that drop white space and cut letters from a run of marks
    before they split (no added token contains white space or a mark of ``TAIL``): then the ids of a
    text are those of its chunks in order, and a chunk's are those of its letters and of its tail. A run
    of letters must be one piece for the model, and ASCII must stand for itself.
    ``tests/llm/test_tokens.py`` holds this against whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        known, code, size = self.known, self.dtype.char, self.dtype.itemsize
        other = []
        for chunk in chunks:
            # Lower-cased ASCII letters are one piece, as they are: the model takes it without the steps before.
            if chunk.isalpha() and chunk.islower():
                ids = [t.id for t in self.model.tokenize(chunk.decode())]
                known[chunk] = ids[0].to_bytes(size, "little") if len(ids) == 1 else struct.pack(f"<{len(ids)}{code}", *ids)
            else:
                other.append(chunk)
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)):
                ids = e.ids
                known[chunk] = struct.pack(f"<{len(ids)}{code}", *ids)

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed; some texts at a time, whose chunks then stay in the processor's cache."""
        return [ids for i in range(0, len(texts), TEXTS) for ids in self._packed(texts[i : i + TEXTS])]

    def _packed(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        known = self.known
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        missing = set().union(*split).difference(known)
        stems = {c: s for c in missing if len(s := c.rstrip(TAIL)) < len(c) and s[-1:].isalpha()}
        parts = missing.difference(stems).union(stems.values(), (c[len(s) :] for c, s in stems.items()))
        self._learn(list(parts.difference(known)))
        for c, s in stems.items():
            known[c] = known[s] + known[c[len(s) :]]
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for c in missing | parts:
            if len(c) > CACHE_BYTES:
                known.pop(c, None)
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_corpus(docs: DataFrame, tokenizer: str, end_id: int, shards: int | None = None) -> str:
    """Write ``docs`` (doc_id, text) as shards below the shared folder and return the folder's URI.

    Rows are dealt by ranges of doc_id and a hash of the text into shards of about ``SHARD_BYTES`` (or
    ``shards`` of them), in which they lie in that order; equal rows are written as often as they
    come. Null texts are empty: the end id alone. No rows: no shards. Other columns are ignored. Ids
    go to the file batch by batch: a task holds a batch, and of each document of its shard a length
    and an id. A shard appears by renaming, so a task that runs again does no harm.
    """
    spark = prepare(docs.sparkSession)
    folder = shared_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if shards is None:
        size = rows.select(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
        shards = size // SHARD_BYTES + 1
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end, size = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        shard = TaskContext.get().partitionId()
        keys, lengths = [], []
        if not (some := next(batches, None)):
            return
        with publishing(f"{folder}/shard-{shard:06d}.ids") as out:
            out.write(MAGIC)
            for b in chain([some], batches):
                packed = coder.packed(list(utf8(b.column(1))))
                out.write(b"".join(x for ids in packed for x in (ids, end)))
                lengths.append(np.array([len(p) // size + 1 for p in packed], np.int64))
                keys.append(b.column(0))
            ids, counts = pa.chunked_array(keys, pa.int64()), np.concatenate([np.zeros(0, np.int64), *lengths])
            tokens = int(counts.sum())
            ends = EliasFano.encode(np.cumsum(counts)).to_bytes()
            names = EliasFano.encode(ids.drop_null().to_numpy()).to_bytes()
            foot = json.dumps({"dtype": coder.dtype.str, "docs": len(ids), "null_ids": ids.null_count, "tokens": tokens, "ids": tokens * size, "ends": len(ends), "names": len(names)}).encode()
            for part in (ends, names, foot, struct.pack("<Q", len(foot)), MAGIC):
                out.write(part)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    told = rows.mapInArrow(write, "shard int, docs long, tokens long").where("docs > 0").collect()
    start, manifest = 0, []
    for r in sorted(told, key=lambda r: r.shard):
        manifest.append({"shard": r.shard, "start": start, "docs": r.docs, "tokens": r.tokens})
        start += r.tokens
    publish(f"{folder}/manifest.json", json.dumps({"end_id": end_id, "tokens": start, "shards": manifest}).encode())
    return folder


class Shard:
    """A shard opened for reading; ids are read in parts, boundaries by select."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.size, self.file = fs.get_file_info(path).size, fs.open_input_file(path)
        tail = self._at(self.size - 16, 16)
        if self._at(0, 8) != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no whole shard")
        n = struct.unpack("<Q", tail[:8])[0]
        self.foot = f = json.loads(self._at(self.size - 16 - n, n))
        self.dtype = np.dtype(f["dtype"])
        self.ends = EliasFano.from_bytes(self._at(8 + f["ids"], f["ends"]))
        self.names = EliasFano.from_bytes(self._at(8 + f["ids"] + f["ends"], f["names"]))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        k = self.dtype.itemsize
        return np.frombuffer(self._at(8 + start * k, (stop - start) * k), self.dtype)

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` of the shard, by two selects."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray, list[np.ndarray]]]:
        """(doc_ids, starts, ids) of some documents at a time: boundaries by select, ids in reads of some MB."""
        most, nulls = READ_BYTES // self.dtype.itemsize, self.foot["null_ids"]
        start = 0
        for i in range(0, self.foot["docs"], READ_DOCUMENTS):
            j = min(i + READ_DOCUMENTS, self.foot["docs"])
            ends = self.ends.span(i, j)
            starts = np.concatenate([[start], ends[:-1]])
            start = int(ends[-1])
            names = [None] * (min(j, nulls) - min(i, nulls)) + (self.names.span(max(i, nulls) - nulls, j - nulls).tolist() if j > nulls else [])
            a = 0
            while a < j - i:
                b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, "right")))
                block, base = self.ids(int(starts[a]), int(ends[b - 1])), starts[a]
                yield names[a:b], starts[a:b], [block[x - base : y - base] for x, y in zip(starts[a:b], ends[a:b])]
                a = b


def read_manifest(folder: str) -> dict:
    fs, path = filesystem(f"{folder}/manifest.json")
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = read_manifest(folder)["shards"]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], out)
    named = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], "shard int, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(f"{folder}/shard-{number:06d}.ids")
                for names, starts, ids in shard.documents():
                    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + base), pa.array([len(x) for x in ids], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.repartition(len(shards)).mapInArrow(read, out)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write ``docs`` in the file format and return what the files say of each document.

    Columns doc_id, start, n_tokens (with the end id), ids_crc32. See :func:`write_corpus` for nulls,
    ties and empty tables.
    """
    return read_index(docs.sparkSession, write_corpus(docs, tokenizer, end_id, shards))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), default_tokenizer())
