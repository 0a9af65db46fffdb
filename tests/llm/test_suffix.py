import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffix


def brute(rows, least):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    rank = lambda d: -(2**63) if d is None else d
    for d, t in data:
        for i in range(len(t) - least + 1):
            s = t[i : i + least]
            first[s] = min(first.get(s, rank(d)), rank(d))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < rank(d):
                gone[i : i + least] = b"\1" * least
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    passages = [text(rng.randrange(45, 120)) for _ in range(8)]
    rows = []
    for i in range(60):
        t = text(rng.randrange(0, 300))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(passages) + t[at:]
        rows.append(t)
    rows += [rows[3], rows[3], rows[5][:80] + "!" + rows[5][81:], None, "", "a" * 400, "a" * 130, "ab" * 100 + "a" * 60, "x" * 49, "x" * 50, "x" * 51]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows)) + [(ids[0], rows[0]), (ids[1], rows[7]), (None, rows[9])]


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,bucket,chunk", [(1, 8 << 20, 1 << 20), (2, 500, 1 << 20), (3, 3000, 700)])
def test_against_brute_force(spark, monkeypatch, seed, bucket, chunk):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "TRANSFORM_BYTES", chunk)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, key string")
    assert digest(suffix.remove_repeats(docs, 50)) == brute(rows, 50)


def test_longer_strings_and_long_texts(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab ") for _ in range(20_000))
    rows = [(1, long), (2, long[5000:9000] + "?" + long[100:180]), (3, long[:81])]
    assert digest(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 80)) == brute(rows, 80)


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    assert digest(suffix.remove_repeats(docs)) == brute([(1, None), (2, "short")], 50)
    assert suffix.remove_repeats(docs.limit(0)).collect() == []


def test_the_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in suffix.op5_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows, 50)


def test_more_buckets_than_twelve_bits_hold(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(len((t or "").encode()) for _, t in rows) > 1 << 13
    assert digest(suffix.remove_repeats(docs, 50)) == brute(rows, 50)


def test_bits_of_owners_and_buckets():
    assert suffix._owner_bits(4) == 30 and suffix._owner_bits(1 << 24) == 8
    with pytest.raises(ValueError):
        suffix._owner_bits((1 << 24) + 1)


def test_a_common_passage_is_sent_once_for_texts_read_together():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(60)) + "a passage that every document of the table has, word for word, at its end" for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(200), pa.int64()), "key": pa.array(range(200), pa.int64()), "text": texts})
    rows = pa.Table.from_batches(list(suffix._first_pass(50, 4)(iter([batch])))).to_pylist()
    sent = np.concatenate([np.frombuffer(r["data"], "<u4") for r in rows if r["part"] is None])
    assert len(np.unique(sent)) == len(sent) and len(sent) < 200 * 20
    told = [n for r in rows if r["part"] is not None for n in np.frombuffer(suffix._un(r["sizes"]), "<i4").tolist()]
    assert len(told) == 200 and min(told) >= 8
