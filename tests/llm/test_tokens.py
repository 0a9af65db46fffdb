import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokens
from tessera.llm.eliasfano import EliasFano

PATH = tokens.default_tokenizer()
DIRECT = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    e = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
    assert e.values().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values
    assert all(e.span(i, j).tolist() == values[i:j] for i in range(0, len(values), 7) for j in range(i + 1, len(values) + 1, 11))


def test_elias_fano_space_and_gaps():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    e = EliasFano.encode(values)
    assert len(e.to_bytes()) < 5000 * 2.5
    wide = np.array([0, 1, 10**7, 10**7, 10**7 + 1])
    assert [EliasFano.encode(wide).select(i) for i in range(5)] == wide.tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aA'sſ İΣσ́eéñß1٣!.,-$|<>  \x1c\x1f\x0b\t\n\r　中ﬁ😀"), max_size=40))
def test_chunks_give_the_ids_of_whole_texts(text):
    packed = tokens.encoder(PATH).packed([text.encode()])[0]
    assert np.frombuffer(packed, "<u2").tolist() == DIRECT.encode(text, add_special_tokens=False).ids


def brute(rows):
    out, start = [], 0
    place = lambda text: (xxhash.xxh64_intdigest((text or "").encode(), 42) + 2**63) % 2**64
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place(r[1]))):
        ids = DIRECT.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards,size", [(1, 1 << 26), (3, 1 << 26), (None, 2000)])
def test_output_is_read_back(spark, monkeypatch, shards, size):
    monkeypatch.setattr(tokens, "SHARD_BYTES", size)
    monkeypatch.setattr(tokens, "READ_DOCUMENTS", 5)
    monkeypatch.setattr(tokens, "READ_BYTES", 100)
    rng = random.Random(3)
    rows = [(i * 7 - 20, " ".join(rng.choice(["the", "Été", "don't", "42", "<|endoftext|>", "x" * 90]) for _ in range(rng.randrange(0, 50)))) for i in range(40)]
    rows += [(3, None), (None, "null id"), (15, ""), (15, ""), (15, "again"), (9999, "long " * 30000)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, ids_crc32 string")
    got = tokens.token_output(docs, PATH, shards=shards).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_no_documents(spark):
    assert tokens.token_output(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_documents_by_select(spark):
    folder = tokens.write_corpus(spark.createDataFrame([(1, "one two"), (2, ""), (3, "three")], "doc_id long, text string"), PATH, 2, shards=1)
    shard = tokens.Shard(f"{folder}/shard-000000.ids")
    assert [shard.document(i).tolist() for i in range(3)] == [DIRECT.encode(t, add_special_tokens=False).ids + [2] for t in ("one two", "", "three")]
