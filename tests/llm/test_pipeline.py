import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontam, tokens


def test_stages_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen, frames = docs.columns, [r.doc_id for r in docs.select("doc_id").collect()], [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, sf), "test")
        assert docs.columns == columns and docs.schema.simpleString() == frames[0].schema.simpleString()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= set(seen) and ids
        if name != "mixing to target weights":
            assert len(set(ids)) == len(ids)
        seen = ids
        frames.append(docs)
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    assert all(any(c.isalpha() for c in t) for t in texts[1].values())
    assert len(texts[1]) >= 0.98 * len(texts[0])
    assert len(set(texts[2].values())) == len(texts[2]) and set(texts[2].values()) <= set(texts[1].values())
    assert len(texts[2]) >= 0.6 * len(set(texts[1].values()))
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for d, t in texts[2].items():
        w = decontam.words(t)
        hit = any(sum(x in set(w) for x in a) >= 0.6 * len(a) and decontam.align(np.array([hash(x) for x in a]), np.array([hash(x) for x in w]))[0] >= 1.2 * len(a) for a in items)
        assert hit == (d not in texts[3]), d
    direct = Tokenizer.from_file(tokens.default_tokenizer())
    start, want = 0, []
    for r in sorted(frames[-1].collect(), key=lambda r: (r.doc_id, r.text)):
        ids = direct.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.STAGES[-1][1](spark, frames[-1], sf).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50
