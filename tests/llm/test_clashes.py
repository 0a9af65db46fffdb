"""Operators that add or return columns leave clashing names and nulls in other columns alone."""

import corpus_pipeline
from tessera.llm import decontam, langid, mixing, neardup

NAMES = "doc_id long, text string, lang string, source string, n_chars long, fp long, tokens int, epoch string, component_id string, h string, domain string, doc string, id string, key string, tessera_code string, TESSERA_KEY string, tessera_fp string, mix_domain string, mix_epoch string, tessera_id string"


def table(spark):
    words = "der die und schön ist das alte haus am see".split()
    rows = [(i, " ".join(words[(i * k) % 9] + str(k % 3) * (k % 2) for k in range(40)) + f" nummer{i}", "de" if i % 3 else None, None if i % 4 == 0 else f"src{i % 7}", None, None, None, "e", None, None, "x", None, "y", None, *["t"] * 6) for i in range(60)]
    return spark.createDataFrame([*rows, rows[0], (None, "ein text ohne nummer ganz allein hier am see", None, None, *[None] * 16), (99, None, "de", "src1", *[None] * 16)], NAMES)


def test_columns_stay(spark):
    docs = table(spark)
    items = spark.createDataFrame([(1, "nichts davon steht irgendwo im text")], "item_id long, text string")
    outs = [langid.keep_known(docs, langid.train(docs), 0.3), neardup.keep_one(docs), decontam.decontaminate(docs, items), mixing.mix(docs, docs["source"], mixing.RECIPE, docs.columns).select("doc.*")]
    for out in outs:
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        rows = out.collect()
        assert rows and {r.epoch for r in rows} <= {"e", None}
    assert outs[0].where("text IS NULL").isEmpty() and outs[2].count() == docs.count()


def test_stages_on_nothing(spark, sf):
    docs = table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
