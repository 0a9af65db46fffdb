import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking as B
from tessera.operators import compete as C
from tessera.operators import decide as D
from tessera.operators import evaluate as E
from tessera.operators import models as M
from tessera.plans import catalogue
from tessera.sources import entities as S
from tessera.streaming.link import link_stream


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1 long, rec long")


@pytest.mark.parametrize("n,truth,pred,want", [(1, [(0, 47), (0, 812)], [(0, 47), (0, 193), (0, 812)], 0.714286), (1, [], [], 1.0), (1, [], [(0, 5)], 0.0), (1, [(0, 5)], [], 0.0), (3, [(0, 1), (2, 3)], [(0, 1)], 0.666667)])
def test_macro_f(spark, n, truth, pred, want):
    ids = spark.range(n).withColumnRenamed("id", "s1")
    r = E.report(E.per_entity(ids, pairs(spark, truth), pairs(spark, pred))).first()
    assert r.macro_f == want
    if n == 3:
        assert r.loss_fully_missed == 0.333333


def test_validator_names_each_fault(spark):
    need, valid = spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string"), spark.createDataFrame([("r1",), ("r2",)], "rec string")
    result = spark.createDataFrame([("a", "r1,r1,a"), ("b", ""), ("b", "r2"), ("x", "zz")], "s1 string, recs string")
    got = {r.rule: r.n for r in E.validate(need, result, valid, spark.createDataFrame([("a", "r1")], "s1 string, rec string")).collect()}
    assert got == {"missing_s1": 1, "extra_s1": 1, "duplicate_s1": 1, "duplicate_in_list": 1, "self_match": 1, "unknown_record": 2, "not_a_candidate": 3}


def scored(spark, rows):
    return spark.createDataFrame(rows, "s1 long, rec long, p double")


def test_rules(spark):
    p = scored(spark, [(1, 10, 0.9), (2, 10, 0.4), (1, 11, 0.6), (2, 11, 0.6), (2, 12, 0.3)])
    best = {(r.s1, r.rec): r.margin for r in D.best_per_record(p).collect()}
    assert best == {(1, 10): 0.5, (1, 11): 0.0, (2, 12): 0.3}
    params = spark.createDataFrame([("US", 0.8, 0.5, 0.1), (None, 0.2, 0.2, 0.0)], "part string, t_base double, t_low double, lead double")
    parts = spark.createDataFrame([(1, "US"), (2, "France")], "s1 long, part string")
    assert {(r.s1, r.rec) for r in D.margin_rule(D.best_per_record(p), parts, params).collect()} == {(1, 10), (2, 12)}
    src = spark.createDataFrame([(10, 2), (11, 2), (12, 3)], "rec long, source int")
    assert {(r.s1, r.rec) for r in D.one_per_source(p, src).collect()} == {(1, 10), (2, 12)}


def test_expected_f_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(s, 100 * s + k, round(rng.random() ** 2, 3)) for s in range(40) for k in range(rng.randrange(1, 6))]
    got = {(r.s1, r.rec) for r in D.expected_f(scored(spark, rows).withColumn("margin", F.lit(0.0))).collect()}
    want = set()
    for s in range(40):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))
        total, none = sum(r[2] for r in own), 1.0
        for r in own:
            none *= 1 - min(r[2], 1 - 1e-7)
        efs = [1.25 * sum(r[2] for r in own[: k + 1]) / (0.25 * total + k + 1) for k in range(len(own))]
        k = efs.index(max(efs))
        if efs[k] > none:
            want |= {(r[0], r[1]) for r in own[: k + 1]}
    assert got == want


def test_cap_counts_the_left_side(spark):
    left = spark.createDataFrame([(i, "x", ["k"]) for i in range(3)] + [(9, "x", ["j", "j"])], "id long, country string, v array<string>")
    right = spark.createDataFrame([(100, "x", ["k", "j"]), (101, "y", ["j"])], "id long, country string, v array<string>")
    spec = lambda cap: [B.KeySpec(4, "v", cap, F.col("v"), F.col("v"))]
    assert {(r.s1, r.rec) for r in B.capped_key_join(left, right, spec(2)).collect()} == {(9, 100)}
    full = {(r.s1, r.rec): (r["keys"], r.kscore) for r in B.capped_key_join(left, right, spec(3)).collect()}
    assert full == {(0, 100): (4, 0.333333), (1, 100): (4, 0.333333), (2, 100): (4, 0.333333), (9, 100): (4, 1.0)}


def test_candidates_reach_all_equal_texts(spark):
    sf = "/root/testdata/sf0.01"
    assert catalogue.eval_ceiling(spark, sf).first().pair_recall > 0.8


def test_competition_of_a_lone_row(spark):
    (r,) = C.competition(scored(spark, [(1, 2, 0.7)])).collect()
    assert (r.r_rank, r.r_margin, r.s_rank, r.s_max_other, r.s_ncand) == (1, 0.7, 1, 0.0, 1)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", 'a "quoted', "x, y", "US"), ("S1-2", "b", "", "India")], S.SOURCE)
    df.write.csv(f"{tmp_path}/src", sep="\t", quote="", header=True, emptyValue="", nullValue="")
    assert sorted(map(tuple, S.read_source(spark, f"{tmp_path}/src").collect())) == sorted(map(tuple, df.collect()))
    assert S.read_source(spark, f"{tmp_path}/src", head=1).count() == 1
    lists = S.result_lists(spark.createDataFrame([("a",), ("b",)], "s1 string"), spark.createDataFrame([("a", "r2"), ("a", "r1"), ("a", "r1")], "s1 string, rec string"))
    S.write_lists(lists, f"{tmp_path}/out")
    assert sorted(map(tuple, S.read_truth(spark, f"{tmp_path}/out").collect())) == [("a", "r1"), ("a", "r2")]
    calls = []
    build = lambda: calls.append(1) or spark.range(3).toDF("x")
    assert [S.cached(spark, f"{tmp_path}/c", build).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    S.write_json(spark, {"t": 0.5}, f"{tmp_path}/j")
    assert S.read_json(spark, f"{tmp_path}/j") == {"t": 0.5}
    S.write_parts(spark.range(10), f"{tmp_path}/p", 2)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 10


def test_models(spark):
    rows = [(i % 40, 1000 + i, (i % 7) / 7.0, (i * 3 % 11) / 11.0, int(i % 7 > 3)) for i in range(400)]
    d = spark.createDataFrame(rows, "s1 long, rec long, a double, b double, y int")
    scored_ = M.cross_fit(d, ["a", "b"])
    assert scored_.count() == 400
    hit = scored_.select(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.97
    assert scored_.groupBy("s1").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert M.sample_strata(d, ["y"], 5, "rec").groupBy("y").count().where("count <> 5").isEmpty()
    kept = M.sample_negatives(d, 0.5)
    assert kept.where("y = 1").count() == d.where("y = 1").count() and kept.where("y = 0").agg(F.min("weight")).first()[0] == 2.0


def test_stream_links_each_batch_once(spark, tmp_path):
    static = spark.createDataFrame([(1, "x", ["k"]), (2, "x", ["j"])], "id long, country string, v array<string>")
    spec = [B.KeySpec(1, "v", 10, F.col("v"), F.col("v"))]
    spark.createDataFrame([(10, "x", ["k"]), (11, "x", ["j", "k"])], "id long, country string, v array<string>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(static.schema).parquet(f"{tmp_path}/in")
    q = link_stream(stream, lambda rows: B.capped_key_join(static, rows, spec), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert {(r.s1, r.rec) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 10), (1, 11), (2, 11)}


def test_ties_round_as_in_sql(spark):
    """Half of a sixth digit: the shortest decimal of the sum ends in 5, its binary value is below that."""
    tokens = spark.createDataFrame([(1, 2, 0.333333), (1, 3, 1.0)], "s1 long, rec long, token double")
    cosines = spark.createDataFrame([(1, 2, 0.348021)], "s1 long, rec long, cos double")
    got = {r.rec: r.score for r in B.union_candidates(tokens, cosines, "fused", 80).collect()}
    assert got == dict(duckdb.sql("SELECT 2, round(0.5 * 0.333333::DOUBLE + 0.348021::DOUBLE, 6) UNION ALL SELECT 3, 0.5::DOUBLE").fetchall()) == {2: 0.514687, 3: 0.5}
