"""Queries that SQL cannot say, against direct computation on collected rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import blocking as B
from tessera.operators import evaluate as E
from tessera.operators import models as M
from tessera.operators import normalize as N
from tessera.plans import catalogue as C


@pytest.fixture(scope="module")
def rows(spark, sf):
    return {r.id: r for r in C.norm(spark, sf).collect()}


def test_metaphones_and_transliteration(spark, sf, rows):
    words = {w for r in rows.values() for w in r.core_tok}
    assert {(r.tok, r.code) for r in C.text_metaphone(spark, sf).collect()} == {(w, K.sound(w)) for w in words}
    got = {r.id: r.latin for r in C.text_transliterate(spark, sf).collect()}
    assert got == {i: r.name for i, r in rows.items()}
    assert all(K.sound(w).isupper() or not K.sound(w) or "0" in K.sound(w) for w in words)


def joined(left, right, caps, keep, more=()):
    """The capped key join, row by row; keys are (id, country, bit, key)."""
    held, n, score, bits = defaultdict(list), Counter(), defaultdict(float), defaultdict(int)
    for i, country, bit, key in set(left):
        held[country, bit, key].append(i)
    best = {}
    for rec, country, bit, key in set(right):
        own = held.get((country, bit, key), [])
        if len(own) <= caps[bit]:
            for s1 in own:
                best[s1, rec, bit] = min(best.get((s1, rec, bit), 10**9), len(own))
    for (s1, rec, bit), n in best.items():
        score[s1, rec] += 1 / n
        bits[s1, rec] += bit
    for s1, rec, bit, weight in more:
        score[s1, rec] += weight
        bits[s1, rec] += bit
    by = defaultdict(list)
    for (s1, rec), v in score.items():
        by[rec].append((-round(v, 6), s1))
    return {(s1, rec, bits[s1, rec], -v) for rec, own in by.items() for v, s1 in sorted(own)[:keep]}


def test_all_keys_together(spark, sf):
    parts = B.add_sounds(C.key_parts(spark, sf)).persist()
    specs = [*B.standard_specs(), *B.french_specs()]
    sides = [[(r.id, r.country, r.bit, r.key) for r in B.keyed(d, specs, side).collect()] for d, side in ((C.one(parts), "left"), (C.rest(parts), "right"))]
    more = [(r.s1, r.rec, 8192, r.cos) for r in B.tfidf_knn(C.one(parts), C.no_numbers(C.rest(parts)), C.padded_grams()).collect()]
    assert more and {b for side in sides for _, _, b, _ in side} >= {1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 16384, 32768, 65536}
    # What a metaphone key is made of, word by word.
    one = [r for r in parts.collect() if r.src == 1]
    assert {x for x in sides[0] if x[2] == 16} == {(r.id, r.country, 16, f"{n}|{K.sound(t)}") for r in one for n in r.nums for t in r.rare if t.isascii() and t.isalpha() and len(t) >= 3 and K.sound(t)}
    want = joined(*sides, {s.bit: s.cap for s in specs}, 50, more)
    got = {(r.s1, r.rec): (r["keys"], r.kscore) for r in C.keys_all(spark, sf).collect()}
    want = {(a, b): (k, v) for a, b, k, v in want}
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in want.items()}
    assert all(got[p][1] == pytest.approx(v, abs=2e-6) for p, (_, v) in want.items())
    sounds = {(r.s1, r.rec, r["keys"]) for r in C.keys_metaphone(spark, sf).collect()}
    assert sounds == {w[:3] for w in joined([x for x in sides[0] if x[2] == 16], [x for x in sides[1] if x[2] == 16], {16: 100}, 50)}
    parts.unpersist()


def test_street_keys(spark):
    df = spark.createDataFrame([(["043 rue de la paix", "75002 paris"],), (["43 rue jean bedouret"],), (["rue des lilas", "no 7 bis rue x"],), (["lilas blanc"],)], "parts array<string>").withColumn("ad", F.array_join("parts", " "))
    got = df.select(*[c.alias(n) for c, n in zip(B.french_streets(F.col("ad"), F.col("parts")), "abc")], B.number_words(F.col("ad")).alias("d")).collect()
    assert [tuple(r)[:3] for r in got] == [(["43 paix", "75002 paris"], ["paix", "paris"], ["43 paix", "75002 paris"]), (["43 jean"], ["jean", "bedouret"], ["43 bedouret"]), (["7 rue"], ["lilas"], []), ([], [], [])]
    assert [r.d for r in got] == [["43 rue", "75002 paris"], ["43 rue"], ["7 bis"], []]
    names = spark.createDataFrame([(["new town of york city", "12 x", "ab", "saint village"],)], "p array<string>").select(B.place_names(F.col("p")).alias("v")).first().v
    assert names == ["new york"]


def test_strings(spark, sf):
    sides = C.profiled(spark, sf).collect()
    got = {(r.s1, r.rec): r for r in C.features_more_strings(spark, sf).collect()}
    assert len(got) == len(sides)
    best = lambda f, *pairs: max(f(a or "", b or "") for a, b in pairs)
    for r in sides[::7]:
        g, names = got[r.s1, r.rec], [(r.s_core, r.r_alias), (r.s_alias, r.r_core), (r.s_alias, r.r_alias)]
        want = [best(K.token_set, *names), best(K.ratio, *names), best(K.ratio, (r.s_concat, r.r_concat)), best(K.partial, (r.s_concat, r.r_concat)), best(K.token_set, (r.s_ad, r.r_ad)), best(K.ratio, (r.s_ad, r.r_ad)), best(K.partial, (r.s_ad, r.r_ad)), best(K.ratio, (r.s_city, r.r_city)), best(K.ratio, (r.s_street, r.r_street))]
        assert [g.n_alias_set, g.n_alias_ratio, g.n_cat_ratio, g.n_cat_partial, g.a_token_set, g.a_ratio, g.a_partial, g.a_city_ratio, g.a_street_ratio] == pytest.approx(want, abs=1e-6)
        assert g.n_best == pytest.approx(max(K.token_set(r.s_core, r.r_core), want[0], want[2]), abs=1e-6)
    old = {(r.s1, r.rec): r for r in C.features_strings(spark, sf).collect()}
    for r in sides[::11]:
        g = old[r.s1, r.rec]
        assert [g[f"n_{n}"] for n in K.KERNELS] == pytest.approx([f(r.s_core, r.r_core) for f in K.KERNELS.values()], abs=1e-6)


def test_records_of_a_row(spark, sf, rows):
    pred = [(r.s1, r.rec, r.p) for r in C.pred(spark, sf).collect() if r.p > 0.01]
    by = defaultdict(list)
    for s1, rec, p in pred:
        by[s1].append((-p, rec))
    got = {(r.s1, r.rec): r for r in C.compete_records(spark, sf).collect()}
    assert len(got) == len(pred)
    for s1, rec, _ in pred:
        other = next(((q, o) for q, o in sorted(by[s1]) if o != rec), None)
        g = got[s1, rec]
        if other is None:
            assert g.rr_q is None and g.rr_name_set is None
            continue
        a, b = rows[rec], rows[other[1]]
        assert (g.rr_q, g.rr_same_src) == (-other[0], int(a.src == b.src))
        assert [g.rr_name_set, g.rr_name_ratio, g.rr_addr_set, g.rr_concat] == pytest.approx([K.token_set(a.core, b.core), K.ratio(a.core, b.core), K.token_set(" ".join(a.comps), " ".join(b.comps)), K.ratio(a.concat, b.concat)], abs=1e-6)


def test_scorers_and_encoders(spark, sf, rows):
    got = C.model_pair_scorer(spark, sf).collect()
    text = {i: " | ".join((r.name, r.address)) for i, r in rows.items()}
    assert len(got) == C.candidates(C.norm(spark, sf)).count()
    assert [r.ce for r in got] == pytest.approx(M.shared_words([(text[r.s1], text[r.rec]) for r in got]).tolist())
    for r in C.model_text_encoder(spark, sf).collect():
        v = M.hashed_words([rows[r.id].name])[0]
        assert r.vec == pytest.approx((v / np.sqrt(v @ v)).tolist())
    odd = M.encode_texts(spark.createDataFrame([(1, None), (2, ""), (3, "a a")], "id int, text string"), M.hashed_words).collect()
    assert {r.id: r.vec is None for r in odd} == {1: True, 2: True, 3: False}


def test_shared_values_lose_no_link(spark):
    left = spark.createDataFrame([(i, "x", ["7", "7"]) for i in range(300)] + [(300, "y", ["7"]), (301, "x", [])], "id long, country string, v array<string>")
    right = spark.createDataFrame([(1000 + i, "x", ["7", str(i)]) for i in range(200)], "id long, country string, v array<string>")
    classes = B.shared_values(left, right, F.col("v"))
    assert classes.count() == 500 and classes.agg(F.sum(F.when(F.col("side") == 1, F.col("links")))).first()[0] == 300 * 200
    assert B.value_pairs(classes).count() == 300 * 200


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_VECTORS", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5)).round(2)
    v[3] = 0
    v[9] = v[8]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vec array<double>")
    got = {(r.s1, r.rec, r.rn): r.cos for r in B.vector_knn(d.where("id % 4 = 0"), d, 3).collect()}
    size = np.sqrt((v * v).sum(axis=1))
    for q in range(0, 40, 4):
        near = sorted((-round(float(v[q] @ v[j] / size[q] / size[j]), 6), j) for j in range(40) if j not in (q, 3))[:3]
        for k, (c, j) in enumerate(near):
            assert got[q, j, k + 1] == pytest.approx(-c, abs=1e-6)
    assert len(got) == 30


def test_loss_kinds(spark):
    rows = [(1, 0, 2, 0), (2, 0, 0, 2), (3, 0, 2, 2), (4, 1, 2, 1), (5, 1, 1, 2), (6, 1, 1, 1)]
    scores = spark.createDataFrame([(*r, 0.5 if r[0] < 6 else 1.0) for r in rows], "s1 long, tp long, n_pred long, n_true long, f double")
    r = E.report(scores).first()
    assert [r[f"loss_{k}"] for k in E.KINDS] == pytest.approx([0.5 / 6, 0.5 / 6, 1.0 / 6, 0.5 / 6], abs=1e-6)


def test_integrity_tells_what_is_lost(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "id int") for v in ([1, 2, 2, 3], [2, 3, 3, 4]))
    assert tuple(N.row_integrity(a, b).first()) == (4, 4, 2, 2)


def test_halves_are_averaged(spark, sf):
    """The mean of the two models, each fitted and applied by itself."""
    d = C.labelled(spark, sf)
    train, target = d.where("s1 % 2 = 0"), d.where("s1 % 2 = 1")
    got = {(r.s1, r.rec): r.p for r in M.half_average(train, target, C.FEATURES).collect()}
    marked = train.withColumn("fold", M.fold("s1", 2))
    halves = [{(r.s1, r.rec): r.p for r in M.fit(M.sample_negatives(marked.where(F.col("fold") != k), 1.0), C.FEATURES)[1](target).collect()} for k in (0, 1)]
    assert set(got) == set(halves[0]) and all(p == pytest.approx((halves[0][k] + halves[1][k]) / 2) for k, p in got.items())
    assert len({round(p, 6) for p in got.values()}) > 1


def test_tfidf_neighbours_in_blocks(spark, monkeypatch):
    """By direct computation, with blocks of a few bags, many copies, ids that recur and rows without a gram; no pair is joined."""
    monkeypatch.setattr(B, "INDEX_BAGS", 20, raising=False)
    monkeypatch.setattr(B, "QUERY_BAGS", 15, raising=False)
    rng = np.random.default_rng(3)
    row = lambda i: (i, "xy"[int(rng.integers(2))], [str(g) for g in rng.integers(0, 9, int(rng.integers(0, 6)))])
    left = [row(i) for i in range(60)] + [(100 + i, "x", ["1", "2"]) for i in range(9)] + [(3, "y", ["4"]), (200, None, ["1"]), (201, "x", [None, "5"])]
    right = [row(1000 + i) for i in range(40)] + [(1100 + i, "x", ["2", "1", "1"]) for i in range(5)] + [(1005, "x", ["7", "8"]), (1200, "y", [])]
    n = Counter(c for _, c, _ in left)
    tf = [Counter((i, c, g) for i, c, gs in side for g in gs if c and g) for side in (left, right)]
    df = Counter((c, g) for _, c, g in tf[0])
    idf = {(c, g): np.log((1 + n[c]) / (1 + v)) + 1 for (c, g), v in df.items() if 2 <= v <= 0.6 * n[c]}
    vectors = [defaultdict(dict), defaultdict(dict)]
    for side, counts in zip(vectors, tf):
        for (i, c, g), v in counts.items():
            if (c, g) in idf:
                side[i][c, g] = (1 + np.log(v)) * idf[c, g]
    unit = [{i: {f: w / np.sqrt(sum(x * x for x in v.values())) for f, w in v.items()} for i, v in side.items()} for side in vectors]
    want = {}
    for rec, v in unit[1].items():
        near = sorted((-round(sum(w * u[f] for f, w in v.items() if f in u), 6), s1) for s1, u in unit[0].items())
        want |= {(s1, rec): (-c, k + 1) for k, (c, s1) in enumerate([x for x in near if x[0] <= -0.3][:7])}
    schema = "id long, country string, g array<string>"
    found = B.tfidf_knn(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), F.col("g"), 7, 2, 0.6, 0.3)
    got = {(r.s1, r.rec): (r.cos, r.rn) for r in found.collect()}
    assert {p: k for p, (_, k) in got.items()} == {p: k for p, (_, k) in want.items()}
    assert all(got[p][0] == pytest.approx(c, abs=1e-6) for p, (c, _) in want.items())
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_an_ensemble_computes_its_pairs_once(spark, sf):
    """The mean of the two kinds, each by itself; neither a fit nor a score goes back to the documents."""
    d = C.labelled(spark, sf)
    assert d.storageLevel.useDisk and not d.storageLevel.useMemory
    each = [{(r.s1, r.rec): r.p for r in M.cross_fit(d, C.FEATURES, kind=k).collect()} for k in ("gbt", "forest")]
    found = C.model_ensemble(spark, sf)
    assert "InMemoryTableScan" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.s1, r.rec): r.p for r in found.collect()}
    assert set(got) == set(each[0]) == set(each[1]) and got
    assert all(p == pytest.approx((each[0][k] + each[1][k]) / 2, abs=1e-6) for k, p in got.items())
