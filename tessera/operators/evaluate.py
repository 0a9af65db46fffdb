"""Scores of matches against truth, with every source-1 row in the denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("singleton_false_match", "fully_missed", "false_matches", "missed_matches")


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta: float = 0.5) -> Column:
    """1 where nothing is true and nothing predicted, 0 where only one is."""
    b = beta * beta
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0), 0.0).otherwise((1 + b) * tp / (b * n_true + n_pred))


def per_entity(ids: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(s1, tp, n_pred, n_true, f) of each of ``ids`` (s1); pairs count once."""
    t, p = truth.select("s1", "rec").distinct().withColumn("t", F.lit(1)), pred.select("s1", "rec").distinct().withColumn("p", F.lit(1))
    counts = t.join(p, ["s1", "rec"], "full_outer").groupBy("s1").agg(F.count(F.col("t") + F.col("p")).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    out = ids.select("s1").join(counts, "s1", "left").na.fill(0, ["tp", "n_pred", "n_true"])
    return out.withColumn("f", F.round(f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6))


def report(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Macro F, precision and recall, totals and the loss of each kind; an entity's loss goes to one kind; it is missed whole only where nothing is matched."""
    tp, n_pred, n_true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    kind = F.when((n_true == 0) & (n_pred > 0), KINDS[0]).when((n_true > 0) & (n_pred == 0), KINDS[1]).when(tp < n_pred, KINDS[2]).when(tp < n_true, KINDS[3])
    s = scores.withColumn("kind", kind)
    aggs = [
        F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("macro_f"),
        F.round(F.avg(F.when(n_pred > 0, tp / n_pred).otherwise(0.0)), 6).alias("macro_p"), F.round(F.avg(F.when(n_true > 0, tp / n_true).otherwise(0.0)), 6).alias("macro_r"),
        F.sum("tp").alias("tp"), F.sum(n_pred - tp).alias("fp"), F.sum(n_true - tp).alias("fn"),
        *[F.round(F.avg(F.when(F.col("kind") == k, 1 - F.col("f")).otherwise(0.0)), 6).alias(f"loss_{k}") for k in KINDS],
    ]
    return s.groupBy(by).agg(*aggs) if by else s.agg(*aggs)


def ceiling(ids: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The report of a perfect model on ``candidates``, and the share of true pairs they hold."""
    found = truth.select("s1", "rec").distinct().join(candidates.select("s1", "rec"), ["s1", "rec"], "left_semi")
    return report(per_entity(ids, truth, found)).withColumn("pair_recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6))


def blocking_report(norm: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, n_s1, n_rec, pairs, found, true_pairs, recall, per_record, reduction) by country."""
    sizes = norm.groupBy("country").agg(F.count_if(F.col("src") == 1).alias("n_s1"), F.count_if(F.col("src") > 1).alias("n_rec"))
    where = norm.select(F.col("id").alias("s1"), "country")
    pairs = candidates.join(where, "s1").groupBy("country").agg(F.count("*").alias("pairs"))
    hits = truth.join(candidates.select("s1", "rec", F.lit(1).alias("hit")), ["s1", "rec"], "left").join(where, "s1").groupBy("country").agg(F.count("hit").alias("found"), F.count("*").alias("true_pairs"))
    out = sizes.join(pairs, "country", "left").join(hits, "country", "left").na.fill(0, ["pairs", "found", "true_pairs"])
    return out.withColumns({
        "recall": F.round(F.try_divide("found", "true_pairs"), 6), "per_record": F.round(F.try_divide("pairs", "n_rec"), 6),
        "reduction": F.round(1 - F.try_divide(F.col("pairs"), F.col("n_s1") * F.col("n_rec")), 9),
    })


def cardinality_bins(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """(bin, n): source-1 rows by number of true matches."""
    n = F.coalesce("n", F.lit(0))
    counts = ids.select("s1").join(truth.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").select(n.alias("n"))
    name = F.when(F.col("n") <= 2, F.col("n").cast("string")).when(F.col("n") <= 5, "3-5").otherwise("6+")
    return counts.groupBy(name.alias("bin")).agg(F.count("*").alias("n"))


def sweep(best: DataFrame, ids: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """(t, macro_f): all thresholds of ``grid`` in one job.

    Each s1 gets its counts at every threshold from its own rows: those that are matched by nothing
    are added up once.
    """
    spark = best.sparkSession
    ts = spark.createDataFrame([(t,) for t in grid], "t double")
    flagged = best.select("s1", "rec", "p").join(truth.select("s1", "rec", F.lit(1).alias("hit")), ["s1", "rec"], "left")
    n_true = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    # The grid is a parameter, of a few hundred rows at most.
    at = flagged.join(F.broadcast(ts), F.col("p") >= F.col("t")).groupBy("t", "s1").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    f = at.join(n_true, "s1", "left").select("t", (f_beta(F.col("tp"), F.col("n_pred"), F.coalesce("n_true", F.lit(0))) - F.when(F.col("n_true").isNull(), 1.0).otherwise(0.0)).alias("gain"))
    base = ids.select("s1").join(n_true, "s1", "left").agg(F.count("*").alias("n"), F.count_if(F.col("n_true").isNull()).alias("singles"))
    sums = F.broadcast(ts).join(f.groupBy("t").agg(F.sum("gain").alias("gain")), "t", "left").crossJoin(F.broadcast(base))
    return sums.select("t", F.round((F.coalesce("gain", F.lit(0.0)) + F.col("singles")) / F.col("n"), 6).alias("macro_f"))


def pair_metrics(scored: DataFrame, t: float) -> DataFrame:
    """(tp, fp, fn, precision, recall, f05, log_loss) of ``scored`` (p, y) at a threshold."""
    hit, y = F.col("p") >= t, F.col("y") == 1
    c = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    a = scored.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.round(-F.avg(F.when(y, F.ln(c)).otherwise(F.ln(1 - c))), 6).alias("log_loss"))
    pr, rc = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return a.select("tp", "fp", "fn", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.try_divide(1.25 * F.col("tp"), 1.25 * F.col("tp") + F.col("fp") + 0.25 * F.col("fn")), 6).alias("f05"), "log_loss")


def validate(required: DataFrame, result: DataFrame, valid: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule of a result (s1, recs: comma list).

    missing, extra and duplicate s1; a record twice in a list; an s1 in its own list; unknown records;
    matches that are no candidates (a warning).
    """
    one = result.select(F.col("s1").cast("string").alias("s1"), F.coalesce("recs", F.lit("")).alias("recs"))
    need = required.select(F.col("s1").cast("string").alias("s1"))
    items = one.select("s1", F.explode(F.filter(F.split("recs", ","), lambda x: x != "")).alias("rec"))
    known = valid.select(F.col("rec").cast("string").alias("rec"))
    cand = candidates.select(F.col("s1").cast("string").alias("s1"), F.col("rec").cast("string").alias("rec"))
    rules = {
        "missing_s1": need.join(one, "s1", "left_anti"), "extra_s1": one.join(need, "s1", "left_anti"),
        "duplicate_s1": one.groupBy("s1").count().where("count > 1"), "duplicate_in_list": items.groupBy("s1", "rec").count().where("count > 1"),
        "self_match": items.where("s1 = rec"), "unknown_record": items.join(known, "rec", "left_anti"), "not_a_candidate": items.join(cand, ["s1", "rec"], "left_anti"),
    }
    out = None
    for name, rows in rules.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def sweep_rules(flagged: DataFrame, keep: Column, grid: DataFrame, names: list[str], ids: DataFrame, truth: DataFrame) -> DataFrame:
    """(part, names..., macro_f): every row of a bounded ``grid`` of parameters, in each part, in one job.

    ``flagged`` is (s1, part, hit, ...) of the best pairs, ``keep`` says over a pair and a grid row
    whether the pair is a match, ``ids`` is (s1, part). What is matched by nothing is added up once.
    """
    n_true = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    at = flagged.join(F.broadcast(grid), keep).groupBy(*names, "part", "s1").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    gain = f_beta(F.col("tp"), F.col("n_pred"), F.coalesce("n_true", F.lit(0))) - F.when(F.col("n_true").isNull(), 1.0).otherwise(0.0)
    gains = at.join(n_true, "s1", "left").select(*names, "part", gain.alias("gain")).groupBy(*names, "part").agg(F.sum("gain").alias("gain"))
    base = ids.join(n_true, "s1", "left").groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("n_true").isNull()).alias("singles"))
    every = base.select("*", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in grid.collect()])).alias("g")).select("part", "n", "singles", "g.*")
    return every.join(gains, [*names, "part"], "left").select("part", *names, F.round((F.coalesce("gain", F.lit(0.0)) + F.col("singles")) / F.col("n"), 6).alias("macro_f"))


def best_of(swept: DataFrame, names: list[str]) -> DataFrame:
    """The best parameters of each part; ties go to the smaller values."""
    from pyspark.sql import Window

    by = Window.partitionBy("part").orderBy(F.desc("macro_f"), *names)
    return swept.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")
