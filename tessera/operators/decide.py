"""Which pairs are matches: one best source-1 row for a record, then a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_record(pred: DataFrame) -> DataFrame:
    """(s1, rec, p, margin): the best s1 of each record (ties: smaller s1) and its lead over the next, p where alone."""
    by = Window.partitionBy("rec").orderBy(F.desc("p"), "s1")
    ranked = pred.withColumn("rn", F.row_number().over(by)).withColumn("next", F.lead("p").over(by))
    return ranked.where("rn = 1").select("s1", "rec", "p", F.round(F.col("p") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"))


def threshold(best: DataFrame, t: float) -> DataFrame:
    return best.where(F.col("p") >= t)


def margin_rule(best: DataFrame, parts: DataFrame, params: DataFrame) -> DataFrame:
    """Keep p >= t_base, or p >= t_low with a margin of ``lead``; ``params`` is (part, t_base, t_low, lead), part null for the default."""
    default = params.where("part IS NULL").select(*[F.col(c).alias(f"d_{c}") for c in ("t_base", "t_low", "lead")])
    own = best.join(parts, "s1", "left").join(params.where("part IS NOT NULL"), "part", "left").crossJoin(F.broadcast(default.limit(1)))
    v = lambda c: F.coalesce(c, f"d_{c}")
    return own.where((F.col("p") >= v("t_base")) | ((F.col("p") >= v("t_low")) & (F.col("margin") >= v("lead")))).select(*best.columns)


def expected_f(best: DataFrame) -> DataFrame:
    """Of each s1 the k best records that maximise the expected F0.5, none where no match is likelier.

    With S_k the sum of the k best p and N of all: 1.25 S_k / (0.25 N + k); the first k of the largest
    value, if that exceeds the product of 1 - p.
    """
    by = Window.partitionBy("s1")
    order = by.orderBy(F.desc("p"), "rec")
    none = F.exp(F.sum(F.ln(1 - F.least(F.col("p"), F.lit(1 - 1e-7)))).over(by))
    w = best.select("*", F.row_number().over(order).alias("k"), F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("p").over(by).alias("total"), none.alias("none"))
    w = w.withColumn("ef", F.round(1.25 * F.col("upto") / (0.25 * F.col("total") + F.col("k")), 9))
    top = F.max(F.struct("ef", (-F.col("k")).alias("k"))).over(by)
    return w.withColumn("top", top).where((F.col("k") <= -F.col("top.k")) & (F.col("top.ef") > F.round("none", 9))).select(*best.columns)


def two_thresholds(best: DataFrame, parts: DataFrame, params: DataFrame) -> DataFrame:
    """Keep an s1's top record from t1 on and its others from t2 on; ``params`` is (part, t1, t2), part null for the default."""
    default = params.where("part IS NULL").select(F.col("t1").alias("d1"), F.col("t2").alias("d2"))
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "rec"))
    own = best.withColumn("rank", rank).join(parts, "s1", "left").join(params.where("part IS NOT NULL"), "part", "left").crossJoin(F.broadcast(default.limit(1)))
    least = F.when(F.col("rank") == 1, F.coalesce("t1", "d1")).otherwise(F.coalesce("t2", "d2"))
    return own.where(F.col("p") >= least).select(*best.columns)


def one_per_source(pred: DataFrame, sources: DataFrame) -> DataFrame:
    """(s1, rec, p): one s1 for a record, then of what is left one record of each source for an s1."""
    best = best_per_record(pred).select("s1", "rec", "p").join(sources, "rec")
    by = Window.partitionBy("s1", "source").orderBy(F.desc("p"), "rec")
    return best.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("s1", "rec", "p")


def by_size(best: DataFrame, small: float, large: float, size: int = 1) -> DataFrame:
    """A threshold for an s1 of at most ``size`` candidate records, another for the rest."""
    n = F.count("*").over(Window.partitionBy("s1"))
    return best.withColumn("n", n).where(F.col("p") >= F.when(F.col("n") <= size, small).otherwise(large)).select(*best.columns)


def shortlist(pred: DataFrame, least: float = 0.01, k: int = 3) -> DataFrame:
    """(s1, rec, p, rank): the pairs worth a dearer score."""
    by = Window.partitionBy("rec").orderBy(F.desc("p"), "s1")
    return pred.withColumn("rank", F.row_number().over(by).cast("long")).where((F.col("p") >= least) & (F.col("rank") <= k))
