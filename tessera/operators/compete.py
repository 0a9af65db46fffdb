"""Features of a pair against its competitors: windows over the record and over the source-1 row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.kernels import logit, string_similarities


def others(value: Column, by: str, order: list, low: float = 0.0) -> tuple[Column, Column, Column]:
    """(rank, best, best of the others) within ``by``; alone, the others' best is ``low``."""
    w = Window.partitionBy(by)
    rank = F.row_number().over(w.orderBy(*order))
    best = F.max(value).over(w)
    second = F.lead(value).over(w.orderBy(*order))
    return rank, best, F.coalesce(F.when(rank == 1, second).otherwise(best), F.lit(low))


def competition(pred: DataFrame, low: float = 0.0) -> DataFrame:
    """(s1, rec, p, r_*, s_*): rank, margin to the best other, counts and sums of the others, by record and by s1.

    Windows of one key share one exchange and one order.
    """
    p = F.col("p")
    r_rank, r_best, r_other = others(p, "rec", [F.desc("p"), "s1"], low)
    s_rank, _, s_other = others(p, "s1", [F.desc("p"), "rec"], low)
    r, s = Window.partitionBy("rec"), Window.partitionBy("s1")
    out = pred.select("*", r_rank.alias("r_rank"), r_best.alias("r_best"), F.round(p - r_other, 6).alias("r_margin"), F.count_if(p > 0.1).over(r).alias("r_n01"), F.count_if(p > 0.5).over(r).alias("r_n05"))
    return out.select("*", s_rank.alias("s_rank"), s_other.alias("s_max_other"), F.round(F.sum("p").over(s) - p, 6).alias("s_sum_other"), (F.count_if(p > 0.5).over(s) - (p > 0.5).cast("long")).alias("s_n05_other"), F.count("*").over(s).alias("s_ncand"))


#: The score of a pair that a scorer has not seen.
UNSCORED = -20.0


def stage1(pred: DataFrame, scored: list[DataFrame]) -> DataFrame:
    """(s1, rec, p1, p1_logit, ce, ce_missing, ce_rank, ce_rec_best, ce_s1_npos, ..., ce_mean) of pairs and of scorers' logits.

    Each of ``scored`` is (s1, rec, ce) of some pairs; columns of the second and later ones end in
    ``_2``, ``_3``, ... Unscored pairs have ``UNSCORED`` and rank last; ``ce_mean`` is over the scorers that saw a pair.
    """
    p = F.col("p")
    out = pred.select("s1", "rec", p.alias("p1"), F.round(logit(p), 6).alias("p1_logit"))
    ends = [f"_{k + 1}" if k else "" for k in range(len(scored))]
    for end, d in zip(ends, scored):
        out = out.join(d.select("s1", "rec", F.col("ce").cast("double").alias("seen")), ["s1", "rec"], "left")
        out = out.withColumn(f"ce{end}", F.coalesce("seen", F.lit(UNSCORED))).withColumn(f"ce_missing{end}", F.col("seen").isNull().cast("int")).drop("seen")
    r, s = Window.partitionBy("rec"), Window.partitionBy("s1")
    out = out.select("*", *[x for e in ends for x in (F.row_number().over(r.orderBy(F.desc(f"ce{e}"), "s1")).alias(f"ce_rank{e}"), F.max(f"ce{e}").over(r).alias(f"ce_rec_best{e}"))])
    out = out.select("*", *[F.count_if(F.col(f"ce{e}") > 0).over(s).alias(f"ce_s1_npos{e}") for e in ends])
    if not scored:
        return out
    seen = sum((F.col(f"ce{e}") * (1 - F.col(f"ce_missing{e}")) for e in ends), F.lit(0.0))
    n = sum((1 - F.col(f"ce_missing{e}") for e in ends), F.lit(0))
    return out.withColumn("ce_mean", F.round(F.when(n > 0, seen / n).otherwise(UNSCORED), 6))


def level2(pred: DataFrame, sources: DataFrame, low: float = 0.0) -> DataFrame:
    """(s1, rec, q, q_logit, qr_*, qs_*, s_n2, s_n3): a pair's score against those of its record and of its source-1 row.

    Of the record: rank, best, margin, best other, counts and sum. Of the row: the same of the others,
    and how many others it wins (ranks first for, at over 0.5), of the same source and of others; and
    how many candidates of sources 2 and 3 it has. ``sources`` is (rec, source). Three exchanges: by
    record, by row, by row and source.
    """
    p = F.col("p")
    r, s, ss = Window.partitionBy("rec"), Window.partitionBy("s1"), Window.partitionBy("s1", "source")
    r_rank, r_best, r_other = others(p, "rec", [F.desc("p"), "s1"], low)
    d = pred.join(sources, "rec").select(
        "s1", "rec", "p", "source", r_rank.alias("qr_rank"), r_best.alias("qr_best"), r_other.alias("qr_other"),
        F.count_if(p > 0.5).over(r).alias("qr_n05"), F.count_if(p > 0.1).over(r).alias("qr_n01"), F.round(F.sum("p").over(r), 6).alias("qr_sum"),
    )
    d = d.withColumn("won", ((F.col("qr_rank") == 1) & (p > 0.5)).cast("long"))
    won = F.col("won")
    s_rank, _, s_other = others(p, "s1", [F.desc("p"), "rec"], low)
    rest = lambda x: (F.sum(x).over(s) - x).cast("long")
    d = d.select(
        "*", s_rank.alias("qs_rank"), s_other.alias("qs_max_other"), rest((p > 0.5).cast("long")).alias("qs_n05_other"), rest((p > 0.9).cast("long")).alias("qs_n09_other"), F.round(F.sum(p).over(s) - p, 6).alias("qs_sum_other"),
        F.count("*").over(s).alias("qs_ncand"), rest(won).alias("qs_won_other"), F.round(F.sum(won * p).over(s) - won * p, 6).alias("qs_wonsum_other"),
        F.count_if(F.col("source") == 2).over(s).alias("s_n2"), F.count_if(F.col("source") == 3).over(s).alias("s_n3"),
    )
    same = F.sum(won).over(ss) - won
    d = d.select("*", same.alias("qs_won_same_src")).withColumn("qs_won_other_src", F.col("qs_won_other") - F.col("qs_won_same_src"))
    return d.withColumn("q_logit", F.round(logit(p), 6)).withColumn("qr_margin", F.round(p - F.col("qr_other"), 6)).withColumnRenamed("p", "q").drop("source", "won")


def record_pairs(pred: DataFrame, norm: DataFrame) -> DataFrame:
    """(s1, rec, rr_q, rr_name_set, rr_name_ratio, rr_addr_set, rr_concat, rr_same_src) of a record and the best other of its row.

    Null where there is no other. Similarities are of 0 to 1, taken once for each two records.
    """
    side = lambda p, key: norm.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("core", "concat", "src")], F.array_join("comps", " ").alias(f"{p}_addr"))
    both = best_other_record(pred)
    each = both.where("other IS NOT NULL").select("rec", "other").distinct().join(side("a", "rec"), "rec").join(side("b", "other"), "other")
    sim = lambda x, kinds: string_similarities(F.col(f"a_{x}"), F.col(f"b_{x}"), kinds)
    each = each.select("rec", "other", sim("core", ("token_set", "ratio")).alias("name"), sim("addr", ("token_set",)).alias("addr"), sim("concat", ("ratio",)).alias("concat"), (F.col("a_src") == F.col("b_src")).cast("int").alias("rr_same_src"))
    out = both.join(each, ["rec", "other"], "left")
    r = lambda c: F.round(F.col(c), 6)
    return out.select("s1", "rec", F.col("q").alias("rr_q"), r("name.token_set").alias("rr_name_set"), r("name.ratio").alias("rr_name_ratio"), r("addr.token_set").alias("rr_addr_set"), r("concat.ratio").alias("rr_concat"), "rr_same_src")


def wins(pred: DataFrame, sources: DataFrame) -> DataFrame:
    """(s1, rec, won, ...): how many other records of the s1, of the same and of other sources, are won by it.

    A record is won where the s1 ranks first for it and p > 0.5. ``sources`` is (rec, source).
    """
    rank = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("p"), "s1"))
    won = pred.join(sources, "rec").withColumn("won", ((rank == 1) & (F.col("p") > 0.5)).cast("long"))
    s, ss = Window.partitionBy("s1"), Window.partitionBy("s1", "source")
    total, same = F.sum("won").over(s), F.sum("won").over(ss)
    return won.select("s1", "rec", "won", (total - F.col("won")).alias("won_other"), F.round(F.sum(F.col("won") * F.col("p")).over(s) - F.col("won") * F.col("p"), 6).alias("wonsum_other"), (same - F.col("won")).alias("won_same_src"), (total - same).alias("won_other_src"))


def best_other_record(pred: DataFrame) -> DataFrame:
    """(s1, rec, other, q): the best other record of the same s1; null where there is none."""
    by = Window.partitionBy("s1").orderBy(F.desc("p"), "rec")
    ranked = pred.withColumn("rn", F.row_number().over(by))
    firsts = ranked.where("rn <= 2").groupBy("s1").agg(F.max(F.when(F.col("rn") == 1, F.struct("rec", "p"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.struct("rec", "p"))).alias("b"))
    o = F.when(F.col("a.rec") == F.col("rec"), F.col("b")).otherwise(F.col("a"))
    return pred.join(firsts, "s1").select("s1", "rec", o["rec"].alias("other"), o["p"].alias("q"))


def context(pred: DataFrame) -> DataFrame:
    """(s1, rec, gap, cand_rank, n_candidates) of a source-1 row's candidates."""
    w = Window.partitionBy("s1")
    return pred.select("s1", "rec", F.round(F.max("p").over(w) - F.col("p"), 6).alias("gap"), F.dense_rank().over(w.orderBy(F.desc("p"))).cast("long").alias("cand_rank"), F.count("*").over(w).alias("n_candidates"))
