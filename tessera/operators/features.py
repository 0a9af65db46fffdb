"""Features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions import text as X
from tessera.operators.blocking import address_tokens

SIDE = ("country", "core", "alias", "core_tok", "alias_tok", "concat", "comps", "nums", "hnum", "street", "addr_empty", "is_web", "has_alias", "src")


def both_sides(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """``pairs`` (s1, rec, ...) with the columns of both rows as s_* and r_*."""
    side = lambda p, key: norm.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in SIDE])
    return pairs.join(side("s", "s1"), "s1").join(side("r", "rec"), "rec")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def pair_features(sides: DataFrame) -> DataFrame:
    """(s1, rec, ...): native string, set, number and structure features; missing values give 0, or -1 where told."""
    c = F.col
    r_all = F.array_distinct(F.concat("r_core_tok", "r_alias_tok"))
    near = lambda i, j: K.edit_distance(F.get("s_nums", F.lit(i)), F.get("r_nums", F.lit(j)))
    distances = F.array(*[near(i, j) for i in range(3) for j in range(3)])
    best = F.coalesce(F.array_min(F.filter(distances, lambda x: x >= 0)), F.lit(-1))
    a, b = c("s_hnum"), c("r_hnum")
    affix = lambda x, y: (F.length(x) == F.length(y) + 1) & ((F.substring(x, F.lit(2), F.length(y)) == y) | (F.left(x, F.length(y)) == y))
    number = lambda x: F.left(x, F.lit(9)).try_cast("long")
    return sides.select(
        "s1", "rec",
        F.round(K.levenshtein_similarity(c("s_core"), c("r_core")), 6).alias("n_lev"),
        F.round(K.levenshtein_similarity(c("s_concat"), c("r_concat")), 6).alias("n_cat_lev"),
        F.round(K.dice(c("s_core"), c("r_core")), 6).alias("n_dice"),
        F.round(K.length_ratio(c("s_core"), c("r_core")), 6).alias("n_len_diff"),
        F.size(F.array_intersect("s_core_tok", r_all)).cast("long").alias("n_tok_inter"),
        F.round(K.jaccard(c("s_core_tok"), r_all), 6).alias("n_tok_jacc"),
        F.round(K.containment(c("s_core_tok"), c("r_core_tok")), 6).alias("n_contain"),
        flag(F.get("s_core_tok", F.lit(0)) == F.get("r_core_tok", F.lit(0))).alias("n_first_eq"),
        F.size("s_core_tok").cast("long").alias("n_len_s1"), F.size("r_core_tok").cast("long").alias("n_len_rec"),
        F.size(F.array_intersect("s_nums", "r_nums")).cast("long").alias("num_inter"),
        F.round(K.jaccard(c("s_nums"), c("r_nums")), 6).alias("num_jacc"),
        flag((F.size("s_nums") > 0) & (F.size("r_nums") > 0) & ~F.arrays_overlap("s_nums", "r_nums")).alias("num_conflict"),
        flag(a == b).alias("hnum_eq"), F.greatest(flag(F.array_contains("r_nums", a)), flag(F.array_contains("s_nums", b))).alias("hnum_in_other"),
        flag(c("s_street") == c("r_street")).alias("street_eq"),
        F.size(F.array_intersect("s_comps", "r_comps")).cast("long").alias("comp_overlap"),
        flag(c("s_addr_empty")).alias("a_empty_s1"), flag(c("r_addr_empty")).alias("a_empty_rec"),
        c("r_src").alias("source"), flag(c("r_is_web")).alias("is_web"), flag(c("r_has_alias")).alias("has_alias"),
        K.edit_distance(a, b).cast("long").alias("hn_ed"), best.cast("long").alias("hn_best_ed"), flag(affix(a, b) | affix(b, a)).alias("hn_affix"),
        F.coalesce(F.round(F.abs(number(a) - number(b)) / F.greatest(number(a), number(b), F.lit(1)), 6), F.lit(-1.0)).alias("hn_reldiff"),
        flag(F.length(a) == F.length(b)).alias("hn_same_len"),
        flag(K.initials_match(c("s_concat"), X.initials(c("r_core_tok"))) | K.initials_match(c("r_concat"), X.initials(c("s_core_tok")))).alias("initials"),
    )


def idf_overlap(sides: DataFrame, freq: DataFrame, sizes: DataFrame, left: str, right: str) -> DataFrame:
    """(s1, rec, idf_inter, idf_jacc, min_shared_f) of two token arrays, by frequencies of a country.

    idf = ln(N / f). Nothing shared: 0, 0 and 1e7.
    """
    flagged = sides.select("s1", "rec", F.col("s_country").alias("country"), F.array_union(left, right).alias("u"), F.array_intersect(left, right).alias("i"))
    toks = flagged.select("s1", "rec", "country", "i", F.explode_outer("u").alias("tok")).withColumn("shared", F.coalesce(F.array_contains("i", F.col("tok")), F.lit(False)))
    valued = toks.join(freq, ["country", "tok"], "left").join(sizes, "country", "left").withColumn("idf", F.ln(F.col("n") / F.col("freq")))
    total = F.sum("idf")
    return valued.groupBy("s1", "rec").agg(
        F.round(F.coalesce(F.sum(F.when(F.col("shared"), F.col("idf"))), F.lit(0.0)), 6).alias("idf_inter"),
        F.round(F.when(total > 0, F.coalesce(F.sum(F.when(F.col("shared"), F.col("idf"))), F.lit(0.0)) / total).otherwise(0.0), 6).alias("idf_jacc"),
        F.coalesce(F.min(F.when(F.col("shared"), F.col("freq"))), F.lit(10_000_000)).cast("long").alias("min_shared_f"),
    )


def string_features(sides: DataFrame) -> DataFrame:
    """(s1, rec, ...): the kernels that need Python, in one hop over distinct pairs of names."""
    names = sides.select("s_core", "r_core").distinct().withColumn("k", K.string_similarities(F.col("s_core"), F.col("r_core")))
    joined = sides.select("s1", "rec", "s_core", "r_core").join(names, ["s_core", "r_core"])
    return joined.select("s1", "rec", *[F.round(F.col(f"k.{n}"), 6).alias(f"n_{n}") for n in K.KERNELS])


PROFILE = ("country", "core", "alias", "concat", "core_tok", "alias_tok", "street", "is_indic", "region_raw", "city", "rest", "ad", "ad_tok", "rare1", "rare1_freq", "name_freq", "addr_freq")


def profile(norm: DataFrame, regions: DataFrame, freq: DataFrame) -> DataFrame:
    """``norm`` with the split address, the rarest name token, and how many rows share a name and an address.

    ``regions`` is that of ``split_region``, ``freq`` (country, tok, freq) of name tokens.
    """
    rare = norm.select("id", "country", F.explode(F.array_distinct("core_tok")).alias("tok")).join(freq, ["country", "tok"]).groupBy("id").agg(F.min(F.struct("freq", "tok")).alias("least"))
    split = regions.select("id", "region_raw", "city", "rest", F.array_join("rest", " ").alias("ad"), address_tokens(F.col("rest")).alias("ad_tok"))
    out = norm.join(split, "id").join(rare, "id", "left")
    shared = lambda c: F.count("*").over(Window.partitionBy("country", c))
    return out.select("*", F.col("least.tok").alias("rare1"), F.coalesce("least.freq", F.lit(0)).alias("rare1_freq"), shared("core").alias("name_freq"), shared("ad").alias("addr_freq")).drop("least")


def profile_sides(pairs: DataFrame, profiled: DataFrame) -> DataFrame:
    """``pairs`` (s1, rec) with the columns of ``PROFILE`` of both rows as s_* and r_*."""
    side = lambda p, key: profiled.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in PROFILE])
    return pairs.join(side("s", "s1"), "s1").join(side("r", "rec"), "rec")


def structure_features(sides: DataFrame) -> DataFrame:
    """(s1, rec, ...): rarest tokens, frequencies, regions, address tokens and cities of :func:`profile_sides`."""
    c = F.col
    return sides.select(
        "s1", "rec", flag(F.array_contains(F.concat("r_core_tok", "r_alias_tok"), c("s_rare1"))).alias("n_s1rare_in_rec"),
        c("s_rare1_freq").alias("s1_rare1_freq"), c("r_rare1_freq").alias("rec_rare1_freq"), c("s_name_freq").alias("name_freq"), c("s_addr_freq").alias("addr_freq"),
        F.when(c("s_region_raw").isNull() | c("r_region_raw").isNull(), -1).otherwise((c("s_region_raw") == c("r_region_raw")).cast("int")).alias("region_eq"),
        F.size(F.array_intersect("s_ad_tok", "r_ad_tok")).cast("long").alias("at_inter"), F.round(K.jaccard(c("s_ad_tok"), c("r_ad_tok")), 6).alias("at_jacc"),
        flag(F.array_contains("r_rest", c("s_city"))).alias("s1_city_in_rec_comps"), flag(c("r_is_indic")).alias("is_indic"),
    )


#: What is compared with what, by which kernels.
TEXTS = {
    "core_alias": ("s_core", "r_alias", ("token_set", "ratio")), "alias_core": ("s_alias", "r_core", ("token_set", "ratio")), "alias_alias": ("s_alias", "r_alias", ("token_set", "ratio")),
    "core": ("s_core", "r_core", ("token_set",)), "concat": ("s_concat", "r_concat", ("ratio", "partial")), "ad": ("s_ad", "r_ad", ("token_set", "ratio", "partial")), "city": ("s_city", "r_city", ("ratio",)), "street": ("s_street", "r_street", ("ratio",)),
}


def more_strings(sides: DataFrame) -> DataFrame:
    """(s1, rec, ...): names by aliases and without spaces, and addresses, by the kernels that need Python.

    Each kind of text goes to Python as its distinct pairs, all kinds in one hop; empty texts give 0.
    """
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    texts = F.array(*[F.struct(F.lit(n).alias("kind"), text(a).alias("a"), text(b).alias("b")) for n, (a, b, _) in TEXTS.items()])
    each = sides.select("s1", "rec", F.explode(texts).alias("t")).select("s1", "rec", "t.*").where("a <> '' AND b <> ''")
    values = each.select("a", "b").distinct().withColumn("k", K.string_similarities(F.col("a"), F.col("b"), ("token_set", "ratio", "partial")))
    value = lambda n, k: F.round(F.coalesce(F.max(F.when(F.col("kind") == n, F.col(f"k.{k}"))), F.lit(0.0)), 6)
    found = each.join(values, ["a", "b"]).groupBy("s1", "rec").agg(*[value(n, k).alias(f"{n}_{k}") for n, (_, _, ks) in TEXTS.items() for k in ks])
    out = sides.select("s1", "rec").join(found, ["s1", "rec"], "left").na.fill(0.0)
    c = F.col
    out = out.withColumn("n_alias_set", F.greatest(*[c(f"{n}_token_set") for n in ("core_alias", "alias_core", "alias_alias")])).withColumn("n_alias_ratio", F.greatest(*[c(f"{n}_ratio") for n in ("core_alias", "alias_core", "alias_alias")]))
    return out.select(
        "s1", "rec", "n_alias_set", "n_alias_ratio", c("concat_ratio").alias("n_cat_ratio"), c("concat_partial").alias("n_cat_partial"), F.greatest("core_token_set", "n_alias_set", "concat_ratio").alias("n_best"),
        c("ad_token_set").alias("a_token_set"), c("ad_ratio").alias("a_ratio"), c("ad_partial").alias("a_partial"), c("city_ratio").alias("a_city_ratio"), c("street_ratio").alias("a_street_ratio"),
    )


def blocking_features(keyed: DataFrame) -> DataFrame:
    """(s1, rec, keys, nkeys, kscore, rec_ncand, s1_ncand) of a capped key join: how many kinds of key, how many candidates of either side."""
    return keyed.select("s1", "rec", "keys", F.bit_count("keys").alias("nkeys"), "kscore", F.count("*").over(Window.partitionBy("rec")).alias("rec_ncand"), F.count("*").over(Window.partitionBy("s1")).alias("s1_ncand"))


def linear_score(features: DataFrame) -> DataFrame:
    """(s1, rec, p): a fixed score of native features, a stand-in for a fitted model."""
    return features.select("s1", "rec", X.rounded(0.55 * F.col("n_tok_jacc") + 0.25 * F.col("n_lev") + 0.2 * F.col("num_jacc")).alias("p"))
