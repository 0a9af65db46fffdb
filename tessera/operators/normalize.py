"""The normalised entity table and the statistics drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def normalize(entities: DataFrame) -> DataFrame:
    """Names and addresses of ``entities`` (id, country, src, name, address) as parts.

    Adds core, alias, has_alias, is_web, is_indic, core_tok, alias_tok, concat, comps, nums, hnum,
    street, addr_empty. A name that is only an alias clause keeps the alias as its core. The one
    Python hop folds names and addresses; everything after is native.
    """
    f = entities.select("*", X.fold(F.coalesce("name", F.lit(""))).alias("fname"), X.fold(F.coalesce("address", F.lit(""))).alias("faddr"))
    f = f.select("*", X.alias_parts(F.col("fname")).alias("parts"), X.components(F.col("faddr")).alias("comps"))
    f = f.select("*", X.core_name(F.get("parts", F.lit(0))).alias("core0"), X.core_name(F.get("parts", F.lit(1))).alias("alias"), F.array_join("comps", " ").alias("full"))
    f = f.withColumn("core", F.when(F.col("core0") == "", F.coalesce("alias", F.lit(""))).otherwise(F.col("core0")))
    f = f.withColumn("nums", X.numbers(F.col("full")))
    return f.select(
        "id", "country", "src", "name", "address", "core", "alias", (F.size("parts") > 1).alias("has_alias"), X.is_web(F.col("name")).alias("is_web"), X.is_indic(F.col("name")).alias("is_indic"),
        X.words(F.col("core")).alias("core_tok"), X.words(F.coalesce("alias", F.lit(""))).alias("alias_tok"), F.replace("core", F.lit(" "), F.lit("")).alias("concat"),
        "comps", "nums", F.get("nums", F.lit(0)).alias("hnum"), X.street_word(F.col("full")).alias("street"), (F.trim(F.coalesce("address", F.lit(""))) == "").alias("addr_empty"),
    )


def token_frequency(norm: DataFrame, column: str = "core_tok") -> DataFrame:
    """(country, tok, freq): rows a token is in, per country."""
    return norm.select("country", F.explode(F.array_distinct(column)).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("freq"))


def rare_tokens(norm: DataFrame, freq: DataFrame, column: str = "core_tok", k: int = 2) -> DataFrame:
    """(id, rank, tok, freq): the ``k`` rarest tokens of each row by frequency, then by name."""
    toks = norm.select("id", "country", F.explode(F.array_distinct(column)).alias("tok")).join(freq, ["country", "tok"])
    by = Window.partitionBy("id").orderBy("freq", "tok")
    return toks.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("id", "rank", "tok", "freq")


def last(c: str | Column) -> Column:
    return F.get(c, F.size(c) - 1)


def region_vocabulary(norm: DataFrame, least: int = 200, share: float = 0.001) -> DataFrame:
    """(country, region, n): last address parts that are frequent enough in their country."""
    counts = norm.where(F.size("comps") > 0).groupBy("country", last("comps").alias("region")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("country"))
    return counts.withColumn("total", total).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("country", "region", "n")


def split_region(norm: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, country, region_raw, city, rest[]): the last part that is a region, the last other without a digit, the others."""
    lists = vocabulary.groupBy("country").agg(F.collect_set("region").alias("regions"))
    d = norm.select("id", "country", "comps").join(lists, "country", "left")
    at = F.array_max(F.filter(F.transform("comps", lambda x, i: F.when(F.array_contains("regions", x), i)), lambda i: i.isNotNull()))
    d = d.withColumn("at", at)
    other = F.filter(F.col("comps"), lambda x, i: F.col("at").isNull() | (i != F.col("at")))
    d = d.withColumn("region_raw", F.get("comps", F.col("at").cast("int"))).withColumn("rest", other)
    return d.select("id", "country", "region_raw", last(F.filter("rest", lambda x: ~x.rlike("[0-9]"))).alias("city"), "rest")


def region_votes(norm: DataFrame, regions: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """(country, spelling, region, n, total): what source 1 calls a region that others spell so.

    Rows meet on (country, core, first number) where that is unique in source 1.
    """
    rows = norm.select("id", "country", "src", "core", "hnum").join(regions.select("id", "region_raw"), "id").where("core <> '' AND hnum IS NOT NULL AND region_raw IS NOT NULL")
    key = ["country", "core", "hnum"]
    one = rows.where("src = 1").withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n = 1").select(*key, F.col("region_raw").alias("region"))
    votes = rows.where("src > 1").join(one, key).groupBy("country", F.col("region_raw").alias("spelling"), "region").agg(F.count("*").alias("n"))
    by = Window.partitionBy("country", "spelling")
    ranked = votes.withColumn("total", F.sum("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "region")))
    return ranked.where((F.col("rank") == 1) & (F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).drop("rank")


def name_frequency(norm: DataFrame) -> DataFrame:
    """(id, name_freq): rows of the same country and core."""
    return norm.select("id", F.count("*").over(Window.partitionBy("country", "core")).alias("name_freq"))


def learn_dictionary(pairs: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(word, to, n): what words of ``rec_tok`` stand for, from pairs (rec_tok[], s1_tok[]) of equal length."""
    aligned = pairs.where(F.size("rec_tok") == F.size("s1_tok")).select(F.explode(F.arrays_zip("rec_tok", "s1_tok")).alias("z")).select(F.col("z.rec_tok").alias("word"), F.col("z.s1_tok").alias("to"))
    votes = aligned.groupBy("word", "to").agg(F.count("*").alias("n"))
    by = Window.partitionBy("word")
    ranked = votes.withColumn("total", F.sum("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "to")))
    return ranked.where((F.col("rank") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("word", "to", "n")


def on_distinct(df: DataFrame, column: str, make, name: str) -> DataFrame:
    """Add ``make(column)`` as ``name``, computed once for each distinct value."""
    values = df.select(column).distinct().withColumn(name, make(F.col(column)))
    return df.join(values.withColumnRenamed(column, "tessera_value"), F.col(column).eqNullSafe(F.col("tessera_value")), "left").drop("tessera_value")


def row_integrity(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(n_before, n_after, lost, gained): whether a step kept all rows."""
    a, b = before.select(key), after.select(key)
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(a, "n_before").crossJoin(one(b, "n_after")).crossJoin(one(a.exceptAll(b), "lost")).crossJoin(one(b.exceptAll(a), "gained"))
