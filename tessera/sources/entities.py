"""Entity tables: delimited files, truth lists, result lists, and the entity view of the given documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "name", "address", "country")])


def read_source(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """A tab-separated source with a header and no quoting; all columns are text, null becomes empty."""
    df = spark.read.schema(SOURCE).csv(path, sep="\t", quote="", header=True).na.fill("")
    return df.limit(head) if head is not None else df


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1, rec) of a file of comma-separated lists; blanks are dropped."""
    schema = T.StructType([T.StructField("s1", T.StringType()), T.StructField("list", T.StringType())])
    lists = spark.read.schema(schema).csv(path, sep="\t", quote="", header=True)
    return lists.select("s1", F.explode(F.split("list", ",")).alias("rec")).select("s1", F.trim("rec").alias("rec")).where("rec <> ''")


def result_lists(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each of ``ids`` (s1): its ``pairs`` (s1, rec), each once, sorted and comma-joined, or empty."""
    lists = pairs.select("s1", "rec").distinct().groupBy("s1").agg(F.array_sort(F.collect_list("rec")).alias("recs"))
    joined = F.coalesce(F.array_join(F.transform("recs", lambda x: x.cast("string")), ","), F.lit(""))
    return ids.select("s1").join(lists, "s1", "left").select("s1", joined.alias("recs"))


def write_lists(lists: DataFrame, path: str) -> None:
    lists.write.csv(path, sep="\t", quote="", header=True, emptyValue="", nullValue="")


def write_parts(df: DataFrame, path: str, rows: int = 2_000_000) -> None:
    """Parquet files of at most ``rows`` rows, zstd."""
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What is at ``path`` if it was written whole, else what ``build`` makes, written there."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, country, src, name, address) of ``documents``.

    Language is the country, doc_id deals sources 1 to 3. Names take the first words, some with an
    alias, a web form, a legal form or an id; addresses the next words with a number and a code from the
    length, some with words that stand for nothing or digits of another script.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    w = F.slice(F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda x: x != ""), 1, 8)
    base = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), (F.pmod("doc_id", F.lit(3)) + 1).cast("int").alias("src"), F.col("n_chars").cast("long").alias("n"), w.alias("w"))
    x = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    cat = lambda *p: F.concat(*[F.lit(q) if isinstance(q, str) else q for q in p])
    kind = F.pmod("id", F.lit(8))
    name = (
        F.when(kind == 0, cat(x(0), " ", x(1), " dba ", x(2)))
        .when(kind == 1, cat(x(0), " & ", x(1), " L.L.C."))
        .when(kind == 2, cat("www.", F.lower(x(0)), F.lower(x(1)), ".com"))
        .when(kind == 3, cat("The ", x(0), " ", x(1), " Pvt. Ltd."))
        .when(kind == 4, cat("-- ", x(0), " ", x(1), " Corporation (ID: ", F.col("id").cast("string"), ")"))
        .when(kind == 5, cat(x(0), " ", x(1), " Inc aka ", x(2), " ", x(3)))
        .when(kind == 6, cat(x(0), ".co.in ", x(1), " L. L.P. (D/B/A) ", x(2), ", formerly ", x(3)))
        .otherwise(cat(x(0), " ", x(1), " ", x(2)))
    )
    region = F.when(F.pmod("n", F.lit(3)) == 0, cat("North ", F.col("country"))).when(F.pmod("n", F.lit(3)) == 1, cat("N. ", F.col("country"), " region")).otherwise(F.upper("country"))
    street = cat((F.col("n") % 990 + 1).cast("string"), " ", x(4), " Street, Apt 0", (F.col("n") % 9).cast("string"), ", ", x(5), " ", x(6), ", ", (F.col("n") % 97 * 100 + 10000).cast("string"), ", ", region)
    address = F.when(F.pmod("id", F.lit(11)) == 0, F.lit("")).when(F.pmod("id", F.lit(13)) == 0, cat("null null n/a, ", street)).when(F.pmod("id", F.lit(17)) == 0, cat("Flat १२३-", (F.col("id") % 7).cast("string"), ", ", street)).otherwise(street)
    return base.select("id", "country", "src", name.alias("name"), address.alias("address"))


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1, rec) of equal texts in one language: source 1 against sources 2 and 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    one = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("s1"), "lang", "digest")
    rec = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("rec"), "lang", "digest")
    return one.join(rec, ["lang", "digest"]).select("s1", "rec")
