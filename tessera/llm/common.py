"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, about. Texts can be long, so batches are cut by size.
ARROW_BYTES = 1 << 20
#: Rows of numbers in one file of a settled table, at least.
FILE_ROWS = 50_000


def prepare(spark: SparkSession) -> SparkSession:
    """The one session setting that the Arrow operators rely on: small batches bound a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"tessera_{name}"
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, as a URI."""
    root = shared_root(spark)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    if root.startswith("file:/") and not root.startswith("file:///"):
        root = "file://" + root[len("file:") :]
    return f"{root}/tessera-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps start from files.

    Where ``rows`` tells how many rows there are at most, a small table is few files. For tables that
    come out of a shuffle: its partitions are then put together, not what was computed before it.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def release(*settled: DataFrame) -> None:
    """Remove the files of settled tables that nothing reads any more."""
    for df in settled:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.tessera_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI and the path within it."""
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def publishing(uri: str) -> Iterator[pa.NativeFile]:
    """A file to write, under a temporary name; it is renamed at the end, so a repeated task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


def publish(uri: str, data: bytes) -> None:
    with publishing(uri) as out:
        out.write(data)


def fetch(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column without decoding it."""
    return iter(column.cast(pa.large_binary()).to_pylist())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blank(c: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bounded_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About twice ``bound`` rows of ``df`` (all, if there are no more), by a hash ``h`` of ``keys``.

    For fitting alone. The caller orders by ``h`` and limits; thinning first keeps what each task
    sends to the driver small, however many tasks there are.
    """
    share = min(1.0, 2 * bound / max(1, df.select(*keys).count()))
    hashed = df.withColumn("h", F.xxhash64(*keys))
    return hashed if share == 1.0 else hashed.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
