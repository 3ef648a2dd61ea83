"""Parquet and JSON sources and sinks, and where intermediate tables are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute the rows of a table too small to give every core a part.

    A small file is read by one or few tasks. A table that splits into at least as many parts as
    there are cores, the normal case on a cluster, is left as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_records(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Record collections as one table, tagged with the order in which they were given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return union_collections([reader.parquet(p) for p in paths])


def union_collections(frames: list[DataFrame]) -> DataFrame:
    """Concatenate collections; columns missing from one are null, ``load_seq`` is its position."""
    out = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn("load_seq", F.lit(i).cast("bigint"))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def read_tags(spark: SparkSession, path: str, attribute: str) -> DataFrame:
    """Key-value export, one JSON object per line, every attribute wrapped as ``{"S": text}``."""
    wrapped = T.StructType([T.StructField("S", T.StringType())])
    schema = T.StructType([T.StructField("uuid", wrapped), T.StructField(attribute, wrapped)])
    return unwrap_tags(spark.read.schema(schema).json(path), attribute)


def unwrap_tags(items: DataFrame, attribute: str) -> DataFrame:
    return items.select(F.col("uuid.S").alias("uuid"), F.col(f"{attribute}.S").alias("tag"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table in place of whatever was there."""
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """An empty table of ``schema`` when nothing exists at ``path``; tells whether it was made."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return False
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return True


def clear_table(spark: SparkSession, path: str) -> int:
    """Remove all rows, keep the schema; returns how many rows there were."""
    table = spark.read.parquet(path)
    n = table.count()
    spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
    return n


def count_check(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


def work_dir(spark: SparkSession) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is unset (local tests) a folder of this machine is taken, and removed at the end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = getattr(spark, "_lodestar_work", None)
        if base is None:
            base = spark._lodestar_work = tempfile.mkdtemp(prefix="lodestar-")
            atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/lodestar/{uuid.uuid4().hex}"


#: Tells Spark to delete the shuffle files of a plan when it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans that begin inside leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where several branches of a plan read the same expensive table: it is computed once, its
    lineage ends, and a lost executor costs a re-read, not a re-computation. Nothing reads the plan's
    shuffle files after that, so they go at once.
    """
    path = work_dir(df.sparkSession)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
