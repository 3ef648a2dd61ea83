"""The stored catalogue: loading, and the layout that lets loads and filters skip parts of it.

The table is partitioned by a bucket of the id. A load replaces only the buckets of its ids, so its cost
grows with the load and the buckets it touches, not with the table. What is to be put in place is written beside the
table first; nothing is deleted before its replacement is complete, and a load that broke off in between is
finished by the next one, or by the next reader.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vectors import embed
from lodestar.operators.ingest import P, embedding_text, last_per_id, normalise, upsert
from lodestar.schemas import CatalogueSpec

# Degrees of a cell that records are laid out by.
CELL = 5
LAYOUT = (f"floor(xmin / {CELL})", f"floor(ymin / {CELL})", "begin_date", "id")
#: Records of a bucket of a new table, and buckets at most; a table keeps its number of buckets, which is part of
#: the partition column's name.
PER_BUCKET, MOST_BUCKETS = 100_000, 4096
_PARTITION = re.compile(r"bucket_of_(\d+)")


def load(raw: DataFrame, path: str, spec: CatalogueSpec = CatalogueSpec(), theme: DataFrame | None = None,
         foundational: DataFrame | None = None, encoder=None, buckets: int | None = None) -> None:
    """Raw records into the stored catalogue: embedded, normalised, the last row of each id by
    ``load_seq``, and put in place of stored rows with the same id. Without ``load_seq`` a load that
    repeats an id fails, as it does not say which row is the last. ``buckets`` is for a table that is not there yet;
    if it is not given, the first load's rows are counted for it.

    A vector of another length than declared ends the load before the stored table is touched.
    """
    spark, rows = raw.sparkSession, raw
    if "load_seq" in raw.columns:  # rows that later ones replace are not embedded
        rows = last_per_id(raw if P + "id" in raw.columns else raw.withColumn(P + "id", F.lit("")), P + "id")
    texts = embed(rows.withColumn("_text", F.expr(embedding_text())), "_text", encoder, "vector", spec.vector_dim)
    new = normalise(texts.drop("_text"), theme, foundational).drop("load_seq")
    recover(spark, path)
    if not exists(spark, path):
        # Written once as they come: the layout reads its rows twice, for the bounds of its ranges and to deal them.
        made = f"{_beside(path)}.load-{uuid.uuid4().hex}"
        checked(new, spec).write.parquet(made)
        made_ = spark.read.schema(new.schema).parquet(made)
        write(made_, path, spec, buckets or min(MOST_BUCKETS, max(1, raw.count() // PER_BUCKET)))
        _delete(spark, made)
        return
    stored = spark.read.parquet(path)
    if _bucketing(stored) is None:  # a table of an older layout gets buckets
        write(upsert(stored, checked(new, spec)), path, spec, buckets)
        return
    column, n = _bucketing(stored)
    # Written once: the buckets it touches are read off, and the rows then go in.
    incoming = f"{_beside(path)}.load-{uuid.uuid4().hex}"
    _bucketed(checked(new, spec), column, n).write.parquet(incoming)
    load_ = spark.read.schema(stored.schema).parquet(incoming)
    touched = [r[0] for r in load_.select(column).distinct().collect()]
    # An equality on the partition column reads the touched folders only.
    old = stored.filter(F.col(column).isin(touched))
    _stage(upsert(old, load_), path, column)
    _delete(spark, incoming)
    recover(spark, path)


def _beside(path: str) -> str:
    return path.rstrip("/")


def _bucketing(stored: DataFrame) -> tuple[str, int] | None:
    """The partition column of a stored table and its number of buckets."""
    for column in stored.columns:
        if found := _PARTITION.fullmatch(column):
            return column, int(found[1])
    return None


def _bucketed(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.withColumn(column, F.coalesce(F.pmod(F.xxhash64("id"), F.lit(n)), F.lit(0)).cast("int"))


def _laid_out(rows: DataFrame, column: str) -> DataFrame:
    """Rows of a bucket together and in it near records together, so the smallest and largest ``xmin`` and
    ``begin_date`` of a row group tell a filter on place or date that it can skip it."""
    order = [F.col(column), *[F.expr(e) for e in LAYOUT]]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _stage(rows: DataFrame, path: str, column: str) -> None:
    """Write whole buckets to where ``recover`` looks; Spark marks the folder when it is complete."""
    _laid_out(rows, column).write.mode("overwrite").partitionBy(column).parquet(f"{_beside(path)}.pending")


def recover(spark: SparkSession, path: str) -> None:
    """Put buckets in place that a load has written completely. Doing so twice has the same result."""
    pending = f"{_beside(path)}.pending"
    if not exists(spark, f"{pending}/_SUCCESS"):
        return
    system, place = _system(spark, pending)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if not _PARTITION.match(name):
            continue
        target, aside = jvm_path(f"{path}/{name}"), jvm_path(f"{path}/.replaced-{name}")
        # Renames only; the old bucket is deleted when the new one is there.
        if system.exists(target):
            system.delete(aside, True)
            if not system.rename(target, aside):
                raise OSError(f"{target} stays as it is, its replacement is in {pending}")
        if not system.rename(status.getPath(), target):
            raise OSError(f"the replacement of {target} stays in {pending}")
        system.delete(aside, True)
    system.delete(place, True)
    spark.catalog.refreshByPath(path)


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def checked(catalogue: DataFrame, spec: CatalogueSpec) -> DataFrame:
    """``catalogue``, failing where a vector is missing or of another length than declared."""
    wrong = f"size(vector) <> {spec.vector_dim} OR vector IS NULL"
    error = f"raise_error(concat('record ', coalesce(id, '?'), ' has a vector of ', coalesce(CAST(size(vector) AS string), 'no'), ' numbers, declared: {spec.vector_dim}'))"
    return catalogue.withColumn("vector", F.expr(f"CASE WHEN {wrong} THEN CAST({error} AS array<float>) ELSE vector END"))


def write(catalogue: DataFrame, path: str, spec: CatalogueSpec = CatalogueSpec(), buckets: int | None = None) -> None:
    """The whole table anew, in as many buckets as given, as the old one has, or in one: written beside the old one, which is renamed aside, and deleted last."""
    spark = catalogue.sparkSession
    if buckets is None:
        old_table = _bucketing(spark.read.parquet(path)) if exists(spark, path) else None
        buckets = old_table[1] if old_table else 1
    fresh, aside = (f"{_beside(path)}.{part}{uuid.uuid4().hex}" for part in ("", "replaced-"))
    column = f"bucket_of_{buckets}"
    rows = _bucketed(checked(catalogue.drop(*[c for c in catalogue.columns if _PARTITION.fullmatch(c)]), spec), column, buckets)
    _laid_out(rows, column).write.partitionBy(column).parquet(fresh)
    system, place = _system(spark, path)
    source, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (fresh, aside))
    if system.exists(place) and not system.rename(place, old):
        raise OSError(f"{path} stays as it is, the new table is {fresh}")
    if not system.rename(source, place):
        raise OSError(f"the new table stays at {fresh}, the old one at {aside}")
    system.delete(old, True)
    spark.catalog.refreshByPath(path)


def read(spark: SparkSession, path: str, spec: CatalogueSpec = CatalogueSpec()) -> DataFrame:
    """The stored catalogue; a table without the declared columns is refused."""
    recover(spark, path)
    table = spark.read.parquet(path)
    missing = {p.split(".")[0] for p in spec.text_fields} | {spec.geometry, "vector"}
    missing -= set(table.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return table.drop(*[c for c in table.columns if _PARTITION.fullmatch(c)])


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _system(spark, path)
    return system.exists(place)
