"""Vector functions over ``array<float|double>`` columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.common import let, run_lengths
from lodestar.functions.text import analyse


def norm(v: str) -> str:
    return f"sqrt(aggregate({v}, 0D, (acc, x) -> acc + double(x) * double(x)))"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (acc, p) -> acc + p)"


def l2_normalise(v: str) -> str:
    """The vector divided by its length; a zero vector stays zero."""
    return let("vlen", f"greatest({norm(v)}, 1e-12D)", f"transform({v}, x -> double(x) / vlen)")


def mean_pool(df: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Masked mean of the vectors of each ``key``: sum(v*m) / max(sum(m), 1e-9).

    The built-in vector summariser combines on the map side, so one row per key and task is
    shuffled. Masked-out rows carry a zero vector and a vanishing weight: they leave the mean
    alone and still give a group without any unmasked row its zero vector.
    """
    m = F.col(mask).cast("double")
    kept = F.when(m > 0, F.col(vector)).otherwise(F.transform(F.col(vector), lambda x: x * 0))
    return (
        df.select(
            key,
            array_to_vector(kept.cast("array<double>")).alias("_v"),
            F.when(m > 0, m).otherwise(F.lit(1e-300)).alias("_m"),
        )
        .groupBy(key)
        .agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_m"))).alias("vector"))
    )


def hash_embed(text: str, dim: int = 64) -> str:
    """Signed feature hashing of the analysed tokens, length one: the stand-in encoder.

    Every token adds +1 or -1 to one of ``dim`` buckets; bucket and sign come from its MD5.
    """
    bucket = f"CAST(conv(substring(h, 1, 8), 16, 10) AS bigint) % {dim}"
    code = let("h", "md5(CAST(tk AS binary))", f"CAST(({bucket}) * 2 + IF(substring(h, 9, 1) >= '8', 1, 0) AS int)")
    counts = f"map_from_entries({run_lengths(f'transform({analyse(text)}, tk -> {code})', 'code', 'n')})"
    none = "map_from_arrays(CAST(array() AS array<int>), CAST(array() AS array<int>))"
    sums = (
        f"transform(sequence(0, {dim - 1}), b -> "
        "double(coalesce(try_element_at(m, b * 2), 0)) - double(coalesce(try_element_at(m, b * 2 + 1), 0)))"
    )
    return let("u", let("m", f"coalesce({counts}, {none})", sums), l2_normalise("u"))


def embed(df: DataFrame, text: str, encoder=None, out: str = "vector", dim: int = 64) -> DataFrame:
    """Add a vector column. ``encoder(list[str]) -> 2-d array`` is called once per Arrow batch.

    ``encoder`` may also be a zero-argument factory (marked by ``encoder.is_factory = True``) that
    loads a model once per Python worker. Without an encoder the hashing stand-in is used.
    """
    if encoder is None:
        return df.withColumn(out, F.expr(f"CAST({hash_embed(text, dim)} AS array<float>)"))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder() if getattr(encoder, "is_factory", False) else encoder
        for texts in batches:
            vectors = np.asarray(run(texts.fillna("").tolist()), dtype="float32")
            yield pd.Series(list(vectors), index=texts.index)

    return df.withColumn(out, encode(F.col(text)))


def vector_quality(df: DataFrame, vector: str = "vector") -> DataFrame:
    """How many rows have no vector, a null inside, and which lengths occur."""
    v = F.col(vector)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(False))).alias("n_null_element"),
        F.min(F.when(v.isNotNull(), F.size(v))).alias("min_dim"),
        F.max(F.when(v.isNotNull(), F.size(v))).alias("max_dim"),
    )
