"""Facet counts over a match set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.filters import field_values
from lodestar.operators.ranking import top_k
from lodestar.schemas import FACET_FIELDS, FACET_SIZE


def facet_columns(schema, lang: str = "en") -> dict[str, str]:
    """Facet name -> distinct, non-null values of a record."""
    out = {}
    for name, path in FACET_FIELDS.items():
        path = f"organisation.{'en' if lang == 'en' else 'fr'}" if name == "unique_org" else path
        out[name] = f"array_distinct(array_compact({field_values(schema, path)}))"
    return out


def facet_counts(matches: DataFrame, facets: dict[str, str], keys: list[str], size: int = FACET_SIZE) -> DataFrame:
    """``(keys…, facet, value, doc_count, sum_other)``: the most frequent values of every facet.

    Values are counted before anything is ranked, so what is shuffled grows with the number of
    distinct values per task and not with the number of matches.
    """
    pairs = ", ".join(
        f"transform({values}, v -> named_struct('facet', '{name}', 'value', v))" for name, values in facets.items()
    )
    counted = (
        matches.selectExpr(*keys, f"inline_outer(concat({pairs}))")
        .filter("value IS NOT NULL")
        .groupBy(*keys, "facet", "value")
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )
    group = [*keys, "facet"]
    top = top_k(counted, group, [F.col("doc_count").desc(), F.col("value").asc()], size, spread_by="value")
    # At most ``size`` rows per group are left, so this window holds a bounded frame.
    shown = top.withColumn("_shown", F.sum("doc_count").over(Window.partitionBy(*group)))
    everything = counted.groupBy(*group).agg(F.sum("doc_count").alias("_all"))
    return shown.join(everything, group).selectExpr(*group, "value", "doc_count", "rn", "_all - _shown AS sum_other")
