"""Joins that enrich rows: places of addresses, localised texts, override tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.common import let

# What is shown when a record has no French text.
NO_TITLE_FR = "Title not available in French."
NO_DESCRIPTION = "Description not available."
NO_KEYWORDS = "Keyword not available."


def client_address(address: str, forwarded: str) -> str:
    """First forwarded address if there is one, else the direct address."""
    return (
        f"CASE WHEN coalesce({forwarded}, '') <> '' THEN trim(substring_index({forwarded}, ',', 1)) "
        f"ELSE coalesce({address}, '') END"
    )


def ip_number(address: str) -> str:
    """Dotted IPv4 as a number; anything else is null."""
    octets = f"transform(split({address}, '[.]'), part -> try_cast(part AS bigint))"
    number = "oct[0] * 16777216 + oct[1] * 65536 + oct[2] * 256 + oct[3]"
    valid = "size(oct) = 4 AND forall(oct, n -> coalesce(n BETWEEN 0 AND 255, false))"
    return let("oct", octets, f"CASE WHEN {valid} THEN {number} END")


def geo_point(text: str) -> str:
    """``"lat,lon"`` as a struct; anything else is null."""
    numbers = f"transform(split({text}, ','), part -> try_cast(part AS double))"
    valid = "size(nums) = 2 AND nums[0] IS NOT NULL AND nums[1] IS NOT NULL"
    return let("nums", numbers, f"CASE WHEN {valid} THEN named_struct('lat', nums[0], 'lon', nums[1]) END")


def place_of_addresses(addresses: DataFrame, blocks: DataFrame, ip: str = "ip_num") -> DataFrame:
    """The narrowest block around every distinct address: an interval join done as an equi-join.

    A block is filed under the power of two that covers its width and touches at most two buckets
    of that size; an address is looked up once per size that occurs. Equal addresses are looked up
    once, so a client that sends most of the traffic costs one row. Blocks of equal width are told
    apart by their start.
    """
    filed = (
        blocks.withColumn("width", F.expr("end_ip - start_ip + 1"))
        .withColumn("level", F.expr("int(ceil(log2(width)))"))
        .withColumn("step", F.expr("shiftleft(1L, level)"))
        .withColumn("bucket", F.expr("explode(sequence(start_ip div step, end_ip div step))"))
    )
    distinct = addresses.select(F.col(ip).alias("ip_num")).filter(F.col("ip_num").isNotNull()).distinct()
    # At most 33 block sizes exist for 32-bit addresses, so this list is bounded.
    levels = [r["level"] for r in filed.select("level").distinct().collect()]
    sizes = f"explode(CAST(array({', '.join(map(str, levels))}) AS array<int>)) AS level"
    probes = distinct.selectExpr("ip_num", sizes).selectExpr("ip_num", "level", "ip_num div shiftleft(1L, level) AS bucket")
    found = probes.join(filed, ["level", "bucket"]).filter("ip_num BETWEEN start_ip AND end_ip")
    payload = ", ".join(c for c in blocks.columns if c not in ("start_ip", "end_ip"))
    narrowest = f"min_by(struct(start_ip, end_ip, {payload}), struct(width, start_ip)) AS place"
    return found.groupBy("ip_num").agg(F.expr(narrowest)).select("ip_num", "place.*")


def add_place(df: DataFrame, blocks: DataFrame, address: str, ip: str = "ip_num") -> DataFrame:
    """Left join of the place of every row's address; ``location`` becomes a geo point."""
    numbered = df.withColumn(ip, F.expr(ip_number(address)))
    places = place_of_addresses(numbered, blocks, ip).withColumn("location", F.expr(geo_point("location")))
    return numbered.join(places.withColumnRenamed("ip_num", ip), ip, "left")


def localise(df: DataFrame, translations: DataFrame, key: str = "id") -> DataFrame:
    """French title, description and keywords by id, with the fall-back texts."""
    texts = translations.select(
        F.col(key), F.col("title").alias("_t"), F.col("description").alias("_d"), F.col("keywords").alias("_k")
    )
    return df.join(texts, key, "left").select(
        *[c for c in df.columns if c not in ("title", "description", "keywords")],
        F.coalesce("_t", F.lit(NO_TITLE_FR)).alias("title"),
        F.coalesce("_d", F.lit(NO_DESCRIPTION)).alias("description"),
        F.coalesce("_k", F.lit(NO_KEYWORDS)).alias("keywords"),
    )
