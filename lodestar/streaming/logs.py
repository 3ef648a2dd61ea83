"""Search logs: slow-log parsing as batch and stream, and the log of requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.common import literal
from lodestar.operators.enrich import add_place, client_address
from lodestar.plans.requests import normalise_requests
from lodestar.schemas import PARSED_EVENT, PARSED_LOG, PLACE, SEARCH_LOG, SLOW_LOG
from lodestar.sources.tables import append_table, create_if_absent

# Test streams the engine makes by itself, and the pattern around the JSON body.
EXCLUDED_STREAMS = ("es-test-log-stream", "cust-test-log-stream")
SOURCE_RE = r"source\[(\{.*\})\]"
DEFAULT_MINUTES = 120
# What tells two events apart.
EVENT = ("stream", "timestamp", "message")


def list_streams(log: DataFrame) -> DataFrame:
    """Names of the streams, oldest last event first."""
    return log.groupBy("stream").agg(F.max("timestamp").alias("last_event")).orderBy("last_event", "stream")


def recent(log: DataFrame, now: dt.datetime, minutes: int | None = None) -> DataFrame:
    """Events of the last ``minutes`` (120 when not given) up to ``now``."""
    end = int(now.replace(tzinfo=now.tzinfo or dt.timezone.utc).timestamp() * 1000)
    start = end - (DEFAULT_MINUTES if minutes is None else minutes) * 60_000
    return log.filter(F.col("timestamp").between(start, end))


def without_test_streams(log: DataFrame, excluded=EXCLUDED_STREAMS) -> DataFrame:
    return log.filter(~F.col("stream").isin(list(excluded)))


def iso_utc(millis: str) -> str:
    """Epoch milliseconds as ISO text; the fraction shows only when there is one."""
    ts = f"timestamp_millis({millis})"
    whole = f"date_format({ts}, {literal(chr(39).join(['yyyy-MM-dd', 'T', 'HH:mm:ss']))})"
    return f"CASE WHEN {millis} % 1000 = 0 THEN {whole} ELSE concat({whole}, date_format({ts}, '.SSSSSS')) END"


def embedded_json(message: str) -> str:
    """The JSON text inside ``source[…]``, or null."""
    return f"nullif(regexp_extract({message}, {literal(SOURCE_RE)}, 1), '')"


def clauses(source: str, path: str = "must") -> str:
    return f"get_json_object({source}, '$.query.bool.{path}')"


def search_string(must: str) -> str:
    """``_name`` of the first ``match_all`` clause that carries one."""
    items = f"from_json({must}, 'array<struct<match_all:map<string,string>>>').match_all"
    named = f"filter({items}, m -> m IS NOT NULL AND map_contains_key(m, '_name'))"
    return f"try_element_at(get({named}, 0), '_name')"


def parse_slow_log(log: DataFrame, filters_path: str = "must") -> DataFrame:
    """One parsed row per event, rows without readable JSON kept with nulls."""
    kept = [c for c in log.columns if c not in ("timestamp", "message")]
    must = clauses(embedded_json("message"), filters_path)
    return log.selectExpr(*kept, "timestamp AS _millis", f"{must} AS _must").selectExpr(
        *kept, f"{iso_utc('_millis')} AS timestamp", "_must AS filters_applied", f"{search_string('_must')} AS search_string"
    )


def slow_log_etl(log: DataFrame) -> DataFrame:
    """Drop test streams, drop repeated events, parse."""
    kept = without_test_streams(log).dropDuplicates(list(EVENT))
    return parse_slow_log(kept).select(*PARSED_LOG.fieldNames())


EVENT_KEY = "sha2(to_json(struct(stream, timestamp, message)), 256)"
#: Events without a time have a day of their own, so that they too are found again.
EVENT_DAY = "coalesce(date_format(timestamp_millis(timestamp), 'yyyy-MM-dd'), 'unknown')"
#: A Parquet option of the sink: a Bloom filter for the event keys of each file.
BLOOM = {"parquet.bloom.filter.enabled#event": "true", "parquet.bloom.filter.expected.ndv#event": "1000000"}


#: Keys of a batch that are looked up one by one.
MAX_KEYS = 200


def load_new_events(log: DataFrame, sink: str) -> None:
    """Append the parsed events of ``log`` that ``sink`` does not hold yet.

    The sink is partitioned by day and keeps each event's key. Only the days that the batch touches are
    read, so an event may come as late as it likes, and loading a batch twice adds nothing. Events without a
    time have a day of their own. A small batch asks for its own keys, so files whose Bloom filter holds none of them
    are not read.
    """
    spark = log.sparkSession
    events = without_test_streams(log).dropDuplicates(list(EVENT)).selectExpr("*", f"{EVENT_KEY} AS event", f"{EVENT_DAY} AS day")
    create_if_absent(spark, sink, PARSED_EVENT)
    days = [r["day"] for r in events.select("day").distinct().collect()]
    have = spark.read.schema(PARSED_EVENT).parquet(sink).filter(F.col("day").isin(days)).select("event")
    # Counted first: so many keys fit in a filter that reaches the scan.
    few = [r["event"] for r in events.select("event").limit(MAX_KEYS + 1).collect()]
    if len(few) <= MAX_KEYS:
        have = have.filter(F.col("event").isin(few))
    new = parse_slow_log(events.join(have, "event", "left_anti"))
    new.select(*PARSED_EVENT.fieldNames()).write.mode("append").options(**BLOOM).partitionBy("day").parquet(sink)


def start_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 1000,
                 available_now: bool = True) -> StreamingQuery:
    """File source to Parquet sink, at most ``files`` files a batch; with ``available_now`` it processes
    what is there and ends, which is the scheduled form of the job. A restart continues from the
    checkpoint. The result is that of the batch form, in whatever order the files come."""
    log = spark.readStream.schema(SLOW_LOG).option("maxFilesPerTrigger", files).json(source)
    writer = log.writeStream.foreachBatch(lambda batch, _: load_new_events(batch, sink)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_request_log(rows: DataFrame, path: str) -> None:
    """Append to the declared log table, which is made when it is not there yet."""
    create_if_absent(rows.sparkSession, path, SEARCH_LOG)
    declared = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in SEARCH_LOG.fields])
    append_table(declared, path)


def request_log(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """One log row per request, rejected or not, with the place of its client."""
    sent = {
        "_client": client_address("ip_address", "ip_address_forward"),
        "_sort": "`sort`", "order_param": "`order`", "_q": "q",
    }
    placed = add_place(normalise_requests(requests, also=sent), blocks, "_client")
    have = set(blocks.columns)
    place = ", ".join(
        f"'{f.name}', CAST({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()})" for f in PLACE.fields
    )
    return placed.selectExpr(
        "req_id",
        "timestamp_millis(try_cast(timestamp AS bigint)) AS timestamp",
        "lang",
        "_q AS q",
        "user_agent", "http_method",
        "CASE WHEN _q = '' THEN 'popularity' ELSE _sort END AS sort_param",
        "order_param",
        "org AS organization_filter",
        "source_system AS metadata_source_filter",
        "theme AS theme_filter",
        "topic_category AS topicCategory_filter",
        "type AS type_filter",
        "protocol AS protocol_filter",
        "mappable AS mappable_filter",
        "relation", "size", "`from`",
        f"named_struct({place}) AS ip2geo",
    )
