"""Search requests: defaults, parsed filters, rejections, shapes shared by equal requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.common import literals
from lodestar.operators.filters import FILTER_COLUMNS, parse_filters
from lodestar.operators.ranking import ORDERS, SORT_FIELDS
from lodestar.schemas import REQUEST_COLUMNS


def complete(requests: DataFrame) -> DataFrame:
    """All request columns as strings; a missing column or a null is empty (= absent)."""
    have = set(requests.columns)
    return requests.selectExpr(*[
        f"coalesce(CAST(`{c}` AS string), '') AS `{c}`" if c in have else f"'' AS `{c}`" for c in REQUEST_COLUMNS
    ])


def _digits(column: str, default: int) -> str:
    """Digits as a number; more than fit are the largest number, anything else is ``default``."""
    return f"CASE WHEN {column} RLIKE '^[0-9]+$' THEN coalesce(try_cast({column} AS bigint), {2**63 - 1}) ELSE bigint({default}) END"


SORT_GIVEN = "CASE WHEN q = '' THEN 'popularity' WHEN `sort` = '' THEN 'relevancy' ELSE lower(`sort`) END"


def normalise_requests(requests: DataFrame, today: dt.date | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """Defaults applied, filters parsed; ``reject`` tells why a request cannot run.

    ``q`` is the text to search for (taken from the JSON body for ``postText``); an empty ``q``
    parameter forces popularity order; relevancy is always descending. ``also`` are further
    columns, computed from the parameters as they were sent.
    """
    r = complete(requests)
    order = (
        f"CASE WHEN {SORT_GIVEN} IN ('relevancy', '_score') THEN 'desc' WHEN `order` <> '' THEN lower(`order`) "
        f"WHEN {SORT_GIVEN} = 'title' THEN 'asc' ELSE 'desc' END"
    )
    parsed = parse_filters(today)
    reject = (
        f"coalesce(CASE WHEN {SORT_GIVEN} NOT IN ({literals(SORT_FIELDS)}) THEN 'unsupported sort field' "
        f"WHEN {order} NOT IN ({literals(ORDERS)}) THEN 'sort order must be asc or desc' END, {parsed.pop('reject')})"
    )
    derived = {
        **parsed,
        "reject": reject,
        "q": "CASE WHEN method = 'postText' THEN coalesce(get_json_object(body, '$.text'), '') ELSE q END",
        "lang": "CASE WHEN lang = '' THEN 'en' ELSE lang END",
        "sort": f"CASE WHEN {SORT_GIVEN} = 'relevancy' THEN '_score' ELSE {SORT_GIVEN} END",
        "order": order,
        "size": _digits("size", 10),
        "from": _digits("`from`", 0),
    }
    derived.update(also or {})
    return r.selectExpr(*[f"`{c}`" for c in r.columns if c not in derived], *[f"{e} AS `{n}`" for n, e in derived.items()])


def rejected_requests(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reject").isNotNull()).select("req_id", "reject")


MATCH_KEY = ("q", "org_lang", *FILTER_COLUMNS)
VIEW_KEY = ("match_id", "lang", "sort", "order", "size", "from")


def with_shapes(normalised: DataFrame) -> DataFrame:
    """Add ``match_id`` (same text and filters) and ``view_id`` (same page of it).

    Equal requests share both, so however often a request is repeated it is answered once.
    """
    keyed = normalised.withColumn("org_lang", F.expr("IF(lang = 'en', 'en', 'fr')"))
    match = ", ".join(MATCH_KEY)
    keyed = keyed.withColumn("match_id", F.expr(f"sha2(to_json(struct({match})), 256)"))
    view = ", ".join(f"`{c}`" for c in VIEW_KEY)
    return keyed.withColumn("view_id", F.expr(f"sha2(to_json(struct({view})), 256)"))
