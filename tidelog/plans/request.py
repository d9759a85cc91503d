"""A flat set of request parameters to one query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.aggregate import group_by_attribute, top_then_chart
from tidelog.operators.filters import (
    filter_ids, filter_query_string, filter_record_type, filter_types, last_minutes, since, until,
)
from tidelog.functions.times import as_instant
from tidelog.operators.search import page


def _given(params: Mapping[str, str], name: str) -> str | None:
    value = params.get(name)
    return str(value).strip() if value is not None and str(value).strip() else None


def query_from_params(df: DataFrame, params: Mapping[str, str], as_of=None, max_size: int | None = None) -> DataFrame:
    """Filters, then one of: top keys charted, top keys, groups, or a page of rows.

    Parameters: types, documentTypes, minutes, timeFrom, timeTo, eventIds,
    queryString, topBy, chartBy, chunkSize (100 if not given), chunkStartAt,
    orderBy, orderAsc. A front end may set ``max_size``; a larger chunkSize is
    refused, never cut, and so is a negative chunkStartAt.
    """
    size = int(_given(params, "chunkSize") or 100)
    start = int(_given(params, "chunkStartAt") or 0)
    if start < 0 or size < 0 or max_size is not None and size > max_size:
        raise ValueError(f"chunkSize or chunkStartAt out of range: {size}, {start}")
    rows = filter_types(df, _given(params, "types"))
    if _given(params, "documentTypes"):
        rows = filter_record_type(rows, _given(params, "documentTypes"))
    if _given(params, "eventIds"):
        rows = filter_ids(rows, [i.strip() for i in _given(params, "eventIds").split(",")])
    rows = last_minutes(rows, int(_given(params, "minutes") or 0), as_of)
    if _given(params, "timeFrom"):
        rows = since(rows, as_instant(_given(params, "timeFrom")))
    if _given(params, "timeTo"):
        rows = until(rows, as_instant(_given(params, "timeTo")))
    rows = filter_query_string(rows, params.get("queryString"))

    top, chart = _given(params, "topBy"), _given(params, "chartBy")
    if top and chart:
        return top_then_chart(rows, top_by=top, chart_by=chart, top_n=size, limit=None)
    if top or chart:
        groups = group_by_attribute(rows, top or chart)
        first = F.col("count").desc() if top else F.col("key")
        return groups.orderBy(first, "key").offset(start).limit(size)
    return page(rows, start, size, _given(params, "orderBy"),
                str(params.get("orderAsc", "")).lower() == "true")
