"""As-of lookup by one sort per key instead of a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(
    requests: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    payload: Sequence[str],
    unique_requests: bool = False,
) -> DataFrame:
    """For every request, each payload's last non-null event value dated strictly before ``at``.

    Requests and events are stacked and swept once per key in date order, so no request is
    ever paired with the events it does not use. Dates are days and both inputs are reduced
    to one row per key and day, which bounds a key's rows by the calendar even when one key
    holds most of the requests. Pass ``unique_requests`` when ``requests`` already has at
    most one row per key and day; its other columns are then carried through the sweep.
    """
    keys = list(keys)
    asked = requests if unique_requests else requests.select(*keys, at).distinct()
    carried = [c for c in asked.columns if c not in (*keys, at)]
    left = asked.select(
        *keys,
        F.col(at).alias("_day"),
        F.lit(0).alias("_event"),
        F.struct(*(F.col(c) for c in carried), F.lit(0).alias("_pad")).alias("_row"),
    )
    right = events.select(*keys, F.col(since).alias("_day"), F.lit(1).alias("_event"), *payload)
    # A request sorts before the events of its own day: those are not visible yet.
    sweep = (
        Window.partitionBy(*keys)
        .orderBy("_day", "_event")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    stacked = left.unionByName(right, allowMissingColumns=True)
    found = stacked.withColumns(
        {p: F.last(F.col(p), ignorenulls=True).over(sweep) for p in payload}
    ).where(F.col("_event") == 0)
    answered = found.select(
        *keys, F.col("_day").alias(at), *(F.col(f"_row.{c}").alias(c) for c in carried), *payload
    )
    if unique_requests:
        return answered
    return requests.join(answered, [*keys, at], "left")
