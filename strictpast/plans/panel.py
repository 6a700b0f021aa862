"""Daily bars -> eligibility rules and the point-in-time panel.

A (date, ticker) pair occurs once (checked by the ``unique_keys`` rule), so a ticker has at
most one row per calendar day and the per-ticker windows below stay bounded by the calendar
however large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strictpast.contracts import (
    DAILY_BARS,
    PANEL,
    UNIVERSE_FLAGS,
    columns_of,
    conform,
    require_columns,
)
from strictpast.functions import is_common
from strictpast.operators.fingerprint import fingerprint


def by_ticker() -> WindowSpec:
    """A ticker's rows in date order."""
    return Window.partitionBy("ticker").orderBy("date")


# Eligibility rules in the order they are tried, and their failure names.
FAIL_REASONS = {
    "common_share_ok": "share_class_not_common",
    "exchange_ok": "exchange_not_allowed",
    "history_ok": "insufficient_history",
    "price_ok": "price_below_floor",
}

# Starts the message of a job that met a repeated (date, ticker).
REPEATED_KEY = "repeated (date, ticker) key in the bars"


@dataclass(frozen=True)
class UniverseRules:
    exchanges: Sequence[str] = ("NYSE", "AMEX", "NASDAQ")
    min_history_days: int = 252
    price_floor: float = 5.0


def with_universe_flags(bars: DataFrame, rules: UniverseRules) -> DataFrame:
    """Add the four rule columns, the first failing rule's name, and eligibility.

    History counts rows strictly before the day and the price rule reads the previous
    close, so nothing from the day itself decides its eligibility.
    """
    require_columns(bars, ["date", "ticker", "exchange", "ticker_type", "raw_close"], "panel")
    flagged = bars.withColumns(
        {
            "common_share_ok": is_common(F.col("ticker_type")),
            "exchange_ok": F.coalesce(F.col("exchange").isin(*rules.exchanges), F.lit(False)),
            "history_ok": F.row_number().over(by_ticker()) - 1 >= rules.min_history_days,
            "price_ok": F.coalesce(
                F.lag("raw_close").over(by_ticker()) >= rules.price_floor, F.lit(False)
            ),
        }
    )
    reason = F.lit(None).cast("string")
    for rule, name in reversed(FAIL_REASONS.items()):
        reason = F.when(~F.col(rule), F.lit(name)).otherwise(reason)
    return flagged.withColumn("fail_reason", reason).withColumn(
        "eligible_flag", F.col("fail_reason").isNull()
    )


def universe_flags(bars: DataFrame, rules: UniverseRules = UniverseRules()) -> DataFrame:
    """One eligibility decision per (date, ticker)."""
    return with_universe_flags(bars, rules).select(*columns_of(UNIVERSE_FLAGS))


def with_returns(bars: DataFrame) -> DataFrame:
    """Log return on the adjusted close; NULL on a ticker's first row."""
    log_price = F.ln("adj_close")
    return bars.withColumn("ret_1d", log_price - F.lag(log_price).over(by_ticker()))


def build_panel(
    bars: DataFrame, rules: UniverseRules = UniverseRules(), check_keys: bool = True
) -> DataFrame:
    """Bars -> the 15-column panel: returns, eligibility, and the snapshot id of its input.

    Returns and flags share one sort per ticker. The snapshot id is a one-row aggregate of
    the bars read as a scalar subquery, so consumers that do not select it never compute it.
    A repeated (date, ticker) makes the job fail unless ``check_keys`` is off: in date order a
    repeated day equals its predecessor, so the check rides on the sort that is there anyway.
    """
    require_columns(bars, columns_of(DAILY_BARS), "bars")
    snapshot = fingerprint(bars, columns_of(DAILY_BARS)).scalar()
    enriched = with_returns(with_universe_flags(bars, rules))
    if check_keys:
        repeated = F.lag("date").over(by_ticker()) == F.col("date")
        message = F.concat(F.lit(f"{REPEATED_KEY}: "), F.concat_ws(", ", "date", "ticker"))
        enriched = enriched.withColumn(
            "ret_1d", F.when(repeated, F.raise_error(message).cast("double")).otherwise(F.col("ret_1d"))
        )
    return conform(enriched.withColumn("data_snapshot_id", snapshot), PANEL)


def for_members(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Bars of the given tickers only, all days."""
    return bars.join(members.select("ticker").distinct(), "ticker", "left_semi")


def eligible_per_day(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(F.count_if("eligible_flag").alias("eligible"))


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, tickers and date span in one pass."""
    return panel.agg(
        F.count("*").alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
