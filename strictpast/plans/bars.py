"""Landed price feeds and ticker details -> the daily bars table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.contracts import DAILY_BARS, conform
from strictpast.functions import exchange_of, is_common, security_type_of

# Why a requested ticker has no bars.
NO_DETAILS = "meta: not found"
NO_BARS = "aggs: no rows returned"


def between_days(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows dated in ``[start, end]``; a plain comparison that reaches the scan."""
    if end < start:
        raise ValueError(f"window {start} to {end} holds no day")
    return df.where(F.col("date").between(F.lit(start), F.lit(end)))


def join_feeds(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """Days present in both feeds; volume comes from the raw one."""
    a = adjusted.select("ticker", "date", F.col("close").alias("adj_close"))
    r = raw.select("ticker", "date", F.col("close").alias("raw_close"), "volume")
    return a.join(r, ["ticker", "date"])


def stamp_details(bars: DataFrame, details: DataFrame) -> DataFrame:
    """Put each ticker's exchange, type and share count on its bars.

    ``details``: (ticker, primary_exchange, type, weighted_shares_outstanding), one row per
    ticker, or one per (ticker, date) for point-in-time share counts. Market cap is
    ``raw_close * shares_out``; unknown share counts are 0.
    """
    keys = ["ticker", "date"] if "date" in details.columns else ["ticker"]
    kind = security_type_of(F.col("type"))
    shares = F.coalesce(F.col("weighted_shares_outstanding").cast("double"), F.lit(0.0))
    facts = details.select(
        *keys,
        exchange_of(F.col("primary_exchange")).alias("exchange"),
        kind.alias("ticker_type"),
        is_common(kind).alias("is_common_share"),
        shares.alias("shares_out"),
    )
    stamped = bars.join(facts, keys).withColumn("mcap", F.col("raw_close") * F.col("shares_out"))
    return conform(stamped, DAILY_BARS)


def skipped_tickers(requested: DataFrame, details: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested tickers without details or bars, with the reason."""
    asked = requested.select("ticker").distinct()
    known = details.select("ticker").distinct()
    priced = bars.select("ticker").distinct()
    no_details = asked.join(known, "ticker", "left_anti").withColumn("reason", F.lit(NO_DETAILS))
    no_bars = (
        asked.join(known, "ticker", "left_semi")
        .join(priced, "ticker", "left_anti")
        .withColumn("reason", F.lit(NO_BARS))
    )
    return no_details.unionByName(no_bars)


def daily_bars(
    adjusted: DataFrame,
    raw: DataFrame,
    details: DataFrame,
    requested: DataFrame,
    start: date,
    end: date,
) -> tuple[DataFrame, DataFrame]:
    """(bars, skipped) for the requested tickers over ``[start, end]``."""
    merged = join_feeds(between_days(adjusted, start, end), between_days(raw, start, end))
    wanted = merged.join(requested.select("ticker").distinct(), "ticker", "left_semi")
    return stamp_details(wanted, details), skipped_tickers(requested, details, merged)
