"""Landed vendor records -> contract-shaped rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.contracts import table
from strictpast.functions import (
    PERIOD_KINDS,
    calendar_day,
    finite_or_null,
    lenient_date,
    stripped_int,
)

# Vendor field -> our column, per statement feed.
INCOME_FIELDS = {
    "revenue": "revenues",
    "net_income_loss_attributable_common_shareholders": "net_income",
    "basic_earnings_per_share": "eps_basic",
    "diluted_earnings_per_share": "eps_diluted",
    "basic_shares_outstanding": "weighted_avg_shares_basic",
    "diluted_shares_outstanding": "weighted_avg_shares_diluted",
}
BALANCE_FIELDS = {
    "total_equity_attributable_to_parent": "common_equity",
    "total_assets": "total_assets",
}
CASHFLOW_FIELDS = {"net_cash_from_operating_activities": "operating_cash_flow"}

# Feed tags in merge order.
INCOME, BALANCE, CASHFLOW = "income_statements", "balance_sheets", "cash_flow_statements"
ENDPOINTS = (INCOME, BALANCE, CASHFLOW)
FIELDS_OF = {INCOME: INCOME_FIELDS, BALANCE: BALANCE_FIELDS, CASHFLOW: CASHFLOW_FIELDS}

BAR_RECORD = table(
    "ticker string, timestamp bigint, close double, volume double"
)


def statement_record(tag: str) -> T.StructType:
    """Landing schema of one statement feed."""
    values = ", ".join(f"{name} double" for name in FIELDS_OF[tag])
    return table(
        "requested string, tickers array<string>, cik string, filing_date string,"
        f" period_end string, fiscal_year int, fiscal_quarter int, timeframe string, {values}"
    )


DETAIL_RECORD = table(
    "ticker string, name string, primary_exchange string, type string, list_date string,"
    " delisted_utc string, sic_code string, sic_description string, cik string,"
    " weighted_shares_outstanding double"
)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def bars_from_feed(raw: DataFrame) -> DataFrame:
    """Epoch-millisecond bars -> (ticker, date, close, volume) by UTC day."""
    day = F.date_from_unix_date(F.floor(F.col("timestamp") / 86_400_000).cast("int"))
    return raw.select(
        "ticker",
        day.alias("date"),
        finite_or_null(F.col("close").cast("double")).alias("close"),
        finite_or_null(F.col("volume").cast("double")).alias("volume"),
    )


def project_statements(raw: DataFrame, fields: Mapping[str, str], tag: str) -> DataFrame:
    """One statement feed -> partial filings rows tagged with their feed.

    The requested ticker wins if the record lists it, else the first listed one, else the
    requested one. ``requested`` stays on the row: it names the entity the record was asked
    for. Fields the record does not have are NULL.
    """
    listed = F.coalesce(F.array_contains("tickers", F.col("requested")), F.lit(False))
    first = F.get("tickers", F.lit(0))
    present = set(raw.columns)
    values = [
        (finite_or_null(F.col(src).cast("double")) if src in present else F.lit(None).cast("double"))
        .alias(dst)
        for src, dst in fields.items()
    ]
    return raw.select(
        "requested",
        F.when(listed, F.col("requested"))
        .otherwise(F.coalesce(first, F.col("requested")))
        .alias("ticker"),
        F.trim("cik").try_cast("bigint").alias("cik"),
        lenient_date(F.col("filing_date")).alias("filing_date"),
        lenient_date(F.col("period_end")).alias("period_end_date"),
        F.col("fiscal_year").cast("int").alias("fiscal_year"),
        F.col("fiscal_quarter").cast("int").alias("fiscal_quarter"),
        F.when(F.col("timeframe").isin(*PERIOD_KINDS), F.col("timeframe")).alias("period_kind"),
        *values,
        F.lit(tag).alias("endpoint"),
    )


def project_details(raw: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Ticker-detail records -> metadata rows.

    ``removals`` (ticker, ref_date) overrides the delisting day of former index members.
    """
    delisted = calendar_day(F.col("delisted_utc"))
    df = raw
    if removals is not None:
        df = raw.join(removals.select("ticker", F.col("ref_date").alias("_override")), "ticker", "left")
        delisted = F.coalesce(F.col("_override"), delisted)
    return df.select(
        "ticker",
        "name",
        "primary_exchange",
        F.col("type").alias("ticker_type"),
        calendar_day(F.col("list_date")).alias("list_date"),
        delisted.alias("delisted_date"),
        "sic_code",
        "sic_description",
        stripped_int(F.col("cik")).alias("cik"),
    )
