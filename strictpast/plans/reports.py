"""Summaries over factor and ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_counters(factor: DataFrame) -> DataFrame:
    """Panel rows, valid rows and tradable rows in one pass."""
    return factor.agg(
        F.count("*").alias("panel_rows"),
        F.count_if("valid_flag").alias("valid_rows"),
        F.count_if("tradable_flag").alias("tradable_rows"),
    )


def zscore_by_day(factor: DataFrame) -> DataFrame:
    """Mean and sample deviation of the valid z-scores per day."""
    return (
        factor.where("valid_flag")
        .groupBy("date")
        .agg(F.avg("zscore_value").alias("mean"), F.stddev_samp("zscore_value").alias("std"))
    )


def zscore_sanity(factor: DataFrame) -> DataFrame:
    """Largest absolute daily mean and mean daily deviation."""
    return zscore_by_day(factor).agg(
        F.max(F.abs("mean")).alias("max_abs_mean"), F.avg("std").alias("mean_std")
    )


def last_day_cross_section(factor: DataFrame) -> DataFrame:
    """Valid rows of the last day, highest z-score first."""
    last = factor.agg(F.max("date").alias("d")).scalar()
    return (
        factor.where((F.col("date") == last) & F.col("valid_flag"))
        .select("ticker", "raw_value", "winsorized_value", "zscore_value")
        .orderBy(F.col("zscore_value").desc(), "ticker")
    )


def ticker_series(factor: DataFrame, ticker: str) -> DataFrame:
    """One ticker's valid values in date order; the filter reaches the scan."""
    return (
        factor.where((F.col("ticker") == ticker) & F.col("valid_flag"))
        .select("date", "raw_value")
        .orderBy("date")
    )


def recent_rows(table: DataFrame, by: str, tie: str, k: int = 3) -> DataFrame:
    """The last ``k`` rows, newest first."""
    return table.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(k)


def first_entities(universe: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entities by ticker: the optional cap of a trial run."""
    return universe.orderBy("ticker").limit(n)
