"""Readers for contract tables already in their final shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.contracts import (
    ContractError,
    FUNDAMENTALS,
    INDEX_MEMBERSHIP,
    PANEL,
    TICKER_ALIASES,
    TICKER_METADATA,
    columns_of,
    conform,
    require_exact,
)
from strictpast.functions import calendar_day


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Headed CSV files as text columns. Every file's own header must be ``columns`` in order:
    a file with other or exchanged columns fails the read instead of swapping values."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}
    # Without column pruning, as a pruned read would compare fewer header names.
    return spark.read.schema(schema).options(**options).csv(path)


def read_contract(
    spark: SparkSession, path: str, contract: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read a table and fail unless its columns are exactly the contract's.

    Date columns that come as text or timestamps are coerced, unreadable ones to NULL.
    """
    if fmt == "csv":
        # One file's header is compared while planning, every file's own while reading.
        require_exact(spark.read.option("header", True).csv(path), contract, f"csv table at {path}")
        df = _csv(spark, path, columns_of(contract))
    else:
        df = spark.read.format(fmt).load(path)
        require_exact(df, contract, f"{fmt} table at {path}")
    dates = [f.name for f in contract.fields if isinstance(f.dataType, T.DateType)]
    stored = {f.name: f.dataType for f in df.schema.fields}
    coerced = {
        name: calendar_day(F.col(name)) if isinstance(stored[name], T.StringType) else F.to_date(name)
        for name in dates
        if not isinstance(stored[name], T.DateType)
    }
    return conform(df.withColumns(coerced) if coerced else df, contract)


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    return read_contract(spark, path, FUNDAMENTALS)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return read_contract(spark, path, INDEX_MEMBERSHIP, "csv")


def read_ticker_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_contract(spark, path, TICKER_METADATA)


def read_ticker_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Renames; an empty date is an open end and a missing note is the empty text."""
    return read_contract(spark, path, TICKER_ALIASES, "csv").fillna("", ["note"])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A written panel slice. Partition columns the sink may have added are dropped."""
    df = spark.read.parquet(path)
    extra = [c for c in df.columns if c not in columns_of(PANEL)]
    df = df.drop(*extra)
    require_exact(df, PANEL, f"panel at {path}")
    return df


def snapshot_of(panel: DataFrame) -> DataFrame:
    """The panel's snapshot ids with their row counts; one row for an intact slice."""
    return panel.groupBy("data_snapshot_id").agg(F.count("*").alias("rows"))


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line; blank lines and ``#`` comments are skipped."""
    line = F.trim(F.col("value"))
    return (
        spark.read.text(path)
        .select(line.alias("ticker"))
        .where((F.col("ticker") != "") & ~F.col("ticker").startswith("#"))
    )


# The published holdings file's leading columns, in file order (fixed values).
HOLDINGS_COLUMNS = ("Ticker", "Name", "Sector", "Asset Class")


def equity_holdings(rows: DataFrame) -> DataFrame:
    """Equity constituents of a holdings table.

    Cash and currency rows, and symbols that contain a dash, are no constituents.
    Preamble and footer lines of the file have another asset class or none.
    """
    ticker = F.trim(F.col("Ticker"))
    return (
        rows.where(F.trim(F.col("Asset Class")) == "Equity")
        .withColumn("Ticker", ticker)
        .where((F.col("Ticker") != "") & ~F.col("Ticker").contains("-"))
    )


def read_holdings(
    spark: SparkSession, path: str, columns: tuple[str, ...] = HOLDINGS_COLUMNS
) -> DataFrame:
    """Equity rows of published holdings files, whose header line lies below a preamble.

    Every file must hold the header line, and it must name ``columns`` in this order: columns that were
    exchanged would otherwise be read as each other.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", False).csv(path)
    cells = F.transform(F.array(*columns), F.trim)
    right = F.coalesce(cells == F.array(*(F.lit(c) for c in columns)), F.lit(False))
    # A header line names a column in any of the leading cells.
    header = F.exists(cells, lambda c: c.isin("Ticker", "Asset Class"))
    heads = rows.select(F.input_file_name().alias("file"), right.alias("right"), F.coalesce(header, F.lit(False)).alias("header"))
    files = heads.groupBy("file").agg(F.bool_or("right").alias("ok"), F.bool_or(F.col("header") & ~F.col("right")).alias("other"))
    wrong = files.where(~F.col("ok") | F.col("other")).select("file").limit(1).collect()
    if wrong:
        raise ContractError(f"holdings file without the header {columns}: {wrong[0].file}")
    return equity_holdings(rows)
