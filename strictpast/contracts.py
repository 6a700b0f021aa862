"""Table contracts: ordered columns and types, plus the plan-time gates built on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A frame does not have the columns its contract asks for."""


_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def table(columns: str) -> T.StructType:
    """A schema from "name type, ..." text; usable before any session exists."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DAILY_BARS = table(
    "date date, ticker string, exchange string, ticker_type string, is_common_share boolean,"
    " raw_close double, adj_close double, volume double, shares_out double, mcap double"
)

PANEL = table(
    "date date, ticker string, exchange string, ticker_type string, is_common_share boolean,"
    " raw_close double, adj_close double, ret_1d double, volume double, shares_out double,"
    " mcap double, gics_sector string, gics_industry string, eligible_flag boolean,"
    " data_snapshot_id string"
)

UNIVERSE_FLAGS = table(
    "date date, ticker string, eligible_flag boolean, price_ok boolean, history_ok boolean,"
    " exchange_ok boolean, common_share_ok boolean, fail_reason string"
)

INDEX_MEMBERSHIP = table(
    "ticker string, name string, wiki_sector string, wiki_sub_industry string,"
    " date_added date, date_removed date, cik_code bigint"
)

TICKER_METADATA = table(
    "ticker string, name string, primary_exchange string, ticker_type string, list_date date,"
    " delisted_date date, sic_code string, sic_description string, cik bigint"
)

TICKER_ALIASES = table(
    "canonical_ticker string, alias string, effective_from date, effective_to date, note string"
)

STATEMENT_VALUES = (
    "revenues",
    "net_income",
    "eps_basic",
    "eps_diluted",
    "weighted_avg_shares_basic",
    "weighted_avg_shares_diluted",
    "common_equity",
    "total_assets",
    "operating_cash_flow",
)

FUNDAMENTALS = table(
    "ticker string, cik bigint, filing_date date, period_end_date date, fiscal_year int,"
    " fiscal_quarter int, period_kind string, "
    + ", ".join(f"{name} double" for name in STATEMENT_VALUES)
    + ", source_endpoints array<string>"
)

FACTOR = table(
    "date date, ticker string, factor_name string, raw_value double, winsorized_value double,"
    " zscore_value double, valid_flag boolean, tradable_flag boolean,"
    " feature_snapshot_id string, invalid_reason string"
)

EXPERIMENTS = table(
    "experiment_id string, name string, config_hash string, git_sha string, created_at timestamp"
)

CANDIDATES = table(
    "candidate_id string, experiment_id string, candidate_name string, candidate_type string,"
    " formula_string string, data_snapshot_id string, status string, created_at timestamp,"
    " updated_at timestamp"
)

ARTIFACTS = table(
    "artifact_id string, candidate_id string, artifact_type string, path string,"
    " checksum string, created_at timestamp"
)

METRICS = table(
    "metric_id string, candidate_id string, metric_name string, value double, fold string,"
    " horizon int, created_at timestamp"
)


LABELS = table(
    "date date, ticker string, horizon int, label_end date, forward_return double, winsorized_return double"
)

#: Metadata of columns that know the future; it stays with a column through joins, filters and files.
LABEL_MARK = {"label": True}


RUN_MARKS = table("experiment_id string, created_at timestamp")


def columns_of(contract: T.StructType) -> list[str]:
    return contract.fieldNames()


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> None:
    """Fail while the plan is being built when input columns are missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ContractError(f"{what} missing required columns: {missing}")


def refuse_labels(df: DataFrame, what: str) -> None:
    """Fail while the plan is being built when a column is marked as a label or named like one."""
    named = {"label_end", "forward_return", "winsorized_return"}
    labels = sorted(f.name for f in df.schema.fields if f.metadata.get("label") or f.name in named)
    if labels:
        raise ContractError(f"{what} may not read labels: {labels}")


def require_exact(df: DataFrame, contract: T.StructType, what: str) -> None:
    """Fail unless ``df`` has exactly the contract's columns in the contract's order."""
    expected = columns_of(contract)
    if df.columns != expected:
        missing = sorted(set(expected) - set(df.columns))
        extra = sorted(set(df.columns) - set(expected))
        raise ContractError(
            f"{what} columns do not match the contract: missing={missing} extra={extra}"
            f" order_ok={not missing and not extra and df.columns == expected}"
        )


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Select the contract's columns in order and cast each to its type; absent ones are null."""
    present = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in contract.fields
        )
    )
