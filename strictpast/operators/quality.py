"""Row rules, key rules and reference rules evaluated over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.functions import KNOWN_TYPES, MIC_TO_EXCHANGE, OTHER_TYPE, PERIOD_KINDS, is_finite
from strictpast.plans.factors.base import INVALID_REASONS
from strictpast.session import stage


class QualityError(ValueError):
    """A table breaks its rules."""


@dataclass(frozen=True)
class Rule:
    """A condition every row must meet; NULL counts as not met."""

    name: str
    holds: Column

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))


def _or_null(column: str, holds: Column) -> Column:
    return F.col(column).isNull() | holds


def _length(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def _hex(column: str, low: int, high: int) -> Column:
    return F.col(column).rlike(f"^[0-9a-fA-F]{{{low},{high}}}$")


def _iff(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) == F.coalesce(b, F.lit(False))


def bar_rules() -> list[Rule]:
    positive = [Rule(f"{c}_positive", F.col(c) > 0) for c in ("raw_close", "adj_close", "shares_out", "mcap")]
    return [
        Rule("ticker_length", _length("ticker", 1, 16)),
        Rule("exchange_known", F.col("exchange").isin(*MIC_TO_EXCHANGE.values())),
        Rule("ticker_type_known", F.col("ticker_type").isin(*KNOWN_TYPES, OTHER_TYPE)),
        *positive,
        Rule("volume_not_negative", F.col("volume") >= 0),
        Rule("common_share_matches_type", F.col("is_common_share") == (F.col("ticker_type") == "CS")),
    ]


def universe_rules() -> list[Rule]:
    passed = F.col("price_ok") & F.col("history_ok") & F.col("exchange_ok") & F.col("common_share_ok")
    return [
        Rule("eligible_means_all_rules", ~F.col("eligible_flag") | passed),
        Rule("reason_iff_not_eligible", F.col("eligible_flag") == F.col("fail_reason").isNull()),
    ]


def membership_rules() -> list[Rule]:
    return [
        Rule("ticker_present", F.col("ticker").isNotNull()),
        Rule("added_present", F.col("date_added").isNotNull()),
        Rule("removed_not_before_added", _or_null("date_removed", F.col("date_removed") >= F.col("date_added"))),
    ]


def metadata_rules() -> list[Rule]:
    ordered = F.col("delisted_date") >= F.col("list_date")
    return [
        Rule("ticker_length", _length("ticker", 1, 16)),
        Rule("delisted_not_before_listed", _or_null("delisted_date", _or_null("list_date", ordered))),
    ]


def alias_rules() -> list[Rule]:
    ordered = F.col("effective_to") >= F.col("effective_from")
    return [Rule("to_not_before_from", _or_null("effective_to", _or_null("effective_from", ordered)))]


def filing_rules() -> list[Rule]:
    quarterly = F.col("period_kind") == "quarterly"
    return [
        *(
            Rule(f"{c}_present", F.col(c).isNotNull())
            for c in ("ticker", "filing_date", "period_end_date", "period_kind")
        ),
        Rule("filed_not_before_period_end", F.col("filing_date") >= F.col("period_end_date")),
        Rule("period_kind_known", F.col("period_kind").isin(*PERIOD_KINDS)),
        Rule(
            "quarter_matches_kind",
            F.when(quarterly, F.coalesce(F.col("fiscal_quarter").isin(1, 2, 3, 4), F.lit(False))).otherwise(
                F.col("fiscal_quarter").isNull()
            ),
        ),
    ]


def factor_rules() -> list[Rule]:
    finite = is_finite(F.col("raw_value")) & is_finite(F.col("winsorized_value"))
    finite &= is_finite(F.col("zscore_value"))
    return [
        Rule("valid_iff_finite", _iff(F.col("valid_flag"), finite)),
        Rule("tradable_means_valid", ~F.coalesce("tradable_flag", F.lit(False)) | F.col("valid_flag")),
        Rule("valid_iff_no_reason", F.col("valid_flag") == F.col("invalid_reason").isNull()),
        Rule("reason_known", _or_null("invalid_reason", F.col("invalid_reason").isin(*INVALID_REASONS))),
    ]


# The closed enums of the ledger.
CANDIDATE_STATUSES = ("registered", "computed", "promoted", "held", "retired")
CANDIDATE_TYPES = ("deterministic_factor",)
ARTIFACT_TYPES = ("panel", "factor", "risk", "metrics", "report")


def experiment_rules() -> list[Rule]:
    return [
        Rule("name_present", F.length("name") >= 1),
        Rule("config_hash_hex", _hex("config_hash", 64, 64)),
        Rule("code_id_length", _length("git_sha", 7, 40)),
    ]


def candidate_rules() -> list[Rule]:
    return [
        Rule("name_present", F.length("candidate_name") >= 1),
        Rule("formula_present", F.length("formula_string") >= 1),
        Rule("snapshot_present", F.length("data_snapshot_id") >= 1),
        Rule("status_known", F.col("status").isin(*CANDIDATE_STATUSES)),
        Rule("type_known", F.col("candidate_type").isin(*CANDIDATE_TYPES)),
    ]


def artifact_rules() -> list[Rule]:
    return [
        Rule("path_present", F.length("path") >= 1),
        Rule("checksum_hex", _hex("checksum", 64, 64)),
        Rule("type_known", F.col("artifact_type").isin(*ARTIFACT_TYPES)),
    ]


def metric_rules() -> list[Rule]:
    return [
        Rule("name_present", F.length("metric_name") >= 1),
        Rule("horizon_positive", _or_null("horizon", F.col("horizon") >= 1)),
    ]


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, broken_rows, total_rows) from one pass over the table."""
    counted = df.agg(
        F.count("*").alias("total_rows"),
        *(F.count_if(r.broken).alias(f"_{i}") for i, r in enumerate(rules)),
    )
    rows = F.array(
        *(
            F.struct(F.lit(r.name).alias("rule"), F.col(f"_{i}").alias("broken_rows"))
            for i, r in enumerate(rules)
        )
    )
    return counted.select("total_rows", F.inline(rows)).select("rule", "broken_rows", "total_rows")


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that break a rule, with the names of the broken rules."""
    names = F.array_compact(F.array(*(F.when(r.broken, F.lit(r.name)) for r in rules)))
    return df.withColumn("broken_rules", names).where(F.size("broken_rules") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def dangling(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent.select(key), key, "left_anti")


def overlapping_aliases(aliases: DataFrame) -> DataFrame:
    """Pairs of neighbouring rename intervals of one lineage that overlap.

    Sorted by start, an interval overlaps an earlier one iff it starts before the latest end
    seen so far. Equal intervals are folded first, with their multiplicity.
    """
    from pyspark.sql import Window

    lineage = Window.partitionBy("canonical_ticker").orderBy("_from", "_to")
    earlier = lineage.rowsBetween(Window.unboundedPreceding, -1)
    folded = (
        aliases.select(
            "canonical_ticker",
            F.coalesce("effective_from", F.lit("0001-01-01").cast("date")).alias("_from"),
            F.coalesce("effective_to", F.lit("9999-12-31").cast("date")).alias("_to"),
        )
        .groupBy("canonical_ticker", "_from", "_to")
        .agg(F.count("*").alias("copies"))
    )
    reach = folded.withColumn("_reach", F.max("_to").over(earlier))
    clash = (F.col("copies") > 1) | F.coalesce(F.col("_from") < F.col("_reach"), F.lit(False))
    return reach.where(clash).select(
        "canonical_ticker",
        F.col("_from").alias("interval_from"),
        F.col("_to").alias("interval_to"),
        "copies",
    )


def snapshot_floors(df: DataFrame, min_rows: int, min_tickers: int = 0, min_delisted: int = 0) -> DataFrame:
    """Row, ticker and delisted counts of a snapshot against their floors (one row)."""
    delisted = F.count_if(F.col("delisted_date").isNotNull()) if "delisted_date" in df.columns else F.lit(0)
    counted = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
        delisted.cast("bigint").alias("delisted"),
    )
    ok = (F.col("rows") >= min_rows) & (F.col("tickers") >= min_tickers) & (F.col("delisted") >= min_delisted)
    return counted.withColumn("ok", ok)


def enforce(df: DataFrame, rules: Sequence[Rule], what: str) -> None:
    """Raise if any row breaks a rule. Runs one aggregate job; the answer has one row per rule."""
    broken = check(df, rules).where(F.col("broken_rows") > 0).collect()
    if broken:
        detail = ", ".join(f"{r.rule}: {r.broken_rows} of {r.total_rows}" for r in broken)
        raise QualityError(f"{what} breaks its rules: {detail}")


def enforce_empty(df: DataFrame, what: str, show: int = 5) -> None:
    """Raise if ``df`` has rows. The message has their number, names the table all of them
    were written to, and quotes the first ``show``."""
    found = stage(df, "violations")
    total = found.count()
    if total:
        quoted = ", ".join(str(tuple(r)) for r in found.orderBy(*found.columns).limit(show).collect())
        raise QualityError(f"{what}: {total} rows, all in {found.inputFiles()[0].rsplit('/', 1)[0]}, such as {quoted}")
