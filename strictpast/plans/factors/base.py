"""The factor plug-in surface and the steps every factor shares."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.contracts import FACTOR, conform, refuse_labels, require_columns
from strictpast.functions import is_finite
from strictpast.operators.cross_section import winsorize, zscore
from strictpast.operators.fingerprint import fingerprint
from strictpast.session import stage

# The closed set of reasons a factor value is unusable.
INVALID_REASONS = (
    "history_ineligible",
    "missing_fundamentals",
    "insufficient_quarters",
    "invalid_denominator",
    "raw_factor_nan",
)
VALID_LABEL = "__valid__"

SNAPSHOT_COLUMNS = (
    "date",
    "ticker",
    "raw_value",
    "winsorized_value",
    "zscore_value",
    "valid_flag",
    "tradable_flag",
    "invalid_reason",
)


@dataclass(frozen=True)
class FactorContext:
    """Side tables a factor may need besides the panel."""

    fundamentals: DataFrame | None = None


class Factor(ABC):
    """A named transform of the panel into the 10-column factor table."""

    name: ClassVar[str]
    formula: ClassVar[str]
    lookback_days: ClassVar[int]
    required: ClassVar[tuple[str, ...]] = ("date", "ticker")
    # Reason given to rows whose values came out unusable without an earlier reason.
    default_reason: ClassVar[str] = "raw_factor_nan"

    def __init_subclass__(cls, **kwargs: object) -> None:
        super().__init_subclass__(**kwargs)
        absent = [a for a in ("name", "formula", "lookback_days") if not hasattr(cls, a)]
        if absent:
            raise TypeError(f"{cls.__name__} must declare {', '.join(absent)}")

    @abstractmethod
    def raw(self, panel: DataFrame, context: FactorContext) -> DataFrame:
        """(date, ticker, raw_value, invalid_reason, eligible) for every panel row."""

    def compute(self, panel: DataFrame, context: FactorContext | None = None) -> DataFrame:
        """Raw values, per-date winsorize and z-score over all rows, flags, snapshot id.

        The raw values are staged once: the per-date passes then read two narrow columns
        instead of repeating the per-ticker windows.
        """
        require_columns(panel, self.required, f"panel for {self.name}")
        refuse_labels(panel, f"factor {self.name}")
        context = context or FactorContext()
        values = stage(self.raw(panel, context), f"raw-{self.name}")
        scored = zscore(winsorize(values, "raw_value", "winsorized_value"), "winsorized_value", "zscore_value")
        flagged = self._flag(scored)
        snapshot = fingerprint(flagged, SNAPSHOT_COLUMNS).scalar()
        return conform(
            flagged.withColumns({"factor_name": F.lit(self.name), "feature_snapshot_id": snapshot}),
            FACTOR,
        )

    def _flag(self, scored: DataFrame) -> DataFrame:
        """Validity and tradability of scored rows."""
        measured = ("raw_value", "winsorized_value", "zscore_value")
        finite = is_finite(F.col(measured[0])) & is_finite(F.col(measured[1])) & is_finite(F.col(measured[2]))
        valid = finite & F.col("invalid_reason").isNull()
        reason = F.coalesce("invalid_reason", F.when(~finite, F.lit(self.default_reason)))
        return scored.withColumns(
            {
                "valid_flag": valid,
                "tradable_flag": valid & F.col("eligible"),
                "invalid_reason": reason,
            }
        ).drop("eligible")

    def diagnostics(
        self, factor_out: DataFrame, context: FactorContext | None = None, values: DataFrame | None = None
    ) -> DataFrame:
        """(section, item, value) rows; a handful, whatever the factor's size.

        ``values`` are the staged raw values if the caller has them: what :meth:`raw` found on
        the way need not be found again.
        """
        return invalid_reason_counts(factor_out).select(
            F.lit("invalid_reason_counts").alias("section"),
            F.col("invalid_reason").alias("item"),
            F.col("rows").alias("value"),
        )


@dataclass(frozen=True)
class Computed:
    """A factor's table and the staged raw values it was made of."""

    table: DataFrame
    values: DataFrame


def compute_all(factors: Sequence[Factor], panel: DataFrame, context: FactorContext | None = None) -> dict[str, Computed]:
    """Several factors over one stored panel, standardized together.

    Raw values are staged once for each factor and stacked; winsorizing and z-scores then run once over
    (date, factor) groups, whatever the number of factors. Each table equals that of :meth:`Factor.compute`.
    """
    context = context or FactorContext()
    raws: dict[str, DataFrame] = {}
    stacked: DataFrame | None = None
    for factor in factors:
        if factor.name in raws:
            raise ValueError(f"factor {factor.name} is asked for twice")
        require_columns(panel, factor.required, f"panel for {factor.name}")
        refuse_labels(panel, f"factor {factor.name}")
        raws[factor.name] = stage(factor.raw(panel, context), f"raw-{factor.name}")
        one = raws[factor.name].select("date", "ticker", "raw_value", "invalid_reason", "eligible", F.lit(factor.name).alias("factor_name"))
        stacked = one if stacked is None else stacked.unionByName(one)
    if stacked is None:
        raise ValueError("no factor is asked for")
    group = ["date", "factor_name"]
    scored = zscore(winsorize(stacked, "raw_value", "winsorized_value", by=group), "winsorized_value", "zscore_value", by=group)
    scored = stage(scored, "scored-factors")
    out = {}
    for factor in factors:
        flagged = factor._flag(scored.where(F.col("factor_name") == factor.name))
        snapshot = fingerprint(flagged, SNAPSHOT_COLUMNS).scalar()
        out[factor.name] = Computed(conform(flagged.withColumn("feature_snapshot_id", snapshot), FACTOR), raws[factor.name])
    return out


def eligibility(panel: DataFrame) -> Column:
    """The panel's eligibility; everything is eligible when it has no such column."""
    if "eligible_flag" not in panel.columns:
        return F.lit(True)
    return F.coalesce("eligible_flag", F.lit(False))


def invalid_reason_counts(factor_out: DataFrame) -> DataFrame:
    label = F.coalesce("invalid_reason", F.lit(VALID_LABEL)).alias("invalid_reason")
    return factor_out.groupBy(label).agg(F.count("*").alias("rows"))


def diagnostics_dict(rows: DataFrame) -> dict[str, dict[str, int]]:
    """Diagnostics rows as a nested dict. Their number is fixed by the closed reason set."""
    out: dict[str, dict[str, int]] = {}
    for section, item, value in rows.collect():
        out.setdefault(section, {})[item] = value
    return out
