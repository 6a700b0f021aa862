"""Trailing-twelve-month net income over market cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.functions import is_finite, positive_finite
from strictpast.plans.factors.base import Factor, FactorContext, eligibility
from strictpast.plans.fundamentals import INSUFFICIENT, MISSING, as_of_states, filing_states


class EarningsYield(Factor):
    name = "earnings_yield"
    formula = "ttm_net_income / mcap (E/P)"
    lookback_days = 365
    required = ("date", "ticker", "mcap")

    def _states(self, context: FactorContext) -> DataFrame:
        if context.fundamentals is None:
            raise ValueError(f"{self.name} requires context.fundamentals")
        return filing_states(context.fundamentals)

    def raw(self, panel: DataFrame, context: FactorContext, carried: Sequence[str] = ()) -> DataFrame:
        """``carried`` columns of the panel go through the sweep, which spares a join back to it."""
        asked = panel.select("date", "ticker", "mcap", eligibility(panel).alias("eligible"), *(c for c in carried if c != "mcap"))
        answered = as_of_states(asked, self._states(context), unique_requests=True)
        status = F.col("net_income_status")
        mcap = positive_finite(F.col("mcap"))
        ratio = F.try_divide("net_income_ttm", mcap)
        # Every filing problem but a short history reads as missing: the panel carries no
        # entity id that could settle an ambiguous ticker.
        reason = (
            F.when(status == INSUFFICIENT, F.lit(INSUFFICIENT))
            .when(status.isNotNull(), F.lit(MISSING))
            .when(mcap.isNull(), F.lit("invalid_denominator"))
            .when(~is_finite(ratio), F.lit("raw_factor_nan"))
        )
        return answered.select(
            "date",
            "ticker",
            F.when(reason.isNull(), ratio).alias("raw_value"),
            reason.alias("invalid_reason"),
            "eligible",
            "latest_lag_days",
            "oldest_lag_days",
            *carried,
        )

    def lags(self, factor_out: DataFrame, context: FactorContext) -> DataFrame:
        """(date, ticker, latest_lag_days, oldest_lag_days), invalid rows included."""
        asked = factor_out.select("date", "ticker")
        return as_of_states(asked, self._states(context), unique_requests=True).select(
            "date", "ticker", "latest_lag_days", "oldest_lag_days"
        )

    def diagnostics(
        self, factor_out: DataFrame, context: FactorContext | None = None, values: DataFrame | None = None
    ) -> DataFrame:
        rows = super().diagnostics(factor_out, context)
        if values is not None:
            return rows.unionByName(lag_distribution(values))
        if context is None or context.fundamentals is None:
            return rows
        return rows.unionByName(lag_distribution(self.lags(factor_out, context)))


def lag_distribution(lags: DataFrame) -> DataFrame:
    """(section, item, value) of both staleness measures; an empty measure gives no rows.

    Lags are whole days, so the exact percentile's buffer is bounded by the calendar.
    """
    sections = {
        "latest_filing_lag_days": "latest_lag_days",
        "oldest_ttm_component_lag_days": "oldest_lag_days",
    }
    stats = []
    for section, column in sections.items():
        q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.9)))
        stats.append(
            F.struct(
                F.lit(section).alias("section"),
                q[0].cast("int").cast("bigint").alias("median"),
                q[1].cast("int").cast("bigint").alias("p90"),
                F.max(column).cast("bigint").alias("max"),
                F.count(column).alias("n"),
            )
        )
    one = lags.agg(F.array(*stats).alias("s")).select(F.inline("s")).where(F.col("n") > 0)
    items = F.array(
        *(F.struct(F.lit(i).alias("item"), F.col(i).alias("value")) for i in ("median", "p90", "max", "n"))
    )
    return one.select("section", F.inline(items))
