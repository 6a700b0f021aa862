"""12-1 momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.plans.factors.base import Factor, FactorContext, eligibility
from strictpast.plans.panel import by_ticker

SKIP_ROWS = 21
LOOKBACK_ROWS = 252


class Momentum(Factor):
    """Log price change from 252 to 21 rows ago; rows of the ticker, not calendar days."""

    name = "mom_12_1"
    formula = "log(P[t-21] / P[t-252])"
    lookback_days = LOOKBACK_ROWS
    required = ("date", "ticker", "adj_close")
    default_reason = "history_ineligible"

    @staticmethod
    def change() -> Column:
        """The raw value as a column over a ticker's rows."""
        log_price, rows = F.ln("adj_close"), by_ticker()
        return F.lag(log_price, SKIP_ROWS).over(rows) - F.lag(log_price, LOOKBACK_ROWS).over(rows)

    def raw(self, panel: DataFrame, context: FactorContext) -> DataFrame:
        return panel.select(
            "date",
            "ticker",
            self.change().alias("raw_value"),
            F.lit(None).cast("string").alias("invalid_reason"),
            eligibility(panel).alias("eligible"),
        )
