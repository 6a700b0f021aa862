"""Forward returns: labels that know the future, kept apart from everything that may not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.contracts import LABEL_MARK, LABELS, columns_of, require_columns
from strictpast.functions import finite_or_null
from strictpast.operators.cross_section import winsorize
from strictpast.plans.panel import by_ticker
from strictpast.session import stage


def _listed_through(start: Column, end: Column) -> Column:
    """Whether one listing holds both days; a missing listing day is since ever, a missing end is open."""
    begun = F.col("_listed").isNull() | (F.col("_listed") <= start)
    return begun & (F.col("_delisted").isNull() | (end < F.col("_delisted")))


def forward_returns(
    bars: DataFrame, horizons: Sequence[int], listings: DataFrame | None = None, pct: tuple[float, float] = (0.01, 0.99)
) -> DataFrame:
    """``LABELS`` rows: the arithmetic return from a row's close to the close ``horizon`` rows later.

    ``label_end`` is the day of that later row, so a label's span is known whatever the gaps. There is no
    row where the series ends before, where a close is not positive, or, with ``listings`` (ticker,
    list_date, delisted_date), where no single listing of the ticker holds both days: a symbol that was
    given to another company makes no return. Returns are also clipped to the quantiles ``pct`` of
    their day and horizon. The last three columns are marked as labels: factors refuse them while planning.
    """
    require_columns(bars, ["date", "ticker", "adj_close"], "bars for labels")
    rows = by_ticker()
    ahead = [
        F.struct(
            F.lit(int(h)).alias("horizon"),
            F.lead("date", h).over(rows).alias("label_end"),
            F.when(F.col("adj_close") > 0, F.lead("adj_close", h).over(rows) / F.col("adj_close") - 1).alias("r"),
            (F.lead("adj_close", h).over(rows) > 0).alias("paid"),
        )
        for h in horizons
    ]
    spans = bars.select("date", "ticker", F.array(*ahead).alias("a")).select("date", "ticker", F.inline("a"))
    labels = spans.where("label_end is not null and paid").withColumn("forward_return", finite_or_null(F.col("r")))
    labels = labels.where("forward_return is not null").drop("r", "paid")
    if listings is not None:
        held = listings.select(F.col("ticker").alias("_t"), F.col("list_date").alias("_listed"), F.col("delisted_date").alias("_delisted"))
        inside = (F.col("ticker") == F.col("_t")) & _listed_through(F.col("date"), F.col("label_end"))
        labels = labels.join(held, inside, "left_semi")
    labels = winsorize(stage(labels, "labels"), "forward_return", "winsorized_return", pct, ["date", "horizon"])
    marked = {"label_end", "forward_return", "winsorized_return"}
    return labels.select(*(F.col(c).alias(c, metadata=LABEL_MARK) if c in marked else F.col(c) for c in columns_of(LABELS)))


def forward_columns(bars: DataFrame, horizons: Sequence[int]) -> tuple[DataFrame, dict[int, str]]:
    """``bars`` with one marked column ``ahead_<horizon>`` a horizon, and the columns by horizon.

    The same returns as :func:`forward_returns` without listings and bounds, null where that has no row: one
    row a bar instead of one a bar and horizon.
    """
    require_columns(bars, ["date", "ticker", "adj_close"], "bars for labels")
    names = {int(h): f"ahead_{int(h)}" for h in horizons}
    ahead = {}
    for h, name in names.items():
        later = F.lead("adj_close", h).over(by_ticker())
        ahead[name] = finite_or_null(F.when((F.col("adj_close") > 0) & (later > 0), later / F.col("adj_close") - 1))
    return bars.select(*bars.columns, *(c.alias(n, metadata=LABEL_MARK) for n, c in ahead.items())), names
