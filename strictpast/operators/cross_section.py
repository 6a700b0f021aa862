"""Per-group winsorize and z-score that hold when one group has most of the rows.

A window over the group would pull the whole group into one task. Here the group
statistics are aggregates with map-side combining, and are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.contracts import require_columns
from strictpast.session import stage

# Rank accuracy of the sketch that brackets the wanted ranks.
SKETCH_ACCURACY = 20_000


def _check_bounds(pct: tuple[float, float]) -> tuple[float, float]:
    lower, upper = pct
    if not 0.0 <= lower < upper <= 1.0:
        raise ValueError(f"invalid percentile bounds {pct!r}; require 0 <= lower < upper <= 1")
    return lower, upper


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _present(value: str, by: list[str]) -> Column:
    return reduce(and_, (F.col(c).isNotNull() for c in (value, *by)))


def group_bounds(
    df: DataFrame, value: str, by: str | Sequence[str], pct: tuple[float, float], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Exact linear-interpolated quantiles ``(by, lo, hi)`` of the non-null values per group.

    ``by`` is a column or several.

    One path for every size, and no task holds a group:
    1. a mergeable sketch cuts each group into five segments, two of them narrow ones that
       should hold the wanted ranks;
    2. one pass counts the segments, which tells exactly which of them each rank lies in, so
       the sketch only decides how much is left to order, never the result;
    3. of these segments, equal values are counted map-side and the distinct ones are ordered.
    """
    lower, upper = _check_bounds(pct)
    by = _names(by)
    values = df.where(_present(value, by)).select(*by, F.col(value).alias("v"))
    slack = 3.0 / accuracy
    probes = [min(1.0, max(0.0, p + side * slack)) for p in (lower, upper) for side in (-1, 1)]
    sketched = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile_approx("v", probes, accuracy).alias("cuts")
    )
    sketched = stage(sketched, "sketched-bounds")

    v, cuts = F.col("v"), [F.col("cuts")[i] for i in range(4)]
    segment = F.when(v < cuts[0], 0).when(v <= cuts[1], 1).when(v < cuts[2], 2).when(v <= cuts[3], 3)
    placed = values.join(sketched.select(*by, "cuts"), by).select(*by, segment.otherwise(4).alias("seg"), "v")
    sizes = placed.groupBy(*by, "seg").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*by).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))

    # 0-based ranks on either side of each fractional position.
    ranks = [
        F.struct(F.lit(f"{side}_{end}").alias("name"), fn((F.col("n") - 1) * F.lit(p)).cast("bigint").alias("rank"))
        for side, p in (("lo", lower), ("hi", upper))
        for end, fn in (("a", F.floor), ("b", F.ceil))
    ]
    wanted = sketched.select(*by, F.explode(F.array(*ranks)).alias("r")).select(*by, "r.*").join(sizes, by)
    wanted = wanted.where(F.col("rank").between(F.col("below"), F.col("below") + F.col("c") - 1))
    wanted = stage(wanted.select(*by, "seg", "name", (F.col("rank") - F.col("below")).alias("place")), "wanted-ranks")

    needed = wanted.select(*by, "seg").distinct()
    distinct = placed.join(needed, [*by, "seg"], "left_semi").groupBy(*by, "seg", "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by, "seg").orderBy("v")
    ordered = distinct.withColumn("upto", F.sum("c").over(order))
    met = ordered.join(wanted, [*by, "seg"])
    picked = met.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))
    found = picked.groupBy(*by).agg(
        *(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ("lo_a", "lo_b", "hi_a", "hi_b"))
    )

    def interpolated(p: float, a: str, b: str):
        weight = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
        return F.when(weight == 0, F.col(a)).otherwise(F.col(a) * (1 - weight) + F.col(b) * weight)

    return found.join(sketched.select(*by, "n"), by).select(
        *by, interpolated(lower, "lo_a", "lo_b").alias("lo"), interpolated(upper, "hi_a", "hi_b").alias("hi")
    )


def _with_stats(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Attach one row of statistics per group; broadcast only if the planner sees it is small."""
    return df.join(stage(stats, "group-stats"), by, "left")


def winsorize(
    df: DataFrame,
    value: str,
    out: str,
    pct: tuple[float, float] = (0.01, 0.99),
    by: str | Sequence[str] = "date",
) -> DataFrame:
    """Clip ``value`` to its group's quantile bounds; missing values stay missing.

    A row without a group has no bounds and keeps its value. Reads ``df`` more than once:
    pass a stored or staged table.
    """
    by = _names(by)
    require_columns(df, [value, *by], "winsorize input")
    bounds = group_bounds(df, value, by, _check_bounds(pct))
    # greatest/least skip NULLs, so a missing value must not reach them.
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(value, "_lo"), "_hi"))
    bounds = bounds.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    return _with_stats(df, bounds, by).select(*df.columns, clipped.alias(out))


def zscore(df: DataFrame, value: str, out: str, by: str | Sequence[str] = "date", ddof: int = 0) -> DataFrame:
    """Standardize ``value`` within its group; groups without spread give NULL."""
    by = _names(by)
    require_columns(df, [value, *by], "zscore input")
    if ddof not in (0, 1):
        raise ValueError(f"ddof must be 0 or 1, got {ddof!r}")
    spread = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    stats = (
        df.where(_present(value, by))
        .groupBy(*by)
        .agg(F.avg(value).alias("_mean"), spread.alias("_sd"))
    )
    score = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd"))
    return _with_stats(df, stats, by).select(*df.columns, score.alias(out))
