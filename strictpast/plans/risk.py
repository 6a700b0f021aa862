"""Cross-section risk model: exposures, weighted regression per day, decayed covariances.

Everything a day's regression needs is a set of sums, so no task ever holds the rows of a day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.contracts import refuse_labels, require_columns
from strictpast.operators.running import decayed_sums
from strictpast.plans.evaluation import trading_days
from strictpast.plans.panel import by_ticker
from strictpast.session import stage

# Deviations at which an exposure is clipped, half-lives in days.
CLIP_SIGMA = 3.0
FACTOR_HALF_LIFE, SPECIFIC_HALF_LIFE = 90.0, 60.0
MARKET = "market"
#: A column whose pivot shrinks to this share of its own square sum depends on earlier ones.
COLLINEAR = 1e-9


def _stats(df: DataFrame, names: Sequence[str], by: str) -> DataFrame:
    measures = [m for n in names for m in (F.avg(n).alias(f"_m_{n}"), F.stddev_pop(n).alias(f"_s_{n}"))]
    return stage(df.groupBy(by).agg(*measures), "exposure-stats")


def exposures(df: DataFrame, styles: Sequence[str], by: str = "date", sigma: float = CLIP_SIGMA) -> DataFrame:
    """``df`` with each style clipped to ``sigma`` deviations of its day and standardized.

    All styles share two passes. A missing style, and one that does not vary on its day, is average: 0.
    ``df`` is read three times: pass a stored one.
    """
    require_columns(df, [*styles, by], "exposures")
    refuse_labels(df.select(*styles), "exposures")
    rest = [c for c in df.columns if c not in styles]
    told = df.join(_stats(df, styles, by), by, "left")
    low = {s: F.col(f"_m_{s}") - sigma * F.col(f"_s_{s}") for s in styles}
    high = {s: F.col(f"_m_{s}") + sigma * F.col(f"_s_{s}") for s in styles}
    clipped = told.select(*rest, *(F.when(F.col(s).isNotNull(), F.least(F.greatest(s, low[s]), high[s])).alias(s) for s in styles))
    told = clipped.join(_stats(clipped, styles, by), by, "left")
    # A constant style has a deviation of rounding errors.
    varied = {s: F.col(f"_s_{s}") > 1e-12 * F.greatest(F.abs(f"_m_{s}"), F.lit(1e-12)) for s in styles}
    scores = {s: F.when(varied[s], (F.col(s) - F.col(f"_m_{s}")) / F.col(f"_s_{s}")) for s in styles}
    return told.select(*rest, *(F.coalesce(scores[s], F.lit(0.0)).alias(s) for s in styles))


def lagged_exposures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row with its ticker's earlier values of ``columns`` and its own arithmetic return ``ret``.

    A day's returns meet exposures that were known the day before.
    """
    require_columns(df, ["date", "ticker", "adj_close", *columns], "lagged exposures")
    rows = by_ticker()
    before = F.lag("adj_close").over(rows)
    return df.select(
        "date", "ticker", F.when(before > 0, F.col("adj_close") / before - 1).alias("ret"),
        *(F.lag(c).over(rows).alias(c) for c in columns),
    )


def _design(styles: Sequence[str], group: str, groups: Sequence[str]) -> dict[str, Column]:
    dummies = {g: F.when(F.col(group) == g, 1.0).otherwise(0.0) for g in groups}
    return {MARKET: F.lit(1.0), **{s: F.col(s) for s in styles}, **dummies}


def _eliminated(matrix: Column, size: int) -> Column:
    """Gauss-Jordan elimination of an array of rows ``[A | y]``; a dependent column leaves a row of zeros.

    Pivots are taken in order, so of columns that depend on each other the later ones go.
    """

    def pivot(rows: Column, k: Column) -> Column:
        own = F.get(rows, k)
        head = F.get(own, k)
        first = F.get(F.get(matrix, k), k)
        lead = F.transform(own, lambda v: v / head)

        def eliminate(row: Column, i: Column) -> Column:
            factor = F.get(row, k)
            return F.when(i == k, lead).otherwise(F.zip_with(row, lead, lambda a, b: a - factor * b))

        def cleared(row: Column, i: Column) -> Column:
            return F.when(i == k, F.transform(row, lambda v: F.lit(0.0))).otherwise(row)

        return F.when(head > COLLINEAR * first, F.transform(rows, eliminate)).otherwise(F.transform(rows, cleared))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, pivot)


def regress_by_date(
    df: DataFrame, y: str, styles: Sequence[str], group: str, groups: Sequence[str], weight: Column, by: str = "date"
) -> DataFrame:
    """``(by, rows, coefficients, r2)``: weighted least squares of ``y`` on an intercept, styles and group dummies.

    ``coefficients`` follows intercept, styles, groups; null stands for a column that depends on earlier ones
    (the last group always does where all rows have one). Rows need a return and a positive finite weight;
    ``styles`` may not be null. A day needs more rows than columns, else all its coefficients are null. The
    normal equations are sums with map-side combining, and are solved inside the row of the day.
    """
    require_columns(df, [by, y, *styles, group], "regression")
    columns = list(_design(styles, group, groups).values())
    size = len(columns)
    rows = df.withColumn("_w", weight).where(F.col(y).isNotNull() & (F.col("_w") > 0) & (F.col("_w") < float("inf")))
    rows = rows.select(by, F.col(y).alias("_y"), "_w", *(c.alias(f"_x{i}") for i, c in enumerate(columns)))
    entries = {f"_a{i}_{j}": F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(size) for j in range(i, size)}
    sides = {f"_b{i}": F.sum(F.col("_w") * F.col(f"_x{i}") * F.col("_y")) for i in range(size)}
    square = F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_yy")
    sums = rows.groupBy(by).agg(F.count("*").alias("rows"), square, *(v.alias(k) for k, v in {**entries, **sides}.items()))
    at = lambda i, j: F.col(f"_a{min(i, j)}_{max(i, j)}")
    matrix = F.array(*(F.array(*(at(i, j) for j in range(size)), F.col(f"_b{i}")) for i in range(size)))
    sums = stage(sums.select(by, "rows", "_yy", F.col("_a0_0").alias("_weight"), matrix.alias("_m")), "normal-equations")
    solved = sums.withColumn("_s", _eliminated(F.col("_m"), size))
    # The pivot of a kept column has become 1, of a dropped one 0.
    kept = F.transform("_s", lambda row, i: F.when(F.get(row, i) > 0.5, F.get(row, F.lit(size))))
    enough = F.col("rows") > size
    told = solved.withColumn("coefficients", F.when(enough, kept).otherwise(F.transform(kept, lambda c: F.lit(None).cast("double"))))
    sides_met = F.transform("_m", lambda row: F.get(row, F.lit(size)))
    explained = F.aggregate(F.zip_with("coefficients", sides_met, lambda c, b: F.coalesce(c, F.lit(0.0)) * b), F.lit(0.0), lambda a, v: a + v)
    mean = F.get(F.get(F.col("_m"), F.lit(0)), F.lit(size)) / F.col("_weight")
    total = F.col("_yy") - mean * mean * F.col("_weight")
    r2 = F.when(enough & (total > 0), 1 - (F.col("_yy") - explained) / total)
    return told.select(by, "rows", "coefficients", r2.alias("r2"))


def factor_returns(fits: DataFrame, styles: Sequence[str], groups: Sequence[str], by: str = "date") -> DataFrame:
    """``(by, factor, value)``: the coefficients by name."""
    names = F.array(*(F.lit(n) for n in (MARKET, *styles, *groups)))
    return fits.select(by, F.inline(F.arrays_zip(names.alias("factor"), F.col("coefficients").alias("value"))))


def residuals(df: DataFrame, fits: DataFrame, y: str, styles: Sequence[str], group: str, groups: Sequence[str], by: str = "date") -> DataFrame:
    """``(by, ticker, residual)``: what the day's coefficients leave of ``y``; null where the day has none."""
    fitted = F.lit(0.0)
    for i, x in enumerate(_design(styles, group, groups).values()):
        fitted = fitted + F.coalesce(F.col("coefficients")[i], F.lit(0.0)) * x
    known = F.exists("coefficients", lambda c: c.isNotNull())
    met = df.join(fits.select(by, "coefficients"), by)
    return met.select(by, "ticker", F.when(known, F.col(y) - fitted).alias("residual"))


def factor_covariance(returns: DataFrame, half_life: float = FACTOR_HALF_LIFE) -> DataFrame:
    """``(date, factor_a, factor_b, covariance)`` with ``factor_a <= factor_b``, for every day both have a return.

    The decayed mean of the products of both returns up to and with the day; ages count trading days of the
    table. Returns are taken about zero, as daily ones are. A day has as many pairs as the model has.
    """
    known = returns.where("value is not null")
    numbers = trading_days(returns)
    of_day = known.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("factor", "value"))).alias("f"))
    later = F.transform("f", lambda a, i: F.transform(F.slice("f", i + 1, F.size("f") - i), lambda b: F.struct(
        a["factor"].alias("factor_a"), b["factor"].alias("factor_b"), (a["value"] * b["value"]).alias("product"))))
    pairs = of_day.join(numbers, "date").select("date", "number", F.inline(F.flatten(later)))
    sums = decayed_sums(pairs, ["factor_a", "factor_b"], "number", half_life, {"_s": "product", "_w": F.lit(1.0)})
    return sums.select("date", "factor_a", "factor_b", (F.col("_s") / F.col("_w")).alias("covariance"))


def specific_variance(rest: DataFrame, half_life: float = SPECIFIC_HALF_LIFE) -> DataFrame:
    """``(date, ticker, variance)``: the decayed mean square of a ticker's residuals up to the day."""
    known = rest.where("residual is not null").join(trading_days(rest), "date")
    sums = decayed_sums(known.select("date", "ticker", "number", "residual"), ["ticker"], "number", half_life, {"_s": F.col("residual") * F.col("residual"), "_w": F.lit(1.0)})
    return sums.select("date", "ticker", (F.col("_s") / F.col("_w")).alias("variance"))


def acceptance(fits: DataFrame, rest: DataFrame) -> DataFrame:
    """``(mean_r2, residual_acf)``: the mean fit, and the correlation of residuals with the ticker's row before."""
    pairs = rest.select("residual", F.lag("residual").over(Window.partitionBy("ticker").orderBy("date")).alias("before"))
    return pairs.agg(fits.agg(F.avg("r2")).scalar().alias("mean_r2"), F.corr("residual", "before").alias("residual_acf"))
