"""Trading costs and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.contracts import require_columns
from strictpast.operators.cross_section import group_bounds
from strictpast.operators.running import prefix_sums
from strictpast.plans.panel import by_ticker
from strictpast.session import stage

# Half spreads of large and other names, borrow a year by cap, a flat one-way cost; basis points.
LARGE_SPREAD, OTHER_SPREAD, FLAT_COST = 2.0, 5.0, 3.0
LARGE_BORROW, MIDDLE_BORROW, SMALL_BORROW = 25.0, 150.0, 500.0
# The impact law, and how much of a day's volume and of the book a position may be.
IMPACT, EXPONENT = 0.10, 1.5
VOLUME_SHARE, POSITION_SHARE = 0.05, 0.02
YEAR_DAYS, VOLUME_DAYS = 252, 21
BASIS = 1e-4
#: Rows of a day that are sorted in one task for their weights; larger days go over range partitions.
MOST_ROWS = 1_000_000


def mean_volume(days: int = VOLUME_DAYS) -> Column:
    """The mean value traded over the ticker's last ``days`` rows, this one included, as a column over its bars."""
    return F.avg(F.col("volume") * F.col("raw_close")).over(by_ticker().rowsBetween(1 - days, 0))


def dollar_volume(bars: DataFrame, days: int = VOLUME_DAYS) -> DataFrame:
    """``(date, ticker, adv)``: :func:`mean_volume` of every bar."""
    return bars.select("date", "ticker", mean_volume(days).alias("adv"))


def tier_flags(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """``rows`` plus ``large`` and ``small``: whether ``mcap`` is in the top or bottom two tenths of its day in ``caps``.

    The bounds are exact quantiles from mergeable counts, not a window over the day. ``caps``, ``(date, mcap)``,
    is read several times: pass a stored one.
    """
    bounds = stage(group_bounds(caps, "mcap", "date", (0.2, 0.8)), "cap-bounds").withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    flag = lambda test: F.coalesce(test, F.lit(False))
    met = rows.join(bounds, "date", "left")
    return met.select(*rows.columns, flag(F.col("mcap") >= F.col("_hi")).alias("large"), flag(F.col("mcap") < F.col("_lo")).alias("small"))


def size_tiers(bars: DataFrame) -> DataFrame:
    """``(date, ticker, mcap, large, small)`` of every bar."""
    sized = stage(bars.select("date", "ticker", "mcap"), "caps")
    return tier_flags(sized, sized)


def position_caps(adv: Column, gmv: float, share: float = POSITION_SHARE) -> Column:
    """The largest weight of a name: a share of the book, and of its volume; without volume, none."""
    return F.when(adv.isNotNull(), F.least(F.lit(share), VOLUME_SHARE * adv / gmv)).otherwise(F.lit(0.0))


def capped_weights(df: DataFrame, raw: str, cap: str, by: str = "date", total: float = 1.0, most: int = MOST_ROWS) -> DataFrame:
    """``df`` plus ``weight``: shares of ``total`` by ``raw``, cut at ``cap``, the excess shared again until all fit.

    The end of that process is known at once. In order of cap over raw, some first rows are cut, and the
    others share what is left; the first row whose share fits tells where. Sums of the rows before give each row
    what it would get as the first one not cut. A day's rows are sorted in one task; days of more than ``most``
    rows that weigh something are dealt to range partitions, so a day may be of any size. A raw value that is
    null or not positive weighs nothing; where all caps together are below ``total``, all rows are at their caps.
    """
    require_columns(df, [raw, cap, by, "ticker"], "capped weights")
    rows = stage(df, "raw-weights")
    wanted = F.col(raw) > 0
    room = F.greatest(F.coalesce(F.col(cap), F.lit(0.0)), F.lit(0.0))
    live = rows.where(wanted).withColumns({"_cap": room, "_level": room / F.col(raw)})
    large = stage(live.groupBy(by).agg(F.count("*").alias("_size")).where(F.col("_size") > most).select(F.col(by).alias("_by")), "large-groups")
    out = rows.where(~F.coalesce(wanted, F.lit(False))).withColumn("weight", F.lit(0.0))
    same = F.col(by).eqNullSafe(F.col("_by"))
    if large.isEmpty():
        return _levelled(live, rows.columns, raw, by, total).unionByName(out)
    dealt = _levelled_ranges(live.join(large, same, "left_semi"), rows.columns, raw, by, total)
    return _levelled(live.join(large, same, "left_anti"), rows.columns, raw, by, total).unionByName(dealt).unionByName(out)


def _levelled(live: DataFrame, columns: list[str], raw: str, by: str, total: float) -> DataFrame:
    """Weights of groups that one task sorts: one shuffle, by group."""
    order = Window.partitionBy(by).orderBy("_level", "ticker")
    before, upto = (order.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    sums = live.withColumns({"_caps": F.coalesce(F.sum("_cap").over(before), zero), "_raws": F.coalesce(F.sum(raw).over(before), zero), "_all": F.sum(raw).over(whole)})
    told = sums.withColumn("_share", (F.lit(total) - F.col("_caps")) / (F.col("_all") - F.col("_raws")))
    fits = F.when(F.col(by).isNotNull() & (F.col("_share") <= F.col("_level")), F.col("_share"))
    met = told.withColumn("_fits", fits).withColumns({"_met": F.count("_fits").over(upto), "_first": F.first("_fits", True).over(whole)})
    return met.select(*columns, F.when(F.col("_met") == 0, F.col("_cap")).otherwise(F.least(F.col("_first") * F.col(raw), F.col("_cap"))).alias("weight"))


def _levelled_ranges(live: DataFrame, columns: list[str], raw: str, by: str, total: float) -> DataFrame:
    """The same of groups of any size: prefix sums over range partitions."""
    before = stage(prefix_sums(live, [by], ["_level", "ticker"], {"_caps": "_cap", "_raws": raw}), "cap-prefixes")
    sums = before.groupBy(by).agg(F.sum(raw).alias("_all"))
    told = before.join(sums, by).withColumn("_share", (F.lit(total) - F.col("_caps")) / (F.col("_all") - F.col("_raws")))
    first = told.where(F.col("_share") <= F.col("_level")).groupBy(by).agg(F.min(F.struct("_level", "ticker", "_share")).alias("_first"))
    met = before.join(first, by, "left")
    at_cap = F.col("_first").isNull() | (F.struct("_level", "ticker") < F.struct("_first._level", "_first.ticker"))
    return met.select(*columns, F.when(at_cap, F.col("_cap")).otherwise(F.least(F.col("_first._share") * F.col(raw), F.col("_cap"))).alias("weight"))


def trade_costs(weights: DataFrame, bars: DataFrame, gmv: float, spread: str | None = None) -> DataFrame:
    """:func:`cost_columns` of ``(date, ticker, weight)``; what they need of the market comes from ``bars``."""
    require_columns(weights, ["date", "ticker", "weight"], "weights")
    carried = [spread] if spread else []
    market = stage(bars.select("date", "ticker", "mcap", mean_volume().alias("adv")), "market")
    met = weights.select("date", "ticker", "weight", *carried).join(tier_flags(market, market), ["date", "ticker"], "left")
    return cost_columns(met, gmv, spread)


def cost_columns(rows: DataFrame, gmv: float, spread: str | None = None) -> DataFrame:
    """``(date, ticker, trade, spread_cost, impact_cost, borrow_cost, cost, flat_cost)`` of ``(date, ticker, weight, adv, large, small)``.

    The trade is the change of a ticker's weight from its row before (from 0 at first). Costs are shares of the
    book: half the spread on the trade (``spread`` names a column with half spreads; otherwise the
    floors by size), impact by the power law of the trade's share of volume, and a day's borrow on a short weight by size. A trade
    without known volume has no impact cost and so no total. Rows are shuffled once, by ticker.
    """
    require_columns(rows, ["date", "ticker", "weight", "adv", "large", "small"], "weights and market")
    trade = F.col("weight") - F.coalesce(F.lag("weight").over(by_ticker()), F.lit(0.0))
    met = rows.withColumn("trade", trade)
    size = F.abs("trade")
    floors = F.when(F.col("large"), LARGE_SPREAD).otherwise(OTHER_SPREAD) * BASIS
    half = F.coalesce(F.col(spread), floors) if spread else floors
    impact = F.when(size == 0, 0.0).when(F.col("adv") > 0, IMPACT * F.pow(size * gmv / F.col("adv"), F.lit(EXPONENT)))
    rate = F.when(F.col("large"), LARGE_BORROW).when(F.col("small"), SMALL_BORROW).otherwise(MIDDLE_BORROW) * BASIS
    borrow = rate * F.greatest(-F.col("weight"), F.lit(0.0)) / YEAR_DAYS
    out = met.select("date", "ticker", "trade", (half * size).alias("spread_cost"), impact.alias("impact_cost"), borrow.alias("borrow_cost"))
    whole = F.col("spread_cost") + F.col("impact_cost") + F.col("borrow_cost")
    return out.withColumns({"cost": whole, "flat_cost": FLAT_COST * BASIS * size})
