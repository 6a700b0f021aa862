"""How well factor values rank later returns: information coefficients, tests, gates, folds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.contracts import require_columns
from strictpast.operators.running import prefix_minima, prefix_sums
from strictpast.session import stage

# The promotion and retirement gate.
PROMOTE_T, RETIRE_T, FALSE_DISCOVERY = 3.0, 1.5, 0.10
# Decay horizons in days, and those whose signs and sizes are compared.
DECAY_HORIZONS, NEAR, MIDDLE, FAR = (1, 2, 3, 5, 7), 1, 3, 5
# Days of a fold, of a label and of the embargo.
FOLD_DAYS, EMBARGO_DAYS = 252, 5
PROMOTED, RETIRED, HELD = "promoted", "retired", "held"
#: Rows of a group that are ranked in one task; larger groups are ranked over range partitions.
MOST_ROWS = 1_000_000


# --- rank correlation ---------------------------------------------------------------------


def average_ranks(counts: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """``(by, value, out)`` of ``(by, value, c)``, one row for each value: ranks from 1, ties at their mean.

    The rank is the number of smaller ones plus half of its own: prefix sums over range partitions,
    so no window spans a group.
    """
    placed = prefix_sums(counts, by, [value], {"_before": "c"})
    return placed.select(*by, value, (F.col("_before") + (F.col("c") + 1) / 2).alias(out))


def rank_correlation(df: DataFrame, x: str, y: str, by: Sequence[str], out: str = "ic") -> DataFrame:
    """``(by, rows, out)``: Spearman's correlation by group, over rows where both values are present.

    Equal pairs are counted first; ranks come from value counts and are joined to the pairs. A group
    in which a value never changes gives null.
    """
    by = list(by)
    require_columns(df, [x, y, *by], "rank correlation input")
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = stage(both.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")), "pairs")
    ranked = pairs
    for side in ("x", "y"):
        counts = stage(pairs.groupBy(*by, side).agg(F.sum("c").alias("c")), "value-counts")
        ranks = average_ranks(counts, side, by, f"r{side}")
        ranked = ranked.join(stage(ranks, "ranks"), [*by, side])
    c, rx, ry = F.col("c").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*by).agg(
        F.sum("c").alias("rows"), F.sum(c * rx * ry).alias("xy"), F.sum(c * rx * rx).alias("xx"), F.sum(c * ry * ry).alias("yy")
    )
    n = F.col("rows").cast("double")
    square = n * (n + 1) * (n + 1) / 4
    spread = (F.col("xx") - square) * (F.col("yy") - square)
    # Ranks are halves of whole numbers: a group of one value has no spread but for rounding.
    varied = (F.col("xx") - square > 0.25) & (F.col("yy") - square > 0.25)
    return sums.select(*by, "rows", F.when(varied, (F.col("xy") - square) / F.sqrt(spread)).alias(out))


def rank_correlations(df: DataFrame, xs: Sequence[str], ys: Sequence[str], by: Sequence[str], most: int = MOST_ROWS) -> DataFrame:
    """``(by, x, y, rows, ic)``: :func:`rank_correlation` of every one of ``xs`` with every one of ``ys``, by name.

    Rows are shuffled once, by group, whatever the number of pairs: a column is sorted once and its ranks among
    the rows of each partner are running counts. That sorts a group in one task, so groups of more than
    ``most`` rows go the way of :func:`rank_correlation`, pair by pair. ``df`` is read twice: pass a stored one.
    """
    by, xs, ys = list(by), list(xs), list(ys)
    require_columns(df, [*xs, *ys, *by], "rank correlation input")
    if most > MOST_ROWS:
        raise ValueError(f"sums of squared ranks of more than {MOST_ROWS} rows do not fit a long")
    sizes = stage(df.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") > most), "large-groups")
    large = sizes.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)))
    any_large = not sizes.isEmpty()
    ranked = df.select(*by, *xs, *ys)
    if any_large:
        ranked = ranked.join(large, same, "left_anti")
    pairs = [(i, j) for i in range(len(xs)) for j in range(len(ys))]
    both = {(i, j): (F.col(xs[i]).isNotNull() & F.col(ys[j]).isNotNull()).cast("bigint") for i, j in pairs}

    def twice_ranks(column: str, side: str, met: list[tuple[int, int]]) -> dict[str, Column]:
        """Rows up to and with the value, less half of the equal ones, and one half; doubled."""
        order = Window.partitionBy(*by).orderBy(column)
        upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        equal = order.rangeBetween(Window.currentRow, Window.currentRow)
        return {f"_{side}{i}_{j}": 2 * F.sum(both[i, j]).over(upto) - F.sum(both[i, j]).over(equal) + 1 for i, j in met}

    for i, x in enumerate(xs):
        ranked = ranked.withColumns(twice_ranks(x, "x", [p for p in pairs if p[0] == i]))
    for j, y in enumerate(ys):
        ranked = ranked.withColumns(twice_ranks(y, "y", [p for p in pairs if p[1] == j]))
    sums, told = [], []
    for i, j in pairs:
        rx, ry, here = F.col(f"_x{i}_{j}"), F.col(f"_y{i}_{j}"), both[i, j] == 1
        products = {"xy": rx * ry, "xx": rx * rx, "yy": ry * ry}
        sums += [F.sum(both[i, j]).alias(f"_n{i}_{j}"), *(F.sum(F.when(here, v)).alias(f"_{k}{i}_{j}") for k, v in products.items())]
        n = F.col(f"_n{i}_{j}")
        square = n * (n + 1) * (n + 1)
        xy, xx, yy = (F.col(f"_{k}{i}_{j}") - square for k in products)
        # Whole numbers throughout: a column that never varies has a spread of exactly zero.
        ic = F.when((xx > 0) & (yy > 0), xy.cast("double") / F.sqrt(xx.cast("double") * yy.cast("double")))
        told.append(F.struct(F.lit(xs[i]).alias("x"), F.lit(ys[j]).alias("y"), n.alias("rows"), ic.alias("ic")))
    out = ranked.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*told))).where("rows > 0")
    if not any_large:
        return out
    rest = stage(df.join(large, same, "left_semi"), "large-group-rows")
    for x in xs:
        for y in ys:
            slow = rank_correlation(rest, x, y, by)
            out = out.unionByName(slow.select(*by, F.lit(x).alias("x"), F.lit(y).alias("y"), "rows", "ic"))
    return out


def ic_by_date(rows: DataFrame, factors: Sequence[str], ahead: Mapping[int, str], least_rows: int = 3) -> DataFrame:
    """``(factor_name, horizon, date, rows, ic)`` of ``rows``, one for each date and ticker.

    ``factors`` are value columns, ``ahead`` the label columns by horizon (:func:`labels.forward_columns`).
    Days with fewer than ``least_rows`` pairs give no row.
    """
    require_columns(rows, ["date", *factors, *ahead.values()], "factor values and labels")
    found = rank_correlations(rows, factors, list(ahead.values()), ["date"]).where(F.col("rows") >= least_rows)
    horizon = F.coalesce(*(F.when(F.col("y") == name, F.lit(h)) for h, name in ahead.items()))
    return found.select(F.col("x").alias("factor_name"), horizon.cast("int").alias("horizon"), "date", "rows", "ic")


def ic_summary(ic: DataFrame, by: Sequence[str] = ("factor_name", "horizon"), lags: int | None = None) -> DataFrame:
    """``(by, dates, mean_ic, sd_ic, t_hac)``: the mean coefficient against a variance that allows for overlap.

    Labels of ``horizon`` days overlap, so the variance adds autocovariances up to ``horizon`` lags
    (``lags`` at most, by default the largest horizon) with Bartlett's falling weights. Lags count the days that have a coefficient.
    A group has one row a day, so its window is bounded by the calendar.
    """
    by = list(by)
    ic = stage(ic.where("ic is not null"), "coefficients")
    if lags is None:
        lags = ic.agg(F.max("horizon")).first()[0] or 0  # one number
    means = ic.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"))
    told = ic.join(means, by).withColumn("_d", F.col("ic") - F.col("mean_ic"))
    order = Window.partitionBy(*by).orderBy("date")
    gammas = {f"_g{k}": F.col("_d") * F.lag("_d", k).over(order) for k in range(lags + 1)}
    sums = told.withColumns(gammas).groupBy(*by).agg(
        F.count("*").alias("dates"), F.first("mean_ic").alias("mean_ic"), F.first("sd_ic").alias("sd_ic"),
        *(F.coalesce(F.sum(g), F.lit(0.0)).alias(g) for g in gammas),
    )
    weighted = F.col("_g0")
    for k in range(1, lags + 1):
        bartlett = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(float(k)) / (F.col("horizon") + 1))
        weighted = weighted + F.lit(2.0) * bartlett * F.col(f"_g{k}")
    n = F.col("dates").cast("double")
    error = F.sqrt(weighted) / n
    return sums.select(*by, "dates", "mean_ic", "sd_ic", F.when((weighted > 1e-18) & (n > 1), F.col("mean_ic") / error).alias("t_hac"))


def decay_gate(summary: DataFrame) -> DataFrame:
    """``(factor_name, t_near, t_middle, fades, flips, retire)`` from the summaries by horizon.

    A factor fades when it passes on the nearest horizon and fails on the middle one; it flips when the
    mean coefficient changes its sign to the far one.
    """
    at = lambda column, h: F.max(F.when(F.col("horizon") == h, F.col(column)))
    wide = summary.groupBy("factor_name").agg(
        at("t_hac", NEAR).alias("t_near"), at("t_hac", MIDDLE).alias("t_middle"),
        at("mean_ic", NEAR).alias("_near"), at("mean_ic", FAR).alias("_far"),
    )
    fades = F.coalesce((F.abs("t_near") > PROMOTE_T) & (F.abs("t_middle") < RETIRE_T), F.lit(False))
    flips = F.coalesce(F.col("_near") * F.col("_far") < 0, F.lit(False))
    return wide.select("factor_name", "t_near", "t_middle", fades.alias("fades"), flips.alias("flips"), (fades | flips).alias("retire"))


# --- multiple testing and gates ---------------------------------------------------------------


def two_sided_p(t: Column) -> Column:
    """The chance that a standard normal number is as far from zero as ``t``; null for null.

    Near zero by the series of the error function, whose terms are all positive; beyond, by the
    continued fraction of its complement, from the innermost term outwards. Right to about 1e-14.
    """
    z = F.abs(t) / math.sqrt(2.0)
    steps = F.sequence(F.lit(1), F.lit(60))
    start = F.struct(z.alias("term"), z.alias("total"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * 2.0 * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    near = 1.0 - F.aggregate(steps, start, add, lambda s: s["total"]) * F.exp(-z * z) * (2.0 / math.sqrt(math.pi))
    depth = F.aggregate(F.reverse(steps), z, lambda f, k: z + k.cast("double") / 2.0 / f)
    far = F.exp(-z * z) / (depth * math.sqrt(math.pi))
    return F.when(z < 2.5, near).when(z.isNotNull(), far)


def step_up(tests: DataFrame, p: str, ids: Sequence[str], by: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """Add the step-up adjusted ``p``: the least ``m * p / rank`` of a test and those with larger ``p``.

    ``m`` counts the tests of a family (``by``) with a ``p``; the others keep null. ``ids`` make a test unique.
    Ranks are prefix sums and the minimum is a prefix minimum from the top, so a family has no bound.
    """
    by, ids = list(by), list(ids)
    tests = stage(tests, "tests")
    known = tests.where(F.col(p).isNotNull())
    ranked = prefix_sums(known, by, [p, *ids], {"_before": F.lit(1)})
    if by:
        sized = ranked.join(known.groupBy(*by).agg(F.count("*").alias("_m")), by)
    else:
        sized = ranked.withColumn("_m", known.agg(F.count("*")).scalar())
    raw = sized.withColumns({"_raw": F.least(F.lit(1.0), F.col("_m") * F.col(p) / (F.col("_before") + 1)), "_down": -F.col("_before")})
    least = prefix_minima(stage(raw, "raised"), by, ["_down"], "_raw", out)
    absent = tests.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return least.select(*tests.columns, out).unionByName(absent)


def gate_states(tests: DataFrame, run: str, ids: Sequence[str], q: float = FALSE_DISCOVERY) -> DataFrame:
    """``tests`` (with ``t``) plus ``p``, ``p_adjusted``, ``decision`` and ``state`` over successive runs.

    In each run a test is promoted whose ``|t|`` reaches the hurdle and whose adjusted ``p`` within the run is at
    most ``q``, retired when ``|t|`` falls below the lower bound, and held otherwise (a null ``t`` too). The
    state is that of the last run that decided, and held before the first decision.
    """
    tested = step_up(tests.withColumn("p", two_sided_p(F.col("t"))), "p", ids, [run])
    size = F.abs("t")
    decision = F.when((size >= PROMOTE_T) & (F.col("p_adjusted") <= q), PROMOTED).when(size < RETIRE_T, RETIRED)
    upto = Window.partitionBy(*ids).orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    decided = tested.withColumn("_d", decision)
    state = F.coalesce(F.last("_d", ignorenulls=True).over(upto), F.lit(HELD))
    return decided.select(*tests.columns, "p", "p_adjusted", F.coalesce("_d", F.lit(HELD)).alias("decision"), state.alias("state"))


# --- folds ------------------------------------------------------------------------------------


def trading_days(days: DataFrame) -> DataFrame:
    """``(date, number)``: the distinct days in order, from 0. As many rows as the calendar has days."""
    distinct = days.where("date is not null").select("date").distinct()
    return distinct.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("number"))


def cv_folds(days: DataFrame, length: int = FOLD_DAYS, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """``(fold, test_start, test_end, first_day, last_day, guard_from, guard_to)`` of expanding walk-forward folds.

    Fold ``k`` tests the ``length`` trading days from day ``k * length`` on, and trains on what is before; the
    first block is never tested, the last may be short. No training label may touch the guarded days: the test and
    ``embargo`` days on either side. ``test_*`` are dates, the others day numbers.
    """
    numbered = trading_days(days).withColumn("fold", F.floor(F.col("number") / length).cast("int")).where("fold > 0")
    folds = numbered.groupBy("fold").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.min("number").alias("first_day"), F.max("number").alias("last_day")
    )
    return folds.withColumns({"guard_from": F.col("first_day") - embargo, "guard_to": F.col("last_day") + embargo})


def fold_membership(labels: DataFrame, days: DataFrame, length: int = FOLD_DAYS, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """``(date, ticker, horizon, test_fold, train_from, purged_from)`` of every label.

    ``test_fold`` is the fold that tests the label's day (null in the first block). The label trains in every
    fold from ``train_from`` on that exists; ``purged_from`` is the first fold before which it lies and in whose guarded days its span still is, or null.
    Spans and guarded days meet in buckets of ``length`` days: each is dealt to the few buckets it
    touches, and the join has equal keys. Rows are labels, not labels times folds.
    """
    numbers = stage(trading_days(days), "trading-days")
    folds = stage(cv_folds(days, length, embargo), "folds")

    def buckets(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / length), F.floor(high / length))).alias("bucket")

    guarded = folds.select("fold", "guard_from", "guard_to", buckets(F.col("guard_from"), F.col("guard_to")))
    start = numbers.select("date", F.col("number").alias("_from"))
    end = numbers.select(F.col("date").alias("label_end"), F.col("number").alias("_to"))
    spans = labels.select("date", "ticker", "horizon", "label_end").join(start, "date").join(end, "label_end")
    spans = spans.withColumn("_block", F.floor(F.col("_from") / length).cast("int"))
    dealt = spans.select("date", "ticker", "horizon", "_from", "_to", "_block", buckets(F.col("_from"), F.col("_to")))
    touching = (F.col("_from") <= F.col("guard_to")) & (F.col("_to") >= F.col("guard_from")) & (F.col("fold") > F.col("_block"))
    met = dealt.join(guarded, "bucket", "left")
    hit = F.when(touching, F.col("fold"))
    purged = met.groupBy("date", "ticker", "horizon", "_block").agg(F.min(hit).alias("purged_from"), F.max(hit).alias("_last"))
    return purged.select(
        "date", "ticker", "horizon", F.when(F.col("_block") > 0, F.col("_block")).alias("test_fold"),
        (F.coalesce("_last", "_block") + 1).alias("train_from"), "purged_from",
    )


def fold_counts(membership: DataFrame, folds: DataFrame) -> DataFrame:
    """``(fold, horizon, test_rows, train_rows, purged_rows)`` of every fold and horizon with a label.

    Labels are counted by their three folds first; only these few cells are unrolled over the folds.
    """
    cells = membership.groupBy("horizon", "test_fold", "train_from", "purged_from").agg(F.count("*").alias("c"))
    last = folds.agg(F.max("fold")).scalar()
    first = F.least("test_fold", "train_from", "purged_from")
    unrolled = cells.withColumn("fold", F.explode(F.when(first <= last, F.sequence(first, last))))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("c"))), F.lit(0)).alias
    return unrolled.groupBy("fold", "horizon").agg(
        count(F.col("fold") == F.col("test_fold"))("test_rows"),
        count(F.col("fold") >= F.col("train_from"))("train_rows"),
        count((F.col("fold") >= F.col("purged_from")) & (F.col("fold") < F.col("train_from")))("purged_rows"),
    )
