"""Labels, coefficients, gates, folds, risk model and costs on cases with known answers."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import business_days
from strictpast.contracts import ContractError, LABELS, columns_of
from strictpast.operators.cross_section import winsorize
from strictpast.operators.running import decayed_sums, prefix_minima
from strictpast.plans import costs, evaluation, labels, risk, sectors
from strictpast.plans.factors import Momentum

DAY = date(2020, 1, 6)


# --- running ------------------------------------------------------------------------------


def test_decayed_sums_over_many_positions(spark):
    r = random.Random(4)
    rows = [(g, p, r.uniform(-1, 1) if r.random() > 0.1 else None) for g in ("a", None) for p in sorted(r.sample(range(6000), 700))]
    df = spark.createDataFrame(rows, "g string, p int, v double")
    got = {(x.g, x.p): (x.s, x.n) for x in decayed_sums(df, ["g"], "p", 7.0, {"s": "v", "n": F.lit(1)}).collect()}
    state = {}
    for g, p, v in rows:
        at, s, n = state.get(g, (p, 0.0, 0.0))
        fade = 0.5 ** ((p - at) / 7.0)
        state[g] = (p, s * fade + (v or 0.0), n * fade + 1.0)
        assert got[g, p] == pytest.approx(state[g][1:], rel=1e-12, abs=1e-13)
    assert len(got) == len(rows)


def test_prefix_minima(spark):
    r = random.Random(5)
    rows = [("xy"[i % 2], i, r.randint(0, 99)) for i in range(200)]
    got = {x.i: x.least for x in prefix_minima(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], "v", "least").collect()}
    assert got == {i: min(v for h, j, v in rows if h == g and j <= i) for g, i, _ in rows}


# --- labels ---------------------------------------------------------------------------------


def label_bars(spark):
    days = business_days(DAY, 8)
    rows = [(d, "A", 100.0 + 10 * i) for i, d in enumerate(days)] + [(d, "B", 50.0) for d in days[::2]] + [(days[0], "C", 1.0), (days[1], "C", 0.0)]
    return days, spark.createDataFrame(rows, "date date, ticker string, adj_close double")


def test_forward_returns_end_on_their_own_day(spark):
    days, bars = label_bars(spark)
    out = labels.forward_returns(bars, (1, 3))
    assert out.columns == columns_of(LABELS)
    rows = {(r.ticker, r.date, r.horizon): r for r in out.collect()}
    assert rows["A", days[0], 3].forward_return == pytest.approx(0.3) and rows["A", days[0], 3].label_end == days[3]
    assert rows["B", days[0], 1].label_end == days[2]  # rows of the ticker, not days
    assert ("A", days[5], 3) not in rows and ("A", days[6], 1) in rows and not any(t == "C" for t, *_ in rows)


def test_forward_returns_stop_with_the_listing(spark):
    days, bars = label_bars(spark)
    spans = [("A", None, days[3]), ("A", days[5], None), ("A", days[5], None)]
    held = spark.createDataFrame(spans, "ticker string, list_date date, delisted_date date")
    got = sorted((r.date, r.label_end) for r in labels.forward_returns(bars, (1,), held).collect())
    assert got == [(days[0], days[1]), (days[1], days[2]), (days[5], days[6]), (days[6], days[7])]


def test_factors_refuse_labels(spark, tmp_path):
    _, bars = label_bars(spark)
    out = labels.forward_returns(bars, (1,))
    joined = bars.join(out, ["date", "ticker"])
    hidden = joined.withColumnRenamed("forward_return", "innocent").drop("label_end", "winsorized_return")
    hidden.write.parquet(str(tmp_path / "rows"))
    for panel in (joined, hidden, spark.read.parquet(str(tmp_path / "rows"))):
        with pytest.raises(ContractError, match="labels"):
            Momentum().compute(panel)
    with pytest.raises(ContractError, match="labels"):
        risk.exposures(hidden, ["innocent"])


def test_winsorize_by_two_columns(spark):
    rows = [(d, h, float(v)) for d in (1, 2) for h in (1, 2) for v in range(100 * h)]
    df = spark.createDataFrame(rows, "d int, h int, v double")
    out = winsorize(df, "v", "w", (0.1, 0.9), ["d", "h"]).groupBy("d", "h").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    want = {h: (float(np.quantile(range(100 * h), 0.1)), float(np.quantile(range(100 * h), 0.9))) for h in (1, 2)}
    assert {(r.d, r.h): pytest.approx((r.a, r.b)) for r in out.collect()} == {(d, h): want[h] for d in (1, 2) for h in (1, 2)}


# --- coefficients ---------------------------------------------------------------------------


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_correlation_with_ties_and_one_large_date(spark):
    r = np.random.default_rng(0)
    rows = [(1, float(x), float(x + r.integers(0, 40))) for x in r.integers(0, 30, 1500)] + [(1, 7.0, float(y)) for y in range(600)]
    rows += [(2, 5.0, float(i)) for i in range(9)] + [(3, 1.0, None), (3, None, 1.0)] + [(4, float(i), float(-i)) for i in range(5)]
    df = spark.createDataFrame(rows, "d int, x double, y double").repartition(5)
    got = {r.d: (r.rows, r.ic) for r in evaluation.rank_correlation(df, "x", "y", ["d"]).collect()}
    one = [(x, y) for d, x, y in rows if d == 1]
    assert got[1] == (2100, pytest.approx(np.corrcoef(ranks([x for x, _ in one]), ranks([y for _, y in one]))[0, 1], rel=1e-12))
    assert got[2] == (9, None) and got[4] == (5, pytest.approx(-1.0)) and 3 not in got


def test_summary_allows_for_overlap(spark):
    r = np.random.default_rng(1)
    noise = r.standard_normal(300)
    series = {1: noise + 0.1, 5: np.convolve(noise, np.ones(5) / 5, "same") + 0.1}
    rows = [("f", h, DAY + timedelta(days=i), 10, float(v)) for h, s in series.items() for i, v in enumerate(s)] + [("f", 1, DAY - timedelta(days=1), 4, None)]
    got = {r.horizon: r for r in evaluation.ic_summary(spark.createDataFrame(rows, "factor_name string, horizon int, date date, rows long, ic double")).collect()}
    for h, s in series.items():
        d, n = s - s.mean(), len(s)
        long_run = sum((1 if k == 0 else 2 * (1 - k / (h + 1))) * (d[k:] * d[: n - k]).sum() / n for k in range(h + 1))
        assert got[h].dates == n and got[h].t_hac == pytest.approx(s.mean() / math.sqrt(long_run / n), rel=1e-9)
    assert abs(got[5].t_hac) < abs(series[5].mean() / series[5].std() * math.sqrt(300))
    gate = evaluation.decay_gate(evaluation.ic_summary(spark.createDataFrame([], "factor_name string, horizon int, date date, rows long, ic double")))
    assert gate.count() == 0


# --- tests and gates --------------------------------------------------------------------------


def test_tail_probabilities(spark):
    ts = [0.0, 1e-9, 0.3, -1.0, 1.96, 3.0, 3.53, 3.54, -5.0, 8.0, 20.0, None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in ts], "t double").select(evaluation.two_sided_p(F.col("t")).alias("p")).collect()]
    for t, p in zip(ts, got):
        assert p is None if t is None else p == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), rel=1e-11)


def test_step_up(spark):
    r = random.Random(3)
    rows = [(i, "ab"[i % 2], r.choice([None, 0.01, 0.02, r.random()])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, g string, p double")

    def want(members):
        ps = sorted((p, i) for i, p in members if p is not None)
        out, least = {}, 1.0
        for k in range(len(ps), 0, -1):
            least = min(least, len(ps) * ps[k - 1][0] / k)
            out[ps[k - 1][1]] = least
        return {i: pytest.approx(out[i]) if i in out else None for i, _ in members}

    grouped = {x.i: x.p_adjusted for x in evaluation.step_up(df, "p", ["i"], ["g"]).collect()}
    assert grouped == want([(i, p) for i, g, p in rows if g == "a"]) | want([(i, p) for i, g, p in rows if g == "b"])
    assert {x.i: x.p_adjusted for x in evaluation.step_up(df, "p", ["i"]).collect()} == want([(i, p) for i, _, p in rows])
    assert evaluation.step_up(df.limit(0), "p", ["i"]).count() == 0


def test_gate_keeps_the_last_decision(spark):
    ts = {"steady": [2.0, 4.0, 2.0, 1.0, 2.0, None], "lucky": [3.1, 3.1, 3.1, 3.1, 3.1, 3.1], "dead": [0.1] * 6}
    rows = [(run, name, t) for name, series in ts.items() for run, t in enumerate(series)]
    # Many empty tests in the last runs make the same t a likely false discovery.
    rows += [(run, f"noise{i}", 0.2) for run in (3, 4, 5) for i in range(200)]
    got = {(r.name, r.run): r.state for r in evaluation.gate_states(spark.createDataFrame(rows, "run int, name string, t double"), "run", ["name"]).collect()}
    assert [got["steady", i] for i in range(6)] == ["held", "promoted", "promoted", "retired", "retired", "retired"]
    assert [got["lucky", i] for i in range(6)] == ["promoted"] * 6 and got["dead", 5] == "retired"


# --- folds ------------------------------------------------------------------------------------


def test_no_training_label_touches_guarded_days(spark):
    days = business_days(DAY, 100)
    r = random.Random(9)
    spans = []
    for ticker in "ABCDE":
        for i in range(0, 95):
            if r.random() < 0.7:
                spans.append((days[i], ticker, 21, days[min(99, i + r.randint(1, 45))]))
    labelled = spark.createDataFrame(spans, "date date, ticker string, horizon int, label_end date")
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    folds = evaluation.cv_folds(calendar, 20, 3).orderBy("fold").collect()
    assert [(f.fold, f.first_day, f.last_day, f.guard_from, f.guard_to) for f in folds] == [(k, 20 * k, 20 * k + 19, 20 * k - 3, 20 * k + 22) for k in range(1, 5)]
    number = {d: i for i, d in enumerate(days)}
    placed = evaluation.fold_membership(labelled, calendar, 20, 3)
    got = {(x.date, x.ticker): x for x in placed.collect()}
    assert len(got) == len(spans)
    counts = {f.fold: [0, 0, 0] for f in folds}
    for start, ticker, _, end in spans:
        a, b, row = number[start], number[end], got[start, ticker]
        assert row.test_fold == (a // 20 or None)
        touched = [f.fold for f in folds if f.fold > a // 20 and a <= f.guard_to and b >= f.guard_from]
        assert row.purged_from == (min(touched) if touched else None)
        for f in folds:
            trains = f.fold >= row.train_from
            assert trains == (f.fold > a // 20 and f.fold not in touched)
            counts[f.fold][0] += row.test_fold == f.fold
            counts[f.fold][1] += trains
            counts[f.fold][2] += f.fold in touched
    told = evaluation.fold_counts(placed, evaluation.cv_folds(calendar, 20, 3)).collect()
    assert {r.fold: [r.test_rows, r.train_rows, r.purged_rows] for r in told} == counts


# --- risk model ---------------------------------------------------------------------------------


def test_regression_against_least_squares(spark):
    r = np.random.default_rng(7)
    rows = []
    for d, n in ((1, 60), (2, 40), (3, 5), (4, 30)):
        for i in range(n):
            a, b = (float(x) for x in r.standard_normal(2))
            rows.append((d, f"T{i}", float(r.standard_normal()), a, 2 * a if d == 2 else b, "XYZ"[i % 3] if d != 4 else "X", float(r.random() + 0.1)))
    rows += [(1, "N1", None, 1.0, 1.0, "X", 1.0), (1, "N2", 5.0, 1.0, 1.0, "X", None), (1, "N3", 5.0, 1.0, 1.0, "X", -1.0)]
    df = spark.createDataFrame(rows, "date int, ticker string, y double, a double, b double, g string, w double")
    fits = risk.regress_by_date(df, "y", ["a", "b"], "g", "XYZ", F.col("w"))
    got = {f.date: f for f in fits.collect()}
    # Dropped: the last group; on day 2 the doubled style too; on day 4 all groups.
    kept = {1: [0, 1, 2, 3, 4], 2: [0, 1, 3, 4], 4: [0, 1, 2]}
    left = {(x.date, x.ticker): x.residual for x in risk.residuals(df, fits, "y", ["a", "b"], "g", "XYZ").collect()}
    for d, columns in kept.items():
        mine = [x for x in rows if x[0] == d and x[2] is not None and (x[6] or 0) > 0]
        design = np.array([[1.0, a, b, *(float(g == s) for s in "XYZ")] for _, _, _, a, b, g, _ in mine])[:, columns]
        y, w = np.array([x[2] for x in mine]), np.sqrt([x[6] for x in mine])
        beta = np.linalg.lstsq(design * w[:, None], y * w, rcond=None)[0]
        assert [i for i, c in enumerate(got[d].coefficients) if c is not None] == columns
        assert [c for c in got[d].coefficients if c is not None] == pytest.approx(beta, rel=1e-8, abs=1e-10)
        rest, mean = y - design @ beta, (y * w**2).sum() / (w**2).sum()
        assert got[d].rows == len(mine) and got[d].r2 == pytest.approx(1 - (w * rest) @ (w * rest) / ((w * (y - mean)) @ (w * (y - mean))), rel=1e-9)
        assert [left[d, x[1]] for x in mine] == pytest.approx(rest, abs=1e-9)
    assert set(got[3].coefficients) == {None} and got[3].r2 is None and left[3, "T0"] is None and left[1, "N1"] is None
    names = [x.factor for x in risk.factor_returns(fits, ["a", "b"], "XYZ").where("date = 1").collect()]
    assert names == ["market", "a", "b", "X", "Y", "Z"]


def test_exposures_are_clipped_then_standardized(spark):
    values = [float(i % 7) for i in range(60)] + [500.0]
    rows = [(1, f"T{i}", v, None, 3.3) for i, v in enumerate(values)] + [(1, "N", None, None, 3.3)]
    out = risk.exposures(spark.createDataFrame(rows, "date int, ticker string, x double, e double, c double"), ["x", "e", "c"])
    got = {r.ticker: r for r in out.collect()}
    v = np.array(values)
    v = np.clip(v, v.mean() - 3 * v.std(), v.mean() + 3 * v.std())
    want = (v - v.mean()) / v.std()
    assert [got[f"T{i}"].x for i in range(61)] == pytest.approx(want)
    assert got["N"].x == 0.0 and {(r.e, r.c) for r in got.values()} == {(0.0, 0.0)}


def test_decayed_covariances(spark):
    days = business_days(DAY, 400)
    r = np.random.default_rng(3)
    rows = [(d, f, float(r.standard_normal()) if (i + len(f)) % 9 else None) for i, d in enumerate(days) for f in ("m", "size")]
    got = {(x.date, x.factor_a, x.factor_b): x.covariance for x in risk.factor_covariance(spark.createDataFrame(rows, "date date, factor string, value double"), 10.0).collect()}
    value = {(d, f): v for d, f, v in rows}
    for a, b in (("m", "m"), ("m", "size"), ("size", "size")):
        s = w = 0.0
        for d in days:
            s, w = s * 0.5**0.1, w * 0.5**0.1
            if value[d, a] is None or value[d, b] is None:
                assert (d, a, b) not in got
                continue
            s, w = s + value[d, a] * value[d, b], w + 1
            assert got[d, a, b] == pytest.approx(s / w, rel=1e-10)


# --- sectors and costs ----------------------------------------------------------------------------


def test_longest_prefix_wins(spark):
    ranges = (("10", "39", "Wide"), ("2", "2", "Short"), ("283", "284", "Drugs"), ("28", "28", "Chemicals"), ("20", "29", "Decade"))
    codes = ["2834", " 2851 ", "2100", "21", "2", "1000", "4000", "", None, "28", "2839", "x9"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, sic_code string")
    got = [r.s for r in sectors.sector_proxy(df, out="s", ranges=ranges).orderBy("i").collect()]
    assert got == ["Drugs", "Chemicals", "Decade", "Decade", "Short", "Wide", "Unknown", "Unknown", "Unknown", "Chemicals", "Drugs", "Unknown"]
    assert len(sectors.SECTORS) == 11


def brute_capped(raw, cap, total):
    fixed, weight = set(), {}
    while True:
        rest = [i for i in raw if i not in fixed]
        left = total - sum(cap[i] for i in fixed)
        weight = {i: cap[i] for i in fixed} | {i: left * raw[i] / sum(raw[j] for j in rest) for i in rest}
        above = {i for i in rest if weight[i] > cap[i] + 1e-12}
        if not above:
            return weight
        fixed |= above


def test_capped_weights(spark):
    r = random.Random(1)
    rows = [(d, f"T{i:03d}", r.random() + 0.01, r.random() * scale) for d, n, scale in ((1, 120, 0.05), (2, 7, 5.0), (3, 6, 0.01)) for i in range(n)]
    rows += [(1, "zero", 0.0, 0.5), (1, "minus", -1.0, 0.5), (1, "none", None, 0.5), (4, "off", None, None), (2, "nocap", 1.0, None)]
    out = costs.capped_weights(spark.createDataFrame(rows, "date int, ticker string, raw double, cap double"), "raw", "cap")
    got = {(x.date, x.ticker): x.weight for x in out.collect()}
    assert len(got) == len(rows)
    for d in (1, 2, 3):
        mine = [(t, x, c or 0.0) for e, t, x, c in rows if e == d and (x or 0) > 0]
        want = brute_capped({t: x for t, x, _ in mine}, {t: c for t, _, c in mine}, 1.0)
        assert {t: got[d, t] for t, *_ in mine} == pytest.approx(want, abs=1e-12)
    assert got[1, "zero"] == got[1, "minus"] == got[1, "none"] == got[4, "off"] == got[2, "nocap"] == 0.0


def test_capped_weights_of_large_days_equal_those_of_small_ones(spark):
    r = random.Random(2)
    rows = [(d, f"T{i:03d}", r.random() - 0.2, r.random() * scale) for d, n, scale in ((1, 150, 0.05), (2, 40, 0.01), (3, 30, 5.0)) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, "T", 1.0, 0.5)], "date int, ticker string, raw double, cap double")
    small, mixed = ({(x.date, x.ticker): x.weight for x in costs.capped_weights(df, "raw", "cap", most=most).collect()} for most in (1000, 50))
    assert len(small) == len(rows) + 1 and small == pytest.approx(mixed, abs=1e-12)


def test_cost_queries_shuffle_once_after_the_scores(spark):
    """Weights are shuffled by day, trades by ticker; rows are joined with tables of one row a day only."""
    for name, key in (("capped_weights", "date"), ("trade_costs", "ticker")):
        plan = contract.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and f"Exchange hashpartitioning({key}#" in plan and "SortMergeJoin" not in plan


def test_costs_of_a_known_trade(spark):
    days = business_days(DAY, 2)
    bars = [(d, f"T{i}", 10.0, 1000.0, float(i + 1)) for d in days for i in range(10)]
    weights = [(days[0], "T9", 0.02), (days[1], "T9", -0.01), (days[0], "T0", -0.05), (days[1], "T0", -0.05), (days[0], "gone", 0.1)]
    out = costs.trade_costs(
        spark.createDataFrame(weights, "date date, ticker string, weight double"),
        spark.createDataFrame(bars, "date date, ticker string, raw_close double, volume double, mcap double"), 1e6)
    got = {(r.date, r.ticker): r for r in out.collect()}
    sold = got[days[1], "T9"]
    assert (sold.trade, sold.spread_cost, sold.flat_cost) == pytest.approx((-0.03, 2e-4 * 0.03, 3e-4 * 0.03))
    assert sold.impact_cost == pytest.approx(0.1 * (0.03 * 1e6 / 1e4) ** 1.5) and sold.borrow_cost == pytest.approx(25e-4 * 0.01 / 252)
    small = got[days[1], "T0"]
    assert (small.trade, small.impact_cost, small.spread_cost) == (0.0, 0.0, 0.0) and small.borrow_cost == pytest.approx(500e-4 * 0.05 / 252)
    assert got[days[0], "gone"].impact_cost is None and got[days[0], "gone"].cost is None


# --- one pass for many pairs ------------------------------------------------------------------


def test_rank_correlations_of_many_pairs_equal_those_of_one(spark):
    r = np.random.default_rng(3)
    some = lambda v: None if r.random() < 0.2 else float(v)
    rows = [(d, some(r.integers(-2, 3)), some(r.standard_normal()), some(r.integers(0, 5)), some(r.standard_normal())) for d in (1, 2, 2, 2) for _ in range(150)]
    rows += [(3, -0.0, 1.0, 1.0, 2.0), (3, 0.0, 1.0, 2.0, 1.0), (3, 1.0, 1.0, 3.0, float("nan")), (4, None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "d int, x0 double, x1 double, y0 double, y1 double").repartition(5)
    whole = {(v.d, v.x, v.y): (v.rows, v.ic) for v in evaluation.rank_correlations(df, ["x0", "x1"], ["y0", "y1"], ["d"]).collect()}
    cut = {(v.d, v.x, v.y): (v.rows, v.ic) for v in evaluation.rank_correlations(df, ["x0", "x1"], ["y0", "y1"], ["d"], most=200).collect()}
    alone = {(v.d, x, y): (v.rows, v.ic) for x in ("x0", "x1") for y in ("y0", "y1") for v in evaluation.rank_correlation(df, x, y, ["d"]).collect()}
    assert set(whole) == set(cut) == set(alone) and whole[3, "x0", "y0"][0] == 3
    for k, (n, ic) in alone.items():
        assert whole[k] == cut[k] == (n, None if ic is None else pytest.approx(ic, rel=1e-12, abs=1e-12))


def test_forward_columns_are_the_forward_returns(spark):
    _, bars = label_bars(spark)
    wide, names = labels.forward_columns(bars, (1, 3))
    want = {(v.date, v.ticker, v.horizon): v.forward_return for v in labels.forward_returns(bars, (1, 3)).collect()}
    got = {(v.date, v.ticker, h): v[n] for v in wide.collect() for h, n in names.items() if v[n] is not None}
    assert got == want
    with pytest.raises(ContractError, match="labels"):
        risk.exposures(wide, [names[1]])


def test_rank_step_shuffles_once_for_all_pairs(spark):
    df = spark.range(40).selectExpr("int(id % 4) d", *(f"double(id * {k} % 7) {c}" for k, c in enumerate(("x0", "x1", "y0", "y1", "y2"), 2)))
    plan = evaluation.rank_correlations(df, ["x0", "x1"], ["y0", "y1", "y2"], ["d"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
