from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strictpast.contracts import ContractError
from strictpast.operators import cross_section as cs

DAY, NEXT = date(2024, 1, 2), date(2024, 1, 3)
SCHEMA = "date date, ticker string, value double"


def frame(spark, values, day=DAY):
    return spark.createDataFrame([(day, f"t{i}", v) for i, v in enumerate(values)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("date", F.length("ticker"), "ticker").collect()]


def test_winsorize_clips_both_ends(spark):
    out = cs.winsorize(frame(spark, [float(i) for i in range(11)]), "value", "w", (0.1, 0.9))
    assert column(out, "w") == [1.0, *map(float, range(1, 10)), 9.0]


def test_missing_values_stay_missing(spark):
    df = frame(spark, [1.0, None, 3.0, 100.0])
    out = cs.zscore(cs.winsorize(df, "value", "w", (0.1, 0.9)), "w", "z")
    assert [v is None for v in column(out, "w")] == [False, True, False, False]
    assert [v is None for v in column(out, "z")] == [False, True, False, False]


def test_days_do_not_mix(spark):
    df = frame(spark, [1.0, 2.0, 3.0]).unionByName(frame(spark, [100.0, 200.0, 300.0], NEXT))
    z = column(cs.zscore(df, "value", "z"), "z")
    assert z[:3] == pytest.approx(z[3:])


def test_no_spread_gives_null(spark):
    assert column(cs.zscore(frame(spark, [7.0, 7.0, 7.0]), "value", "z"), "z") == [None] * 3
    assert column(cs.zscore(frame(spark, [7.0]), "value", "z"), "z") == [None]
    assert column(cs.zscore(frame(spark, [None, None]), "value", "z"), "z") == [None, None]


def test_sample_deviation(spark):
    z = column(cs.zscore(frame(spark, [1.0, 2.0, 3.0]), "value", "z", ddof=1), "z")
    assert z == pytest.approx([-1.0, 0.0, 1.0])


def test_empty_input_gives_empty_output(spark):
    assert cs.zscore(cs.winsorize(frame(spark, []), "value", "w"), "w", "z").count() == 0


@pytest.mark.parametrize("pct", [(0.5, 0.5), (-0.1, 0.9), (0.1, 1.1), (0.9, 0.1)])
def test_bad_bounds_raise(spark, pct):
    with pytest.raises(ValueError):
        cs.winsorize(frame(spark, [1.0]), "value", "w", pct)


def test_unknown_column_raises(spark):
    with pytest.raises(ContractError):
        cs.winsorize(frame(spark, [1.0]), "nope", "w")
    with pytest.raises(ContractError):
        cs.zscore(frame(spark, [1.0]), "nope", "z")


def bounds_of(spark, groups, pct, **kw):
    rows = [(g, f"t{i}", float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = cs.group_bounds(df, "value", "date", pct, **kw).collect()
    return {r["date"]: (r["lo"], r["hi"]) for r in found}


def test_large_groups_match_brute_force(spark):
    """One hot day, ties, a constant day and a small day, all through the one path."""
    rng = np.random.default_rng(7)
    groups = {
        date(2024, 1, 1): rng.normal(size=4000),
        date(2024, 1, 2): rng.integers(0, 5, size=700).astype(float),
        date(2024, 1, 3): np.full(300, 3.5),
        date(2024, 1, 4): rng.normal(size=9),
    }
    for pct in ((0.01, 0.99), (0.0, 1.0), (0.45, 0.55), (0.5, 0.500001)):
        got = bounds_of(spark, groups, pct, accuracy=200)
        for day, values in groups.items():
            assert got[day] == pytest.approx(tuple(np.quantile(values, pct)), abs=1e-12)


def test_wrong_brackets_are_widened(spark):
    """A far too coarse sketch must not change the answer."""
    values = np.random.default_rng(3).exponential(size=3000) ** 3
    got = bounds_of(spark, {DAY: values}, (0.05, 0.95), accuracy=2)
    assert got[DAY] == pytest.approx(tuple(np.quantile(values, (0.05, 0.95))))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60), low=st.integers(0, 49))
def test_bounds_do_not_depend_on_the_sketch(spark, values, low):
    """Bit for bit, however coarse the sketch is."""
    pct = (low / 100, 1 - low / 100)
    brute = tuple(np.quantile(np.array(values, dtype=float), pct))
    fine = bounds_of(spark, {DAY: values}, pct)
    assert fine[DAY] == pytest.approx(brute)
    assert bounds_of(spark, {DAY: values}, pct, accuracy=3) == fine


def test_no_window_over_the_day(spark):
    """The whole day is never gathered into one task."""
    out = cs.zscore(cs.winsorize(frame(spark, [1.0, 2.0, 5.0]), "value", "w"), "w", "z")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
