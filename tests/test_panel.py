from datetime import date

import math
import pytest
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, ELIGIBILITY, bar_rows, business_days
from strictpast.contracts import ContractError, PANEL, columns_of
from strictpast.plans import panel as panels
from strictpast.plans.panel import UniverseRules, build_panel, universe_flags


@pytest.fixture(scope="module")
def flags(eligibility_bars):
    return universe_flags(eligibility_bars).cache()


def of(flags, ticker):
    return flags.where(F.col("ticker") == ticker).orderBy("date").collect()


def test_every_flag_follows_its_rule(flags):
    """Reasons of all rows from the rules' definitions."""
    for ticker, (exchange, kind, close, n) in ELIGIBILITY.items():
        rows = of(flags, ticker)
        assert len(rows) == n
        for i, r in enumerate(rows):
            broken = [
                ("share_class_not_common", kind != "CS"),
                ("exchange_not_allowed", exchange == "OTC"),
                ("insufficient_history", i < 252),
                ("price_below_floor", i == 0 or close(i - 1) < 5.0),
            ]
            reason = next((name for name, holds in broken if holds), None)
            assert (r.fail_reason, r.eligible_flag) == (reason, reason is None), (ticker, i)
            assert [r.common_share_ok, r.exchange_ok, r.history_ok, r.price_ok] == [not holds for _, holds in broken]


def test_missing_input_columns_raise(eligibility_bars):
    with pytest.raises(ContractError, match="exchange"):
        universe_flags(eligibility_bars.drop("exchange"))
    with pytest.raises(ContractError, match="mcap"):
        build_panel(eligibility_bars.drop("mcap"))


def test_null_exchange_and_type_fail(spark):
    rows = bar_rows("A", None, "CS", [10.0] * 3, business_days(date(2024, 1, 1), 3))
    rows += bar_rows("B", "NYSE", None, [10.0] * 3, business_days(date(2024, 1, 1), 3))
    out = universe_flags(spark.createDataFrame(rows, BAR_SCHEMA), UniverseRules(min_history_days=0))
    reasons = {(r.ticker, r.fail_reason) for r in out.collect()}
    assert reasons == {("A", "exchange_not_allowed"), ("B", "share_class_not_common")}


def test_panel_shape_and_returns(spark):
    days = business_days(date(2024, 1, 1), 3)
    bars = spark.createDataFrame(bar_rows("A", "NYSE", "CS", [10.0, 11.0, 9.9], days), BAR_SCHEMA)
    out = build_panel(bars)
    assert out.columns == columns_of(PANEL) and len(out.columns) == 15
    rows = out.orderBy("date").collect()
    assert rows[0].ret_1d is None
    assert rows[1].ret_1d == pytest.approx(math.log(1.1))
    assert rows[0].gics_sector is None
    assert len(rows[0].data_snapshot_id) == 64
    assert len({r.data_snapshot_id for r in rows}) == 1


def test_truncation_does_not_change_the_past(eligibility_bars):
    cut = business_days(date(2020, 1, 2), 400)[300]
    kept = [c for c in columns_of(PANEL) if c != "data_snapshot_id"]
    whole = build_panel(eligibility_bars).where(F.col("date") <= F.lit(cut)).select(*kept)
    early = build_panel(eligibility_bars.where(F.col("date") <= F.lit(cut))).select(*kept)
    assert whole.exceptAll(early).isEmpty() and early.exceptAll(whole).isEmpty()


def test_one_shuffle_for_all_ticker_windows(eligibility_bars):
    df = panels.with_returns(panels.with_universe_flags(eligibility_bars, UniverseRules()))
    planned = df._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange hashpartitioning") == 1 and planned.count("Sort [") == 1


def test_eligible_counts_and_summary(eligibility_bars):
    panel = build_panel(eligibility_bars).cache()
    last = panels.eligible_per_day(panel).orderBy(F.col("date").desc()).first()
    # On the last row ASPEN and BIRCH pass; the close before it is a low one of GORSE.
    assert last.eligible == 2
    s = panels.panel_summary(panel).first()
    assert (s["rows"], s.tickers) == (7 * 300 + 120, 8)
