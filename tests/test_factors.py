import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import business_days, d
from strictpast.contracts import ContractError, FACTOR, columns_of
from strictpast.operators import quality
from strictpast.plans import reports
from strictpast.plans.factors import REGISTRY, EarningsYield, Factor, FactorContext, Momentum
from strictpast.plans.factors.base import diagnostics_dict

PRICE = "date date, ticker string, adj_close double"


def prices(spark, **series):
    days = business_days(date(2020, 1, 1), max(map(len, series.values())))
    return spark.createDataFrame(
        [(day, t, float(v)) for t, vs in series.items() for day, v in zip(days, vs)], PRICE
    )


def ramp(n=300, start=100.0, step=0.5):
    return [start + step * i for i in range(n)]


def rows_of(factor, ticker):
    return factor.where(F.col("ticker") == ticker).orderBy("date").collect()


def test_momentum_values_and_warmup(spark):
    out = Momentum().compute(prices(spark, A=ramp(), B=[100.0] * 300, C=ramp(step=0.2)))
    assert out.columns == columns_of(FACTOR)
    a = rows_of(out, "A")
    assert all(r.raw_value is None for r in a[:252])
    p = ramp()
    assert a[252].raw_value == pytest.approx(math.log(p[231] / p[0]))
    assert a[251].invalid_reason == "history_ineligible" and not a[251].valid_flag
    assert a[252].valid_flag and a[252].invalid_reason is None and a[252].tradable_flag
    assert quality.check(out, quality.factor_rules()).agg(F.sum("broken_rows")).first()[0] == 0


def test_momentum_skips_the_last_month(spark):
    """Whatever the last 21 days do, the last value reads the close before them."""
    calm = ramp(275, step=0.25)
    series = {"CALM": calm, "FALL": calm[:-21] + [c / 3 for c in calm[-21:]], "SOAR": calm[:-21] + [c * 5 for c in calm[-21:]]}
    out = Momentum().compute(prices(spark, **series))
    last = {t: rows_of(out, t)[-1].raw_value for t in series}
    assert last["FALL"] == last["CALM"] == last["SOAR"] == pytest.approx(math.log(calm[-22] / calm[-253]))


def test_single_name_days_have_no_score(spark):
    last = rows_of(Momentum().compute(prices(spark, A=ramp())), "A")[-1]
    assert last.raw_value is not None and last.zscore_value is None
    assert last.invalid_reason == "history_ineligible"


def test_momentum_outlier_is_clipped(spark):
    series = {f"T{i:02d}": ramp(260, step=0.1 + i / 1000) for i in range(20)}
    series["OUT"] = [1.0] + [1000.0] * 259
    last = Momentum().compute(prices(spark, **series))
    final = last.agg(F.max("date")).first()[0]
    row = last.where((F.col("date") == final) | F.lit(False)).where("ticker = 'OUT'").first()
    first_valid = rows_of(last, "OUT")[252]
    assert first_valid.winsorized_value < first_valid.raw_value
    assert row is not None


def test_momentum_truncation_and_fingerprint(spark):
    panel = prices(spark, A=ramp(), B=ramp(step=0.3), C=ramp(step=0.7))
    cut = business_days(date(2020, 1, 1), 300)[280]
    values = ["date", "ticker", "raw_value", "winsorized_value", "zscore_value", "valid_flag"]
    whole = Momentum().compute(panel)
    before = whole.where(F.col("date") <= F.lit(cut)).select(*values)
    alone = Momentum().compute(panel.where(F.col("date") <= F.lit(cut))).select(*values)
    assert before.exceptAll(alone).isEmpty() and alone.exceptAll(before).isEmpty()

    def stamp(df):
        return Momentum().compute(df).select("feature_snapshot_id").distinct().collect()

    again = stamp(panel.orderBy(F.rand(1)))
    changed = stamp(panel.withColumn("adj_close", F.col("adj_close") * F.when(F.col("ticker") == "A", 1.1).otherwise(1.0)))
    assert stamp(panel) == again and again != changed and len(again) == 1


def test_eligibility_only_enters_tradable(spark):
    panel = prices(spark, A=ramp(), B=ramp(step=0.3)).withColumn(
        "eligible_flag", F.when(F.col("ticker") == "A", False)
    )
    out = Momentum().compute(panel)
    last = rows_of(out, "A")[-1]
    assert last.valid_flag and last.tradable_flag is False and last.invalid_reason is None
    assert rows_of(out, "B")[-1].tradable_flag is False


def test_missing_columns_and_declarations_raise(spark):
    with pytest.raises(ContractError, match="adj_close"):
        Momentum().compute(prices(spark, A=[1.0]).drop("adj_close"))
    with pytest.raises(TypeError, match="formula"):

        class Broken(Factor):
            name = "broken"
            lookback_days = 1

            def raw(self, panel, context):
                return panel

    assert set(REGISTRY) == {"mom_12_1", "earnings_yield"}


VALUE = "date date, ticker string, mcap double, adj_close double, shares_out double, eligible_flag boolean"


def value_rows(*rows):
    return [(d(day), t, m, 10.0, 1e6, ok) for day, t, m, ok in rows]


TODAY, LATER = "2021-11-15", "2021-11-22"
VALUE_PANEL = value_rows(
    *((TODAY, t, m, True) for t, m in (("LARK", 600.0), ("WREN", 1160.0), ("FINCH", 920.0))),
    *((LATER, t, 60.0, True) for t in ("NOBODY", "SWIFT", "CRANE", "DOVE")),
)


@pytest.fixture(scope="module")
def value_panel(spark):
    return spark.createDataFrame(VALUE_PANEL, VALUE)


def test_earnings_yield_values_and_reasons(spark, value_panel, filings):
    out = EarningsYield().compute(value_panel, FactorContext(filings))
    got = {r.ticker: r for r in out.collect()}
    # 48 / 600, 29 / 1160 (restated) and 92 / 920.
    raw = {t: got[t].raw_value for t in ("LARK", "WREN", "FINCH")}
    assert raw == {"LARK": pytest.approx(0.08), "WREN": pytest.approx(0.025), "FINCH": pytest.approx(0.1)}
    assert all(got[t].valid_flag for t in raw)
    assert got["NOBODY"].invalid_reason == "missing_fundamentals"
    assert got["SWIFT"].invalid_reason == "insufficient_quarters"
    assert got["DOVE"].invalid_reason == "missing_fundamentals"
    # The only usable name of its day has no spread to be scored against.
    assert got["CRANE"].raw_value == pytest.approx(0.25)
    assert got["CRANE"].invalid_reason == "raw_factor_nan"


def test_bad_denominators_and_lag_diagnostics(spark, filings):
    rows = value_rows(
        (TODAY, "LARK", 0.0, True),
        (TODAY, "WREN", None, True),
        (TODAY, "FINCH", float("nan"), True),
        (TODAY, "NOBODY", 1.0, True),
    )
    ctx = FactorContext(filings)
    out = EarningsYield().compute(spark.createDataFrame(rows, VALUE), ctx)
    reasons = {r.ticker: r.invalid_reason for r in out.collect()}
    assert {reasons[t] for t in ("LARK", "WREN", "FINCH")} == {"invalid_denominator"}
    notes = diagnostics_dict(EarningsYield().diagnostics(out, ctx))
    assert notes["invalid_reason_counts"] == {"invalid_denominator": 3, "missing_fundamentals": 1}
    assert notes["latest_filing_lag_days"]["n"] == 3
    assert notes["oldest_ttm_component_lag_days"]["max"] == (d(TODAY) - d("2020-11-02")).days


def test_diagnostics_without_filings(spark, value_panel, filings):
    out = EarningsYield().compute(value_panel, FactorContext(filings))
    notes = diagnostics_dict(EarningsYield().diagnostics(out))
    assert set(notes) == {"invalid_reason_counts"}
    nobody = value_panel.where("ticker = 'NOBODY'")
    only_missing = EarningsYield().compute(nobody, FactorContext(filings))
    assert set(diagnostics_dict(EarningsYield().diagnostics(only_missing, FactorContext(filings)))) == {
        "invalid_reason_counts"
    }


def test_context_is_required(value_panel):
    with pytest.raises(ValueError, match="fundamentals"):
        EarningsYield().compute(value_panel)


def test_ineligible_but_computable(spark, filings):
    rows = value_rows((TODAY, "LARK", 600.0, False), (TODAY, "WREN", 1160.0, True))
    out = EarningsYield().compute(spark.createDataFrame(rows, VALUE), FactorContext(filings))
    row = rows_of(out, "LARK")[0]
    assert row.valid_flag and row.tradable_flag is False and row.invalid_reason is None


def test_earnings_yield_truncation(spark, value_panel, filings):
    """Reports filed on or after the day do not change it."""
    cut = filings.where(F.col("filing_date") < F.lit(d(TODAY)))
    day = value_panel.where(F.col("date") == F.lit(d(TODAY)))
    cols = ["ticker", "raw_value", "zscore_value", "invalid_reason"]
    a = EarningsYield().compute(day, FactorContext(filings)).select(*cols)
    b = EarningsYield().compute(day, FactorContext(cut)).select(*cols)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_reports(spark):
    out = Momentum().compute(prices(spark, A=ramp(), B=ramp(step=0.3), C=ramp(step=0.9))).cache()
    c = reports.slice_counters(out).first()
    assert (c.panel_rows, c.valid_rows) == (900, 3 * 48)
    sanity = reports.zscore_sanity(out).first()
    assert sanity.max_abs_mean < 1e-9 and sanity.mean_std == pytest.approx(math.sqrt(1.5))
    ranked = [r.ticker for r in reports.last_day_cross_section(out).collect()]
    assert ranked == ["C", "A", "B"]
    assert reports.ticker_series(out, "A").count() == 48
