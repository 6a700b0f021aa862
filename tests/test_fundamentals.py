import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import d, filing, filings_frame
from strictpast.plans import fundamentals as fund

FIELDS = ("net_income", "revenues")


def ask(spark, filings, *requests):
    asked = spark.createDataFrame([(t, d(day)) for t, day in requests], "ticker string, date date")
    out = fund.as_of_states(asked, fund.filing_states(filings, FIELDS), FIELDS)
    return {(r.ticker, str(r.date)): r for r in out.collect()}


def ask_id(spark, filings, ticker, entity, day):
    asked = spark.createDataFrame([(ticker, entity, d(day))], "ticker string, entity_id string, date date")
    return fund.as_of_states(asked, fund.filing_states(filings, FIELDS, by_id=True), FIELDS).first()


TODAY = "2021-11-15"


def test_engineered_histories(spark, filings):
    lark = ["2020-08-02", "2020-08-03", "2021-06-01", TODAY]
    others = ["WREN", "FINCH", "SWIFT", "CRANE", "HERON", "DOVE", "NOBODY"]
    got = ask(spark, filings, *(("LARK", day) for day in lark), ("WREN", "2021-06-10"), *((t, TODAY) for t in others))
    # A report is not visible on its own filing day.
    assert got["LARK", lark[0]].latest is None and got["LARK", lark[0]].net_income_status == fund.MISSING
    assert (got["LARK", lark[1]].latest.fiscal_year, got["LARK", lark[1]].latest.fiscal_quarter) == (2020, 2)
    assert got["LARK", lark[1]].latest_lag_days == 1 and got["LARK", lark[1]].net_income_status == fund.INSUFFICIENT
    # Sums of the newest four quarters; yearly and trailing rows never enter them.
    assert (got["LARK", lark[2]].net_income_ttm, got["LARK", TODAY].net_income_ttm) == (3 + 5 + 7 + 11.0, 7 + 11 + 13 + 17.0)
    assert got["LARK", TODAY].revenues_ttm == 9 * 48.0 and got["LARK", TODAY].revenues_status is None
    assert got["LARK", TODAY].oldest_lag_days == (d(TODAY) - d("2021-02-02")).days
    # Restated: seen from the day after the restatement only.
    assert got["WREN", "2021-06-10"].net_income_status == fund.INSUFFICIENT
    assert got["WREN", TODAY].net_income_ttm == 4 + 6 + 9 + 10.0
    assert got["FINCH", TODAY].net_income_ttm == 92.0
    for ticker, status in (("SWIFT", fund.INSUFFICIENT), ("HERON", fund.INSUFFICIENT), ("NOBODY", fund.MISSING), ("DOVE", fund.AMBIGUOUS)):
        assert got[ticker, TODAY].net_income_status == status and got[ticker, TODAY].net_income_ttm is None
    crane = got["CRANE", TODAY]
    assert (crane.revenues_status, crane.revenues_ttm) == (fund.MISSING_FIELD, None)
    assert (crane.net_income_status, crane.net_income_ttm) == (None, 15.0)
    dove = got["DOVE", TODAY]
    assert dove.latest is None and dove.latest_lag_days is None and dove.oldest_lag_days is None


def test_naming_the_entity_settles_ambiguity(spark, filings):
    from strictpast.functions import normalize_id

    second = ask_id(spark, filings, "DOVE", "7002", TODAY)
    assert second.net_income_ttm == 126.0 and second.net_income_status is None
    assert spark.range(1).select(normalize_id(F.lit("0000007002")).alias("i")).first().i == "7002"
    first = ask_id(spark, filings, "DOVE", "7001", TODAY)
    assert first.latest.net_income == 4.0 and first.latest.filing_date == d("2021-11-02")
    assert ask_id(spark, filings, "DOVE", "7003", TODAY).net_income_status == fund.MISSING


def scalar(rows, ticker, day):
    """Brute force for one request: everything visible, in plain Python."""
    seen = [r for r in rows if r[0] == ticker and r[2] is not None and r[2] < day]
    if len({r[1] for r in seen if r[1] is not None}) > 1:
        return fund.AMBIGUOUS, None, None, None
    lag = (day - max(r[2] for r in seen)).days if seen else None
    quarterly = [r for r in seen if r[6] == "quarterly"]
    if not quarterly:
        return fund.MISSING, None, lag, None
    newest = {}
    for r in quarterly:
        if r[4] is not None and r[5] in (1, 2, 3, 4):
            o = r[4] * 4 + r[5]
            if o not in newest or r[2] > newest[o][2]:
                newest[o] = r
    top = sorted(newest)[-4:]
    if len(top) < 4 or top[-1] - top[0] != 3:
        return fund.INSUFFICIENT, None, lag, None
    old = (day - min(newest[o][2] for o in top)).days
    values = [newest[o][8] for o in top]
    if any(v is None for v in values):
        return fund.MISSING_FIELD, None, lag, old
    return None, sum(values), lag, old


def test_random_histories_match_brute_force(spark):
    """Gaps, restatements, odd quarters, null and reused ids; the first entity has most rows."""
    rng = random.Random(11)
    start = date(2020, 1, 1)
    rows = []
    for e in range(25):
        days = rng.sample(range(1500), 300 if e == 0 else rng.randint(0, 60))
        cik = None if rng.random() < 0.2 else 100 + e
        for day in days:
            year, quarter = 2019 + day // 400 + rng.randint(0, 1), rng.choice([1, 2, 3, 4, 4, 3, 2, 1, 9, None])
            kind = rng.choice(["quarterly"] * 6 + ["annual"])
            mine = 999 if e > 20 and rng.random() < 0.1 else cik
            net = None if rng.random() < 0.15 else float(rng.randint(1, 99))
            filed = start + timedelta(days=day)
            rows.append(filing(f"E{e}", mine, str(filed), str(filed), year, quarter, 1.0, net, kind))
    requests = [(f"E{e}", start + timedelta(days=rng.randint(-5, 1600))) for e in range(26) for _ in range(40)]
    asked = spark.createDataFrame(requests, "ticker string, date date").distinct()
    out = fund.as_of_states(asked, fund.filing_states(filings_frame(spark, rows)), unique_requests=True)
    seen = set()
    for r in out.collect():
        want = scalar(rows, r.ticker, r.date)
        seen.add(want[0])
        assert (r.net_income_status, r.net_income_ttm, r.latest_lag_days, r.oldest_lag_days) == want, r
    assert seen >= {None, fund.AMBIGUOUS, fund.MISSING, fund.INSUFFICIENT, fund.MISSING_FIELD}


def test_repeated_requests_keep_their_rows(spark, filings):
    asked = spark.createDataFrame(
        [("LARK", d(TODAY), i) for i in range(3)], "ticker string, date date, tag int"
    )
    out = fund.as_of_states(asked, fund.filing_states(filings))
    assert sorted(r.tag for r in out.collect()) == [0, 1, 2]
    assert {r.net_income_ttm for r in out.collect()} == {48.0}


def test_later_filings_do_not_change_the_past(spark, filings):
    days = [("LARK", "2021-05-03"), ("WREN", "2021-05-03"), ("DOVE", "2021-02-01")]
    cut = filings.where(F.col("filing_date") < F.lit(d("2021-05-03")))
    assert ask(spark, filings, *days) == ask(spark, cut, *days)


def test_coverage(spark, filings):
    out = fund.coverage_grid(filings, d("2021-01-01"), d("2021-01-03"))
    assert out.count() == 3 * filings.select("ticker").distinct().count()
    wide = fund.coverage_grid(filings, d("2020-08-02"), d("2020-08-05"))
    flags = {(r.ticker, str(r.date)): r.has_pit_fundamentals for r in wide.collect()}
    assert not flags[("LARK", "2020-08-02")] and flags[("LARK", "2020-08-03")]
    late = fund.coverage_grid(filings, d("2021-02-02"), d("2021-02-04")).where("ticker = 'DOVE'")
    assert not any(r.has_pit_fundamentals for r in late.collect())  # both owners file on one day
    with pytest.raises(ValueError):
        fund.coverage_grid(filings, d("2024-01-03"), d("2024-01-01"))


def test_no_pairs_within_an_entity(spark, filings):
    asked = filings.select("ticker", F.col("filing_date").alias("date")).distinct()
    out = fund.as_of_states(asked, fund.filing_states(filings), unique_requests=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
