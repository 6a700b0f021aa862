from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import d
from strictpast import functions as fx
from strictpast.contracts import FUNDAMENTALS, INDEX_MEMBERSHIP, TICKER_ALIASES, TICKER_METADATA, ContractError, columns_of
from strictpast.plans import bars as bar_plans
from strictpast.plans import fundamentals as fund
from strictpast.plans.jobs import fundamentals_snapshot, land_bars
from strictpast.operators.quality import QualityError
from strictpast.sources import feeds, index_pages, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("0000022222", "22222"), (" 7 ", "7"), ("", None), ("  ", None), (None, None), ("AB1", "AB1"), ("000", "0")],
)
def test_id_normalization(spark, raw, want):
    assert one(spark, fx.normalize_id(text(raw))) == want


def test_id_normalization_of_numbers(spark):
    assert one(spark, fx.normalize_id(F.lit(22222), "bigint")) == "22222"
    assert one(spark, fx.normalize_id(F.lit(22222.0), "double")) == "22222"
    assert one(spark, fx.normalize_id(F.lit(1.5), "double")) == "1.5"
    assert one(spark, fx.normalize_id(F.lit(float("nan")), "double")) is None


@pytest.mark.parametrize(("raw", "want"), [("320193", "0000320193"), ("bad", None), (None, None), ("12345678901", "12345678901")])
def test_padded_id(spark, raw, want):
    assert one(spark, fx.padded_id(text(raw))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2024-01-05", "2024-01-05"), ("2024-01-05T10:00:00Z", "2024-01-05"), ("nope", None), ("", None), (None, None), ("2024-13-01", None)],
)
def test_lenient_date(spark, raw, want):
    assert one(spark, fx.lenient_date(text(raw))) == (want and d(want))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-01-05", "2024-01-05"),
        ("2024-01-05T23:30:00Z", "2024-01-05"),
        ("2024-01-05T23:30:00-05:00", "2024-01-06"),
        ("January 5, 2024", "2024-01-05"),
        ("TBD", None),
        (" ", None),
    ],
)
def test_calendar_day(spark, raw, want):
    assert one(spark, fx.calendar_day(text(raw))) == (want and d(want))


@pytest.mark.parametrize(("raw", "want"), [(" 0001732845", 1732845), ("0", 0), ("000", 0), ("", None), ("x", None)])
def test_stripped_int(spark, raw, want):
    assert one(spark, fx.stripped_int(text(raw))) == want


@pytest.mark.parametrize(
    ("raw", "want"), [(5.0, 5.0), (0.0, None), (-1.0, None), (float("inf"), None), (float("nan"), None), (None, None)]
)
def test_positive_finite(spark, raw, want):
    assert one(spark, fx.positive_finite(F.lit(raw).cast("double"))) == want
    assert one(spark, fx.positive_finite(F.lit("abc"))) is None


def test_code_maps(spark):
    assert [one(spark, fx.exchange_of(text(m))) for m in ("XNYS", "XASE", "XNAS", "XOTC", None)] == [
        "NYSE",
        "AMEX",
        "NASDAQ",
        None,
        None,
    ]
    assert [one(spark, fx.security_type_of(text(m))) for m in ("CS", "ADRC", "ZZ", None)] == ["CS", "ADRC", "OTHER", "OTHER"]
    assert one(spark, fx.undotted(F.lit("BRK.B"))) == "BRKB"


def test_exchanged_headers_in_any_file_raise(spark, tmp_path):
    for first in ("a", "b"):
        folder = tmp_path / first
        folder.mkdir()
        heads = {"a": "canonical_ticker,alias,effective_from,effective_to,note", "b": "alias,canonical_ticker,effective_from,effective_to,note"}
        for name, head in heads.items():
            file = folder / ("1.csv" if name == first else "2.csv")
            file.write_text(f"{head}\nNEW,OLD,2001-01-02,,\n")
        with pytest.raises(Exception, match="(?i)column|header|contract"):
            tables.read_ticker_aliases(spark, str(folder)).collect()


def test_csv_round_trip_and_header_gate(spark, tmp_path):
    good = tmp_path / "membership.csv"
    good.write_text(",".join(columns_of(INDEX_MEMBERSHIP)) + "\nA,A Co,S,SS,2020-01-02,,5\nB,B Co,,,2020-01-02,2021-01-01,\n")
    rows = {r.ticker: r for r in tables.read_membership(spark, str(good)).collect()}
    assert rows["A"].date_removed is None and rows["A"].cik_code == 5
    assert rows["B"].date_removed == d("2021-01-01") and rows["B"].wiki_sector is None
    bad = tmp_path / "bad.csv"
    bad.write_text("name,ticker\nx,y\n")
    with pytest.raises(ContractError, match="date_added"):
        tables.read_membership(spark, str(bad))
    alias = tmp_path / "aliases.csv"
    alias.write_text(",".join(columns_of(TICKER_ALIASES)) + "\nMETA,FB,,2022-06-09,\n")
    row = tables.read_ticker_aliases(spark, str(alias)).first()
    assert row.effective_from is None and row.effective_to == d("2022-06-09") and row.note == ""


def test_parquet_contracts(spark, tmp_path, filings):
    path = str(tmp_path / "f")
    stamped = filings.withColumn("filing_date", F.col("filing_date").cast("timestamp"))
    stamped.write.parquet(path)
    back = tables.read_fundamentals(spark, path)
    assert back.schema["filing_date"].dataType.simpleString() == "date"
    assert back.count() == filings.count()
    swapped = str(tmp_path / "swapped")
    filings.select(*reversed(columns_of(FUNDAMENTALS))).write.parquet(swapped)
    with pytest.raises(ContractError):
        tables.read_fundamentals(spark, swapped)
    meta = str(tmp_path / "m")
    spark.createDataFrame(
        [("A", "n", "XNYS", "CS", "2020-01-02", "garbage", "1", "d", 1)],
        ", ".join(f"{c} {'bigint' if c == 'cik' else 'string'}" for c in columns_of(TICKER_METADATA)),
    ).write.parquet(meta)
    row = tables.read_ticker_metadata(spark, meta).first()
    assert row.list_date == d("2020-01-02") and row.delisted_date is None


def test_symbol_list_and_holdings(spark, tmp_path):
    names = tmp_path / "names.txt"
    names.write_text("# header\n\nAAPL\n MSFT \n")
    assert sorted(r.ticker for r in tables.read_symbol_list(spark, str(names)).collect()) == ["AAPL", "MSFT"]
    held = tmp_path / "held.csv"
    held.write_text(
        'Fund\n"Holdings as of","Jun 15, 2018"\n\n \nTicker,Name,Sector,Asset Class,Weight\n'
        'AAPL,Apple,IT,Equity,4\n MSFT ,Microsoft,IT, Equity ,3\nMSFT-,x,IT,Equity,0\nUSD,Cash,,Cash,1\n,none,,Equity,0\n'
    )
    assert sorted(r.Ticker for r in tables.read_holdings(spark, str(held)).collect()) == ["AAPL", "MSFT"]


def test_bars_from_records(spark, tmp_path):
    lines = tmp_path / "bars.json"
    lines.write_text('{"ticker":"A","timestamp":1704153600000,"close":10.5,"volume":3}\n{"ticker":"A","timestamp":1704239999999,"close":11}\n')
    out = feeds.bars_from_feed(feeds.read_records(spark, str(lines), feeds.BAR_RECORD)).collect()
    assert [r.date for r in out] == [date(2024, 1, 2)] * 2 and out[1].volume is None


STATEMENT = "requested string, tickers array<string>, cik string, filing_date string, period_end string, fiscal_year int, fiscal_quarter int, timeframe string"


def record(requested="GOOG", tickers=("GOOGL", "GOOG"), cik="0001652044", filed="2024-04-25", kind="quarterly"):
    return (requested, list(tickers) if tickers is not None else None, cik, filed, "2024-03-31", 2024, 1, kind)


def test_statement_projection(spark):
    raw = spark.createDataFrame(
        [(*record(), 5.0), (*record(tickers=("GOOGL",)), 5.0), (*record(tickers=()), 5.0), (*record(tickers=None, cik="", kind="weird"), None)],
        f"{STATEMENT}, revenue double",
    )
    rows = feeds.project_statements(raw, feeds.INCOME_FIELDS, feeds.INCOME).collect()
    assert [r.ticker for r in rows] == ["GOOG", "GOOGL", "GOOG", "GOOG"]
    assert rows[0].cik == 1652044 and rows[0].revenues == 5.0 and rows[0].net_income is None
    assert rows[3].cik is None and rows[3].period_kind is None
    assert rows[0].filing_date == d("2024-04-25") and rows[0].endpoint == feeds.INCOME


def snapshot(spark, *ref_dates):
    income = spark.createDataFrame([(*record(), 5.0, 1.0)], f"{STATEMENT}, revenue double, net_income_loss_attributable_common_shareholders double")
    balance = spark.createDataFrame([(*record(filed="2024-05-02"), 9.0)], f"{STATEMENT}, total_assets double")
    cash = spark.createDataFrame([(*record(filed="2024-04-20"), 2.0)], f"{STATEMENT}, net_cash_from_operating_activities double")
    universe = spark.createDataFrame([("GOOG", ref_dates[0]), ("NONE", None)], "ticker string, ref_date date")
    return fundamentals_snapshot(income, balance, cash, universe, d("2020-01-01"))


def test_three_feeds_become_one_row(spark):
    merged, missing = snapshot(spark, None)
    assert merged.columns == columns_of(FUNDAMENTALS)
    row = merged.collect()
    assert len(row) == 1
    assert row[0].filing_date == d("2024-05-02")
    assert (row[0].revenues, row[0].total_assets, row[0].operating_cash_flow) == (5.0, 9.0, 2.0)
    assert row[0].source_endpoints == ["income_statements", "balance_sheets", "cash_flow_statements"]
    assert [r.ticker for r in missing.collect()] == ["NONE"]


def test_filings_of_former_members_are_capped(spark):
    merged, _ = snapshot(spark, d("2024-03-26"))
    row = merged.first()
    # The grace period ends on 2024-04-25, exclusively.
    assert row.source_endpoints == ["cash_flow_statements"] and row.filing_date == d("2024-04-20")
    assert sorted(r.ticker for r in snapshot(spark, d("2020-01-01"))[1].collect()) == ["GOOG", "NONE"]


def test_first_non_null_value_wins(spark):
    cols = "requested string, ticker string, cik bigint, filing_date date, period_end_date date, fiscal_year int, fiscal_quarter int, period_kind string, revenues double, endpoint string"
    base = ("R", "R", None, d("2024-03-31"), 2024, 1, "quarterly")
    def row(filed, value, tag, fy=2024):
        return (base[0], base[1], None, d(filed), base[3], fy, 1, "quarterly", value, tag)
    a = spark.createDataFrame([row("2024-05-01", None, feeds.INCOME), row("2024-06-01", 7.0, feeds.INCOME)], cols)
    b = spark.createDataFrame([row("2024-04-01", 9.0, feeds.BALANCE)], cols)
    out = fund.merge_statements(b, a).first()
    assert out.revenues == 7.0 and out.filing_date == d("2024-06-01")
    assert out.source_endpoints == [feeds.INCOME, feeds.BALANCE]
    assert fund.complete_filings(fund.merge_statements(a.withColumn("period_kind", F.lit(None).cast("string")))).isEmpty()


def test_details(spark):
    raw = spark.createDataFrame(
        [
            ("A", "A Co", "XNYS", "CS", "1990-01-02", "2020-01-05T05:00:00Z", "1", "d", "0001", 1.0),
            ("B", "B Co", "XNYS", None, "", None, "1", None, "x", None),
        ],
        "ticker string, name string, primary_exchange string, type string, list_date string, delisted_utc string,"
        " sic_code string, sic_description string, cik string, weighted_shares_outstanding double",
    )
    removed = spark.createDataFrame([("B", d("2019-01-01"))], "ticker string, ref_date date")
    rows = {r.ticker: r for r in feeds.project_details(raw, removed).collect()}
    assert rows["A"].delisted_date == d("2020-01-05") and rows["A"].cik == 1
    assert rows["B"].delisted_date == d("2019-01-01") and rows["B"].list_date is None and rows["B"].cik is None
    assert feeds.project_details(raw).columns == columns_of(TICKER_METADATA)


def test_pages(spark):
    current = spark.createDataFrame(
        [(" A ", "A Co", "S", "SS", "2020-01-02", "0005"), ("B", "B Co", "S", "SS", "?", "n/a")],
        "Symbol string, Security string, `GICS Sector` string, `GICS Sub-Industry` string, `Date added` string, CIK string",
    )
    rows = index_pages.normalize_current(current).collect()
    assert [(r.ticker, r.cik_code) for r in rows] == [("A", 5)]
    assert index_pages.undated_current(current).first().undated == 1
    changes = spark.createDataFrame(
        [("January 5, 2020", " X ", "X Co", None, None), ("soon", "Y", None, None, None)],
        "`Effective Date_Effective Date` string, Added_Ticker string, Added_Security string, Removed_Ticker string, Removed_Security string",
    )
    out = index_pages.normalize_changes(changes).collect()
    assert [(r.date, r.added_ticker, r.removed_ticker) for r in out] == [(d("2020-01-05"), "X", None)]


def feed(spark, *rows):
    return spark.createDataFrame(
        [(t, d(day), c, 100.0) for t, day, c in rows], "ticker string, date date, close double, volume double"
    )


def test_daily_bars_partial_failure(spark):
    adj = feed(spark, ("GOOD", "2024-01-02", 9.0), ("GOOD", "2024-01-03", 9.5), ("BAD", "2024-01-02", 1.0), ("GOOD", "2025-01-02", 1.0))
    raw = feed(spark, ("GOOD", "2024-01-02", 10.0), ("GOOD", "2025-01-02", 10.0), ("BAD", "2024-01-02", 1.0))
    details = spark.createDataFrame(
        [("GOOD", "XNYS", "CS", None), ("SILENT", "XOTC", "ZZ", 5.0)],
        "ticker string, primary_exchange string, type string, weighted_shares_outstanding double",
    )
    want = spark.createDataFrame([("GOOD",), ("BAD",), ("SILENT",)], "ticker string")
    span = (d("2024-01-01"), d("2024-12-31"))
    bars, skipped = bar_plans.daily_bars(adj, raw, details, want, *span)
    row = bars.collect()
    assert len(row) == 1 and (row[0].raw_close, row[0].adj_close, row[0].mcap, row[0].exchange) == (10.0, 9.0, 0.0, "NYSE")
    reasons = {r.ticker: r.reason for r in skipped.collect()}
    assert reasons == {"BAD": "meta: not found", "SILENT": "aggs: no rows returned"}
    with pytest.raises(QualityError, match="BAD"):
        land_bars(adj, raw, details, want, *span, strict=True)
    with pytest.raises(ValueError):
        bar_plans.daily_bars(adj, raw, details, want, span[1], span[0])


def test_dated_share_counts(spark):
    bars = feed(spark, ("A", "2024-01-02", 9.0), ("A", "2024-01-03", 9.0)).withColumnRenamed("close", "raw_close").withColumn("adj_close", F.lit(9.0))
    details = spark.createDataFrame(
        [("A", d("2024-01-02"), "XNYS", "CS", 2.0), ("A", d("2024-01-03"), "XNYS", "CS", 3.0)],
        "ticker string, date date, primary_exchange string, type string, weighted_shares_outstanding double",
    )
    out = bar_plans.stamp_details(bars, details).orderBy("date").collect()
    assert [r.mcap for r in out] == [18.0, 27.0]
