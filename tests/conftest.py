"""Shared session, frame builders, and the engineered fixtures."""

from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strictpast.contracts import FUNDAMENTALS, STATEMENT_VALUES  # noqa: E402
from strictpast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = str(tmp_path_factory.mktemp("checkpoints"))
    session = build_session("tests", 8, spark__checkpoint__dir=scratch)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    # Tiny inputs: compiling each stage would take longer than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session


def d(text: str) -> date:
    return date.fromisoformat(text)


def business_days(start: date, count: int) -> list[date]:
    out, day = [], start
    while len(out) < count:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


BAR_SCHEMA = (
    "date date, ticker string, exchange string, ticker_type string, is_common_share boolean,"
    " raw_close double, adj_close double, volume double, shares_out double, mcap double"
)


def bar_rows(ticker, exchange, kind, closes, days):
    return [
        (day, ticker, exchange, kind, kind == "CS", c, c, 1e6, 1e6, c * 1e6)
        for day, c in zip(days, closes)
    ]


#: What sets each ticker of the eligibility table apart: exchange, type, closes by row, days.
ELIGIBILITY = {
    "ASPEN": ("NYSE", "CS", lambda i: 31.0 + i % 7, 300),
    "BIRCH": ("NASDAQ", "CS", lambda i: 5.0, 300),  # exactly the floor
    "CEDAR": ("NYSE", "ETF", lambda i: 40.0, 300),
    "DATURA": ("OTC", "CS", lambda i: 40.0, 300),
    "ELDER": ("NASDAQ", "CS", lambda i: 40.0, 120),
    "FIG": ("NYSE", "CS", lambda i: 3.25, 300),
    "GORSE": ("NYSE", "CS", lambda i: 9.0 if i % 3 == 0 else 2.0, 300),  # one day in three above
    "HAZEL": ("OTC", "ADRC", lambda i: 1.0, 300),  # breaks every rule
}


@pytest.fixture(scope="session")
def eligibility_bars(spark):
    days = business_days(date(2017, 3, 1), 300)
    rows = []
    for ticker, (exchange, kind, close, n) in ELIGIBILITY.items():
        rows += bar_rows(ticker, exchange, kind, [close(i) for i in range(n)], days[:n])
    return spark.createDataFrame(rows, BAR_SCHEMA)


def filing(ticker, cik, filed, ended, year, quarter, revenues, net_income, kind="quarterly"):
    values = {"revenues": revenues, "net_income": net_income}
    return (
        ticker,
        cik,
        d(filed),
        d(ended),
        year,
        quarter,
        kind,
        *(values.get(c) for c in STATEMENT_VALUES),
        ["income_statements"],
    )


def filings_frame(spark, rows):
    return spark.createDataFrame(rows, FUNDAMENTALS)


QUARTER_ENDS = [f"{y}-{e}" for y in (2019, 2020, 2021) for e in ("03-31", "06-30", "09-30", "12-31")]


def quarters(ticker, cik, first, income, fiscal, revenues=None):
    """Quarterly reports from quarter number ``first`` of QUARTER_ENDS on, filed 33 days after
    their end; ``fiscal`` is the ordinal (4 * year + quarter - 1) of the first; None skips one."""
    rows = []
    for i, net in enumerate(income):
        if net is None:
            continue
        ended = QUARTER_ENDS[first + i]
        filed = str(d(ended) + timedelta(days=33))
        year, quarter = divmod(fiscal + i, 4)
        rows.append(filing(ticker, cik, filed, ended, year, quarter + 1, revenues[i] if revenues else 9.0 * net, net))
    return rows


@pytest.fixture(scope="session")
def filing_rows():
    """LARK files plainly, WREN restates, FINCH has a shifted year, SWIFT is young, CRANE omits a
    value, HERON skips a quarter, and two companies used the symbol DOVE."""
    rows = quarters("LARK", 41, 5, [3.0, 5.0, 7.0, 11.0, 13.0, 17.0], 4 * 2020 + 1)
    rows.append(filing("LARK", 41, "2021-02-20", "2020-12-31", 2020, None, 999.0, 888.0, "annual"))
    rows.append(filing("LARK", 41, "2021-02-21", "2020-12-31", 2020, None, 999.0, 777.0, "trailing_twelve_months"))
    rows += quarters("WREN", 42, 6, [4.0, 6.0, 8.0, 10.0], 4 * 2020 + 2)
    rows.append(filing("WREN", 42, "2021-06-10", "2021-03-31", 2021, 1, 81.0, 9.0))
    rows += quarters("FINCH", 43, 7, [20.0, 22.0, 24.0, 26.0], 4 * 2021 + 1)
    rows += quarters("SWIFT", 44, 8, [1.0, 1.5, 2.0], 4 * 2021)
    rows += quarters("CRANE", 45, 7, [2.0, 3.0, 4.0, 6.0], 4 * 2020 + 3, [18.0, None, 36.0, 54.0])
    rows += quarters("HERON", 46, 6, [5.0, 5.0, None, 5.0, 5.0], 4 * 2020 + 2)
    rows += quarters("DOVE", 7001, 7, [1.0, 2.0, 3.0, 4.0], 4 * 2020 + 3)
    rows += quarters("DOVE", 7002, 7, [30.0, 31.0, 32.0, 33.0], 4 * 2020 + 3)
    return rows


@pytest.fixture(scope="session")
def filings(spark, filing_rows):
    return filings_frame(spark, filing_rows).cache()
