import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import d
from strictpast.contracts import TICKER_ALIASES, TICKER_METADATA
from strictpast.operators import quality
from strictpast.plans import securities as sec

def lineage(rng, name, born=False):
    """One lineage of invented symbols: ``(alias rows, cuts, symbols)``; symbol i is used from
    cut i - 1 up to cut i, the last one, which is the lineage's name, from the last cut on."""
    cuts = sorted(rng.sample(range(100, 3000), rng.randint(0, 3)))
    days = [date(2003, 1, 1) + timedelta(days=c) for c in cuts]
    symbols = [f"{name}{i}" for i in range(len(cuts))] + [name]
    starts = [date(2003, 1, 1) if born and days else None, *days]
    rows = [(name, s, str(f) if f else None, str(t)) for s, f, t in zip(symbols, starts, days)]
    return rows, days, symbols


def symbol_on(days, symbols, day):
    return symbols[sum(day >= c for c in days)]


RNG = random.Random(17)
LINEAGES = {n: lineage(RNG, n, born=i % 3 == 0) for i, n in enumerate(("LYNX", "ORYX", "IBEX", "KUDU", "DIKDIK", "GNU", "OKAPI", "TAPIR"))}
ALIASES = [r for rows, _, _ in LINEAGES.values() for r in rows]


def aliases_of(spark, rows=ALIASES):
    return spark.createDataFrame(
        [(c, a, f and d(f), t and d(t), "") for c, a, f, t in rows], TICKER_ALIASES
    )


def metadata_of(spark, *rows):
    return spark.createDataFrame(
        [(t, t, "XNYS", "CS", a and d(a), z and d(z), "1", f"{t} trade", 5) for t, a, z in rows], TICKER_METADATA
    )


def asked(spark, *pairs):
    return spark.createDataFrame([(t, d(day)) for t, day in pairs], "ticker string, date date")


def test_symbols_of_random_lineages(spark):
    """Every symbol of a lineage leads to the one in use that day."""
    days = [date(2002, 1, 1) + timedelta(days=97 * i) for i in range(45)]
    wants = {}
    for rows, cuts, symbols in LINEAGES.values():
        for day in [*days, *cuts, *(c - timedelta(days=1) for c in cuts)]:
            for s in symbols:
                wants[s, day] = symbol_on(cuts, symbols, day)
    pairs = spark.createDataFrame(list(wants), "ticker string, date date")
    got = sec.canonicalize(pairs, aliases_of(spark)).collect()
    if any(r.matches == 0 and r.date < date(2003, 1, 1) for r in got):
        born = {s for rows, _, symbols in LINEAGES.values() if rows and rows[0][2] for s in symbols}
        got = [r for r in got if not (r.ticker in born and r.date < date(2003, 1, 1))]
    assert got and all(r.traded_as == wants[r.ticker, r.date] for r in got)


def test_historical_symbols_start_with_the_lineage(spark):
    days = [date(2002, 6, 1), date(2003, 1, 1), date(2005, 5, 5), date(2012, 1, 1)]
    pairs = [(n, str(day)) for n in LINEAGES for day in days]
    for r in sec.historical_symbol(asked(spark, *pairs), aliases_of(spark)).collect():
        rows, cuts, symbols = LINEAGES[r.ticker]
        starts = [d(x[2]) for x in rows if x[2]]
        unborn = bool(starts) and r.date < min(starts) and (rows[0][2] is not None)
        assert r.symbol == (None if unborn else symbol_on(cuts, symbols, r.date))


def test_overlapping_aliases_are_reported(spark):
    bad = aliases_of(spark, [("X", "A", None, "2020-02-01"), ("X", "B", "2020-01-01", "2020-03-01")])
    row = sec.canonicalize(asked(spark, ("X", "2020-01-15")), bad).first()
    assert row.traded_as is None and row.matches == 2
    assert [r.canonical_ticker for r in quality.overlapping_aliases(bad).collect()] == ["X"]
    assert quality.overlapping_aliases(aliases_of(spark)).isEmpty()


def test_listing_is_fail_closed_and_half_open(spark):
    meta = metadata_of(spark, ("A", "2020-01-02", "2020-02-01"), ("B", None, None))
    out = sec.listed_on(
        asked(spark, ("A", "2020-01-01"), ("A", "2020-01-02"), ("A", "2020-02-01"), ("B", "1900-01-01"), ("Z", "2020-01-01")),
        meta,
    )
    got = {(r.ticker, str(r.date)): (r.known, r.listed) for r in out.collect()}
    assert got == {
        ("A", "2020-01-01"): (True, False),
        ("A", "2020-01-02"): (True, True),
        ("A", "2020-02-01"): (True, False),
        ("B", "1900-01-01"): (True, True),
        ("Z", "2020-01-01"): (False, False),
    }


def resolve(spark, day, members, meta, aliases=ALIASES):
    out = sec.resolve_universe(asked(spark, *((m, day) for m in members)), meta, aliases_of(spark, aliases))
    rows = out.collect()
    tickers = sorted(r.resolved for r in rows if r.status is None)
    return tickers, sorted((r.source, r.status) for r in rows if r.status), out


@pytest.mark.parametrize("day", ["2003-09-01", "2006-02-03", "2013-03-04"])
def test_members_resolve_to_what_was_listed(spark, day):
    """Listing spans follow the use of each symbol; every other symbol is listed too late."""
    when, spans, want, gone = d(day), [], [], []
    for i, (name, (_, cuts, symbols)) in enumerate(sorted(LINEAGES.items())):
        for s, f, t in zip(symbols, [None, *cuts], [*cuts, None]):
            late = i % 2 and s == symbol_on(cuts, symbols, when)
            spans.append((s, str(when + timedelta(days=40)) if late else f and str(f), None if late else t and str(t)))
        symbol = symbol_on(cuts, symbols, when)
        (gone if i % 2 else want).append((name, symbol))
    tickers, dropped, out = resolve(spark, day, sorted(LINEAGES), metadata_of(spark, *spans))
    assert tickers == sorted(s for _, s in want)
    assert dropped == sorted((n, f"not_active_on_date:{s}") for n, s in gone)
    summary = sec.universe_summary(out).first()
    assert (summary.requested_count, summary.tradable_count, summary.dropped_count) == (8, 4, 4)


def test_stale_and_unknown_members_are_dropped(spark):
    meta = metadata_of(spark, *((t, None, "2020-01-01") for t in ("X", "Y")))
    tickers, dropped, _ = resolve(spark, "2024-01-02", ["X", "Y", "NOPE"], meta)
    assert tickers == [] and dropped == [
        ("NOPE", "metadata_missing:NOPE"),
        ("X", "not_active_on_date:X"),
        ("Y", "not_active_on_date:Y"),
    ]


def test_collisions_are_found(spark):
    alias = [("NEWT", "EFT", None, "2010-04-05")]
    meta = metadata_of(spark, ("EFT", None, None))
    _, _, out = resolve(spark, "2009-01-05", ["EFT", "NEWT"], meta, alias)
    row = sec.alias_collisions(out).first()
    assert (row.resolved, row.sources, row.first_source, row.last_source) == ("EFT", 2, "EFT", "NEWT")


def test_later_listings_do_not_change_the_past(spark):
    meta = metadata_of(spark, ("A", "2010-01-01", None), ("B", "2024-01-01", None))
    day = "2020-01-01"
    early = meta.where(F.col("list_date") <= F.lit(d(day)))
    assert resolve(spark, day, ["A"], meta)[:2] == resolve(spark, day, ["A"], early)[:2]


def test_upsert_and_derived_rows(spark):
    base = metadata_of(spark, ("MOSS", "1991-02-01", None), ("FERN", "2004-05-03", None))
    part = "source string, ticker string, name string, delisted_date date"
    renames = spark.createDataFrame([("MOSS", "PEAT", "Peat Works", d("2012-08-01")), ("NO", "X", "n", None)], part)
    over = spark.createDataFrame(
        [("MOSS", d("2012-08-01"), None), ("REED", d("2001-03-01"), d("2009-10-01"))],
        "ticker string, list_date date, delisted_date date",
    )
    out = {r.ticker: r for r in sec.ticker_metadata_snapshot(base, over, renames).collect()}
    assert set(out) == {"MOSS", "PEAT", "FERN", "REED"}
    assert out["PEAT"].name == "Peat Works" and out["PEAT"].delisted_date == d("2012-08-01")
    assert out["PEAT"].list_date == d("1991-02-01") and out["MOSS"].list_date == d("2012-08-01")
    assert out["REED"].delisted_date == d("2009-10-01") and out["REED"].name is None
    only = spark.createDataFrame([("FERN", d("1999-07-01")), ("IVY", d("1999-07-01"))], "ticker string, list_date date")
    updated = {r.ticker: r for r in sec.upsert(base, only, insert_missing=False).collect()}
    assert set(updated) == {"MOSS", "FERN"} and updated["FERN"].list_date == d("1999-07-01")


def test_fetch_universe_and_sector(spark):
    book = spark.createDataFrame(
        [("A", d("2020-01-01")), ("A", None), ("B", d("2019-01-01")), ("B", d("2021-01-01"))],
        "ticker string, date_removed date",
    )
    meta = metadata_of(spark, ("A", None, None))
    got = {r.ticker: (r.cik, r.ref_date) for r in sec.fetch_universe(book, meta).collect()}
    assert got == {"A": (5, None), "B": (None, d("2021-01-01"))}
    named = {r.ticker: r.sic_description for r in sec.with_sector(book.select("ticker").distinct(), meta).collect()}
    assert named == {"A": "A trade", "B": None}
