import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import d
from strictpast.contracts import INDEX_MEMBERSHIP
from strictpast.plans import membership as idx

CHANGES = "date date, added_ticker string, added_name string, removed_ticker string, removed_name string"
CURRENT = (
    "ticker string, name string, wiki_sector string, wiki_sub_industry string, date_added date, cik_code bigint"
)


def changes_of(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def current_of(spark, rows):
    return spark.createDataFrame([(t, f"{t} Inc", "S", "Sub", day, 7) for t, day in rows], CURRENT)


def test_properties_of_random_logs(spark):
    """Repeated events included; one ticker has most of the log. What any reading of a log of
    entries and exits must keep: intervals start no later than they end, an exit in the log ends
    some interval, and exactly the current tickers are open."""
    rng = random.Random(5)
    start = date(2020, 1, 1)
    events = []
    for _ in range(900):
        ticker = "HOT" if rng.random() < 0.5 else f"T{rng.randint(0, 40)}"
        events.append((ticker, start + timedelta(days=rng.randint(0, 60)), rng.random() < 0.5))
    current = {f"T{i}": start + timedelta(days=i) for i in range(0, 40, 3)}
    rows = [(day, *((t, "n", None, None) if enters else (None, None, t, "n"))) for t, day, enters in events]
    found, phantoms = idx.membership_intervals(current_of(spark, current.items()), changes_of(spark, rows))
    spans = [tuple(r) for r in found.collect()]
    closed = Counter((t, end) for t, _, end in spans if end is not None)
    exits = Counter((t, day) for t, day, enters in events if not enters)
    entries = {(t, day) for t, day, enters in events if enters}
    assert {(t, a) for t, a, end in spans if end is None} == set(current.items())
    assert len([1 for _, _, end in spans if end is None]) == len(current)
    assert all(end is None or a <= end for _, a, end in spans)
    assert all(closed[e] >= n for e, n in exits.items())
    assert set(closed) <= set(exits) | entries
    lost = {r[0] for r in phantoms.collect()}
    assert not lost & set(current)
    assert lost <= {t for t, _ in entries}


def intervals(spark, *rows):
    return spark.createDataFrame(
        [(t, t, None, None, a and d(a), r and d(r), None) for t, a, r in rows], INDEX_MEMBERSHIP
    )


@pytest.fixture(scope="module")
def book(spark):
    return intervals(
        spark,
        ("A", "2020-01-02", "2020-01-08"),
        ("A", "2020-01-13", None),
        ("B", "2019-01-01", None),
        ("B", "2019-06-01", None),
        ("C", None, None),
        ("D", "2020-01-06", "2020-01-06"),
    )


def names(df):
    return sorted(r.ticker for r in df.collect())


def test_intervals_are_half_open(book):
    assert names(idx.members_on(book, d("2020-01-01"))) == ["B"]
    assert names(idx.members_on(book, d("2020-01-02"))) == ["A", "B"]
    assert names(idx.members_on(book, d("2020-01-08"))) == ["B"]
    assert names(idx.members_on(book, d("2020-01-13"))) == ["A", "B"]


def test_many_days_agree_with_one_day(spark, book):
    days = [d("2019-12-31") + timedelta(days=i) for i in range(40)]
    out = idx.active_on(spark.createDataFrame([(x,) for x in days], "date date"), book)
    got = {(r.date, r.ticker) for r in out.collect()}
    want = {(x, t) for x in days for t in names(idx.members_on(book, x))}
    assert got == want and out.count() == len(want)


def test_window_has_business_days_only(book):
    out = idx.membership_window(book, d("2020-01-01"), d("2020-01-14"))
    assert out.columns == ["date", "ticker"]
    assert all(r.date.weekday() < 5 for r in out.collect())
    assert out.where("ticker = 'A'").count() == 4 + 2 and out.where("ticker = 'B'").count() == 10
    assert out.count() == out.distinct().count()
    assert idx.membership_window(book, d("2018-01-01"), d("2018-01-31")).count() == 0
    with pytest.raises(ValueError):
        idx.membership_window(book, d("2020-01-02"), d("2020-01-01"))


def test_future_rows_do_not_change_the_past(book):
    day = d("2020-01-07")
    early = book.where(F.col("date_added") <= F.lit(day)).withColumn(
        "date_removed", F.when(F.col("date_removed") <= F.lit(day), F.col("date_removed"))
    )
    assert names(idx.members_on(book, day)) == names(idx.members_on(early, day))


def test_enrichment_falls_back_to_the_log(spark):
    changes = changes_of(
        spark,
        [
            (d("2020-01-02"), "OLD", "Old Co", "GONE", "Gone Co"),
            (d("2020-02-03"), None, None, "OLD", "Old Co renamed"),
        ],
    )
    current = current_of(spark, [("CUR", d("2019-01-01"))])
    got, _ = idx.membership_intervals(current, changes)
    out = {r.ticker: r for r in idx.enrich_intervals(got, current, changes).collect()}
    assert out["OLD"].name == "Old Co" and out["GONE"].name == "Gone Co"
    assert out["CUR"].name == "CUR Inc" and out["CUR"].cik_code == 7
    assert out["GONE"].date_added == d("2020-01-02") and out["OLD"].wiki_sector is None


def test_log_position_decides_the_first_name(spark):
    changes = changes_of(
        spark,
        [(d("2020-01-02"), "T", "Early", None, None), (d("2020-02-03"), None, None, "T", "Late")],
    ).withColumn("seq", -F.unix_date("date"))
    current = current_of(spark, [("CUR", d("2019-01-01"))])
    got, _ = idx.membership_intervals(current, changes)
    assert idx.enrich_intervals(got, current, changes).where("ticker = 'T'").first().name == "Late"


def test_patches(spark):
    book = intervals(
        spark,
        ("OAK", "2001-02-05", "2003-03-10"),
        ("ELM", "2002-05-06", None),
        ("ASH", "2000-01-03", "2004-06-01"),
        ("ASH", "2004-06-01", None),
    )
    part = "ticker string, date_added date, date_removed date"
    updates = spark.createDataFrame(
        [("OAK", None, d("2003-03-07")), ("ELM", d("1998-09-01"), None), ("FIR", d("2000-01-03"), None)], part
    )
    adds = spark.createDataFrame([("YEW", d("2001-01-02"), d("2002-02-04"))], part)
    deletes = spark.createDataFrame([("ASH", d("2000-01-03"), d("2004-06-01"))], part)
    rows = {(r.ticker, r.date_added, r.date_removed) for r in idx.apply_patches(book, updates, adds, deletes).collect()}
    assert rows == {
        ("OAK", d("2001-02-05"), d("2003-03-07")),
        ("ELM", d("1998-09-01"), None),
        ("ASH", d("2004-06-01"), None),
        ("YEW", d("2001-01-02"), d("2002-02-04")),
    }
    counts = {r.op: r.rows for r in idx.patch_counts(book, updates, adds, deletes).collect()}
    assert counts == {"update": 2, "add": 1, "delete": 1}


def test_constituent_difference(spark):
    a = spark.createDataFrame([("A",), ("B",), ("B",)], "ticker string")
    b = spark.createDataFrame([("B",), ("C",)], "ticker string")
    diff = idx.constituent_difference(a, b)
    assert {tuple(r) for r in diff.collect()} == {("A", "only_left"), ("C", "only_right")}
    assert not idx.within_tolerance(diff).first().ok
    assert idx.within_tolerance(idx.constituent_difference(a, a)).first().ok
