"""Several factors in a run, half runs, ordered patches, large parts, holdings headers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import bar_rows, business_days, d, filings_frame, quarters, BAR_SCHEMA
from strictpast.contracts import ContractError, INDEX_MEMBERSHIP
from strictpast.operators.fingerprint import TOO_LARGE, artifact_checksums
from strictpast.plans import jobs, ledger, membership as idx
from strictpast.plans.factors import REGISTRY, FactorContext
from strictpast.plans.factors.base import compute_all
from strictpast.plans.panel import UniverseRules, build_panel
from strictpast.sinks import writers
from strictpast.sources import tables

RUN = jobs.RunInfo("several", "ab" * 32, "c0ffee1")


@pytest.fixture(scope="module")
def small(spark):
    days = business_days(date(2020, 11, 2), 290)
    rows = [r for i, t in enumerate(("LARK", "WREN", "FINCH")) for r in bar_rows(t, "NYSE", "CS", [20.0 + i + (k * (i + 3)) % 11 for k in range(290)], days)]
    filings = [r for i, t in enumerate(("LARK", "WREN", "FINCH")) for r in quarters(t, 40 + i, 4, [3.0 + i, 5.0, 7.0, 11.0, 13.0], 4 * 2020)]
    return spark.createDataFrame(rows, BAR_SCHEMA), FactorContext(filings_frame(spark, filings))


def test_factors_together_equal_factors_alone(spark, small):
    bars, context = small
    panel = build_panel(bars, UniverseRules(min_history_days=20))
    both = compute_all([REGISTRY["mom_12_1"], REGISTRY["earnings_yield"]], panel, context)
    for name, computed in both.items():
        alone = REGISTRY[name].compute(panel, context)
        assert sorted(map(str, computed.table.collect())) == sorted(map(str, alone.collect()))
    with pytest.raises(ValueError, match="twice"):
        compute_all([REGISTRY["mom_12_1"]] * 2, panel, context)
    lags = {tuple(r) for r in REGISTRY["earnings_yield"].diagnostics(both["earnings_yield"].table, context).collect()}
    assert lags == {tuple(r) for r in REGISTRY["earnings_yield"].diagnostics(both["earnings_yield"].table, context, both["earnings_yield"].values).collect()}


def test_run_of_two_factors_and_a_half_run(spark, small, tmp_path, monkeypatch):
    bars, context = small
    root = str(tmp_path / "ledger")
    one, two = jobs.run_slices(spark, bars, str(tmp_path / "a"), root, RUN, ("mom_12_1", "earnings_yield"), context, UniverseRules(min_history_days=20))
    book = ledger.open_ledger(spark, root)
    assert (book.experiments.count(), book.candidates.count(), book.artifacts.count()) == (1, 2, 4)
    shared = {r.path: r.n for r in book.artifacts.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert sorted(shared.values()) == [1, 1, 2] and one.panel_path == two.panel_path and one.candidate_id != two.candidate_id
    codes = spark.createDataFrame([(RUN.code_id,)], "git_sha string")
    for done in (one, two):
        verdict = jobs.verify_candidate(spark, root, str(tmp_path / "a"), done.candidate_id, RUN.config_hash, codes).first()
        assert verdict.all_ok and verdict.artifacts_verified == 2

    def stop(*_):
        raise RuntimeError("executor and driver are gone")

    # The next run stops after its experiment and candidates were appended.
    monkeypatch.setattr(jobs, "artifact_checksums", stop)
    with pytest.raises(RuntimeError, match="gone"):
        jobs.run_slices(spark, bars, str(tmp_path / "b"), root, RUN, ("mom_12_1",))
    assert ledger.read_table(spark, root, "candidates").count() == 3
    book = ledger.open_ledger(spark, root)
    assert (book.experiments.count(), book.candidates.count(), book.artifacts.count()) == (1, 2, 4)


def test_ordered_patches(spark):
    rows = [("OAK", "Oak", "A", None, d("2001-02-05"), d("2003-03-10"), 1), ("OAK", "Oak", "A", None, d("2005-01-03"), None, 1), ("ELM", None, None, None, d("2002-05-06"), None, None)]
    book = spark.createDataFrame(rows, INDEX_MEMBERSHIP)
    day = d("2001-02-05")
    listed = [
        (5, "update", "OAK", day, None, "wiki_sector", "C"),
        (3, "update", "OAK", day, None, "wiki_sector", "B"),
        (4, "update", "OAK", None, None, "name", None),
        (6, "update", "OAK", day, None, "date_added", "2001-03-01"),
        (7, "update", "OAK", day, None, "name", "moved away"),
        (8, "update", "OAK", d("2001-03-01"), None, "date_added", "2001-04-02"),
        (1, "delete", "ELM", None, d("2009-01-01"), None, None),
        (2, "update", "YEW", None, None, "name", "too early"),
        (9, "add", "YEW", d("2010-01-04"), None, None, None),
        (10, "update", "YEW", None, None, "cik_code", "77"),
        (11, "update", "YEW", None, None, "wrong", "77"),
        (12, "rename", "YEW", None, None, "name", "no such operation"),
    ]
    patches = spark.createDataFrame(listed, idx.PATCHES)
    got = {tuple(r) for r in idx.fold_patches(book, patches).collect()}
    assert got == {
        ("OAK", None, "C", None, d("2001-04-02"), d("2003-03-10"), 1),
        ("OAK", None, "A", None, d("2005-01-03"), None, 1),
        ("ELM", None, None, None, d("2002-05-06"), None, None),
        ("YEW", None, None, None, d("2010-01-04"), None, 77),
    }
    assert sorted(r.position for r in idx.unmatched_patches(book, patches).collect()) == [1, 2, 7, 11, 12]
    assert idx.fold_patches(book, patches.limit(0)).count() == 3


def test_large_parts_are_named(spark, tmp_path):
    for name, rows in (("small", 1), ("large", 50_000)):
        spark.range(rows).coalesce(1).write.parquet(str(tmp_path / name))
    got = {r.path.rsplit("/", 1)[1]: r.checksum for r in artifact_checksums(spark, str(tmp_path), part_limit=10_000).collect()}
    assert len(got["small"]) == 64 and got["large"].startswith(TOO_LARGE + "part-")
    assert all(len(r.checksum) == 64 for r in artifact_checksums(spark, str(tmp_path)).collect())


def test_sinks_bound_the_rows_of_a_part(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "PART_ROWS", 100)
    writers.write_slice(build_panel(small[0]).coalesce(1), str(tmp_path / "panel"))
    parts = [p for p in (tmp_path / "panel").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 9 and spark.read.parquet(str(tmp_path / "panel")).count() == 870


@pytest.mark.parametrize("header", ["Name,Ticker,Sector,Asset Class", "AAA,Apple,IT,Equity", "Ticker,Name,Asset Class,Sector"])
def test_holdings_of_another_layout_fail(spark, tmp_path, header):
    (tmp_path / "good.csv").write_text("Fund\n\nTicker,Name,Sector,Asset Class,Weight\nAAPL,Apple,IT,Equity,4\n")
    assert [r.Ticker for r in tables.read_holdings(spark, str(tmp_path)).collect()] == ["AAPL"]
    (tmp_path / "other.csv").write_text(f"Fund\n{header}\nMSFT,Microsoft,IT,Equity\n")
    with pytest.raises(ContractError, match="other.csv"):
        tables.read_holdings(spark, str(tmp_path))
