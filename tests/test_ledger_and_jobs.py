import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, bar_rows, business_days, d, filings_frame
from strictpast.contracts import FACTOR, INDEX_MEMBERSHIP, PANEL, TICKER_ALIASES, TICKER_METADATA, columns_of
from strictpast.operators import quality
from strictpast.operators.fingerprint import artifact_checksums, fingerprint
from strictpast.operators.quality import QualityError
from strictpast.plans import jobs, ledger
from strictpast.plans.jobs import RunInfo
from strictpast.plans.panel import UniverseRules
from strictpast.sinks import writers
from strictpast.sources.tables import read_membership, read_panel, read_symbol_list, snapshot_of
from strictpast.session import scratch_root, stage
from strictpast.testbed.tables import Tables

RUN = RunInfo("exp", "ab" * 32, "c0ffee1")


@pytest.fixture(scope="module")
def bars(spark):
    days = business_days(date(2023, 1, 2), 280)
    rows = []
    for i in range(12):
        closes = [50.0 + i + 0.01 * (i + 1) * j for j in range(len(days))]
        rows += bar_rows(f"T{i:02d}", "NYSE", "CS", closes, days)
    return spark.createDataFrame(rows, BAR_SCHEMA).cache()


@pytest.fixture(scope="module")
def slice_run(spark, bars, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("slice"))
    return jobs.run_slice(spark, bars, out, f"{out}/ledger", RUN), out


# --- fingerprints ---------------------------------------------------------------------------


def test_fingerprint_properties(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "b")], "x int, y string")

    def of(frame, columns=("x", "y")):
        return fingerprint(frame, columns).first()[0]

    base = of(df)
    assert len(base) == 64 and base == of(df.orderBy(F.rand(3)).repartition(3))
    assert base != of(df, ("y", "x"))
    assert base != of(df.withColumn("y", F.coalesce("y", F.lit("a"))))
    assert base != of(df.distinct())
    swapped = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "b")], "x int, y string")
    assert base != of(swapped)
    assert len(of(df.limit(0))) == 64


def test_nulls_do_not_slide_between_columns(spark):
    a = spark.createDataFrame([("v", None)], "x string, y string")
    b = spark.createDataFrame([(None, "v")], "x string, y string")
    assert fingerprint(a, ["x", "y"]).first()[0] != fingerprint(b, ["x", "y"]).first()[0]


def test_text_is_escaped_and_doubles_are_exact(spark):
    def of(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return fingerprint(df, df.columns).first()[0]

    text = "x string, y string"
    assert of([("a|b", "c")], text) != of([("a", "b|c")], text)
    assert of([(None, "a")], text) != of([("~", "a")], text)
    assert of([("1:a", "")], text) != of([("", "1:a")], text)
    values = [0.0, 1.0, -1.0, 0.1, 0.1 + 2**-56, 1 / 3, 1e300, 1e-300, 2.0**52, 2.0**53 - 1, float("inf"), float("-inf"), float("nan"), None]
    assert len({of([(v,)], "x double") for v in values}) == len(values)


# --- scratch area ------------------------------------------------------------------------------


def test_staging_uses_the_configured_folder(spark):
    root = scratch_root(spark)
    staged = stage(spark.range(3), "probe")
    assert root == spark.conf.get("spark.checkpoint.dir")
    assert root.removeprefix("file:") in staged.inputFiles()[0] and staged.count() == 3


# --- slices ---------------------------------------------------------------------------------------


def test_slice_writes_and_records(spark, slice_run):
    result, out = slice_run
    panel = read_panel(spark, result.panel_path)
    factor = spark.read.parquet(result.factor_path)
    assert panel.columns == columns_of(PANEL) and factor.columns == columns_of(FACTOR)
    assert result.panel_rows == panel.count() == 12 * 280
    assert result.valid_rows == 12 * 28 and result.tradable_rows == 12 * 28
    assert snapshot_of(panel).first().data_snapshot_id == result.data_snapshot_id
    book = ledger.open_ledger(spark, f"{out}/ledger")
    assert [t.count() for t in (book.experiments, book.candidates, book.artifacts)] == [1, 1, 2]
    assert {r.artifact_type for r in book.artifacts.collect()} == {"panel", "factor"}
    candidate = book.candidates.first()
    assert candidate.candidate_name == "mom_12_1" and candidate.status == "computed"
    notes = writers.read_diagnostics(spark, result.factor_path)
    assert notes == {"invalid_reason_counts": {"__valid__": 336, "history_ineligible": 12 * 252}}
    assert writers.read_diagnostics(spark, result.panel_path) == {}


def test_rerun_has_the_same_content(spark, bars, slice_run, tmp_path):
    again = jobs.run_slice(spark, bars.orderBy(F.rand(5)), str(tmp_path), f"{tmp_path}/ledger", RUN)
    assert again.data_snapshot_id == slice_run[0].data_snapshot_id
    stamps = [
        spark.read.parquet(r.factor_path).select("feature_snapshot_id").distinct().collect()
        for r in (again, slice_run[0])
    ]
    assert stamps[0] == stamps[1]


def test_slices_never_overwrite(spark, bars, slice_run):
    _, out = slice_run
    with pytest.raises(Exception, match="(?i)exist"):
        jobs.run_slice(spark, bars, out, f"{out}/ledger2", RUN)


def test_bad_bars_are_rejected(spark, bars, tmp_path):
    with pytest.raises(QualityError, match="repeated"):
        jobs.run_slice(spark, bars.unionByName(bars.limit(1)), str(tmp_path), f"{tmp_path}/l", RUN)
    with pytest.raises(ValueError, match="no bars"):
        jobs.run_slice(spark, bars.limit(0), str(tmp_path), f"{tmp_path}/l", RUN)


def test_earnings_slice(spark, bars, filing_rows, tmp_path):
    from strictpast.plans.factors import FactorContext

    context = FactorContext(filings_frame(spark, filing_rows))
    out = jobs.run_slice(spark, bars, str(tmp_path), f"{tmp_path}/l", RUN, "earnings_yield", context)
    assert out.valid_rows == 0
    notes = writers.read_diagnostics(spark, out.factor_path)
    assert notes == {"invalid_reason_counts": {"missing_fundamentals": 12 * 280}}


def universe_inputs(spark):
    members = [("NEW", None), ("T00", None), ("FUT", None)]
    membership = spark.createDataFrame(
        [(t, t, None, None, d("2020-01-01"), r, None) for t, r in members], INDEX_MEMBERSHIP
    )
    listed = [("T01", "2010-01-01"), ("T00", "2010-01-01"), ("FUT", "2025-01-01")]
    metadata = spark.createDataFrame(
        [(t, t, "XNYS", "CS", d(a), None, None, None, None) for t, a in listed], TICKER_METADATA
    )
    aliases = spark.createDataFrame([("NEW", "T01", None, d("2024-06-01"), "")], TICKER_ALIASES)
    return membership, metadata, aliases


def test_universe_slice_uses_dated_symbols(spark, bars, tmp_path):
    inputs = universe_inputs(spark)
    day = d("2023-06-15")
    out = jobs.universe_slice(spark, bars, *inputs, day, str(tmp_path), f"{tmp_path}/l", RUN)
    kept = {r.ticker for r in spark.read.parquet(out.panel_path).select("ticker").distinct().collect()}
    assert kept == {"T00", "T01"} and out.panel_path.endswith("daily_panel_full_2023-06-15")
    with pytest.raises(ValueError, match="no tradable"):
        jobs.universe_slice(spark, bars, *inputs, d("2019-01-01"), str(tmp_path), f"{tmp_path}/l", RUN)
    clash = inputs[2].unionByName(
        spark.createDataFrame([("T00", "T01", None, None, "")], TICKER_ALIASES)
    )
    with pytest.raises(QualityError, match="collision"):
        jobs.universe_slice(spark, bars, inputs[0], inputs[1], clash, day, str(tmp_path), f"{tmp_path}/l", RUN)


def test_fixed_slice_and_panel_for_date(spark, bars, tmp_path):
    with pytest.raises(QualityError, match="AAPL"):
        jobs.fixed_slice(spark, bars, str(tmp_path), f"{tmp_path}/l", RUN)
    days = business_days(date(2023, 1, 2), 5)
    eight = spark.createDataFrame(
        [row for t in jobs.FIXED_UNIVERSE for row in bar_rows(t, "NYSE", "CS", [9.0] * 5, days)], BAR_SCHEMA
    )
    assert jobs.fixed_slice(spark, eight.unionByName(bars), str(tmp_path), f"{tmp_path}/l", RUN).panel_rows == 40
    membership = universe_inputs(spark)[0]
    assert jobs.panel_for_date(bars, membership, d("2023-06-15"), UniverseRules()).count() == 280
    with pytest.raises(ValueError, match="no index members"):
        jobs.panel_for_date(bars, membership, d("2019-01-01"))


def test_partitioned_panel(spark, slice_run, tmp_path):
    panel = read_panel(spark, slice_run[0].panel_path)
    path = str(tmp_path / "by_year")
    writers.write_slice(panel, path, by_year=True)
    assert sorted(n for n in os.listdir(path) if n.startswith("year=")) == ["year=2023", "year=2024"]
    assert read_panel(spark, path).exceptAll(panel).isEmpty()
    assert artifact_checksums(spark, path).first().path == path


# --- verify -----------------------------------------------------------------------------------------


def verdict(spark, root, recomputed, config=RUN.config_hash, known=(RUN.code_id,), **kw):
    codes = spark.createDataFrame([(c,) for c in known], "git_sha string")
    return ledger.verify(ledger.open_ledger(spark, root), recomputed, config, codes, **kw).first()


def test_verify(spark, slice_run):
    result, out = slice_run
    root = f"{out}/ledger"
    now = artifact_checksums(spark, out).where(~F.col("path").contains("/ledger")).cache()
    ok = verdict(spark, root, now)
    assert ok.all_ok and (ok.artifacts_verified, ok.artifacts_failed) == (2, 0)
    changed = verdict(spark, root, now.withColumn("checksum", F.when(F.col("path") == result.panel_path, "x").otherwise(F.col("checksum"))))
    assert (changed.checksum_mismatch, changed.artifacts_verified, changed.all_ok) == (1, 1, False)
    gone = verdict(spark, root, now.where(F.col("path") != result.factor_path))
    assert (gone.file_missing, gone.all_ok) == (1, False)
    drift = verdict(spark, root, now, config="cd" * 32)
    assert (drift.config_hash_match, drift.all_ok) == (False, False)
    skipped = verdict(spark, root, now, config=None, check_config=False)
    assert skipped.all_ok and not skipped.config_hash_match and skipped.config_hash_current == "<skipped>"
    assert not verdict(spark, root, now, known=("other",)).all_ok
    before = [t.count() for t in vars(ledger.open_ledger(spark, root)).values()]
    assert before == [1, 1, 2]
    assert ledger.candidate_provenance(ledger.open_ledger(spark, root), result.candidate_id).count() == 2
    with pytest.raises(LookupError):
        ledger.candidate_provenance(ledger.open_ledger(spark, root), "nobody")
    codes = spark.createDataFrame([(RUN.code_id,)], "git_sha string")
    args = (RUN.config_hash, codes)
    assert jobs.verify_candidate(spark, root, out, result.candidate_id, *args).first().all_ok
    with pytest.raises(LookupError):
        jobs.verify_candidate(spark, root, out, "nobody", *args)


def test_changed_bytes_are_noticed(spark, tmp_path):
    path = str(tmp_path / "art")
    spark.range(5).coalesce(1).write.parquet(path)
    before = artifact_checksums(spark, str(tmp_path)).first().checksum
    part = next(n for n in os.listdir(path) if n.startswith("part-"))
    with open(f"{path}/{part}", "ab") as f:
        f.write(b"x")
    assert artifact_checksums(spark, str(tmp_path)).first().checksum != before


def experiment(spark, eid, config="ab" * 32):
    return spark.createDataFrame(
        [(eid, "n", config, "c0ffee1", datetime(2024, 1, 1))],
        "experiment_id string, name string, config_hash string, git_sha string, created_at timestamp",
    )


def candidate(spark, cid, eid, status="registered"):
    now = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(cid, eid, "f", "deterministic_factor", "x", "s", status, now, now)],
        "candidate_id string, experiment_id string, candidate_name string, candidate_type string,"
        " formula_string string, data_snapshot_id string, status string, created_at timestamp, updated_at timestamp",
    )


def test_ledger_gates(spark, tmp_path):
    root = str(tmp_path / "ledger")
    ledger.append_ledger(spark, root, "experiments", experiment(spark, "e1"))
    with pytest.raises(QualityError, match="experiments"):
        ledger.append_ledger(spark, root, "candidates", candidate(spark, "c1", "e2"))
    with pytest.raises(QualityError, match="status_known"):
        ledger.append_ledger(spark, root, "candidates", candidate(spark, "c1", "e1", "great"))
    with pytest.raises(QualityError, match="config_hash_hex"):
        ledger.append_ledger(spark, root, "experiments", experiment(spark, "e2", "zz" * 32))
    ledger.append_ledger(spark, root, "candidates", candidate(spark, "c1", "e1"))
    none = verdict(spark, root, spark.createDataFrame([], "path string, checksum string"), known=("c0ffee1",))
    assert none.no_artifacts_recorded == 1 and not none.all_ok
    metric = spark.createDataFrame(
        [("m", "c1", "ic", 0.1, None, 0, datetime(2024, 1, 1))],
        "metric_id string, candidate_id string, metric_name string, value double, fold string, horizon int, created_at timestamp",
    )
    with pytest.raises(QualityError, match="horizon_positive"):
        ledger.append_ledger(spark, root, "metrics", metric)
    ledger.append_ledger(spark, root, "metrics", metric.withColumn("horizon", F.lit(21)))
    assert not [n for n in dir(ledger) if n.startswith(("update", "delete"))]


# --- snapshots and quality -------------------------------------------------------------------------------


def test_publishing_snapshots(spark, filings, tmp_path):
    out = str(tmp_path)
    jobs.publish_fundamentals(filings, out, min_rows=10, min_tickers=5)
    with pytest.raises(QualityError, match="floors"):
        jobs.publish_fundamentals(filings, f"{out}/x")
    membership = universe_inputs(spark)[0]
    changes = spark.createDataFrame([(d("2010-01-01"),)], "date date")
    jobs.publish_membership(membership, changes, out, min_rows=3)
    assert read_membership(spark, f"{out}/index_membership").count() == 3
    bad = membership.withColumn("date_removed", F.lit(d("2019-01-01")))
    with pytest.raises(QualityError, match="removed_not_before_added"):
        jobs.publish_membership(bad, changes, f"{out}/y", min_rows=1)
    metadata = universe_inputs(spark)[1]
    jobs.publish_ticker_metadata(metadata, out, min_rows=3, min_delisted=0)
    with pytest.raises(QualityError, match="duplicate"):
        jobs.publish_ticker_metadata(metadata.union(metadata), f"{out}/z")
    rows = {r.snapshot: r for r in spark.read.json(f"{out}/snapshot_manifest").collect()}
    assert rows["fundamentals"].rows == filings.count() and len(rows["fundamentals"].content_sha) == 64
    assert rows["index_membership"].current_members == 3
    assert rows["index_membership"].earliest_change == "2010-01-01"
    assert rows["ticker_metadata"].delisted == 0


def test_constituents_file(spark, tmp_path):
    path = str(tmp_path / "names")
    tickers = spark.createDataFrame([("B",), ("A",), ("B",)], "ticker string")
    writers.write_constituents(tickers, path, "constituents as of 2024-01-02")
    assert [r.ticker for r in read_symbol_list(spark, path).orderBy("ticker").collect()] == ["A", "B"]
    first = spark.read.text(path).collect()[0].value
    assert first.startswith("# ")


def test_reconstruction_job(spark):
    current = spark.createDataFrame(
        [("CUR", "Cur", "S", "SS", "2015-01-02", "7")],
        "Symbol string, Security string, `GICS Sector` string, `GICS Sub-Industry` string, `Date added` string, CIK string",
    )
    changes = spark.createDataFrame(
        [("2010-01-04", "OLD", "Old", None, None), ("2012-01-04", None, None, "OLD", "Old")],
        "`Effective Date_Effective Date` string, Added_Ticker string, Added_Security string, Removed_Ticker string, Removed_Security string",
    )
    out = jobs.reconstruct_membership(current, changes)
    assert out.columns == columns_of(INDEX_MEMBERSHIP)
    assert {(r.ticker, r.date_added, r.date_removed) for r in out.collect()} == {
        ("CUR", d("2015-01-02"), None),
        ("OLD", d("2010-01-04"), d("2012-01-04")),
    }
    assert quality.check(out, quality.membership_rules()).agg(F.sum("broken_rows")).first()[0] == 0


def test_rules_catch_broken_rows(spark):
    days = business_days(date(2024, 1, 1), 2)
    rows = bar_rows("A", "NYSE", "CS", [10.0, -1.0], days) + bar_rows("", "OTC", "ZZ", [1.0], days[:1])
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    found = {r.rule: r.broken_rows for r in quality.check(bars, quality.bar_rules()).collect()}
    assert found["raw_close_positive"] == 1 and found["mcap_positive"] == 1
    assert found["exchange_known"] == 1 and found["ticker_length"] == 1 and found["ticker_type_known"] == 1
    assert quality.violations(bars, quality.bar_rules()).count() == 2
    with pytest.raises(QualityError, match="raw_close_positive: 1 of 3"):
        quality.enforce(bars, quality.bar_rules(), "bars")
    twice = quality.duplicate_keys(bars.unionByName(bars.limit(1)), ["date", "ticker"])
    assert twice.count() == 1


def test_large_tables_are_read_once_by_the_published_snapshots(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in t.filings().inputFiles())
    # The change log formats and parses its dates when it is stored, not in the plans that read it.
    assert t.stored_changes() is t.stored_changes() and not any("events" in f for f in t.stored_changes().inputFiles())
    assert "date_format" not in t.membership()._jdf.queryExecution().executedPlan().toString()
