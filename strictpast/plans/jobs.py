"""User-level jobs: inputs and parameters in, written tables and a ledger entry out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictpast.contracts import CANDIDATES, DAILY_BARS, EXPERIMENTS, INDEX_MEMBERSHIP, columns_of, require_columns
from strictpast.operators import quality
from strictpast.operators.fingerprint import artifact_checksums
from strictpast.plans import fundamentals as fund
from strictpast.plans import membership as idx
from strictpast.plans import reports, securities
from strictpast.plans.bars import daily_bars
from strictpast.plans.factors import REGISTRY, FactorContext
from strictpast.plans.factors.base import compute_all, diagnostics_dict
from strictpast.plans.ledger import Ledger, append_ledger, begin_run, commit_run, open_ledger, verify
from strictpast.plans.panel import REPEATED_KEY, UniverseRules, build_panel, for_members
from strictpast.session import stage
from strictpast.sinks import writers
from strictpast.sources import feeds, index_pages
from strictpast.sources.tables import read_fundamentals, read_membership, read_panel, read_ticker_metadata, snapshot_of

# The eight names of the fixed-universe slice.
FIXED_UNIVERSE = ("AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "JPM", "JNJ")


@dataclass(frozen=True)
class RunInfo:
    """What a run records about itself."""

    experiment: str
    config_hash: str
    code_id: str


@dataclass(frozen=True)
class SliceResult:
    experiment_id: str
    candidate_id: str
    panel_path: str
    factor_path: str
    panel_rows: int
    valid_rows: int
    tradable_rows: int
    data_snapshot_id: str


def _tickers(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def land_bars(
    adjusted: DataFrame,
    raw: DataFrame,
    details: DataFrame,
    requested: DataFrame,
    start: date,
    end: date,
    strict: bool = False,
) -> DataFrame:
    """Daily bars of the requested tickers; ``strict`` raises when any has none."""
    bars, skipped = daily_bars(adjusted, raw, details, requested, start, end)
    if strict:
        quality.enforce_empty(skipped, "requested tickers without bars")
    return bars


def _stored_panel(spark: SparkSession, bars: DataFrame, path: str, rules: UniverseRules, stored: bool) -> tuple[DataFrame, str]:
    """Build, write and reread the panel; with it its one snapshot id."""
    require_columns(bars, columns_of(DAILY_BARS), "bars")
    if not stored:
        # Fingerprinted and swept: derived bars would be computed once per pass.
        bars = stage(bars, "bars")
    if bars.isEmpty():
        raise ValueError("no bars for the requested universe")
    try:
        writers.write_slice(build_panel(bars, rules, check_keys=True), path)
    except (PySparkException, Py4JJavaError) as error:
        if REPEATED_KEY in str(error):
            raise quality.QualityError(REPEATED_KEY) from error
        raise
    panel = read_panel(spark, path)
    stamps = [r.data_snapshot_id for r in snapshot_of(panel).limit(2).collect()]
    if len(stamps) != 1:
        raise quality.QualityError(f"a panel has one snapshot id, this one {stamps}")
    return panel, stamps[0]


def run_slices(
    spark: SparkSession,
    bars: DataFrame,
    out: str,
    ledger_root: str,
    run: RunInfo,
    factors: Sequence[str] = ("mom_12_1",),
    context: FactorContext | None = None,
    rules: UniverseRules = UniverseRules(),
    label: str = "slice",
    stored: bool = False,
) -> tuple[SliceResult, ...]:
    """Panel -> factors -> checksums -> one experiment, a candidate for each factor, two artifacts each.

    The factors read one written panel, so the artifact is what was computed on, and are
    standardized together. All candidates record the same panel. The rows of the run become
    visible together, after the last append. Pass ``stored`` when ``bars`` is already a plain
    table on storage.
    """
    specs = [REGISTRY[f] for f in factors]
    panel_path = f"{out}/daily_panel_{label}"
    factor_paths = {f: f"{out}/factor_{f}_{label}" for f in factors}
    panel, snapshot = _stored_panel(spark, bars, panel_path, rules, stored)
    counters = {}
    for name, computed in compute_all(specs, panel, context).items():
        # Its scores are stored already: flags are cheaper to derive twice than to write twice.
        notes = diagnostics_dict(REGISTRY[name].diagnostics(computed.table, context, computed.values))
        writers.write_factor(computed.table, factor_paths[name], notes)
        counters[name] = reports.slice_counters(spark.read.parquet(factor_paths[name])).first()

    now = datetime.now(timezone.utc)
    experiment_id, candidate_ids = str(uuid.uuid4()), {f: str(uuid.uuid4()) for f in factors}
    begin_run(spark, ledger_root, experiment_id)
    experiment = (experiment_id, run.experiment, run.config_hash, run.code_id, now)
    append_ledger(spark, ledger_root, "experiments", spark.createDataFrame([experiment], EXPERIMENTS))
    candidates = [
        (candidate_ids[f.name], experiment_id, f.name, "deterministic_factor", f.formula, snapshot, "computed", now, now)
        for f in specs
    ]
    append_ledger(spark, ledger_root, "candidates", spark.createDataFrame(candidates, CANDIDATES))
    checksums = stage(artifact_checksums(spark, panel_path, *factor_paths.values()), "checksums")
    owned = [(candidate_ids[f], kind, path.rsplit("/", 1)[1]) for f in factors for kind, path in (("panel", panel_path), ("factor", factor_paths[f]))]
    owners = spark.createDataFrame(owned, "candidate_id string, artifact_type string, folder string")
    named = checksums.withColumn("folder", F.element_at(F.split("path", "/"), -1))
    artifacts = named.join(owners, "folder").select(
        "candidate_id", "artifact_type", "path", "checksum", F.lit(now).alias("created_at")
    )
    # A stable id per artifact: a recomputed task must not make a different one.
    artifact_id = F.sha2(F.concat_ws("|", "candidate_id", "artifact_type", "path"), 256)
    as_uuid = F.concat_ws(
        "-", *(F.substring(artifact_id, p, n) for p, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    )
    append_ledger(spark, ledger_root, "artifacts", artifacts.withColumn("artifact_id", as_uuid))
    commit_run(spark, ledger_root, experiment_id)
    return tuple(
        SliceResult(experiment_id, candidate_ids[f], panel_path, factor_paths[f], *counters[f][:3], snapshot) for f in factors
    )


def run_slice(
    spark: SparkSession,
    bars: DataFrame,
    out: str,
    ledger_root: str,
    run: RunInfo,
    factor: str = "mom_12_1",
    context: FactorContext | None = None,
    rules: UniverseRules = UniverseRules(),
    label: str = "slice",
    stored: bool = False,
) -> SliceResult:
    """:func:`run_slices` of one factor."""
    return run_slices(spark, bars, out, ledger_root, run, (factor,), context, rules, label, stored)[0]


def verify_candidate(
    spark: SparkSession,
    ledger_root: str,
    artifacts_root: str,
    candidate_id: str,
    config_hash: str | None,
    known_code_ids: DataFrame,
    check_config: bool = True,
) -> DataFrame:
    """One candidate's verdict against what ``artifacts_root`` holds now; an unknown id raises."""
    book = open_ledger(spark, ledger_root)
    wanted = spark.createDataFrame([(candidate_id,)], "candidate_id string")
    candidate = book.candidates.join(wanted, "candidate_id", "left_semi")
    if candidate.isEmpty():
        raise LookupError(f"candidate {candidate_id} is not in the ledger")
    # Joined rather than filtered by a literal: equal literals would cost the joins their key.
    artifacts = book.artifacts.join(wanted, "candidate_id", "left_semi")
    one = Ledger(book.experiments, candidate, artifacts)
    # A candidate has a handful of artifacts: only what lies at their paths is read.
    recorded = [r.path for r in artifacts.select("path").distinct().collect()]
    inside = artifacts_root.removeprefix("file:").rstrip("/") + "/"
    now = artifact_checksums(spark, *(p for p in recorded if p and p.startswith(inside)))
    return verify(one, now, config_hash, known_code_ids, check_config)


def fixed_slice(spark: SparkSession, bars: DataFrame, out: str, ledger_root: str, run: RunInfo, **kw) -> SliceResult:
    """The fixed eight-name slice; every name must have bars."""
    wanted = _tickers(spark, FIXED_UNIVERSE)
    absent = wanted.join(bars.select("ticker").distinct(), "ticker", "left_anti")
    quality.enforce_empty(absent, "fixed universe without bars")
    return run_slice(spark, for_members(bars, wanted), out, ledger_root, run, label="fixed", **kw)


def panel_for_date(
    bars: DataFrame, membership: DataFrame, day: date, rules: UniverseRules = UniverseRules()
) -> DataFrame:
    """All days of the tickers that were index members on ``day``."""
    members = idx.members_on(membership, day)
    if members.isEmpty():
        raise ValueError(f"no index members on {day}")
    return build_panel(for_members(bars, members), rules)


def universe_slice(
    spark: SparkSession,
    bars: DataFrame,
    membership: DataFrame,
    metadata: DataFrame,
    aliases: DataFrame,
    day: date,
    out: str,
    ledger_root: str,
    run: RunInfo,
    **kw,
) -> SliceResult:
    """A slice over the universe that was tradable on ``day``."""
    members = idx.members_on(membership, day).withColumn("date", F.lit(day))
    resolved = stage(securities.resolve_universe(members, metadata, aliases), "resolved")
    overlap = resolved.where(F.col("status").startswith(securities.ALIAS_OVERLAP))
    quality.enforce_empty(overlap, "overlapping alias intervals")
    quality.enforce_empty(securities.alias_collisions(resolved), "alias collision")
    tradable = resolved.where(F.col("status").isNull()).select(F.col("resolved").alias("ticker"))
    if tradable.isEmpty():
        raise ValueError(f"no tradable tickers on {day}")
    label = f"full_{day.isoformat()}"
    return run_slice(spark, for_members(bars, tradable), out, ledger_root, run, label=label, **kw)


def reconstruct_membership(
    current_page: DataFrame,
    changes_page: DataFrame,
    updates: DataFrame | None = None,
    adds: DataFrame | None = None,
    deletes: DataFrame | None = None,
    ordered: DataFrame | None = None,
) -> DataFrame:
    """Published tables -> patched membership intervals; ``ordered`` patches come last."""
    current = index_pages.normalize_current(current_page)
    changes = index_pages.normalize_changes(changes_page)
    intervals, _ = idx.membership_intervals(current, changes)
    enriched = idx.enrich_intervals(intervals, current, changes)
    patched = idx.apply_patches(enriched, updates, adds, deletes)
    return patched if ordered is None else idx.fold_patches(patched, ordered)


def publish_membership(
    membership: DataFrame, changes: DataFrame, out: str, min_rows: int = 640, code_id: str | None = None
) -> None:
    """Check, write, and record a membership snapshot."""
    require_columns(membership, columns_of(INDEX_MEMBERSHIP), "membership")
    membership = stage(membership, "membership")
    quality.enforce(membership, quality.membership_rules(), "membership")
    floors = quality.snapshot_floors(membership, min_rows).where(~F.col("ok"))
    quality.enforce_empty(floors, "membership below its floors")
    writers.write_membership(membership, f"{out}/index_membership")
    membership = read_membership(membership.sparkSession, f"{out}/index_membership")
    manifest = writers.membership_manifest(membership, changes)
    writers.append_manifest(manifest, f"{out}/snapshot_manifest", f"{out}/index_membership", code_id)


def fundamentals_snapshot(
    income: DataFrame,
    balance: DataFrame,
    cashflow: DataFrame,
    universe: DataFrame,
    not_before: date,
) -> tuple[DataFrame, DataFrame]:
    """(filings, uncovered entities) from the three landed statement feeds."""
    projected = [
        fund.within_filing_window(
            feeds.project_statements(raw, feeds.FIELDS_OF[tag], tag), universe, not_before
        )
        for raw, tag in ((income, feeds.INCOME), (balance, feeds.BALANCE), (cashflow, feeds.CASHFLOW))
    ]
    merged = fund.merge_statements(*projected)
    return fund.complete_filings(merged), fund.without_filings(universe, *projected)


def publish_fundamentals(
    filings: DataFrame,
    out: str,
    min_rows: int = 10_000,
    min_tickers: int = 500,
    code_id: str | None = None,
    universe: DataFrame | None = None,
) -> None:
    """Check, write, and record a filings snapshot; with ``universe`` also whom it does not cover."""
    filings = stage(filings, "filings")
    quality.enforce(filings, quality.filing_rules(), "fundamentals")
    floors = quality.snapshot_floors(filings, min_rows, min_tickers).where(~F.col("ok"))
    quality.enforce_empty(floors, "fundamentals below their floors")
    writers.write_fundamentals(filings, f"{out}/fundamentals")
    filings = read_fundamentals(filings.sparkSession, f"{out}/fundamentals")
    manifest = writers.fundamentals_manifest(filings, universe)
    writers.append_manifest(manifest, f"{out}/snapshot_manifest", f"{out}/fundamentals", code_id)


def publish_ticker_metadata(
    metadata: DataFrame, out: str, min_rows: int = 500, min_delisted: int = 50, code_id: str | None = None
) -> None:
    """Check, write, and record a snapshot of ticker metadata."""
    metadata = stage(metadata, "metadata")
    quality.enforce_empty(quality.duplicate_keys(metadata, ["ticker"]), "duplicate tickers")
    quality.enforce(metadata, quality.metadata_rules(), "ticker metadata")
    floors = quality.snapshot_floors(metadata, min_rows, 0, min_delisted).where(~F.col("ok"))
    quality.enforce_empty(floors, "ticker metadata below its floors")
    writers.write_ticker_metadata(metadata, f"{out}/ticker_metadata")
    metadata = read_ticker_metadata(metadata.sparkSession, f"{out}/ticker_metadata")
    manifest = writers.metadata_manifest(metadata)
    writers.append_manifest(manifest, f"{out}/snapshot_manifest", f"{out}/ticker_metadata", code_id)
