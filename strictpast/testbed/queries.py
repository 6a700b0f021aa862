"""Every operator as a query over the general test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from strictpast.contracts import DAILY_BARS, TICKER_ALIASES, TICKER_METADATA, columns_of, conform
from strictpast.functions import normalize_id, padded_id, undotted
from strictpast.operators import quality
from strictpast.operators.cross_section import winsorize, zscore
from strictpast.operators.fingerprint import artifact_checksums, fingerprint
from strictpast.plans import bars as bar_plans
from strictpast.plans import fundamentals as fund
from strictpast.plans import ledger as books
from strictpast.plans import membership as idx
from strictpast.plans import panel as panels
from strictpast.plans import reports, securities
from strictpast.plans.factors import REGISTRY, FactorContext
from strictpast.plans.factors.base import invalid_reason_counts
from strictpast.plans.factors.earnings_yield import lag_distribution
from strictpast.plans.jobs import (
    RunInfo,
    fundamentals_snapshot,
    FIXED_UNIVERSE,
    panel_for_date,
    publish_fundamentals,
    publish_membership,
    publish_ticker_metadata,
    reconstruct_membership,
    run_slices,
    universe_slice,
    verify_candidate,
)
from strictpast.plans.jobs import fixed_slice as fixed_slice_job
from strictpast.session import scratch_root, stage
from strictpast.sinks import writers
from strictpast.sources import feeds, index_pages
from strictpast.sources import tables
from strictpast.sources.tables import equity_holdings
from strictpast.testbed.tables import RULES, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WINDOW = (date(2024, 1, 1), date(2024, 2, 29))
ANCHOR = date(2024, 1, 12)
COVERAGE = (date(1998, 1, 1), date(1999, 12, 31))
NOT_BEFORE = date(1996, 1, 1)
CONFIG = "config 1"


def query(fn: Callable[[Tables], DataFrame], name: str | None = None) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    QUERIES[name or fn.__name__] = run
    return fn


def named(name: str) -> Callable:
    return lambda fn: query(fn, name)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- bars and panel ---------------------------------------------------------------------


@query
def bars_from_feed(t: Tables) -> DataFrame:
    """Epoch-millisecond records of the raw feed back to days."""
    ms = F.unix_date("date").cast("bigint") * 86_400_000 + 3_600_000
    landed = t.raw_feed().withColumn("timestamp", ms).drop("date")
    return feeds.bars_from_feed(landed)


@query
def adj_raw_join(t: Tables) -> DataFrame:
    return bar_plans.join_feeds(t.adjusted_feed(), t.raw_feed())


@query
def daily_bars(t: Tables) -> DataFrame:
    requested = t.details().select("ticker")
    return bar_plans.daily_bars(
        t.adjusted_feed(), t.raw_feed(), t.details(), requested, date(1996, 1, 1), date(2000, 12, 31)
    )[0]


@query
def skip_audit(t: Tables) -> DataFrame:
    """Customers and parts ask for tickers: many are no suppliers, and some have details but no bars."""
    k = F.col("c_custkey")
    requested = t.read("customer").select(F.concat(F.lit("S"), k).alias("ticker"))
    odd = t.read("customer").select(
        F.concat(F.lit("N"), k).alias("ticker"), F.lit("XNYS").alias("primary_exchange"), F.lit("CS").alias("type"),
        F.lit(1.0).alias("weighted_shares_outstanding"),
    )
    asked = requested.unionByName(odd.select("ticker"))
    return bar_plans.skipped_tickers(asked, t.details().unionByName(odd), t.raw_feed())


@query
def ret_1d(t: Tables) -> DataFrame:
    return rounded(panels.with_returns(t.bars()).select("date", "ticker", "ret_1d"), 9, "ret_1d")


@query
def universe_flags(t: Tables) -> DataFrame:
    return panels.universe_flags(t.bars(), RULES)


@query
def fail_reason_counts(t: Tables) -> DataFrame:
    flags = panels.universe_flags(t.bars(), RULES)
    return flags.groupBy(F.coalesce("fail_reason", F.lit("eligible")).alias("fail_reason")).agg(
        F.count("*").alias("rows")
    )


@query
def panel(t: Tables) -> DataFrame:
    return rounded(panels.build_panel(t.bars(), RULES), 9, "ret_1d").drop("data_snapshot_id")


@query
def panel_for_anchor_date(t: Tables) -> DataFrame:
    """The panel of the suppliers that were in the index on one day."""
    users = t.membership().withColumn("ticker", F.translate("ticker", "UX", "SS"))
    return panel_for_date(t.bars(), users, ANCHOR, RULES).select("date", "ticker", "eligible_flag")


@query
def eligible_per_day(t: Tables) -> DataFrame:
    return panels.eligible_per_day(panels.build_panel(t.bars(), RULES))


@query
def panel_summary(t: Tables) -> DataFrame:
    return panels.panel_summary(panels.build_panel(t.bars(), RULES))


@query
def panel_fingerprint(t: Tables) -> DataFrame:
    """The content fingerprint of all bars, all columns."""
    bars = t.bars()
    return fingerprint(bars, columns_of(DAILY_BARS))


@query
def panel_stamped(t: Tables) -> DataFrame:
    """The fingerprint of its input stamped on every panel row, one row per distinct stamp."""
    return panels.build_panel(t.bars(), RULES).groupBy("data_snapshot_id").agg(F.count("*").alias("rows"))


# --- cross-section and momentum -------------------------------------------------------------


@named("winsorize")
def winsorized(t: Tables) -> DataFrame:
    rows = t.bars().select("date", "ticker", F.ln("adj_close").alias("log_price"))
    out = winsorize(rows, "log_price", "clipped", (0.05, 0.95))
    return rounded(out, 8, "clipped").select("date", "ticker", "clipped")


@named("zscore")
def zscored(t: Tables) -> DataFrame:
    rows = t.bars().select("date", "ticker", "adj_close")
    out = zscore(zscore(rows, "adj_close", "z"), "adj_close", "z_sample", ddof=1)
    return rounded(out, 6, "z", "z_sample").select("date", "ticker", "z", "z_sample")


def momentum(t: Tables) -> DataFrame:
    return REGISTRY["mom_12_1"].compute(panels.build_panel(t.bars(), RULES))


def factor_view(factor: DataFrame) -> DataFrame:
    out = rounded(factor, 8, "raw_value", "winsorized_value")
    return rounded(out, 6, "zscore_value").drop("feature_snapshot_id")


@query
def mom_12_1(t: Tables) -> DataFrame:
    return factor_view(momentum(t))


@query
def mom_reason_counts(t: Tables) -> DataFrame:
    return invalid_reason_counts(momentum(t))


@query
def slice_counters(t: Tables) -> DataFrame:
    return reports.slice_counters(momentum(t))


@query
def zscore_sanity(t: Tables) -> DataFrame:
    return rounded(reports.zscore_sanity(momentum(t)), 6, "max_abs_mean", "mean_std")


@query
def zscore_by_day(t: Tables) -> DataFrame:
    daily = reports.zscore_by_day(momentum(t))
    return daily.select("date", F.abs(F.round("mean", 6)).alias("abs_mean"), F.round("std", 6).alias("std"))


@query
def last_day_cross_section(t: Tables) -> DataFrame:
    out = rounded(reports.last_day_cross_section(momentum(t)), 8, "raw_value", "winsorized_value")
    return rounded(out, 6, "zscore_value")


@query
def ticker_series(t: Tables) -> DataFrame:
    return rounded(reports.ticker_series(momentum(t), "S7"), 8, "raw_value")


def _run(t: Tables, factors: tuple[str, ...] = ("mom_12_1",), label: str = "slice"):
    """A slice over all bars in a folder of its own: ``(folder, run, results)``."""
    out = f"{scratch_root(t.spark)}/slices/{uuid.uuid4().hex}"
    run = RunInfo("testbed", "ab" * 32, "c0ffee1")
    context = FactorContext(t.stored_filings()) if "earnings_yield" in factors else None
    return out, run, run_slices(t.spark, t.bars(), out, f"{out}/ledger", run, factors, context, RULES, label)


@query
def slice_job(t: Tables) -> DataFrame:
    """The whole pipeline: both artifacts and the ledger written, then verified from storage."""
    out, run, (done,) = _run(t)
    codes = t.spark.createDataFrame([(run.code_id,)], "git_sha string")
    verdict = verify_candidate(t.spark, f"{out}/ledger", out, done.candidate_id, run.config_hash, codes)
    factor = t.spark.read.parquet(done.factor_path)
    verified = verdict.select(F.struct("artifacts_verified", "all_ok")).scalar()
    return reports.slice_counters(factor).withColumn("_v", verified).select(
        "panel_rows", "valid_rows", "tradable_rows", "_v.artifacts_verified", "_v.all_ok"
    )


@query
def multi_slice(t: Tables) -> DataFrame:
    """Two factors over one panel: values of both, as written, with what the ledger holds of the run."""
    out, _, done = _run(t, ("mom_12_1", "earnings_yield"), "multi")
    both = t.spark.read.parquet(*(d.factor_path for d in done))
    book = books.open_ledger(t.spark, f"{out}/ledger")
    facts = books.provenance(book).groupBy("candidate_name").agg(
        F.count("artifact_id").alias("artifacts"), F.count_distinct("path").alias("paths"), F.count_distinct("candidate_id").alias("candidates")
    )
    # Stored, so that its size is known: a shuffle by the factor's name would make one task of a factor.
    facts = stage(facts, "facts")
    met = factor_view(both).join(facts, F.col("factor_name") == F.col("candidate_name")).drop("candidate_name")
    return met.withColumn("experiments", book.experiments.agg(F.count("*")).scalar())


@query
def factor_notes(t: Tables) -> DataFrame:
    """Diagnostics of both factors as read back from the footers of their files."""
    _, _, done = _run(t, ("mom_12_1", "earnings_yield"), "notes")
    rows = []
    for one, name in zip(done, ("mom_12_1", "earnings_yield")):
        notes = writers.read_diagnostics(t.spark, one.factor_path)
        rows += [(name, section, item, value) for section, items in notes.items() for item, value in items.items()]
    return t.spark.createDataFrame(rows, "factor_name string, section string, item string, value long")


@query
def verify_changed_files(t: Tables) -> DataFrame:
    """A run's files verified after one dataset gained a part and another one lost all of its files."""
    out, run, done = _run(t, ("mom_12_1", "earnings_yield"), "verify")
    # The panel gains rows; the second factor is checked where it never was.
    t.spark.read.parquet(done[0].panel_path).write.mode("append").parquet(done[0].panel_path)
    book = books.open_ledger(t.spark, f"{out}/ledger")
    gone = F.when(F.col("path").contains("earnings_yield"), F.concat("path", F.lit("-gone"))).otherwise(F.col("path"))
    moved = books.Ledger(book.experiments, book.candidates, book.artifacts.withColumn("path", gone))
    paths = [r.path for r in moved.artifacts.select("path").distinct().collect()]
    codes = t.spark.createDataFrame([(run.code_id,)], "git_sha string")
    verdict = books.verify(moved, artifact_checksums(t.spark, *paths), run.config_hash, codes)
    names = book.candidates.select("candidate_id", "candidate_name")
    return verdict.join(names, "candidate_id").select(
        "candidate_name", "artifacts_verified", "artifacts_failed", "file_missing", "checksum_mismatch", "all_ok"
    )


@query
def dated_slice(t: Tables) -> DataFrame:
    """The date-anchored job over the suppliers that play the index members of one day."""
    out = f"{scratch_root(t.spark)}/slices/{uuid.uuid4().hex}"
    members = t.membership().withColumn("ticker", F.translate("ticker", "UX", "SS"))
    listed = t.details().select("ticker", F.lit(None).cast("date").alias("list_date"), F.lit(None).cast("date").alias("delisted_date"))
    none = t.spark.createDataFrame([], TICKER_ALIASES)
    run = RunInfo("dated", "cd" * 32, "c0ffee1")
    done = universe_slice(t.spark, t.bars(), members, conform(listed, TICKER_METADATA), none, ANCHOR, out, f"{out}/ledger", run, rules=RULES)
    return t.spark.read.parquet(done.factor_path).groupBy("ticker").agg(F.count("*").alias("rows"), F.count_if("valid_flag").alias("valid_rows"))


@query
def fixed_slice(t: Tables) -> DataFrame:
    """The fixed-universe job: eight suppliers play its eight names."""
    out = f"{scratch_root(t.spark)}/slices/{uuid.uuid4().hex}"
    names = F.create_map(*(F.lit(x) for i, n in enumerate(FIXED_UNIVERSE) for x in (f"S{i + 1}", n)))
    bars = t.bars().withColumn("ticker", F.coalesce(F.element_at(names, F.col("ticker")), F.col("ticker")))
    done = fixed_slice_job(t.spark, bars, out, f"{out}/ledger", RunInfo("fixed", "ef" * 32, "c0ffee1"), rules=RULES)
    return t.spark.read.parquet(done.factor_path).groupBy("ticker").agg(F.count("*").alias("rows"), F.count_if("valid_flag").alias("valid_rows"))


# --- membership -------------------------------------------------------------------------------


@query
def normalize_current(t: Tables) -> DataFrame:
    return t.current()


@query
def undated_current(t: Tables) -> DataFrame:
    return index_pages.undated_current(t.current_page())


@query
def normalize_changes(t: Tables) -> DataFrame:
    return t.changes()


@query
def membership_intervals(t: Tables) -> DataFrame:
    return t.intervals()


@query
def membership_phantoms(t: Tables) -> DataFrame:
    return idx.membership_intervals(t.current(), t.changes())[1]


@query
def interval_enrichment(t: Tables) -> DataFrame:
    return idx.enrich_intervals(t.intervals(), t.current(), t.changes())


@query
def curated_patches(t: Tables) -> DataFrame:
    """Reconstructed membership after the three patch tables and then an ordered list."""
    return reconstruct_membership(t.current_page(), t.changes_page(), *t.patches(), t.ordered_patches())


@query
def unmatched_patches(t: Tables) -> DataFrame:
    return idx.unmatched_patches(t.membership(), t.ordered_patches())


@query
def patch_counts(t: Tables) -> DataFrame:
    enriched = idx.enrich_intervals(t.intervals(), t.current(), t.changes())
    return idx.patch_counts(enriched, *t.patches())


@query
def members_on(t: Tables) -> DataFrame:
    return idx.members_on(t.membership(), ANCHOR)


@query
def active_on(t: Tables) -> DataFrame:
    return idx.active_on(t.days(), t.membership())


@query
def membership_window(t: Tables) -> DataFrame:
    return idx.membership_window(t.membership(), *WINDOW)


@query
def holdings(t: Tables) -> DataFrame:
    return equity_holdings(t.holdings()).select("Ticker", "Name")


def _constituents(t: Tables) -> tuple[DataFrame, DataFrame]:
    ours = idx.members_on(t.membership(), ANCHOR)
    theirs = equity_holdings(t.holdings()).select(undotted(F.col("Ticker")).alias("ticker"))
    return ours.select(undotted(F.col("ticker")).alias("ticker")), theirs


@query
def constituent_diff(t: Tables) -> DataFrame:
    return idx.constituent_difference(*_constituents(t))


@query
def constituent_tolerance(t: Tables) -> DataFrame:
    return idx.within_tolerance(idx.constituent_difference(*_constituents(t)))


# --- securities ---------------------------------------------------------------------------------


def members(t: Tables) -> DataFrame:
    return idx.active_on(t.days(), t.stored_membership())


@query
def listed_on(t: Tables) -> DataFrame:
    return securities.listed_on(members(t), t.metadata())


@query
def canonicalize(t: Tables) -> DataFrame:
    return securities.canonicalize(members(t), t.aliases())


@query
def historical_symbol(t: Tables) -> DataFrame:
    return securities.historical_symbol(members(t), t.aliases())


@query
def resolve_universe(t: Tables) -> DataFrame:
    return securities.resolve_universe(members(t), t.metadata(), t.aliases())


@query
def resolve_drops(t: Tables) -> DataFrame:
    resolved = securities.resolve_universe(members(t), t.metadata(), t.aliases())
    return securities.universe_summary(resolved)


@query
def alias_collisions(t: Tables) -> DataFrame:
    resolved = securities.resolve_universe(members(t), t.metadata(), t.aliases())
    return securities.alias_collisions(resolved)


@query
def alias_overlaps(t: Tables) -> DataFrame:
    return quality.overlapping_aliases(t.aliases())


@query
def sector_lookup(t: Tables) -> DataFrame:
    return securities.with_sector(members(t), t.metadata())


@query
def metadata_upsert(t: Tables) -> DataFrame:
    """Rename rows derived from existing ones, then whole-row overrides."""
    k = F.col("c_custkey")
    customers = t.read("customer")
    renames = customers.where(k % 7 == 3).select(
        F.concat(F.lit("U"), k).alias("source"),
        F.concat(F.lit("R"), k).alias("ticker"),
        F.lit(date(2026, 1, 14)).alias("delisted_date"),
        F.when(k % 2 == 0, F.lit("Renamed")).alias("name"),
    )
    overrides = customers.where(k % 5 == 2).select(
        F.concat(F.lit("U"), k).alias("ticker"),
        F.lit(date(2015, 7, 1)).alias("list_date"),
        F.lit(None).cast("date").alias("delisted_date"),
        F.lit("2650").alias("sic_code"),
    )
    return securities.ticker_metadata_snapshot(t.metadata(), overrides, renames)


@query
def project_details(t: Tables) -> DataFrame:
    """Detail records from customers and orders; former members get their removal day."""
    c, o = t.read("customer"), t.read("orders")
    seen = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last")
    )
    k = F.col("c_custkey")
    raw = c.join(seen, "c_custkey").select(
        F.concat(F.lit("U"), k).alias("ticker"),
        F.col("c_name").alias("name"),
        F.lit("XNYS").alias("primary_exchange"),
        F.lit("CS").alias("type"),
        F.when(k % 4 == 1, F.lit("")).otherwise(F.col("first").cast("string")).alias("list_date"),
        F.when(k % 4 == 0, F.concat(F.col("last").cast("string"), F.lit("T05:30:00Z"))).alias("delisted_utc"),
        F.lit("1000").alias("sic_code"),
        F.col("c_mktsegment").alias("sic_description"),
        F.when(k % 9 == 0, F.lit("x1")).otherwise(F.format_string(" %010d", k)).alias("cik"),
    )
    return feeds.project_details(raw, securities.fetch_universe(t.membership(), t.metadata()))


@query
def fetch_universe(t: Tables) -> DataFrame:
    found = securities.fetch_universe(t.membership(), t.metadata())
    return found.select("ticker", padded_id(F.col("cik")).alias("cik"), "ref_date")


@query
def first_entities(t: Tables) -> DataFrame:
    return reports.first_entities(securities.fetch_universe(t.membership(), t.metadata()), 25)


# --- fundamentals -----------------------------------------------------------------------------------


@query
def statement_projection(t: Tables) -> DataFrame:
    return feeds.project_statements(t.statement_feed(feeds.INCOME), feeds.INCOME_FIELDS, feeds.INCOME)


@query
def filing_cap(t: Tables) -> DataFrame:
    rows = feeds.project_statements(t.statement_feed(feeds.INCOME), feeds.INCOME_FIELDS, feeds.INCOME)
    kept = fund.within_filing_window(rows, t.filing_universe(), NOT_BEFORE)
    return kept.select("requested", "ticker", "filing_date", "fiscal_year", "fiscal_quarter")


def _snapshot(t: Tables) -> tuple[DataFrame, DataFrame]:
    raw = [t.statement_feed(tag) for tag in feeds.ENDPOINTS]
    return fundamentals_snapshot(*raw, t.filing_universe(), NOT_BEFORE)


@query
def statement_merge(t: Tables) -> DataFrame:
    out = _snapshot(t)[0]
    return out.withColumn("source_endpoints", F.concat_ws(",", "source_endpoints")).drop(
        "eps_basic", "eps_diluted", "weighted_avg_shares_basic", "weighted_avg_shares_diluted"
    )


@query
def coverage_failed(t: Tables) -> DataFrame:
    """Customers as a fetch universe: most have no statements at all."""
    k = F.col("c_custkey")
    universe = t.read("customer").select(
        F.concat(F.lit("S"), k).alias("ticker"), F.lit(None).cast("date").alias("ref_date")
    )
    return fundamentals_snapshot(*(t.statement_feed(tag) for tag in feeds.ENDPOINTS), universe, NOT_BEFORE)[1]


@query
def snapshot_facts(t: Tables) -> DataFrame:
    filings = t.filings()
    return filings.agg(
        F.count("*").alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
        F.min("filing_date").alias("first_filing"),
        F.max("filing_date").alias("last_filing"),
    )


@query
def fundamentals_manifest(t: Tables) -> DataFrame:
    """Facts of the filings, their fingerprint, and how much of the customers' universe they cover."""
    universe = t.read("customer").select(F.concat(F.lit("S"), "c_custkey").alias("ticker"))
    manifest = writers.fundamentals_manifest(t.stored_filings(), universe)
    return writers.with_provenance(manifest, "/snapshots/fundamentals", "c0ffee1")


@query
def membership_manifest(t: Tables) -> DataFrame:
    manifest = writers.membership_manifest(t.membership(), t.changes())
    return writers.with_provenance(manifest, "/snapshots/index_membership", "c0ffee1")


@query
def metadata_manifest(t: Tables) -> DataFrame:
    return writers.with_provenance(writers.metadata_manifest(t.metadata()), "/snapshots/ticker_metadata", "c0ffee1")


def scratch(t: Tables, label: str) -> str:
    """A new path for files that a query writes and reads back."""
    return f"{scratch_root(t.spark)}/{label}-{uuid.uuid4().hex}"


@query
def read_fundamentals(t: Tables) -> DataFrame:
    """The filings sink and its reader."""
    path = scratch(t, "fundamentals")
    writers.write_fundamentals(t.filings(), path)
    out = tables.read_fundamentals(t.spark, path)
    return out.withColumn("source_endpoints", F.concat_ws(",", "source_endpoints")).select(
        "ticker", "cik", "filing_date", "period_end_date", "fiscal_year", "fiscal_quarter", "period_kind", "revenues", "net_income", "source_endpoints"
    )


@query
def published_snapshots(t: Tables) -> DataFrame:
    """The three publish jobs: what their manifest holds and how many rows lie at the paths it names."""
    out = scratch(t, "published")
    changes = t.stored_changes()
    universe = t.read("customer").select(F.concat(F.lit("S"), "c_custkey").alias("ticker"))
    current = t.membership().where("date_removed is null or date_removed >= date_added")
    publish_membership(current, changes, out, 1, "c0ffee1")
    publish_fundamentals(t.filings(), out, 1, 1, "c0ffee1", universe)
    dated = t.metadata().where("delisted_date is null or list_date is null or delisted_date >= list_date")
    publish_ticker_metadata(dated, out, 1, 1, "c0ffee1")
    held = {
        "index_membership": tables.read_membership(t.spark, f"{out}/index_membership"),
        "fundamentals": tables.read_fundamentals(t.spark, f"{out}/fundamentals"),
        "ticker_metadata": tables.read_ticker_metadata(t.spark, f"{out}/ticker_metadata"),
    }
    counts: DataFrame | None = None
    for name, df in held.items():
        one = df.agg(F.lit(name).alias("snapshot"), F.count("*").alias("stored_rows"))
        counts = one if counts is None else counts.unionByName(one)
    manifest = t.spark.read.schema(
        "snapshot string, rows long, code_id string, artifact_path string, universe_size long, coverage_failed long, coverage_failed_sample string"
    ).json(f"{out}/snapshot_manifest")
    folder = F.element_at(F.split("artifact_path", "/"), -1).alias("folder")
    return manifest.join(counts, "snapshot").select("snapshot", "rows", "stored_rows", "code_id", folder, "universe_size", "coverage_failed", "coverage_failed_sample")


@query
def read_membership(t: Tables) -> DataFrame:
    """The membership sink and its reader."""
    path = scratch(t, "membership-csv")
    writers.write_membership(t.stored_membership(), path)
    return tables.read_membership(t.spark, path)


@query
def read_metadata(t: Tables) -> DataFrame:
    """The ticker-metadata sink and its reader."""
    path = scratch(t, "metadata")
    writers.write_ticker_metadata(t.metadata(), path)
    return tables.read_ticker_metadata(t.spark, path)


@query
def read_aliases(t: Tables) -> DataFrame:
    """Aliases as headed CSV files and their reader."""
    path = scratch(t, "aliases-csv")
    columns = columns_of(TICKER_ALIASES)
    t.aliases().select(*(F.col(c) for c in columns)).write.option("header", True).csv(path)
    return tables.read_ticker_aliases(t.spark, path).drop("note")


@query
def read_symbol_list(t: Tables) -> DataFrame:
    """The constituent sink, with its comment lines, and the symbol-list reader."""
    path = scratch(t, "constituents")
    writers.write_constituents(t.bars().select("ticker"), path, "suppliers with bars")
    return tables.read_symbol_list(t.spark, path)


@query
def bar_duplicates(t: Tables) -> DataFrame:
    """Bars of which every fiftieth supplier's were landed twice."""
    bars = t.bars()
    twice = bars.where(F.substring("ticker", 2, 20).cast("bigint") % 50 == 0)
    return quality.duplicate_keys(bars.unionByName(twice), ["date", "ticker"])


def answers(t: Tables, fields: tuple[str, ...] = ("net_income",)) -> DataFrame:
    asked = t.bars().select("ticker", "date")
    return fund.as_of_states(asked, fund.filing_states(t.stored_filings(), fields), fields, unique_requests=True)


@query
def fundamentals_as_of(t: Tables) -> DataFrame:
    """The newest visible report on every panel day."""
    wanted = ("cik", "filing_date", "period_end_date", "fiscal_year", "fiscal_quarter", "period_kind", "net_income")
    return answers(t).select("ticker", "date", *(F.col(f"latest.{c}").alias(c) for c in wanted))


@query
def ttm_as_of(t: Tables) -> DataFrame:
    fields = ("net_income", "revenues")
    return rounded(answers(t, fields), 4, "net_income_ttm", "revenues_ttm").select(
        "ticker", "date", "net_income_ttm", "net_income_status", "revenues_ttm", "revenues_status"
    )


@query
def ttm_status_counts(t: Tables) -> DataFrame:
    status = F.coalesce("net_income_status", F.lit("ok")).alias("status")
    return answers(t).groupBy(status).agg(F.count("*").alias("rows"))


@query
def ttm_by_entity_id(t: Tables) -> DataFrame:
    """Lookups that name the entity, in padded text form."""
    key = F.substring("ticker", 2, 15).cast("bigint") + 100000
    asked = t.bars().select("ticker", "date", normalize_id(padded_id(key)).alias("entity_id"))
    states = fund.filing_states(t.stored_filings(), by_id=True)
    out = fund.as_of_states(asked, states, unique_requests=True)
    return rounded(out, 4, "net_income_ttm").select(
        "ticker", "entity_id", "date", "net_income_ttm", "net_income_status", "latest_lag_days"
    )


@query
def latest_filing_lag(t: Tables) -> DataFrame:
    return answers(t).select("ticker", "date", "latest_lag_days")


@query
def oldest_component_lag(t: Tables) -> DataFrame:
    return answers(t).select("ticker", "date", "oldest_lag_days")


@query
def coverage_grid(t: Tables) -> DataFrame:
    return fund.coverage_grid(t.filings(), *COVERAGE)


# --- earnings yield -----------------------------------------------------------------------------------


def earnings(t: Tables) -> DataFrame:
    context = FactorContext(t.stored_filings())
    return REGISTRY["earnings_yield"].compute(panels.build_panel(t.bars(), RULES), context)


@query
def earnings_yield(t: Tables) -> DataFrame:
    return factor_view(earnings(t))


@query
def earnings_yield_reasons(t: Tables) -> DataFrame:
    return invalid_reason_counts(earnings(t))


@query
def filing_lag_stats(t: Tables) -> DataFrame:
    return lag_distribution(answers(t).select("latest_lag_days", "oldest_lag_days"))


# --- quality ----------------------------------------------------------------------------------------------


@query
def dq_summary(t: Tables) -> DataFrame:
    """Every table's rules, one pass per table."""
    checks = [
        ("daily_bars", t.bars(), quality.bar_rules()),
        ("universe_flags", panels.universe_flags(t.bars(), RULES), quality.universe_rules()),
        ("membership", t.membership(), quality.membership_rules()),
        ("metadata", t.metadata(), quality.metadata_rules()),
        ("aliases", t.aliases(), quality.alias_rules()),
        ("filings", t.filings(), quality.filing_rules()),
        ("candidates", t.ledger().candidates, quality.candidate_rules()),
        ("artifacts", t.ledger().artifacts, quality.artifact_rules()),
        ("experiments", t.ledger().experiments, quality.experiment_rules()),
        ("metrics", t.metrics(), quality.metric_rules()),
    ]
    out: DataFrame | None = None
    for name, df, rules in checks:
        one = quality.check(df, rules).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def dq_violations(t: Tables) -> DataFrame:
    bad = quality.violations(t.bars(), quality.bar_rules())
    return bad.select("date", "ticker", F.concat_ws(",", "broken_rules").alias("broken_rules"))


@query
def factor_rules(t: Tables) -> DataFrame:
    return quality.check(momentum(t), quality.factor_rules())


@query
def key_duplicates(t: Tables) -> DataFrame:
    """Trades per supplier and day: the key the panel forbids to repeat."""
    lines = t.read("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"))
    return quality.duplicate_keys(lines, ["l_suppkey", "date"])


@query
def fk_violations(t: Tables) -> DataFrame:
    """Artifacts and metrics whose candidate was marked lost, and candidates of unreachable code."""
    book = t.ledger()
    kept = book.candidates.where(F.col("status") != "lost")
    reachable = book.experiments.join(t.known_code(), "git_sha", "left_semi")
    found = [
        ("artifacts", "artifact_id", "candidate_id", quality.dangling(book.artifacts, kept, "candidate_id")),
        ("metrics", "metric_id", "candidate_id", quality.dangling(t.metrics(), kept, "candidate_id")),
        ("candidates", "candidate_id", "experiment_id", quality.dangling(book.candidates, reachable, "experiment_id")),
    ]
    out: DataFrame | None = None
    for name, own, parent, rows in found:
        one = rows.select(F.lit(name).alias("table_name"), F.col(own).alias("row_id"), F.col(parent).alias("parent_id"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def key_violations(t: Tables) -> DataFrame:
    """Ticker keys that occur twice in metadata of which every third customer's was landed twice."""
    again = t.metadata().where(F.col("cik") % 3 == 0)
    return quality.duplicate_keys(t.metadata().unionByName(again), ["ticker"])


@query
def snapshot_floors(t: Tables) -> DataFrame:
    return quality.snapshot_floors(t.metadata(), 500, 400, 50)


# --- ledger -----------------------------------------------------------------------------------------------


@query
def ledger_provenance(t: Tables) -> DataFrame:
    return books.provenance(t.ledger())


@query
def artifact_verify(t: Tables) -> DataFrame:
    return books.artifact_verification(t.ledger(), t.recomputed())


def _verdict(t: Tables, check_config: bool) -> DataFrame:
    import hashlib

    current = hashlib.sha256(CONFIG.encode()).hexdigest()
    return books.verify(t.ledger(), t.recomputed(), current, t.known_code(), check_config)


@query
def verify_verdict(t: Tables) -> DataFrame:
    return _verdict(t, True)


@query
def verify_without_config(t: Tables) -> DataFrame:
    return _verdict(t, False)


@query
def recent_ledger_rows(t: Tables) -> DataFrame:
    rows = reports.recent_rows(t.ledger().artifacts, "created_at", "artifact_id", 4)
    return rows.select("artifact_id", "candidate_id", "artifact_type", "path", "checksum")


# Registers its queries in QUERIES and uses the helpers above.
from strictpast.testbed import evaluation_queries  # noqa: E402, F401

__all__ = ["QUERIES"]
