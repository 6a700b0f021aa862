"""Writers: slices, factors with embedded diagnostics, snapshots with a manifest row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictpast.contracts import (
    FACTOR,
    FUNDAMENTALS,
    INDEX_MEMBERSHIP,
    PANEL,
    TICKER_METADATA,
    require_exact,
)
from strictpast.operators.fingerprint import fingerprint

DIAGNOSTICS_KEY = "factor_diagnostics"
#: Rows of one part file, so that it stays far below what a checksum can read at once.
PART_ROWS = 5_000_000
# The column whose metadata carries the diagnostics through the Parquet footer.
DIAGNOSTICS_COLUMN = "raw_value"


def write_slice(panel: DataFrame, path: str, by_year: bool = False) -> None:
    """One directory per slice; an existing slice is never overwritten."""
    require_exact(panel, PANEL, "panel slice")
    if by_year:
        # Ranges keep a task within a year or two and spread each year over many tasks.
        year = panel.withColumn("year", F.year("date")).repartitionByRange("year", "ticker")
        year.write.mode("errorifexists").option("maxRecordsPerFile", PART_ROWS).partitionBy("year").parquet(path)
    else:
        panel.write.mode("errorifexists").option("maxRecordsPerFile", PART_ROWS).parquet(path)


def write_factor(factor: DataFrame, path: str, diagnostics: dict | None = None) -> None:
    """Factor Parquet (snappy); diagnostics travel in the table's own schema."""
    require_exact(factor, FACTOR, "factor")
    if diagnostics is not None:
        note = {DIAGNOSTICS_KEY: json.dumps(diagnostics, sort_keys=True)}
        factor = factor.withMetadata(DIAGNOSTICS_COLUMN, note)
    writer = factor.write.mode("errorifexists").option("compression", "snappy").option("maxRecordsPerFile", PART_ROWS)
    writer.parquet(path)


def read_diagnostics(spark: SparkSession, path: str) -> dict:
    """Diagnostics of a written factor, from the footer alone; ``{}`` when there are none."""
    fields = {f.name: f for f in spark.read.parquet(path).schema.fields}
    carrier = fields.get(DIAGNOSTICS_COLUMN)
    note = carrier.metadata.get(DIAGNOSTICS_KEY) if carrier else None
    return json.loads(note) if note else {}


def _manifest(df: DataFrame, name: str, facts: list) -> DataFrame:
    stats = df.agg(F.lit(name).alias("snapshot"), F.count("*").alias("rows"), *facts)
    return stats.withColumn("content_sha", fingerprint(df, df.columns).scalar())


#: Uncovered entities that a manifest names; the count is of all.
SAMPLE = 10


def fundamentals_manifest(df: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row of facts; with ``universe`` (ticker) also its size and who of it has no filing."""
    manifest = _manifest(
        df,
        "fundamentals",
        [
            F.count_distinct("ticker").alias("tickers"),
            F.min("filing_date").alias("first_filing"),
            F.max("filing_date").alias("last_filing"),
        ],
    )
    if universe is None:
        return manifest
    asked = universe.select("ticker").distinct()
    bare = asked.join(df.select("ticker").distinct(), "ticker", "left_anti")
    few = bare.orderBy("ticker").limit(SAMPLE).agg(F.array_join(F.sort_array(F.collect_list("ticker")), ","))
    return manifest.withColumns({
        "universe_size": asked.agg(F.count("*")).scalar(),
        "coverage_failed": bare.agg(F.count("*")).scalar(),
        "coverage_failed_sample": few.scalar(),
    })


def membership_manifest(df: DataFrame, changes: DataFrame) -> DataFrame:
    facts = [
        F.count_if(F.col("date_removed").isNull()).alias("current_members"),
        F.count_if(F.col("date_removed").isNotNull()).alias("historical_removals"),
    ]
    first = changes.agg(F.min("date")).scalar()
    return _manifest(df, "index_membership", facts).withColumn("earliest_change", first)


def metadata_manifest(df: DataFrame) -> DataFrame:
    return _manifest(
        df,
        "ticker_metadata",
        [
            F.count_if(F.col("delisted_date").isNull()).alias("current"),
            F.count_if(F.col("delisted_date").isNotNull()).alias("delisted"),
        ],
    )


def with_provenance(manifest: DataFrame, artifact: str | None, code_id: str | None) -> DataFrame:
    """A manifest row plus where its data lie and which code made them."""
    return manifest.withColumns({"artifact_path": F.lit(artifact), "code_id": F.lit(code_id)})


def append_manifest(manifest: DataFrame, path: str, artifact: str | None = None, code_id: str | None = None) -> None:
    """Add one snapshot's provenance row, with the time, the data's path and the code that made it."""
    row = with_provenance(manifest, artifact, code_id).withColumn("written_at", F.current_timestamp())
    row.write.mode("append").json(path)


def write_fundamentals(df: DataFrame, path: str) -> None:
    """Filings clustered by ticker and ordered by filing day inside each file."""
    require_exact(df, FUNDAMENTALS, "fundamentals")
    # Ranges over both columns let one ticker's filings spread over several files.
    clustered = df.repartitionByRange("ticker", "filing_date")
    clustered.sortWithinPartitions("ticker", "filing_date").write.mode("errorifexists").parquet(path)


def write_membership(df: DataFrame, path: str) -> None:
    """Membership CSV ordered by start day and ticker."""
    require_exact(df, INDEX_MEMBERSHIP, "index membership")
    df.orderBy("date_added", "ticker").write.mode("errorifexists").option("header", True).csv(path)


def write_ticker_metadata(df: DataFrame, path: str) -> None:
    require_exact(df, TICKER_METADATA, "ticker metadata")
    df.orderBy("ticker").write.mode("errorifexists").parquet(path)


def write_constituents(tickers: DataFrame, path: str, note: str) -> None:
    """Distinct symbols in order, one per line, under ``#`` header lines.

    The header sorts before every symbol, so the ordered write puts it first.
    """
    symbols = tickers.select("ticker").distinct()
    count = symbols.agg(F.concat(F.lit("# count: "), F.count("*").cast("string")).alias("value"))
    head = count.select(F.lit(f"# {note}").alias("value")).unionByName(count)
    lines = head.withColumn("_part", F.lit(0)).unionByName(
        symbols.select(F.col("ticker").alias("value"), F.lit(1).alias("_part"))
    )
    lines.orderBy("_part", "value").select("value").write.mode("errorifexists").text(path)
