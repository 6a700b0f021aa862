"""Append-only provenance tables and the query that verifies them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.contracts import ARTIFACTS, CANDIDATES, EXPERIMENTS, METRICS, RUN_MARKS, conform
from strictpast.operators import quality
from strictpast.session import stage

TABLES: dict[str, T.StructType] = {
    "experiments": EXPERIMENTS,
    "candidates": CANDIDATES,
    "artifacts": ARTIFACTS,
    "metrics": METRICS,
    "begun": RUN_MARKS,
    "commits": RUN_MARKS,
}
PARENTS = {
    "candidates": ("experiments", "experiment_id"),
    "artifacts": ("candidates", "candidate_id"),
    "metrics": ("candidates", "candidate_id"),
}
_RULES = {
    "experiments": quality.experiment_rules,
    "candidates": quality.candidate_rules,
    "artifacts": quality.artifact_rules,
    "metrics": quality.metric_rules,
}

# How an artifact can fail verification.
FILE_MISSING = "file_missing"
CHECKSUM_MISMATCH = "checksum_mismatch"
NO_ARTIFACTS = "no_artifacts_recorded"
VERIFIED = "verified"
LEDGER_PATH = "<ledger>"
SKIPPED = "<skipped>"


@dataclass(frozen=True)
class Ledger:
    """The ledger's tables as frames."""

    experiments: DataFrame
    candidates: DataFrame
    artifacts: DataFrame


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A ledger table; empty before its first append."""
    schema = TABLES[table]
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def open_ledger(spark: SparkSession, root: str) -> Ledger:
    """The ledger without runs that were begun and not committed, so no half run is ever seen."""
    experiments, candidates, artifacts = (read_table(spark, root, t) for t in ("experiments", "candidates", "artifacts"))
    half = read_table(spark, root, "begun").join(read_table(spark, root, "commits"), "experiment_id", "left_anti")
    hidden = candidates.join(half, "experiment_id", "left_semi").select("candidate_id")
    return Ledger(
        experiments.join(half, "experiment_id", "left_anti"),
        candidates.join(half, "experiment_id", "left_anti").select(*candidates.columns),
        artifacts.join(hidden, "candidate_id", "left_anti").select(*artifacts.columns),
    )


def _mark(spark: SparkSession, root: str, table: str, experiment_id: str) -> None:
    row = spark.range(1).select(F.lit(experiment_id).alias("experiment_id"), F.current_timestamp().alias("created_at"))
    conform(row, RUN_MARKS).coalesce(1).write.mode("append").parquet(f"{root}/{table}")


def begin_run(spark: SparkSession, root: str, experiment_id: str) -> None:
    """Announce a run: what is appended under its experiment stays hidden until it is committed."""
    _mark(spark, root, "begun", experiment_id)


def commit_run(spark: SparkSession, root: str, experiment_id: str) -> None:
    """Make all rows of an announced run visible at once; the last write of a run."""
    _mark(spark, root, "commits", experiment_id)


def append_ledger(spark: SparkSession, root: str, table: str, rows: DataFrame) -> None:
    """Insert rows that meet the table's rules and whose parents exist. Nothing is ever updated."""
    shaped = stage(conform(rows, TABLES[table]), f"new-{table}")
    quality.enforce(shaped, _RULES[table](), table)
    if table in PARENTS:
        parent, key = PARENTS[table]
        orphans = quality.dangling(shaped, read_table(spark, root, parent), key).select(key)
        quality.enforce_empty(orphans, f"{table} rows without a row in {parent}")
    shaped.write.mode("append").parquet(f"{root}/{table}")


def provenance(ledger: Ledger) -> DataFrame:
    """One row per recorded artifact with its candidate's and experiment's facts.

    Candidates without artifacts keep one row with NULL artifact columns.
    """
    e = ledger.experiments.select("experiment_id", "config_hash", "git_sha")
    c = ledger.candidates.select(
        "candidate_id", "experiment_id", "candidate_name", "formula_string", "data_snapshot_id"
    )
    a = ledger.artifacts.select("candidate_id", "artifact_id", "artifact_type", "path", "checksum")
    return c.join(e, "experiment_id").join(a, "candidate_id", "left").select(
        "candidate_id",
        "candidate_name",
        "formula_string",
        "data_snapshot_id",
        "config_hash",
        "git_sha",
        "artifact_id",
        "artifact_type",
        "path",
        "checksum",
    )


def candidate_provenance(ledger: Ledger, candidate_id: str) -> DataFrame:
    """:func:`provenance` of one candidate; an unknown id raises."""
    rows = provenance(ledger).where(F.col("candidate_id") == candidate_id)
    if rows.isEmpty():
        raise LookupError(f"candidate {candidate_id} is not in the ledger")
    return rows


def artifact_verification(ledger: Ledger, recomputed: DataFrame) -> DataFrame:
    """(candidate_id, path, outcome) for every recorded artifact.

    ``recomputed``: (path, checksum) of what is on storage now.
    """
    now = recomputed.select("path", F.col("checksum").alias("_now"))
    recorded = provenance(ledger).select("candidate_id", "artifact_id", "path", "checksum")
    outcome = (
        F.when(F.col("artifact_id").isNull(), NO_ARTIFACTS)
        .when(F.col("_now").isNull(), FILE_MISSING)
        .when(F.col("_now") != F.col("checksum"), CHECKSUM_MISMATCH)
        .otherwise(VERIFIED)
    )
    return recorded.join(now, "path", "left").select(
        "candidate_id", F.coalesce("path", F.lit(LEDGER_PATH)).alias("path"), outcome.alias("outcome")
    )


def verify(
    ledger: Ledger,
    recomputed: DataFrame,
    config_hash: str | None,
    known_code_ids: DataFrame,
    check_config: bool = True,
) -> DataFrame:
    """One verdict per candidate; reads only.

    ``known_code_ids``: (git_sha) of code versions that can still be reached.
    """
    outcomes = artifact_verification(ledger, recomputed)
    failures = (FILE_MISSING, CHECKSUM_MISMATCH, NO_ARTIFACTS)
    counted = outcomes.groupBy("candidate_id").agg(
        F.count_if(F.col("outcome") == VERIFIED).alias("artifacts_verified"),
        *(F.count_if(F.col("outcome") == f).alias(f) for f in failures),
    )
    e = ledger.experiments.select("experiment_id", "config_hash", "git_sha")
    known = known_code_ids.select("git_sha").distinct().withColumn("_known", F.lit(True))
    current = F.lit(config_hash) if check_config else F.lit(SKIPPED)
    match = F.coalesce(current == F.col("config_hash_recorded"), F.lit(False)) & F.lit(check_config)
    joined = (
        ledger.candidates.select("candidate_id", "experiment_id")
        .join(e, "experiment_id")
        .join(counted, "candidate_id")
        .join(known, "git_sha", "left")
        .withColumnsRenamed({"config_hash": "config_hash_recorded", "git_sha": "git_sha_recorded"})
    )
    failed = F.col(FILE_MISSING) + F.col(CHECKSUM_MISMATCH) + F.col(NO_ARTIFACTS)
    verdict = (
        (F.col("artifacts_failed") == 0)
        & (F.col("artifacts_verified") > 0)
        & (F.col("config_hash_match") | F.lit(not check_config))
        & F.col("git_sha_available")
    )
    return (
        joined.withColumns(
            {
                "artifacts_failed": failed,
                "config_hash_current": current,
                "config_hash_checked": F.lit(check_config),
                "config_hash_match": match,
                "git_sha_available": F.coalesce("_known", F.lit(False)),
            }
        )
        .withColumn("all_ok", verdict)
        .select(
            "candidate_id",
            "artifacts_verified",
            "artifacts_failed",
            *failures,
            "config_hash_recorded",
            "config_hash_current",
            "config_hash_checked",
            "config_hash_match",
            "git_sha_recorded",
            "git_sha_available",
            "all_ok",
        )
    )
