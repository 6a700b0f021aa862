"""Sector proxies from industry codes by the longest matching prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictpast.contracts import require_columns

# Code prefixes (first, last) and their proxy sector.
PROXY_RANGES = (
    ("13", "13", "Energy"),
    ("10", "14", "Materials"),
    ("24", "32", "Materials"),
    ("15", "17", "Industrials"),
    ("33", "39", "Industrials"),
    ("40", "47", "Industrials"),
    ("50", "59", "Consumer Discretionary"),
    ("20", "21", "Consumer Staples"),
    ("54", "54", "Consumer Staples"),
    ("28", "28", "Health Care"),
    ("80", "80", "Health Care"),
    ("60", "67", "Financials"),
    ("35", "36", "Information Technology"),
    ("73", "73", "Information Technology"),
    ("48", "48", "Communication Services"),
    ("78", "79", "Communication Services"),
    ("49", "49", "Utilities"),
)
UNKNOWN = "Unknown"
SECTORS = tuple(sorted({name for *_, name in PROXY_RANGES})) + (UNKNOWN,)


def prefix_table(spark: SparkSession, ranges: Sequence[tuple[str, str, str]] = PROXY_RANGES) -> DataFrame:
    """``(prefix, sector)``: every prefix of every range, the narrowest range of each, earlier ones first."""
    rows = [(a, b, name, place) for place, (a, b, name) in enumerate(ranges)]
    table = spark.createDataFrame(rows, "first string, last string, sector string, place int")
    span = F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))
    each = table.select("sector", "place", F.size(span).alias("width"), F.length("first").alias("n"), F.explode(span).alias("code"))
    each = each.withColumn("prefix", F.lpad(F.col("code").cast("string"), F.col("n"), F.lit("0")))
    return each.groupBy("prefix").agg(F.min_by("sector", F.struct("width", "place")).alias("sector"))


def sector_proxy(
    df: DataFrame, code: str = "sic_code", out: str = "sector_proxy", ranges: Sequence[tuple[str, str, str]] = PROXY_RANGES
) -> DataFrame:
    """``df`` plus ``out``: the sector of the longest prefix of ``code`` that a range has, else ``Unknown``.

    Distinct codes are cut into their prefixes, which meet the table by equality; the longest match wins, and of
    overlapping ranges of one length the narrowest, then the first. Codes are trimmed; a null one is unknown.
    """
    require_columns(df, [code], "sector proxy")
    longest = max(len(a) for a, *_ in ranges)
    plain = F.trim(F.col(code).cast("string"))
    codes = df.select(F.col(code).alias("_code"), plain.alias("_plain")).where("_plain <> ''").distinct()
    lengths = F.sequence(F.lit(1), F.least(F.length("_plain"), F.lit(longest)))
    cut = codes.select("_code", F.explode(F.transform(lengths, lambda n: F.substring("_plain", F.lit(1), n))).alias("prefix"))
    matched = cut.join(prefix_table(df.sparkSession, ranges), "prefix")
    best = matched.groupBy("_code").agg(F.max_by("sector", F.length("prefix")).alias("_sector"))
    met = df.join(best, F.col(code) == F.col("_code"), "left")
    return met.select(*df.columns, F.coalesce("_sector", F.lit(UNKNOWN)).alias(out))
