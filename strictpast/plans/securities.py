"""Symbols over time: renames, listing intervals, and the date-anchored universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.contracts import TICKER_METADATA, columns_of, conform
from strictpast.functions import covers

# Reasons a member is left out of the universe.
METADATA_MISSING = "metadata_missing"
NOT_ACTIVE = "not_active_on_date"
ALIAS_OVERLAP = "alias_overlap"


def listed_on(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """(ticker, date) -> known, listed. Unknown tickers are not listed.

    Unlike index membership, a missing listing day counts as listed since ever.
    """
    asked = requests.select("ticker", "date").distinct()
    spans = metadata.select("ticker", "list_date", "delisted_date", F.lit(True).alias("_known"))
    inside = covers(F.col("list_date"), F.col("delisted_date"), F.col("date"), open_start=True)
    return (
        asked.join(spans, "ticker", "left")
        .groupBy("ticker", "date")
        .agg(
            F.coalesce(F.bool_or("_known"), F.lit(False)).alias("known"),
            F.coalesce(F.bool_or(F.col("_known") & inside), F.lit(False)).alias("listed"),
        )
    )


def _in_force(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``matches`` and ``alias``: the rename intervals of ``canonical`` in force on ``date``.

    ``asked`` has one row per (ticker, date). Intervals not in force never leave the join.
    """
    a = aliases.select(
        F.col("canonical_ticker").alias("_lineage"), "alias", "effective_from", "effective_to"
    )
    inside = covers(F.col("effective_from"), F.col("effective_to"), F.col("date"), open_start=True)
    return (
        asked.join(a, (F.col("canonical") == F.col("_lineage")) & inside, "left")
        .groupBy("ticker", "date", "canonical")
        .agg(F.count("_lineage").alias("matches"), F.min("alias").alias("alias"))
    )


def canonicalize(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ticker, date) -> (ticker, date, canonical, traded_as, matches).

    A symbol leads to its lineage, and the lineage to the symbol in force that day; with no
    interval in force that is the lineage's own symbol. More than one interval in force means
    a malformed alias table: ``traded_as`` is NULL and ``matches`` says how many.
    """
    lineage = aliases.groupBy(F.col("alias").alias("ticker")).agg(
        F.min("canonical_ticker").alias("canonical")
    )
    asked = requests.select("ticker", "date").distinct().join(lineage, "ticker", "left")
    asked = asked.withColumn("canonical", F.coalesce("canonical", "ticker"))
    traded = F.when(F.col("matches") == 0, F.col("canonical")).when(
        F.col("matches") == 1, F.col("alias")
    )
    return _in_force(asked, aliases).select(
        "ticker", "date", "canonical", traded.alias("traded_as"), "matches"
    )


def historical_symbol(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ticker, date) of canonical symbols -> (ticker, date, symbol).

    Days before a lineage's earliest known start have no symbol (NULL).
    """
    asked = requests.select("ticker", "date").distinct().withColumn("canonical", F.col("ticker"))
    births = aliases.groupBy(F.col("canonical_ticker").alias("ticker")).agg(
        F.min("effective_from").alias("_born")
    )
    unborn = F.col("_born").isNotNull() & (F.col("date") < F.col("_born"))
    symbol = F.when(F.col("matches") > 0, F.col("alias")).when(~unborn, F.col("canonical"))
    return (
        _in_force(asked, aliases)
        .join(births, "ticker", "left")
        .select("ticker", "date", symbol.alias("symbol"))
    )


def _tagged(reason: str, symbol: Column) -> Column:
    return F.concat_ws(":", F.lit(reason), symbol)


def resolve_universe(members: DataFrame, metadata: DataFrame, aliases: DataFrame) -> DataFrame:
    """Index members per day -> (date, source, resolved, status); a NULL status is tradable.

    Fail-closed: a symbol without metadata, or not listed that day, is dropped with a reason.
    """
    traded = canonicalize(members, aliases)
    spans = metadata.select(F.col("ticker").alias("traded_as"), "list_date", "delisted_date")
    spans = spans.withColumn("_known", F.lit(True))
    inside = covers(F.col("list_date"), F.col("delisted_date"), F.col("date"), open_start=True)
    checked = (
        traded.join(spans, "traded_as", "left")
        .groupBy("date", "ticker", "traded_as", "matches")
        .agg(
            F.coalesce(F.bool_or("_known"), F.lit(False)).alias("known"),
            F.coalesce(F.bool_or(F.col("_known") & inside), F.lit(False)).alias("listed"),
        )
    )
    status = (
        F.when(F.col("matches") > 1, _tagged(ALIAS_OVERLAP, F.col("ticker")))
        .when(~F.col("known"), _tagged(METADATA_MISSING, F.col("traded_as")))
        .when(~F.col("listed"), _tagged(NOT_ACTIVE, F.col("traded_as")))
    )
    return checked.select(
        "date", F.col("ticker").alias("source"), F.col("traded_as").alias("resolved"), status.alias("status")
    )


def alias_collisions(resolved: DataFrame) -> DataFrame:
    """Days on which several members resolve to one tradable symbol."""
    return (
        resolved.where(F.col("status").isNull())
        .groupBy("date", "resolved")
        .agg(
            F.count("*").alias("sources"),
            F.min("source").alias("first_source"),
            F.max("source").alias("last_source"),
        )
        .where(F.col("sources") > 1)
    )


def universe_summary(resolved: DataFrame) -> DataFrame:
    """Per day: members requested, tradable, and dropped."""
    return resolved.groupBy("date").agg(
        F.count("*").alias("requested_count"),
        F.count_if(F.col("status").isNull()).alias("tradable_count"),
        F.count_if(F.col("status").isNotNull()).alias("dropped_count"),
    )


def with_sector(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the industry description of each row's ticker (NULL if unknown)."""
    return df.join(metadata.select("ticker", "sic_description"), "ticker", "left")


def upsert(
    base: DataFrame, overrides: DataFrame, key: str = "ticker", insert_missing: bool = True
) -> DataFrame:
    """Replace the overridden columns of existing rows and, optionally, insert the others."""
    given = [c for c in overrides.columns if c != key]
    o = overrides.select(
        key, *(F.col(c).alias(f"_new_{c}") for c in given), F.lit(True).alias("_present")
    )
    joined = base.join(o, key, "full_outer" if insert_missing else "left")
    return joined.select(
        *(
            F.when(F.col("_present"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in given
            else F.col(c)
            for c in base.columns
        )
    )


def derived_rows(base: DataFrame, renames: DataFrame) -> DataFrame:
    """Metadata rows for another symbol of an existing one.

    ``renames``: ``source`` (existing ticker), ``ticker`` (the row to make) and any metadata
    columns to replace; NULL cells keep the source's value.
    """
    given = [c for c in renames.columns if c not in ("source", "ticker")]
    r = renames.select("source", F.col("ticker").alias("_made"), *(F.col(c).alias(f"_r_{c}") for c in given))
    joined = base.join(r, base["ticker"] == r["source"])
    return joined.select(
        *(
            F.col("_made").alias("ticker")
            if c == "ticker"
            else (F.coalesce(f"_r_{c}", c).alias(c) if c in given else F.col(c))
            for c in columns_of(TICKER_METADATA)
        )
    )


def fetch_universe(membership: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per ticker ever in the index: (ticker, cik, ref_date).

    ``ref_date`` is NULL for current members, else the last removal.
    """
    last = membership.groupBy("ticker").agg(
        F.when(F.bool_or(F.col("date_removed").isNull()), None)
        .otherwise(F.max("date_removed"))
        .alias("ref_date")
    )
    return last.join(metadata.select("ticker", "cik"), "ticker", "left").select(
        "ticker", "cik", "ref_date"
    )


def ticker_metadata_snapshot(
    details: DataFrame, overrides: DataFrame | None = None, renames: DataFrame | None = None
) -> DataFrame:
    """Projected details with derived rows and overrides applied, in contract order."""
    out = conform(details, TICKER_METADATA)
    if renames is not None:
        out = upsert(out, derived_rows(out, renames))
    if overrides is not None:
        out = upsert(out, overrides)
    return conform(out, TICKER_METADATA)
