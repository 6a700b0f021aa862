"""Filings: merging statement feeds, and as-of lookups over restated reports.

Everything a lookup can return changes only on days when something is filed. So filings are
turned once into a small table of dated facts per entity, and any number of (ticker, date)
requests is answered by one as-of sweep over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.contracts import FUNDAMENTALS, STATEMENT_VALUES, conform
from strictpast.functions import normalize_id
from strictpast.operators.asof import latest_before
from strictpast.sources.feeds import ENDPOINTS

# Why a trailing-four-quarter value is missing.
MISSING = "missing_fundamentals"
INSUFFICIENT = "insufficient_quarters"
MISSING_FIELD = "missing_field_value"
AMBIGUOUS = "ambiguous_cik"

QUARTERS = (0, 1, 2, 3)


# --- building the table ---------------------------------------------------------------


def within_filing_window(
    statements: DataFrame, universe: DataFrame, not_before: date, grace_days: int = 30
) -> DataFrame:
    """Filings since ``not_before``; for former members only up to the grace period's end."""
    limits = universe.select(F.col("ticker").alias("requested"), "ref_date")
    until = F.date_add("ref_date", grace_days)
    return (
        statements.join(limits, "requested")
        .where(F.col("filing_date") >= F.lit(not_before))
        .where(F.col("ref_date").isNull() | (F.col("filing_date") < until))
        .drop("ref_date")
    )


def merge_statements(*feeds: DataFrame) -> DataFrame:
    """One row per fiscal period from the three projected statement feeds.

    A column's value is the first non-null one in feed order; equal feeds are settled by the
    earlier filing. The filing date is the latest of all, and the feed tags are listed once
    each in feed order. Records are merged per requested entity; the period key is the
    entity id, or the ticker when there is none.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    feed_order = F.array_position(F.lit(list(ENDPOINTS)), F.col("endpoint")).cast("int")
    have = set(stacked.columns)
    values = [c for c in STATEMENT_VALUES if c in have]
    keyed = stacked.withColumns(
        {
            "_entity": F.when(
                F.coalesce("cik", F.lit(0)) != 0, F.concat(F.lit("id:"), F.col("cik").cast("string"))
            ).otherwise(F.concat(F.lit("t:"), F.col("ticker"))),
            "_feed": feed_order,
        }
    )

    def first_seen(name: str) -> Column:
        turn = F.struct(F.col("_feed"), F.col("filing_date"), F.col(name))
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), turn)).alias(name)

    tags = F.array_compact(
        F.array(*(F.when(F.bool_or(F.col("endpoint") == t), F.lit(t)) for t in ENDPOINTS))
    )
    period = ["requested", "_entity", "fiscal_year", "fiscal_quarter", "period_kind", "period_end_date"]
    merged = keyed.groupBy(*period).agg(
        first_seen("ticker"),
        first_seen("cik"),
        F.max("filing_date").alias("filing_date"),
        *(first_seen(c) for c in values),
        tags.alias("source_endpoints"),
    )
    return conform(merged, FUNDAMENTALS)


def complete_filings(merged: DataFrame) -> DataFrame:
    """Rows that have the four key columns of a filing."""
    return merged.dropna(subset=["ticker", "filing_date", "period_end_date", "period_kind"])


def without_filings(universe: DataFrame, *feeds: DataFrame) -> DataFrame:
    """Entities of the fetch universe for which no feed has a usable record."""
    covered = reduce(lambda a, b: a.union(b), (f.select("requested") for f in feeds)).distinct()
    return universe.select("ticker").join(
        covered.withColumnRenamed("requested", "ticker"), "ticker", "left_anti"
    )


# --- dated facts ----------------------------------------------------------------------


def _entity_columns(filings: DataFrame, by_id: bool) -> tuple[DataFrame, list[str]]:
    kind = filings.schema["cik"].dataType.simpleString()
    tagged = filings.withColumn("entity_id", normalize_id(F.col("cik"), kind))
    if by_id:
        return tagged.where(F.col("entity_id").isNotNull()), ["ticker", "entity_id"]
    return tagged, ["ticker"]


def _tie_order() -> Column:
    """Total order among filings of one day; the greatest is the latest."""
    return F.struct(
        F.col("period_end_date"),
        F.col("fiscal_year"),
        F.coalesce("fiscal_quarter", F.lit(0)).alias("quarter"),
        F.col("period_kind"),
        F.col("cik"),
        *STATEMENT_VALUES,
    )


def _daily_facts(filings: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity and filing day: newest report, any quarterly, and whether ids conflict by then.

    One aggregate over the filings. Several ids are visible exactly when the least and the
    greatest id seen so far differ; the running pair is swept over days, not over filings.
    """
    row = F.struct(*(c for c in FUNDAMENTALS.fieldNames() if c not in ("ticker", "source_endpoints")))
    dated = F.when(F.col("filing_date").isNotNull(), F.col("entity_id"))
    facts = filings.groupBy(*keys, F.col("filing_date").alias("since")).agg(
        F.max_by(row, _tie_order()).alias("latest"),
        F.max(F.when(F.col("period_kind") == "quarterly", F.lit(True))).alias("quarterly"),
        F.min(dated).alias("_least"),
        F.max(dated).alias("_most"),
    )
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("since")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    conflict = F.min("_least").over(so_far) != F.max("_most").over(so_far)
    return facts.withColumn("ambiguous", F.when(conflict, F.lit(True))).drop("_least", "_most")


def _quarterly_events(filings: DataFrame, keys: list[str], fields: Sequence[str]) -> DataFrame:
    """Trailing-four-quarter facts: (keys, since, ttm struct).

    The window in force is the one ending at the greatest fiscal quarter seen so far, so a
    filing for quarter ``o`` can only matter to the windows ending at ``o .. o+3``. Each
    filing is placed into those four windows and each window is swept once in filing order.
    Work is linear in filings: filings of one entity are never paired with one another.
    """
    valid = filings.where(
        (F.col("period_kind") == "quarterly")
        & F.col("fiscal_year").isNotNull()
        & F.col("fiscal_quarter").isin(1, 2, 3, 4)
    ).withColumn("ordinal", F.col("fiscal_year") * 4 + F.col("fiscal_quarter"))
    versions = valid.groupBy(*keys, "ordinal", "filing_date").agg(
        F.max_by(F.struct(*fields), _tie_order()).alias("v")
    )
    # When each quarter became the newest, and when a newer one replaced it.
    newer = (
        Window.partitionBy(*keys)
        .orderBy(F.col("ordinal").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    leads = (
        versions.groupBy(*keys, "ordinal")
        .agg(F.min("filing_date").alias("lead_from"))
        .withColumn("lead_to", F.min("lead_from").over(newer))
        .where(F.col("lead_to").isNull() | (F.col("lead_from") < F.col("lead_to")))
        .withColumnRenamed("ordinal", "lead")
    )
    placed = (
        versions.withColumn("slot", F.explode(F.array(*(F.lit(s) for s in QUARTERS))))
        .withColumn("lead", F.col("ordinal") + F.col("slot"))
        .join(leads, [*keys, "lead"])
        .where(F.col("lead_to").isNull() | (F.col("filing_date") < F.col("lead_to")))
    )

    def in_slot(s: int) -> Column:
        mine = F.col("slot") == s
        filed = F.struct(F.col("filing_date").alias("filed"), F.col("v"))
        return F.max_by(F.when(mine, filed), F.when(mine, F.col("filing_date"))).alias(f"q{s}")

    window = [*keys, "lead"]
    sweep = (
        Window.partitionBy(*window)
        .orderBy("since")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = (
        placed.groupBy(*window, F.greatest("filing_date", "lead_from").alias("since"))
        .agg(*(in_slot(s) for s in QUARTERS))
        .withColumns({f"q{s}": F.last(f"q{s}", ignorenulls=True).over(sweep) for s in QUARTERS})
    )
    complete = reduce(Column.__and__, (F.col(f"q{s}").isNotNull() for s in QUARTERS))
    sums = [
        reduce(Column.__add__, (F.col(f"q{s}.v.{f}") for s in reversed(QUARTERS))).alias(f)
        for f in fields
    ]
    ttm = F.struct(
        complete.alias("complete"),
        F.when(complete, F.least(*(F.col(f"q{s}.filed") for s in QUARTERS))).alias("oldest"),
        *sums,
    )
    return filled.select(*keys, "since", ttm.alias("ttm"))


def filing_states(
    filings: DataFrame, fields: Sequence[str] = ("net_income",), by_id: bool = False
) -> DataFrame:
    """Dated facts per entity: (keys, since, latest, quarterly, ambiguous, ttm).

    A fact dated ``since`` is visible to requests strictly after that day. ``by_id`` keys the
    facts by (ticker, entity_id) for lookups that name the entity.
    """
    tagged, keys = _entity_columns(filings, by_id)
    dated = tagged.where(F.col("filing_date").isNotNull())
    return _daily_facts(dated, keys).unionByName(
        _quarterly_events(dated, keys, fields), allowMissingColumns=True
    )


def as_of_states(
    requests: DataFrame,
    states: DataFrame,
    fields: Sequence[str] = ("net_income",),
    unique_requests: bool = False,
) -> DataFrame:
    """Answer (ticker[, entity_id], date) requests.

    Per field: ``<field>_ttm`` and ``<field>_status`` (NULL status is a value). Also
    ``latest`` (the newest visible report as a struct), ``latest_lag_days`` and
    ``oldest_lag_days``. ``unique_requests``: at most one request per key and day.
    """
    keys = ["ticker", "entity_id"] if "entity_id" in states.columns else ["ticker"]
    payload = ["ttm", "quarterly", "latest", "ambiguous"]
    found = latest_before(requests, states, keys, "date", "since", payload, unique_requests)
    clear = F.col("ambiguous").isNull()
    usable = clear & F.coalesce(F.col("ttm.complete"), F.lit(False))
    base_status = (
        F.when(~clear, AMBIGUOUS)
        .when(F.col("quarterly").isNull(), MISSING)
        .when(~usable, INSUFFICIENT)
    )
    answers: dict[str, Column] = {}
    for f in fields:
        answers[f"{f}_status"] = F.coalesce(
            base_status, F.when(F.col(f"ttm.{f}").isNull(), F.lit(MISSING_FIELD))
        )
        answers[f"{f}_ttm"] = F.when(usable, F.col(f"ttm.{f}"))
    answers["latest_lag_days"] = F.when(clear, F.date_diff("date", F.col("latest.filing_date")))
    answers["oldest_lag_days"] = F.when(usable, F.date_diff("date", F.col("ttm.oldest")))
    answers["latest"] = F.when(clear, F.col("latest"))
    return found.withColumns(answers).drop("ttm", "quarterly", "ambiguous")


def coverage_grid(filings: DataFrame, start: date, end: date) -> DataFrame:
    """(date, ticker, has_pit_fundamentals) for every calendar day and filing ticker.

    A ticker is covered from the day after its first filing until a second entity id makes
    it ambiguous: two days per ticker decide the whole row of the grid.
    """
    if start > end:
        raise ValueError(f"coverage window {start} to {end} is empty")
    tagged, keys = _entity_columns(filings, by_id=False)
    spans = _daily_facts(tagged, keys).groupBy("ticker").agg(
        F.min("since").alias("first_filed"),
        F.min(F.when(F.col("ambiguous"), F.col("since"))).alias("clouded"),
    )
    visible = F.col("first_filed") < F.col("date")
    clear = F.col("clouded").isNull() | (F.col("date") <= F.col("clouded"))
    days = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    return spans.select("ticker", "first_filed", "clouded", days).select(
        "date", "ticker", F.coalesce(visible & clear, F.lit(False)).alias("has_pit_fundamentals")
    )
