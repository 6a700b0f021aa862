"""Who was in the index on a day: event logs -> intervals -> point-in-time membership."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.contracts import INDEX_MEMBERSHIP, columns_of, conform, table
from strictpast.functions import covers, is_weekday

_ADD, _REMOVE = 0, 1


def membership_events(changes: DataFrame) -> DataFrame:
    """Change log -> (ticker, day, kind, times), equal events counted before any shuffle by ticker.

    After counting, a ticker has at most two rows per calendar day however many log lines
    it has, so the ordered walk below is bounded by the calendar.
    """
    sides = F.array(
        F.struct(F.col("added_ticker").alias("ticker"), F.lit(_ADD).alias("kind")),
        F.struct(F.col("removed_ticker").alias("ticker"), F.lit(_REMOVE).alias("kind")),
    )
    events = changes.select(F.col("date").alias("day"), F.inline(sides))
    # Text rendering of a missing cell is no ticker.
    named = (F.col("ticker") != "") & (F.col("ticker") != "nan")
    return events.where(named).groupBy("ticker", "day", "kind").agg(F.count("*").alias("times"))


def membership_intervals(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, phantoms) from the current table and the change log.

    A removal closes the add right before it, or opens at the log's first day when there is
    none. An add right after an add closes the earlier one. Current members get one open
    interval from the current table. A trailing add of a ticker that is not current is a
    phantom (usually an unlogged rename): reported, not kept.
    """
    events = membership_events(changes)
    walk = Window.partitionBy("ticker").orderBy("day", "kind")
    first_day = changes.agg(F.min("date").alias("d")).scalar()
    seen = events.withColumns(
        {
            "prev_day": F.lag("day").over(walk),
            "prev_kind": F.lag("kind").over(walk),
            "next_day": F.lead("day").over(walk),
            "sentinel": first_day,
        }
    )
    follows_add = F.col("prev_kind") == _ADD
    # The first copy of an event looks back at the previous event; any further copy looks
    # back at its twin: another add closes at once, another removal has nothing open.
    first_start = F.when(follows_add, F.col("prev_day")).when(
        F.col("kind") == _REMOVE, F.col("sentinel")
    )
    twin_start = F.when(F.col("kind") == _ADD, F.col("day")).otherwise(F.col("sentinel"))
    starts = F.concat(
        F.when(first_start.isNotNull(), F.array(first_start)).otherwise(F.array().cast("array<date>")),
        F.array_repeat(twin_start, (F.col("times") - 1).cast("int")),
    )
    closed = seen.select(
        "ticker", F.explode(starts).alias("date_added"), F.col("day").alias("date_removed")
    )
    still_in = current.select("ticker", "date_added", F.lit(None).cast("date").alias("date_removed"))
    phantoms = (
        seen.where(F.col("next_day").isNull() & (F.col("kind") == _ADD))
        .join(current.select("ticker"), "ticker", "left_anti")
        .select("ticker", F.col("day").alias("dangling_since"))
    )
    return closed.unionByName(still_in), phantoms


def enrich_intervals(intervals: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """Attach name, sectors and id; names of former members come from the change log.

    The first name seen in the log wins. Log order is the optional ``seq`` column, else the
    day; then the added side before the removed side, then the smaller name.
    """
    position = "seq" if "seq" in changes.columns else "date"
    sides = F.array(
        F.struct(
            F.col("added_ticker").alias("ticker"),
            F.col("added_name").alias("seen_name"),
            F.lit(_ADD).alias("side"),
        ),
        F.struct(
            F.col("removed_ticker").alias("ticker"),
            F.col("removed_name").alias("seen_name"),
            F.lit(_REMOVE).alias("side"),
        ),
    )
    usable = (F.col("ticker") != "") & (F.col("ticker") != "nan") & (F.col("seen_name") != "")
    fallback = (
        changes.select(F.col(position).alias("position"), F.inline(sides))
        .where(usable)
        .groupBy("ticker")
        .agg(F.min(F.struct("position", "side", "seen_name")).alias("first"))
        .select("ticker", F.col("first.seen_name").alias("seen_name"))
    )
    known = current.select("ticker", "name", "wiki_sector", "wiki_sub_industry", "cik_code")
    joined = intervals.join(known, "ticker", "left").join(fallback, "ticker", "left")
    return conform(
        joined.withColumn("name", F.coalesce("name", "seen_name")).drop("seen_name"),
        INDEX_MEMBERSHIP,
    )


def apply_patches(
    df: DataFrame, updates: DataFrame | None, adds: DataFrame | None, deletes: DataFrame | None
) -> DataFrame:
    """Curated corrections: updates first, then added rows, then deletions.

    ``updates``: (ticker, date_added, date_removed), a non-null cell replaces that field on
    all rows of the ticker; each field of a ticker is updated at most once. ``adds``: whole rows. ``deletes``: (ticker, date_added,
    date_removed), a non-null cell must equal the row's.
    """
    out = df
    if updates is not None:
        new = updates.groupBy("ticker").agg(
            F.max("date_added").alias("_added"), F.max("date_removed").alias("_removed")
        )
        out = (
            out.join(new, "ticker", "left")
            .withColumn("date_added", F.coalesce("_added", "date_added"))
            .withColumn("date_removed", F.coalesce("_removed", "date_removed"))
        )
    out = conform(out, INDEX_MEMBERSHIP)
    if adds is not None:
        out = out.unionByName(conform(adds, INDEX_MEMBERSHIP))
    if deletes is not None:
        row, rule = out.alias("row"), deletes.alias("rule")
        same = F.col("row.ticker") == F.col("rule.ticker")
        for name in ("date_added", "date_removed"):
            asked = F.col(f"rule.{name}")
            same &= asked.isNull() | F.coalesce(F.col(f"row.{name}") == asked, F.lit(False))
        out = row.join(rule, same, "left_anti")
    return out.select(*columns_of(INDEX_MEMBERSHIP))


#: Ordered patches: what to do, to which rows of a ticker, and the new value of a field as text.
PATCHES = table("position int, op string, ticker string, date_added date, date_removed date, field string, value string")
UPDATE, ADD, DELETE = "update", "add", "delete"


def _folded(df: DataFrame, patches: DataFrame) -> DataFrame:
    """``(ticker, rows, hit, asked)``: a patched ticker's rows after its patches, in order of position."""
    fields = INDEX_MEMBERSHIP.fields
    whole = F.struct(*(F.col(f.name) for f in fields))
    rows = conform(df, INDEX_MEMBERSHIP).groupBy("ticker").agg(F.collect_list(whole).alias("rows"))
    lists = conform(patches, PATCHES).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*(F.col(n) for n in columns_of(PATCHES))))).alias("patches"))
    kind = T.ArrayType(INDEX_MEMBERSHIP)

    def step(state: Column, p: Column) -> Column:
        def meant(row: Column) -> Column:
            same = F.lit(True)
            for name in ("date_added", "date_removed"):
                same &= p[name].isNull() | F.coalesce(row[name] == p[name], F.lit(False))
            return same

        def renewed(row: Column) -> Column:
            new = [F.when(p["field"] == f.name, p["value"].try_cast(f.dataType)).otherwise(row[f.name]).alias(f.name) for f in fields]
            return F.when(meant(row), F.struct(*new)).otherwise(row)

        given = ("ticker", "date_added", "date_removed")
        fresh = F.struct(*((p[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        known = F.exists(state["rows"], meant)
        rows = (
            F.when(p["op"] == ADD, F.concat(state["rows"], F.array(fresh)))
            .when(p["op"] == DELETE, F.filter(state["rows"], lambda r: ~meant(r)))
            .when(p["op"] == UPDATE, F.transform(state["rows"], renewed))
            .otherwise(state["rows"])
        )
        # A field that the table lacks changes nothing.
        usable = (p["op"] != UPDATE) | F.coalesce(p["field"].isin(*INDEX_MEMBERSHIP.fieldNames()), F.lit(False))
        done = (p["op"] == ADD) | (p["op"].isin(UPDATE, DELETE) & known & usable)
        hit = F.when(F.coalesce(done, F.lit(False)), F.concat(state["hit"], F.array(p["position"]))).otherwise(state["hit"])
        return F.struct(rows.cast(kind).alias("rows"), hit.alias("hit"))

    start = F.struct(F.coalesce(F.col("rows"), F.array()).cast(kind).alias("rows"), F.array().cast("array<int>").alias("hit"))
    met = lists.join(rows, "ticker", "left")
    return met.select("ticker", F.aggregate("patches", start, step).alias("s"), F.col("patches.position").alias("asked")).select("ticker", "s.*", "asked")


def fold_patches(df: DataFrame, patches: DataFrame) -> DataFrame:
    """An ordered list of corrections, applied one after the other.

    ``patches`` has ``PATCHES`` columns. ``update`` sets one field, ``delete`` drops, on those rows of the ticker
    that have the patch's days where it names some (as rows are at that point of the list); ``add`` puts
    a new row with ticker and days, whose other fields later updates set. Values are text, read in the field's type;
    null empties a field. Only tickers with a patch are gathered, and a ticker has few intervals
    and few patches; all other rows pass by.
    """
    touched = patches.select("ticker").distinct()
    rest = conform(df, INDEX_MEMBERSHIP).join(touched, "ticker", "left_anti").select(*columns_of(INDEX_MEMBERSHIP))
    return rest.unionByName(_folded(df, patches).select(F.inline("rows")))


def unmatched_patches(df: DataFrame, patches: DataFrame) -> DataFrame:
    """The patches that met no row, or name a field or an operation that is none, in ``PATCHES`` columns."""
    found = _folded(df, patches)
    idle = found.select("ticker", F.explode(F.array_except("asked", "hit")).alias("position"))
    return conform(patches, PATCHES).join(idle, ["ticker", "position"], "left_semi").select(*columns_of(PATCHES))


def patch_counts(df: DataFrame, updates: DataFrame, adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows touched per kind of patch: (op, rows)."""
    touched = df.join(updates.select("ticker").distinct(), "ticker", "left_semi")
    updated = apply_patches(df, updates, adds, None)
    row, rule = updated.alias("row"), deletes.alias("rule")
    same = F.col("row.ticker") == F.col("rule.ticker")
    for name in ("date_added", "date_removed"):
        asked = F.col(f"rule.{name}")
        same &= asked.isNull() | F.coalesce(F.col(f"row.{name}") == asked, F.lit(False))
    gone = row.join(rule, same, "left_semi")

    def counted(op: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(op).alias("op"), F.count("*").alias("rows"))

    return (
        counted("update", touched)
        .unionByName(counted("add", adds))
        .unionByName(counted("delete", gone))
    )


def members_on(membership: DataFrame, day: date) -> DataFrame:
    """Tickers in the index on one day. A missing start never matches."""
    inside = covers(F.col("date_added"), F.col("date_removed"), F.lit(day), open_start=False)
    return membership.where(inside).select("ticker").distinct()


def active_on(dates: DataFrame, membership: DataFrame) -> DataFrame:
    """(date, ticker) members on each of many days.

    Intervals are clipped to the span of the days and unrolled, and the unrolled days that are
    asked for stay: an equi-join on the day, in which no day is compared with every interval.
    """
    days = dates.select("date").distinct()
    span = days.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    clipped = (
        membership.select("ticker", "date_added", "date_removed")
        .distinct()
        .withColumn("_span", span)
        .withColumn("_from", F.greatest("date_added", "_span.first"))
        .withColumn("_to", F.least(F.date_sub("date_removed", 1), F.col("_span.last")))
        .where(F.col("date_added").isNotNull() & (F.col("_from") <= F.col("_to")))
    )
    unrolled = clipped.select("ticker", F.explode(F.sequence("_from", "_to")).alias("date"))
    return unrolled.join(days, "date", "left_semi").select("date", "ticker").distinct()


def membership_window(membership: DataFrame, start: date, end: date) -> DataFrame:
    """(date, ticker) for every business day in ``[start, end]``.

    Each interval is clipped to the window and unrolled into its days; nothing is joined.
    """
    if end < start:
        raise ValueError(f"membership window ends ({end}) before it starts ({start})")
    begin = F.greatest("date_added", F.lit(start))
    stop = F.least(F.date_sub("date_removed", 1), F.lit(end))
    return (
        membership.where(F.col("date_added").isNotNull() & (begin <= stop))
        .select("ticker", F.explode(F.sequence(begin, stop)).alias("date"))
        .where(is_weekday(F.col("date")))
        .select("date", "ticker")
        .distinct()
    )


def constituent_difference(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Symmetric difference of two ticker sets: (ticker, side)."""
    a = ours.select("ticker").distinct().withColumn("_a", F.lit(True))
    b = theirs.select("ticker").distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right")
    return (
        a.join(b, "ticker", "full_outer")
        .select("ticker", side.alias("side"))
        .where(F.col("side").isNotNull())
    )


def within_tolerance(difference: DataFrame, tolerance: int = 1) -> DataFrame:
    """(differing, ok): whether two constituent sets agree up to ``tolerance`` names."""
    return difference.agg(
        F.count("*").alias("differing"), (F.count("*") <= tolerance).alias("ok")
    )
