"""Chat logs: drop conversations that are a prefix of a longer one, then render the rest.

Loggers often store every state of a growing conversation. Turns get a hash of role and text,
prefixes a running sum of position-dependent turn hashes in two independent lanes, exact in
decimals. A conversation goes if some longer one has its prefix; of equal ones the smallest
id stays. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.session import stage

#: Fixed values of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _content(seed: int, role: str, text: str) -> Column:
    """A 64-bit hash of a turn's role and text; nulls are marked."""
    return F.xxhash64(F.lit(seed), F.isnull(role), role, F.isnull(text), text)


def rolling_hashes(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(_conv, _at, _h, _more)``: for every turn the hash of all turns up to it.

    ``_at`` counts from 1 in order of turn and then of turn hash, null turns first; equal rows
    are turns of their own; ``_more`` tells that a turn follows. Only hashes go through the
    window, whose sort can spill, so a long conversation costs three numbers a turn.
    """
    slim = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), *(_content(s, role, text).alias(f"_c{s}") for s in (1, 2)))
    order = Window.partitionBy("_conv").orderBy("_turn", "_c1", "_c2")
    placed = slim.select("_conv", "_turn", "_c1", "_c2", F.row_number().over(order).alias("_at"), F.lead("_c1").over(order).isNotNull().alias("_more"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lanes = [F.sum(F.xxhash64("_at", f"_c{s}").cast("decimal(20,0)")).over(upto).cast("string") for s in (1, 2)]
    return placed.select("_conv", "_at", F.concat_ws("/", *lanes).alias("_h"), "_more")


def collapse_snapshots(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, n_turns, n_copies)`` of the maximal conversations.

    ``n_copies`` counts the conversations with exactly these turns, of which the smallest id is
    returned. A null ``conv`` is a conversation of its own id; a null role or text differs from
    the empty one; an empty table gives an empty result; other columns are not read. Large groups of copies are
    folded before any join: one row per distinct conversation meets one row per distinct prefix.
    """
    hashes = stage(rolling_hashes(turns, conv, turn, role, text), "turn-prefixes")
    whole = hashes.where("not _more").groupBy("_at", "_h").agg(F.min(F.struct(F.col("_conv").isNotNull(), "_conv")).alias("_kept"), F.count("*").alias("n_copies"))
    # A turn that another one follows ends a prefix of a longer conversation.
    prefixes = hashes.where("_more").select("_at", "_h").distinct()
    maximal = whole.join(prefixes, ["_at", "_h"], "left_anti")
    return maximal.select(F.col("_kept._conv").alias(conv), F.col("_at").cast("bigint").alias("n_turns"), "n_copies")


def render(
    turns: DataFrame, kept: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Add ``chat`` to ``kept``: the turns of each conversation in ChatML, in order.

    A null role reads ``unknown`` and a null text is empty.
    """
    shown = F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))
    rows = turns.select(F.col(conv).alias("_conv"), F.struct(turn, *(_content(s, role, text) for s in (1, 2)), shown.alias("shown")).alias("_row"))
    wanted = kept.withColumnRenamed(conv, "_kept")
    met = rows.join(wanted, F.col("_conv").eqNullSafe(F.col("_kept"))).drop("_conv")
    turns_in_order = F.transform(F.sort_array(F.collect_list("_row")), lambda r: r["shown"])
    chats = met.groupBy(*wanted.columns).agg(F.array_join(turns_in_order, "").alias("chat"))
    return chats.withColumnRenamed("_kept", conv)
