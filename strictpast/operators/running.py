"""Prefix sums, prefix minima and decayed sums over an order, without a task that holds a group.

Rows are dealt to range partitions of (group, order), so a huge group is many partitions.
Totals of the partitions are a small table whose prefix sums give every partition its start;
inside a partition a window adds the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.contracts import require_columns
from strictpast.session import stage

PART = "_part"


def _prefixes(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], fold: Callable[[str], Column], merge: Callable[..., Column]) -> DataFrame:
    """``df`` with ``fold`` of each value over the group's earlier rows; null without any."""
    require_columns(df, [*by, *order], "prefix input")
    columns = df.columns
    valued = df.withColumns({f"_v_{name}": v for name, v in values.items()})
    ranged = valued.repartitionByRange(*(F.col(c) for c in (*by, *order))).withColumn(PART, F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    group = [F.col(c) for c in by] or [F.lit(0)]
    totals = ranged.groupBy(*by, PART).agg(*(fold(f"_v_{name}").alias(f"_t_{name}") for name in values))
    across = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)),
        F.col(PART).alias("_p"),
        *(fold(f"_t_{name}").over(across).alias(f"_s_{name}") for name in values),
    )
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({f"_w_{name}": fold(f"_v_{name}").over(inside) for name in values})
    same = F.col(PART) == F.col("_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    found = placed.join(starts, same)
    return found.select(*columns, *(merge(f"_s_{name}", f"_w_{name}").alias(name) for name in values))


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column | str]) -> DataFrame:
    """``df`` with, for each ``name: value`` of ``sums``, the sum of ``value`` over the group's earlier rows.

    ``order`` ascends, nulls first; null groups are groups. Rows that are equal in all of ``by`` and
    ``order`` share a partition and are ordered arbitrarily, so make the order unique, or fold equal
    rows into counts first. A value may not be null. ``df`` is read twice (once to sample the
    ranges): pass a stored or cheap one. The single-task part is one row for each partition.
    """
    values = {name: F.col(v) if isinstance(v, str) else v for name, v in sums.items()}

    def added(a: str, b: str) -> Column:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    return _prefixes(df, list(by), list(order), values, F.sum, added)


def prefix_minima(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the least ``value`` of the group's rows up to this one, itself included.

    The same work and the same conditions as :func:`prefix_sums`.
    """
    found = _prefixes(df, list(by), list(order), {"_least": F.col(value)}, F.min, F.least)
    return found.select(*df.columns, F.least("_least", value).alias(out))


def decayed_sums(df: DataFrame, by: Sequence[str], position: str, half_life: float, sums: Mapping[str, Column | str]) -> DataFrame:
    """``df`` with, for each ``name: value``, the sum over the group's rows up to this one, halved every ``half_life``.

    A row's weight is ``2 ** ((p - position) / half_life)`` with ``p`` its position, a whole number that
    occurs once in a group. Positions are cut into blocks of four half-lives. In a block, values are
    scaled up by at most 16 and back, so any number of positions is stable; what earlier blocks leave
    is carried from block to block in one small fold for each group (one entry a block). A null value
    adds nothing. A group's rows are sorted a block at a time; no task holds more of a group.
    ``df`` is read twice: pass a stored or cheap one.
    """
    by, names = list(by), list(sums)
    require_columns(df, [*by, position], "decayed sums input")
    size = max(1, int(4 * half_life))
    fade = 2.0 ** (-size / half_life)
    values = {n: F.coalesce((F.col(v) if isinstance(v, str) else v).cast("double"), F.lit(0.0)) for n, v in sums.items()}
    rows = df.withColumn("_block", F.floor(F.col(position) / size).cast("bigint"))
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    into = F.col(position) - F.col("_block") * size
    left = F.pow(F.lit(2.0), (into - size) / F.lit(float(half_life)))
    ends = rows.groupBy(*by, "_block").agg(F.array(*(F.sum(F.col(f"_v_{n}") * left) for n in names)).alias("e"))
    blocks = ends.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_block", "e"))).alias("blocks"))

    def step(state: Column, block: Column) -> Column:
        gap = (block["_block"] - state["upto"]).cast("double")
        carry = F.transform(state["sums"], lambda s: s * F.pow(F.lit(fade), gap))
        return F.struct(
            (block["_block"] + 1).alias("upto"),
            F.zip_with(F.transform(carry, lambda c: c * F.lit(fade)), block["e"], lambda c, e: c + e).alias("sums"),
            F.concat(state["told"], F.array(F.struct(block["_block"].alias("b"), carry.alias("carry")))).alias("told"),
        )

    start = F.struct(
        F.get("blocks", F.lit(0))["_block"].alias("upto"),
        F.array(*(F.lit(0.0) for _ in names)).alias("sums"),
        F.lit([]).cast("array<struct<b: bigint, carry: array<double>>>").alias("told"),
    )
    carried = blocks.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.inline(F.aggregate("blocks", start, step, lambda s: s["told"])))
    same = F.col("_block") == F.col("b")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*by, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(2.0), into / F.lit(float(half_life)))
    summed = rows.withColumns({f"_w_{n}": F.sum(F.col(f"_v_{n}") * scale).over(inside) for n in names})
    met = summed.join(carried, same)
    return met.select(*df.columns, *(((F.col("carry")[j] + F.col(f"_w_{n}")) / scale).alias(n) for j, n in enumerate(names)))
