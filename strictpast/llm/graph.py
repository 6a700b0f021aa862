"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.session import stage

#: Parts into which the edges of one node are dealt.
SALT = 8


def in_parts(rows: DataFrame, facts: DataFrame, key: str, by: str, parts: int) -> DataFrame:
    """``rows`` with the facts of their ``key``, of which a large part of all rows may share one.

    Each fact is repeated for ``parts`` parts, into which the rows of its key are dealt by ``by``.
    Both sides are shuffled: to the planner the repeated facts look as small as before, so it
    broadcasts ``parts`` times its limit, which the driver has to hold.
    """
    facts = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge")
    return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(facts, [key, "part"]).drop("part")


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """Every edge ``(u, v)`` with ``m``, the least of ``u`` and its neighbours.

    The minimum is an aggregate with map-side combining and is met in SALT parts, so the
    edges of a hub are split over tasks.
    """
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return in_parts(edges, least, "u", "v", SALT)


def _starred(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``: then each ``v`` is the least of its component."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    sides = sides.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return (ends.agg(F.max(F.col("up") + F.col("down"))).first()[0] or 0) <= 1


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node that occurs in ``links``; the component is its least node.

    Loops and repeated links do no harm; links with a null end are ignored; without links the
    result is empty. Each round is written to the shared scratch folder, so lineage stays short
    and a lost executor costs one round at most. The driver sees one number a round.
    """
    ends = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stage(ends.distinct(), "links")
    while not _starred(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbours(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        met = _least_neighbours(large)
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.*").where("u != v").distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
