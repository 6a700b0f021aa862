"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w``: ``u`` a uniform number made from its id and text, ``w`` its
quality weight. In order of these keys, documents are a weighted sample without replacement. A source
that is to give more words than it has gives whole epochs first; what remains is taken in order of the
keys until a prefix sum of sizes meets the budget. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.operators.running import prefix_sums
from strictpast.session import stage

#: Weights of sources in order, repeated, and how many times a source may be taken at most.
CYCLE, EPOCHS = (1, 2, 3), 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = "12"
#: Hexadecimal digits of a hash that make a uniform number: 52 bits.
DIGITS = 13


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(key, nameless, source, size, drawn, row)``: what is left of a document; the text goes no further.

    ``row`` tells equal rows apart. It is given where the table is read, before anything is shuffled,
    so a task that runs again gives the same.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(body))
    return docs.select(
        F.col(key).alias("key"),
        F.col(source).isNull().alias("nameless"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("size"),
        F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("double").alias("drawn"),
        F.monotonically_increasing_id().alias("row"),
    )


def scored(slim: DataFrame, weight: Column) -> DataFrame:
    """Add the sampling key ``score``; a weight of nothing comes last."""
    uniform = (F.col("drawn") + 0.5) / float(16**DIGITS)
    return slim.withColumn("score", F.when(weight > 0, -F.ln(uniform) / weight).otherwise(F.lit(float("inf")))).drop("drawn")


def filled(sources: DataFrame, epochs: int) -> DataFrame:
    """``(…, target)`` of sources ``(…, words, weight)``: shares by weight, cut at ``epochs`` times the words.

    What the cuts free goes to the others by weight, again and again. The end of that is known at once:
    with sources in order of cap over weight, a prefix is cut and the rest shares what the prefix leaves;
    the prefix ends at the first source whose share is within its cap. Prefix sums give every
    source what it would get were it the first one not cut, and one minimum finds the end.
    """
    wide = "decimal(38,0)"
    capped = sources.withColumn("cap", F.col("words") * epochs).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = ["full_at", "nameless", "source"]
    before = stage(prefix_sums(capped, [], order, {"caps": "cap", "weights": "weight"}), "source-caps")
    left = before.agg(F.sum("words")).scalar() - F.col("caps")
    shared = before.agg(F.sum("weight")).scalar() - F.col("weights")
    told = before.withColumns({"left": left.cast(wide), "shared": shared.cast(wide)})
    within = F.col("left") * F.col("weight").cast(wide) <= F.col("cap").cast(wide) * F.col("shared")
    first = told.where(within).agg(F.min(F.struct(*order, "left", "shared"))).scalar()
    share = (first["left"] * F.col("weight").cast(wide)).cast("double") / first["shared"].cast("double")
    cap = F.col("cap").cast("double")
    target = F.when(F.col("full_at") >= first["full_at"], F.least(share, cap)).otherwise(cap)
    return before.select(*sources.columns, target.alias("target"))


def weighted(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Weights of ``cycle`` to sources in code point order, null last, over and over."""
    placed = prefix_sums(sources, [], ["nameless", "source"], {"place": F.lit(1)})
    return placed.select(*sources.columns, F.element_at(F.array(*map(F.lit, cycle)), (F.col("place") % len(cycle) + 1).cast("int")).cast("bigint").alias("weight"))


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", quality: DataFrame | None = None,
    cycle: tuple[int, ...] = CYCLE, epochs: int = EPOCHS,
) -> DataFrame:
    """``(key, size, source_size, target, taken)`` of every row.

    ``size`` counts the words of a text (null: 0). Sources in code point order, null last as a source of
    its own, weigh ``cycle``, repeated, and share the words of the whole table by weight; a target stops at
    ``epochs`` times its source's words and the excess is shared again by weight until none is above.
    ``taken`` is the words the mix takes of a document, repeats counted: whole epochs of its source, then,
    in the order of sampling, whole documents, and of the one at which the budget ends its first words.
    So the words taken of a source are its target, rounded.

    ``quality`` is a table ``(key, weight)``: documents of a higher weight tend to be taken before others. A
    key without weight weighs 1, of several weights the largest counts, and what weighs nothing comes
    last. Equal rows are rows of their own: the same numbers go to them in any order. A null key is a key; other columns are not read; an empty table
    gives an empty result. Results are the same in every run. No task holds a source.
    """
    slim, weight = sized(docs, key, text, source), F.lit(1.0)
    if quality is not None:
        name = quality.columns[0]
        known = quality.groupBy(F.col(name).alias("key")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        slim, weight = slim.join(known, "key", "left"), F.coalesce("weight", F.lit(1.0))
    slim = stage(scored(slim, weight).select("key", "nameless", "source", "size", "score", "row"), "document-sizes")
    sources = stage(slim.groupBy("nameless", "source").agg(F.sum("size").alias("words")), "sources")
    sources = stage(filled(stage(weighted(sources, cycle), "weighted-sources"), epochs), "source-targets")
    placed = prefix_sums(slim, ["nameless", "source"], ["score", "key", "size", "row"], {"before": "size"})
    met = placed.join(sources, ["nameless", "source"])
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("words") > 0, F.expr("floor(target + 0.5) div words")).otherwise(F.lit(0).cast("bigint"))
    part = F.least(F.greatest(budget - rounds * F.col("words") - F.col("before"), F.lit(0)), F.col("size"))
    return met.select(
        F.col("key").alias(key), "size", F.col("words").alias("source_size"), "target",
        (rounds * F.col("size") + part).cast("bigint").alias("taken"),
    )
