"""Content fingerprints: row order free, column order bound, value sensitive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stands for the checksum of a dataset none of whose part files can be read.
UNREADABLE = "<unreadable>"

# A row's 128-bit digest is summed in pieces of five hex digits: plain long sums cannot
# overflow below eight trillion rows. Sums, unlike XOR, do not let duplicate rows cancel.
DIGITS = 5


def _times_power(c: Column, k: Column) -> Column:
    """``c * 2**k`` in two steps, so that the power does not overflow for tiny numbers."""
    half = F.floor(k / 2)
    return c * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), k - half)


def _double_text(c: Column) -> Column:
    """A double as ``sign mantissa p exponent``: exact, and the same in any SQL engine.

    The exponent is estimated by a logarithm and corrected, so its rounding does not matter.
    """
    size = F.when((c != 0) & ~F.isnan(c) & (F.abs(c) < float("inf")), F.abs(c))
    rough = F.floor(F.log2(size))
    lifted = _times_power(size, 52 - rough)
    exponent = rough + F.when(lifted >= 2.0**53, 1).when(lifted < 2.0**52, -1).otherwise(0)
    mantissa = _times_power(size, 52 - exponent).cast("bigint")
    sign = F.when(c < 0, "-").otherwise("")
    odd = F.when(c == 0, "0").when(F.isnan(c), "nan").when(c.isNotNull(), F.concat(sign, F.lit("inf")))
    return F.coalesce(F.concat(sign, mantissa.cast("string"), F.lit("p"), exponent.cast("string")), odd)


def canonical_text(df: DataFrame, name: str) -> Column:
    """A column as unambiguous text: its length, a colon and the value; ``~`` for NULL."""
    c = F.col(name)
    kind = df.schema[name].dataType
    text = _double_text(c.cast("double")) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def fingerprint(df: DataFrame, columns: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """One row with a 64-hex-digit digest of the named columns' contents.

    A commutative aggregate: every task folds its own rows, nothing is sorted or gathered.
    Computed from text and MD5 only, so that another engine can recompute it.
    """
    row = F.md5(F.concat(*(canonical_text(df, c) for c in columns)))
    hashed = df.select(row.alias("h"))
    sums = [
        F.coalesce(F.sum(F.conv(F.substring("h", start, DIGITS), 16, 10).cast("bigint")), F.lit(0)).cast("string")
        for start in range(1, 33, DIGITS)
    ]
    text = F.concat_ws("|", F.lit(",".join(columns)), F.count("*").cast("string"), *sums)
    return hashed.agg(F.sha2(text, 256).alias(name))


def _present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of a few paths that exist on their file systems."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, at in found if at.getFileSystem(conf).exists(at)]


#: Bytes above which a part file does not fit into one value, and how its dataset's checksum begins.
PART_LIMIT = 2_000_000_000
TOO_LARGE = "<part too large: "


def artifact_checksums(spark: SparkSession, *roots: str, part_limit: int = PART_LIMIT) -> DataFrame:
    """Dataset checksum of every written artifact under ``roots``: ``(path, checksum)``.

    Roots that are gone are left out. One scan hashes all part files where they lie. They are folded per dataset directory by
    a commutative sum, so the result does not depend on part file names and no list of parts
    is gathered. Artifacts that are gone give no row. Part files the file system itself
    finds damaged count as changed, they do not stop the job. A part file above ``part_limit``
    bytes is not read: its dataset's checksum names it instead, and never verifies. Sinks bound
    the rows of a part, so that only foreign files are that large.
    """
    there = _present(spark, roots)
    if not there:
        return spark.createDataFrame([], "path string, checksum string")
    parts = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .load(there)
    )
    directory = F.regexp_replace("path", r"(/[^/=]+=[^/]*)*/part-[^/]*$", "")
    dataset = F.regexp_replace(directory, "^file:/+", "/").alias("path")
    pieces = [
        F.sum(F.conv(F.substring("h", start, 8), 16, 10).cast("bigint")).cast("string")
        for start in range(1, 65, 8)
    ]
    digest = F.sha2(F.concat_ws("|", F.count("*").cast("string"), *pieces), 256)
    hashed = (
        # Lengths are known from listing, so the content of a larger part is never loaded.
        parts.where(F.col("length") <= part_limit)
        .select(dataset, F.sha2("content", 256).alias("h"))
        .groupBy("path")
        .agg(digest.alias("checksum"))
    )
    # Listing reads no contents, so it also names datasets without a single readable part.
    name = F.when(F.col("length") > part_limit, F.element_at(F.split("path", "/"), -1))
    listed = parts.select(dataset, name.alias("name")).groupBy("path").agg(F.min("name").alias("large"))
    told = F.coalesce(F.concat(F.lit(TOO_LARGE), "large", F.lit(">")), "checksum", F.lit(UNREADABLE))
    return listed.join(hashed, "path", "left").select("path", told.alias("checksum"))
