"""Prefix sums against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strictpast.contracts import ContractError
from strictpast.operators.running import prefix_sums


def test_prefix_sums_of_groups(spark):
    r = random.Random(3)
    rows = [(None if g == 0 else f"g{min(g, 3)}", i, r.randint(-5, 9)) for i, g in enumerate(r.choices(range(12), k=900))]
    r.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, i int, v int")
        got = {(x.g, x.i): (x.before, x.n) for x in prefix_sums(df, ["g"], ["i"], {"before": "v", "n": F.lit(1)}).collect()}
        total = {x.i: x.before for x in prefix_sums(df, [], ["i"], {"before": "v"}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen, all_of = {}, {}, 0
    for g, i, v in sorted(rows, key=lambda x: x[1]):
        s, n = seen.get(g, (0, 0))
        want[g, i] = (s, n)
        seen[g] = (s + v, n + 1)
        assert total[i] == all_of
        all_of += v
    assert got == want


def test_prefix_sums_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i int, v int")
    assert prefix_sums(df, ["g"], ["i"], {"before": "v"}).count() == 0
    with pytest.raises(ContractError):
        prefix_sums(df, ["absent"], ["i"], {"before": "v"})
