"""Values carried along an order, against the same by a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog as C
from tidemark.operators.ordered import carried


def brute(rows, with_own, backward):
    out = []
    for k, at, v in rows:
        mine = sorted(((a, x) for kk, a, x in rows if kk == k and x is not None), reverse=backward)
        before = [x for a, x in mine if ((a > at) if backward else (a < at)) or (with_own and a == at)]
        out.append((k, at, v, before[-1] if before else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("with_own", [False, True])
@pytest.mark.parametrize("backward", [False, True])
def test_carried(spark, with_own, backward):
    """One key holds most rows, one is null, some bins hold no value."""
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["b", None]), at, r.choice([None, None, at * 10])) for at in r.sample(range(900), 250)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    got = carried(df, "k", F.floor(F.col("at") / 50), ["at"], F.col("v"), "last", with_own, backward)
    assert got.columns == ["k", "at", "v", "last"]
    assert sorted(repr(tuple(x)) for x in got.collect()) == brute(rows, with_own, backward)


def test_wal_between(spark):
    segments = spark.createDataFrame([("s", n) for n in ("01", "02", "02", "03", "07", "08")] + [("t", "05")], "server string, name string")
    backups = spark.createDataFrame([("s", "a", "02"), ("s", "b", "02"), ("s", "c", "07"), ("t", "a", "06")], "server string, label string, wal string")
    got = sorted(tuple(r) for r in C.wal_between(segments, backups, 1).collect())
    assert got == [("s", "a", 0), ("s", "b", 3), ("s", "c", 2), ("t", "a", 0)]
