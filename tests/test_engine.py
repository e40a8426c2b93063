import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F
from tidemark.functions import scalar as X
from tidemark.operators import catalog as C
from tidemark.operators import changes as B
from tidemark.operators import metrics as M
from tidemark.operators import snapshots as S
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "nation orders lineitem events documents".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def tidy(v):
    return round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v


@pytest.mark.parametrize("name", ["a2_wal_stats", "a3_summarize_wal", "j3_manifest_diff", "j11_backup_root", "w1_retention_mark", "w9_zero_filled", "f5_delete_backup"])
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(ORACLE_SQL[name])
    at = [[x[0] for x in r.description].index(c) for c in cols]
    want = sorted(str(tuple(tidy(x[i]) for i in at)) for x in r.fetchall())
    assert sorted(str(tuple(tidy(x[c]) for c in cols)) for x in df.collect()) == want


def test_limits_and_marks(spark):
    rows = [(1, 1, None, 5), (2, 0, 3, None), (3, 1, None, 6), (4, 0, 4, None)]
    e = spark.createDataFrame([(1663, 1, 2, 0, *r) for r in rows], "spc long, db long, rel long, fork long, lsn long, phase int, limit_block long, blk long")
    assert [r.blk for r in B.summarize(e).collect()] == [6]
    assert B.brt_limits(e).first().limit_block == 3


def test_rebuild(spark):
    f = spark.createDataFrame([("a", 0, "incremental", 2), ("a", 1, "incremental", 9), ("a", 2, "full", 4)], "file string, depth long, kind string, truncation_len long")
    b = spark.createDataFrame([("a", 0, 1, "n1"), ("a", 1, 3, "m3"), ("a", 1, 1, "m1"), ("a", 2, 0, "f0")], "file string, depth long, blk long, payload string")
    assert {(r.blk, r.payload) for r in S.reconstruct_blocks(f, b).collect()} == {(0, "f0"), (1, "n1")}


def test_incremental_plan(spark):
    f = spark.createDataFrame([("base/5/16384", 3 * 8192), ("base/5/16385", 100), ("base/5/16386_fsm", 8192), ("base/5/16387", 0), ("base/5/16388", 8192), ("global/pg_control", 8192)], "path string, size long")
    b = spark.createDataFrame([(1663, 5, 16384, 0, 2), (1663, 5, 16384, 0, 0), (1663, 5, 16384, 0, 7)], "spc long, db long, rel long, fork int, blk long")
    lim = spark.createDataFrame([], "spc long, db long, rel long, fork int, limit_block long")
    got = {r.path: (r.kind, r.blocks, r.truncation_len) for r in B.incremental_plan(f, b, lim).collect()}
    assert got["base/5/16384"] == ("incremental", [0, 2], 3) and got["base/5/16388"] == ("incremental", [], 1)
    assert {p for p, v in got.items() if v[0] == "full"} == {"base/5/16385", "base/5/16386_fsm", "base/5/16387", "global/pg_control"}


def test_weeks_modes(spark):
    days = lambda mode: [r.day for r in C.retention_anchors(spark, dt.date(2025, 3, 12), 3, -1, -1, mode).collect()]
    assert days("consecutive") == ["20250224", "20250303", "20250310"] and days("cumulative") == ["20250217", "20250303", "20250310"]


def test_metrics_text(spark):
    text = ["#HELP up Is it up", "#TYPE up gauge", 'up{a="x\\"}y",b="2"} 1', "plain 3.5", ""]
    got = {r.name: r for r in M.parse_metrics(spark.createDataFrame([(t,) for t in text], "value string"), "e").collect()}
    assert got["up"].labels == {"a": 'x"}y', "b": "2", "endpoint": "e"} and got["up"].help == "Is it up" and got["plain"].value == "3.5"


def test_crc32c(spark):
    df = spark.createDataFrame([(b"123456789",), (b"",), (None,)], "b binary")
    assert [r[0] for r in df.select(X.crc32c("b")).collect()] == [0xE3069283, 0, None]


def test_aes_and_text(spark):
    df = spark.range(1).select(F.expr("try_aes_decrypt(aes_encrypt('x', '0000111122223333'), '0000111122223334') IS NULL").alias("bad"), X.bytes_to_text(F.lit(1536).cast("long")).alias("t"))
    assert tuple(df.first()) == (True, "1.5kB")
