"""Block events, rewriting, the pruning source and the stream of segments, over synthesised log segments, against brute force."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from tests.test_wal_bytes import SEG, Log, body, rows, write_log

from tidemark.functions.scalar import crc32c
from tidemark.operators import changes, wal
from tidemark.sources import wal_bytes as B
from tidemark.sources import wal_source
from tidemark.streaming import log as T

INVALID = 4


def storage_log(seed, n=300, magic=0xD116, first=2**32 // SEG - 2):
    """A log of block changes, truncations, new forks, drops and databases, and its events in order."""
    r, log, events, version = random.Random(seed), Log(first, magic=magic), [], B.MAGIC[magic]
    for _ in range(n):
        key = (1663, r.randrange(2), r.randrange(4))
        kind, found = r.choice(["heap"] * 6 + ["skip", "create", "truncate", "drop", "made", "gone", "other"]), []
        blocks, main, info, rmid = [], b"", 0x20, 10
        if kind in ("heap", "skip", "other"):
            blocks = [(*key, r.randrange(4), r.randrange(60), None, bytes(r.randrange(700))) for _ in range(r.randrange(1, 4))]
            rmid, info = {"heap": (10, 0x20), "skip": (0, r.choice([0x00, 0x60, 0x90, 0xE0])), "other": (0, 0xB0)}[kind]
            found = [] if kind == "skip" else [("mark", (*b[:4],), b[4]) for b in blocks if b[3] != 1]
        elif kind == "create":
            fork = r.randrange(4)
            rmid, info, main = 2, 0x10, struct.pack("<IIIi", *key, fork)
            found = [("limit", (*key, fork), 0)] if fork != 1 else []
        elif kind == "truncate":
            flags, blk = r.randrange(8), r.randrange(60)
            rmid, info, main = 2, 0x20, struct.pack("<IIIIi", blk, *key, flags)
            found = [("limit", (*key, f), blk) for f, bit in ((0, 1), (2, 2)) if flags & bit]
        elif kind == "drop":
            rels = [(1663, r.randrange(2), r.randrange(4)) for _ in range(r.randrange(1, 3))]
            rmid, info, main = 1, 0x80 | r.choice([0x00, 0x20, 0x30, 0x40]), struct.pack("<qI", 5, 4) + struct.pack("<i", len(rels)) + b"".join(struct.pack("<III", *x) for x in rels)
            found = [("limit", (*x, f), 0) for x in rels for f in (0, 2, 3)]
        elif kind == "made":
            rmid, info, main = 4, (r.choice([0x00, 0x10]) if version >= 15 else 0x00), struct.pack("<IIII", 1, 1663, 0, 0)
            found = [("limit", (1663, 1, 0, 0), 0)]
        else:
            spaces = [r.choice([1663, 1700]) for _ in range(r.randrange(3))]
            rmid, info, main = 4, (0x20 if version >= 15 else 0x10), struct.pack(f"<Ii{len(spaces)}I", 1, len(spaces), *spaces)
            found = [("limit", (s, 1, 0, 0), 0) for s in spaces]
        lsn, _, _ = log.add(r.randrange(9), info, rmid, body(r, blocks, main, bit=2 if version < 15 else 4))
        events += [(lsn, *e) for e in found]
    return log, events


def summary(events, start, end):
    marks, limits = set(), {}
    for lsn, what, key, blk in events:
        if start <= lsn < end:
            if what == "mark":
                marks.add((*key, blk))
            elif blk < limits.get(key, 2**32):
                limits[key] = blk
                marks -= {m for m in marks if m[:4] == key and m[4] >= blk}
    return marks, limits


def frame(spark, log):
    return spark.createDataFrame(list(log.segments().items()), "file string, content binary").repartition(3)


@pytest.mark.parametrize(("seed", "magic"), [(1, 0xD116), (2, 0xD10D), (3, 0xD119)])
def test_events_from_records(spark, seed, magic):
    magic = magic if magic in B.MAGIC else 0xD118
    log, events = storage_log(seed, magic=magic)
    got = changes.block_events(B.read_wal_records(frame(spark, log)))
    found = sorted((e.lsn, e.phase, e.spc, e.db, e.rel, e.fork, e.limit_block, e.blk) for e in got.collect())
    assert [tuple(-1 if x is None else x for x in f) for f in found] == sorted((lsn, int(w == "mark"), *k, b if w == "limit" else -1, b if w == "mark" else -1) for lsn, w, k, b in events)
    lsns = sorted({e[0] for e in events})
    for start, end in ((0, 2**62), (lsns[len(lsns) // 3], lsns[-20])):
        marks, limits = summary(events, start, end)
        assert {tuple(x) for x in changes.summarize(got, start, end).collect()} == marks
        cut = got.filter((F.col("lsn") >= start) & (F.col("lsn") < end))
        assert {tuple(x) for x in changes.brt_limits(cut).collect()} == {(*k, v) for k, v in limits.items()}


def test_short_payloads_have_no_limits(spark):
    log = Log(5)
    for info, rmid, main in ((0x10, 2, b""), (0x20, 2, bytes(15)), (0x00, 4, b"abc"), (0x20, 4, struct.pack("<Ii", 1, 5)), (0x10, 2, struct.pack("<IIIi", 1, 2, 3, 0))):
        log.add(1, info, rmid, body(random.Random(0), [], main))
    got = changes.block_events(B.read_wal_records(frame(spark, log))).collect()
    assert [(e.spc, e.db, e.rel, e.fork, e.limit_block) for e in got] == [(1, 2, 3, 0, 0)]


def crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_rewritten_records(spark):
    log, want = write_log(4, 150)
    r = B.read_wal_records(frame(spark, log), keep_raw=True)
    xids = sorted({w[3] for w in want})[:40]
    table = spark.createDataFrame([(x,) for x in xids], "x long")
    for given in (xids, table):
        out = {x.lsn: x for x in wal.wal_filter_xids(r, given).collect()}
        assert len(out) == len(want)
        for lsn, prev, total, xid, top, info, rmid, *_ in want:
            x, hit = out[lsn], xid in xids or top in xids
            raw = bytes(x.raw)
            assert x.changed == hit and len(raw) == total
            assert struct.unpack_from("<IIQBBHI", raw)[:5] == ((total, xid, prev, 0x20, 0) if hit else (total, xid, prev, info, rmid))
            if hit:
                assert (x.rmgr, x.rmid, x.info, x.noop) == ("XLOG", 0, 0x20, True)
                assert x.crc == struct.unpack_from("<I", raw, 20)[0] == crc(raw[24:] + raw[:20])
            else:
                assert x.crc == 0xABCD and x.rmid == rmid
    again = wal.with_op(wal.wal_filter_xids(r, xids)).filter("changed").select("op").distinct().collect()
    assert [a.op for a in again] == ["NOOP"]
    deletes = {w[10] for w in want if w[10] is not None}
    for x in wal.wal_filter_delete(r, F.col("delete_xmax").isNotNull(), "delete_xmax").collect():
        w = next(w for w in want if w[0] == x.lsn)
        assert x.changed == (w[10] is not None or w[3] in deletes or w[4] in deletes)


def test_operations_and_objects(spark):
    log, want = write_log(6, 200)
    r = wal.with_op(B.read_wal_records(frame(spark, log)))
    got = {x.lsn: x.op for x in r.select("lsn", "op").collect()}
    names = {(10, 0x20): "UPDATE", (10, 0x10): "DELETE", (11, 0x20): None, (0, 0x20): "NOOP", (15, 0): None}
    for lsn, _, _, _, _, info, rmid, *_ in want:
        assert got[lsn] == ({0x00: "COMMIT", 0x20: "ABORT"}[info & 0x70] if rmid == 1 else names[rmid, info & 0xF0])
    mapping = spark.createDataFrame([(7, "orders"), (1663, "elsewhere")], "oid long, name string")
    touched = lambda test: {w[0] for w in want if any(test(b) for b in w[11])}
    assert {x.lsn for x in wal.wal_filter_objects(r, ["orders"], mapping).collect()} == touched(lambda b: 7 in b[:3])
    assert {x.lsn for x in wal.wal_filter_interactive(r, relations=" orders , rel 1663/2/3").collect()} >= touched(lambda b: b[:3] == (1663, 2, 3))
    assert {x.lsn for x in wal.wal_filter_interactive(r, rmgrs="heap,BTREE", relations="8").collect()} >= touched(lambda b: 8 in b[:3])


def test_pushed_lists(spark, tmp_path):
    spark.range(100).selectExpr("id AS lsn", "id AS prev_lsn", "id % 7 AS xid", "concat('r', id % 5) AS rmgr").write.parquet(str(tmp_path / "r"))
    df = wal.wal_filter(spark.read.parquet(str(tmp_path / "r")), ["r1", "r2"], xids=[3, 4])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "In(rmgr" in plan and "In(xid" in plan
    assert df.count() == wal.wal_filter(spark.read.parquet(str(tmp_path / "r")), spark.createDataFrame([("r1",), ("r2",)], "n string"), xids=spark.createDataFrame([(3,), (4,)], "x long")).count() > 0


def test_source_opens_what_it_needs(spark, tmp_path):
    log, want = write_log(8, 400)
    given = sorted(log.segments().items())
    for name, raw in given:
        (tmp_path / name).write_bytes(raw)
    assert rows(wal_source.wal_records(spark, str(tmp_path))) == [(*w, False) for w in want]
    # a segment that is no segment fails whoever opens it
    middle = len(given) // 2
    base = lambda name: int(name[8:16], 16) * 2**32 + int(name[16:], 16) * SEG
    cut = next(k for k in range(2, len(given)) if not any(w[0] < base(given[k][0]) < w[0] + w[2] for w in want) or k > middle)
    for name, _ in [*given[: cut - 2], *given[cut + 2 :]][1:]:
        (tmp_path / name).write_bytes(b"no segment")
    low, high = base(given[cut - 1][0]), base(given[cut][0])
    got = wal_source.wal_records(spark, f"file://{tmp_path}").filter((F.col("lsn") >= low) & (F.col("lsn") < high))
    assert {x.lsn for x in got.select("lsn").collect()} == {w[0] for w in want if low <= w[0] < high}
    assert wal_source.wal_records(spark, str(tmp_path)).filter("timeline = 9").collect() == []
    with pytest.raises(Exception, match="page header|magic"):
        wal_source.wal_records(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_stream_of_segments(spark, tmp_path, order):
    """Statistics and blocks of arriving segments equal those of all at once, whatever the order, over restarts."""
    log, events = storage_log(9, 250)
    given = sorted(log.segments().items())
    random.Random(3).shuffle(given) if order == "mixed" else given.sort(reverse=order == "backward")
    inbox = tmp_path / "in"
    inbox.mkdir()
    stores = {k: str(tmp_path / k) for k in ("stats", "blocks", "c1", "c2")}
    for i in range(0, len(given), 2):
        for name, raw in given[i : i + 2]:
            (inbox / name).write_bytes(raw)
        for start in (lambda: T.stats_fold(wal_source.stream_wal_records(spark, str(inbox), 1), stores["stats"], stores["c1"]), lambda: T.brt_stream(changes.block_events(wal_source.stream_wal_records(spark, str(inbox))), stores["blocks"], stores["c2"])):
            q = start()
            q.awaitTermination(120)
            assert q.exception() is None
    whole = wal.wal_filter(B.read_wal_records(frame(spark, log)))
    assert sorted(map(tuple, T.stats_so_far(spark, stores["stats"]).select("rmgr", "count", "record_size", "fpi_size", "combined_size").collect())) == sorted(map(tuple, T.wal_stats_stream(whole).collect()))
    assert {tuple(x) for x in T.brt_so_far(spark, stores["blocks"]).collect()} == summary(events, 0, 2**62)[0]


def test_crc_of_nothing(spark):
    assert spark.createDataFrame([(b"",), (None,), (b"123456789",)], "b binary").select(crc32c("b").alias("c")).collect()[2].c == 0xE3069283
