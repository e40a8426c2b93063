"""Binary log segments, built here record by record, against what the reader makes of them."""

import datetime as dt
import gzip
import io
import random
import struct
import tarfile

import pytest

from tidemark.sources import wal_bytes as B

PAGE, SEG = 8192, 65536
EPOCH = dt.datetime(2000, 1, 1, tzinfo=dt.UTC)


def body(r, blocks, main, toplevel=None, origin=None, bit=4):
    """Headers and data of a record: blocks are (spc, db, rel, fork, blk, image bytes or None, data bytes)."""
    head, data, last = b"", b"", None
    for k, (spc, db, rel, fork, blk, image, content) in enumerate(blocks):
        same = last == (spc, db, rel)
        flags = fork | (0x10 if image is not None else 0) | (0x20 if content else 0) | (0x80 if same else 0)
        head += struct.pack("<BBH", k, flags, len(content))
        if image is not None:
            packed = r.random() < 0.5
            head += struct.pack("<HHB", len(image), 60, 1 | (bit if packed else 0))
            if packed:
                head += struct.pack("<H", 100)
            data += image
        if not same:
            head += struct.pack("<III", spc, db, rel)
        last = (spc, db, rel)
        head += struct.pack("<I", blk)
        data += content
    if origin is not None:
        head += struct.pack("<BH", 253, origin)
    if toplevel is not None:
        head += struct.pack("<BI", 252, toplevel)
    if main:
        head += struct.pack("<BB", 255, len(main)) if len(main) < 256 else struct.pack("<BI", 254, len(main))
    return head + data + main


class Log:
    """Writes records from a segment's start on; segments are cut from it afterwards."""

    def __init__(self, first_segment, magic=0xD116, timeline=1):
        self.pages, self.first, self.magic, self.timeline = [], first_segment, magic, timeline
        self.prev = 0

    def room(self):
        return PAGE - len(self.pages[-1]) if self.pages else 0

    def new_page(self, left):
        address = self.first * SEG + len(self.pages) * PAGE
        long = address % SEG == 0
        page = struct.pack("<HHIQII", self.magic, (1 if left else 0) | (2 if long else 0), self.timeline, address, left, 0)
        self.pages.append(page + (struct.pack("<QII", 77, SEG, PAGE) if long else b""))

    def add(self, xid, info, rmid, payload):
        if not self.room():
            self.new_page(0)
        total = 24 + len(payload)
        lsn = self.first * SEG + (len(self.pages) - 1) * PAGE + len(self.pages[-1])
        raw = struct.pack("<IIQBBHI", total, xid, self.prev, info, rmid, 0, 0xABCD) + payload
        raw += b"\0" * (-len(raw) % 8)
        at = 0
        while at < len(raw):
            if not self.room():
                self.new_page(max(0, total - at))
            n = min(self.room(), len(raw) - at)
            self.pages[-1] += raw[at : at + n]
            at += n
        prev, self.prev = self.prev, lsn
        return lsn, prev, total

    def segments(self):
        data = b"".join(p + b"\0" * (PAGE - len(p)) for p in self.pages)
        data += b"\0" * (-len(data) % SEG)
        return {f"{self.timeline:08X}{(self.first + i) // (2**32 // SEG):08X}{(self.first + i) % (2**32 // SEG):08X}": data[i * SEG : (i + 1) * SEG] for i in range(len(data) // SEG)}


def write_log(seed, n=400, **more):
    r, log, want = random.Random(seed), Log(2**32 // SEG - 2, **more), []
    for i in range(n):
        kind = r.choice(["heap", "heap", "delete", "commit", "noop", "btree", "plain"])
        xid, top, blocks, main, info, rmid = r.randrange(1000), None, [], b"", 0, 0
        ts, subs, rels, xmax = None, None, None, None
        if kind in ("heap", "btree", "delete"):
            rel = (1663, r.randrange(3), r.randrange(9))
            for _ in range(r.randrange(1, 5)):
                rel = rel if r.random() < 0.5 else (1663, r.randrange(3), r.randrange(9))
                image = bytes(r.randrange(30)) * r.choice([1, 200]) if r.random() < 0.3 else None
                blocks.append((*rel, r.randrange(4), r.randrange(2**32 - 1), image, bytes(r.randrange(40))))
            rmid, info = (11, 0x20) if kind == "btree" else (10, 0x10 if kind == "delete" else 0x20)
            xmax = r.randrange(5000) if kind == "delete" else None
            main = struct.pack("<IHBB", xmax, 3, 0, 0) if kind == "delete" else bytes(r.randrange(600))
            top = r.randrange(1, 99) if r.random() < 0.2 else None
        elif kind == "commit":
            us, rmid = r.randrange(10**15), 1
            ts, main = EPOCH + dt.timedelta(microseconds=us), struct.pack("<q", us)
            info = r.choice([0x00, 0x20])
            if r.random() < 0.6:
                info |= 0x80
                flags = r.randrange(8)
                main += struct.pack("<I", flags) + (struct.pack("<II", 5, 1663) if flags & 1 else b"")
                if flags & 2:
                    subs = [r.randrange(2**32 - 1) for _ in range(r.randrange(4))]
                    main += struct.pack(f"<i{len(subs)}I", len(subs), *subs)
                if flags & 4:
                    rels = [(1663, 5, r.randrange(99)) for _ in range(r.randrange(1, 3))]
                    main += struct.pack("<i", len(rels)) + b"".join(struct.pack("<III", *x) for x in rels)
        elif kind == "noop":
            info = 0x20
            main = bytes(r.randrange(60))
        else:
            rmid, main = 15, bytes(r.choice([1, 255, 256, 9000, 70_000, 140_000]) if r.random() < 0.15 else 10)
        lsn, prev, total = log.add(xid, info, rmid, body(r, blocks, main, top, 3 if r.random() < 0.1 else None, 2 if log.magic < 0xD110 else 4))
        got = [(s, d, o, f, b, im is not None, len(im or b"")) for s, d, o, f, b, im, _ in blocks]
        want.append((lsn, prev, total, xid, top, info, rmid, ts, subs, rels, xmax, got, main))
    return log, want


def rows(df):
    out = []
    for r in df.collect():
        ts = r.xact_ts.replace(tzinfo=dt.UTC) if r.xact_ts else None
        rels = [tuple(x) for x in r.dropped_rels] if r.dropped_rels is not None else None
        blocks = [tuple(b) for b in r.blocks] if r.blocks is not None else None
        out.append((r.lsn, r.prev_lsn, r.tot_len, r.xid, r.toplevel_xid, r.info, r.rmid, ts, r.subxacts, rels, r.delete_xmax, blocks, bytes(r.main_data) if r.main_data is not None else None, r.partial))
    return sorted(out, key=lambda x: x[0])


@pytest.fixture(autouse=True)
def utc(monkeypatch):
    monkeypatch.setenv("TZ", "UTC")
    import time

    time.tzset()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_over_all_borders(spark, seed):
    log, want = write_log(seed)
    files = spark.createDataFrame(list(log.segments().items()), "file string, content binary").repartition(4)
    assert rows(B.read_wal_records(files)) == [(*w, False) for w in want]
    r = B.read_wal_records(files).filter("rmid = 0").first()
    assert r.noop and r.rmgr == "XLOG" and r.version == 17 and r.description.startswith("info 0x20")


def test_missing_segments(spark):
    """Without one segment, what it holds and what it cuts is partial; all else is whole."""
    log, want = write_log(5)
    given = log.segments()
    gone = sorted(given)[2]
    a = int(gone[8:16], 16) * 2**32 + int(gone[16:], 16) * SEG
    inside = {w[0] for w in want if a <= w[0] < a + SEG}
    del given[gone]
    got = rows(B.read_wal_records(spark.createDataFrame(list(given.items()), "file string, content binary")))
    whole, partial = [g[:-1] for g in got if not g[-1]], [g for g in got if g[-1]]
    cut = {w[0] for w in want if w[0] < a < w[0] + w[2]}
    assert [w for w in want if w[0] not in inside | cut] == [w for w in whole]
    assert {p[0] for p in partial} == cut | {a + SEG}


def test_ends_and_versions(spark, tmp_path):
    log, want = write_log(7, 40, magic=0xD106)
    name, raw = next(iter(log.segments().items()))
    stale = raw[: 3 * PAGE] + raw[PAGE : 2 * PAGE] + raw[4 * PAGE :]  # the fourth page is of an earlier use
    frame = lambda x: spark.createDataFrame([(name, x)], "file string, content binary")
    first = [w for w in want if w[0] + w[2] < (int(name[8:16], 16) * 2**32 + int(name[16:], 16) * SEG) + 3 * PAGE - 100]
    assert [x[0] for x in rows(B.read_wal_records(frame(stale)))][: len(first)] == [w[0] for w in first]
    for bad in (b"", b"x" * 100, raw[2:]):
        with pytest.raises(Exception, match="page header|magic"):
            B.read_wal_records(frame(bad)).collect()
    assert B.read_wal_records(spark.createDataFrame([], "file string, content binary")).collect() == []


def test_inputs(spark, tmp_path):
    log, want = write_log(9, 60)
    given = sorted(log.segments().items())
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo(f"pg_wal/{given[0][0]}")
        info.size = len(given[0][1])
        tar.addfile(info, io.BytesIO(given[0][1]))
    for name, raw in given[1:]:
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "00000002.history").write_text("1\t0/0\n")
    assert rows(B.read_wal_records(B.wal_files(spark, str(tmp_path)))) == [(*w, False) for w in want]
