"""Roll-up, deletion and publication of versioned snapshots; incremental files; packed blocks; large JSON; whole targets and chains."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog as C
from tidemark.operators import changes, snapshots, store
from tidemark.sources import files as R

CATALOG = "server long, label string, type string, parent_label string, valid boolean, keep boolean, size long"
FILES = "server long, label string, path string, kind string, size long, truncation_len long, ref_label string"
BLOCKS = "server long, label string, path string, blk long, payload binary"


def page(tag):
    return tag.encode().ljust(snapshots.BLOCK, b".")


def made():
    """A chain l1 (full) - l2 - l3 of two files, and a linked configuration file; content after each is what a restore must give."""
    cat = [(1, "l1", "full", None, True, False, 0), (1, "l2", "incremental", "l1", True, False, 0), (1, "l3", "incremental", "l2", True, False, 0), (2, "l1", "full", None, True, True, 7)]
    files, blocks, P = [], [], snapshots.BLOCK
    for path, n in (("a", 4), ("b", 2)):
        files.append((1, "l1", path, "full", n * P, None, None))
        blocks += [(1, "l1", path, k, page(f"{path}{k}.1")) for k in range(n)]
    files += [(1, "l2", "a", "incremental", 2 * P, 5, None), (1, "l2", "b", "incremental", 0, 1, None)]
    blocks += [(1, "l2", "a", 1, page("a1.2")), (1, "l2", "a", 4, page("a4.2"))]
    files += [(1, "l3", "a", "incremental", P, 4, None), (1, "l3", "b", "incremental", 2 * P, 3, None)]
    blocks += [(1, "l3", "a", 3, page("a3.3")), (1, "l3", "b", 1, page("b1.3")), (1, "l3", "b", 2, page("b2.3"))]
    files += [(1, "l1", "conf", "full", 4, None, None), (1, "l2", "conf", "full", 4, None, "l1"), (1, "l3", "conf", "full", 4, None, "l1")]
    blocks.append((1, "l1", "conf", 0, b"text"))
    return cat, files, blocks


def restored(s, label):
    """Bytes of every file of a snapshot, from its chain, in plain Python."""
    cat = {r.label: r for r in s.catalog.filter("server = 1").collect()}
    files = {(r.label, r.path): r for r in s.files.filter("server = 1").collect()}
    data = {(r.label, r.path, r.blk): bytes(r.payload) for r in s.blocks.filter("server = 1").collect()}
    chain = [label]
    while cat[chain[-1]].type != "full":
        chain.append(cat[chain[-1]].parent_label)
    out = {}
    for path in sorted({p for l, p in files if l == label}):
        have, cut, top = {}, files[label, path].truncation_len, -1
        for depth, l in enumerate(chain):
            f = files[l, path]
            at = f.ref_label or l
            for (x, p, k), v in data.items():
                if x == at and p == path and (depth == 0 or cut is None or k < cut):
                    have.setdefault(k, v)
            if f.kind == "full":
                break
        top = max([(cut or 0) - 1, *have])
        out[path] = b"".join(have.get(k, bytes(snapshots.BLOCK)) for k in range(top + 1))
    return out


@pytest.fixture
def root(spark, tmp_path):
    cat, files, blocks = made()
    store.publish(spark, str(tmp_path / "s"), spark.createDataFrame(cat, CATALOG), spark.createDataFrame(files, FILES), spark.createDataFrame(blocks, BLOCKS), 0)
    return str(tmp_path / "s")


def test_roll_up_to_full(spark, root):
    before = restored(store.current(spark, root), "l3")
    store.roll_up(spark, root, 1, "l3")
    s = store.current(spark, root)
    r = s.catalog.filter("server = 1 AND label = 'l3'").first()
    assert (s.version, r.type, r.parent_label) == (1, "full", None)
    assert restored(s, "l3") == before
    # what is left of b after l2 is block 0; l3 grew it again
    assert before["b"] == page("b0.1") + page("b1.3") + page("b2.3")
    assert r.size == sum(len(v) for p, v in before.items() if p != "conf")
    assert s.catalog.filter("server = 2").first().size == 7
    with pytest.raises(ValueError, match="full snapshot"):
        store.roll_up(spark, root, 1, "l3")


def test_roll_up_of_increments(spark, root):
    before = restored(store.current(spark, root), "l3")
    store.roll_up(spark, root, 1, "l3", "l2")
    s = store.current(spark, root)
    r = s.catalog.filter("server = 1 AND label = 'l3'").first()
    assert (r.type, r.parent_label) == ("incremental", "l1")
    assert restored(s, "l3") == before


def test_delete_with_child_and_links(spark, root):
    s = store.current(spark, root)
    before = {k: restored(s, k) for k in ("l2", "l3")}
    store.delete(spark, root, 1, "l1")
    s = store.current(spark, root)
    assert [(r.label, r.type, r.parent_label) for r in s.catalog.filter("server = 1").orderBy("label").collect()] == [("l2", "full", None), ("l3", "incremental", "l2")]
    assert {k: restored(s, k) for k in ("l2", "l3")} == before
    assert {(r.label, r.ref_label) for r in s.files.filter("path = 'conf'").collect()} == {("l2", None), ("l3", "l2")}
    assert s.catalog.filter("server = 1 AND label = 'l2'").first().size == sum(map(len, before["l2"].values()))
    with pytest.raises(ValueError, match="kept"):
        store.delete(spark, root, 2, "l1")
    store.delete(spark, root, 2, "l1", force=True)
    assert store.current(spark, root).catalog.filter("server = 2").count() == 0
    with pytest.raises(ValueError, match="no snapshot"):
        store.delete(spark, root, 1, "l9")


@pytest.mark.parametrize("step", [0, 2, 3])
def test_a_lost_job_leaves_the_old_state(spark, root, step, monkeypatch):
    """The job ends before it writes its catalog, files, blocks or pointer."""
    old = restored(store.current(spark, root), "l3")
    wrote, write = [], type(spark.range(1).write).parquet

    def failing(self, path, *a, **b):
        if len(wrote) == step:
            raise RuntimeError("lost")
        wrote.append(path)
        return write(self, path, *a, **b)

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1).write), "parquet", failing)
        if step == 3:
            m.setattr(store, "point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.delete(spark, root, 1, "l1")
    s = store.current(spark, root)
    assert s.version == 0 and restored(s, "l3") == old and s.catalog.count() == 4
    store.delete(spark, root, 1, "l1")
    assert restored(store.current(spark, root), "l3") == old


def test_chain_without_full_file(spark):
    f = spark.createDataFrame([("x", 0, "incremental", 3), ("y", 0, "full", None)], "file string, depth int, kind string, truncation_len long")
    b = spark.createDataFrame([("x", 0, 1, b"p"), ("y", 0, 0, b"q")], "file string, depth int, blk long, payload binary")
    assert snapshots.reconstruct_blocks(f, b).count() == 2
    with pytest.raises(Exception, match="no snapshot of the chain has the full file x"):
        snapshots.reconstruct_blocks(f, b, incremental=False).collect()


def test_incremental_files(spark):
    r, rows, want = random.Random(2), [], {}
    for i, n in enumerate([0, 1, 3, 2045, 2046]):
        numbers = sorted(r.sample(range(5000), n))
        pages = [bytes([r.randrange(256)]) * 8192 for _ in numbers]
        head = struct.pack(f"<III{n}I", 0xD3AE1F0D, n, 5000 + i, *numbers)
        head += bytes(-len(head) % 8192) if n else b""
        rows.append((f"f{i}", head + b"".join(pages)))
        want[f"f{i}"] = (5000 + i, list(zip(numbers, pages, strict=True)), rows[-1][1])
    df = snapshots.incremental_files(spark.createDataFrame(rows, "path string, content binary"))
    got = {}
    for x in df.collect():
        got.setdefault(x.path, (x.truncation_len, []))[1].extend([] if x.blk is None else [(x.blk, bytes(x.payload))])
    assert {k: (v[0], sorted(v[1])) for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    blocks = F.array_sort(F.collect_list(F.when(F.col("blk").isNotNull(), F.struct("blk", "payload"))))
    again = df.groupBy("path").agg(blocks.alias("b"), F.max("truncation_len").alias("cut")).select("path", snapshots.incremental_content(F.col("b"), F.col("cut")).alias("c"))
    assert {x.path: bytes(x.c) for x in again.collect()} == {k: v[2] for k, v in want.items()}
    sizes = spark.createDataFrame([(k, len(v[1]), len(v[2])) for k, v in want.items()], "path string, n long, size long")
    assert sizes.filter(changes.incremental_file_size(F.col("n")) != F.col("size")).count() == 0
    for bad, why in ((b"abc", "magic"), (struct.pack("<III", 1, 0, 0), "magic"), (rows[2][1][:-1], "cut short")):
        with pytest.raises(Exception, match=why):
            snapshots.incremental_files(spark.createDataFrame([("x", bad)], "path string, content binary")).collect()


def test_whole_files_and_back(spark):
    raw = {"a": bytes(range(256)) * 200, "b": b"", "c": b"x" * 8192, "d": b"y" * 8193}
    blocks = snapshots.file_blocks(spark.createDataFrame(list(raw.items()), "path string, content binary"))
    got = {}
    for x in sorted(snapshots.file_parts(blocks, "path", part=2).collect(), key=lambda x: x.part):
        got[x.path] = got.get(x.path, b"") + bytes(x.bytes)
    assert got == {k: v for k, v in raw.items() if v}


def test_packed_blocks(spark):
    r, key = random.Random(4), (1663, 5, 7, 0)
    a = {r.randrange(200_000) for _ in range(500)} | set(range(40_000, 70_000))
    b = {r.randrange(200_000) for _ in range(2000)} | set(range(98_000, 101_000))
    frame = lambda s: spark.createDataFrame([(*key, x) for x in s], "spc long, db long, rel long, fork int, blk long")
    pa, pb = changes.brt_packed(frame(a)), changes.brt_packed(frame(b))
    both = changes.brt_union(pa, pb)
    assert {x.blk for x in changes.brt_unpacked(pa).collect()} == a
    assert {x.blk for x in changes.brt_unpacked(both).collect()} == a | b
    rows = both.collect()
    assert sum(x.n for x in rows) == len(a | b) and {x.bits is None for x in rows} == {True, False}
    for x in rows:
        held = len(x.bits) if x.bits is not None else 2 * len(x.offsets)
        assert held == min(4096, 2 * x.n)


def test_large_json(spark, tmp_path):
    """One line of many items, read in many ranges, with braces, quotes, escapes and other letters in names."""
    odd = ['a}b{"', "back\\", "}}", "é{", '"', "\\\\\"}", "plain"]
    items = [{"Path": f"{odd[i % 7]}/{i}", "Size": i, "Last-Modified": "x", "Checksum-Algorithm": "SHA256", "Checksum": "c" * 40} for i in range(4000)]
    doc = {"Version": 1, "Files": items, "WAL-Ranges": [{"Timeline": 1, "Start-LSN": "0/2", "End-LSN": "0/3"}], "Manifest-Checksum": "z"}
    (tmp_path / "m.json").write_text(json.dumps(doc, ensure_ascii=False))
    (tmp_path / "n.json").write_text(json.dumps({"Files": [{"Path": "n}", "Size": 1}]}, indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "m.json"))
        assert pieces.rdd.getNumPartitions() > 8
        got = R.read_manifest_json(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((x.Path, x.Size) for x in got) == sorted([*((x["Path"], x["Size"]) for x in items), ("n}", 1)])


def test_targets_and_chains(spark):
    cat = spark.createDataFrame([
        (1, "20240101000000", "full", None, True, 100, 1), (1, "20240102000000", "incremental", "20240101000000", True, 200, 1), (1, "20240103000000", "incremental", "20240102000000", False, 300, 1),
        (1, "20240104000000", "incremental", "20240102000000", True, 350, 2), (1, "20240105000000", "full", None, True, 250, 3), (1, "20240106000000", "incremental", "gone", True, 900, 3),
    ], "server long, label string, type string, parent_label string, valid boolean, start_lsn long, start_timeline long")
    day = lambda d: None if d is None else f"2024010{d}000000"
    asked = [(1, None, 99, None, None), (1, None, 260, None, 5), (1, None, 349, None, 5), (1, None, 10**6, None, 6), (1, "20240103120000", None, None, 2), (1, "2023", None, None, None), (1, None, None, 2, 4), (1, None, None, 9, None), (2, None, 500, None, None)]
    t = spark.createDataFrame([x[:4] for x in asked], "server long, time string, lsn long, timeline long")
    assert sorted(map(str, map(tuple, C.resolve_targets(cat, t).collect()))) == sorted(str((*x[:4], day(x[4]))) for x in asked)
    # timeline 2 left 1 at 220, timeline 3 left 2 at 240: what came later on those isn't part of 3
    history = spark.createDataFrame([(1, 2, 1, 220), (1, 3, 1, 220), (1, 3, 2, 240)], "server long, tli long, parent_tli long, switch_lsn long")
    t = spark.createDataFrame([(1, 10**6, 2), (1, 10**6, 3), (1, 245, 3), (1, 150, 3)], "server long, lsn long, timeline long")
    assert {(x.lsn, x.timeline): x.label for x in C.resolve_targets(cat, t, history).collect()} == {(10**6, 2): day(4), (10**6, 3): day(6), (245, 3): day(2), (150, 3): day(1)}
    ask = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "server long, newest string, oldest string")
    got = C.label_chains(cat, ask((day(4), None), (day(4), day(2)), (day(5), None))).collect()
    assert sorted((x.newest, str(x.oldest), x.label, x.depth) for x in got) == sorted([(day(4), "None", day(4), 0), (day(4), "None", day(2), 1), (day(4), "None", day(1), 2), (day(4), day(2), day(4), 0), (day(4), day(2), day(2), 1), (day(5), "None", day(5), 0)])
    assert {x.label for x in C.label_chains(cat, ask((day(4), None)), inclusive=False).collect()} == {day(2), day(1)}
    for bad, why in (((day(6), None), "without gone"), ((day(4), day(4)), "can't be its oldest"), ((day(9), None), "no snapshot"), ((day(4), day(5)), "without 20240105")):
        with pytest.raises(Exception, match=why):
            C.label_chains(cat, ask(bad)).collect()
    with pytest.raises(Exception, match="lacks the parent"):
        C.backup_root(cat, strict=True).collect()


def test_usage_of_trees(spark):
    files = [("r", 1), ("a/x", 2), ("a/b/y", 3), ("a/b/c/d/z", 4), ("e/f/w", 5), ("a/b/y2", 3)]
    got = {x.folder: (x.total, x.files, x.biggest) for x in C.tree_usage(spark.createDataFrame(files, "path string, size long")).collect()}
    want = {}
    for p, size in files:
        parts = p.split("/")[:-1]
        for k in range(len(parts) + 1):
            want.setdefault("/".join(parts[:k]), []).append(size)
    assert got == {k: (sum(v), len(v), max(v)) for k, v in want.items()}
    assert C.tree_usage(spark.createDataFrame([], "path string, size long")).count() == 0
