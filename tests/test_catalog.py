import pytest
from tidemark.operators import catalog as C

SCHEMA = "server int, label string, type string, parent_label string, keep boolean"


def chains(sizes):
    """One chain a server, its first snapshot full."""
    return [(s, f"{i:05d}", "incremental" if i else "full", f"{i - 1:05d}" if i else None, False) for s, n in enumerate(sizes) for i in range(n)]


def test_long_chains(spark):
    rows = chains([1500, 3, 1]) + [(3, "b", "incremental", "gone", False), (3, "c", "incremental", "b", False), (3, "d", "full", "c", False), (3, "e", "incremental", "d", False)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(s, la): ("00000", int(la)) for s, la, *_ in rows if s < 3} | {(3, "b"): ("b", 0), (3, "c"): ("b", 1), (3, "d"): ("d", 0), (3, "e"): ("d", 1)}
    assert {(r.server, r.label): (r.root, r.depth) for r in C.backup_root(df).collect()} == want
    for server, label, hit in [(0, "01400", {(0, f"{i:05d}") for i in range(1401)}), (3, "c", {(3, "b"), (3, "c")}), (3, "d", {(3, "d")}), (1, "none", set())]:
        got = C.keep(df, server, label, True, True).collect()
        assert len(got) == len(rows) and {(r.server, r.label) for r in got if r.keep} == hit


def test_row_limit(spark):
    df = spark.createDataFrame(chains([5] * 60), SCHEMA)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert sorted((r.server, r.label, r.ancestor, r.depth) for r in C.backup_chain(df).collect()) == sorted((s, f"{i:05d}", f"{j:05d}", i - j) for s in range(60) for i in range(5) for j in range(i + 1))
        assert {(r.root, r.depth) for r in C.backup_root(df).collect()} == {("00000", i) for i in range(5)}
        assert sum(r.keep for r in C.keep(df, 7, "00003", True, True).collect()) == 4
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_round_chain(spark):
    df = spark.createDataFrame([(1, "a", "incremental", "b", False), (1, "b", "incremental", "a", False)], SCHEMA)
    for f in (C.backup_root, C.backup_chain, lambda c: C.keep(c, 1, "a", True, True)):
        with pytest.raises(ValueError):
            f(df)
