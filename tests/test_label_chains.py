from tidemark.operators import catalog as C

ROWS = [(0, f"{i:04d}", "incremental" if i else "full", f"{i - 1:04d}" if i else None) for i in range(600)]
ROWS += [(1, "a", "full", None), (1, "b", "incremental", "a"), (1, "c", "incremental", "b"), (2, "b", "incremental", "gone"), (2, "c", "incremental", "b")]


def catalog(spark):
    return spark.createDataFrame(ROWS, "server int, label string, type string, parent_label string")


def ask(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], "server int, newest string, oldest string")


def test_no_further_than_asked(spark, monkeypatch):
    """A chain of three takes three rounds at most, however long other chains are."""
    rounds, jumps = [], C._jumps
    monkeypatch.setattr(C, "_jumps", lambda links: (rounds.append(j) or j for j in jumps(links)))
    got = {(r.label, r.depth) for r in C.label_chains(catalog(spark), ask(spark, (1, "c"))).collect()}
    assert got == {("c", 0), ("b", 1), ("a", 2)} and len(rounds) <= 3


def test_broken_chains_left_out(spark, monkeypatch):
    asked = ask(spark, (0, "0599"), (1, "b"), (1, "none"), (2, "c"))
    want = {(0, "0599", f"{i:04d}", 599 - i) for i in range(600)} | {(1, "b", "b", 0), (1, "b", "a", 1)}
    for sent in (C.SENT_ROWS, 1):
        monkeypatch.setattr(C, "SENT_ROWS", sent)
        got = C.label_chains(catalog(spark), asked, strict=False).collect()
        assert len(got) == len(want) and {(r.server, r.newest, r.label, r.depth) for r in got} == want
