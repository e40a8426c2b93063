import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm import jaccard as J
from tidemark.llm import sets as S
from tidemark.llm.graph import components


def brute(rows, sim):
    def shingles(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + sim.words]) for i in range(max(len(w) - sim.words + 1, min(1, len(w))))}

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sim.den * len(sets[a] & sets[b]) >= sim.num * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    r = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a b c d"), (7, "a b c d"), (8, "A B c D")]
    base = [[f"w{r.randrange(300)}" for _ in range(r.randrange(2, 120))] for _ in range(12)]
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            t[r.randrange(len(t))] = f"x{r.randrange(50)}"
        rows.append((100 + i, " ".join(t[: len(t) - r.randrange(3)])))
    return rows


@pytest.mark.parametrize(("seed", "sim", "more"), [(1, S.Similarity(3, 9, 10), {}), (2, S.Similarity(5, 4, 5), {}), (3, S.Similarity(2, 4, 5), {"meeting": 6, "bucket_rows": 500})])
def test_links(spark, seed, sim, more):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS component_id").repartition(4)
    got = J.link_documents(df, sim, **more).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, sim)


def test_overgrown_bucket(spark, monkeypatch):
    rows = corpus(9, 80)
    sim = S.Similarity(3, 9, 10)

    def blob(part):
        ids = pa.array(range(len(part)), pa.int64())
        rows = pa.RecordBatch.from_pydict({"doc_id": ids, "text_key": ids, "text": pa.array([t for _, t in part])})
        return list(J._shingled(sim, 1)(iter([rows])))

    def met(batches):
        t = pa.Table.from_batches(list(J._meet(iter(batches)))).to_pandas()
        return t[t["sig"].notna()][["sig", "node", "unit", "spare", "n"]]

    whole = met(blob(rows))
    monkeypatch.setattr(J, "HELD_ROWS", 300)
    parts = [b for i in range(0, len(rows), 10) for b in blob(rows[i : i + 10])]
    loose = met(parts)
    assert loose["n"].isna().any()
    loose = loose.drop(columns="n").drop_duplicates()
    assert len(loose) == len(loose.drop_duplicates(["sig", "node"]))
    loose = loose[loose.groupby("sig")["node"].transform("size") > 1]
    shared = whole
    assert (shared["n"] == shared.groupby("sig")["node"].transform("size")).all()
    shared = shared.drop(columns="n")
    assert set(map(tuple, loose.to_numpy())) == set(map(tuple, shared.to_numpy()))


def test_bound_never_loses_a_link():
    r = np.random.default_rng(3)
    sim = S.Similarity(3, 9, 10)
    c = r.integers(0, 9, (70, 40))
    c[1::2] = c[::2]
    c[1::2, r.integers(0, 40, 35)] += 1
    size = c.sum(1)
    got = set(zip(*map(np.ndarray.tolist, J.surviving(sim, size, c)), strict=True))
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if np.minimum(c[i], c[j]).sum() >= sim.need(size[i], size[j])}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 60), (60, 61), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 60: 60, 61: 60, 100: 60}


def test_empty(spark):
    assert J.link_documents(spark.createDataFrame([], "doc_id long, text string"), S.Similarity(3, 9, 10)).collect() == []


def test_linked_sets_meet_in_what_they_keep():
    """Each linked pair shares a signature that neither leaves out, whichever order they are left out in."""
    rows, r = corpus(11, 120), np.random.default_rng(1)
    for sim in (S.Similarity(3, 9, 10), S.Similarity(5, 4, 5)):
        v, first = S.shingles(pa.array([t for _, t in rows]), sim.words)
        doc, sig, unit, spare = S.signatures(sim, v, first)
        size, kept = np.diff(first), [set() for _ in rows]
        rank = {s: k for k, s in enumerate(r.permutation(np.unique(sig)).tolist())}
        for d in range(len(rows)):
            for u in np.unique(unit[doc == d]):
                mine = (doc == d) & (unit == u)
                order = sorted(sig[mine].tolist(), key=rank.get)
                kept[d].update(order[: len(order) - int(spare[mine][0])])
        sets = [set(v[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
        links = [(a, b) for a in range(len(rows)) for b in range(a) if size[a] and sim.den * len(sets[a] & sets[b]) >= sim.num * len(sets[a] | sets[b])]
        assert len(links) > 100 and all(kept[a] & kept[b] for a, b in links)
        assert spare.max() > 0


def test_parities_bound_and_second_pass_stays_small():
    """The bound never exceeds the difference, and near copies just below the similarity, whose count vectors agree, make no pairs."""
    r = np.random.default_rng(5)
    base, sets = r.integers(0, 1 << 63, 700, dtype=np.uint64), []
    for k in range(60):
        size = int(r.integers(60, 700)) if k < 20 else 300
        own = base[:size].copy()
        own[r.permutation(size)[: size // 9 if k >= 20 else int(r.integers(0, size // 4))]] ^= np.uint64(0x1FFFFF) * np.uint64(r.integers(1, 1 << 30))
        sets.append(np.unique(own))
    v, first = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    i, j = np.triu_indices(60, 1)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    bound = S.least_apart(S.parities(v, first), i, j)
    close = apart <= 130
    assert (bound <= apart).all() and close.sum() > 500 and (bound[close] >= 0.7 * apart[close]).all()

    sim = S.Similarity(5, 5, 6)
    c, size = S.count_vectors(v, first), np.diff(first)
    node = pa.array([b"%03d" % k for k in range(60)])
    t = pa.RecordBatch.from_pydict({
        "sig": pa.array([1] * 60), "node": node, "block": pa.array([0] * 60), "label": node, "size": pa.array(size),
        "vec": pa.array([x.astype("<u4").tobytes() for x in c]), "parity": pa.array(S.parities(v, first), pa.binary()),
    })
    got = {(int(a), int(b)) for x in J._second_pass(sim)(iter([t])) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)}
    common = (size[i] + size[j] - apart) // 2
    links = {(a, b) for a, b, n, u in zip(i.tolist(), j.tolist(), common, size[i] + size[j] - common, strict=True) if sim.den * n >= sim.num * u}
    loose = len(J.surviving(sim, size, c)[0])
    assert links <= got and len(got) <= len(links) + 20 and loose > len(links) + 500
