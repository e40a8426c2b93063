"""Benchmarks of several groups."""

import pickle
from types import SimpleNamespace

import pyarrow as pa
from tidemark.llm import decontaminate as D


def test_groups_are_unfolded_where_they_may_occur(spark, monkeypatch):
    """Of ten groups only those that a block may hold are unfolded, each once, and the result is that of one group."""
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12 + k))) for k in range(10)]
    texts = [f"some words {items[k][1]} and others w5x1 w5x2" for k in (2, 7, 2, 7)] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(map(str, D.find_contamination(docs, bench, group_bytes=n).collect())) for n in (1 << 20, 60))
    assert one == many and "i7" in str(many)

    groups = [SimpleNamespace(value=D.packed_items([x])) for x in items]
    calls, real = [], D.phrases_of
    monkeypatch.setattr(D, "phrases_of", lambda packed, window: calls.append(packed) or real(packed, window))
    monkeypatch.setattr(D.X, "blocks", lambda batches, column: (pa.Table.from_batches([b]) for b in batches))
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts[:40])]
    out = [r for b in D._find(groups, D.WINDOW, False)(iter(batches)) for r in b.to_pylist()]
    assert [r["items"] for r in out] == [["i2"], ["i7"]] * 20
    assert len(calls) == 2 and {pickle.loads(c)[2][0] for c in calls} == {"i2", "i7"}
