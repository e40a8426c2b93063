import numpy as np
import pyarrow as pa
from tidemark.llm import toxicity as T


def test_every_training_document_counts(spark):
    """Marks of label 1 that few documents hold, all learnt by several learners, whatever sample is; order and partitions don't matter."""
    n = 600
    text = lambda i: f"plain w{i % 40} " + (f"mark{i % 60 // 4} w{i % 7}" if i % 4 == 0 else f"fine w{i % 9}")
    rows = [(i, text(i)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = T.train(df, labels, sample=60)
    b = T.train(df.repartition(3).unionByName(df), labels.repartition(5), sample=60)
    h, first = T.hashed(pa.array([text(i) for i in range(n)]))
    marks = np.unique(T.hashed(pa.array([f"mark{k}" for k in range(15)]))[0])
    assert np.isin(marks, a.known).all()
    assert ((a.scores(h, first) >= 0.5) == (np.arange(n) % 4 == 0)).all()
    assert np.allclose(a.scores(h, first), b.scores(h, first), atol=1e-5)


def test_mean_of_what_learners_moved():
    part = lambda k, rows, seen: {"model": 0, "chunk": 0, "learner": k, "change": np.array(rows, np.float32).tobytes(), "seen": np.array(seen).tobytes()}
    got = T._mean(pa.Table.from_pylist([part(1, [[2, 2], [4, 0], [0, 0]], [True, True, False]), part(0, [[4, 0], [0, 0], [0, 0]], [True, False, False])]))
    assert np.frombuffer(got["change"][0].as_py(), np.float32).tolist() == [3, 1, 4, 0, 0, 0]


def test_steps_cover_all_documents_once():
    sizes, key = [3, 0, 5, 1, 0, 2] * 40, [0] * 100 + [1] * 3 + [4] * 137
    lists, at = [], 0
    for s in sizes:
        lists.append(list(range(at, at + s)))
        at += s
    zeros = pa.array([0] * len(sizes), pa.int32())
    batch = pa.RecordBatch.from_pydict({"learner": pa.array(key), "fold": pa.array(range(len(sizes))), "toxic": zeros, "lang": zeros, "words": pa.array(lists, pa.list_(pa.int32()))})
    got = list(T._steps(iter([batch, batch.slice(50, 0), batch.slice(7)]), "learner"))
    docs = [(int(k), int(f), w[a:b].tolist()) for k, fold, _, _, w, first in got for f, a, b in zip(fold, first[:-1], first[1:], strict=True)]
    want = list(zip(key, range(len(sizes)), lists, strict=True))
    assert docs == want + want[7:] and max(len(g[1]) for g in got) == T.BATCH
