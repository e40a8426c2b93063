"""What a task holds follows its own rows, and goes with the task."""

import pickle
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from tidemark.llm import jaccard as J
from tidemark.llm import sets as S
from tidemark.llm import textops as X
from tidemark.llm import tokens as K
from tidemark.llm.queries import TOKENIZER


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_small_texts_take_little_memory():
    texts = pa.array(["a b c d", "b c d e f"])
    S.shingles(texts, 3)  # imports
    X.let_go()
    (v, first), most = peak(lambda: S.shingles(texts, 3))
    assert np.diff(first).tolist() == [2, 3] and most < 8_000_000
    assert len(X.powers(len(X.powers(1)[0]) + 1)[0]) < 1 << 19
    p, inv = X.powers(300_000)
    assert len(p) >= 300_000 and (p * inv == 1).all() and p[1] == X.BASE
    X.let_go()


def test_dense_meetings_hold_each_pair_once():
    n = 1500
    c = np.full((n, 128), 3, np.int32)
    (i, j), most = peak(lambda: J.surviving(S.Similarity(5, 4, 5), c.sum(1), c))
    assert (np.sort(i.astype(np.int64) * n + j) == np.flatnonzero(np.triu(np.ones((n, n), bool), 1))).all()
    assert most < 30 * len(i)


def test_tasks_of_a_worker_share_one_tokenizer(monkeypatch):
    """Workers unpickle a task's function each time, and the library keeps memory of each tokenizer that was used and dropped."""
    file, made = public_tokenizers.path(TOKENIZER), []

    def init(self, file, real=K.Vocabulary.__init__):
        real(self, file)
        made.append(self)

    monkeypatch.setattr(K.Vocabulary, "__init__", init)
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 3)))
    if hasattr(K, "_vocabulary"):
        K._vocabulary.cache_clear()
    sent = cloudpickle.dumps(X.task(K._pack(file, K.END, K.SHARD_TOKENS)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["some words", None]})
    rows = [[b.to_pylist() for b in pickle.loads(sent)(iter([batch]))] for _ in range(3)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 1
    assert len(made) == 1 and len(made[0].h1) == len(made[0].pool) == 0
