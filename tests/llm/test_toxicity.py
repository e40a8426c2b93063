import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import toxicity as T


@pytest.mark.parametrize("huge", [(0,), (1,), (0, 1)])
def test_huge_training_text(spark, huge):
    """The training document with the least hash of its label holds more words than the sample may."""
    ids = spark.range(400).withColumn("toxic", F.when(F.col("id") % 4 == 0, 1).otherwise(0)).withColumnRenamed("id", "doc_id")
    order = [(r.doc_id, r.toxic) for r in T.training_rows(ids).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    big = {next(i for i, k in order if k == label) for label in huge}
    text = lambda i: " ".join(["plain", f"w{i % 50}", "filth" if i % 4 == 0 else "fine"] * (3 if i not in big else 2000))
    df = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    model = T.train(df, ids, sample_words=5000)
    got = model.scores(*T.hashed(pa.array([text(i) for i in range(400)])))
    assert ((got >= 0.5) == (np.arange(400) % 4 == 0)).all()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in T.score_toxicity(df, ids, sample_words=5000).collect())


def test_share_and_runs(spark):
    r = np.random.default_rng(1)
    for _ in range(300):
        n, total = r.integers(0, 30, r.integers(1, 12)), int(r.integers(1, 200))
        m = T.share(n, total)
        assert m == 1 or np.minimum(n, m).sum() <= total
        assert m >= n.max() or np.minimum(n, m + 1).sum() > total
    rows = [(n, list(range(n))) for n in (0, 5, 39, 40, 41, 100, 1001)]
    df = spark.createDataFrame(rows, "n long, words array<bigint>")
    for most in (1, 7, 40):
        for n, x in df.select("n", T._spread(F.col("words"), F.col("n"), most)).collect():
            assert len(x) == min(n, most) and x == sorted(set(x)) and set(x) <= set(range(n))
            assert n <= most or most < T.RUNS or (x[0] == 0 and x[-1] == n - 1)
