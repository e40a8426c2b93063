"""Stages of the pipeline against brute force, with null and repeated doc_ids."""

import random

import corpus_pipeline as P
import public_tokenizers
import pytest
from tidemark.llm.queries import TOKENIZER
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(5)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    texts = [words(40) for _ in range(12)]
    near = lambda t: t + " tail"
    ids = [None, None, None, 7, 7, 7, 1, 2, 3, None, 7, 9]
    rows = list(zip(ids, texts, strict=True))
    rows += [(None, near(texts[0])), (7, near(texts[6])), (20, near(texts[1])), (21, near(texts[3])), (None, near(texts[7]))]
    rows += [(None, None), (None, ""), (None, ""), (None, " "), (7, ""), (9, texts[11])]
    return [(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)]


def groups(rows):
    """Lists of rows whose texts are alike: sets of five-word shingles, similarity 0.8, connected."""
    sets = []
    for row in rows:
        w = (row[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return [[r for r, x in zip(rows, label, strict=True) if x == k] for k in sorted(set(label))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("i", corpus()[3][1])], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def out(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_near_duplicates(spark, folder):
    rows = corpus()
    got = [tuple(r) for r in P.near_duplicates_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder).collect()]
    want = groups(rows)
    assert len(got) == len(want)
    for g in want:
        least = min(g, key=lambda r: (r[0] is not None, r[0] or 0))[0]
        stays = [r for r in got if any(r[:2] == x[:2] for x in g)]
        assert {r[0] for r in stays} == {least} and len({r[1] for r in stays}) == 1


def test_toxicity_and_decontamination(spark, folder):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert out(P.toxicity_stage(spark, df, folder)) == sorted(map(repr, rows))  # one label, 0: nothing is toxic
    leak = rows[3][1]
    want = [r if leak not in (r[1] or "") else (r[0], "tail", *r[2:4], 4) for r in rows if r[1] != leak]
    assert out(P.decontamination_stage(spark, df, folder)) == sorted(map(repr, want))


def test_mixing_and_token_ids(spark, folder):
    rows = corpus()
    got = [tuple(r) for r in P.mixing_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder).collect()]
    # a copy is a row's whole text or its first words
    assert all(any(g[0] == r[0] and g[3] == r[3] and (r[1] or "").startswith(g[1] or "") for r in rows) for g in got)
    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    tokens = P.token_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder).collect()
    want = sorted((repr(r[0]), len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in tokens) == want
    assert min(r.start for r in tokens) == 0


def test_the_whole_run(spark, tmp_path):
    """Stage by stage on what the stage before wrote: each result is what brute force makes of it."""
    labels = [(100 + i, int(i % 2)) for i in range(60)]
    rows = corpus() + [(100 + i, f"{'filth ' if i % 2 else 'fine '}word{i} " * 8, "en", "s1", 5) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS words", "2 AS size", "3 AS node").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", rows[3][1])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mine = [tuple(r) for r in docs.select(P.COLUMNS).collect()]
    for k, (name, stage) in enumerate(P.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert docs.columns == P.COLUMNS
        got = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            assert not any("filth" in (r[1] or "") for r in got) and set(map(repr, got)) >= {repr(r) for r in mine if "fine" in (r[1] or "")}
        elif name == "near_duplicates":
            assert len(got) == len(groups(mine)) and set(map(repr, got)) <= set(map(repr, mine))
        elif name == "decontamination":
            assert not any(rows[3][1] in (r[1] or "") for r in got) and len(got) == len(mine) - sum(r[1] == rows[3][1] for r in mine)
        else:
            total = sum(len((r[1] or "").split()) for r in mine)
            assert abs(sum(len((r[1] or "").split()) for r in got) - 1.5 * total) <= 2  # one word a source
        mine = got
    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = sorted((repr(r[0]), len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in mine)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in P.run(spark, str(tmp_path)).collect()) == want


def test_a_run_over_nothing(spark, tmp_path):
    for name, kind in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
