"""What the learned contexts add to the base patterns."""

import re

import pytest
from pyspark.sql import functions as F
from tidemark.llm import pii

PLANTED = re.compile(r'token = "([0-9a-f]{32,})"')


def added(spark, texts, rounds=pii.ROUNDS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.find_pii(docs, rounds).select("doc_id", F.explode(F.filter("spans", lambda s: s["kind"] == 4)).alias("s")).select("doc_id", "s.start", "s.stop").collect()
    return {(r.doc_id, r.start, r.stop) for r in out}


def test_planted_keys(spark):
    """Recall and precision of added spans on the given documents; without rounds over the graph nothing is found."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    keys = {(i, m.start(1), m.end(1)) for i, t in enumerate(texts) for m in PLANTED.finditer(t or "")}
    got = added(spark, texts)
    assert len(keys) >= 10
    assert len(got & keys) >= 0.9 * len(keys)
    assert len(got & keys) >= 0.9 * len(got)
    assert added(spark, texts, rounds=0) & keys == set()


@pytest.mark.parametrize("n", [3, 40])
def test_contexts_tell_keys_from_others(spark, n):
    """Values without a prior are found where a context introduces known ones, and key-shaped words are not where theirs introduces anything."""
    known = [f"write to mail: user{k}@host{k}.org now" for k in range(n * 4)]
    unseen = ["write to mail: user77ataddress now"]
    loose = [f"item {k} of hash {'0123456789abcdef'[k % 16] * 8}{k:032d}" if k % 8 == 0 else f"item {k} of hash x{k}y" for k in range(n * 8)]
    texts = known + unseen + loose
    got = {texts[i][a:b] for i, a, b in added(spark, texts)}
    assert got == {"user77ataddress"}


@pytest.mark.parametrize("confirmed", [0, 40])
def test_lone_key_follows_its_shapes_record(spark, confirmed):
    """A key whose contexts say nothing is found only where contexts confirm others of its shape; one behind prose is not found."""
    hexa = lambda k: f"{'0123456789abcdef'[k % 16] * 8}{k:032d}"
    prose = [f"item {k} of hash x{k}y" for k in range(40)] + [f"item 99 of hash {hexa(1000)}"]
    texts = [f'a token = "{hexa(k)}" there' for k in range(confirmed)] + prose + [f"alone {hexa(2000)}", hexa(2001)]
    got = {texts[i][a:b] for i, a, b in added(spark, texts)}
    assert got == ({*map(hexa, range(confirmed)), hexa(2000), hexa(2001)} if confirmed else set())
