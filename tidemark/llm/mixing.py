"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textops as X

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 7
BIN_ROWS = 4_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight from 0.1 to 1: ordinary word length (3 to 12 characters), up to 50 words, and letters for most of the characters that
    are not white space (none up to a half, full from nine tenths) add a third each."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{L}")) / F.greatest(F.char_length(text) - size + 1, F.lit(1))
    prose = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (letters - 0.5) / 0.4))
    return F.lit(0.1) + F.when(mean.between(3, 12), F.lit(0.3)).otherwise(F.lit(0.0)) + F.lit(0.3) * F.least(size / F.lit(50.0), F.lit(1.0)) + F.lit(0.3) * F.coalesce(prose, F.lit(0.0))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals (source, source_size, docs) with target: the words to take of each source.

    Sources by code point, null last, have the weights in turn and divide share of all words by weight; a target stops at
    most times its source, and what is over goes to the others by weight until none is above. With sources in order of
    size by weight that is one level, the first that the bound of its source allows: earlier ones take their bound, later ones
    weight times the level (further levels are lower, so the first is the largest).
    The windows here run over one row a source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    t = totals.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("all", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    t = t.withColumn("level", (F.col("all") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("bound") / F.col("weight"), F.col("level"))).over(W.partitionBy()))
    return t.select("source", "source_size", "docs", F.least(F.col("bound"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))).alias("target"))


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, source, row, size, source_size, target, taken) for each row of documents (doc_id, text, source).

    Each source is taken whole as often as its target allows; of the rest, documents come in the order of exponential keys
    -ln(u) / quality, u a hash of the document and the seed, up to the target: of the last one only the words that are
    missing. So a source's words come within one word of its target. A key depends on its row alone: reruns agree.

    Null texts have no words; a null source is a source, the last one. Rows that repeat doc_id and text get equal keys and
    stand side by side in the order: each is taken by itself. A source without words has target 0. An empty table gives an
    empty result; further columns are ignored.

    The prefix sums of a source run over ranges of its keys, BIN_ROWS rows each on average, so that no task holds a source.
    """
    size = sizes(F.col("text"))
    key = F.xxhash64("text")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed), "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    docs = documents.select("doc_id", "source", key.alias("text_key"), size.alias("size"), u.alias("u"), quality(F.col("text"), size).alias("quality"))
    docs = docs.withColumn("key", -F.log("u") / F.col("quality"))
    # equal rows are told apart by a number, so that each is taken once
    docs = X.kept(docs.select("doc_id", "source", "text_key", "size", "key", F.monotonically_increasing_id().alias("row")))
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(totals, weights, share, most)
    targets = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    targets = targets.withColumn("bins", F.ceil(F.col("docs") / F.lit(BIN_ROWS))).withColumnRenamed("source", "of")
    d = docs.join(targets, docs["source"].eqNullSafe(targets["of"])).drop("of", "docs")
    # keys at quality q have the distribution 1 - exp(-q * key); ranges by the mean of four of these hold a few BIN_ROWS at most
    share_below = sum((1 - F.exp(-F.col("key") * F.lit(q))) for q in (0.1, 0.4, 0.7, 1.0)) / 4
    d = d.withColumn("bin", F.floor(share_below * F.col("bins")).cast("long"))
    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    up = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("of"), F.col("bin").alias("b"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("base"))
    d = d.join(bins, d["source"].eqNullSafe(bins["of"]) & (d["bin"] == bins["b"]))
    within = W.partitionBy("source", "bin").orderBy("key", "doc_id", "text_key", "row").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return d.select("doc_id", "text_key", "source", "row", "size", "source_size", "target", (F.col("times") * F.col("size") + part).alias("taken"))
