"""The corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark passages are cut out, sources
are mixed to their target weights, and the mix is written as token ids.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, mixing, sets, tokens, toxicity
from tidemark.llm import textops as X
from tidemark.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labelled ones among them, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs.select(COLUMNS), labels).filter("predicted = 0").select(COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group that links of five-word shingles (similarity 0.8) connect the document with the least doc_id (null before others).

    Of rows of a group that repeat that doc_id the one with the least hash of its text stays; documents without words link with
    nothing and all stay. A null doc_id says nothing: rows without doc_id are told apart by their texts, and all without words stay.
    """
    linked = jaccard.link_documents(docs, sets.Similarity(5, 4, 5))
    alone = linked.filter("n_shingles = 0").select("doc_id", "text_key")
    first = linked.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("d")).select("d.*")
    stay = first.union(alone.distinct())
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    # a row that repeats both doc_id and text is the same document again, but not without either
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.join(stay, X.same_row(keyed, stay), "left_semi").withColumn("row", F.when(F.col("doc_id").isNull() & wordless, F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", "text_key", "row"]).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents of which no word is left go, if they had any."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.find_contamination(docs.select(COLUMNS), benchmark, cut=True)
    out = out.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return out.withColumn("n_chars", F.when(F.col("n_hit") == 0, F.col("n_chars")).otherwise(F.char_length("text"))).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it whole; of a document that is taken in part, its first words follow."""
    mixed = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("k"), F.col("source").alias("s")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s"))
    # rows that repeat doc_id, text and source are taken together
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key")).dropDuplicates(["doc_id", "text_key", "source"])
    d = keyed.join(mixed, same).select(*COLUMNS, "size", "taken")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("taken") - whole * F.col("size")
    copies = F.array_repeat(F.col("size"), whole)
    d = d.withColumn("words", F.explode(F.when(rest > 0, F.array_append(copies, rest)).otherwise(copies)))
    # the text up to its words-th word: what is left when words and gaps after that many are cut off
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{mixing.WORD}"), F.lit(0)), 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text"))
    n_chars = F.when(F.col("words") < F.col("size"), F.char_length(text)).otherwise(F.col("n_chars"))
    return d.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as directly addressable codes and returns what is read back of each document."""
    import public_tokenizers

    path = X.new_path(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return tokens.read_tokens(spark, path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = X.new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
