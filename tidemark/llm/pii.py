"""Personal data by base patterns and by bootstrapped contexts, with DataFrame functions only.

Matches of the base patterns are the seeds. The words before a match (and what the word itself starts with, as in `id:`) make lexical
patterns, with and without the label that they name; patterns and the word values that they introduce form a graph. Round after round Spark scores
a pattern by the scores of its values, and a value by its prior and its patterns. The prior is 1 for seeds and PRIOR for words in the
shape of a key, which alone is below the threshold: such a word counts where its contexts introduce others like it. Where its contexts introduce
nothing else, so that they say nothing, the shape counts as far as contexts confirm it elsewhere. Only patterns that
reach CONFIDENT on SUPPORT values at least count. Values that reach the threshold become spans of the kind `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textops as X

KINDS = ("email", "ip", "card", "phone", "id")
#: The stated patterns, written for one pass: a match can start only where a run of its characters starts or where the last
#: match ended, and runs are never given back. Leftmost matches are the same, and long runs cost no second look.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: A word in the shape of a key, a weak prior: 32 hexadecimal digits or more, figures among them.
SHAPE = r"^(?=.*[0-9])[0-9A-Fa-f]{32,}$"
ROUNDS = 3
LEAST, CONFIDENT, SUPPORT, PRIOR = 0.75, 0.3, 2, 0.5
MIN_LENGTH = 6


def _luhn(digits: Column) -> Column:
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (kind == 0) | (kind == 4) | ((kind == 1) & small) | ((kind == 2) & n.between(16, 19) & _luhn(digits)) | ((kind == 3) & n.between(8, 15))


def _matches(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, row, kind, start, stop, word, near): matches of all kinds; word and near (what stands before) for words only."""
    text, has = F.col("text"), F.col("text").rlike("[0-9@]")
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.monotonically_increasing_id().alias("row")).filter(has)
    need = ("@", "[0-9]", "[0-9]", r"\+[0-9]", "[0-9@]")
    none = F.array().cast("array<string>")
    each = [
        F.struct(
            F.lit(k).alias("kind"),
            F.when(text.rlike(n), F.split(text, p, -1)).otherwise(none).alias("pieces"),
            F.when(text.rlike(n), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias("found"),
        )
        for k, (p, n) in enumerate(zip((*BASE, WORD), need, strict=True))
    ]
    d = docs.select("doc_id", "text_key", "row", F.explode(F.array(*each)).alias("e")).filter(F.size("e.found") > 0)
    d = d.select("doc_id", "text_key", "row", "e.kind", F.posexplode(F.arrays_zip(F.col("e.pieces").alias("piece"), F.col("e.found").alias("match"))).alias("at", "x"))
    is_word = F.col("kind") == 4
    d = d.filter("x.match IS NOT NULL").select(
        "doc_id", "text_key", "row", "kind", "at", F.char_length("x.piece").cast("long").alias("skip"), F.char_length("x.match").cast("long").alias("size"),
        _passes(F.col("kind"), F.col("x.match")).alias("good"), F.when(is_word, F.col("x.match")).alias("word"),
        F.when(is_word, F.regexp_extract("x.piece", r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]+$", 0)).alias("near"),
    )
    upto = W.partitionBy("doc_id", "text_key", "row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("stop", F.sum(F.col("skip") + F.col("size")).over(upto)).withColumn("start", F.col("stop") - F.col("size"))
    # rows that repeat both doc_id and text have the same matches: one of them is enough
    first = F.min("row").over(W.partitionBy("doc_id", "text_key"))
    return d.filter("good").withColumn("first", first).filter("row = first").select("doc_id", "text_key", "kind", "start", "stop", "word", "near")


def _plain(c: str) -> Column:
    return F.regexp_replace(F.lower(c), "[0-9]", "0")


def _counted(documents: DataFrame) -> DataFrame:
    """(context, total): how often each word of all texts occurs, by its hash."""
    words = documents.select(F.explode(F.split(_plain("text"), r"[\x20\x09-\x0D]+")).alias("word"))
    return words.groupBy(F.xxhash64("word").alias("context")).agg(F.count("*").alias("total"))


def _occurrences(found: DataFrame) -> DataFrame:
    """Words with digits or @ and what introduces them: (doc_id, text_key, start, stop, value, seed, shaped, patterns, context): context
    is the hash of the word before, null where the word itself begins with a label."""
    is_word = F.col("kind") == 4
    # in order of a base match's start and a word's end, the furthest end so far tells whether a base match overlaps the word
    by = W.partitionBy("doc_id", "text_key").orderBy(F.when(is_word, F.col("stop")).otherwise(F.col("start")), F.when(is_word, 0).otherwise(1))
    reach = F.max(F.when(~is_word, F.col("stop"))).over(by.rowsBetween(W.unboundedPreceding, 0))
    w = found.withColumn("seed", F.coalesce(reach > F.col("start"), F.lit(False))).filter(is_word)
    w = w.withColumn("lead", F.regexp_extract("word", r"^(?:[^=:]*+[=:])?[^\p{L}\p{N}@+]*", 0))
    rest = F.expr("substring(word, char_length(lead) + 1)")
    w = w.withColumn("value", F.regexp_replace(rest, r"[^\p{L}\p{N}]+$", ""))
    w = w.withColumn("start", F.col("start") + F.char_length("lead")).withColumn("stop", F.col("start") + F.char_length("value"))
    lead, near = _plain("lead"), F.split(F.trim(F.regexp_replace(_plain("near"), r"[\x20\x09-\x0D]+", " ")), " ")
    one, two = F.element_at(near, -1), F.when(F.size(near) > 1, F.element_at(near, -2))
    labelled = F.col("lead").rlike("[=:]")
    patterns = F.when(labelled, F.array(lead)).otherwise(F.array(F.concat(one, F.lit(" "), lead), F.concat(two, F.lit(" "), one, F.lit(" "), lead)))
    w = w.withColumn("patterns", F.filter(patterns, lambda p: p.isNotNull() & (F.trim(p) != "")))
    return w.select("doc_id", "text_key", "start", "stop", "value", "seed", F.col("value").rlike(SHAPE).alias("shaped"), "patterns", F.when(~labelled, F.xxhash64(one)).alias("context"))


def _alone(edges: DataFrame, priors: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """(value, score) of key-shaped values whose patterns introduce fewer than SUPPORT values each: the share of the other such values that
    contexts confirm. With none of those the share is 0."""
    shaped, keys = priors.filter(F.col("score") == PRIOR).select("value"), F.col("prior") == PRIOR
    wide = edges.groupBy("p").agg(F.count("*").alias("n"), F.count_if(keys).alias("k")).filter(f"n >= {SUPPORT} AND k > 0").select("p")
    heard = edges.filter(keys).join(shaped, "value", "left_semi").join(wide, "p", "left_semi").select("value").distinct()
    share = heard.join(values, "value", "left").agg((F.count_if(F.col("score") >= least) / (F.count("*") + 1)).alias("score"))
    return shaped.join(heard, "value", "left_anti").crossJoin(share)


def _scored(occurrences: DataFrame, totals: DataFrame, rounds: int, least: float) -> DataFrame:
    """(value, score) of the values that a confident pattern introduces, or that have a prior: edges join values to patterns, and scores go
    to and fro between them. value is a hash of the word in lower case.

    A pattern trusts its values as far as they are known, times the share of such values among all words that follow its last word: a
    word of ordinary prose introduces next to none, whatever those few are.
    """
    prior = F.when(F.col("seed"), 1 - 1e-9).when(F.col("shaped"), PRIOR).otherwise(0.0)
    led = occurrences.filter("context IS NOT NULL").groupBy("context").agg(F.count("*").alias("led"))
    share = led.join(totals, "context").select("context", (F.col("led") / F.greatest("led", "total")).alias("share"))
    edges = occurrences.select(F.xxhash64(F.lower("value")).alias("value"), prior.alias("prior"), "context", F.explode_outer("patterns").alias("p"))
    edges = edges.groupBy("value", F.xxhash64("p").alias("p"), F.col("p").isNull().alias("bare"), "context").agg(F.max("prior").alias("prior"))
    edges = X.kept(edges.join(share, "context", "left").select("value", "p", "bare", "prior", F.coalesce("share", F.lit(1.0)).alias("share")))
    priors = edges.groupBy("value").agg(F.max("prior").alias("score")).filter("score > 0")
    doubt = priors.select("value", F.log(1 - F.col("score")).alias("doubt"))
    values, edges = priors, edges.filter("NOT bare").select("value", "p", "share", "prior")
    for _ in range(rounds):
        # a pattern that introduces mostly unknown words, as every frequent word does, is dropped here and not joined back
        p = edges.join(values, "value", "left").groupBy("p").agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("*") + 1) * F.max("share")).alias("trust"), F.count_if(F.col("score") >= PRIOR).alias("support"))
        p = p.filter((F.col("trust") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("p", "trust")
        led = edges.join(p, "p").select("value", F.log(1 - F.lit(0.95) * F.col("trust")).alias("doubt"))
        values = X.kept(led.unionByName(doubt).groupBy("value").agg((1 - F.exp(F.sum("doubt"))).alias("score")))
    return values.unionByName(_alone(edges, priors, values, least)).groupBy("value").agg(F.max("score").alias("score"))


def find_pii(documents: DataFrame, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """(doc_id, text_key, spans) of the documents that have any: spans is a sorted array of (kind, start, stop), in code
    points, kind an index into KINDS.

    Base kinds are the stated patterns and checks; the contextual kind, id, adds words of MIN_LENGTH characters or more that
    hold a digit, overlap no base span, and score least or more, as a word does that is a base match elsewhere. Null and empty texts have no spans; rows that repeat doc_id
    and text have one result here, which holds for each of them; a null doc_id is a document like any other. Empty tables
    give empty results, further columns are ignored.
    """
    found = X.kept(_matches(documents))
    occurrences = X.kept(_occurrences(found))
    values = _scored(occurrences, _counted(documents), rounds, least).filter(F.col("score") >= least).select(F.col("value").alias("v"))
    new = occurrences.filter(~F.col("seed") & (F.char_length("value") >= MIN_LENGTH) & F.col("value").rlike("[0-9]"))
    new = new.join(values, F.xxhash64(F.lower("value")) == F.col("v"), "left_semi")
    spans = found.filter("kind < 4").select("doc_id", "text_key", "kind", "start", "stop")
    spans = spans.unionByName(new.select("doc_id", "text_key", F.lit(4).alias("kind"), "start", "stop"))
    return spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop of the spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    """How many of the spans are of a kind, an index into KINDS."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """documents with each span of text replaced by its kind in brackets; the first of overlapping spans counts."""
    docs = documents.withColumn("text_key", F.xxhash64("text"))
    s = spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))).alias("spans"))
    j = docs.join(s, docs["doc_id"].eqNullSafe(s["d"]) & (docs["text_key"] == s["k"]), "left")
    kinds = F.array(*map(F.lit, KINDS))
    out = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(
            F.struct(x["stop"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), F.element_at(kinds, x["kind"] + 1), F.lit("]")).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text"))),
    )
    return j.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(out)).select(documents.columns)
