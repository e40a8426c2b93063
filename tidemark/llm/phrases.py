"""Phrase collocations of each language: phrases that occur more often than their parts suggest, the best of them by best-first growth.

Words and pairs of frequent words are counted over the whole corpus. Longer phrases grow from their prefixes, best first: a phrase
that extends a prefix q occurs a <= f(q) times, and the cut behind its first word w gives a score of at most a / (f(w) + a), which grows
with a; so f(q) / (f(w) + f(q)) bounds all that grow from q. A round takes a floor for each language, expands the prefixes
whose bound reaches it, and counts around each candidate that reaches it the longer phrases that may absorb it. If at least `top`
candidates survive, no prefix left on the frontier can change the result; else the floor falls and the frontier goes on.

Tasks code blocks of texts into numbers, count within a block and emit the phrases that a round asks for. What it asks for reaches
the tasks as bitmaps of hashes, of a fixed size: a clash makes a task count a phrase that nobody asked for, exactly like the others.
Phrases are grouped by their words, never by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textops as X

LEAST, TOP, SHARE = 30, 2000, 80
#: Bits of a bitmap of phrases (4 MB).
BITS = 1 << 25
BUCKET = 1 << 15
ODD = np.uint64(0xC2B2AE3D27D4EB4F)

BREAK = np.zeros(256, bool)
BREAK[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
IN_WORD = ~BREAK
IN_WORD[[32, 9]] = False

_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_COUNTS_SQL = "lang string, phrase string, n long"
_KEYED_SQL = "lang string, m int, phrase string, key long, n long"


class Coded:
    """A block of texts: its words as numbers, which words the next one goes on from, and keys of phrases at every word."""

    def __init__(self, table: pa.Table):
        data, off = X.texts(table["text"])
        self.data = X.LOWER[data]
        self.starts, self.ends, first = X.words(self.data, off, IN_WORD)
        self.first = first
        n = len(self.starts)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        piece = np.cumsum(BREAK[self.data])[self.starts]
        self.goes_on = np.append((piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1]), False) if n else np.zeros(0, bool)
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.names = langs.dictionary
        self.lang = langs.indices.to_numpy()[doc].astype(np.int64)
        size = self.ends - self.starts
        own = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(X.gather(self.data, self.starts, self.ends))]).dictionary_encode()
        vocabulary, off = X.texts(own.dictionary)
        self.code, self.vocabulary = own.indices.to_numpy().astype(np.int64), len(own.dictionary)
        word = X.spans(X.prefix(X.TABLES[0][vocabulary]), off[:-1], off[1:] - 1)
        names, off = X.texts(self.names)
        lang = X.spans(X.prefix(X.TABLES[1][names]), off[:-1], off[1:] - 1)
        self.keys = [X.mix(word[self.code] + lang[self.lang])]

    def key(self, m: int) -> np.ndarray:
        """Of each place the key of the m words from there on (of any words where the piece ends before)."""
        while len(self.keys) < m:
            k, last = len(self.keys), self.keys[-1]
            later = np.concatenate((self.keys[0][k:], np.zeros(min(k, len(last)), np.uint64)))
            self.keys.append(X.mix(last * ODD + later))
        return self.keys[m - 1]

    def whole(self, m: int) -> np.ndarray:
        """Where the m words from a place on are within one piece."""
        out = np.ones(len(self.code), bool)
        for k in range(m - 1):
            out &= _later(self.goes_on, k)
        return out

    def counts(self, m: int, at: np.ndarray) -> pa.RecordBatch:
        """How often each phrase of m words occurs at the places; equality is by the words."""
        ids = self.lang[at] * self.vocabulary + self.code[at]
        for k in range(1, m):
            ids = np.unique(ids, return_inverse=True)[1] * self.vocabulary + self.code[at + k]
        _, first, n = np.unique(ids, return_index=True, return_counts=True)
        p = at[first]
        words = (p[:, None] + np.arange(m)).ravel()
        text = X.gather(self.data, self.starts[words], self.ends[words], gap=1)
        ends = np.cumsum((self.ends[words] - self.starts[words]).reshape(-1, m).sum(1) + m)
        text = np.delete(text, ends - 1)
        off = np.concatenate(([0], ends - np.arange(1, len(p) + 1)))
        phrase = pa.Array.from_buffers(pa.large_string(), len(p), [None, pa.py_buffer(off), pa.py_buffer(text)]).cast(pa.string())
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.lang[p])), phrase, pa.array(n)], schema=_COUNTS)

    def totals(self) -> pa.RecordBatch:
        """How many words each language has."""
        n = np.bincount(self.lang, minlength=len(self.names))
        return pa.RecordBatch.from_arrays([self.names, pa.array([""] * len(n), pa.string()), pa.array(n)], schema=_COUNTS)


def _later(flags: np.ndarray, k: int) -> np.ndarray:
    """The flag k places further on; False beyond the end."""
    return np.concatenate((flags[k:], np.zeros(min(k, len(flags)), bool)))


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys & np.uint64(BITS - 1)
    return bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8) & 1 > 0


def bitmap(phrases: DataFrame) -> np.ndarray:
    """The bits of the phrases' keys: at most BITS / 8 bytes come to the driver, however many phrases there are."""
    place = (F.col("key").bitwiseAND(F.lit(BITS - 1)) + 1).alias("place")
    packed = phrases.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in packed.collect():
        out[(r.bucket - 1) * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, m, phrase, key, n) of counted phrases: a phrase is a text of its own, so its key is that of its first place."""
    for b in batches:
        block = Coded(pa.table({"lang": b["lang"], "text": b["phrase"]}))
        m, at = np.diff(block.first), np.minimum(block.first[:-1], max(len(block.code) - 1, 0))
        key = np.zeros(b.num_rows, np.uint64)
        for k in range(1, int(m.max(initial=0)) + 1):
            key = np.where(m == k, block.key(k)[at], key)
        yield pa.RecordBatch.from_arrays([b["lang"], pa.array(m.astype(np.int32)), b["phrase"], pa.array(key.view(np.int64)), b["n"]], names=["lang", "m", "phrase", "key", "n"])


def _counted(docs: DataFrame, least: int, asked: list[tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]], bits: dict[str, np.ndarray]) -> DataFrame:
    """(lang, m, phrase, key, n) of the phrases asked for that occur least times, written: (m, all, any) asks for those of m words of which
    every part in all, and some part in any (if there are any), is in its bitmap; a part is (bitmap, its words, how many words stand
    before it). With words of one, the phrase of none counts all words."""
    named = {p[0] for _, every, some in asked for p in [*every, *some]}
    sent = {k: docs.sparkSession.sparkContext.broadcast(v) for k, v in bits.items() if k in named}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in X.blocks(batches, "text"):
            block = Coded(table)
            inside: dict[tuple[str, int], np.ndarray] = {}

            def part(name: str, words: int, before: int, block=block, inside=inside) -> np.ndarray:
                if (name, words) not in inside:
                    inside[name, words] = _has(sent[name].value, block.key(words))
                return _later(inside[name, words], before)

            for m, every, some in asked:
                if m == 1:
                    yield block.totals()
                on = block.whole(m)
                for p in every:
                    on &= part(*p)
                if some:
                    on &= reduce(np.logical_or, [part(*p) for p in some])
                yield block.counts(m, np.flatnonzero(on))
            del block, inside, part

    # blocks have counted already, so tasks don't count once more before the shuffle
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = docs.select("lang", "text").mapInArrow(X.task(run), _COUNTS_SQL).repartition(parts, "lang", "phrase")
    out = out.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == ""))
    out = X.written(out.mapInArrow(X.task(_keyed), _KEYED_SQL))
    for b in sent.values():
        b.destroy()
    return out


def _head(phrase: str, words: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), 1, words), " ")


def _tail(phrase: str, m: Column | int, before: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(1) + before, m - before), " ")


def _ratio(a: Column, whole: Column) -> Column:
    """floor(2,000,000 a / whole), exact also where the product passes 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), whole.cast("decimal(20,0)"))


def scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """phrases (lang, m, phrase, key, n) with the cut that scores lowest: l, r and score. parts (lang, phrase, n) counts the parts; phrases with a
    part that isn't there are left out."""
    f = parts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    cuts = phrases.select("lang", "m", "phrase", "key", "n", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("*", _head("phrase", F.col("k")).alias("first"), _tail("phrase", F.col("m"), F.col("k")).alias("rest"))
    cuts = cuts.join(f, (F.col("lang") == F.col("_lang")) & (F.col("first") == F.col("_part"))).withColumnRenamed("_n", "l").drop("_lang", "_part")
    cuts = cuts.join(f, (F.col("lang") == F.col("_lang")) & (F.col("rest") == F.col("_part"))).withColumnRenamed("_n", "r").drop("_lang", "_part")
    low = cuts.groupBy("lang", "m", "phrase", "key", "n").agg(F.min(F.struct(_ratio(F.col("n"), F.col("l") + F.col("r")).alias("score"), "k", "l", "r")).alias("cut"), F.count("*").alias("cuts"))
    return low.filter("cuts = m - 1").select("lang", "m", "phrase", "key", "n", "cut.l", "cut.r", "cut.score")


def _bounded(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases with bound, which no phrase that extends one passes."""
    f = words.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    out = phrases.withColumn("_first", _head("phrase", 1)).join(f, (F.col("lang") == F.col("_lang")) & (F.col("_first") == F.col("_part")))
    return out.withColumn("bound", _ratio(F.col("n"), F.col("_n") + F.col("n"))).drop("_lang", "_part", "_n", "_first")


def _at_least(phrases: DataFrame, value: str, floors: DataFrame) -> DataFrame:
    return phrases.join(floors, "lang").filter(F.col(value) >= F.col("floor")).drop("floor")


def _unabsorbed(candidates: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """candidates without those that lie in a longer phrase which occurs at least share percent as often. Phrases of one word more are
    enough: what occurs in a still longer one occurs in one of those at least as often."""
    parts = longer.select("lang", "n", F.explode(F.array(_head("phrase", F.col("m") - 1), _tail("phrase", F.col("m"), F.lit(1)))).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    whole = lambda c, k: F.col(c).cast("decimal(20,0)") * F.lit(k).cast("decimal(3,0)")
    return candidates.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (whole("most", 100) < whole("n", share))).drop("most")


def collocations(documents: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, step: int = 2) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the best top phrases.

    Texts (null: empty) are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, pieces at blanks into words. Candidates are
    phrases of 2 to 4 words of a piece with a = f(phrase) >= least. A candidate's score is the lowest floor(2,000,000 a / (l + r))
    of its cuts into l = f(first words) and r = f(rest), of equal ones that of the first cut. A candidate within a longer one that occurs at
    least share percent as often is dropped. n counts the language's words (null: `und`). Rank follows score and a, descending, and
    the phrase's bytes. Repeated rows count each; an empty table gives no rows; further columns are ignored.

    The first floor is the score of the language's pair at place step * top; each further round goes to four times the place.
    """
    spark: SparkSession = documents.sparkSession
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = _counted(docs, least, [(1, [], [])], {})
    totals, words = words.filter("m = 0").select("lang", F.col("n").alias("total")), words.filter("m = 1")
    bits = {"words": bitmap(words)}
    pairs = _counted(docs, least, [(2, [("words", 1, 0), ("words", 1, 1)], [])], bits)
    pairs = _bounded(pairs, words).withColumnRenamed("bound", "_b")
    pairs = X.written(scored(pairs.drop("_b"), words).join(pairs.select("lang", "phrase", F.col("_b").alias("bound")), ["lang", "phrase"]))
    bits["pairs"] = bitmap(pairs)
    known = words.select("lang", "phrase", "n").unionByName(pairs.select("lang", "phrase", "n"))
    best = W.partitionBy("lang").orderBy(F.desc("score"))
    place, open_, settled = step * top, pairs.select("lang").distinct(), []
    rows = lambda df: df.select("lang", "m", "phrase", "key", "n", "l", "r", "score")
    while not open_.isEmpty():
        here = pairs.join(open_, "lang", "left_semi")
        # beyond the last pair nothing is left out
        ranked = here.select("lang", "score", F.row_number().over(best).alias("row")).filter(F.col("row") <= place)
        floors = ranked.groupBy("lang").agg(F.count("*").alias("c"), F.min("score").alias("s")).select("lang", F.when(F.col("c") < place, 0).otherwise(F.col("s")).alias("floor"))
        floors = X.written(floors)
        grown, wanted = X.written(_at_least(here, "bound", floors)), X.written(_at_least(here, "score", floors))
        bits |= {"grow2": bitmap(grown), "want2": bitmap(wanted)}
        both = [("pairs", 2, 0), ("pairs", 2, 1)]
        threes = _counted(docs, least, [(3, both, [("grow2", 2, 0), ("want2", 2, 1)])], bits)
        three = scored(threes, known).join(_bounded(threes, words).select("lang", "phrase", "bound"), ["lang", "phrase"])
        three = X.written(three.join(floors.select("lang"), "lang", "left_semi"))
        grown3, wanted3 = _at_least(three, "bound", floors), _at_least(three, "score", floors)
        # the last three of four words may start with a pair that was not expanded
        ends = grown3.select("lang", _tail("phrase", F.lit(3), F.lit(1)).alias("phrase")).distinct()
        ends = pairs.join(ends, ["lang", "phrase"], "left_semi").join(grown, ["lang", "phrase"], "left_anti")
        bits |= {"grow3": bitmap(grown3), "want3": bitmap(wanted3), "ends": bitmap(ends)}
        asked = [(4, [*both, ("pairs", 2, 2)], [("grow3", 3, 0), ("want3", 3, 1)]), (3, both, [("ends", 2, 0)])]
        more = _counted(docs, least, asked, bits)
        parts = known.unionByName(threes.unionByName(more.filter("m = 3")).select("lang", "phrase", "n").distinct())
        fours = more.filter("m = 4")
        four = _at_least(scored(fours, parts), "score", floors)
        found = rows(_unabsorbed(wanted, threes, share)).unionByName(rows(_unabsorbed(wanted3, fours, share))).unionByName(rows(four))
        found = X.written(found)
        enough = found.groupBy("lang").count().filter(F.col("count") >= top).select("lang").unionByName(floors.filter("floor = 0").select("lang")).distinct()
        settled.append(found.join(enough, "lang", "left_semi"))
        open_ = X.written(open_.join(enough, "lang", "left_anti"))
        place *= 4
    empty = spark.createDataFrame([], "lang string, m int, phrase string, key long, n long, l long, r long, score long")
    every = reduce(DataFrame.unionByName, settled, empty)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase"))
    out = every.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).join(totals, "lang")
    return out.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
