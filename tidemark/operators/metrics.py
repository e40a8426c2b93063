"""Operational metrics: exposition text, series, categories, medians, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAME = "[a-zA-Z_:][a-zA-Z0-9_:]*"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def parse_metrics(lines: DataFrame, endpoint: str) -> DataFrame:
    """Exposition text (value, one line a row) as (name, type, help, labels, value, ts); each sample gets the label endpoint. ts is null
    where the line has no time (milliseconds since 1970)."""
    v = F.trim("value")
    meta = lambda kind: lines.filter(v.rlike(rf"^#\s*{kind} ")).select(F.regexp_extract(v, rf"^#\s*{kind}\s+({NAME})", 1).alias("name"), F.regexp_extract(v, rf"^#\s*{kind}\s+{NAME}\s*(.*)$", 1).alias(kind.lower())).dropDuplicates(["name"])
    s = lines.filter((v != "") & ~v.startswith("#"))
    shape = rf"^({NAME})(\{{.*\}})?\s+(\S+)(?:\s+(-?[0-9]+))?$"
    inner = F.regexp_extract(v, shape, 2)
    values = F.transform(F.regexp_extract_all(inner, F.lit(LABEL), F.lit(2)), lambda x: F.regexp_replace(F.regexp_replace(x, r'\\(["\\])', "$1"), r"\\n", "\n"))
    labels = F.map_from_arrays(F.array_append(F.regexp_extract_all(inner, F.lit(LABEL), F.lit(1)), F.lit("endpoint")), F.array_append(values, F.lit(endpoint)))
    s = s.filter(v.rlike(shape)).select(F.regexp_extract(v, shape, 1).alias("name"), labels.alias("labels"), F.regexp_extract(v, shape, 3).alias("value"), F.timestamp_millis(F.regexp_extract(v, shape, 4).try_cast("long")).alias("ts"))
    return s.join(meta("TYPE"), "name", "left").join(meta("HELP"), "name", "left")


def write_metrics(samples: DataFrame) -> DataFrame:
    """One column, value: the exposition lines, each name's help and type before its samples."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    body = samples.select("name", F.lit(2).alias("k"), F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string")).alias("value"))
    heads = samples.groupBy("name").agg(F.first("help").alias("help"), F.first("type").alias("type"))
    lines = [heads.select("name", F.lit(k).alias("k"), F.concat_ws(" ", F.lit(w), "name", c).alias("value")) for k, (w, c) in enumerate((("#HELP", "help"), ("#TYPE", "type")))]
    return lines[0].union(lines[1]).union(body).orderBy("name", "k", "value").select("value")


def last_n_values(samples: DataFrame, keys: list[str], n: int = 100, unique: str | None = None) -> DataFrame:
    order = [F.col("ts").desc()] + ([F.col(unique).desc()] if unique else [])
    w = W.partitionBy(*keys).orderBy(*order)
    return samples.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def operation_counters(events: DataFrame, by: str, failed) -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("operations"), F.count_if(failed).alias("failed"), F.max("ts").alias("last_ts"), F.max(F.when(failed, F.col("ts"))).alias("last_failed_ts"))


def log_level_counts(events: DataFrame, level: str) -> DataFrame:
    return events.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n"))


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.coalesce(F.median(value), F.lit(0.0)).alias("median"))


def bench_compare(base: DataFrame, candidate: DataFrame, band: float = 0.10) -> DataFrame:
    """(phase, base, candidate, verdict) of medians (phase, median)."""
    j = base.select("phase", F.col("median").alias("base")).join(candidate.select("phase", F.col("median").alias("candidate")), "phase")
    b, c = F.col("base"), F.col("candidate")
    verdict = F.when((b <= 0) | (c <= 0), "n/a").when(F.abs(b - c) / b < band, "no change").when(c < b, F.format_string("%.2fx faster", b / c)).otherwise(F.format_string("%.2fx slower", c / b))
    return j.withColumn("verdict", verdict)


def metric_categories(names: DataFrame, deepest: int = 4) -> DataFrame:
    """(name, category): each name's longest accepted prefix, else its first part.

    Prefixes of one to deepest parts that two names share are candidates, scored count * (1 + depth / 5). One is accepted unless a
    shorter accepted prefix of it ranks before it; as depth is bounded, that many passes settle all.
    """
    n = names.select("name").distinct()
    parts = F.split("name", "_")
    p = n.select("name", F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest)))).alias("depth")).withColumn("prefix", F.array_join(F.slice(parts, 1, F.col("depth")), "_"))
    cand = p.groupBy("prefix", "depth").agg(F.count("*").alias("n")).filter("n >= 2").withColumn("score", F.col("n") * (1 + F.lit(0.2) * F.col("depth")))
    accepted = cand.filter("depth = 1")
    for d in range(2, deepest + 1):
        mine = cand.filter(F.col("depth") == d)
        short = accepted.select(F.col("prefix").alias("_p"), F.col("score").alias("_s"), F.col("depth").alias("_d"))
        ups = mine.select("*", F.explode(F.sequence(F.lit(1), F.lit(d - 1))).alias("_k")).withColumn("_u", F.array_join(F.slice(F.split("prefix", "_"), 1, F.col("_k")), "_"))
        covered = ups.join(short, (F.col("_u") == F.col("_p")) & (F.col("_k") == F.col("_d")) & (F.col("_s") >= F.col("score"))).select("prefix").distinct()
        accepted = accepted.unionByName(mine.join(covered, "prefix", "left_anti").select(accepted.columns))
    best = p.join(accepted.select("prefix", "depth"), ["prefix", "depth"]).groupBy("name").agg(F.max_by("prefix", "depth").alias("category"))
    return n.join(best, "name", "left").withColumn("category", F.coalesce("category", F.element_at(parts, 1)))


def perf_data(samples: DataFrame) -> DataFrame:
    """One line: OK | name=value ..., in order of names."""
    return samples.agg(F.concat(F.lit("OK | "), F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit("="), F.col("value").cast("string")))), " ")).alias("line"))


def phase_weights(phases: DataFrame, cap: int = 85) -> DataFrame:
    """Weights of (job, phase, seq, elapsed): whole percent, at least 1, the phase basebackup at most cap with its surplus shared in
    proportion, the last phase filling up to 100."""
    job = W.partitionBy("job")
    raw = F.greatest(F.lit(1), F.floor(F.lit(100) * F.col("elapsed") / F.sum("elapsed").over(job))).cast("long")
    p = phases.withColumn("w", raw).withColumn("over", F.sum(F.when(F.col("phase") == "basebackup", F.greatest(F.col("w") - cap, F.lit(0))).otherwise(0)).over(job))
    others = F.sum(F.when(F.col("phase") != "basebackup", F.col("w"))).over(job)
    p = p.withColumn("w", F.when(F.col("phase") == "basebackup", F.least(F.col("w"), F.lit(cap))).otherwise(F.col("w") + F.floor(F.col("over") * F.col("w") / others)).cast("long"))
    last = F.col("seq") == F.max("seq").over(job)
    return p.withColumn("weight", F.when(last, F.lit(100) - F.sum("w").over(job) + F.col("w")).otherwise(F.col("w"))).drop("w", "over")


def progress_report(progress: DataFrame) -> DataFrame:
    """percent and remaining of (before, upto, done, total, elapsed): a phase runs from before to upto percent."""
    total = F.greatest("done", "total")
    pct = F.least(F.lit(100), F.col("before") + F.when(total > 0, F.floor(F.col("done") / total * (F.col("upto") - F.col("before")))).otherwise(0)).cast("long")
    p = progress.withColumn("percent", pct)
    return p.withColumn("remaining", F.when((F.col("percent") > 0) & (F.col("percent") < 100), F.col("elapsed") * (100 - F.col("percent")) / F.col("percent")).otherwise(F.lit(0.0)))
