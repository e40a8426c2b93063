"""The catalog of snapshots: rows (server, label, size, valid, keep, type, parent_label, ...)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import shared
from tidemark.functions.scalar import ratio, throughput
from tidemark.operators.ordered import by_log, by_month, carried

#: Chains of fewer rows are sent to the tasks that look for their parents.
SENT_ROWS = 50_000


def list_backups(catalog: DataFrame, descending: bool = False) -> DataFrame:
    return catalog.orderBy("server", F.col("label").desc() if descending else F.col("label"))


def backup_info(catalog: DataFrame, server, which: str) -> DataFrame:
    """One row: by label, or the oldest, newest or latest."""
    c = catalog.filter(F.col("server") == server)
    if which in ("oldest", "newest", "latest"):
        return c.orderBy(F.col("label") if which == "oldest" else F.col("label").desc()).limit(1)
    return c.filter(F.col("label") == which)


def backup_relatives(catalog: DataFrame) -> DataFrame:
    """(server, label, parent_label, child_label): the child is the first snapshot that names this one as parent."""
    child = catalog.filter("parent_label IS NOT NULL").groupBy("server", F.col("parent_label").alias("label")).agg(F.min("label").alias("child_label"))
    return catalog.select("server", "label", "parent_label").join(child, ["server", "label"], "left")


def _links(catalog: DataFrame) -> DataFrame:
    """(server, label, up): the parent of each snapshot that is not full, where the catalog has it."""
    own = catalog.filter("type <> 'full'").select("server", "label", F.col("parent_label").alias("up"))
    return own.join(catalog.select("server", F.col("label").alias("up")), ["server", "up"]).select("server", "label", "up").distinct()


def _jumps(links: DataFrame) -> Iterator[DataFrame]:
    """(server, label, up) with up 1, 2, 4, ... parents above label, until no chain is that long."""
    jump, steps = shared.written(links), 1
    n = jump.count()
    while not jump.isEmpty():
        if steps > n:
            raise ValueError("parents of a snapshot lead back to it")
        yield jump
        further = jump.select("server", F.col("label").alias("up"), F.col("up").alias("_up"))
        jump, steps = shared.written(jump.join(further, ["server", "up"]).select("server", "label", F.col("_up").alias("up"))), steps * 2


def backup_chain(catalog: DataFrame) -> DataFrame:
    """(server, label, ancestor, depth): each snapshot and its parents up to the first full one; broken where a parent is missing.

    Chains double in each round, so neither their length nor the number of rows is limited; one that leads back to itself is an error.
    """
    chain = catalog.select("server", "label", F.col("label").alias("ancestor"), F.lit(0).alias("depth"))
    for k, jump in enumerate(_jumps(_links(catalog))):
        up = jump.select("server", F.col("label").alias("ancestor"), "up")
        chain = shared.kept(chain.union(chain.join(up, ["server", "ancestor"]).select("server", "label", F.col("up").alias("ancestor"), (F.col("depth") + (1 << k)).cast("int").alias("depth"))))
    return chain


def backup_root(catalog: DataFrame, strict: bool = False) -> DataFrame:
    """(server, label, root, depth). A snapshot whose parent is missing is the root of those above it; where strict, it is an error.

    Each round takes every snapshot to where its ancestor has got to, so rows stay as many as snapshots and rounds are few.
    """
    links = _links(catalog)
    at = catalog.select("server", "label").distinct().join(links, ["server", "label"], "left")
    at = shared.kept(at.select("server", "label", F.coalesce("up", "label").alias("root"), F.col("up").isNotNull().cast("int").alias("depth")))
    n, steps, moved = at.count(), 1, True
    while moved:
        if steps > 2 * n:
            raise ValueError("parents of a snapshot lead back to it")
        further = at.filter("depth > 0").select("server", F.col("label").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        more = at.join(further, ["server", "root"], "left")
        more = shared.kept(more.select("server", "label", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_depth").isNotNull().alias("moved")))
        moved, at, steps = not more.filter("moved").isEmpty(), more.drop("moved"), steps * 2
    out = at.groupBy("server", "label").agg(F.max_by("root", "depth").alias("root"), F.max("depth").alias("depth"))
    if strict:
        full = catalog.filter("type = 'full'").select("server", F.col("label").alias("root"), F.lit(True).alias("_full")).distinct()
        whole = F.when(F.col("_full"), F.col("root")).otherwise(F.raise_error(F.concat(F.lit("the chain lacks the parent of "), F.col("root"))))
        out = out.join(full, ["server", "root"], "left").select("server", "label", whole.alias("root"), "depth")
    return out


def label_chains(catalog: DataFrame, asked: DataFrame, inclusive: bool = True, strict: bool = True) -> DataFrame:
    """(server, newest, oldest, label, depth) of the chain of each row asked for (server, newest, oldest): from newest (itself only where
    inclusive) down to oldest, or where that is null to the first full snapshot.

    Only these chains are followed, by doubling, and no further than they reach. When the rows are computed, an error is raised for a newest that the
    catalog lacks or that is its own oldest, and for a chain that ends before it gets there, as a parent is missing or oldest isn't in it; where not
    strict, such chains are left out instead.
    """
    asked = asked.select("server", "newest", "oldest").distinct()
    c = catalog.select(F.col("server").alias("_s"), F.col("label").alias("_l"), "type", "parent_label")
    key = ["server", "newest", "oldest"]
    chain = shared.kept(asked.select(*key, F.col("newest").alias("label"), F.lit(0).alias("depth")))
    # parents that the catalog lacks have no parents themselves, so they can only end a chain, and are dropped below
    links = catalog.filter("type <> 'full' AND parent_label IS NOT NULL").select("server", "label", F.col("parent_label").alias("up")).distinct()
    rows = chain.count()
    sent = lambda df: F.broadcast(df) if rows < SENT_ROWS else df
    for k, jump in enumerate(_jumps(links)):
        further = shared.kept(jump.join(sent(chain), ["server", "label"]).select(*key, F.col("up").alias("label"), (F.col("depth") + (1 << k)).cast("int").alias("depth")))
        if further.isEmpty():
            break
        chain = shared.kept(chain.union(further))
        rows = chain.count()
    there = c.join(sent(chain.select(F.col("server").alias("_s"), F.col("label").alias("_l")).distinct()), ["_s", "_l"], "left_semi")
    known = chain.join(there, (F.col("server") == F.col("_s")) & (F.col("label") == F.col("_l")), "left").filter("depth = 0 OR _l IS NOT NULL")
    known = shared.kept(known.select(*key, F.col("_l").alias("label"), "depth", "type", "parent_label").distinct())
    ends = known.groupBy(*key).agg(F.max_by(F.struct("label", "type", "parent_label"), "depth").alias("end"), F.max(F.when(F.col("label") == F.col("oldest"), F.col("depth"))).alias("at"), F.max("depth").alias("deepest"))
    fails = lambda *cs: (F.raise_error(F.concat(*cs)) if strict else F.lit(None)).cast("int")
    stop = (
        F.when(F.col("end.label").isNull(), fails(F.lit("there is no snapshot "), "newest"))
        .when(F.col("newest") == F.col("oldest"), fails(F.lit("the newest snapshot of a chain can't be its oldest: "), "newest"))
        .when(F.col("oldest").isNotNull() & F.col("at").isNotNull(), F.col("at"))
        .when(F.col("oldest").isNull() & (F.col("end.type") == "full"), F.col("deepest"))
        .otherwise(fails(F.lit("the chain of "), "newest", F.lit(" ends at "), "end.label", F.lit(" without "), F.coalesce("oldest", "end.parent_label", F.lit("a full snapshot"))))
    )
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in key], stop.alias("stop"))
    out = known.select(*key, "label", "depth").distinct().join(ends, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).filter((F.col("depth") <= F.col("stop")) & (F.col("depth") >= (0 if inclusive else 1)))
    return out.select(*key, "label", "depth")


def resolve_targets(catalog: DataFrame, targets: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adds label to targets (server and any of time, lsn and timeline; the first of lsn, time and timeline that a target has counts): its
    newest valid snapshot, or null. Labels are times, so the largest is the newest.

    A time takes a snapshot with label <= time, a position one with start_lsn <= lsn, a timeline one that starts on it. Where history (server,
    tli, parent_tli, switch_lsn; of every timeline all that it comes from, as history files have them) is given and a target has both
    lsn and timeline, its snapshot must start on that timeline or, before they part, on one that it comes from.

    Each kind is one pass over targets and snapshots in one order. Repeated targets are resolved once each.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in targets.columns else F.lit(None).cast(kind)
    t = targets.select(F.col("server"), has("time", "string").alias("time"), has("lsn", "long").alias("lsn"), has("timeline", "long").alias("timeline")).distinct()
    good = catalog.filter("valid")
    null = lambda kind: F.lit(None).cast(kind)

    def as_of(backups: DataFrame, asked: DataFrame, bins) -> DataFrame:
        """asked (by, at) with found: the largest label among the backups (by, at, label) up to it."""
        both = backups.select("by", "at", F.lit(0).alias("k"), "label").unionByName(asked.select("by", "at").distinct().select("by", "at", F.lit(1).alias("k"), null("string").alias("label")))
        return carried(both, "by", bins, ["at", "k"], F.col("label"), "found", with_own=True, largest=True).filter("k = 1").select("by", "at", "found")

    same = lambda a, b, *cs: [a[c].eqNullSafe(b[c]) for c in cs]
    times = t.filter("lsn IS NULL AND time IS NOT NULL")
    f = as_of(good.select(F.struct("server").alias("by"), F.col("label").alias("at"), "label"), times.select(F.struct("server").alias("by"), F.col("time").alias("at")), by_month("at"))
    f = f.select(F.col("by.server").alias("server"), F.col("at").alias("time"), "found")
    out = [times.join(f, same(times, f, "server", "time"), "left").select(times["*"], F.col("found").alias("label"))]

    if "start_lsn" in catalog.columns:
        both = history is not None
        plain = t.filter("lsn IS NOT NULL" + (" AND timeline IS NULL" if both else ""))
        f = as_of(good.select(F.struct("server").alias("by"), F.col("start_lsn").alias("at"), "label"), plain.select(F.struct("server").alias("by"), F.col("lsn").alias("at")), by_log("at"))
        f = f.select(F.col("by.server").alias("server"), F.col("at").alias("lsn"), "found")
        out.append(plain.join(f, same(plain, f, "server", "lsn"), "left").select(plain["*"], F.col("found").alias("label")))
        if both:
            branch = t.filter("lsn IS NOT NULL AND timeline IS NOT NULL")
            h = history.select(F.col("server").alias("_s"), F.col("tli").alias("_t"), F.col("parent_tli").cast("long").alias("on"), F.col("switch_lsn").alias("_cut")).distinct()
            above = branch.join(h, (F.col("server") == F.col("_s")) & (F.col("timeline") == F.col("_t"))).select("server", "lsn", "timeline", "on", F.least("lsn", F.col("_cut")).alias("upto"))
            ways = branch.select("server", "lsn", "timeline", F.col("timeline").alias("on"), F.col("lsn").alias("upto")).unionByName(above)
            f = as_of(good.select(F.struct("server", F.col("start_timeline").cast("long").alias("on")).alias("by"), F.col("start_lsn").alias("at"), "label"), ways.select(F.struct("server", "on").alias("by"), F.col("upto").alias("at")), by_log("at"))
            f = f.select(F.col("by.server").alias("server"), F.col("by.on").alias("on"), F.col("at").alias("upto"), "found")
            w = ways.join(f, ["server", "on", "upto"], "left").groupBy("server", "lsn", "timeline").agg(F.max("found").alias("found"))
            out.append(branch.join(w, same(branch, w, "server", "lsn", "timeline"), "left").select(branch["*"], F.col("found").alias("label")))
    if "start_timeline" in catalog.columns:
        lines = t.filter("lsn IS NULL AND time IS NULL AND timeline IS NOT NULL")
        w = good.groupBy("server", F.col("start_timeline").cast("long").alias("timeline")).agg(F.max("label").alias("found"))
        out.append(lines.join(w, same(lines, w, "server", "timeline"), "left").select(lines["*"], F.col("found").alias("label")))
    every = reduce(DataFrame.unionByName, out)
    return every.select("server", *[c for c in ("time", "lsn", "timeline") if c in targets.columns], "label")


def remote_reconcile(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds verify: remote for labels that the listing (server, label) has, else local."""
    there = listing.select("server", "label").distinct().withColumn("_r", F.lit(True))
    return catalog.join(there, ["server", "label"], "left").withColumn("verify", F.when(F.col("_r"), "remote").otherwise("local")).drop("_r")


def wal_between(segments: DataFrame, backups: DataFrame, bins: int = 16) -> DataFrame:
    """For each backup (server, label, wal) how many segments (server, name) there are from its own up to the next backup's.

    One pass: backups and segments of a server go in one order, and each segment counts for the last backup at or before it. Later
    labels start at no earlier segment; of backups that start at one segment the last label gets its segments. bins is the length of
    the start of names that segments of one task share.
    """
    b = backups.select("server", F.col("wal").alias("at"), F.lit(0).alias("k"), "label")
    s = segments.select("server", F.col("name").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("label"))
    own = carried(b.union(s), "server", F.left("at", F.lit(bins)), ["at", "k", "label"], F.col("label"), "of").filter("k = 1 AND of IS NOT NULL")
    n = own.groupBy("server", F.col("of").alias("label")).agg(F.count("at").alias("segments"))
    return backups.select("server", "label").join(n, ["server", "label"], "left").withColumn("segments", F.coalesce("segments", F.lit(0)))


def backup_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("server").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


def oldest_newest(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("server").agg(F.min("label").alias("oldest"), F.min_by("size", "label").alias("oldest_size"), F.max("label").alias("newest"), F.max_by("size", "label").alias("newest_size"))


def space_usage(files: DataFrame, by: str = "server") -> DataFrame:
    return files.groupBy(by).agg(F.sum("size").alias("total"), F.count("*").alias("files"), F.max("size").alias("biggest"))


def tree_usage(files: DataFrame, levels: int = 32) -> DataFrame:
    """(folder, total, files, biggest) of every folder, with all that is below it, of files (path, size). The root's folder is the empty
    text. One aggregation a level of the tree, from the deepest up: a level adds what is directly in its folders to what came up from
    below, so a file counts once and not once for each folder above it. A path of more than levels folders is an error."""
    up = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    sums = [F.sum("total").alias("total"), F.sum("files").alias("files"), F.max("biggest").alias("biggest")]
    own = files.select(up(F.col("path")).alias("folder"), F.col("size").alias("total"), F.lit(1).cast("long").alias("files"), F.col("size").alias("biggest")).groupBy("folder").agg(*sums)
    own = shared.kept(own.withColumn("depth", depth))
    deepest = own.agg(F.max("depth")).first()[0] or 0
    if deepest > levels:
        raise ValueError(f"a path has {deepest} folders, more than {levels}")
    every, below = [], None
    for d in range(deepest, -1, -1):
        here = own.filter(F.col("depth") == d).drop("depth")
        if below is not None:
            here = here.unionByName(below.withColumn("folder", up(F.col("folder")))).groupBy("folder").agg(*sums)
        below = shared.kept(here)
        every.append(below)
    return reduce(DataFrame.unionByName, every)


def wal_usage(segments: DataFrame, start: str = "") -> DataFrame:
    """(server, total, files) of the log segments (server, name, size) from a name on."""
    return segments.filter(F.col("name") >= start).groupBy("server").agg(F.sum("size").alias("total"), F.count("*").alias("files"))


def server_status(catalog: DataFrame, settings: DataFrame | None = None, defaults: dict[str, int] | None = None, details: bool = False) -> DataFrame:
    """One row a server: its snapshots, sizes and flags. With settings (server and any of workers, days, weeks, months, years) every server of
    it has a row with its own value of each, or defaults' where it has none or -1. With details, backups lists its snapshots in
    order: (label, type, size, valid, keep)."""
    more = [F.array_sort(F.collect_list(F.struct("label", "type", "size", "valid", "keep"))).alias("backups")] if details else []
    out = catalog.groupBy("server").agg(
        F.count("*").alias("n_backups"), F.sum("size").alias("total_size"), F.count_if("keep").alias("n_kept"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(F.col("type") == "full").alias("n_full"), *more
    )
    if settings is None:
        return out
    s = settings.join(out, "server", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_backups", "total_size", "n_kept", "n_invalid", "n_full")]
    return s.select("server", *[_setting(c, defaults or {}).alias(c) for c in settings.columns if c != "server"], *counts, *(["backups"] if details else []))


def _setting(column: str, defaults: dict[str, int]):
    """A server's own value, or the default where it is null or -1."""
    own = F.nullif(F.col(column), F.lit(-1))
    return F.coalesce(own, F.lit(defaults.get(column, -1)))


#: Fixed names: the times of a snapshot's phases.
PHASES = ("total", "basebackup", "manifest", "hash", "compression_zstd", "compression_gzip", "compression_bzip2", "compression_lz4", "encryption", "linking", "remote_ssh", "remote_s3", "remote_azure")
#: Sizes, positions and timelines that a catalog may have, as they stand.
PLAIN_GAUGES = ("restore_size", "biggest_file_size", "major_version", "minor_version", "start_timeline", "end_timeline", "start_lsn", "checkpoint_lsn", "end_lsn")


def catalog_gauges(catalog: DataFrame, servers: DataFrame) -> DataFrame:
    """Long samples (server, label, metric, value) of every snapshot: validity, retention, sizes, versions, timelines and positions, the
    ratio of its own to its restored size, and for each phase (elapsed_*) its seconds and its throughput in MB/s; of the columns
    that the catalog lacks there are none, and values that are null are 0. A server without snapshots has one row of 0 for each metric, label null."""
    size = F.col("size").cast("double")
    out = {"backup_size": size, "backup_valid": F.col("valid").cast("double"), "backup_retain": F.col("keep").cast("double")}
    out |= {f"backup_{c}": F.col(c).cast("double") for c in PLAIN_GAUGES if c in catalog.columns}
    if "restore_size" in catalog.columns:
        out["backup_ratio"] = ratio(size, F.col("restore_size").cast("double"))
    for p in PHASES:
        if f"elapsed_{p}" in catalog.columns:
            seconds = F.col(f"elapsed_{p}").cast("double")
            out |= {f"backup_elapsed_{p}": seconds, f"backup_{p}_mbs": F.round(throughput(size, seconds), 4)}
    wide = catalog.select("server", "label", *[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in out.items()])
    long = wide.unpivot(["server", "label"], list(out), "metric", "value")
    none = servers.select("server").distinct().join(catalog.select("server").distinct(), "server", "left_anti")
    none = none.select("server", F.lit(None).cast("string").alias("label"), F.explode(F.array(*map(F.lit, out))).alias("metric"), F.lit(0.0).alias("value"))
    return long.unionByName(none)


def retention_anchors(spark, now: dt.date, weeks: int, months: int, years: int, weeks_mode: str = "consecutive") -> DataFrame:
    """Days of which the last snapshot stays; -1 switches a rule off."""
    days: set[dt.date] = set()
    monday = now - dt.timedelta(days=now.weekday())
    for j in range(max(weeks, 0)):
        days.add(monday - dt.timedelta(days=7 * (j if weeks_mode == "consecutive" else j * (j + 1) // 2)))
    for j in range(max(months, 0)):
        m = now.year * 12 + now.month - 1 - j
        days.add(dt.date(m // 12, m % 12 + 1, 1))
    days.update(dt.date(now.year - j, 1, 1) for j in range(max(years, 0)))
    return spark.createDataFrame([(d.strftime("%Y%m%d"),) for d in sorted(days)], "day string")


def retention_mark(catalog: DataFrame, now: dt.date, days: int = 7, weeks: int = -1, months: int = -1, years: int = -1, weeks_mode: str = "consecutive") -> DataFrame:
    """Adds marked: labels of the last days, and of each anchor day the latest."""
    anchors = retention_anchors(catalog.sparkSession, now, weeks, months, years, weeks_mode).withColumn("_a", F.lit(True))
    day = F.left("label", F.lit(8))
    last = F.row_number().over(W.partitionBy("server", "day").orderBy(F.col("label").desc())) == 1
    c = catalog.withColumn("day", day).withColumn("_last", last).join(anchors, "day", "left")
    since = (now - dt.timedelta(days=days)).strftime("%Y%m%d000000")
    recent = F.lit(False) if days < 0 else F.col("label") >= since
    return c.withColumn("marked", recent | (F.col("_last") & F.coalesce("_a", F.lit(False)))).drop("day", "_last", "_a")


def _anchors_by_server(policies: DataFrame, now: dt.date, weeks_mode: str) -> DataFrame:
    """(server, day) of the days of which a server keeps the last snapshot, of policies (server, weeks, months, years)."""
    today, upto = F.lit(now), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    monday = F.date_sub(F.trunc(today, "week"), 0)
    back = (lambda j: j * 7) if weeks_mode == "consecutive" else (lambda j: F.expr("0") + (j * (j + 1) / 2).cast("int") * 7)
    days = {
        "weeks": lambda j: F.date_sub(monday, back(j).cast("int")),
        "months": lambda j: F.add_months(F.trunc(today, "month"), -j),
        "years": lambda j: F.add_months(F.trunc(today, "year"), -12 * j),
    }
    each = [F.when(F.col(c) > 0, F.transform(upto(c), f)).otherwise(F.array().cast("array<date>")) for c, f in days.items()]
    return policies.select("server", F.explode(F.array_distinct(F.concat(*each))).alias("day")).select("server", F.date_format("day", "yyyyMMdd").alias("day"))


def retention_mark_by_server(catalog: DataFrame, now: dt.date, policies: DataFrame, defaults: dict[str, int] | None = None, weeks_mode: str = "consecutive") -> DataFrame:
    """Like retention_mark, with policies (server and any of days, weeks, months, years) of each server; where a server or a value is
    missing, null or -1, defaults hold (days 7, the others off, where they don't say)."""
    base = {"days": 7, "weeks": -1, "months": -1, "years": -1} | (defaults or {})
    p = catalog.select("server").distinct().join(policies.dropDuplicates(["server"]), "server", "left")
    own = lambda c: _setting(c, base) if c in policies.columns else F.lit(base[c])
    p = p.select("server", *[own(c).cast("int").alias(c) for c in base])
    anchors = _anchors_by_server(p, now, weeks_mode).withColumn("_a", F.lit(True))
    last = F.row_number().over(W.partitionBy("server", "day").orderBy(F.col("label").desc())) == 1
    c = catalog.withColumn("day", F.left("label", F.lit(8))).withColumn("_last", last).join(anchors, ["server", "day"], "left").join(p.select("server", "days"), "server")
    recent = (F.col("days") >= 0) & (F.col("label") >= F.date_format(F.date_sub(F.lit(now), F.col("days")), "yyyyMMdd000000"))
    return c.withColumn("marked", recent | (F.col("_last") & F.coalesce("_a", F.lit(False)))).select(*catalog.columns, "marked")


def retention_plan(catalog: DataFrame, now: dt.date, policies: DataFrame | None = None, defaults: dict[str, int] | None = None, **policy) -> DataFrame:
    """(server, label) to delete in this run: per server the oldest that is unmarked, not kept and nobody's parent. One policy holds for all, or
    each server of policies has its own, with defaults where it has none."""
    marked = retention_mark(catalog, now, **policy) if policies is None else retention_mark_by_server(catalog, now, policies, defaults, **policy)
    parents = catalog.filter("parent_label IS NOT NULL").select("server", F.col("parent_label").alias("label")).distinct()
    free = marked.filter("NOT marked AND NOT keep").join(parents, ["server", "label"], "left_anti")
    return free.groupBy("server").agg(F.min("label").alias("label"))


def size_increment(catalog: DataFrame) -> DataFrame:
    """Adds increment: a snapshot's size less that of the one before (where there is none, or one without size: less 0)."""
    c = carried(catalog, "server", by_month("label"), ["label"], F.struct("size"), "_before")
    return c.withColumn("increment", F.col("size") - F.coalesce("_before.size", F.lit(0))).drop("_before")


def valid_neighbours(catalog: DataFrame) -> DataFrame:
    good = F.when(F.col("valid"), F.col("label"))
    c = carried(catalog.select("server", "label", "valid"), "server", by_month("label"), ["label"], good, "previous_valid")
    return carried(c, "server", by_month("label"), ["label"], good, "next_valid", backward=True).select("server", "label", "previous_valid", "next_valid")


def link_base(catalog: DataFrame) -> DataFrame:
    """(server, label, base): of each server's newest snapshot the nearest earlier valid one of its major version."""
    newest = catalog.groupBy("server").agg(F.max("label").alias("_new"), F.max_by("major_version", "label").alias("_major"))
    older = catalog.filter("valid").join(newest, "server").filter((F.col("label") < F.col("_new")) & (F.col("major_version") == F.col("_major")))
    base = older.groupBy("server").agg(F.max("label").alias("base"))
    return newest.select("server", F.col("_new").alias("label")).join(base, "server", "left").select("server", "label", "base")


def wal_delta(catalog: DataFrame) -> DataFrame:
    """Log bytes between a backup and the one before: lsn grows along the labels."""
    c = carried(catalog, "server", by_month("label"), ["label"], F.struct("start_lsn"), "_before")
    return c.withColumn("wal_delta", F.coalesce(F.col("start_lsn") - F.col("_before.start_lsn"), F.lit(0))).drop("_before")


def keep(catalog: DataFrame, server, label: str, flag: bool = True, cascade: bool = False) -> DataFrame:
    """Sets the flag on a snapshot, with cascade on its ancestors too: the one chain is followed, within its server."""
    own = catalog.filter(F.col("server") == server)
    chain = own.filter(F.col("label") == label).select("server", "label").distinct()
    if cascade:
        for jump in _jumps(_links(own)):
            chain = shared.kept(chain.union(chain.join(jump, ["server", "label"]).select("server", F.col("up").alias("label"))).distinct())
    hit = chain.withColumn("_h", F.lit(True))
    return catalog.join(hit, ["server", "label"], "left").withColumn("keep", F.when(F.col("_h"), F.lit(flag)).otherwise(F.col("keep"))).drop("_h")


def delete_backup(catalog: DataFrame, server, label: str, force: bool = False) -> DataFrame:
    """catalog without the snapshot; a kept one stays unless forced; a child takes over its parent and, from a full one, its type."""
    me = catalog.filter((F.col("server") == server) & (F.col("label") == label))
    if not force:
        me = me.filter(~F.col("keep"))
    gone = me.select(F.col("server").alias("_s"), F.col("label").alias("_l"), F.col("type").alias("_t"), F.col("parent_label").alias("_p"))
    rest = catalog.join(me.select("server", "label"), ["server", "label"], "left_anti").select(catalog.columns)
    j = rest.join(gone, (F.col("server") == F.col("_s")) & (F.col("parent_label") == F.col("_l")), "left")
    taken = F.col("_l").isNotNull()
    return j.withColumn("type", F.when(taken & (F.col("_t") == "full"), F.lit("full")).otherwise(F.col("type"))).withColumn("parent_label", F.when(taken, F.when(F.col("_t") != "full", F.col("_p"))).otherwise(F.col("parent_label"))).drop("_s", "_l", "_t", "_p")


def prune_wal(segments: DataFrame, first_needed: str | None) -> DataFrame:
    return segments if first_needed is None else segments.filter(F.col("name") < first_needed)


def select_wal(segments: DataFrame, start: str) -> DataFrame:
    base = F.regexp_replace("name", r"\.partial$", "")
    return segments.filter(F.left(base, F.lit(24)) >= start).withColumn("out", base)


def annotate(catalog: DataFrame, action: str, key: str, comment: str = "") -> DataFrame:
    """comments (k|v,k|v) after adding, updating or removing a key, with status ok or failed; order is kept."""
    items = F.filter(F.split(F.coalesce("comments", F.lit("")), ","), lambda x: x != "")
    has = F.exists(items, lambda x: F.substring_index(x, "|", 1) == key)
    one = F.lit(f"{key}|{comment}")
    new = {
        "add": F.array_append(items, one),
        "update": F.transform(items, lambda x: F.when(F.substring_index(x, "|", 1) == key, one).otherwise(x)),
        "remove": F.filter(items, lambda x: F.substring_index(x, "|", 1) != key),
    }[action]
    good = ~has if action == "add" else has
    return catalog.withColumn("status", F.when(good, "ok").otherwise("failed")).withColumn("comments", F.when(good, F.array_join(new, ",")).otherwise(F.col("comments")))
