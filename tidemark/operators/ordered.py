"""Values carried along an order of rows, such as the row before, without one task for each key.

A key's rows are cut into bins that follow the order; a window runs within a bin, and what comes from earlier bins is carried by a
table of one row a bin. A hot key is so spread over as many tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of labels: snapshots of one month. Bins of the log: so many bits of a position are within one.
MONTH, LOG_BITS = 6, 30


def by_month(label: str) -> Column:
    return F.left(label, F.lit(MONTH))


def by_log(lsn: str) -> Column:
    return F.shiftright(lsn, LOG_BITS)


def carried(df: DataFrame, by: str, bins: Column, order: list[str], value: Column, to: str, with_own: bool = False, backward: bool = False, largest: bool = False) -> DataFrame:
    """Adds to: the last value that is not null among the rows before this one (with_own: and of this one), in order within by; backward
    the first one among the rows after it; with largest, the largest of them and not the last. bins must never fall along the order. Rows of a null key are a key of their own."""
    d = df.withColumn("_bin", bins).withColumn("_value", value)
    along = [F.desc(c) if backward else F.asc(c) for c in order]
    inside = W.partitionBy(by, "_bin").orderBy(*along).rowsBetween(W.unboundedPreceding, 0 if with_own else -1)
    pick = F.min_by if backward else F.max_by
    ends = d.filter("_value IS NOT NULL").groupBy(by, "_bin").agg((F.max("_value") if largest else pick("_value", F.struct(*order))).alias("_last"))
    all_bins = d.select(by, "_bin").distinct()
    ends = all_bins.join(ends, all_bins[by].eqNullSafe(ends[by]) & all_bins["_bin"].eqNullSafe(ends["_bin"]), "left").select(all_bins[by].alias("_by"), all_bins["_bin"].alias("_of"), "_last")
    before = W.partitionBy("_by").orderBy(F.desc("_of") if backward else F.asc("_of")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("_by", "_of", (F.max("_last") if largest else F.last("_last", ignorenulls=True)).over(before).alias("_carry"))
    d = d.withColumn("_in", (F.max("_value") if largest else F.last("_value", ignorenulls=True)).over(inside))
    out = d.join(ends, d[by].eqNullSafe(ends["_by"]) & d["_bin"].eqNullSafe(ends["_of"]), "left")
    return out.withColumn(to, F.greatest("_in", "_carry") if largest else F.coalesce("_in", "_carry")).drop("_bin", "_value", "_by", "_of", "_in", "_carry")
