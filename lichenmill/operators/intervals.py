"""Merging of half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions that one task's run of a group spans at first.
STRETCH = 1 << 20


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The intervals (__lo, __hi) of each group of ``keys``, merged by gaps and islands over a spillable sort."""
    order = Window.partitionBy(*keys).orderBy("__lo", "__hi")
    reach = F.max("__hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("__lo") > reach), 1).otherwise(0)
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("__new", fresh).withColumn("__island", island)
    return marked.groupBy(*keys, "__island").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")).drop("__island")


def compress_intervals(df: DataFrame, keys: list[str] | str, start: str = "start", stop: str = "stop", stretch: int = STRETCH) -> DataFrame:
    """keys, start, stop: one row a merged interval.

    Rows with a NULL end are ignored, swapped ends are turned, and intervals that touch merge. Intervals
    are merged within stretches of ``stretch`` positions first, so that a group with most rows is as
    many tasks as it has stretches; what is left of them is merged across.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    a, b = F.col(start).cast("bigint"), F.col(stop).cast("bigint")
    rows = df.where(a.isNotNull() & b.isNotNull()).select(*keys, F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi"))
    dealt = rows.withColumn("__stretch", F.floor(F.col("__lo") / stretch))
    near = _islands(dealt, [*keys, "__stretch"]).drop("__stretch")
    return _islands(near, keys).select(*keys, F.col("__lo").alias(start), F.col("__hi").alias(stop))


def compress_intervals_list(df: DataFrame, keys: list[str] | str, start: str = "start", stop: str = "stop") -> DataFrame:
    """keys, intervals: the merged intervals of each group as a sorted list of structs; NULL for a group without any."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    merged = compress_intervals(df, keys, start, stop)
    lists = merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("start"), F.col(stop).alias("stop")))).alias("intervals"))
    every = df.select(*keys).distinct()
    same = None
    left, right = every.alias("l"), lists.alias("r")
    for k in keys:
        c = F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
        same = c if same is None else same & c
    return left.join(right, same, "left").select(*[f"l.`{k}`" for k in keys], "r.intervals")


def merge_interval_array(intervals: Column) -> Column:
    """The same for an array of struct(start, stop) in one row; NULL if no element has both ends."""
    whole = F.filter(intervals, lambda x: x["start"].isNotNull() & x["stop"].isNotNull())
    pair = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("stop"))
    ordered = F.array_sort(F.transform(whole, lambda x: pair(F.least(x["start"], x["stop"]), F.greatest(x["start"], x["stop"]))))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(pair(last["start"], F.greatest(last["stop"], x["stop"]))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["stop"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.when(F.size(whole) > 0, F.aggregate(ordered, none, step))
