"""Joins that Spark has no operator for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps that an interval spans at most, on its level of a range join.
SPAN = 64


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str | None = None, prefix: str = "r_", parts: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before it; right columns are prefixed, and null where there is none.

    Time is cut into `parts` stretches of about as many right rows. Both sides of a key and a stretch are put in one ordered list, and the last right row
    before each left one is looked up by a window; where there is none in the stretch, it is the last of an earlier stretch, which is found among one
    row for each key and stretch. So a key with most of the rows, or no key at all, is dealt to as many tasks. Rows with a null key or time find nothing.
    """
    right_on = right_on or on
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    type_ = right.schema[right_on].dataType
    cuts = []
    if isinstance(type_, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        cuts = right.agg(F.percentile_approx(right_on, [k / parts for k in range(1, parts)] or [0.5]).cast("array<string>")).first()[0] or []
    steps = F.array(*(F.lit(c).cast(type_) for c in dict.fromkeys(cuts))) if cuts else F.array().cast(f"array<{type_.simpleString()}>")

    def stretch(time: str) -> Column:
        return F.size(F.filter(steps, lambda c: c <= F.col(time)))

    keys = [f"_k{i}" for i in range(len(by))]
    others = [c for c in right.columns if c not in by]
    value = F.struct(*(F.col(c).alias(c) for c in others))
    a = left.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(on).alias("_t"), stretch(on).alias("_part"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_right"))
    b = right.filter(F.col(right_on).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(right_on).alias("_t"), stretch(right_on).alias("_part"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), value.alias("_right"))
    order = Window.partitionBy(*keys, "_part").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    found = a.unionAll(b).withColumn("_found", F.last("_right", ignorenulls=True).over(order)).filter("_side = 1")
    # One row for each key and stretch of either side, with the last right row of those before it.
    last = b.groupBy(*keys, "_part").agg(F.max_by("_right", "_t").alias("_last"))
    every = last.unionAll(a.filter(known).select(*keys, "_part").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))).groupBy(*keys, "_part").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).filter("_before is not null").drop("_last")
    out = found.join(carried, [*keys, "_part"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    return out.select("_left.*", *(F.when(known, F.col(f"_found.{c}")).alias(prefix + c) for c in others))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with low <= point <= high. Intervals are cut into steps of `width`, so this is an equi-join with a check, not all pairs.

    An interval of more than SPAN steps is cut into steps SPAN times as wide, and so on; points are looked up on every level that there is, so
    neither side grows with the width of the intervals.
    """
    kept = right.filter(F.col(low) <= F.col(high))
    steps = (F.col(high).cast("double") - F.col(low).cast("double")) / (width * SPAN)
    level = F.when(steps <= 1, 0).otherwise(F.ceil(F.log(steps) / math.log(SPAN))).cast("int")
    kept = kept.withColumn("_level", level)
    levels = sorted(r["_level"] for r in kept.select("_level").distinct().collect())  # as many as a number has powers of SPAN at most
    size = F.lit(float(width)) * F.pow(F.lit(float(SPAN)), F.col("_level"))
    b = kept.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    a = left.withColumn("_level", F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>"))).withColumn("_bin", F.floor(F.col(point) / size))
    return a.join(b, ["_level", "_bin"]).filter((F.col(low) <= F.col(point)) & (F.col(point) <= F.col(high))).drop("_level", "_bin")
