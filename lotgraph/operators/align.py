"""Clock alignment: anchors, robust offsets, drift, application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.functions.values import seconds


def anchors(a: DataFrame, b: DataFrame, keys: list[str], max_seconds: int) -> DataFrame:
    """For each row of a (keys, ts) the nearest row of b with equal keys within max_seconds: keys, ts_a, ts_b, diff.

    The time axis is cut into windows of max_seconds, so a key's rows meet only rows of three neighbouring windows and
    a busy key is spread; ties take the earlier ts_b.
    """
    width = max(1, max_seconds)
    left = a.select(*keys, F.col("ts").alias("ts_a")).distinct()
    left = left.withColumn("_w", F.explode(F.array(*[F.floor(seconds(F.col("ts_a")) / width) + k for k in (-1, 0, 1)])))
    right = b.select(*keys, F.col("ts").alias("ts_b")).distinct().withColumn("_w", F.floor(seconds(F.col("ts_b")) / width))
    diff = seconds(F.col("ts_b")) - seconds(F.col("ts_a"))
    pairs = left.join(right, [*keys, "_w"]).withColumn("diff", diff).where(F.abs("diff") <= max_seconds)
    nearest = F.min(F.struct(F.abs("diff").alias("far"), "ts_b", "diff")).alias("n")
    return pairs.groupBy(*keys, "ts_a").agg(nearest).select(*keys, "ts_a", F.col("n.ts_b").alias("ts_b"), F.col("n.diff").alias("diff"))


def robust_offset(pairs: DataFrame, key: str, k: float = 3.5, least: int = 5) -> DataFrame:
    """key, offset, mad, n, confidence: the median of what lies within k MADs of the first median."""
    first = pairs.groupBy(key).agg(F.median("diff").alias("m"), F.count("diff").alias("all")).where(F.col("all") >= least)
    far = pairs.join(first, key).withColumn("far", F.abs(F.col("diff") - F.col("m")))
    mad = far.groupBy(key).agg(F.median("far").alias("mad0")).select(key, F.when(F.col("mad0") < 1e-6, 1.0).otherwise(F.col("mad0")).alias("mad"))
    near = far.join(mad, key).withColumn("ok", F.col("far") <= k * F.col("mad"))
    near = near.withColumn("kept", F.count_if("ok").over(Window.partitionBy(key))).where(F.col("ok") | (F.col("kept") < least))
    out = near.groupBy(key).agg(F.median("diff").alias("offset"), F.first("mad").alias("mad"), F.count("diff").alias("n"))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 50) / (1 + F.col("mad") / 10))


def drift(pairs: DataFrame, key: str, day: str, per_day: int = 3, days: int = 3, least: int = 9, limit: float = 1.0) -> DataFrame:
    """key, slope, intercept, r2, significant: the line of diff over day, from days with enough anchors."""
    counted = pairs.withColumn("_n", F.count("diff").over(Window.partitionBy(key, day))).where(F.col("_n") >= per_day)
    out = counted.groupBy(key).agg(F.regr_slope("diff", day).alias("slope"), F.regr_intercept("diff", day).alias("intercept"), F.when(F.var_pop("diff") == 0, 0.0).otherwise(F.regr_r2("diff", day)).alias("r2"), F.count_distinct(day).alias("days"), F.count("diff").alias("n"))
    out = out.where((F.col("days") >= days) & (F.col("n") >= least) & F.col("slope").isNotNull())
    return out.withColumn("significant", F.abs("slope") > limit)


def anchor_audit(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count("diff").alias("n"), F.median("diff").alias("median"), F.stddev_samp("diff").alias("std"))


def apply_offset(events: DataFrame, offsets: DataFrame, key: str, faithful: bool = False) -> DataFrame:
    """events (key, ts) with ts_aligned = ts + offset + drift * days since base; raw without an offset.

    offsets: key, offset and, if the clocks drift, drift (seconds a day) and base (the first day).  faithful: minus,
    which doubles the error.
    """
    drifts = "drift" in offsets.columns
    days = F.datediff(F.to_date("ts"), F.col("base")) if drifts else F.lit(0)
    total = F.coalesce(F.col("offset") + (F.coalesce("drift", F.lit(0.0)) if drifts else F.lit(0.0)) * days, F.lit(0.0))
    shift = F.make_dt_interval(secs=total * (-1 if faithful else 1))
    return events.join(offsets.select(key, "offset", *(["drift", "base"] if drifts else [])), key, "left").withColumn("ts_aligned", F.col("ts") + shift)
