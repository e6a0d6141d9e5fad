"""Process-control signals over ordered series: columns series, ord (a total order), value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.operators.running import ranges_of, running


BLOCK = 8192  # points of a series that are looked at together
REACH = 8  # points that a rule looks ahead


def _base(df: DataFrame) -> DataFrame:
    """series, value, mean, std, n, i (the point's place from 0) of series of three points and more."""
    rows = df.where("value is not null and not isnan(value)").select("series", "ord", "value")
    spread = rows.groupBy("series").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")).where("n >= 3")
    placed = running(rows, ["series"], ranges_of(df, "ord"), [F.col("ord")], {"i": ("sum", F.lit(1))})
    return placed.withColumn("i", F.col("i") - 1).join(spread, "series").select("series", "value", "mean", "std", "n", "i")


def _blocks(df: DataFrame) -> DataFrame:
    """_base with a block of BLOCK points for each row, and of the next block's first REACH points a second row in it.

    What starts at a point of the block is told by the block's rows alone; start tells these points.
    """
    base = _base(df).withColumn("own", F.floor(F.col("i") / BLOCK))
    early = F.pmod("i", F.lit(BLOCK)) < REACH
    out = base.withColumn("block", F.explode(F.when(early & (F.col("own") > 0), F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    return out.withColumn("start", F.col("block") == F.col("own")).drop("own")


def _next(last: int):
    return Window.partitionBy("series", "block").orderBy("i").rowsBetween(0, last)


def nelson1(df: DataFrame) -> DataFrame:
    """A point beyond three sigmas: series, start, end, side."""
    out = _base(df).where("std > 0 and abs(value - mean) > 3 * std")
    return out.select("series", F.col("i").alias("start"), F.col("i").alias("end"), F.when(F.col("value") > F.col("mean"), "above").otherwise("below").alias("side"))


def nelson2(df: DataFrame, size: int = 9) -> DataFrame:
    """Nine points in a row on one side of the mean."""
    w = _next(size - 1)
    out = _blocks(df).withColumns({"lo": F.min("value").over(w), "hi": F.max("value").over(w), "k": F.count("value").over(w)}).where(f"start and k = {size} and (lo > mean or hi < mean)")
    return out.select("series", F.col("i").alias("start"), (F.col("i") + size - 1).alias("end"), F.when(F.col("lo") > F.col("mean"), "above").otherwise("below").alias("side"))


def nelson3(df: DataFrame, size: int = 6) -> DataFrame:
    """Six points in a row all rising or all falling."""
    step = F.signum(F.lead("value").over(Window.partitionBy("series", "block").orderBy("i")) - F.col("value"))
    w = _next(size - 2)
    out = _blocks(df).withColumn("step", step).withColumns({"up": F.sum("step").over(w), "k": F.count("step").over(w)}).where(f"start and k = {size - 1} and abs(up) = {size - 1}")
    return out.select("series", F.col("i").alias("start"), (F.col("i") + size - 1).alias("end"), F.when(F.col("up") > 0, "rising").otherwise("falling").alias("side"))


def nelson5(df: DataFrame) -> DataFrame:
    """Two of three points beyond two sigmas on one side."""
    w = _next(2)
    flags = {"above": F.sum(F.expr("int(value > mean + 2 * std)")).over(w), "below": F.sum(F.expr("int(value < mean - 2 * std)")).over(w), "k": F.count("value").over(w)}
    out = _blocks(df).where("std > 0").withColumns(flags).where("start and k = 3 and (above >= 2 or below >= 2)")
    return out.select("series", F.col("i").alias("start"), (F.col("i") + 2).alias("end"), F.when(F.col("above") >= 2, "above").otherwise("below").alias("side"))


def _fired(df: DataFrame) -> DataFrame:
    """series, mean, std, n, and how often each rule fired, all told in one sweep."""
    lo, hi, k9 = F.min("value").over(_next(8)), F.max("value").over(_next(8)), F.count("value").over(_next(8))
    step = F.signum(F.lead("value").over(Window.partitionBy("series", "block").orderBy("i")) - F.col("value"))
    near = lambda c: F.sum(F.expr(c).cast("int")).over(_next(2))
    rows = _blocks(df).withColumn("step", step).withColumns({"k3": F.count("value").over(_next(2)), "above": near("value > mean + 2 * std"), "below": near("value < mean - 2 * std"), "lo": lo, "hi": hi, "k9": k9, "up": F.sum("step").over(_next(4)), "k6": F.count("step").over(_next(4))}).where("start")
    rules = {"1": "std > 0 and abs(value - mean) > 3 * std", "2": "k9 = 9 and (lo > mean or hi < mean)", "3": "k6 = 5 and abs(up) = 5", "5": "std > 0 and k3 = 3 and (above >= 2 or below >= 2)"}
    return rows.groupBy("series").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"), *[F.count_if(F.expr(rule)).alias(f"rule{k}") for k, rule in rules.items()])


def summary(df: DataFrame) -> DataFrame:
    """series, n, mean, std, rules (comma-joined rule numbers that fired)."""
    rules = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"rule{k}") > 0, F.lit(k)) for k in "1235"])), ",")
    return _fired(df).select("series", "n", "mean", "std", rules.alias("rules"))


def capability(df: DataFrame) -> DataFrame:
    """series, n, cp, cpk, delta, trend; df has lsl and usl too.  The halves use the whole series' sigma."""
    size = df.where("value is not null").groupBy("series").agg(F.count("value").alias("n"))
    rows = running(df.where("value is not null"), ["series"], ranges_of(df, "ord"), [F.col("ord")], {"i": ("sum", F.lit(1))}).join(size, "series")
    half = F.col("i") <= F.floor(F.col("n") / 2)
    out = rows.groupBy("series").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.avg(F.when(half, F.col("value"))).alias("m1"), F.avg(F.when(~half, F.col("value"))).alias("m2"), F.min("lsl").alias("lsl"), F.min("usl").alias("usl"))
    cpk = lambda m: F.least(F.try_divide(F.col("usl") - m, 3 * F.col("s")), F.try_divide(m - F.col("lsl"), 3 * F.col("s")))
    out = out.withColumns({"cp": F.try_divide(F.col("usl") - F.col("lsl"), 6 * F.col("s")), "cpk": cpk(F.col("m")), "delta": cpk(F.col("m2")) - cpk(F.col("m1"))})
    trend = F.when(F.col("n") < 5, "INSUFFICIENT_DATA").when(F.col("s") == 0, "ZERO_VARIANCE").when(F.col("delta") > 0.1, "IMPROVING").when(F.col("delta") < -0.1, "DECLINING").otherwise("STABLE")
    known = (F.col("n") >= 5) & (F.col("s") > 0)
    return out.select("series", "n", *[F.when(known, F.col(c)).alias(c) for c in ("cp", "cpk", "delta")], trend.alias("trend"))


def machine_signal(df: DataFrame, least: int = 5) -> DataFrame:
    """series, strength: min(1, signals / 20) of series with enough points."""
    points = df.groupBy("series").agg(F.count("value").alias("n")).where(F.col("n") >= least).select("series")
    every = _fired(df).select("series", sum((F.col(f"rule{k}") for k in "235"), F.col("rule1")).alias("k"))
    return points.join(every, "series", "left").select("series", F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / 20).alias("strength"))


def decline_signal(df: DataFrame, least: int = 10, goal: float = 1.33) -> DataFrame:
    """series, strength: declining series whose cpk is under the goal."""
    out = capability(df).where((F.col("n") >= least) & (F.col("trend") == "DECLINING") & (F.coalesce("cpk", F.lit(2.0)) < goal))
    return out.select("series", F.least(F.lit(1.0), (F.lit(goal) - F.col("cpk")) / 0.5).alias("strength"))
