"""Report of how the engines' answers compare with what is expected of them, metric by metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgraph.functions import stats
from lotgraph.operators import backward

# A metric's target and whether more of it is better.
TARGETS = {"forward_f1": (0.85, True), "shortfall_mape": (0.10, False), "late_brier": (0.15, False), "cause_top3": (0.75, True)}
LEAST = 0.5  # a probability from which an order counts as late


def benchmark(forward: DataFrame, causes: DataFrame) -> DataFrame:
    """metric, value, target, passed (null without a target), over all cases at once.

    forward: case_id, expected_late, predicted_late (arrays of orders), expected_short, predicted_short, is_late (0 or
    1), p_late; causes: case_id, expected, ranked (array of candidates, the best first).  Shortfalls count where one is
    expected.
    """
    return _metrics(stats.confusion(forward, "expected_late", "predicted_late"), forward, backward.accuracy(causes, "expected", "ranked"))


def benchmark_counts(forward: DataFrame, causes: DataFrame) -> DataFrame:
    """benchmark() of orders that are counted, not listed: all cases of a product and day may expect the same many orders.

    forward: case_id, n_expected, n_predicted, n_both, expected_short, predicted_short, p_late; causes: case_id, first and
    any (whether the first or any of the ranked candidates is the expected one).
    """
    rows = forward.withColumn("is_late", (F.col("n_expected") > 0).cast("int"))
    hit = causes.agg(*[F.avg(F.col(c).cast("double")).alias(name) for c, name in (("first", "top1"), ("any", "top3"))])
    return _metrics(stats.counted_confusion(rows, "n_expected", "n_predicted", "n_both"), rows, hit)


def _metrics(sets: DataFrame, forward: DataFrame, hits: DataFrame) -> DataFrame:
    sets = sets.select(F.col("f1").alias("forward_f1"), F.col("exact").alias("late_set_accuracy"), F.col("hit").alias("late_hit_rate"))
    wanted = F.col("expected_short") > 0
    off = F.abs(F.col("predicted_short") - F.col("expected_short")) / F.col("expected_short")
    numbers = forward.agg(F.avg(F.when(wanted, off)).alias("shortfall_mape"), F.avg((F.col("p_late") - F.col("is_late")) * (F.col("p_late") - F.col("is_late"))).alias("late_brier"), F.avg(((F.col("p_late") >= LEAST).cast("int") == F.col("is_late")).cast("double")).alias("late_accuracy"))
    ranks = hits.select(F.col("top1").alias("cause_top1"), F.col("top3").alias("cause_top3"))
    one = sets.crossJoin(numbers).crossJoin(ranks)  # one row each
    names = one.columns
    rows = one.unpivot([], names, "metric", "value")
    aims = [F.when(F.col("metric") == m, F.lit(t)) for m, (t, _) in TARGETS.items()]
    more = [m for m, (_, up) in TARGETS.items() if up]
    rows = rows.withColumn("target", F.coalesce(*aims))
    return rows.withColumn("passed", F.when(F.col("metric").isin(*more), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target")))
