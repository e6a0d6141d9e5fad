"""Runs of cases on the canonical tables: forward, backward, what-if, and how their answers compare with what is expected.

A case is a row, and all cases of a run are one plan.  The tables are those that ``canonical.run`` builds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgraph.operators import action, backward, evaluation, forward, spc

# The stock of each product when the horizon starts.
OPENING = {"PROD-P1": 450.0, "PROD-P2": 600.0, "PROD-P3": 450.0, "PROD-P4": 450.0}
CHECKED = 5  # orders of a case that are held against their trucks


class Forward(NamedTuple):
    impact: DataFrame
    late: DataFrame
    reached: DataFrame


def run_forward(cases: DataFrame, t: dict[str, DataFrame], opening: DataFrame | None = None, bom: DataFrame | None = None, available: DataFrame | None = None, first: int = CHECKED) -> Forward:
    """The impact of every case, its late orders, and the orders it reaches through the genealogy.

    Of the orders that a case reaches, the first ones by due date are held against their trucks; orders whose shipment has
    departed are done.  cases: case_id, station_id, start_ts, hours; opening: product, opening.
    """
    spark = cases.sparkSession
    opening = spark.createDataFrame(list(OPENING.items()), "product string, opening double") if opening is None else opening
    lots = t["lot"].select("lot_id", F.col("product_id").alias("product"), "qty", F.col("created_ts").alias("created"))
    events = t["lot_event"].select("station_id", "lot_id", F.coalesce("ts_aligned", "ts_raw").alias("ts"))
    orders = t["jt_order"].select("jt_id", F.col("product_id").alias("product"), "qty", F.col("due_ts").alias("due"))
    ships = t["shipment"].select("jt_id", "truck_time", "status")
    known = forward.with_fulfilled(orders, ships)
    named = forward.cascade(cases, lots, events, known, opening).cases.select("case_id", "product")
    edges = t["lot_edge"].select(F.col("parent_lot_id").alias("parent"), F.col("child_lot_id").alias("child"))
    reached = forward.affected_orders(named, forward.affected_lots(cases, events), edges, t["jt_allocation"].select("lot_id", "jt_id"), orders, first).checkpoint()
    solved = forward.cascade(cases, lots, events, known, opening, shipments=ships.where("truck_time is not null"), checked=reached.where(F.col("place") <= first), due_day=False)
    solved = forward.Cascade(*[df.checkpoint() for df in solved])  # several answers come from it
    impact = forward.impact(cases, lots, events, known, bom=bom, available=available, faithful=True, solved=solved)
    return Forward(impact.checkpoint(), forward.late_list(solved, faithful=True).checkpoint(), reached)


def run_backward(cases: DataFrame, t: dict[str, DataFrame], top: int = 3) -> DataFrame:
    """The first causes of every case with tests, score and containment; cases: case_id, lot_id."""
    edges = t["lot_edge"].select(F.col("parent_lot_id").alias("parent"), F.col("child_lot_id").alias("child"))
    events = t["lot_event"].select("station_id", "lot_id", F.coalesce("ts_aligned", "ts_raw").alias("ts")).where("ts is not null")
    bad = backward.ng_lots(t["qc_result"]).withColumn("bad", F.lit(True))
    lots = t["lot"].select("lot_id").join(bad, "lot_id", "left").select("lot_id", F.coalesce("bad", F.lit(False)).alias("is_ng"))
    points = t["qc_result"].where("value is not null and station_id is not null and measured_ts is not null").select(F.col("station_id").alias("series"), F.struct("measured_ts", "qc_id").alias("ord"), "value", "lsl", "usl")
    signal = backward.signals(spc.machine_signal(points), spc.decline_signal(points))
    used = t["material_consumption"].select("lot_id", F.col("mat_lot_id").alias("mat_lot"))
    return backward.diagnose(cases, edges, events, used, lots, top=top, signal=signal).checkpoint()


def run_what_if(cases: DataFrame, run: Forward, p_max: float = 0.05, costs: dict[str, float] = action.COSTS) -> DataFrame:
    """All options of every case on its first late order, ranked, with the chosen one; cases: case_id, hours."""
    base = action.late_base(run.impact, run.late)
    opts = action.options(cases.sparkSession)
    rows = action.ranks(action.scored(action.simulate(cases.select("case_id", "hours").join(base, "case_id"), opts), costs))
    best = action.choose(rows, ["case_id"], p_max).select("case_id", F.col("option").alias("best"))
    return rows.join(best, "case_id").withColumns({"within": F.col("p_late") <= p_max, "chosen": F.col("option") == F.col("best")}).drop("best")


def action_cards(options: DataFrame, p_max: float = 0.05) -> DataFrame:
    """case_id, option, action, p_late, cost, reason, table (all options in order) of the chosen option of every case."""
    row = F.struct("option", "action", "p_late", "cost", "within", "chosen")
    table = options.groupBy("case_id").agg(F.array_sort(F.collect_list(row)).alias("table"))  # seven options
    reason = F.when(F.col("within"), F.lit(f"least cost within a late probability of {p_max}")).otherwise(f"least late probability, none is within {p_max}")
    return options.where("chosen").select("case_id", "option", "action", "p_late", "cost", reason.alias("reason")).join(table, "case_id")


def report(run: Forward, causes: DataFrame, expected: DataFrame, expected_causes: DataFrame) -> DataFrame:
    """metric, value, target, passed of both engines over all cases.

    expected: case_id, late (array of orders), short; expected_causes: case_id, cause.  The probability of a case is that
    of its likeliest late order.
    """
    late = run.late.groupBy("case_id").agg(F.collect_set(F.col("jt_id").cast("string")).alias("predicted_late"), F.max("p_late").alias("p_late"))
    none = F.array().cast("array<string>")
    rows = expected.join(late, "case_id", "left").join(run.impact.select("case_id", F.round("shortfall").alias("predicted_short")), "case_id", "left")
    rows = rows.select("case_id", F.coalesce(F.col("late").cast("array<string>"), none).alias("expected_late"), F.coalesce("predicted_late", none).alias("predicted_late"), F.col("short").cast("double").alias("expected_short"), F.coalesce("predicted_short", F.lit(0.0)).alias("predicted_short"), (F.size(F.coalesce(F.col("late").cast("array<string>"), none)) > 0).cast("int").alias("is_late"), F.coalesce("p_late", F.lit(0.0)).alias("p_late"))
    ranked = causes.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda c: c["candidate"]).alias("ranked"))
    named = expected_causes.join(ranked, "case_id", "left").select("case_id", F.col("cause").cast("string").alias("expected"), F.coalesce("ranked", none).alias("ranked"))
    return evaluation.benchmark(rows, named)


def walk(run: Forward, causes: DataFrame, options: DataFrame) -> DataFrame:
    """step, case_id, subject, detail: impact, late orders, causes and the chosen option, one after the other."""
    row = lambda df, step, subject, detail: df.select(F.lit(step).alias("step"), F.col("case_id").cast("string").alias("case_id"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))
    text = lambda form, *columns: F.format_string(form, *[F.col(c) for c in columns])
    out = row(run.impact, "1 impact", F.col("product"), text("loss %.1f, short %.1f, %d late", "loss", "shortfall", "n_late"))
    out = out.unionByName(row(run.late, "2 late", F.col("jt_id"), text("%s: short %.1f, shows %.1f", "late_by", "short", "shortfall")))
    out = out.unionByName(row(causes, "3 cause", F.col("candidate"), text("rank %d, score %.4f, p %.6f", "rank", "score", "p")))
    return out.unionByName(row(options.where("chosen"), "4 option", F.col("option"), text("cost %.0f, late %.4f", "cost", "p_late")))


def differences(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """keys, field, expected, actual, passed: a row for each field of expected, numbers within a share of tolerance.

    Rows that are missing on the other side have null there and fail.
    """
    fields = [c for c in expected.columns if c not in keys]
    long = lambda df, name: df.select(*keys, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(keys, fields, "field", name)
    both = long(expected, "expected").join(long(actual, "actual"), [*keys, "field"], "full")
    a, b = F.col("expected").try_cast("double"), F.col("actual").try_cast("double")
    near: Column = F.coalesce(F.abs(a - b) <= tolerance * F.abs(a), F.lit(False))
    return both.withColumn("passed", F.col("expected").eqNullSafe(F.col("actual")) | near)


