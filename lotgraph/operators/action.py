"""What-if action selection: options, closed-form outcome, cost, constrained choice, sensitivity.  A case is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgraph.functions import stats
from lotgraph.operators.forward import RATE, late_probability

# Option, action, share of the base recovered, overtime hours, changeovers, expedited trucks.
OPTIONS = (
    ("A", "wait", 0.0, 0.0, 0, 0),
    ("B", "overtime 2 h", 0.865, 2.0, 0, 0),
    ("C", "overtime 4 h", 1.177, 4.0, 0, 0),
    ("D", "resequence", 0.868, 0.0, 1, 0),
    ("E", "resequence and overtime 2 h", 1.113, 2.0, 1, 0),
    ("F", "alternative line", 0.30, 0.0, 0, 0),
    ("G", "expedite", 0.0, 0.0, 0, 1),
)
# Costs.
COSTS = {"overtime_rate": 80_000.0, "overtime_factor": 1.5, "crew": 5.0, "energy_h": 500_000.0, "changeover": 1_500_000.0, "truck": 5_000_000.0, "expedite_factor": 3.0, "penalty_h": 2_000_000.0}


def options(spark: SparkSession, alternative_line: bool = True) -> DataFrame:
    rows = [o for o in OPTIONS if alternative_line or o[0] != "F"]
    return spark.createDataFrame(rows, "option string, action string, effect double, overtime_h double, changeovers int, trucks int")


# A cost's section and key in a configuration file.
CONFIG_KEYS = {"overtime_rate": "labor.operator_hourly_rate", "overtime_factor": "overtime.hourly_multiplier", "energy_h": "overtime.energy_cost_per_hour", "changeover": "changeover.fixed_cost", "truck": "shipping.normal_cost_per_truck", "expedite_factor": "shipping.expedite_multiplier", "penalty_h": "shipping.late_penalty_per_hour"}


def costs_from(config: dict[str, str]) -> dict[str, float]:
    """COSTS with what a flat configuration (``readers.config``) states."""
    return COSTS | {name: float(config[key]) for name, key in CONFIG_KEYS.items() if key in config}


def cost(p_late: Column, delay_h: Column, overtime: float | Column | None = None, changeover: float | Column | None = None, costs: dict[str, float] = COSTS) -> Column:
    """Overtime, changeovers, expedited trucks if the order may be late, and a penalty by the hour if it is likely late."""
    overtime = costs["overtime_rate"] if overtime is None else overtime
    changeover = costs["changeover"] if changeover is None else changeover
    hours = F.col("overtime_h") * (F.lit(1.0) * overtime * costs["overtime_factor"] * costs["crew"] + costs["energy_h"])
    trucks = F.when(p_late > 0, F.col("trucks") * costs["truck"] * costs["expedite_factor"]).otherwise(0.0)
    penalty = F.when(p_late >= 0.5, delay_h * costs["penalty_h"]).otherwise(0.0)
    return hours + F.col("changeovers") * changeover + trucks + penalty


def simulate(cases: DataFrame, opts: DataFrame, rate: float = RATE) -> DataFrame:
    """case_id, option, recovered, p_late, shortfall (expected), delay_h, completion_h; cases: case_id, base, hours.  opts has seven rows."""
    out = cases.join(F.broadcast(opts), F.lit(True))
    recovered = F.col("base") * F.col("effect")
    out = out.withColumns({"recovered": recovered, "p_late": late_probability(F.col("base"), recovered)})
    mean = F.when(F.col("base") > 0, F.col("base") * stats.triangular_excess(F.try_divide("recovered", "base"))).otherwise(0.0)
    return out.withColumns({"shortfall": mean, "delay_h": F.round(mean / rate, 2), "completion_h": F.col("hours") + F.col("recovered") / rate})


def scored(simulated: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    return simulated.withColumn("cost", cost(F.col("p_late"), F.col("delay_h"), costs=costs))


def ranks(rows: DataFrame) -> DataFrame:
    """rows with rank_by_cost and rank_by_risk of each case's options; the first option on ties."""
    case = Window.partitionBy("case_id")
    place = lambda *order: F.row_number().over(case.orderBy(*order, "option")).cast("long")
    return rows.withColumns({"rank_by_cost": place("cost"), "rank_by_risk": place("p_late", "cost")})


def what_if(cases: DataFrame, impacts: DataFrame, opts: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """All options of every case on its forward impact's base, with their ranks; cases: case_id, hours; impacts: case_id, base."""
    return ranks(scored(simulate(cases.select("case_id", "hours").join(impacts.select("case_id", "base"), "case_id"), opts), costs))


def late_base(impacts: DataFrame, late: DataFrame) -> DataFrame:
    """case_id, base, base_p, jt_id: what the options of a case start from.

    It is the shortfall and probability of the case's first late order; without one the case's total shortage, with a
    probability of 0.5 above 100 pieces and 0.1 up to there.  impacts: case_id, shortfall; late: case_id, jt_id, shortfall,
    p_late, place.
    """
    first = late.where("place = 1").select("case_id", "jt_id", F.col("shortfall").alias("_first"), "p_late")
    total = F.coalesce("shortfall", F.lit(0.0))
    out = impacts.select("case_id", "shortfall").join(first, "case_id", "left")
    return out.select("case_id", F.coalesce("_first", total).alias("base"), F.coalesce("p_late", F.when(total > 100, 0.5).otherwise(0.1)).alias("base_p"), "jt_id")


def choose(rows: DataFrame, keys: list[str], p_max: Column | float = 0.05) -> DataFrame:
    """The cheapest option within p_max, or the least risky if there is none; the first on ties."""
    ok = F.col("p_late") <= p_max
    order = Window.partitionBy(*keys).orderBy(F.desc(ok), F.when(ok, F.col("cost")).otherwise(F.col("p_late")), "option")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumn("feasible", ok)


def sensitivity_threshold(rows: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """case_id, threshold, option, cost, robust (one option at all thresholds)."""
    every = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = choose(every, ["case_id", "threshold"], F.col("threshold")).select("case_id", "threshold", "option", "cost")
    w = Window.partitionBy("case_id")
    return out.withColumn("robust", F.min("option").over(w) == F.max("option").over(w))


def sensitivity_cost(rows: DataFrame, factors: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2), p_max: float = 0.05) -> DataFrame:
    """case_id, factor, what, option, cost: the choice if overtime or changeovers cost more or less."""
    every = rows.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).withColumn("what", F.explode(F.array(F.lit("overtime"), F.lit("changeover"))))
    scale = lambda name: F.when(F.col("what") == name, F.col("factor")).otherwise(1.0)
    every = every.withColumn("cost", cost(F.col("p_late"), F.col("delay_h"), scale("overtime") * COSTS["overtime_rate"], scale("changeover") * COSTS["changeover"]))
    return choose(every, ["case_id", "what", "factor"], p_max).select("case_id", "what", "factor", "option", "cost")
