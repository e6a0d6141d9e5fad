"""Forward impact: from an outage to short or late orders.  A case is a row; all cases run in one plan."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.functions import stats
from lotgraph.functions.values import seconds
from lotgraph.operators import graph
from lotgraph.operators.cuts import cut
from lotgraph.operators.running import running

RATE = 92.0  # fixed value: units an hour
HORIZON = 14
SHORT_LIMIT = 10.0
_TOP = 1e9  # above any stock


def qty_loss(hours: Column, rate: Column | float = RATE) -> Column:
    return F.round(hours * rate, 1)


def time_to_starve(wip: Column, rate: Column | float = RATE) -> Column:
    rate = F.lit(rate) if isinstance(rate, float | int) else rate
    return F.when(rate <= 0, float("inf")).otherwise(F.try_divide(wip.cast("double"), rate))


def station_product(station: Column, majority: Column) -> Column:
    """The product that a station makes; heat treatment takes the majority of its lots."""
    return F.when(station.isin("STN-M1", "STN-M2", "STN-AS1", "STN-T1"), "PROD-P1").when(station == "STN-AS2", "PROD-P3").when(station.startswith("STN-HT"), F.coalesce(majority, F.lit("PROD-P1"))).otherwise("PROD-P3")


def affected_lots(cases: DataFrame, events: DataFrame, width: int = 6 * 3600) -> DataFrame:
    """case_id, lot_id: lots with an event at the case's station in its closed window.

    Cases and events meet by station and time bucket, so a busy station's events are not all paired with its cases.
    """
    end = F.col("start_ts") + F.make_dt_interval(hours=F.col("hours").cast("int"))
    hit = (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= end)
    bucket = lambda ts: F.floor(seconds(ts) / width)
    spans = cases.where("hours >= 0").select("case_id", "station_id", "start_ts", "hours", F.explode(F.sequence(bucket(F.col("start_ts")), bucket(end))).alias("_w"))
    seen = events.select("station_id", "lot_id", "ts", bucket(F.col("ts")).alias("_w"))
    return spans.join(seen, ["station_id", "_w"]).where(hit).select("case_id", "lot_id").distinct()


def majority_product(affected: DataFrame, lots: DataFrame) -> DataFrame:
    """case_id, product: the most frequent product of its lots, the smallest on ties."""
    counts = affected.join(lots.select("lot_id", "product"), "lot_id").groupBy("case_id", "product").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("case_id").agg(F.min(F.struct(-F.col("k"), "product")).alias("m")).select("case_id", F.col("m.product").alias("product"))


def daily_production(lots: DataFrame, fallback: float = 900.0) -> DataFrame:
    """product, daily: mean over days of the day's quantity, one decimal."""
    days = lots.groupBy("product", F.to_date("created").alias("day")).agg(F.sum("qty").alias("qty"))
    return days.groupBy("product").agg(F.round(F.coalesce(F.avg("qty"), F.lit(fallback)), 1).alias("daily"))


def ship_schedule(orders: DataFrame, day0: str, days: int = HORIZON) -> DataFrame:
    """product, day_idx, qty: what is due on each day of the horizon, zero where nothing is."""
    spine = orders.select("product").distinct().select("product", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day_idx"))
    due = orders.withColumn("day_idx", F.datediff(F.to_date("due"), F.lit(day0).cast("date"))).where((F.col("day_idx") >= 0) & (F.col("day_idx") < days)).groupBy("product", "day_idx").agg(F.sum("qty").alias("qty"))
    return spine.join(due, ["product", "day_idx"], "left").select("product", "day_idx", F.coalesce("qty", F.lit(0)).alias("qty"))


def netting(schedule: DataFrame, opening: DataFrame, production: DataFrame, loss: Column) -> DataFrame:
    """product, day_idx, baseline, incident, is_short: stock at the end of each day; day 0 makes max(0, daily - loss)."""
    w = Window.partitionBy("product").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = F.when(F.col("day_idx") == 0, F.greatest(F.lit(0.0), F.col("daily") - loss)).otherwise(F.col("daily"))
    out = schedule.join(opening, "product").join(production, "product")
    out = out.withColumns({"baseline": F.col("opening") + F.sum(F.col("daily") - F.col("qty")).over(w), "incident": F.col("opening") + F.sum(made - F.col("qty")).over(w)})
    return out.select("product", "day_idx", "baseline", "incident", (F.col("incident") < 0).alias("is_short"))


def netting_summary(net: DataFrame) -> DataFrame:
    """product, first_short_day (null if there is none), n_short_days, shortage (the sum of what is below zero)."""
    return net.groupBy("product").agg(F.min(F.when(F.col("is_short"), F.col("day_idx"))).alias("first_short_day"), F.count_if("is_short").alias("n_short_days"), F.sum(F.when(F.col("is_short"), -F.col("incident")).otherwise(0.0)).alias("shortage"))


def atp_waterfall(orders: DataFrame, supply: DataFrame) -> DataFrame:
    """case_id, jt_id, available, short: orders in due order take what is left by their day.

    orders: case_id, jt_id, qty, due_idx, fulfilled; supply: case_id, opening, made (array of the days' production).
    A short order takes all that is left (nothing is carried on); a fulfilled one may take stock below zero.  The fold
    runs over one case's orders of the horizon, which are few.
    """
    rows = orders.where((F.col("due_idx") >= 0) & (F.col("due_idx") <= HORIZON)).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("due_idx", "jt_id", F.col("qty").cast("double").alias("qty"), "fulfilled"))).alias("o"))
    out = "array<struct<jt_id:string,available:double,short:double>>"
    start = F.struct(F.col("opening").cast("double").alias("left"), F.lit(-1).alias("day"), F.array().cast(out).alias("out"))

    def step(acc: Column, o: Column) -> Column:
        new = F.aggregate(F.filter("made", lambda p, i: (i > acc["day"]) & (i <= o["due_idx"])), F.lit(0.0), lambda s, p: s + p)
        have = acc["left"] + new
        short = F.when(o["fulfilled"], 0.0).otherwise(F.greatest(F.lit(0.0), o["qty"] - F.greatest(have, F.lit(0.0))))
        left = F.when(o["fulfilled"], have - o["qty"]).when(short > 0, 0.0).otherwise(have - o["qty"])
        row = F.struct(o["jt_id"].cast("string").alias("jt_id"), have.alias("available"), short.alias("short"))
        return F.struct(left.alias("left"), F.greatest(acc["day"], o["due_idx"]).alias("day"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = rows.join(supply, "case_id").select("case_id", F.explode(F.aggregate("o", start, step, lambda acc: acc["out"])).alias("r"))
    return folded.select("case_id", "r.jt_id", F.round("r.available", 4).alias("available"), F.round("r.short", 4).alias("short"))


def material_check(required_for: DataFrame, bom: DataFrame, available: DataFrame) -> DataFrame:
    """case_id, component, required, available, sufficient; required_for: case_id, product, qty."""
    need = required_for.join(bom, "product").select("case_id", "component", (F.col("qty") * F.col("per_unit") * F.coalesce("scrap", F.lit(1.002))).alias("required"))
    out = need.join(available, "component", "left").select("case_id", "component", "required", F.coalesce("available", F.lit(0.0)).alias("available"))
    return out.withColumn("sufficient", F.col("available") >= F.col("required"))


def _grid(draws: int) -> list[float]:
    """The triangular factor at the middles of equal shares."""
    cut = 1 / 3  # (1 - 0.75) / (1.5 - 0.75)
    us = [(i + 0.5) / draws for i in range(draws)]
    return [0.75 + math.sqrt(u * 0.1875) if u < cut else 1.5 - math.sqrt((1 - u) * 0.375) for u in us]


def shortfall_distribution(base: DataFrame, limit: float = SHORT_LIMIT, draws: int = 2000) -> DataFrame:
    """case_id, mean, std, p50, p90, p_late of base times a triangular factor, on a fixed grid of quantiles.

    The grid is the same for all cases, so its moments and percentiles are constants and the late share is a count by
    the distribution function; nothing is exploded or shuffled.
    """
    grid = _grid(draws)
    mean = sum(grid) / draws
    std = math.sqrt(sum((x - mean) ** 2 for x in grid) / draws)

    def at(p: float) -> float:
        k = p * (draws - 1)
        low = int(k)
        return grid[low] + (k - low) * (grid[min(low + 1, draws - 1)] - grid[low])

    b = F.col("base").cast("double")
    below = F.floor(draws * stats.triangular_cdf(F.try_divide(F.lit(limit), b)) + 0.5)
    p_late = F.when(b > 0, 1 - F.least(below, F.lit(draws)) / draws).otherwise(F.lit(0.0) if limit >= 0 else F.lit(None).cast("double"))
    return base.select("case_id", (b * mean).alias("mean"), (F.abs(b) * std).alias("std"), (b * at(0.5)).alias("p50"), F.when(b >= 0, b * at(0.9)).otherwise(b * at(0.1)).alias("p90"), F.when(b.isNotNull(), p_late).alias("p_late"))


def late_probability(base: Column, recovered: Column, limit: float = SHORT_LIMIT) -> Column:
    """P(base · T - recovered > limit), T triangular, in closed form; 0 without a base."""
    return F.when(base <= 0, 0.0).otherwise(1 - stats.triangular_cdf(F.try_divide(recovered + limit, base)))


def cutoff(cases: DataFrame, shipments: DataFrame, recovery_hours: float = 0.0) -> DataFrame:
    """case_id, jt_id, status: whether production is done before the order's first truck."""
    first = shipments.groupBy("jt_id").agg(F.min("truck_time").alias("truck_time"))
    done = F.timestamp_add("MINUTE", ((F.col("hours") + recovery_hours) * 60).cast("int"), F.col("start_ts"))
    out = cases.join(first, "jt_id", "left").withColumn("done", done)
    status = F.when(F.col("truck_time").isNull(), "no_shipment_for_jt").when(F.col("start_ts") > F.col("truck_time"), "PASS").when(F.col("done") <= F.col("truck_time"), "PASS").otherwise("LATE")
    return out.select("case_id", "jt_id", status.alias("status"))


def late_by(short: Column, status: Column) -> Column:
    return F.when((short > 0) & (status == "LATE"), "qty+time").when(short > 0, "qty").when(status == "LATE", "time")


def recommendation(p_late: Column, short: Column) -> Column:
    return F.when((p_late < 0.1) & (short < 50), "no_action_needed").when(p_late < 0.5, "monitor").when(p_late < 0.9, "resequencing").otherwise("resequencing + OT2")


def evidence_card(loss: Column, starve: Column, short: Column, p_late: Column) -> Column:
    return F.struct(loss.alias("qty_loss"), starve.alias("hours_to_starve"), short.alias("shortfall"), p_late.alias("p_late"), recommendation(p_late, short).alias("action"), F.when(p_late >= 0.9, "A").when(p_late >= 0.5, "B").otherwise("C").alias("grade"))


def scheduled_hours(start: Column, end: Column, opens: int = 6, closes: int = 22) -> Column:
    """Hours of an outage inside the daily shift, by days."""
    days = F.sequence(F.to_date(start), F.to_date(end))

    def inside(day: Column) -> Column:
        base = day.cast("timestamp_ntz")
        lo, hi = F.greatest(start, F.timestamp_add("HOUR", F.lit(opens), base)), F.least(end, F.timestamp_add("HOUR", F.lit(closes), base))
        return F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", lo, hi) / 3600.0)

    return F.when(end > start, F.aggregate(F.transform(days, inside), F.lit(0.0), lambda s, h: s + h)).otherwise(0.0)


def case_product(station: Column, majority: Column) -> Column:
    """The rule for the reference's stations; any other station has the majority of its lots, if there are any."""
    station = station.cast("string")
    fixed = station_product(station, majority)
    return F.when(station.startswith("STN-"), fixed).otherwise(F.coalesce(majority, fixed))


def with_fulfilled(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """orders with fulfilled: a shipment of the order has departed; shipments: jt_id, status."""
    gone = shipments.where(F.upper(F.trim("status")) == "DEPARTED").select("jt_id", F.lit(True).alias("fulfilled")).distinct()
    return orders.drop("fulfilled").join(gone, "jt_id", "left").withColumn("fulfilled", F.coalesce("fulfilled", F.lit(False)))


def affected_orders(cases: DataFrame, hit: DataFrame, edges: DataFrame, allocation: DataFrame, orders: DataFrame, first: int = 5) -> DataFrame:
    """case_id, jt_id, source, place: the orders that a case reaches through the genealogy, in due order.

    The case's lots and all their descendants lead to the orders they are allocated to.  Of these the ones of the case's
    product count (source product); where it has none, all of them (any); where nothing is allocated, the first orders by
    id stand in (first).  Orders without a due date come last.

    cases: case_id, product; hit: case_id, lot_id; edges: parent, child; allocation: lot_id, jt_id; orders: jt_id,
    product, due.
    """
    down = graph.reach(edges, hit.select(F.col("lot_id").alias("seed")).distinct(), down=True, max_depth=None, include_seed=True)
    lots = hit.join(down, F.col("lot_id") == F.col("seed")).select("case_id", F.col("node").alias("lot_id")).distinct()
    reached = lots.join(allocation.select("lot_id", "jt_id").distinct(), "lot_id").select("case_id", "jt_id").distinct()
    known = reached.join(orders.select("jt_id", F.col("product").alias("made"), "due"), "jt_id").join(cases.select("case_id", "product"), "case_id").withColumn("own", F.coalesce(F.col("made") == F.col("product"), F.lit(False)))
    counts = known.groupBy("case_id").agg(F.count_if("own").alias("n_own"))
    chosen = known.join(counts, "case_id").where(F.col("own") | (F.col("n_own") == 0)).select("case_id", "jt_id", "due", F.when(F.col("own"), "product").otherwise("any").alias("source"))
    few = orders.select("jt_id", "due").orderBy("jt_id").limit(first)  # a fixed number of rows
    left = cases.select("case_id").distinct().join(counts.select("case_id"), "case_id", "left_anti")
    stand_in = left.join(F.broadcast(few), F.lit(True)).select("case_id", "jt_id", "due", F.lit("first").alias("source"))
    order = Window.partitionBy("case_id").orderBy(F.asc_nulls_last("due"), "jt_id")
    return chosen.unionByName(stand_in).withColumn("place", F.row_number().over(order).cast("long")).select("case_id", "jt_id", "source", "place")


class Cascade(NamedTuple):
    """What all answers of the forward engine share; see cascade()."""

    cases: DataFrame
    queue: DataFrame
    trucks: DataFrame

    @property
    def missed(self) -> DataFrame:
        """case_id, jt_id of trucks."""
        return self.trucks.select("case_id", "jt_id")


def cascade(cases: DataFrame, lots: DataFrame, events: DataFrame, orders: DataFrame, opening: float | DataFrame = 20.0, fallback: float = 900.0, shipments: DataFrame | None = None, checked: DataFrame | None = None, due_day: bool = True, written: bool = False) -> Cascade:
    """Cases of one product and day have one queue of orders and the same production, but for the first day's loss.

    So the waterfall is solved once for each product and day, for any stock s at the start (opening and the first day's
    production).  What an order finds is ``a + max(s, m)``: a is what is made until its day less what earlier orders ask
    for, and m comes from the last earlier order that left nothing.  It is short by ``hi - max(s, lo)`` where that is
    above zero, with ``hi = qty - a`` and ``lo = max(m, -a)``.

    cases: the cases with product, daily, loss, n_affected, day0, s; queue: product, day0, due_idx, jt_id, qty, due, open,
    lo, hi (null if it can't be short); trucks: case_id, s, jt_id, due_idx, lo, hi of open orders whose first truck leaves in
    the outage, or of checked ones (case_id, jt_id), if given.  written: cases and queue are cut, as several branches of a
    plan start from them.  opening: a number, or product, opening.  due_day=False: what is made on the
    day an order is due does not count for it, as in the reference; orders of the first day then see the opening stock.
    """
    hit = affected_lots(cases, events)
    size = hit.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_affected"))
    major = majority_product(hit, lots).withColumnRenamed("product", "majority")
    own = cases.join(size, "case_id", "left").join(major, "case_id", "left").withColumns({"n_affected": F.coalesce("n_affected", F.lit(0)), "product": case_product(F.col("station_id"), F.col("majority"))})
    own = own.join(daily_production(lots, fallback), "product", "left").withColumns({"daily": F.coalesce("daily", F.lit(fallback)), "loss": qty_loss(F.col("hours")), "day0": F.to_date("start_ts")})
    own = own.join(opening.select("product", F.col("opening").cast("double").alias("opening")), "product", "left").fillna(20.0, ["opening"]) if isinstance(opening, DataFrame) else own.withColumn("opening", F.lit(float(opening)))
    own = own.withColumn("first", F.round(F.greatest(F.lit(0.0), F.col("daily") - F.col("loss")), 4))
    own = own.withColumns({"s": F.col("opening") + F.col("first"), "net": F.col("opening") + F.col("first")})

    own = cut(own) if written and due_day else own
    days = own.select("product", "day0", "daily", "opening").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(HORIZON))).alias("due_idx")).withColumn("day", F.expr("date_add(day0, due_idx)"))
    queue = days.join(orders.select("product", "jt_id", F.col("qty").cast("double").alias("qty"), "due", (~F.coalesce("fulfilled", F.lit(False))).alias("open"), F.to_date("due").alias("day")), ["product", "day"])
    # orders that see the opening stock only are a queue of their own, the same one for all cases
    queue = queue.withColumns({"early": F.lit(not due_day) & (F.col("due_idx") == 0), "made": F.col("daily") * F.greatest(F.lit(0), F.col("due_idx") - (0 if due_day else 1))})
    keys, order = ["product", "day0", "early"], [F.col("due_idx"), F.col("jt_id")]
    queue = running(queue, keys, F.col("due_idx"), order, {"asked": ("sum", F.col("qty"))}, exclusive=True)
    queue = running(queue, keys, F.col("due_idx"), order, {"least": ("min", F.when(F.col("open"), F.col("made") - F.col("asked") - F.col("qty")))}, exclusive=True)
    a = F.col("made") - F.col("asked")
    queue = queue.withColumns({"hi": F.round(F.col("qty") - a, 4), "lo": F.round(F.greatest(-F.col("least"), -a), 4)})
    if not due_day:
        early = queue.where("early").groupBy("product", "day0").agg(F.max("opening").alias("o"), F.sum("qty").alias("taken"), F.max(F.when(F.col("open"), F.col("asked") + F.col("qty"))).alias("most"))
        own = own.join(early, ["product", "day0"], "left").withColumn("s", F.coalesce(F.greatest("o", "most") - F.col("taken"), F.col("opening")) + F.col("first")).drop("o", "taken", "most")
        fixed = F.round(F.col("hi") - F.greatest("opening", "lo"), 4)  # a lack that no case changes: at the top of the line
        queue = queue.withColumns({"hi": F.when(F.col("early"), F.lit(_TOP) + fixed).otherwise(F.col("hi")), "lo": F.when(F.col("early"), F.lit(_TOP)).otherwise(F.col("lo"))})
    own = own.withColumns({"s": F.round("s", 4), "net": F.round("net", 4)})
    able = F.col("open") & (F.col("lo") < F.col("hi"))
    queue = queue.select("product", "day0", "daily", "due_idx", "jt_id", "qty", "due", "open", F.when(able, F.col("lo")).alias("lo"), F.when(able, F.col("hi")).alias("hi"))
    queue = cut(queue) if written else queue

    if shipments is None:
        none = {c: F.lit(None).cast(queue.schema[c].dataType) for c in ("jt_id", "due_idx", "lo", "hi")}
        return Cascade(own, queue, own.select("case_id", "s").withColumns(none).where(F.lit(False)))
    first = shipments.groupBy("jt_id").agg(F.min("truck_time").alias("truck_time"))
    done = F.timestamp_add("MINUTE", ((F.col("hours") + 80 / RATE) * 60).cast("int"), F.col("start_ts"))
    if checked is not None:
        missed = own.select("case_id", "product", "day0", "s", "start_ts", done.alias("done")).join(checked.select("case_id", "jt_id"), "case_id").join(first, "jt_id")
        missed = missed.join(queue.select("product", "day0", "jt_id", "due_idx", "lo", "hi"), ["product", "day0", "jt_id"], "left")
    else:
        # trucks and outages meet by product, day and time bucket
        width = 6 * 3600
        bucket = lambda ts: F.floor(seconds(ts) / width)
        spans = own.select("case_id", "product", "day0", "s", "start_ts", done.alias("done")).withColumn("_w", F.explode(F.sequence(bucket(F.col("start_ts")), bucket(F.col("done")))))
        trucks = queue.where("open").join(first, "jt_id").select("product", "day0", "jt_id", "due_idx", "lo", "hi", "truck_time", bucket(F.col("truck_time")).alias("_w"))
        missed = spans.join(trucks, ["product", "day0", "_w"])
    missed = missed.where((F.col("truck_time") >= F.col("start_ts")) & (F.col("truck_time") < F.col("done"))).select("case_id", "s", "jt_id", "due_idx", "lo", "hi")
    return Cascade(own, queue, missed)


def short_of(s: Column) -> Column:
    """What an order of the queue lacks at stock s; 0 if nothing."""
    return F.coalesce(F.greatest(F.lit(0.0), F.round(F.col("hi") - F.greatest(s, F.col("lo")), 4)), F.lit(0.0))


def short_totals(c: Cascade) -> DataFrame:
    """case_id, n_qty, n_today (due on the case's day), shortfall of the cases' short orders.

    Each order that can be short is two bounds, lo and hi, on the line of stocks, each case a point on it: one sweep by
    product and day counts and sums the bounds above each point, so cases and orders are not paired.
    """
    bound = lambda name, sign: c.queue.where(F.col(name).isNotNull()).select("product", "day0", F.lit(None).cast(c.cases.schema["case_id"].dataType).alias("case_id"), F.col(name).alias("at"), F.lit(sign).alias("sign"), (F.col("due_idx") == 0).alias("today"))
    points = c.cases.select("product", "day0", "case_id", F.col("s").alias("at"), F.lit(0).alias("sign"), F.lit(False).alias("today"))
    line = bound("hi", 1).unionByName(bound("lo", -1)).unionByName(points).withColumns({"_down": -F.col("at"), "_kind": F.abs("sign")})
    # from the top; at one value the points come first, so a bound at the point itself does not count
    swept = running(line, ["product", "day0"], F.floor(F.col("_down") / 4096), [F.col("_down"), F.col("_kind")], {"n_hi": ("sum", F.when(F.col("sign") == 1, 1).otherwise(0)), "n_today": ("sum", F.when((F.col("sign") == 1) & F.col("today"), 1).otherwise(0)), "n": ("sum", F.col("sign")), "total": ("sum", F.col("sign") * F.col("at"))})
    return swept.where("sign = 0").select("case_id", F.col("n_hi").alias("n_qty"), "n_today", (F.col("total") - F.col("at") * F.col("n")).alias("shortfall"))


def net_shorts(c: Cascade) -> DataFrame:
    """case_id, net_short: what the days of the horizon end below zero, netted by day; solved once by product and day."""
    asked = c.queue.groupBy("product", "day0", "due_idx").agg(F.sum("qty").alias("qty"))
    asked = asked.groupBy("product", "day0").agg(F.collect_list(F.struct("due_idx", "qty")).alias("asked"))  # a row a day
    total = lambda d: F.aggregate(F.filter("asked", lambda x: x["due_idx"] <= d), F.lit(0.0), lambda t, x: t + x["qty"])
    groups = c.cases.select("product", "day0", "daily").distinct().join(asked, ["product", "day0"], "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<struct<due_idx:int,qty:double>>")))
    rest = F.transform(F.sequence(F.lit(0), F.lit(HORIZON - 1)), lambda d: F.col("daily") * d - total(d))
    rows = c.cases.select("case_id", "product", "day0", "net").join(groups.select("product", "day0", rest.alias("rest")), ["product", "day0"])
    return rows.select("case_id", F.round(F.aggregate("rest", F.lit(0.0), lambda t, w: t + F.greatest(F.lit(0.0), -(F.col("net") + w))), 1).alias("net_short"))


def late_list(c: Cascade, faithful: bool = False) -> DataFrame:
    """case_id, jt_id, due, late_by, short, shortfall, p_late, place: the late orders of every case, in the engine's order.

    An order is late by what it lacks, by its truck, or both.  As in the reference, what a short order shows is not its own
    lack but the expected one of all the case's short orders, and their probability; an order that only misses its truck
    shows those of the netted shortage, or of the loss.  Orders without a lack come after those with one; faithful=True
    truncates the expected numbers as the reference does.
    """
    at = c.cases.select("case_id", "product", "day0", "s", "loss")
    short = at.join(c.queue.where("hi is not null"), ["product", "day0"]).withColumn("short", short_of(F.col("s"))).where("short > 0").select("case_id", "jt_id", "short")
    missed = c.missed.select("case_id", "jt_id", F.lit(True).alias("missed")).distinct()
    rows = short.join(missed, ["case_id", "jt_id"], "full").withColumns({"short": F.coalesce("short", F.lit(0.0)), "missed": F.coalesce("missed", F.lit(False))})
    totals = rows.groupBy("case_id").agg(F.sum("short").alias("total"))
    rows = rows.join(totals, "case_id").join(net_shorts(c), "case_id").join(at.select("case_id", "loss"), "case_id")
    due = c.queue.select("jt_id", "due").distinct()
    rows = rows.join(due, "jt_id", "left")
    base = F.when(F.col("short") > 0, F.col("total")).when(F.col("net_short") > 0, F.col("net_short")).otherwise(F.col("loss"))
    expected = F.round(base * stats.triangular_excess(F.lit(0.0)), 1)
    order = Window.partitionBy("case_id").orderBy(F.col("short") == 0, F.asc_nulls_last("due"), "jt_id")
    rows = rows.withColumns({"late_by": F.when((F.col("short") > 0) & F.col("missed"), "qty+time").when(F.col("short") > 0, "qty").otherwise("time"), "shortfall": F.floor(expected).cast("double") if faithful else expected, "p_late": late_probability(base, F.lit(0.0)), "place": F.row_number().over(order).cast("long")})
    return rows.select("case_id", "jt_id", "due", "late_by", "short", "shortfall", "p_late", "place")


def late_counts(c: Cascade) -> DataFrame:
    """case_id, product, day0, loss, n_late, n_today (due on the case's day), shortfall, p_late (null if none is late).

    The rows of late_list(), counted without being made: p_late is that of a case's likeliest late order.  The orders that
    are short come from the sweep, those that miss their truck are counted where they meet the case.
    """
    lacks = short_of(F.col("s")) > 0
    times = c.trucks.groupBy("case_id").agg(F.count_if(~lacks).alias("n_time"), F.count_if(~lacks & (F.col("due_idx") == 0)).alias("_today"))
    out = c.cases.select("case_id", "product", "day0", "loss").join(short_totals(c), "case_id", "left").join(times, "case_id", "left").join(net_shorts(c), "case_id", "left").fillna(0, ["n_qty", "n_today", "n_time", "_today", "shortfall", "net_short"])
    p = lambda base: late_probability(base, F.lit(0.0))
    # of those with a lack the same, of the others too
    likeliest = F.greatest(F.when(F.col("n_qty") > 0, p(F.col("shortfall"))), F.when(F.col("n_time") > 0, p(F.when(F.col("net_short") > 0, F.col("net_short")).otherwise(F.col("loss")))))
    return out.select("case_id", "product", "day0", "loss", (F.col("n_qty") + F.col("n_time")).alias("n_late"), (F.col("n_today") + F.col("_today")).alias("n_today"), F.round("shortfall", 4).alias("shortfall"), likeliest.alias("p_late"))


def impact(cases: DataFrame, lots: DataFrame, events: DataFrame, orders: DataFrame, opening: float | DataFrame = 20.0, fallback: float = 900.0, shipments: DataFrame | None = None, bom: DataFrame | None = None, available: DataFrame | None = None, faithful: bool = False, solved: Cascade | None = None) -> DataFrame:
    """The whole cascade, a row for every case; solved: the cascade() of the same frames, if there is one already.

    The product of a case comes from its station or affected lots, of which there may be none; its orders within the
    horizon meet the product's daily production, less the loss on the first day, once netted by day (net_short) and
    once order by order (shortfall).  n_late counts the orders that are short (n_qty), miss their truck (n_time) or
    both; open orders of the horizon are held against their trucks.  base is the shortfall, else the netted one, else
    the loss where an order misses its truck or, as in the reference, faithful=True; p_late, expected, p50 and p90 are
    the Monte-Carlo step on it in closed form.  material: no_bom, ok or shortage of what makes up net_short or the loss.

    cases: case_id, station_id, start_ts, hours; lots: lot_id, product, qty, created; orders: product, jt_id, qty, due,
    fulfilled; shipments: jt_id, truck_time; bom: product, component, per_unit, scrap; available: component, available.
    """
    c = solved or cascade(cases, lots, events, orders, opening, fallback, shipments)
    times = c.trucks.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_time"), F.count_if(short_of(F.col("s")) > 0).alias("n_both"))
    out = c.cases.join(short_totals(c), "case_id", "left").join(times, "case_id", "left").join(net_shorts(c), "case_id", "left").fillna(0, ["n_qty", "n_time", "n_both", "shortfall", "net_short"])
    out = out.withColumn("n_late", F.col("n_qty") + F.col("n_time") - F.col("n_both"))
    if bom is None:
        out = out.withColumn("material", F.lit("no_bom"))
    else:
        have = available if available is not None else bom.select("component", F.lit(0.0).alias("available")).distinct()
        need = out.select("case_id", "product", F.when(F.col("net_short") > 0, F.col("net_short")).otherwise(F.col("loss")).alias("qty"))
        enough = material_check(need, bom, have).groupBy("case_id").agg(F.bool_and("sufficient").alias("enough"))
        out = out.join(enough, "case_id", "left").withColumn("material", F.when(F.col("enough").isNull(), "no_bom").when(F.col("enough"), "ok").otherwise("shortage"))
    hurt = F.lit(True) if faithful else F.col("n_time") > 0
    out = out.withColumn("base", F.when(F.col("shortfall") > 0, F.col("shortfall")).when(F.col("net_short") > 0, F.col("net_short")).when(hurt, F.col("loss")).otherwise(0.0))
    p = late_probability(F.col("base"), F.lit(0.0))
    monte = {"expected": stats.triangular_excess(F.lit(0.0)), "p50": stats.triangular_quantile(F.lit(0.5)), "p90": stats.triangular_quantile(F.lit(0.9))}
    return out.select("case_id", "loss", time_to_starve(F.lit(80)).alias("hours_to_starve"), "n_affected", "product", "n_late", "n_qty", "n_time", F.round("shortfall", 4).alias("shortfall"), "net_short", "material", F.round("base", 4).alias("base"), *[F.round(F.col("base") * k, 4).alias(name) for name, k in monte.items()], F.round(p, 6).alias("p_late"), recommendation(p, F.col("shortfall")).alias("action"))


def predict(cases: DataFrame, lots: DataFrame, events: DataFrame, orders: DataFrame, opening: float = 20.0) -> DataFrame:
    """The rows of impact() whose cases have affected lots; impact() answers every case."""
    return impact(cases, lots, events, orders, opening).where("n_affected > 0")
