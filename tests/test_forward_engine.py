"""The forward engine answers every case."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotgraph import plans
from lotgraph.operators import action, forward
from lotgraph.operators.running import running

T = dt.datetime(2026, 1, 1, 8)


def frames(spark):
    cases = spark.createDataFrame([("F", "M2", T, 8), ("none", "M9", T, 1), ("line", "STN-M1", T, 1), ("heat", "STN-HT", T, 1)], "case_id string, station_id string, start_ts timestamp_ntz, hours int")
    lots = spark.createDataFrame([("L1", "P1", 900, T), ("L2", "P1", 700, T + dt.timedelta(days=1))], "lot_id string, product string, qty long, created timestamp_ntz")
    events = spark.createDataFrame([(s, "L1", T + dt.timedelta(hours=1)) for s in ("M2", "STN-M1", "STN-HT")], "station_id string, lot_id string, ts timestamp_ntz")
    orders = spark.createDataFrame([("P1", "J1", 500, T, False), ("P1", "J2", 5000, T + dt.timedelta(days=2), False), ("PROD-P3", "J3", 848, T, False)], "product string, jt_id string, qty long, due timestamp_ntz, fulfilled boolean")
    return cases, lots, events, orders


def test_every_case_has_a_row(spark):
    got = {r.case_id: r for r in forward.impact(*frames(spark)).collect()}
    assert {k: (r.n_affected, r.product) for k, r in got.items()} == {"F": (1, "P1"), "none": (0, "PROD-P3"), "line": (1, "PROD-P1"), "heat": (1, "P1")}
    # no lot of PROD-P3: 20 + 900 - 92 = 828 of 848
    assert (got["none"].loss, got["none"].n_late, got["none"].shortfall) == (92.0, 1, 20.0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rows_out_equal_cases_in(spark, sf):
    sf = f"/root/testdata/{sf}"
    cases = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'").select("event_id")
    got = plans.QUERIES["forward_predict"](spark, sf).select("case_id")
    assert got.count() == cases.count() and got.exceptAll(cases).count() == 0


def test_the_whole_cascade_is_chained(spark):
    cases = spark.createDataFrame([("short", "A", T, 8), ("truck", "B", T, 8), ("net", "C", T, 8), ("calm", "D", T, 8)], "case_id string, station_id string, start_ts timestamp_ntz, hours int")
    events = spark.createDataFrame([(s, f"L{s}", T) for s in "ABCD"], "station_id string, lot_id string, ts timestamp_ntz")
    lots = spark.createDataFrame([(f"L{s}", f"P{s}", 800, T) for s in "ABCD"], "lot_id string, product string, qty long, created timestamp_ntz")
    orders = spark.createDataFrame(
        [("PA", "a", 100, T, False), ("PB", "b", 10, T, False), ("PB", "gone", 1, T, True), ("PC", "c", 100, T, True), ("PD", "d", 10, T, False)],
        "product string, jt_id string, qty long, due timestamp_ntz, fulfilled boolean",
    )
    # the outage ends at 16:00, with 80 / 92 hours to starve at 16:52
    trucks = {"a": 16, "b": 16, "gone": 9, "c": 9, "d": 17}
    ships = spark.createDataFrame([(k, T.replace(hour=h)) for k, h in trucks.items()], "jt_id string, truck_time timestamp_ntz")
    bom = spark.createDataFrame([("PA", "x", 2.0, None), ("PB", "x", 2.0, 1.0)], "product string, component string, per_unit double, scrap double")
    have = spark.createDataFrame([("x", 100.0)], "component string, available double")
    ask = lambda **more: {r.case_id: r for r in forward.impact(cases, lots, events, orders, shipments=ships, bom=bom, available=have, **more).collect()}
    got = ask()
    # 20 + 800 - 736 = 84 on day 0
    assert {k: (r.n_late, r.n_qty, r.n_time, r.shortfall, r.net_short, r.base) for k, r in got.items()} == {
        "short": (1, 1, 1, 16.0, 16.0, 16.0), "truck": (1, 0, 1, 0.0, 0.0, 736.0), "net": (0, 0, 0, 0.0, 16.0, 16.0), "calm": (0, 0, 0, 0.0, 0.0, 0.0),
    }
    assert {k: r.material for k, r in got.items()} == {"short": "ok", "truck": "shortage", "net": "no_bom", "calm": "no_bom"}
    assert {k: r.action for k, r in got.items()} == {"short": "resequencing + OT2", "truck": "resequencing + OT2", "net": "resequencing + OT2", "calm": "no_action_needed"}
    assert ask(faithful=True)["calm"].action == "resequencing + OT2"
    grid = {r.case_id: r for r in forward.shortfall_distribution(spark.createDataFrame([(k, r.base) for k, r in got.items()], "case_id string, base double")).collect()}
    for k, r in got.items():
        assert (r.expected, r.p50, r.p90, r.p_late) == pytest.approx((grid[k].mean, grid[k].p50, grid[k].p90, grid[k].p_late), rel=1e-3, abs=1e-3)


def test_one_waterfall_for_many_cases_equals_one_for_each(spark):
    """cascade() against atp_waterfall(), which folds over the orders of each case."""
    rng = random.Random(4)
    cases = spark.createDataFrame([(k, f"S{k % 3}", T + dt.timedelta(days=k % 2, hours=k % 5), 1 + k % 12) for k in range(40)], "case_id int, station_id string, start_ts timestamp_ntz, hours int")
    events = spark.createDataFrame([(f"S{k}", f"L{k}", T + dt.timedelta(days=d, hours=4)) for k in range(3) for d in range(2)], "station_id string, lot_id string, ts timestamp_ntz")
    lots = spark.createDataFrame([(f"L{k}", f"P{k}", 300 * (k + 1), T) for k in range(3)], "lot_id string, product string, qty long, created timestamp_ntz")
    orders = spark.createDataFrame([(f"P{k % 3}", f"J{k:03d}", rng.choice([0, 5, 80, 300, 900]), T + dt.timedelta(days=rng.randrange(-2, 18)), rng.random() < 0.3) for k in range(150)], "product string, jt_id string, qty long, due timestamp_ntz, fulfilled boolean")
    c = forward.cascade(cases, lots, events, orders)
    supply = c.cases.select("case_id", F.lit(20.0).alias("opening"), F.concat(F.array(F.greatest(F.lit(0.0), F.col("daily") - F.col("loss"))), F.array_repeat("daily", 14)).alias("made"))
    due = c.cases.select("case_id", "product", "day0").join(orders, "product").withColumn("due_idx", F.datediff("due", "day0"))
    want = {(r.case_id, r.jt_id): r.short for r in forward.atp_waterfall(due, supply).collect() if r.short > 0}
    got = {(r.case_id, r.jt_id): (r.short, r.late_by) for r in forward.late_list(c).collect()}
    assert want and {k: v[0] for k, v in got.items()} == pytest.approx(want)
    assert {v[1] for v in got.values()} == {"qty"}
    totals = {r.case_id: (r.n_qty, r.shortfall) for r in forward.short_totals(c).collect()}
    for k in range(40):
        own = [v for (case, _), v in want.items() if case == k]
        assert totals[k] == (len(own), pytest.approx(sum(own)))


def test_affected_orders_and_each_fallback(spark):
    cases = spark.createDataFrame([("own", "P1"), ("other", "P3"), ("nothing", "P1"), ("far", "P1")], "case_id string, product string")
    hit = spark.createDataFrame([("own", "L1"), ("own", "L2"), ("other", "L1"), ("nothing", "L9"), ("far", "L5")], "case_id string, lot_id string")
    edges = spark.createDataFrame([("L5", "L6"), ("L6", "L7"), (None, "L1")], "parent string, child string")
    allocation = spark.createDataFrame([("L1", "J1"), ("L1", "J1"), ("L2", "J2"), ("L1", "J3"), ("L7", "J4"), ("L9", None)], "lot_id string, jt_id string")
    orders = spark.createDataFrame([("J1", "P1", T), ("J2", "P2", T), ("J3", "P1", None), ("J4", "P1", T), ("J0", "P9", T + dt.timedelta(days=1))], "jt_id string, product string, due timestamp_ntz")
    got = sorted(map(tuple, forward.affected_orders(cases, hit, edges, allocation, orders, first=2).collect()))
    assert got == [
        ("far", "J4", "product", 1),  # by two generations
        ("nothing", "J0", "first", 2), ("nothing", "J1", "first", 1),
        ("other", "J1", "any", 1), ("other", "J3", "any", 2),  # none of its product
        ("own", "J1", "product", 1), ("own", "J3", "product", 2),  # no due date comes last
    ]


def test_late_orders_show_the_expectation_of_all(spark):
    cases, lots, events, _ = frames(spark)
    cases = cases.where("case_id = 'F'")
    orders = spark.createDataFrame([("P1", "J1", 500, T), ("P1", "J2", 5000, T + dt.timedelta(days=2)), ("P1", "J3", 10, T + dt.timedelta(days=3)), ("P1", "J4", 1, T)], "product string, jt_id string, qty long, due timestamp_ntz")
    ships = spark.createDataFrame([("J1", T.replace(hour=9), "PLANNED"), ("J3", T.replace(hour=10), "x"), ("J4", T.replace(hour=10), " departed")], "jt_id string, truck_time timestamp_ntz, status string")
    known = forward.with_fulfilled(orders, ships)
    assert {r.jt_id: r.fulfilled for r in known.collect()} == {"J1": False, "J2": False, "J3": False, "J4": True}
    c = forward.cascade(cases, lots, events, known, shipments=ships)
    rows = {r.jt_id: r for r in forward.late_list(c).collect()}
    # 20 + 800 - 736 = 84 on day 0: J1 lacks 416 and leaves nothing (J4, delivered, takes 1 below it); two days make 1599, so J2 lacks 3401
    lacks = {"J1": 416.0, "J2": 3401.0}
    assert {k: (r.late_by, r.short, r.place) for k, r in rows.items()} == {"J1": ("qty+time", lacks["J1"], 1), "J2": ("qty", lacks["J2"], 2), "J3": ("time", 0.0, 3)}
    assert rows["J1"].shortfall == rows["J2"].shortfall == round(sum(lacks.values()) * 3.25 / 3, 1)
    net = forward.net_shorts(c).first().net_short
    assert rows["J3"].shortfall == pytest.approx(net * 3.25 / 3, abs=0.051)
    assert forward.late_list(c, faithful=True).where("jt_id = 'J1'").first().shortfall == int(sum(lacks.values()) * 3.25 / 3)
    base = action.late_base(forward.impact(cases, lots, events, known, solved=c), forward.late_list(c)).first()
    assert (base.jt_id, base.base, base.base_p) == ("J1", rows["J1"].shortfall, rows["J1"].p_late)
    calm = spark.createDataFrame([("a", 120.0), ("b", 100.0), ("c", None)], "case_id string, shortfall double")
    none = forward.late_list(c).where("false").withColumn("case_id", F.col("case_id").cast("string"))
    assert {r.case_id: (r.base, r.base_p, r.jt_id) for r in action.late_base(calm, none).collect()} == {"a": (120.0, 0.5, None), "b": (100.0, 0.1, None), "c": (0.0, 0.1, None)}


def test_only_checked_orders_meet_their_trucks(spark):
    cases, lots, events, orders = frames(spark)
    ships = spark.createDataFrame([("J1", T.replace(hour=9)), ("J2", T.replace(hour=9))], "jt_id string, truck_time timestamp_ntz")
    checked = spark.createDataFrame([("F", "J2")], "case_id string, jt_id string")
    got = forward.cascade(cases, lots, events, orders, shipments=ships, checked=checked).missed.collect()
    assert [tuple(r) for r in got] == [("F", "J2")]


def test_running_by_ranges_equals_one_window(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(40), k, rng.choice([None, 1, 2, 5])) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, at int, id int, value long")
    order = [F.col("at"), F.col("id")]
    wanted = {"total": ("sum", F.col("value")), "lo": ("min", F.col("value")), "hi": ("max", F.col("value")), "seen": ("last", F.col("value"))}
    for exclusive in (False, True):
        w = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        want = df.withColumns({"total": F.coalesce(F.sum("value").over(w), F.lit(0)), "lo": F.min("value").over(w), "hi": F.max("value").over(w), "seen": F.last("value", True).over(w)})
        got = running(df, ["key"], F.floor(F.col("at") / 7), order, wanted, exclusive)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
