"""Raw files to metrics: the chain makes the canonical tables, the runs answer the saved cases on them."""

from datetime import datetime, timedelta

import pytest
from test_canonical_chain import put

from lotgraph.plans import canonical, runners

START = datetime(2026, 9, 29, 8)
BATCH = [f"LOT-{k:04d}" for k in range(401, 406)]


def raw_files(root):
    """411 lots: five days of PROD-P1 that make 1,528.6 a day, and the lots of a heat-treatment batch, two of them bad."""
    made, k = [], 0
    p1 = {0: 1528, 1: 1529, 2: 1528, 3: 1529, 4: 1529}  # 7,643 in five days
    for day, total in p1.items():
        for part in range(20):
            k += 1
            made.append((k, f"L-A-{k:04d}", "P1", "LINE-A", total // 20 + (total % 20 if part == 0 else 0), 0, (datetime(2026, 9, 29, 7) + timedelta(days=day, minutes=part)).strftime("%d/%m/%Y %H:%M")))
    others = [f"LOT-{n:04d}" for n in range(101, 412)]
    made += [(n, lot, "P2", "LINE-B", 50, 0, "29/09/2026 09:00") for n, lot in enumerate(others, 1000)]
    put(root, "SRC-01_output/a.csv", ["record_id", "local_lot_label", "model_code", "line_code", "qty_ok", "qty_ng", "event_ts"], made)
    at = lambda hours: (START + timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S")
    machine = [(f"E{n}", "M2", f"LOT-{n:04d}", "RUN", "", at(n / 10)) for n in range(1, 11)]
    machine += [(f"H{n}", "HT1", lot, "RUN", "", (datetime(2026, 10, 2, 8) + timedelta(minutes=n)).strftime("%Y-%m-%dT%H:%M:%S")) for n, lot in enumerate([*BATCH[:3], *others[:31]])]
    put(root, "SRC-02_ipc/a.csv", ["ipc_event_id", "machine_code", "local_lot_ref", "event_type", "event_code", "ts_raw"], machine)
    put(root, "SRC-03_qr/a.csv", ["scan_id", "qr_code", "parent_qr_code", "scan_type", "station_code", "scan_ts_raw"], [("S1", "LOT-0001", "", "MOVE", "STN-M1", "2026-09-28 07:00:00")])
    checks = [(f"Q{n}", lot, "HT1", "press", 12, 10, 15, "FAIL" if lot in BATCH[1:3] else "PASS", "", "03/10/2026 08:00:00") for n, lot in enumerate(BATCH)]
    put(root, "SRC-04_qc_auto/a.csv", ["qc_record_id", "local_lot_ref", "station_code", "characteristic", "value_raw", "lsl", "usl", "result", "ng_code", "measured_ts_raw"], checks)
    put(root, "SRC-05_qc_sampling/Data.csv", ["local_lot_ref", "characteristic", "value_raw", "measured_date", "station_code", "inspector"], [("LOT-0001", "width", "3.5", "29/09/2026", "M1", "an")])
    orders = [("JT-0001", 600, "01/10/2026"), ("JT-0005", 900, "01/10/2026"), ("JT231", 1300, "01/10/2026"), ("JT-0240", 900, "03/10/2026")]
    put(root, "SRC-06_jt/a.csv", ["source_order_no", "model_code", "source_line_code", "qty", "due_date_raw", "priority", "customer_code", "status"], [(jt, "P1", "LINE-A", qty, due, "HIGH", "C1", "OPEN") for jt, qty, due in orders], sep=";")
    put(root, "SRC-07_inventory/a.csv", ["snapshot_id", "capture_ts_raw", "item_code", "item_type", "location_code", "qty_raw"], [("I1", "29/09/2026 06:00", "C1", "COMPONENT", "W1", 500)])
    ships = [(f"SH{n}", jt, "01/10/2026 16:00", "01/10/2026 15:00", "P1", qty, "DEPARTED" if jt == "JT-0001" else "PLANNED") for n, (jt, qty, _) in enumerate(orders)]
    put(root, "SRC-08_shipping/a.csv", ["shipment_ref", "order_ref", "truck_ts_raw", "cutoff_ts_raw", "product_code", "qty_planned", "status"], ships)
    put(root, "SRC-09_incident/a.csv", ["incident_ref", "machine_or_station", "start_ts_raw", "end_ts_raw", "incident_code", "note"], [("INC-1", "M2", "29/09/2026 08:00", "29/09/2026 16:00", "F-01", "belt")])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    raw_files(root / "raw")
    pool = spark.createDataFrame([(f"LOT-{k:04d}",) for k in range(1, 412)], "canonical string")
    bom = spark.createDataFrame([("PROD-P1", "COMP-C1", 2.0)], "product string, component string, per_unit double")
    material = spark.createDataFrame([("COMP-C1", "MAT-1", "2026-09-20")], "component string, mat_lot string, received string")
    batches = spark.createDataFrame([(lot, "BATCH-HT-B07") for lot in BATCH], "lot_id string, batch string")
    return canonical.run(spark, str(root / "raw"), str(root / "out"), pool, bom, material, batches=batches)


def test_saved_cases_from_raw_files(spark, tables):
    cases = spark.createDataFrame([("F01", "STN-M2", START, 8)], "case_id string, station_id string, start_ts timestamp_ntz, hours int")
    run = runners.run_forward(cases, tables)
    impact = run.impact.first()
    assert (impact.loss, impact.product, impact.n_affected) == (736.0, "PROD-P1", 10)
    assert impact.shortfall == pytest.approx(28.8)  # 450 + 792.6 + 1528.6 - 600 - 900 of 1300
    late = run.late.collect()
    assert [(r.jt_id, r.late_by, r.short, r.shortfall) for r in late] == [("JT-0231", "qty", pytest.approx(28.8), 31.0)]
    assert {r.jt_id for r in run.reached.where("place <= 5").collect()} <= {"JT-0001", "JT-0005", "JT-0231", "JT-0240"}

    causes = runners.run_backward(spark.createDataFrame([("R01", "LOT-0403")], "case_id string, lot_id string"), tables)
    batch = next(r for r in causes.collect() if r.kind == "BATCH")
    assert (batch.candidate, batch.a, batch.b, batch.c, batch.d, batch["rank"]) == ("BATCH-HT-B07", 2, 3, 0, 406, 1)
    assert (batch.p, batch.lift) == (pytest.approx(0.0001186873, abs=1e-9), pytest.approx(82.2))
    assert (batch.n_isolated, batch.n_baseline, round(batch.reduction, 4)) == (5, 34, 0.8529)

    options = runners.run_what_if(cases, run).checkpoint()
    got = {r.option: (round(r.p_late, 4), r.cost) for r in options.collect()}
    assert got["E"][1] == 3_700_000 and got["E"][0] <= 0.05
    card = runners.action_cards(options).first()
    assert (card.option, card.cost, len(card.table)) == ("E", 3_700_000, 7) and card.reason.startswith("least cost")
    steps = [r.step for r in runners.walk(run, causes, options).orderBy("step").collect()]
    assert steps[:2] == ["1 impact", "2 late"] and steps[-1] == "4 option" and steps.count("3 cause") == causes.count()

    expected = spark.createDataFrame([("F01", ["JT-0231"], 29.0)], "case_id string, late array<string>, short double")
    named = spark.createDataFrame([("R01", "BATCH-HT-B07")], "case_id string, cause string")
    report = {r.metric: (round(r.value, 6), r.passed) for r in runners.report(run, causes, expected, named).collect()}
    assert report["forward_f1"] == (1.0, True) and report["cause_top3"] == (1.0, True) and report["shortfall_mape"] == (0.0, True)
    assert report["cause_top1"] == (1.0, None)

    # the validation table: golden fields against the run's
    golden = spark.createDataFrame([("F01", 736.0, 29.0, 2)], "case_id string, loss double, shortfall double, n_late long")
    shown = {r.field: r.passed for r in runners.differences(golden, run.impact, ["case_id"], tolerance=0.01).collect()}
    assert shown == {"loss": True, "shortfall": True, "n_late": False}


def test_orders_of_the_first_day_see_the_opening_stock_only(spark):
    from lotgraph.operators import forward

    cases = spark.createDataFrame([("a", "M2", START, 8), ("b", "M2", START, 1)], "case_id string, station_id string, start_ts timestamp_ntz, hours int")
    lots = spark.createDataFrame([("L", "P", 1000, START)], "lot_id string, product string, qty long, created timestamp_ntz")
    events = spark.createDataFrame([("M2", "L", START)], "station_id string, lot_id string, ts timestamp_ntz")
    orders = spark.createDataFrame([("P", "J0", 30, START, False), ("P", "J1", 5, START, True), ("P", "J2", 300, START + timedelta(days=1), False)], "product string, jt_id string, qty long, due timestamp_ntz, fulfilled boolean")
    c = forward.cascade(cases, lots, events, orders, 20.0, due_day=False)
    # J0 lacks 10 of 30 whatever the case; J1, delivered, takes 5 below nothing; day 0 then makes 264 or 908
    assert sorted((r.case_id, r.jt_id, r.short) for r in forward.late_list(c).collect()) == [("a", "J0", 10.0), ("a", "J2", 41.0), ("b", "J0", 10.0)]
    assert {r.case_id: (r.n_qty, round(r.shortfall, 4)) for r in forward.short_totals(c).collect()} == {"a": (2, 51.0), "b": (1, 10.0)}
