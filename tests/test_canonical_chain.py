"""Raw files to the canonical tables, on small fixtures with drifted headers, a clock that is off, and dirty values."""

from datetime import datetime, timedelta

import pytest

from lotgraph.operators import action, builders, dashboard, forward
from lotgraph.plans import canonical
from lotgraph.schemas import CANONICAL
from lotgraph.sources import readers, writers


def put(root, name, header, rows, sep=",", bom=""):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(bom + "\n".join(sep.join(map(str, r)) for r in [header, *rows]) + "\n", encoding="utf-8")


def fixtures(root):
    put(root, "SRC-01_output/a.csv", ["record_id", "local_lot_label", "model_code", "line_code", "qty_ok", "qty_ng", "event_ts"], [(1, "L-A-0001", "P1", "LINE-A", 190, 10, "29/09/2026 07:00"), (2, "A0001", "P1", "LINE-A", 1, 1, "29/09/2026 08:00"), (3, "LOT-0002", "P01", "LINE-A", 200, "", "29/09/2026 09:00"), (4, "A0003", "P1", "LINE-A", '"1,200"', 0, "30/09/2026 07:30"), (5, "", "P1", "LINE-A", 5, 5, "30/09/2026 07:30")], bom="﻿")
    start = datetime(2026, 9, 29, 7)
    scans, machine = [], []
    for k in range(12):
        at = start + timedelta(hours=k)
        scans.append((f"S{k}", f"L-A-{1 + k % 3:04d}", "", "MOVE", "STN-HT1", at.strftime("%Y-%m-%d %H:%M:%S")))
        machine.append((f"E{k}", "HT1", f"A{1 + k % 3:04d}", "RUN", "X", (at + timedelta(seconds=240)).strftime("%Y-%m-%dT%H:%M:%S")))
    scans += [("S90", "LOT-0002", "LOT-0001", "SPLIT", "STN-M1", "2026-09-29 12:00:00"), ("S91", "LOT-0099", "LOT-0003", "MERGE", "STN-M1", "2026-09-30 12:00:00"), ("S92", "LOT-0003", "", "SPLIT", "STN-M1", "2026-09-30 13:00:00")]
    machine.append(("E99", "M9", "A0001", "RUN", "", "2026-09-29T07:30:00"))
    put(root, "SRC-02_ipc/a.csv", ["ipc_event_id", "machine_code", "local_lot_ref", "event_type", "event_code", "ts_raw"], machine)
    put(root, "SRC-03_qr/a.csv", ["scan_id", "qr_code", "parent_qr_code", "scan_type", "station_code", "scan_ts_raw"], scans)
    put(root, "SRC-04_qc_auto/a.csv", ["qc_record_id", "local_lot_ref", "station_code", "characteristic", "value_raw", "lsl", "usl", "result", "ng_code", "measured_ts_raw"], [("Q1", "A0001", "HT1", "hardness", '"12,5"', 10, 15, "PASS", "", "29/09/2026 07:04:00"), ("Q2", "A0002", "M1", "hardness", "x", 10, 15, "FAIL", "NG-3", "29/09/2026 08:00:00")])
    put(root, "SRC-05_qc_sampling/Data.csv", ["local_lot_ref", "characteristic", "value_raw", "measured_date", "station_code", "inspector"], [("A0001", "width", "3.5", "29/09/2026", "M1", "an")])
    put(root, "SRC-05_qc_sampling/Day_9.csv", ["Mã lô", "Đặc tính", "Giá trị", "Ngày đo", "Trạm"], [("A0002", "width", '"3,75"', "30/09/2026", "M1"), ("", "width", "1", "30/09/2026", "M1")])
    put(root, "SRC-06_jt/a.csv", ["source_order_no", "model_code", "source_line_code", "qty", "due_date_raw", "priority", "customer_code", "status"], [("JT231", "P1", "LINE-A", 300, "01/10/2026", "HIGH", "C1", "OPEN"), ("JT-0232", "P1", "LINE-A", 250, "02/10/2026", "LOW", "C2", "OPEN"), ("JT231", "P1", "LINE-A", 1, "03/10/2026", "LOW", "C2", "OPEN")], sep=";")
    put(root, "SRC-07_inventory/a.csv", ["snapshot_id", "capture_ts_raw", "item_code", "item_type", "location_code", "qty_raw"], [("I1", "29/09/2026 06:00", "C1", "COMPONENT", "W1", 500)])
    put(root, "SRC-08_shipping/a.csv", ["shipment_ref", "order_ref", "truck_ts_raw", "cutoff_ts_raw", "product_code", "qty_planned", "status"], [("SH1", "JT-231", "01/10/2026 16:00", "01/10/2026 15:00", "P1", 300, "DEPARTED"), ("", "JT-232", "", "", "P1", 1, "X")])
    put(root, "SRC-09_incident/a.csv", ["incident_ref", "machine_or_station", "start_ts_raw", "end_ts_raw", "incident_code", "note"], [("INC-1", "HT1", "29/09/2026 10:00", "29/09/2026 18:00", "F-01", "belt")])


def test_raw_files_become_the_canonical_tables(spark, tmp_path):
    fixtures(tmp_path / "raw")
    pool = spark.createDataFrame([(f"LOT-{k:04d}",) for k in (1, 2, 3, 99)], "canonical string")
    bom = spark.createDataFrame([("PROD-P1", "COMP-C1", 2.0), ("PROD-P1", "COMP-C2", 0.5)], "product string, component string, per_unit double")
    material = spark.createDataFrame([("COMP-C1", "MAT-1", "2026-09-20"), ("COMP-C1", "MAT-0", "2026-09-01")], "component string, mat_lot string, received string")
    confirmed = spark.createDataFrame([("JT-0232", "LOT-0002", 180, datetime(2026, 10, 1))], "jt_id string, lot_id string, qty_allocated long, allocation_time timestamp_ntz")
    batches = spark.createDataFrame([("LOT-0003", "BATCH-HT-B07"), ("LOT-0001", None)], "lot_id string, batch string")
    got = canonical.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), pool, bom, material, confirmed, batches)
    assert {n: df.schema.simpleString() for n, df in got.items()} == {n: CANONICAL[n].simpleString() for n in got} and set(got) == set(CANONICAL)
    rows = {n: df.collect() for n, df in got.items()}

    lots = {r.lot_id: r for r in rows["lot"]}
    assert {k: (r.qty, r.qty_ok, r.qty_ng, r.confidence) for k, r in lots.items()} == {"LOT-0001": (200, 190, 10, 1.0), "LOT-0002": (200, 200, 0, 1.0), "LOT-0003": (1200, 1200, 0, 1.0), "LOT-0099": (None, None, None, 0.5)}
    assert lots["LOT-0001"].created_ts == datetime(2026, 9, 29, 7) and lots["LOT-0002"].product_id == "PROD-P1"

    events = {r.event_id: r for r in rows["lot_event"]}
    assert len(events) == 13
    assert all(r.ts_raw - r.ts_aligned == timedelta(seconds=0 if k == "E99" else 240) for k, r in events.items())  # a station without anchors keeps its time

    edges = {(r.parent_lot_id, r.child_lot_id): (r.edge_type, r.confidence, r.qty) for r in rows["lot_edge"]}
    assert edges == {("LOT-0001", "LOT-0002"): ("SPLIT", 1.0, None), ("LOT-0003", "LOT-0099"): ("MERGE", 1.0, None), ("BATCH-HT-B07", "LOT-0003"): ("SPLIT", 0.75, 1200)}

    assert {(r.jt_id, r.qty) for r in rows["jt_order"]} == {("JT-0231", 300), ("JT-0232", 250)}
    taken = {(r.jt_id, r.lot_id): (r.qty_allocated, r.confidence) for r in rows["jt_allocation"]}
    assert taken == {("JT-0231", "LOT-0001"): (200, 0.85), ("JT-0232", "LOT-0002"): (180, 1.0), ("JT-0232", "LOT-0003"): (150, 0.85)}
    assert {(r.lot_id, r.component_id, r.mat_lot_id, r.qty_consumed) for r in rows["material_consumption"]} == {("LOT-0001", "COMP-C1", "MAT-0", 400.0), ("LOT-0002", "COMP-C1", "MAT-0", 400.0), ("LOT-0003", "COMP-C1", "MAT-0", 2400.0)}
    assert [(r.shipment_id, r.jt_id, r.qty_planned, r.truck_time) for r in rows["shipment"]] == [("SH1", "JT-0231", 300, datetime(2026, 10, 1, 16))]
    qc = {(r.test_type, r.lot_id): r for r in rows["qc_result"]}
    assert {k: (r.value, r.result, r.lsl) for k, r in qc.items()} == {("AUTO", "LOT-0001"): (12.5, "OK", 10.0), ("AUTO", "LOT-0002"): (None, "NG", 10.0), ("SAMPLE", "LOT-0001"): (3.5, None, None), ("SAMPLE", "LOT-0002"): (3.75, None, None)}
    assert qc["AUTO", "LOT-0001"].measured_ts == datetime(2026, 9, 29, 7)  # its machine's clock was four minutes ahead
    assert {r.table: r.n_rows for r in canonical.reconstruction_audit(got).collect()} == {n: len(r) for n, r in rows.items()}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/review_queue")).count() == 0


def test_drifting_clocks_are_aligned_by_a_line(spark):
    start = datetime(2026, 9, 1, 8)
    rows = [(d, k, start + timedelta(days=d, hours=k)) for d in range(8) for k in range(6)]
    frame = lambda off: spark.createDataFrame([(f"LOT-{d:02d}{k:02d}", "STN-1", at + timedelta(seconds=off(d))) for d, k, at in rows], "lot_ref_norm string, station_norm string, ts_norm timestamp_ntz")
    staged = {"SRC-02": frame(lambda d: 360 - 1.5 * d * 8), "SRC-03": frame(lambda d: 0)}
    found = canonical.offsets(staged)
    r = found.first()
    assert abs(r.drift - 12) < 0.5 and abs(r.offset + 360) < 2
    got = canonical.aligned(staged, found)["SRC-02"].collect()
    true = {f"LOT-{d:02d}{k:02d}": at for d, k, at in rows}
    assert max(abs((x.ts_aligned - true[x.lot_ref_norm]).total_seconds()) for x in got) < 3


def test_builders_take_frames_that_lack_columns(spark):
    bare = spark.createDataFrame([("LOT-1",), (None,)], "canonical_id string")
    assert [(r.lot_id, r.qty, r.confidence) for r in builders.lots(bare).collect()] == [("LOT-1", 0, 1.0)]
    assert builders.events(bare).columns == CANONICAL["lot_event"].names
    assert builders.qc_results(None, bare).count() == 1
    assert builders.shipments(bare).count() == builders.orders(bare).count() == 0


def test_sheets_formats_and_reports(spark, tmp_path):
    put(tmp_path, "Data.csv", ["a", "b"], [(1, 2)])
    put(tmp_path, "Day_9.csv", ["b", "c"], [(3, 4)])
    got = readers.sheets(spark, {"Data": str(tmp_path / "Data.csv"), "Day_9": str(tmp_path / "Day_9.csv")}).select("_source_sheet", "a", "b", "c").collect()
    assert sorted(map(tuple, got)) == [("Data", "1", "2", None), ("Day_9", None, "3", "4")]
    assert readers.dispatch(spark, [str(tmp_path / "Data.csv")]).count() == 1
    with pytest.raises(ValueError):
        readers.dispatch(spark, ["book.xlsx"])
    impacts = spark.createDataFrame([(1, 8.0), (2, 1.0)], "incident_id int, hours double")
    linked = spark.createDataFrame([(1, "JT-1", "confirmed", 28.8), (1, "JT-2", "inferred", 0.0)], "incident_id int, jt_id string, link string, short double")
    writers.reports(str(tmp_path / "r"), impacts, linked, spark.createDataFrame([("x", "y")], "column string, rule string"), impacts, "2026-10-01")
    read = lambda name: [r.asDict() for r in spark.read.option("header", True).csv(str(tmp_path / "r" / name)).collect()]
    assert sorted((r["incident_id"], r["jt_id"] or "", r["data_kind"]) for r in read("incidents")) == [("1", "JT-1", "pilot"), ("1", "JT-2", "inferred"), ("2", "", "not linked")]
    assert [(r["jt_id"], r["short"], r["data_kind"]) for r in read("orders_at_risk")] == [("JT-1", "29.0", "forecast/pilot")]
    writers.markdown(impacts.withColumnRenamed("incident_id", "case_id"), str(tmp_path / "md"))
    assert "| hours | 8.0 |" in [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    causes = spark.createDataFrame([(1, 2, "BATCH", "B", 0.5), (1, 1, "MACHINE", "M", 0.6)], "case_id int, rank int, kind string, candidate string, score double")
    writers.dashboard_export(impacts.withColumnRenamed("incident_id", "case_id"), causes, str(tmp_path / "json"))
    assert [[c.candidate for c in r.causes or []] for r in spark.read.json(str(tmp_path / "json")).orderBy("case_id").collect()] == [["M", "B"], []]


def test_lookups_and_formats(spark):
    allocation = spark.createDataFrame([("J1", "L1"), ("J1", "L2"), ("J2", "L3")], "jt_id string, lot_id string")
    events = spark.createDataFrame([("S1", "L1"), ("S2", "L3")], "station_id string, lot_id string")
    assert sorted(r.lot_id for r in dashboard.lots_of_order(allocation, ["J1"]).collect()) == ["L1", "L2"]
    assert [r.jt_id for r in dashboard.orders_of_station(events, allocation, "S2").collect()] == ["J2"]
    shown = dashboard.formatted(spark.createDataFrame([(1234.56, datetime(2026, 9, 29, 6, 5))], "n double, t timestamp_ntz"), {"n": 1}, ["t"]).first()
    assert (shown.n, shown.t) == ("1,234.6", "29/09/2026 06:05")


def test_netting_summary_and_drift_of_the_stock(spark):
    net = spark.createDataFrame([("P", d, 0.0, x, x < 0) for d, x in enumerate([5.0, -2.0, 1.0, -3.5])] + [("Q", 0, 0.0, 1.0, False)], "product string, day_idx int, baseline double, incident double, is_short boolean")
    got = {r["product"]: (r.first_short_day, r.n_short_days, r.shortage) for r in forward.netting_summary(net).collect()}
    assert got == {"P": (1, 2, 5.5), "Q": (None, 0, 0.0)}


def test_costs_come_from_a_configuration_file(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# costs\nlabor:\n  operator_hourly_rate: 90000   # by the hour\nshipping:\n  expedite_multiplier: 2.0\ncurrency: VND\n")
    found = readers.config(spark, str(tmp_path / "c.yaml"))
    assert found == {"labor.operator_hourly_rate": "90000", "shipping.expedite_multiplier": "2.0", "currency": "VND"}
    costs = action.costs_from(found)
    assert (costs["overtime_rate"], costs["expedite_factor"], costs["truck"]) == (90_000, 2, action.COSTS["truck"])
    cases = spark.createDataFrame([(1, 8)], "case_id int, hours int")
    impacts = spark.createDataFrame([(1, 28.8)], "case_id int, base double")
    rows = {r.option: r for r in action.what_if(cases, impacts, action.options(spark), costs).collect()}
    assert rows["B"].cost == 2 * (90_000 * 1.5 * 5 + 500_000) and rows["G"].cost >= 5_000_000 * 2
    assert sorted(r.rank_by_cost for r in rows.values()) == sorted(r.rank_by_risk for r in rows.values()) == list(range(1, 8))
