"""Import transactions, drift detectors, further rules, and the sweeps of resolution, FIFO and control charts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotgraph.operators import dashboard, imports, quality, reconstruct, resolve, spc
from lotgraph.schemas import SOURCES

T = datetime(2026, 9, 29, 8)
GROUPS = {
    "incident": imports.Group({"incident_id": ("Mã sự cố",), "station": ("Máy",), "start": ("Bắt đầu",), "hours": ("duration_h",), "lots": ("affected_lots",), "status": ("status",)}, ("incident_id", "station", "start"), ("incident_id",), dates=("start",), numbers=("hours",), enums={"status": ("open", "closed")}, foreign={"lots": "lot", "station": "station"}, listed=("lots",)),
    "other": imports.Group({"a": ("a",), "b": ("b",)}, ("a", "b"), ("a",)),
}


def raw(spark, rows):
    return spark.createDataFrame([(f"f_{k:06d}", *r) for k, r in enumerate(rows)], "_raw_row_id string, `mã  sự cố` string, MAY string, `Bắt đầu` string, duration_h string, affected_lots string, status string")


ROWS = [
    ("I1", "M1", "29/09/2026 08:00", "8", "L1, L2", "open"),
    ("I2", "M1", "31/13/2026", "abc", "L1", "open"),
    ("", "M9", "29/09/2026 08:00", "1,5", "L1,L9", "gone"),
    ("I1", "M1", "30/09/2026 08:00", "2", None, None),
    ("I3", "M2", "2026-09-30 09:00:00", "1,5", None, "closed"),
]


def known(spark):
    return {"lot": spark.createDataFrame([("L1",), ("L2",)], "lot_id string"), "station": spark.createDataFrame([("M1",), ("M2",)], "station_id string")}


def test_import_is_a_transaction(spark, tmp_path):
    staged = imports.stage(raw(spark, ROWS), GROUPS, known(spark))
    assert staged.group == "incident" and staged.unmapped == []
    assert sorted((r._row[-1], r.column, r.kind) for r in staged.issues.collect()) == [
        ("1", "hours", "invalid"), ("1", "start", "invalid"), ("2", "incident_id", "incomplete"), ("2", "lots", "reference"), ("2", "station", "reference"), ("2", "status", "invalid"), ("3", "incident_id", "repeated"),
    ]
    state = imports.summary(staged).first()
    assert (state.group, state.state, state.n_valid, state.n_invalid, state.n_issues) == ("incident", "partly valid", 2, 3, 7)

    table = imports.VersionedTable(spark, str(tmp_path / "incident"))
    old = spark.createDataFrame([("I1", "M2", None, 1.0, "by hand"), ("I0", "M2", None, None, None)], "incident_id string, station string, start timestamp_ntz, hours double, note string")
    assert table.version() is None
    table.create(old)
    assert table.commit(staged, GROUPS["incident"], "a.csv") == 1
    rows = {r.incident_id: tuple(r)[1:] for r in table.read().collect()}
    assert rows == {"I0": ("M2", None, None, None), "I1": ("M1", T, 8.0, "by hand"), "I3": ("M2", datetime(2026, 9, 30, 9), 1.5, None)}
    # the same file again changes nothing, a corrected one completes it, and earlier versions stay
    assert table.commit(imports.stage(raw(spark, ROWS), GROUPS, known(spark)), GROUPS["incident"], "a.csv") == 2
    assert {r.incident_id: tuple(r)[1:] for r in table.read().collect()} == rows
    fixed = [("I2", "M1", "01/10/2026 08:00", "3", "L1", "open")]
    assert table.commit(imports.stage(raw(spark, fixed), GROUPS, known(spark)), GROUPS["incident"], "b.csv") == 3
    assert table.read().count() == 4 and table.read(0).count() == 2 and table.issues(1).count() == 7
    assert [(r.version, r.file, r.state, r.n_valid) for r in table.log().orderBy("version").collect()] == [(0, "", "valid", 2), (1, "a.csv", "partly valid", 2), (2, "a.csv", "partly valid", 2), (3, "b.csv", "valid", 1)]
    # a version without its log row, as a run that died leaves it, is not read and is written anew
    spark.range(3).write.parquet(str(tmp_path / "incident" / "version=4"))
    assert table.version() == 3
    assert table.commit(imports.stage(raw(spark, fixed), GROUPS, known(spark)), GROUPS["incident"], "b.csv") == 4 and table.read().count() == 4


def test_files_that_can_not_be_imported(spark, tmp_path):
    with pytest.raises(ValueError, match="no table"):
        imports.stage(spark.createDataFrame([("r", "1")], "_raw_row_id string, z string"), GROUPS, known(spark))
    lacking = raw(spark, ROWS).drop("Bắt đầu")
    staged = imports.stage(lacking, GROUPS, known(spark), group="incident")
    assert staged.unmapped == ["start"] and imports.summary(staged).first().state == "invalid"
    table = imports.VersionedTable(spark, str(tmp_path / "t"))
    table.create(spark.createDataFrame([("I1",)], "incident_id string"))
    with pytest.raises(ValueError, match="lacks start"):
        table.commit(staged, GROUPS["incident"], "c.csv")
    empty = imports.stage(raw(spark, ROWS).limit(0), GROUPS, known(spark))
    with pytest.raises(ValueError, match="no valid rows"):
        table.commit(empty, GROUPS["incident"], "d.csv")
    assert table.version() == 0


def test_header_and_clock_drift(spark):
    sheets = spark.createDataFrame([("Data", "A1", "1", None, None, None), ("Day_9", None, None, "A2", "2", "x"), ("Data", "A3", None, None, None, None)], "_source_sheet string, local_lot_ref string, value_raw string, `Mã lô` string, `Giá trị` string, remark string")
    aliases = {k: SOURCES["SRC-05"].aliases[k] for k in ("lot_ref_raw", "value_raw", "station_raw")}
    got = sorted((r.sheet, r.target or "", r.column or "", r.n, r.state) for r in quality.header_drift(sheets, aliases).collect())
    assert got == [
        ("Data", "lot_ref_raw", "local_lot_ref", 2, "known"), ("Data", "station_raw", "", 0, "missing"), ("Data", "value_raw", "value_raw", 1, "known"),
        ("Day_9", "", "remark", 1, "unknown"), ("Day_9", "lot_ref_raw", "Mã lô", 1, "drifted"), ("Day_9", "station_raw", "", 0, "missing"), ("Day_9", "value_raw", "Giá trị", 1, "drifted"),
    ]
    pairs = spark.createDataFrame([(key, day, float(diff(day, k))) for key, diff in {"even": lambda d, k: k % 3, "off": lambda d, k: 240 + k % 2, "drifts": lambda d, k: 12 * d - 40}.items() for day in range(8) for k in range(6)], "key string, day int, diff double")
    clocks = quality.clock_residuals(pairs, "key", "day")
    assert {r.key: r.found for r in clocks.collect()} == {"even": False, "off": True, "drifts": True}
    signs = {r.code: (r.found, r.n) for r in quality.drift_signs(clocks, quality.header_drift(sheets, aliases)).collect()}
    assert signs == {"D01": (True, 2), "D04": (True, 4)}


def test_further_rules_and_indicators(spark):
    edges = spark.createDataFrame([("B", "x", "SPLIT"), ("B", "y", "SPLIT"), ("B", "y", "SPLIT"), ("C", "z", "MERGE")], "parent string, child string, edge_type string")
    stated = spark.createDataFrame([("B", 2), ("C", 1)], "parent string, stated int")
    assert [tuple(r) for r in quality.split_counts(edges, stated).collect()] == [("C", 0, 1)]
    snapshots = spark.createDataFrame([("P1", 450, T), ("P2", 590, T), ("P1", 1, T + timedelta(days=1))], "item string, qty long, at timestamp_ntz")
    stock = spark.createDataFrame([("P1", 450), ("P2", 600), ("P3", 5)], "item string, stated long")
    assert sorted(map(tuple, quality.stock_differs(snapshots, stock, F.col("at") == F.lit(T)).collect())) == [("P2", 590, 600), ("P3", None, 5)]
    sources = {"SRC-01": spark.createDataFrame([("1", "a.csv"), ("2", "b.csv")], "x string, _source_file string")}
    assert [tuple(r) for r in quality.ingest_summary(sources).collect()] == [("SRC-01", 2, 1, 2)]
    incidents = spark.createDataFrame([(1, "open"), (2, "open"), (3, "closed by hand"), (4, None)], "incident_id int, status string")
    linked = spark.createDataFrame([(1, "J1", 5.0), (2, "J1", 7.0), (2, "J2", 0.0)], "incident_id int, jt_id string, short double")
    hit = spark.createDataFrame([(1, "L1"), (2, "L1"), (2, "L2")], "incident_id int, lot_id string")
    assert {r.kpi: r.value for r in dashboard.order_kpis(incidents, linked, hit).collect()} == {"incidents_open": 2, "incidents_closed_by_hand": 1, "incidents_unknown": 1, "shortfall": 7, "orders_at_risk": 1, "orders_linked": 2, "lots_affected": 2}


def test_nearest_sighting_equals_all_pairs(spark):
    rng = random.Random(2)
    times = lambda n: [T + timedelta(seconds=rng.randrange(6000)) for _ in range(n)]
    seen = [(rng.choice("ABC"), f"LOT-{rng.randrange(30):02d}", t) for t in times(120)] + [("A", "LOT-99", T), ("B", "LOT-98", T), ("A", None, None)]
    asked = [(rng.choice("ABC"), f"x{k}", t) for k, t in enumerate(times(80))] + [("A", "same", T), ("B", "none", None)]
    got = resolve.nearest(spark.createDataFrame(asked, "source string, alias string, ts timestamp_ntz"), spark.createDataFrame(seen, "source string, canonical string, ts timestamp_ntz"), 300, span=500)
    want = {}
    for s, a, t in asked:
        near = [(abs((t2 - t).total_seconds()), c) for s2, c, t2 in seen if t and t2 and s2 != s and abs((t2 - t).total_seconds()) <= 300]
        if near:
            want[a] = (s, min(near)[1], int(min(near)[0]))
    assert {r.alias: (r.source, r.canonical, r.gap) for r in got.collect()} == want


def test_fifo_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(reconstruct, "STRETCH", 50)
    rng = random.Random(6)
    orders = [(p, f"J{k:03d}", rng.choice([0, 7, 40, 260]), T + timedelta(days=rng.randrange(9))) for p in "pq" for k in range(40)]
    lots = [(p, f"L{k:03d}", rng.choice([0, 11, 90]), T + timedelta(days=rng.randrange(9))) for p in "pq" for k in range(60)]
    want = {}
    for p in "pq":
        supply = [[lot, q] for _, lot, q, _ in sorted((r for r in lots if r[0] == p), key=lambda r: (r[3], r[1]))]
        for _, jt, need, _ in sorted((r for r in orders if r[0] == p), key=lambda r: (r[3], r[1])):
            for s in supply:
                take = min(need, s[1])
                if take:
                    want[p, jt, s[0]] = take
                need, s[1] = need - take, s[1] - take
    got = reconstruct.fifo(spark.createDataFrame(orders, "product string, jt_id string, qty long, due timestamp_ntz"), spark.createDataFrame(lots, "product string, lot_id string, qty long, created timestamp_ntz"))
    assert {(r["product"], r.jt_id, r.lot_id): r["take"] for r in got.collect()} == want


def test_control_rules_across_blocks(spark, monkeypatch):
    rng = random.Random(8)
    values = [rng.gauss(0, 1) + (3 if 40 <= k < 60 else 0) + (0.4 * (k - 90) if 90 <= k < 99 else 0) for k in range(140)]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "series string, ord int, value double")
    rules = (spc.nelson1, spc.nelson2, spc.nelson3, spc.nelson5)
    answers = lambda: [sorted(map(tuple, rule(df).collect())) for rule in rules] + [list(map(tuple, spc.summary(df).collect())), list(map(tuple, spc.machine_signal(df).collect()))]
    whole = answers()
    assert whole[0] and whole[1] and whole[2] and whole[3] or whole[1]
    monkeypatch.setattr(spc, "BLOCK", 11)
    again = answers()
    assert again[:4] == whole[:4] and [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in again[4]] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in whole[4]] and again[5] == whole[5]
    assert sum(map(len, whole[:4])) / 20 == pytest.approx(whole[5][0][1]) or whole[5][0][1] == 1.0
