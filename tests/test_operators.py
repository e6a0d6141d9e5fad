import datetime as dt

import pytest
from pyspark.sql import functions as F
from pytest import approx

from lotgraph.operators import action, align, backward, dashboard, forward, graph, reconstruct, resolve, spc
from lotgraph.schemas import CANONICAL
from lotgraph.sources import readers, writers
from lotgraph.streaming import events as streaming


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_fifo_splits_orders_and_lots(spark):
    orders = spark.createDataFrame([("p", "J1", 300, 1), ("p", "J2", 250, 2), (None, "J3", 5, 3)], "product string, jt_id string, qty long, due int")
    lots = spark.createDataFrame([("p", "L1", 200, 1), ("p", "L2", 200, 2), ("p", "L3", 200, 3), ("p", "L0", 0, 0)], "product string, lot_id string, qty long, created int")
    got = rows(reconstruct.fifo(orders, lots).select("jt_id", "lot_id", "take"), "jt_id", "lot_id")
    assert got == [("J1", "L1", 200), ("J1", "L2", 100), ("J2", "L2", 100), ("J2", "L3", 150)]


def test_waterfall_of_the_saved_case(spark):
    orders = spark.createDataFrame([("F01", "JT-0001", 600, 2, True), ("F01", "JT-0005", 900, 2, False), ("F01", "JT-0231", 1300, 2, False)], "case_id string, jt_id string, qty long, due_idx int, fulfilled boolean")
    supply = spark.createDataFrame([("F01", 450.0, [0.0, 1528.6 - 736.0, 1528.6])], "case_id string, opening double, made array<double>")
    got = rows(forward.atp_waterfall(orders, supply).select("jt_id", "short"), "jt_id")
    assert got == [("JT-0001", 0.0), ("JT-0005", 0.0), ("JT-0231", approx(28.8))]
    assert spark.range(1).select(forward.qty_loss(F.lit(8))).first()[0] == 736.0


def test_a_short_order_leaves_nothing_and_a_fulfilled_one_may_go_below_zero(spark):
    orders = spark.createDataFrame([("c", "a", 50, 0, False), ("c", "b", 5, 0, False), ("c", "d", 20, 1, True), ("c", "e", 1, 1, False)], "case_id string, jt_id string, qty long, due_idx int, fulfilled boolean")
    supply = spark.createDataFrame([("c", 30.0, [0.0, 10.0])], "case_id string, opening double, made array<double>")
    assert rows(forward.atp_waterfall(orders, supply).select("jt_id", "short"), "jt_id") == [("a", 20.0), ("b", 5.0), ("d", 0.0), ("e", 1.0)]


def test_scheduled_hours_and_recommendation(spark):
    t = lambda h, d=1: F.lit(f"2026-01-0{d} {h:02d}:00:00").cast("timestamp_ntz")
    got = spark.range(1).select(forward.scheduled_hours(t(16), t(0, 2)), forward.scheduled_hours(t(23), t(23)), forward.recommendation(F.lit(0.95), F.lit(3)), forward.recommendation(F.lit(0.0), F.lit(3)), forward.time_to_starve(F.lit(80), 0)).first()
    assert tuple(got) == (6.0, 0.0, "resequencing + OT2", "no_action_needed", float("inf"))


def test_what_if_of_the_saved_case(spark):
    case = spark.createDataFrame([("F01", 31.0, 8.0), ("none", 0.0, 1.0)], "case_id string, base double, hours double")
    out = action.scored(action.simulate(case, action.options(spark)))
    got = {r.option: (round(r.p_late, 4), round(r.cost)) for r in out.where("case_id = 'F01'").collect()}
    assert got["B"][0] == approx(0.2603, abs=2e-3) and got["D"][0] == approx(0.2553, abs=2e-3) and got["E"][0] == approx(0.0111, abs=1e-3)
    assert {k: v[1] for k, v in got.items()} == {"A": 740_000, "B": 2_200_000, "C": 4_400_000, "D": 1_500_000, "E": 3_700_000, "F": 520_000, "G": 15_740_000}
    assert rows(action.choose(out, ["case_id"]).select("case_id", "option", "feasible"), "case_id") == [("F01", "E", True), ("none", "A", True)]
    robust = {r.case_id: r.robust for r in action.sensitivity_threshold(out).collect()}
    assert robust == {"F01": False, "none": True}


def test_nelson_rules(spark):
    def series(values):
        return spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(values)], "series string, ord int, value double")

    assert rows(spc.nelson1(series([0, 1] * 10 + [50])), "start") == [("s", 20, 20, "above")]
    assert rows(spc.nelson2(series([1] * 9 + [-3] * 3)), "start") == [("s", 0, 8, "above")]
    assert rows(spc.nelson3(series([1, 2, 3, 4, 5, 6, 0, 0])), "start") == [("s", 0, 5, "rising")]
    assert rows(spc.nelson1(series([2, 2, 2])), "start") == []
    assert rows(spc.nelson2(series([1, 1])), "start") == []
    cap = spc.capability(series([1, 2, 3]).withColumns({"lsl": F.lit(0.0), "usl": F.lit(9.0)})).first()
    assert (cap.trend, cap.cpk) == ("INSUFFICIENT_DATA", None)
    same = spc.capability(series([2] * 6).withColumns({"lsl": F.lit(0.0), "usl": F.lit(9.0)})).first()
    assert same.trend == "ZERO_VARIANCE"


def test_graph_depths_cycles_and_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")], "parent string, child string")
    seed = spark.createDataFrame([("d",)], "seed string")
    assert rows(graph.reach(edges, seed).select("node", "depth"), "node") == [("a", 2), ("b", 2), ("c", 1), ("x", 1)]
    assert [r[0] for r in rows(graph.reach(edges, seed, max_depth=1).select("node"), "node")] == ["c", "x"]
    assert [r[0] for r in rows(graph.bfs(edges, seed, max_depth=0).select("node"), "node")] == ["c", "d", "x"]
    both = spark.createDataFrame([("d",), ("c",), ("unknown",)], "seed string")
    assert [r[0] for r in rows(graph.common_ancestors(edges, both), "node")] == ["a", "b", "c"]
    pair = spark.createDataFrame([("a", "d")], "source string, target string")
    assert rows(graph.shortest_path(edges, pair), "source") == [("a", "d", 2, "a>c>d")]
    assert graph.is_acyclic(edges)
    assert not graph.is_acyclic(edges.union(spark.createDataFrame([("d", "a")], edges.schema)))


def test_candidates_contingency_and_rank(spark):
    edges = spark.createDataFrame([("BATCH-HT-B07", f"L{k}") for k in range(5)], "parent string, child string")
    lots = spark.createDataFrame([(f"L{k}", k < 2) for k in range(411)], "lot_id string, is_ng boolean")
    events = spark.createDataFrame([("L0", "M1", dt.datetime(2026, 1, 1, 8)), ("L1", "M1", dt.datetime(2026, 1, 1, 9)), ("L9", "M1", dt.datetime(2026, 1, 3, 9))], "lot_id string, station_id string, ts timestamp_ntz")
    used = spark.createDataFrame([("L0", "A")], "lot_id string, mat_lot string")
    case = spark.createDataFrame([("R01", "L0")], "case_id string, lot_id string")
    touched = backward.members(edges, events, used, lots)
    found = backward.candidates(backward.lineage(case, edges), touched)
    assert rows(found.select("kind", "candidate"), "kind") == [("BATCH", "BATCH-HT-B07"), ("MACHINE", "M1"), ("MATERIAL", "A")]
    table = backward.contingency(touched, lots)
    got = {r.kind: (r.a, r.b, r.c, r.d) for r in table.collect()}
    assert got == {"BATCH": (2, 3, 0, 406), "MACHINE": (2, 1, 0, 408), "MATERIAL": (1, 0, 1, 409)}
    best = backward.diagnose(case, edges, events, used, lots)
    assert [(r.rank, r.kind) for r in best.orderBy("rank").collect()][0] == (1, "MACHINE") and best.count() == 3
    kept = {r.candidate: (r.n_isolated, r.n_baseline) for r in best.collect()}
    assert kept == {"M1": (2, 2), "BATCH-HT-B07": (5, 2), "A": (1, 2)}
    narrow = backward.ancestor_members(backward.lineage(case, edges), touched)
    assert {r.kind: (r.a, r.b) for r in backward.contingency(narrow, lots).collect()} == {"MACHINE": (1, 0), "MATERIAL": (1, 0), "BATCH": (2, 3)}
    assert [r.insufficient for r in backward.insufficient(best).collect()] == [False]


def test_forward_prediction(spark):
    t = dt.datetime(2026, 1, 1, 8)
    cases = spark.createDataFrame([("F", "M2", t, 8), ("none", "M9", t, 1)], "case_id string, station_id string, start_ts timestamp_ntz, hours int")
    lots = spark.createDataFrame([("L1", "P1", 900, t), ("L2", "P1", 700, t + dt.timedelta(days=1))], "lot_id string, product string, qty long, created timestamp_ntz")
    events = spark.createDataFrame([("M2", "L1", t + dt.timedelta(hours=1))], "station_id string, lot_id string, ts timestamp_ntz")
    orders = spark.createDataFrame([("P1", "J1", 500, t, False), ("P1", "J2", 5000, t + dt.timedelta(days=2), False), ("P1", "J3", 1, t - dt.timedelta(days=1), False)], "product string, jt_id string, qty long, due timestamp_ntz, fulfilled boolean")
    got = forward.predict(cases, lots, events, orders).collect()
    assert len(got) == 1
    # 20 + max(0, 800 - 736) = 84 on the first day: 416 short; then two days of 800
    assert (got[0].loss, got[0].n_affected, got[0].product, got[0].n_late, got[0].shortfall, got[0].action) == (736.0, 1, "P1", 2, 416.0 + 3400.0, "resequencing + OT2")


def test_alignment_of_a_shifted_clock(spark):
    t0 = dt.datetime(2026, 1, 1)
    a = [("m", t0 + dt.timedelta(hours=k)) for k in range(20)]
    b = [("m", t0 + dt.timedelta(hours=k, seconds=240 if k else 900)) for k in range(20)]
    schema = "station string, ts timestamp_ntz"
    pairs = align.anchors(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["station"], 1000)
    offset = align.robust_offset(pairs, "station")
    assert (offset.first().offset, offset.first().n) == (240.0, 19)
    aligned = align.apply_offset(spark.createDataFrame(a[:1], schema), offset, "station").first().ts_aligned
    assert aligned == t0 + dt.timedelta(seconds=240)
    assert align.apply_offset(spark.createDataFrame(a[:1], schema), offset, "station", faithful=True).first().ts_aligned == t0 - dt.timedelta(seconds=240)
    flat = spark.createDataFrame([("m", d, 5.0) for d in range(3) for _ in range(3)], "station string, day int, diff double")
    assert tuple(align.drift(flat, "station", "day").first())[1:4] == (0.0, 5.0, 0.0)


def test_resolution_tiers(spark):
    t = dt.datetime(2026, 1, 1)
    aliases = spark.createDataFrame([("s", "LOT-0001", t), ("s", "A0002", t), ("s", "odd", t), ("s", "far", t + dt.timedelta(days=1))], "source string, alias string, ts timestamp_ntz")
    seen = spark.createDataFrame([("r", "LOT-0003", t + dt.timedelta(seconds=60))], "source string, canonical string, ts timestamp_ntz")
    got = {r.alias: (r.canonical, r.method, round(r.confidence, 3)) for r in resolve.resolve(aliases, resolve.canonical_pool(spark, 5), seen).collect()}
    assert got == {"LOT-0001": ("LOT-0001", "exact", 1.0), "A0002": ("LOT-0002", "suffix", 0.95), "odd": ("LOT-0003", "temporal", 0.68), "far": (None, "no_match", 0.0)}


def test_genealogy_from_scans_and_missing_lots(spark):
    scans = spark.createDataFrame([("SPLIT", "a", "b"), ("MOVE", "a", "c")], "scan_type string, parent string, child string")
    batches = spark.createDataFrame([("b", "a"), ("d", "a")], "lot_id string, batch string")
    assert rows(reconstruct.edges_from_scans(scans, batches).select("parent", "child", "confidence"), "child") == [("a", "b", 1.0), ("a", "d", 0.75)]


def test_upsert_links_and_stock(spark):
    facts = spark.createDataFrame([(1, 5, "x"), (1, 9, "y")], "k int, t int, v string")
    probes = spark.createDataFrame([(1, 4, "a"), (1, 5, "b"), (1, 20, "c")], "k int, u int, id string")
    assert rows(dashboard.latest_before(facts, probes, ["k"], "t", "u", "v").select("id", "latest_v"), "id") == [("a", None), ("b", "x"), ("c", "y")]


def test_csv_scan_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x;y\n1;NA\n;\"q;r\"\n".encode())
    df = readers.with_row_ids(readers.csv_text(spark, str(tmp_path / "a.csv"), ";"))
    assert [(r.x, r.y, r._raw_row_id) for r in df.orderBy("_raw_row_id").collect()] == [("1", "NA", "a_000000"), (None, "q;r", "a_000001")]
    assert tuple(readers.audit(df).first())[0::2] == (2, 1)
    lot = spark.createDataFrame([], CANONICAL["lot"])
    writers.parquet_layer({"lot": lot}, str(tmp_path / "layer"))
    assert tuple(writers.verify(spark, str(tmp_path / "layer"), {"lot": CANONICAL["lot"]}).first()) == ("lot", 0, "")
    writers.graphml(spark.createDataFrame([("a&", "b", None)], "parent_lot_id string, child_lot_id string, edge_type string"), str(tmp_path / "g"))
    assert 'source="a&amp;"' in spark.read.text(str(tmp_path / "g/1-edges")).first()[0]


@pytest.mark.parametrize("kind", ["counts", "sessions"])
def test_streaming_equals_batch(spark, tmp_path, kind):
    t = dt.datetime(2026, 1, 1)
    schema = "user_id int, ts timestamp, event_type string, value double"

    def arrive(*minutes):
        spark.createDataFrame([(1, t + dt.timedelta(minutes=m), "view", 1.0) for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive(0, 5, 90)
    op = streaming.windowed_counts if kind == "counts" else streaming.sessions
    stream = op(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete" if kind == "counts" else "append").format("memory").queryName(f"out_{kind}").start()
    q.processAllAvailable()
    arrive(900)  # moves the watermark, which closes the sessions before
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start - t, r.n) for r in spark.table(f"out_{kind}").collect())
    hours = lambda h: dt.timedelta(hours=h)
    assert got == ([(hours(0), 2), (hours(1), 1), (hours(15), 1)] if kind == "counts" else [(hours(0), 2), (hours(1.5), 1)])
