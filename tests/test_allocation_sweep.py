"""First in, first out allocation: lots are made once, and stretches of any length meet."""

from lotgraph.operators import reconstruct
from lotgraph.plans import signals


def test_lots_are_made_once(spark):
    for name in ("fifo_alloc", "alloc_check", "alloc_overlay"):
        plan = signals.Q[name](spark, "/root/testdata/sf0.001")
        assert not any("lineitem" in f for f in plan.inputFiles())


def test_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(reconstruct, "STRETCH", 3)
    orders = [("p", k, q, k) for k, q in enumerate([5, 1, 9, 2, 0, 30, 4])] + [("q", 9, 2, 1)]
    lots = [("p", f"l{k}", q, k) for k, q in enumerate([2, 2, 11, 7, 0, 40])] + [("r", "x", 5, 1)]
    got = reconstruct.fifo(spark.createDataFrame(orders, "product string, jt_id long, qty long, due long"), spark.createDataFrame(lots, "product string, lot_id string, qty long, created long"))
    units = lambda rows: [r[1] for r in rows if r[0] == "p" for _ in range(r[2])]
    want: dict = {}
    for pair in zip(units(orders), units(lots), strict=False):
        want[pair] = want.get(pair, 0) + 1
    assert {(r.jt_id, r.lot_id): r["take"] for r in got.collect()} == want
