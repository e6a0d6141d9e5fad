import math

from pyspark.sql import functions as F
from pytest import approx

from lotgraph.functions import ids, stats, values
from lotgraph.operators import mapping


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_lot_labels(spark):
    raw = ["L-A-0147", "QR260929A147", "A147", "LOT-0147-A", "LOT-0147", "", None, "odd", "QR-x0147y"]
    got = one(spark, ids.lot_id(F.col("r")), [(x,) for x in raw], "r string")
    assert got == ["LOT-0147"] * 5 + [None, None, "odd", "LOT-0147"]


def test_other_ids(spark):
    row = spark.range(1).select(ids.order_id(F.lit("JT_7")).alias("a"), ids.station_id(F.lit("M1")).alias("b"), ids.product_id(F.lit("P03")).alias("c"), ids.component_id(F.lit("C4")).alias("d"), ids.batch_id(F.lit("B07")).alias("e"), ids.digits_key(F.lit("A147")).alias("f"), ids.order_id(F.lit("JT-12345")).alias("g")).first()
    assert tuple(row) == ("JT-0007", "STN-M1", "PROD-P3", "COMP-C4", "BATCH-HT-B07", "0147", "JT-12345")


def test_decimals_in_both_modes(spark):
    raw = [("12,5",), ("1.234,5",), ("1,234.5",), ("12,61",), ("1,234",), ("abc",), (None,)]
    assert one(spark, values.decimal(F.col("r")), raw, "r string") == [12.5, 1234.5, 1234.5, 12.61, 1234.0, None, None]
    assert one(spark, values.decimal(F.col("r"), faithful=True), raw[:5], "r string") == [12.5, 1234.5, 1234.5, 1261.0, 1.234]


def test_results_times_and_lists(spark):
    words = [(x,) for x in ("OK", "pass ", "ĐẠT", "1", "NG", "fail", "0", "other")]
    assert one(spark, values.result(F.col("r")), words, "r string") == ["OK"] * 4 + ["NG"] * 3 + ["OTHER"]
    times = [("05/09/2026 07:08",), ("2026-09-05 07:08:09",), ("05/09/2026",), ("x",)]
    assert [str(x) for x in one(spark, values.timestamp(F.col("r")), times, "r string")] == ["2026-09-05 07:08:00", "2026-09-05 07:08:09", "2026-09-05 00:00:00", "None"]
    assert one(spark, values.listed(F.col("r")), [("LOT-1, LOT-2,,",)], "r string") == [["LOT-1", "LOT-2"]]
    assert values.header("Mã lô!") == "malo"


def test_fisher_matches_saved_values(spark):
    rows = [(1, 0, 1, 409), (2, 3, 0, 406), (0, 0, 3, 4)]
    cells = [F.col(c) for c in "abcd"]
    got = one(spark, stats.fisher_exact(*cells), rows, "a long, b long, c long, d long")
    assert got == [approx(0.0048661800486618, rel=1e-9), approx(0.0001186873182600439, rel=1e-7), 1.0]
    assert one(spark, stats.lift(*cells), rows, "a long, b long, c long, d long")[1] == approx(82.2)


def brute_fisher(a, b, c, d):
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    if 0 in (r1, r2, c1, n - c1):
        return 1.0
    lf = lambda x: math.lgamma(x + 1)
    logs = {k: lf(r1) + lf(r2) + lf(c1) + lf(n - c1) - lf(n) - lf(k) - lf(r1 - k) - lf(c1 - k) - lf(r2 - c1 + k) for k in range(max(0, c1 - r2), min(r1, c1) + 1)}
    return min(1.0, sum(math.exp(x) for x in logs.values() if x <= logs[a] + 1e-7))


def test_fisher_of_large_tables(spark):
    rows = [(1250, 3750, 123750, 371250), (1300, 3700, 123700, 371300), (3750, 1250, 371250, 123750), (100, 900, 90_000, 910_000), (0, 1000, 500_000, 400_000), (900, 100, 20_000, 980_000)]
    rows += [(3, 3, 3, 3), (5, 0, 0, 5), (0, 5, 5, 0), (40, 2, 1, 0), (0, 0, 0, 0), (1, 1, 1, 1), (20, 21, 21, 20), (123_456, 654_321, 234_567, 987_654)]
    got = one(spark, stats.fisher_exact(*[F.col(c) for c in "abcd"]), rows, "a long, b long, c long, d long")
    assert got[0] == approx(1.0)
    assert got == [approx(brute_fisher(*r), rel=1e-5, abs=1e-300) for r in rows]


def test_mapping_takes_each_rows_first_value(spark):
    df = spark.createDataFrame([("a", None, "k"), (None, "b", "k")], "x string, y string, other string")
    names = {"t": ("x", "y"), "missing": ("z",)}
    assert [tuple(r) for r in mapping.map_columns(df, names).collect()] == [("a", None, "k"), ("b", None, "k")]
    assert [r.t for r in mapping.map_columns(df, names, faithful=True).collect()] == ["a", None]
    assert mapping.mapping_audit(df.columns, names) == {"renamed": ["t"], "missing": ["missing"], "unmapped": ["other"]}
    assert mapping.auto_map(["MÃ LÔ", "q"], {"lot": ("Mã lô",)}) == {"MÃ LÔ": "lot"}
    assert mapping.detect_group(["a", "b"], {"g": ({"a": (), "b": ()}, 1), "h": ({"z": ()}, 0)}) == "g"


def test_rounds_as_the_sql_does(spark):
    values = [0.72625, 0.66075, 0.73235, 0.5, 0.00005, -0.72625, -2.5, 1e300, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(stats.rounded("x", 4)).collect()] == [0.7262, 0.6607, 0.7323, 0.5, 0.0001, -0.7262, -2.5, 1e300, None]
