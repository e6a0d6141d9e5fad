"""Data-quality dimensions, issues and validator rules, each one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.operators import align

def completeness(df: DataFrame, required: list[str]) -> DataFrame:
    """n_cells, n_missing, score over the required columns; an empty text is missing."""
    missing = sum((F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")) for c in required[1:]), F.count_if(F.col(required[0]).isNull() | (F.col(required[0]).cast("string") == "")))
    out = df.agg((F.count(F.lit(1)) * len(required)).alias("n_cells"), missing.alias("n_missing"))
    return out.withColumn("score", 1 - F.coalesce(F.try_divide("n_missing", "n_cells"), F.lit(0.0)))


def validity(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n, n_bad: values that are there and fail a check; checks: name → condition, null where the value is."""
    rows = df.agg(*[F.struct(F.lit(k).alias("check"), F.count(c).alias("n"), F.count_if(~c).alias("n_bad")).alias(f"c{i}") for i, (k, c) in enumerate(checks.items())])
    return rows.select(F.explode(F.array(*rows.columns)).alias("r")).select("r.*")


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, n_repeated (second and later rows of a key), score."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("n_repeated"))
    return out.withColumn("score", 1 - F.col("n_repeated") / F.col("n"))


def referential(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """n, n_found, score of a foreign key; a list-valued key counts each entry."""
    refs = df.select(F.explode(key).alias("k")) if dict(df.dtypes)[key].startswith("array") else df.select(F.col(key).alias("k"))
    refs = refs.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    known = parent.select(F.col(parent_key).alias("k")).distinct().withColumn("here", F.lit(True))
    out = refs.join(known, "k", "left").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("here"), F.col("c"))), F.lit(0)).alias("n_found"))
    return out.withColumn("score", F.coalesce(F.try_divide("n_found", "n"), F.lit(1.0)))


def timeliness(df: DataFrame, ts: str, now: str) -> DataFrame:
    """latest, age_days against a stated time."""
    at = F.lit(now).cast("timestamp_ntz")
    return df.agg(F.max(ts).alias("latest")).withColumn("age_days", F.timestamp_diff("SECOND", F.col("latest"), at) / 86400)


def weighted_score(dims: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score: the weighted mean of the dimensions that are not null."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    low = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return dims.withColumn("score", F.try_divide(top, low))


def issues(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """key, column, rule: a row per violated rule; rules: name → (column, condition of a good row)."""
    bad = F.array_compact(F.array(*[F.when(~good, F.struct(F.lit(c).alias("column"), F.lit(name).alias("rule"))) for name, (c, good) in rules.items()]))
    return df.select(F.col(key), F.explode(bad).alias("i")).select(key, "i.*")


def duplicates(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows that share their keys with a different row."""
    w = Window.partitionBy(*keys)
    return df.withColumn("n_same", F.count(F.lit(1)).over(w)).where("n_same > 1").select(*keys, row_id, "n_same")


def validator(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, n_bad, passed from violation frames."""
    out = None
    for name, df in checks.items():
        row = df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n_bad")).withColumn("passed", F.col("n_bad") == 0)
        out = row if out is None else out.unionByName(row)
    return out


def missing_columns(spark, frames: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """table, missing: a row per wanted column that a table lacks, and one with null for a table that is not there."""
    rows = []
    for name, columns in wanted.items():
        rows += [(name, None)] if name not in frames else [(name, c) for c in columns if c not in frames[name].columns]
    return spark.createDataFrame(rows, "table string, missing string")


def volume(frames: dict[str, DataFrame], targets: dict[str, int], share: float = 0.1) -> DataFrame:
    """table, n, passed: row counts within a share of their targets."""
    out = None
    for name, target in targets.items():
        row = frames[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")).withColumn("passed", F.abs(F.col("n") - target) / target <= share)
        out = row if out is None else out.unionByName(row)
    return out


def rules(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Violations of the validator's rules by name, from the canonical tables.

    t: lot (lot_id, product_id), production (lot_id, station_id, qty_in, qty_out, qty_ng, start_time, end_time), genealogy
    (parent_lot_id, child_lot_id), consumption (lot_id, consumption_time), qc (lot_id, measured_time), station
    (station_id), jt (jt_id, product_id, qty), allocation (jt_id, lot_id), shipment (jt_id, qty_planned).
    """
    lot, jt, made = t["lot"], t["jt"], t["production"]
    unknown = lambda df, column, parent, key: df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    spans = made.groupBy("lot_id").agg(F.min("start_time").alias("first"), F.max("end_time").alias("last"))
    repeated = jt.groupBy("jt_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("jt_id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("k"))).alias("copy"))
    pairs = t["allocation"].join(lot.select("lot_id", F.col("product_id").alias("made")), "lot_id", "left").join(jt.select("jt_id", F.col("product_id").alias("asked")), "jt_id", "left")
    return {
        "quantity_balance": made.where("qty_in != qty_out + qty_ng"),
        "genealogy_parent": unknown(t["genealogy"], "parent_lot_id", lot, "lot_id").where(~F.col("parent_lot_id").startswith("BATCH-")),
        "genealogy_child": unknown(t["genealogy"], "child_lot_id", lot, "lot_id"),
        "consumed_after_start": t["consumption"].join(spans, "lot_id").where("consumption_time > first"),
        "checked_before_end": t["qc"].join(spans, "lot_id").where("measured_time < last"),
        "production_lot": unknown(made, "lot_id", lot, "lot_id"),
        "production_station": unknown(made, "station_id", t["station"], "station_id"),
        "lot_id_form": lot.where(F.col("lot_id").contains("_")),
        "jt_unique": repeated,
        "allocation_jt": unknown(t["allocation"], "jt_id", jt, "jt_id"),
        "allocation_lot": unknown(t["allocation"], "lot_id", lot, "lot_id"),
        "allocation_product": pairs.where(~F.col("made").eqNullSafe(F.col("asked"))),
        "shipment_jt": unknown(t["shipment"], "jt_id", jt, "jt_id"),
        "shipment_qty": t["shipment"].join(jt.select("jt_id", "qty"), "jt_id", "left").where(~F.col("qty_planned").eqNullSafe(F.col("qty"))),
    }


def error_signs(scans: DataFrame, events: DataFrame, labels: DataFrame, values: DataFrame, stock: DataFrame, most_labels: int = 1, missing: float = 0.015) -> DataFrame:
    """code, found, n: signs of missing scans (D02), labels of several lots (D03), decimal commas (D05) and rounded stock
    (D06).  labels: key, label and any column that makes a key unique; values: value; stock: qty."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    lost = n(scans, "k").crossJoin(n(events, "m")).select(F.lit("D02").alias("code"), (1 - F.col("k") / F.col("m") >= missing).alias("found"), (F.col("m") - F.col("k")).alias("n"))  # one row each
    keys = [c for c in labels.columns if c != "label"]
    shared = n(labels.groupBy(*keys).agg(F.count_distinct("label").alias("k")).where(F.col("k") > most_labels), "n").select(F.lit("D03").alias("code"), (F.col("n") > 0).alias("found"), "n")
    comma = n(values.where(F.col("value").contains(",")), "n").select(F.lit("D05").alias("code"), (F.col("n") > 0).alias("found"), "n")
    tens = stock.agg(F.count_if(F.col("qty") % 10 == 0).alias("n"), F.count("qty").alias("m")).select(F.lit("D06").alias("code"), ((F.col("n") > 0) & (F.col("n") == F.col("m"))).alias("found"), "n")
    return lost.unionByName(shared).unionByName(comma).unionByName(tens)


def header_drift(rows: DataFrame, aliases: dict[str, tuple[str, ...]], sheet: str = "_source_sheet") -> DataFrame:
    """sheet, target, column, n, state: under which names the sheets of a source hold their values.

    known is a target's first name, drifted a later one, missing a target without any value in the sheet, unknown a column
    with values that is no target's.  rows: the sheets one under the other by column name.
    """
    columns = [c for c in rows.columns if c != sheet and not c.startswith("_")]
    counts = rows.groupBy(sheet).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot([sheet], [F.col(f"`{c}`") for c in columns], "column", "n").where("n > 0")
    names = rows.sparkSession.createDataFrame([(t, c, k) for t, known in aliases.items() for k, c in enumerate(known)], "target string, column string, place int")  # the registry
    held = counts.join(F.broadcast(names), "column", "left")
    state = F.when(F.col("target").isNull(), "unknown").when(F.col("place") == 0, "known").otherwise("drifted")
    here = held.select(F.col(sheet).alias("sheet"), "target", "column", "n", state.alias("state"))
    every = rows.select(F.col(sheet).alias("sheet")).distinct().join(F.broadcast(names.select("target").distinct()), F.lit(True))
    gone = every.join(here.where("target is not null").select("sheet", "target").distinct(), ["sheet", "target"], "left_anti")
    return here.unionByName(gone.select("sheet", "target", F.lit(None).cast("string").alias("column"), F.lit(0).cast("long").alias("n"), F.lit("missing").alias("state")))


def clock_residuals(pairs: DataFrame, key: str, day: str, tolerance: float = 60.0) -> DataFrame:
    """key, offset, slope, found: how far a source's clock is off, and whether that is more than the tolerance or drifts.

    pairs: key, day (a number), diff (seconds) of anchors.
    """
    line = align.drift(pairs, key, day).select(key, "slope", "significant")
    out = align.robust_offset(pairs, key).select(key, "offset").join(line, key, "left")
    return out.select(key, "offset", "slope", ((F.abs("offset") > tolerance) | F.coalesce("significant", F.lit(False))).alias("found"))


def drift_signs(residuals: DataFrame, headers: DataFrame) -> DataFrame:
    """code, found, n: clocks that are off (D01) and columns under a drifted name or missing (D04)."""
    sign = lambda df, code: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), (F.col("n") > 0).alias("found"), "n")
    return sign(residuals.where("found"), "D01").unionByName(sign(headers.where("state in ('drifted', 'missing')"), "D04"))


def split_counts(edges: DataFrame, stated: DataFrame) -> DataFrame:
    """parent, n_children, stated: splits whose number of children is not the stated one; edges: parent, child, edge_type."""
    made = edges.where("edge_type = 'SPLIT'").groupBy("parent").agg(F.count_distinct("child").alias("n_children"))
    return stated.join(made, "parent", "left").select("parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), "stated").where("n_children != stated")


def stock_differs(snapshots: DataFrame, stated: DataFrame, at: Column) -> DataFrame:
    """item, qty, stated: the items whose stock in the snapshots of a moment is not the stated one, or is not there."""
    seen = snapshots.where(at).select("item", "qty").distinct()
    return stated.join(seen, "item", "left").where(~F.col("qty").eqNullSafe(F.col("stated"))).select("item", "qty", "stated")


def ingest_summary(sources: dict[str, DataFrame]) -> DataFrame:
    """source, n_rows, n_columns, n_files of every raw source."""
    out = None
    for name, df in sources.items():
        row = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_rows"), F.lit(len([c for c in df.columns if not c.startswith("_")])).cast("long").alias("n_columns"), F.count_distinct("_source_file").alias("n_files"))
        out = row if out is None else out.unionByName(row)
    return out
