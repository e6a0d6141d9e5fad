"""Builders of the canonical tables from normalised and resolved source frames.

Frames carry the columns of ``mapping.map_columns`` and ``mapping.normalise``, and ``canonical_id`` and
``match_confidence`` of ``resolve.apply_mapping``.  Row ids come from natural keys, so they need no global count and are
the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgraph.operators import reconstruct
from lotgraph.schemas import CANONICAL


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, null where a source lacks it."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def _first(df: DataFrame, *names: str, kind: str = "string") -> Column:
    return F.coalesce(*[_has(df, n, kind) for n in names])


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; what is missing is null."""
    return df.select(*[_has(df, f.name, f.dataType.simpleString()).alias(f.name) for f in CANONICAL[table]])


def lots(output: DataFrame) -> DataFrame:
    """One row per lot, its first report: quantity is good plus bad pieces, a number that is none counts as 0."""
    ok, ng = (F.coalesce(_has(output, c, "long"), F.lit(0)) for c in ("qty_ok_norm", "qty_ng_norm"))
    rows = output.select(_has(output, "canonical_id").alias("lot_id"), _has(output, "product_norm").alias("product_id"), _has(output, "line_raw").alias("line_id"), (ok + ng).alias("qty"), ok.alias("qty_ok"), ng.alias("qty_ng"), _has(output, "ts_norm", "timestamp_ntz").alias("created_ts"), _has(output, "shift_raw").alias("shift"), F.coalesce(_has(output, "match_confidence", "double"), F.lit(1.0)).alias("confidence"), _has(output, "_raw_row_id").alias("_row"))
    return _shaped(reconstruct.first_per_key(rows.where("lot_id is not null"), ["lot_id"], [F.asc_nulls_last("_row"), F.asc_nulls_last("created_ts"), F.asc("qty")]), "lot")


def events(machine: DataFrame) -> DataFrame:
    """Machine events of resolved lots; the aligned time falls back to the raw one."""
    rows = machine.select(_first(machine, "ipc_event_id", "_raw_row_id").alias("event_id"), _has(machine, "canonical_id").alias("lot_id"), _has(machine, "station_norm").alias("station_id"), _has(machine, "event_type_raw").alias("event_type"), _has(machine, "event_code_raw").alias("event_code"), _has(machine, "ts_norm", "timestamp_ntz").alias("ts_raw"), _first(machine, "ts_aligned", "ts_norm", kind="timestamp_ntz").alias("ts_aligned"), F.lit("SRC-02").alias("source"), F.lit(1.0).alias("confidence"))
    return _shaped(rows.where("lot_id is not null"), "lot_event")


def shipments(plan: DataFrame) -> DataFrame:
    rows = plan.select(_has(plan, "shipment_raw").alias("shipment_id"), _has(plan, "order_norm").alias("jt_id"), _has(plan, "truck_norm", "timestamp_ntz").alias("truck_time"), _has(plan, "cutoff_norm", "timestamp_ntz").alias("cutoff_time"), F.coalesce(_has(plan, "qty_norm", "long"), F.lit(0)).alias("qty_planned"), _has(plan, "status_raw").alias("status"), F.lit(0.95).alias("confidence"), F.lit("direct_shipping_plan").alias("evidence"))
    return _shaped(rows.where("shipment_id is not null and jt_id is not null"), "shipment")


def qc_results(auto: DataFrame | None, sampling: DataFrame | None) -> DataFrame:
    """Automatic checks and samples one under the other; samples have no limits and no verdict."""
    parts = []
    for df, kind, source in ((auto, "AUTO", "SRC-04"), (sampling, "SAMPLE", "SRC-05")):
        if df is None:
            continue
        own = F.col("qc_record_id").cast("string") if "qc_record_id" in df.columns else F.concat(F.lit("QC-S-"), _has(df, "_raw_row_id"))
        limits = [_has(df, f"{c}_norm", "double").alias(c) if kind == "AUTO" else F.lit(None).cast("double").alias(c) for c in ("lsl", "usl")]
        verdict = [(_has(df, c) if kind == "AUTO" else F.lit(None).cast("string")).alias(n) for c, n in (("result_norm", "result"), ("ng_code", "ng_code"))]
        rows = df.select(own.alias("qc_id"), _has(df, "canonical_id").alias("lot_id"), _first(df, "station_norm", "station_raw").alias("station_id"), F.lit(kind).alias("test_type"), _has(df, "characteristic_raw").alias("characteristic"), _has(df, "value_norm", "double").alias("value"), *limits, *verdict, _first(df, "ts_aligned", "ts_norm", kind="timestamp_ntz").alias("measured_ts"), F.lit(source).alias("source"))
        parts.append(_shaped(rows.where("lot_id is not null"), "qc_result"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orders(tickets: DataFrame) -> DataFrame:
    """One row per order, its first ticket."""
    rows = tickets.select(_has(tickets, "order_norm").alias("jt_id"), _has(tickets, "product_norm").alias("product_id"), _has(tickets, "line_raw").alias("line_id"), F.coalesce(_has(tickets, "qty_norm", "long"), F.lit(0)).alias("qty"), _has(tickets, "due_norm", "timestamp_ntz").alias("due_ts"), _has(tickets, "priority_raw").alias("priority"), _has(tickets, "customer_raw").alias("customer"), _has(tickets, "status_raw").alias("status"), _has(tickets, "_raw_row_id").alias("_row"))
    return _shaped(reconstruct.first_per_key(rows.where("jt_id is not null"), ["jt_id"], [F.asc_nulls_last("_row"), F.asc_nulls_last("due_ts"), F.asc("qty")]), "jt_order")


def allocation(jt_order: DataFrame, lot: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """First in, first out by product; confirmed rows (jt_id, lot_id, qty_allocated, allocation_time) win by lot."""
    took = reconstruct.fifo(jt_order.select(F.col("product_id").alias("product"), "jt_id", "qty", F.col("due_ts").alias("due")), lot.select(F.col("product_id").alias("product"), "lot_id", "qty", F.col("created_ts").alias("created")))
    rows = took.join(jt_order.select("jt_id", F.col("due_ts").alias("allocation_time")), "jt_id").select("jt_id", "lot_id", F.col("take").alias("qty_allocated"), "allocation_time")
    if confirmed is not None:
        sure = confirmed.where("jt_id is not null and lot_id is not null")
        sure = reconstruct.first_per_key(sure, ["lot_id"], [F.asc("jt_id"), F.asc("allocation_time")])
        rows = reconstruct.overlay(rows, sure.select("jt_id", "lot_id", F.coalesce("qty_allocated", F.lit(0)).cast("long").alias("qty_allocated"), F.col("allocation_time").cast("timestamp_ntz").alias("allocation_time")))
    known = F.col("origin") == "confirmed" if "origin" in rows.columns else F.lit(False)
    rows = rows.withColumns({"confidence": F.when(known, 1.0).otherwise(0.85), "evidence": F.when(known, "confirmed").otherwise("fifo_based"), "allocation_id": F.concat_ws("-", F.lit("ALLOC"), "jt_id", "lot_id")})
    return _shaped(rows, "jt_allocation")


def consumption(lot: DataFrame, bom: DataFrame, material: DataFrame) -> DataFrame:
    """What each lot took of each component, from its oldest material lot, by the bill of materials, in whole units.

    bom: product, component, per_unit; material: component, mat_lot, received.
    """
    used = reconstruct.bom_explode(lot.select("lot_id", F.col("product_id").alias("product"), "qty"), bom.select("product", "component", "per_unit", F.lit(1.0).alias("scrap")), material)
    rows = used.join(lot.select("lot_id", F.col("created_ts").alias("consumption_time")), "lot_id")
    rows = rows.select(F.concat_ws("-", F.lit("CONS"), "lot_id", "component").alias("consumption_id"), "lot_id", F.col("mat_lot").alias("mat_lot_id"), F.col("component").alias("component_id"), F.bround("qty").alias("qty_consumed"), "consumption_time", F.lit(0.9).alias("confidence"), F.lit("fifo_bom_based").alias("evidence"))
    return _shaped(rows, "material_consumption")


def edges(scans: DataFrame, lot: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Splits and merges that scans state; a lot's batch (lot_id, batch), if known, is its inferred parent."""
    stated = scans.select(_has(scans, "event_type_raw").alias("edge_type"), _first(scans, "parent_canonical_id", "parent_ref_norm").alias("parent_lot_id"), _has(scans, "canonical_id").alias("child_lot_id"), _first(scans, "ts_aligned", "ts_norm", kind="timestamp_ntz").alias("edge_time"), _has(scans, "_source_file").alias("source_file"), _has(scans, "_raw_row_id").alias("_row"))
    stated = stated.where("edge_type in ('SPLIT', 'MERGE') and parent_lot_id is not null and child_lot_id is not null")
    out = reconstruct.first_per_key(stated, ["parent_lot_id", "child_lot_id"], [F.asc_nulls_last("_row"), F.asc_nulls_last("edge_time")]).drop("_row")
    out = out.withColumns({"qty": F.lit(None).cast("long"), "confidence": F.lit(1.0), "evidence": F.lit("direct_scan")})
    if batches is not None:
        guess = batches.where("batch is not null").select(F.col("batch").alias("parent_lot_id"), F.col("lot_id").alias("child_lot_id")).distinct()
        guess = guess.join(out.select("parent_lot_id", "child_lot_id"), ["parent_lot_id", "child_lot_id"], "left_anti")
        guess = guess.join(lot.select(F.col("lot_id").alias("child_lot_id"), "qty", F.col("created_ts").alias("edge_time")), "child_lot_id")
        out = out.unionByName(guess.withColumns({"edge_type": F.lit("SPLIT"), "source_file": F.lit("lot"), "confidence": F.lit(0.75), "evidence": F.lit("inferred_from_batch_id")}))
    return _shaped(out.withColumn("edge_id", F.concat_ws("-", F.lit("EDGE"), "parent_lot_id", "child_lot_id")), "lot_edge")


def with_named_lots(lot: DataFrame, lot_edge: DataFrame) -> DataFrame:
    """lot and, with null fields and low confidence, the lots (not batches) that only the genealogy names."""
    own = lambda c: F.when(F.col(c).startswith("LOT-"), F.col(c))
    return _shaped(reconstruct.fill_missing_lots(lot, lot_edge.select(own("parent_lot_id").alias("parent"), own("child_lot_id").alias("child"))), "lot")
