"""Schemas of the canonical tables and the field rules that quality checks read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

S, L, D, T = StringType(), LongType(), DoubleType(), TimestampNTZType()


def _table(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


CANONICAL: dict[str, StructType] = {
    "lot": _table(lot_id=S, product_id=S, line_id=S, qty=L, qty_ok=L, qty_ng=L, created_ts=T, shift=S, confidence=D),
    "lot_edge": _table(edge_id=S, parent_lot_id=S, child_lot_id=S, edge_type=S, qty=L, edge_time=T, confidence=D, evidence=S, source_file=S),
    "lot_event": _table(event_id=S, lot_id=S, station_id=S, event_type=S, event_code=S, ts_raw=T, ts_aligned=T, source=S, confidence=D),
    "material_consumption": _table(consumption_id=S, lot_id=S, mat_lot_id=S, component_id=S, qty_consumed=D, consumption_time=T, confidence=D, evidence=S),
    "jt_order": _table(jt_id=S, product_id=S, line_id=S, qty=L, due_ts=T, priority=S, customer=S, status=S),
    "jt_allocation": _table(allocation_id=S, jt_id=S, lot_id=S, qty_allocated=L, allocation_time=T, confidence=D, evidence=S),
    "shipment": _table(shipment_id=S, jt_id=S, truck_time=T, cutoff_time=T, qty_planned=L, status=S, confidence=D, evidence=S),
    "qc_result": _table(qc_id=S, lot_id=S, station_id=S, test_type=S, characteristic=S, value=D, lsl=D, usl=D, result=S, ng_code=S, measured_ts=T, source=S),
}


@dataclass(frozen=True)
class Source:
    """A raw source: where its files are and how they read; target column → its known names, first present wins."""

    glob: str
    sep: str
    aliases: dict[str, tuple[str, ...]]


# The raw sources and their column names, drifted headers included.
SOURCES: dict[str, Source] = {
    "SRC-01": Source("SRC-01_output/*.csv", ",", {"lot_ref_raw": ("local_lot_label", "lot_label"), "product_raw": ("model_code",), "line_raw": ("line_code",), "qty_ok_raw": ("qty_ok",), "qty_ng_raw": ("qty_ng",), "ts_raw": ("event_ts",), "shift_raw": ("shift",)}),
    "SRC-02": Source("SRC-02_ipc/*.csv", ",", {"lot_ref_raw": ("local_lot_ref",), "station_raw": ("machine_code",), "event_type_raw": ("event_type",), "event_code_raw": ("event_code",), "ts_raw": ("ts_raw",)}),
    "SRC-03": Source("SRC-03_qr/*.csv", ",", {"lot_ref_raw": ("qr_code",), "parent_ref_raw": ("parent_qr_code",), "event_type_raw": ("scan_type",), "station_raw": ("station_code",), "ts_raw": ("scan_ts_raw",)}),
    "SRC-04": Source("SRC-04_qc_auto/*.csv", ",", {"lot_ref_raw": ("local_lot_ref",), "station_raw": ("station_code",), "characteristic_raw": ("characteristic",), "value_raw": ("value_raw",), "lsl_raw": ("lsl",), "usl_raw": ("usl",), "result_raw": ("result",), "ng_code_raw": ("ng_code",), "ts_raw": ("measured_ts_raw",)}),
    "SRC-05": Source("SRC-05_qc_sampling/*.csv", ",", {"lot_ref_raw": ("local_lot_ref", "Mã lô"), "characteristic_raw": ("characteristic", "Đặc tính"), "value_raw": ("value_raw", "Giá trị"), "ts_raw": ("measured_date", "Ngày đo"), "station_raw": ("station_code", "Trạm")}),
    "SRC-06": Source("SRC-06_jt/*.csv", ";", {"order_ref_raw": ("source_order_no",), "product_raw": ("model_code",), "line_raw": ("source_line_code",), "qty_raw": ("qty",), "due_raw": ("due_date_raw",), "priority_raw": ("priority",), "customer_raw": ("customer_code",), "status_raw": ("status",)}),
    "SRC-07": Source("SRC-07_inventory/*.csv", ",", {"ts_raw": ("capture_ts_raw",), "item_raw": ("item_code",), "item_type_raw": ("item_type",), "location_raw": ("location_code",), "qty_raw": ("qty_raw",)}),
    "SRC-08": Source("SRC-08_shipping/*.csv", ",", {"shipment_raw": ("shipment_ref",), "order_ref_raw": ("order_ref",), "truck_raw": ("truck_ts_raw",), "cutoff_raw": ("cutoff_ts_raw",), "qty_raw": ("qty_planned",), "status_raw": ("status",)}),
    "SRC-09": Source("SRC-09_incident/*.csv", ",", {"incident_raw": ("incident_ref",), "station_raw": ("machine_or_station",), "start_raw": ("start_ts_raw",), "end_raw": ("end_ts_raw",), "code_raw": ("incident_code",), "note_raw": ("note",)}),
}
