"""The chain from raw files to the canonical tables: ingest, align and resolve, build; each step a layer of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgraph.operators import align, builders, mapping, resolve
from lotgraph.schemas import SOURCES, Source
from lotgraph.sources import readers, writers

MACHINE, SCANS, AUTO, SAMPLES = "SRC-02", "SRC-03", "SRC-04", "SRC-05"


def ingest(spark: SparkSession, root: str, sources: tuple[str, ...] = tuple(SOURCES), registry: dict[str, Source] = SOURCES) -> dict[str, DataFrame]:
    """Mapped and normalised frames by source; of the drifted sheets' raw columns only the mapped ones stay."""
    out = {}
    for name in sources:
        df = mapping.normalise(mapping.map_columns(readers.raw(spark, root, name, registry), registry[name].aliases))
        if name == SAMPLES:
            kept = {*registry[name].aliases, *(to for to, _ in mapping.RULES.values())}
            df = df.select(*[c for c in df.columns if c in kept or c.startswith("_")])
        out[name] = df
    return out


def offsets(staged: dict[str, DataFrame], window_seconds: int = 900) -> DataFrame:
    """station_norm, offset, drift, base: what a station's machine clock is short of the scans' clock.

    The offset is the median of the anchors; where they drift significantly, it is the line through them from the
    first day on.
    """
    pick = lambda s: staged[s].where("lot_ref_norm is not null and ts_norm is not null").select("lot_ref_norm", "station_norm", F.col("ts_norm").alias("ts"))
    pairs = align.anchors(pick(MACHINE), pick(SCANS), ["lot_ref_norm", "station_norm"], window_seconds)
    first = pairs.agg(F.min(F.to_date("ts_a")).alias("base"))  # one row
    pairs = pairs.crossJoin(F.broadcast(first)).withColumn("day", F.datediff(F.to_date("ts_a"), "base"))
    robust = align.robust_offset(pairs, "station_norm")
    line = align.drift(pairs, "station_norm", "day").where("significant").select("station_norm", "slope", "intercept")
    out = robust.join(line, "station_norm", "left").crossJoin(F.broadcast(first))
    return out.select("station_norm", F.coalesce("intercept", "offset").alias("offset"), F.coalesce("slope", F.lit(0.0)).alias("drift"), "base", "confidence")


def aligned(staged: dict[str, DataFrame], found: DataFrame) -> dict[str, DataFrame]:
    """Machine and check sources with ts_aligned; scans keep their time, they are the clock."""
    out = {}
    for name, df in staged.items():
        if name in (MACHINE, AUTO) and {"station_norm", "ts_norm"} <= set(df.columns):
            out[name] = align.apply_offset(df.withColumn("ts", F.col("ts_norm")), found, "station_norm").drop("ts", "offset", "drift", "base")
        elif "ts_norm" in df.columns:
            out[name] = df.withColumn("ts_aligned", F.col("ts_norm"))
        else:
            out[name] = df
    return out


def resolved(frames: dict[str, DataFrame], pool: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Frames with canonical_id and match_confidence, and the mapping: source, alias, canonical, confidence, method."""
    rows = None
    for name, df in frames.items():
        for column in ("lot_ref_norm", "parent_ref_norm"):
            if column in df.columns:
                part = df.where(F.col(column).isNotNull()).select(F.lit(name).alias("source"), F.col(column).alias("alias"), F.col("ts_aligned").alias("ts"), F.col("_raw_row_id").alias("row_id"))
                rows = part if rows is None else rows.unionByName(part)
    found = resolve.resolve(resolve.alias_sample(rows), pool)
    out = {}
    for name, df in frames.items():
        if "lot_ref_norm" in df.columns:
            own = found.where(F.col("source") == name)
            df = resolve.apply_mapping(df, own.withColumnRenamed("alias", "lot_ref_norm"), ["lot_ref_norm"])
            if "parent_ref_norm" in df.columns:
                parents = own.select(F.col("alias").alias("parent_ref_norm"), F.col("canonical").alias("parent_canonical_id"))
                df = df.join(parents, "parent_ref_norm", "left")
        out[name] = df
    return out, found


def build(frames: dict[str, DataFrame], bom: DataFrame, material: DataFrame, confirmed: DataFrame | None = None, batches: DataFrame | None = None) -> dict[str, DataFrame]:
    """The eight canonical tables by name."""
    lot = builders.lots(frames["SRC-01"])
    lot_edge = builders.edges(frames[SCANS], lot, batches)
    jt_order = builders.orders(frames["SRC-06"])
    return {
        "lot": builders.with_named_lots(lot, lot_edge),
        "lot_edge": lot_edge,
        "lot_event": builders.events(frames[MACHINE]),
        "material_consumption": builders.consumption(lot, bom, material),
        "jt_order": jt_order,
        "jt_allocation": builders.allocation(jt_order, lot, confirmed),
        "shipment": builders.shipments(frames["SRC-08"]),
        "qc_result": builders.qc_results(frames.get(AUTO), frames.get(SAMPLES)),
    }


def reconstruction_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows of the canonical tables."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def run(spark: SparkSession, root: str, out: str, pool: DataFrame, bom: DataFrame, material: DataFrame, confirmed: DataFrame | None = None, batches: DataFrame | None = None) -> dict[str, DataFrame]:
    """Raw files under root to Parquet layers under out: staged, resolved, canonical, mapping and review queue."""
    staged = ingest(spark, root)
    writers.parquet_layer(staged, f"{out}/staged")
    staged = {n: spark.read.parquet(f"{out}/staged/{n}.parquet") for n in staged}
    frames, found = resolved(aligned(staged, offsets(staged)), pool)
    writers.parquet_layer({**frames, "mapping": found}, f"{out}/resolved")
    frames = {n: spark.read.parquet(f"{out}/resolved/{n}.parquet") for n in frames}
    writers.csv_report(spark.read.parquet(f"{out}/resolved/mapping.parquet").where("needs_review"), f"{out}/review_queue")
    writers.parquet_layer(build(frames, bom, material, confirmed, batches), f"{out}/canonical")
    return readers.tables(spark, f"{out}/canonical", ["lot", "lot_edge", "lot_event", "material_consumption", "jt_order", "jt_allocation", "shipment", "qc_result"])
