"""Schema mapping, id and value rules, contracts, import helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgraph.functions import ids, values


def map_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]], faithful: bool = False) -> DataFrame:
    """Target columns from their known names; unmatched targets are null, unmapped columns stay.

    Each row takes its first name that has a value; faithful: the first name that exists, for all rows.
    """
    used = {c for names in aliases.values() for c in names if c in df.columns}
    out = []
    for target, names in aliases.items():
        found = [F.col(f"`{c}`") for c in names if c in df.columns]
        out.append((F.coalesce(*(found[:1] if faithful else found)) if found else F.lit(None).cast("string")).alias(target))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in used and c not in aliases])


def mapping_audit(columns: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    used = {t: next((c for c in names if c in columns), None) for t, names in aliases.items()}
    known = {c for names in aliases.values() for c in names}
    return {"renamed": sorted(t for t, c in used.items() if c), "missing": sorted(t for t, c in used.items() if not c), "unmapped": sorted(set(columns) - known)}


def contract(df: DataFrame, required: list[str]) -> DataFrame:
    """column, n_null: violations of a contract's required columns; a column that is absent violates it in every row."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) if c in df.columns else F.count(F.lit(1)).alias(c) for c in required]
    return df.agg(*counts).unpivot([], required, "column", "n_null").where("n_null > 0")


#: Raw column → (normalised column, rule).
RULES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "lot_ref_raw": ("lot_ref_norm", ids.lot_id),
    "parent_ref_raw": ("parent_ref_norm", ids.lot_id),
    "order_ref_raw": ("order_norm", ids.order_id),
    "station_raw": ("station_norm", ids.station_id),
    "product_raw": ("product_norm", ids.product_id),
    "item_raw": ("item_norm", ids.component_id),
    "qty_raw": ("qty_norm", values.whole),
    "qty_ok_raw": ("qty_ok_norm", values.whole),
    "qty_ng_raw": ("qty_ng_norm", values.whole),
    "value_raw": ("value_norm", values.decimal),
    "lsl_raw": ("lsl_norm", values.decimal),
    "usl_raw": ("usl_norm", values.decimal),
    "result_raw": ("result_norm", values.result),
    "ts_raw": ("ts_norm", values.timestamp),
    "due_raw": ("due_norm", values.timestamp),
    "start_raw": ("start_norm", values.timestamp),
    "end_raw": ("end_norm", values.timestamp),
    "truck_raw": ("truck_norm", values.timestamp),
    "cutoff_raw": ("cutoff_norm", values.timestamp),
}


def normalise(df: DataFrame, rules=RULES) -> DataFrame:
    return df.withColumns({to: rule(F.col(c)) for c, (to, rule) in rules.items() if c in df.columns})


def normalise_audit(df: DataFrame, rules=RULES) -> DataFrame:
    """column, n_input, n_output, n_failed of a normalised frame, in one pass."""
    pairs = [(c, to) for c, (to, _) in rules.items() if c in df.columns and to in df.columns]
    rows = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n_input"), F.count(to).alias("n_output"), F.count_if(F.col(c).isNotNull() & F.col(to).isNull()).alias("n_failed")).alias(f"s{k}") for k, (c, to) in enumerate(pairs)])
    return rows.select(F.explode(F.array(*rows.columns)).alias("r")).select("r.*")


def auto_map(headers: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Header → target by names without accents and case."""
    known = {values.header(n): t for t, names in aliases.items() for n in (t, *names)}
    return {h: known[values.header(h)] for h in headers if values.header(h) in known}


def detect_group(headers: list[str], groups: dict[str, tuple[dict[str, tuple[str, ...]], int]]) -> str | None:
    """The table whose share of mapped headers is largest, if over one half; groups: (aliases, required count)."""
    score = {g: len(set(auto_map(headers, a).values())) / (need + 2) for g, (a, need) in groups.items()}
    best = max(score, key=lambda g: score[g], default=None)
    return best if best and score[best] > 0.5 else None


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, the new value wins field by field where it has one."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c).alias(c) for c in old.columns])
