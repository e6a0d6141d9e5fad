"""Entity resolution in tiers: exact, suffix, temporal, none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgraph.functions.ids import digits_key
from lotgraph.functions.values import seconds
from lotgraph.operators.running import running


def canonical_pool(spark, lots: int = 410, special: tuple[str, ...] = ()) -> DataFrame:
    """canonical: LOT-0001 … and special ids."""
    pool = spark.range(1, lots + 1).select(F.format_string("LOT-%04d", "id").alias("canonical"))
    return pool.unionByName(spark.createDataFrame([(x,) for x in special], "canonical string")).distinct() if special else pool


def alias_sample(rows: DataFrame) -> DataFrame:
    """source, alias, ts, n_records: the first record's time per alias; rows: source, alias, ts, row_id."""
    return rows.groupBy("source", "alias").agg(F.min_by("ts", "row_id").alias("ts"), F.count(F.lit(1)).alias("n_records"))


def nearest(probes: DataFrame, sightings: DataFrame, most: int, span: int = 3600) -> DataFrame:
    """source, alias, canonical, gap: the nearest sighting of another source within most seconds, the least id on ties.

    Probes and sightings are sorted together by time and swept once forwards and once backwards.  What a sweep carries on
    is the last sighting, and the last one of a source other than its source: that is the sighting before the present
    stretch of one source.  Ranges of span seconds are swept by themselves, so no rows meet by time alone.

    probes: source, alias, ts; sightings: source, canonical, ts.
    """
    seen = sightings.where("ts is not null").groupBy("source", seconds(F.col("ts")).alias("at")).agg(F.min("canonical").alias("canonical"))
    asked = probes.where("ts is not null").select("source", "alias", seconds(F.col("ts")).alias("at"), F.lit(1).alias("kind"))
    rows = seen.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    mark = F.when(F.col("kind") == 0, F.struct("source", "canonical", "at"))

    def one_way(sign: int) -> DataFrame:
        # sightings come before probes of their time, and of one time the least id comes last
        order = [sign * F.col("at"), F.col("kind"), F.desc("canonical"), F.desc("source")]
        ranges = sign * F.floor(F.col("at") / span)
        before = running(rows, [], ranges, order, {"before": ("last", mark)}, exclusive=True)
        begins = F.when((F.col("kind") == 0) & (F.col("before.source") != F.col("source")), F.col("before"))
        swept = running(before, [], ranges, order, {"last": ("last", mark), "other": ("last", begins)}).where("kind = 1")
        found = F.when(F.col("last.source") != F.col("source"), F.col("last")).otherwise(F.col("other"))
        return swept.select("source", "alias", F.abs(found["at"] - F.col("at")).alias("gap"), found["canonical"].alias("canonical")).where(F.col("gap") <= most)

    return one_way(1).unionByName(one_way(-1)).groupBy("source", "alias").agg(F.min(F.struct("gap", "canonical")).alias("m")).select("source", "alias", "m.canonical", "m.gap")


def resolve(aliases: DataFrame, pool: DataFrame, sightings: DataFrame | None = None, window_seconds: int = 300, review: float = 0.75) -> DataFrame:
    """source, alias, canonical, confidence, method, needs_review.

    aliases: source, alias, ts; pool: canonical; sightings: source, canonical, ts of lots already known, for the
    temporal tier, which takes the nearest sighting of another source within the window (nearest()).
    """
    exact = pool.select(F.col("canonical").alias("alias"), F.col("canonical").alias("c1"))
    suffixes = pool.where(F.col("canonical").rlike(r"\d{3,4}")).groupBy(digits_key(F.col("canonical")).alias("suffix")).agg(F.first("canonical").alias("c2"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    out = aliases.withColumn("suffix", F.when(F.col("alias").rlike(r"\d{3,4}"), digits_key(F.col("alias")))).join(exact, "alias", "left").join(suffixes, "suffix", "left")
    c3, near = F.lit(None).cast("string"), F.lit(None).cast("double")
    if sightings is not None:
        best = nearest(aliases, sightings, window_seconds).select("source", "alias", F.struct("gap", F.col("canonical").alias("c3")).alias("m"))
        out = out.join(best, ["source", "alias"], "left")
        c3, near = F.col("m.c3"), F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.85 * (1 - F.col("m.gap") / window_seconds)))
    method = F.when(F.col("c1").isNotNull(), "exact").when(F.col("c2").isNotNull(), "suffix").when(c3.isNotNull(), "temporal").otherwise("no_match")
    conf = F.when(F.col("c1").isNotNull(), 1.0).when(F.col("c2").isNotNull(), 0.95).when(c3.isNotNull(), near).otherwise(0.0)
    out = out.select("source", "alias", F.coalesce("c1", "c2", c3).alias("canonical"), conf.alias("confidence"), method.alias("method"))
    return out.withColumn("needs_review", F.col("confidence") < review)


def resolution_audit(resolved: DataFrame) -> DataFrame:
    """method, n, n_review and counts in four confidence buckets."""
    c = F.col("confidence")
    buckets = {"c_high": c >= 0.95, "c_good": (c >= 0.75) & (c < 0.95), "c_low": (c >= 0.5) & (c < 0.75), "c_none": c < 0.5}
    return resolved.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_review").alias("n_review"), *[F.count_if(x).alias(k) for k, x in buckets.items()])


def apply_mapping(rows: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(mapping.select(*keys, F.col("canonical").alias("canonical_id"), F.col("confidence").alias("match_confidence")), keys, "left")
