"""Exact dedup by a heavy-hitter split (operator 3, DataFrame and SQL functions only).

A Misra-Gries summary of the digests (Spark's ``approx_top_k``) names at most ``heavy_k`` candidates.  One exact
pass counts them and finds the row that stays; these verified winners are broadcast, so rows of frequent texts are
settled where they are read.  All other digests, none of which has more than a ``heavy_k``-th of the rows, take the
ordinary shuffle: counts and first rows are combined before it, and so are the rows that stay (the window keeps the
first row per digest and task before it shuffles), so a group adds a row per task at most.

Defined cases: null text counts as empty; of equal texts the row with the smallest doc_id stays, a null doc_id comes
last, and of rows that repeat the same doc_id exactly one stays.  An empty table gives an empty result.  A text of any
length is hashed whole and only its digest is compared.  Extra columns play no part and come back as they were,
whatever their names: a caller's row travels in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.llm.scratch import stored

SPACE = r"[\x20\x09-\x0D]+"
HEAVY_K = 1024
TRACKED = 16384


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))


def winners(rows: DataFrame, heavy_k: int = HEAVY_K, tracked: int = TRACKED) -> DataFrame:
    """Digests that the Misra-Gries summary names, with their exact row counts (size) and first rows (first).

    rows: key (64 bits of the digest), digest, id, row.  At most heavy_k keys come back, so the result may be
    broadcast at any input size.
    """
    named = rows.select(F.expr(f"approx_top_k(key, {heavy_k}, {tracked})").alias("top"))  # one row for all rows
    named = named.where(F.col("top").isNotNull()).select(F.explode("top").alias("hit")).where("hit.count > 1").select(F.col("hit.item").alias("key"))
    found = rows.join(F.broadcast(named), "key", "left_semi").groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("size"))
    return found.where("size > 1")


def duplicates(docs: DataFrame, heavy_k: int = HEAVY_K, tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = F.sha2(normalised(F.col("text")), 256)
    rows = docs.select(F.col("doc_id").alias("id"), F.unhex(digest).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.withColumn("key", F.xxhash64("digest")), "digests")
    heavy = stored(winners(rows, heavy_k, tracked), "winners")
    settled = rows.join(F.broadcast(heavy), "digest").select("id", "row", "digest", "first", "size")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("size"))
    return settled.unionByName(rest.join(groups, "digest").select("id", "row", "digest", "first", "size")).select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, heavy_k: int = HEAVY_K, tracked: int = TRACKED) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keyed = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.doc_id").alias("id"), F.unhex(F.sha2(normalised(F.col("doc.text")), 256)).alias("digest"), F.lit(0).cast("long").alias("row"))
    heavy = stored(winners(keyed.select("id", "digest", "row", F.xxhash64("digest").alias("key")), heavy_k, tracked), "winners")
    # copies of frequent texts go before any text is shuffled
    left = keyed.join(F.broadcast(heavy.select("digest", "first")), "digest", "left").where(F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first.id")))
    order = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last())
    return left.withColumn("place", F.row_number().over(order)).where("place = 1").select("doc.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""
