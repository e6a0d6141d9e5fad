"""Joins and components whose hot keys are spread over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgraph.llm.scratch import stored

HOT_KEYS = 50_000  # at most so many keys can have more than this share of the rows each, so they may be broadcast
LEAST = 256  # rows of a key that one task may well take
FEW = 500_000  # rows of a few numbers each that are sent to all tasks rather than shuffled
PARTS = 16  # and of their files


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys of more than LEAST and more than a HOT_KEYS-th of the rows: fewer than HOT_KEYS."""
    limit = max(LEAST, rows.count() // HOT_KEYS)
    return stored(rows.groupBy(key).count().where(F.col("count") > limit).select(key), "hot")


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None, most: int = FEW, parts: int | None = None) -> DataFrame:
    """left (a stored table) joined with right, which has one row per key.

    Up to most rows of right, written in parts files, go to all tasks, so left is not shuffled.  Of more rows, those of hot keys of left (fewer than
    HOT_KEYS) meet left where it is read; all others meet in an ordinary shuffle.
    """
    if hot is None:
        right = stored(right, "right", parts)
        if right.count() <= most:
            return left.join(F.broadcast(right), key)
        hot = hot_keys(left, key)
    often = left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return often.unionByName(rest)


def _few_components(edges: DataFrame, rounds: int) -> DataFrame:
    """components() of edges that are few enough for all tasks to have all labels: one small shuffle per round.

    A label that meets a smaller one across an edge hooks onto it, then every label takes its own label.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("far")).union(edges.select("b", "a"))
    labels = stored(ends.groupBy("node").agg(F.min("far").alias("far")).select("node", F.least("node", "far").alias("label")), "labels", PARTS)
    for _ in range(rounds):
        x, y = (F.broadcast(labels.toDF(end, f"l{end}")) for end in "ab")
        across = edges.select("a", "b").join(x, "a").join(y, "b").where("la != lb").select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to"))
        hooks = stored(across.groupBy("label").agg(F.min("to").alias("to")), "hooks", PARTS)
        if not hooks.count():
            return labels
        step = stored(labels.join(F.broadcast(hooks), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", PARTS)
        labels = stored(step.join(F.broadcast(step.toDF("label", "far")), "label").select("node", F.col("far").alias("label")), "labels", PARTS)
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, rounds: int = 64, few: int = FEW) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a long, b long; of stored tables).

    Each round takes the smallest label among neighbours and then the label's own label, so chains halve at least;
    lineage is cut after each round.  Up to few edges, labels go to all tasks.  Of more, minima are combined before the
    shuffle; busy nodes and labels of large components are settled by broadcast of their one row each.
    """
    if edges.count() <= few:
        return _few_components(edges, rounds)
    links = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("a", "node").distinct(), "links")
    hubs = hot_keys(links, "node")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("node"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = spread_join(links, labels, "node", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stored(spread_join(step, jump, "label", hot=hot_keys(step, "label")).select("node", "old", F.least("label", "far").alias("label")), "labels")
        changed = new.where("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
