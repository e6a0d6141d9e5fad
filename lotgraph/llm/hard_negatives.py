"""Hard-negative mining over a vantage-point tree (operator 11).

Rows have an id, a label and an integer vector; the score of two rows is their inner product.  Every row gets one more
coordinate, ``sqrt(M² - |x|²)`` for the largest length M, and a query gets 0 there.  All rows then lie on a sphere around
the origin and ``d² = |q|² + M² - 2 score``: a higher score is a smaller distance, and a window of scores is an annulus
around the query.

1. Of rows with one vector and label only the ``keep`` smallest ids can be among the first ones of a query, so batches
   are thinned to those, then groups; a vector that a third of all rows share is a few rows from here on.
2. The upper tree is made from at most SAMPLE rows: a vantage point per node, halves by the median distance.  It has at
   most LEAVES leaves however many rows there are.  Every row walks down it, and a leaf's rows are dealt into blocks of
   about BLOCK rows, each with a vantage-point tree of its own, whose buckets keep their nearest and furthest distance to
   every vantage point of the block.
3. Search, nearest first inside the annulus.  The triangle inequality bounds a query's scores in each leaf.  The leaf with
   the best bound is searched first and gives the k-th score; a second pass searches the leaves whose bound still reaches
   it.  Inside a block the buckets are taken in order of their best score within the window, until the next one can't
   reach the k-th found.  Queries come in chunks of about CHUNK to a block, so a task holds one block and one chunk.

The search is exact: bounds have slack for rounding, and equal scores are not pruned, so ties go to the smaller id.

Defined cases: rows with a null id, label, vector or component take no part, nor do those with a component that is not
finite or with a squared length of 2 ** 52 and more, whose scores would not be exact; a shorter vector counts as filled
up with zeros; rows that repeat id, label and vector are one row, and no row with the anchor's id is its positive; a
label or vector that many rows share is no special case; a positive with a score below zero has an empty window; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotgraph.llm.scratch import stored

SAMPLE, LEAVES, LEAF_ROWS = 8192, 512, 4096
BLOCK, BUCKET, CHUNK = 2048, 64, 1024
PARTS = 64  # of the first grouping of equal vectors
LIMIT = 2.0**52
_LEAST = np.iinfo(np.int64).min


def short(v: Column) -> Column:
    """The squared length is small enough for exact scores."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < LIMIT


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of an array, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    sizes = np.diff(ends)
    flat = np.asarray(column.values)[ends[0] : ends[-1]]
    out = np.zeros((len(sizes), width), np.int32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(np.float64)


def _packed(width: int):
    """The rows with v as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _binary(_matrix(batch.column("v"), width))], names=["id", "label", "v"])

    return run


def _thin(keep: int):
    """The rows of a batch that a query can have among its first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (_, label), (_, v) = np.asarray(batch.column("id")), *(np.unique(batch.column(c).to_numpy(zero_copy_only=False), return_inverse=True) for c in ("label", "v"))
            order = np.lexsort((ids, label, v))
            first = np.r_[True, (np.diff(v[order]) != 0) | (np.diff(label[order]) != 0)][: len(order)]
            start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            yield batch.take(pa.array(order[np.arange(len(order)) - start < keep]))

    return run


def thinned(rows: DataFrame, keep: int) -> DataFrame:
    """id, label, v: of each vector and label the keep smallest ids; batches, then parts of a group, then groups."""
    few = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)
    small = rows.mapInArrow(_thin(keep), "id long, label long, v binary")
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    parts = small.select("*", part).groupBy("label", "v", "part").agg(few(F.collect_list("id")).alias("ids"))
    return parts.groupBy("label", "v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.explode("ids").alias("id"), "label", "v")


class _Tree:
    """Vantage points with medians; leaves are numbered from left to right."""

    def __init__(self, x: np.ndarray, levels: int, m2: float, rng: np.random.Generator):
        self.levels, self.m2, self.nodes = levels, m2, {}
        self._split(lifted(x, m2), 1, rng)

    def _split(self, x: np.ndarray, node: int, rng: np.random.Generator) -> None:
        if node >= 1 << self.levels or not len(x):
            return
        tried = x[rng.choice(len(x), min(8, len(x)), replace=False)]
        far = distances(tried, x)
        k = int(np.argmax(far.std(axis=1)))
        cut = float(np.median(far[k]))
        self.nodes[node] = tried[k], cut
        for child, half in ((2 * node, far[k] <= cut), (2 * node + 1, far[k] > cut)):
            self._split(x[half], child, rng)

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distance to the vantage points on its way."""
        at, path, up = np.ones(len(x), np.int64), np.zeros((len(x), self.levels)), lifted(x, self.m2)
        for level in range(self.levels):
            for node in np.unique(at):
                own = np.flatnonzero(at == node)
                if node in self.nodes:
                    point, cut = self.nodes[node]
                    d = distances(point[None], up[own])[0]
                    path[own, level] = d
                    at[own] = 2 * node + (d > cut)
                else:
                    at[own] = 2 * node
        return at - (1 << self.levels), path

    def bounds(self, q: np.ndarray, rings: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves with rows, and for each query the least and most score in them."""
        leaves = np.array(sorted(rings), np.int64)
        base = (q * q).sum(axis=1)
        at = {n: np.sqrt(np.maximum(0.0, base + self.m2 - 2 * (q @ p[:-1]))) for n, (p, _) in self.nodes.items()}
        low, high = np.zeros((len(q), len(leaves))), np.full((len(q), len(leaves)), np.inf)
        for k, leaf in enumerate(leaves):
            lo, hi = rings[leaf]
            for level in range(self.levels):
                node = (int(leaf) + (1 << self.levels)) >> (self.levels - level)
                if node in at:
                    low[:, k] = np.maximum(low[:, k], np.maximum(at[node] - hi[level], lo[level] - at[node]))
                    high[:, k] = np.minimum(high[:, k], at[node] + hi[level])
        return leaves, *scores(base, self.m2, low, high)


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(axis=1)))])


def distances(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each point to each row; both lie on the sphere."""
    return np.sqrt(np.maximum(0.0, (points * points).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * (points @ x.T)))


def scores(base: np.ndarray, m2: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score of distances from low to high, with slack for rounding."""
    total = base[:, None] + m2
    slack = 1e-3 + 1e-7 * total
    reach = np.sqrt(base)[:, None] * np.sqrt(m2)  # no score is beyond
    least = np.ceil(np.maximum((total - np.minimum(high, 1e150) ** 2) / 2, -reach) - slack)
    most = np.floor(np.minimum((total - np.maximum(low, 0.0) ** 2) / 2, reach) + slack)
    return least, most


def _routed(tree: _Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, path = tree.walk(_vectors(batch.column("v"), width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, path.size + 1, max(1, tree.levels), dtype=np.int32) if tree.levels else np.zeros(len(leaf) + 1, np.int32)), pa.array(path.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), lists], names=[*batch.schema.names, "leaf", "path"])

    return run


def _built(width: int, m2: float):
    """A block: its rows in the order of the buckets of its own tree, and the buckets' rings."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels = np.asarray(table.column("id")), np.asarray(table.column("label"))
        x = _vectors(table.column("v"), width)
        up, order, starts, points = lifted(x, m2), [], [0], []

        def split(rows: np.ndarray) -> None:
            if len(rows) > BUCKET:
                far = distances(up[rows[:: max(1, len(rows) // 8)]], up[rows])
                k = int(np.argmax(far.std(axis=1)))
                points.append(up[rows[:: max(1, len(rows) // 8)][k]])
                by = np.argsort(far[k], kind="stable")
                split(rows[by[: len(by) // 2]])
                split(rows[by[len(by) // 2 :]])
            else:
                order.append(rows)
                starts.append(starts[-1] + len(rows))

        split(np.argsort(ids, kind="stable"))
        order = np.concatenate(order)
        points = np.array(points or [up[order[0]]])
        far = distances(points, up[order])
        lo = np.stack([far[:, s:e].min(axis=1) for s, e in zip(starts, starts[1:])])
        hi = np.stack([far[:, s:e].max(axis=1) for s, e in zip(starts, starts[1:])])
        values = [ids[order], labels[order], x[order].astype(np.int32), np.array(starts, np.int64), points, lo, hi]
        path = np.stack([np.asarray(p, np.float64) for p in table.column("path").to_pylist()])
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]]
        return pa.Table.from_arrays([*columns, pa.array([path.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([path.max(axis=0).tolist()], pa.list_(pa.float64()))], names=[f.split()[0] for f in _BLOCKS.split(", ")])

    return run


_BLOCKS = "leaf int, block int, ids binary, labels binary, x binary, starts binary, points binary, lo binary, hi binary, path_lo array<double>, path_hi array<double>"


def first_in_block(q: dict[str, np.ndarray], block: dict[str, np.ndarray], m2: float, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores (queries x k) of the first rows of a block for each query; _LEAST where there is none.

    q: x, label, own, lo, hi, floor; of each query only scores from lo to hi that reach floor count.
    """
    x, base, n = q["x"], (q["x"] * q["x"]).sum(axis=1), len(q["x"])
    at = np.sqrt(np.maximum(0.0, base[:, None] + m2 - 2 * (x @ block["points"][:, :-1].T)))
    low, high = np.zeros((n, len(block["lo"]))), np.full((n, len(block["lo"])), np.inf)
    for p in range(at.shape[1]):
        low = np.maximum(low, np.maximum(at[:, p : p + 1] - block["hi"][None, :, p], block["lo"][None, :, p] - at[:, p : p + 1]))
        high = np.minimum(high, at[:, p : p + 1] + block["hi"][None, :, p])
    least, most = scores(base, m2, low, high)
    top = np.where(least <= q["hi"][:, None], np.minimum(most, q["hi"][:, None]), -np.inf)
    turn = np.argsort(-top, axis=1, kind="stable")
    top = np.take_along_axis(top, turn, axis=1)
    best, who = np.full((n, k), _LEAST), np.full((n, k), np.iinfo(np.int64).max)
    need = np.maximum(q["lo"], q["floor"]).astype(np.float64)
    for t in range(top.shape[1]):
        active = np.flatnonzero(top[:, t] >= need)
        if not len(active):
            break
        for bucket in np.unique(turn[active, t]):
            own = active[turn[active, t] == bucket]
            rows = slice(*block["starts"][bucket : bucket + 2])
            got = np.rint(x[own] @ block["x"][rows].T).astype(np.int64)
            match = block["labels"][rows][None] == q["label"][own][:, None]
            good = (match & (block["ids"][rows][None] != q["own"][own][:, None]) if same else ~match) & (got >= need[own][:, None]) & (got <= q["hi"][own][:, None])
            hit = good.any(axis=1)
            own, got = own[hit], np.where(good[hit], got[hit], _LEAST)
            if len(own):
                s = np.concatenate([best[own], got], axis=1)
                i = np.concatenate([who[own], np.where(got > _LEAST, block["ids"][rows][None], np.iinfo(np.int64).max)], axis=1)
                first = np.lexsort((i, -np.maximum(s, _LEAST + 1)), axis=1)[:, :k]
                best[own], who[own] = np.take_along_axis(s, first, axis=1), np.take_along_axis(i, first, axis=1)
                need[own] = np.maximum(need[own], best[own, k - 1])
    return who, best


def _searched(width: int, m2: float, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                raw = lambda c, t, *shape: np.frombuffer(row[c].as_py(), t).reshape(*shape)  # noqa: B023, E731
                starts = raw("starts", np.int64, -1)
                points = raw("points", np.float64, -1, width + 1)
                block = {"ids": raw("ids", np.int64, -1), "labels": raw("labels", np.int64, -1), "x": raw("x", np.int32, -1, width).astype(np.float64), "starts": starts, "points": points, "lo": raw("lo", np.float64, -1, len(points)), "hi": raw("hi", np.float64, -1, len(points))}
                asked = row["queries"].values
                q = {c: np.asarray(asked.field(c)) for c in ("q", "label", "own", "lo", "hi", "floor")} | {"x": _vectors(asked.field("v"), width)}
                who, best = first_in_block(q, block, m2, k, same)
                a, b = np.nonzero(best > _LEAST)
                yield pa.RecordBatch.from_arrays([pa.array(q["q"][a]), pa.array(who[a, b]), pa.array(best[a, b])], names=["q", "id", "score"])

    return run


class Index:
    """The tree over all rows (id, label, v) and its searches."""

    def __init__(self, rows: DataFrame, keep: int):
        self.spark = rows.sparkSession
        rows = rows.where(short(F.col("v")))
        size = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("m2"), F.count(F.lit(1)).alias("n")).first()
        self.width, self.m2, self.n = max(1, size["width"] or 0), size["m2"] or 0.0, size["n"]
        self.rows = stored(rows.mapInArrow(_packed(self.width), "id long, label long, v binary"), "vectors")
        self.k = keep
        thin = thinned(self.rows, keep + 1)
        # rows with a small hash, twice as many as needed in expectation, so tasks together send no more to the driver
        place = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
        sample = self.rows.where(place < int(min(1.0, 2 * SAMPLE / max(1, self.n)) * (1 << 31))).orderBy(place, "id").limit(SAMPLE).select("v").collect()
        x = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), np.int32).reshape(-1, self.width).astype(np.float64)
        levels = 0
        while (1 << levels) < LEAVES and (LEAF_ROWS << levels) < self.n:
            levels += 1
        self.tree = _Tree(x, levels, self.m2, np.random.default_rng(11))
        routed = stored(thin.mapInArrow(_routed(self.tree, self.width), "id long, label long, v binary, leaf int, path array<double>"), "routed")
        sizes = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # LEAVES rows at most
        self.sizes = stored(sizes, "leaves")
        dealt = routed.join(F.broadcast(self.sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).drop("blocks")
        self.blocks = stored(dealt.groupBy("leaf", "block").applyInArrow(_built(self.width, self.m2), _BLOCKS), "blocks")
        ring = self.blocks.select("leaf", F.posexplode(F.arrays_zip("path_lo", "path_hi")).alias("level", "p")).groupBy("leaf", "level").agg(F.min("p.path_lo").alias("lo"), F.max("p.path_hi").alias("hi"))
        self.rings = {r["leaf"]: (np.zeros(levels), np.zeros(levels)) for r in self.sizes.collect()}
        for r in ring.collect():  # a row for each leaf and level
            self.rings[r["leaf"]][0][r["level"]], self.rings[r["leaf"]][1][r["level"]] = r["lo"], r["hi"]

    def _leaves(self, queries: DataFrame, first: bool) -> DataFrame:
        """queries with a leaf to search: the best one, or all others whose bound reaches what the query asks for."""
        tree, rings, width = self.tree, self.rings, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(k, CHUNK)
                    lo, hi, floor = (np.asarray(part.column(c)).astype(np.float64) for c in ("lo", "hi", "floor"))
                    leaves, least, most = tree.bounds(_vectors(part.column("v"), width), rings)
                    top = np.where(least <= hi[:, None], np.minimum(most, hi[:, None]), -np.inf)
                    best = np.argmax(top, axis=1)
                    if first:
                        a, b = np.arange(len(best)), best
                    else:
                        top[np.arange(len(best)), best] = -np.inf
                        a, b = np.nonzero(top >= np.maximum(lo, floor)[:, None])
                    out = part.take(pa.array(a))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaves[b].astype(np.int32))], names=[*out.schema.names, "leaf"])

        return queries.mapInArrow(run, "q long, label long, own long, lo long, hi long, floor long, v binary, leaf int")

    def _visit(self, asked: DataFrame, same: bool) -> DataFrame:
        """q, id, score of the first rows in each block of the leaves asked for."""
        asked = stored(asked, "asked")
        chunks = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))  # LEAVES rows at most
        keyed = asked.join(F.broadcast(chunks), "leaf").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")))
        packed = keyed.groupBy("leaf", "chunk").agg(F.collect_list(F.struct("q", "label", "own", "lo", "hi", "floor", "v")).alias("queries"))
        each = packed.join(F.broadcast(self.sizes), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "queries")
        met = self.blocks.drop("path_lo", "path_hi").join(each, ["leaf", "block"])
        return met.mapInArrow(_searched(self.width, self.m2, self.k, same), "q long, id long, score long")

    def first(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """q, rank, id, score: the first k rows of each query (q, label, own, lo, hi, v) with its label, or another."""
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not self.rings:
            return self.spark.createDataFrame([], "q long, id long, score long, rank int")
        queries = queries.withColumn("floor", F.col("lo")).select("q", "label", "own", "lo", "hi", "floor", "v")
        near = best(self._visit(self._leaves(queries, True), same).distinct())
        if len(self.rings) == 1:
            return near
        near = stored(near, "near")
        kth = near.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        # the leaf searched first is the same one as before, as floor plays no part in its choice
        again = queries.join(kth, "q", "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth").select(*queries.columns)
        far = self._visit(self._leaves(again, False), same).distinct()
        return best(near.select("q", "id", "score").unionByName(far))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: id, label, v (array of integers).  A negative's score is from low to high hundredths of the positive's.
    """
    index = Index(vectors, max(positives, negatives))
    anchors = index.rows.where(is_anchor).distinct()
    anchors = stored(anchors.withColumn("q", F.monotonically_increasing_id()), "anchors")
    edge = F.lit(1 << 62)
    mates = index.first(anchors.select("q", "label", F.col("id").alias("own"), (-edge).alias("lo"), edge.alias("hi"), "v"), positives, True)
    mates = stored(mates.select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0"), "positives")
    # positives with one score have one window
    window = {"lo": F.expr(f"(positive_score * {low} + 99) div 100"), "hi": F.expr(f"(positive_score * {high}) div 100")}
    exact = mates.select(F.col("q").alias("a"), "positive_score").distinct().withColumns(window).where("lo <= hi")
    exact = stored(exact.withColumn("q", F.monotonically_increasing_id()), "windows")
    asked = exact.join(anchors.select(F.col("q").alias("a"), "label", F.col("id").alias("own"), "v"), "a")
    found = index.first(asked.select("q", "label", "own", "lo", "hi", "v"), negatives, False)
    out = found.join(exact.select("q", "a", "positive_score"), "q").select("a", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(mates.withColumnRenamed("q", "a"), ["a", "positive_score"]).join(anchors.select(F.col("q").alias("a"), F.col("id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth row, on labels and components as the query's contract changes them."""
    x = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(x(c) * 256)).alias("v"))
    return mine(rows, F.col("id") % 100 == 0)


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INT AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s QUALIFY rank <= 10"""
