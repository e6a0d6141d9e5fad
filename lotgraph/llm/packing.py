"""Sequence packing by non-negative least squares (operator 7).

Documents are cut into whole windows and one remainder each.  The histogram of all remainders' lengths, at most a number
per length below the window, is all that one place sees of the corpus:

1. shallow length combinations that fill a window exactly are enumerated: a + b, and i times a, j times b and c, for
   every present c and fillers drawn by their weight;
2. non-negative repeat counts x that minimise ``|A x - h|²`` are solved by multiplicative updates;
3. the counts are rounded to the nearest that the histogram still has, most used combination first, and what is left of
   the histogram is solved again with new fillers, until a round packs less than a hundredth of the rest;
4. residual remainders are packed greedily, longest first, each window taking what fits and cutting the last piece.

The solution says which ranks of a length go to which sequence and place.  A remainder's rank is its number in its task,
counted while texts are encoded, and the counts of the tasks before, so no text is shuffled; only residual documents,
which the solution has no window for, are dealt to tasks of about ``block_tokens`` ids.  What is left at the end of such
a task, less than a window, is cut into sequences whose lengths are powers of two, which need no padding; everything
else fills windows exactly.  A lost task is run again with the same result.

Defined cases: null and empty texts have only the end id; repeated rows are packed as often as they occur; a null
doc_id is kept; ties of rank go by task and place in it; a text of any length is encoded whole by one task and cut into
windows; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.llm.scratch import only, stored
from lotgraph.llm.tokens import encoder, tokenizer_path

WINDOW = 4096
BLOCK_TOKENS = 4_000_000
FILLERS = 32  # drawn for each length and round
REPEATS = 16  # most repeats of a filler
KEPT = 60_000  # combinations of a round
SWEEPS = 60
ROUNDS = 24
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
BROADCAST_ROWS = 2_000_000
WHOLE, REST = 1 << 62, 1 << 61  # sequence ids of whole windows and of residual documents


def combinations(hist: np.ndarray, window: int = WINDOW, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and times, three of each to a row (times 0: not used), of combinations that fill the window."""
    hist = np.zeros(window + 1, np.int64) + np.pad(np.asarray(hist, np.int64), (0, window + 1 - len(hist)))
    hist[0] = 0
    present, rng = np.flatnonzero(hist), np.random.default_rng(seed)
    if not len(present):
        return np.empty((0, 3), np.int64), np.empty((0, 3), np.int64)
    pairs = present[(present <= window // 2) & (hist[window - present] > 0)]

    def rows(a, b, c, i: int, j: int, k: int) -> np.ndarray:
        """Lengths and times side by side, two bytes each."""
        out = np.empty((len(a), 6), np.int16)
        for column, value in enumerate((a, b, c, i, j, k)):
            out[:, column] = value
        return out

    made = [rows(pairs, window - pairs, 0, 1, 1, 0)]
    fillers = rng.choice(present, (len(present), FILLERS), p=hist[present] / hist[present].sum())
    c, a = np.repeat(present, FILLERS).astype(np.int32), fillers.ravel().astype(np.int32)
    for i in range(1, REPEATS + 1):
        left = window - c - i * a
        on = np.flatnonzero((left >= 0) & (hist[a] >= i))
        ci, ai, li = c[on], a[on], left[on]
        full = li == 0
        made.append(rows(ai[full], ci[full], 0, i, 1, 0))
        for j in range(1, REPEATS + 1):
            bi = li // j
            fits = np.flatnonzero((li > 0) & (bi * j == li) & (hist[bi] >= j))
            made.append(rows(ai[fits], bi[fits], ci[fits], i, j, 1))
    found = np.concatenate(made)
    if len(found) > 4 * KEPT:
        found = found[np.unique(rng.integers(0, len(found), 4 * KEPT))]
    # one length once, the smaller lengths first
    found[:, 3] += np.where(found[:, 0] == found[:, 1], found[:, 4], 0)
    found[:, 4] = np.where(found[:, 0] == found[:, 1], 0, found[:, 4])
    for k in (0, 1):
        same = (found[:, k] == found[:, 2]) & (found[:, 3 + k] > 0) & (found[:, 5] > 0)
        found[:, 3 + k] += np.where(same, found[:, 5], 0)
        found[:, 5] = np.where(same, 0, found[:, 5])
    lengths = np.where(found[:, 3:] > 0, found[:, :3], np.int16(window))
    order = np.argsort(lengths, axis=1, kind="stable")
    lengths, times = np.take_along_axis(lengths, order, axis=1), np.take_along_axis(found[:, 3:], order, axis=1)
    have = ((hist[lengths] >= times) | (times == 0)).all(axis=1)
    both = np.unique(np.concatenate([lengths, times], axis=1)[have], axis=0)
    if len(both) > KEPT:
        both = both[np.sort(rng.choice(len(both), KEPT, replace=False))]
    return np.where(both[:, 3:] > 0, both[:, :3], 0).astype(np.int64), both[:, 3:].astype(np.int64)


def repeat_counts(hist: np.ndarray, combos: tuple[np.ndarray, np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: x ← x · Aᵀh / AᵀAx."""
    lengths, times = combos
    size = max(len(hist), int(lengths.max(initial=0)) + 1)
    goal = np.pad(np.asarray(hist, float), (0, size - len(hist)))
    goal[0] = 0
    wanted = (times * goal[lengths]).sum(axis=1)
    x = np.ones(len(lengths))
    for _ in range(sweeps):
        fit = np.bincount(lengths.ravel(), (times * x[:, None]).ravel(), size)
        x *= wanted / np.maximum((times * fit[lengths]).sum(axis=1), 1e-12)
    return x


def solve(hist: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[list[tuple[int, int]], int]], np.ndarray]:
    """Used combinations as (((length, times), ...), repeats), and the histogram that is left."""
    left, used = np.asarray(hist, np.int64).copy(), []
    left[0] = 0
    weight = np.arange(len(left))
    for turn in range(ROUNDS):
        before = int((left * weight).sum())
        combos = combinations(left, window, turn)
        if not len(combos[0]):
            break
        x = repeat_counts(left, combos)
        parts = [[(n, k) for n, k in zip(ns, ks, strict=True) if k] for ns, ks in zip(combos[0].tolist(), combos[1].tolist(), strict=True)]
        # the rounded counts first, then what the histogram still has
        for most_of in (lambda v: int(v + 0.5), lambda v: 1):
            for j in np.argsort(-x, kind="stable"):
                take = min(most_of(x[j]), *(int(left[n]) // k for n, k in parts[j]))
                if take > 0:
                    for n, k in parts[j]:
                        left[n] -= k * take
                    used.append((parts[j], take))
        after = int((left * weight).sum())
        if before - after < before / 100:
            break
    return used, left


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of these lengths; each id lies in one piece."""
    sequences: list[list[tuple[int, int, int]]] = []
    whole = lengths // window
    for d in np.flatnonzero(whole):
        sequences += [[(int(d), int(k) * window, window)] for k in range(whole[d])]
    rest = lengths - whole * window
    hist = np.bincount(rest, minlength=window)
    hist[0] = 0
    order = np.argsort(rest, kind="stable")
    ends = np.cumsum(np.bincount(rest, minlength=window))
    queue = {n: order[ends[n] - hist[n] : ends[n]].tolist() for n in np.flatnonzero(hist).tolist()}
    for parts, repeats in solve(hist, window)[0]:
        for _ in range(repeats):
            owners = [(queue[n].pop(), n) for n, k in parts for _ in range(k)]
            sequences.append([(d, int(whole[d]) * window, n) for d, n in owners])
    current: list[tuple[int, int, int]] = []
    room = window
    for n in sorted(queue, reverse=True):
        for d in reversed(queue[n]):
            start, size = int(whole[d]) * window, n
            while size:
                take = min(size, room)
                current.append((d, start, take))
                start, size, room = start + take, size - take, room - take
                if not room:
                    sequences.append(current)
                    current, room = [], window
    used = window - room
    while used:
        target = 1 << (used.bit_length() - 1)
        seq, need = [], target
        while need:
            d, start, size = current[0]
            take = min(size, need)
            seq.append((d, start, take))
            current[0:1] = [(d, start + take, size - take)] if size > take else []
            need -= take
        sequences.append(seq)
        used -= target
    return sequences


def _crc(ids: bytes, start: int, size: int) -> int:
    return zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])


def _encoded(path: str, end_id: int, window: int):
    """Per document the checksums of its windows and remainder, its numbers in its task, and the remainder's ids."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lotgraph.llm.tokens")
        encode, task = encoder(path), TaskContext.get().partitionId()
        ranks, windows = np.zeros(window, np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = [b + tail for b in encode(part.column("text"))]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                rank, first = [], []
                for n in sizes.tolist():
                    rank.append(int(ranks[n % window]))
                    ranks[n % window] += 1
                    first.append(windows)
                    windows += n // window
                crcs = [[_crc(x, s, window) for s in range(0, n, window)] for x, n in zip(ids, sizes.tolist(), strict=True)]
                tails = [x[len(x) - 4 * (n % window) :] for x, n in zip(ids, sizes.tolist(), strict=True)]
                columns = [pa.array(np.full(len(ids), task, np.int64)), pa.array(sizes % window), pa.array(rank, pa.int64()), pa.array(first, pa.int64()), pa.array(sizes), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "task", "rest", "rank", "windows", "tokens", "crcs", "tail"])

    return run


def _residual(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("tokens").to_pylist(), b.column("rest").to_pylist(), b.column("tail").to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
        if not rows:
            return
        out = []
        for q, seq in enumerate(plan(np.array([r[2] for r in rows], np.int64), window)):
            at = 0
            for d, start, size in seq:
                name, tokens, rest, ids = rows[d]
                out.append((name, tokens - rest + start, size, _crc(ids, start, size), tokens, REST | (task << 36) + q, at))
                at += size
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    found = stored(rows.mapInArrow(_encoded(path or tokenizer_path(), end_id, window), "doc_id long, task long, rest long, rank long, windows long, tokens long, crcs array<long>, tail binary"), "encoded")
    whole = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tokens") / window) - 1))
    windows = found.where(F.col("tokens") >= window).select("doc_id", "task", "windows", "tokens", "crcs", whole.alias("k"))
    windows = windows.select("doc_id", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.get("crcs", F.col("k").cast("int")).alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.lit(WHOLE) + F.shiftleft("task", 36) + F.col("windows") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # per task and length a count; per length of less than a window one number comes to the driver
    counts = stored(found.where("rest > 0").groupBy("task", "rest").count(), "counts")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("count").alias("n")).collect():
        hist[r["rest"]] = r["n"]
    used, left = solve(hist, window)
    slots, taken, first = [], np.zeros(window, np.int64), 0
    for parts, repeats in used:
        at = 0
        for n, k in parts:
            slots.append((n, int(taken[n]), k, first, at))
            taken[n] += k * repeats
            at += n * k
        first += repeats
    sent = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 5))  # a row per length of each combination used

    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = F.broadcast(spark.createDataFrame([(n, int(taken[n])) for n in range(1, window)], "rest long, taken long"))  # at most a number per length
    tasks = stored(counts.withColumn("before", F.sum("count").over(before) - F.col("count")).join(cuts, "rest"), "tasks")
    rank = F.col("rank") + F.col("before")
    ranked = found.where("rest > 0").select("doc_id", "task", "rest", "rank", "tokens", F.element_at("crcs", -1).alias("crc")).join(tasks.where("before < taken"), ["task", "rest"]).withColumn("rank", rank)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            rest, rank, tokens = (batch.column(c).to_numpy() for c in ("rest", "rank", "tokens"))
            row = table[np.searchsorted(keys, (rest << 48) + rank, side="right") - 1] if len(table) else np.empty((0, 5), np.int64)
            turn, slot = (rank - row[:, 1]) // row[:, 2], (rank - row[:, 1]) % row[:, 2]
            columns = [tokens - rest, rest, batch.column("crc"), tokens, row[:, 3] + turn, row[:, 4] + slot * rest]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    solved = ranked.where("rank < taken").select("doc_id", "rest", "rank", "tokens", "crc").mapInArrow(placed, SCHEMA)
    # the last ranks of a length are residual, so few tasks have them; up to BROADCAST_ROWS of these are sent, more are joined
    open_ = tasks.where(F.col("before") + F.col("count") > F.col("taken"))
    open_ = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
    rest = found.where("rest > 0").join(open_, ["task", "rest"]).where(rank >= F.col("taken")).select("doc_id", "tokens", "rest", "tail")
    dealt = rest.repartition(int(-(-int((left * np.arange(window)).sum()) // max(block_tokens, 64 * window)) or 1), F.xxhash64("tail", "doc_id"))
    return windows.unionByName(solved).unionByName(dealt.mapInArrow(_residual(window), SCHEMA))
