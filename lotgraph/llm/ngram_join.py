"""N-gram Jaccard join as a blocked sparse matrix product (operator 10).

The incidence matrix has a row per document and a column per word n-gram (a 64-bit hash).  Documents with the same
row fall into one class first.  Of the product of the matrix with its transpose only entries that can reach the
threshold t are formed:

* Columns come in one global order: a fixed share of the hash space first (``1 / part``), by document frequency in it,
  then the rest, piece by piece of the hash space, and last the hot columns of the share.  If two rows reach the threshold, the first ``n - ceil(t * n) + 1`` columns of the longer one and the
  first ``n - ceil(2 t / (1 + t) * n) + 1`` of the shorter one share one, so only these are multiplied, and frequent
  n-grams fall out of them.
* A pair needs sizes within the threshold, enough columns left behind the shared one, and enough in the sum of the
  least bucket counts of both rows (an upper bound of the overlap).  Pairs below these size-derived bounds are dropped.
* The overlaps of the pairs that are left are accumulated exactly over the whole rows.

A group of near copies is not expanded into its pairs:

1. Star rounds.  Each column names one pivot by a rank of the row alone, so the columns of a group agree on it.  Each
   row takes the pivot that most of its columns name, one pair per row; pairs that reach the threshold link the row to
   the pivot, its centre, at a known Jaccard distance.  Linked rows are contracted to components, and later rounds look
   at columns with several components only, under ``PIVOTS`` other ranks each, as long as they still link.
2. Blocks.  Rows around one centre form a block.  In columns with several components left, blocks meet, not rows, in
   tiles of ``TILE`` blocks so that a column of many blocks is spread.  Jaccard distance is a metric: where the centres
   are further apart than ``1 - t`` and both radii, no pair of the blocks can link; where they reach t, they link.
3. Pairs of rows of different components are formed only inside block pairs that are neither, under all bounds and the
   distances to the centres, and are verified.  So no link between components is lost.

Defined cases: null or empty texts, or texts without words, have an empty set and are linked with nothing; a text with
fewer words than n has its whole word sequence as its only n-gram; null doc_ids sort last, so a component's id is null
only if all its ids are; repeated rows belong to one class; ties of rank go by row number and do not change components;
a text of any length is one row, of which a task holds the n-grams; an empty table gives an empty result; extra columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.llm.scratch import only, stored
from lotgraph.llm.spread import FEW, HOT_KEYS, LEAST, PARTS, components, spread_join

BUCKETS = 128
ROUNDS, PIVOTS = 6, 4  # most star rounds, and pairs of a row in each but the first; what they leave open is settled exactly
TILE = 256
PIECES = 16  # of the hash space, a power of two; they follow the share one by one
SAMPLE = 16  # one of so many rows tells busy columns
BROADCAST_ROWS = 2_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(1)
def _hashes() -> _Hashes:
    return _Hashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the text with A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        h = np.append(np.zeros(n - len(h), np.uint64), h)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _A
        out ^= out >> np.uint64(32)
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _B
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        pa.default_memory_pool().release_unused()


def prefix(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _features(n: int, num: int, den: int, part: int):
    import xxhash

    bound = np.uint64((1 << 64) // part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lotgraph.llm.ngram_join")
        for batch in _slices(batches):
            sets = [shingles(text.as_py(), n) for text in batch.column("text")]
            firsts = [int(np.searchsorted(s, bound)) for s in sets]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            counts = [np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32) for s in sets]
            # the share of the hash space; where it can't fill the prefix, all columns
            kept = [s if k < prefix(len(s), num, den) else s[:k] for s, k in zip(sets, firsts, strict=True)]
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *kept]).view(np.int64)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, BUCKETS * len(sets) + 1, BUCKETS, dtype=np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *counts])))
            sizes = [pa.array([len(s) for s in sets], pa.int32()), pa.array(firsts, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *sizes, pa.array(digests, pa.binary()), columns, rows], names=["id", "row", "n", "first", "digest", "columns", "counts"])

    return run


def _sets(n: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles(t.as_py(), n) for t in batch.column("text")]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["digest", "set"])

    return run


def _few(rows: DataFrame) -> DataFrame:
    """Up to BROADCAST_ROWS rows of numbers are sent to all tasks, more are joined by key."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _keys(rows: DataFrame) -> DataFrame:
    """rows of a stored table as keys of a semi join: sent to all tasks as they are, or, if there are many, once each."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.distinct()


def _reaches(overlap: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return overlap.cast("long") * (den + num) >= (a.cast("long") + b.cast("long")) * num


def _most(a: str, b: str) -> Column:
    """Upper bound of the overlap of two rows by their bucket counts."""
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)


def _sized(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b).cast("long") * den >= F.greatest(a, b).cast("long") * num


class _Join:
    """The rows of one matrix and what is known of their product; see the module's text."""

    def __init__(self, docs: DataFrame, found: DataFrame, n: int, num: int, den: int):
        self.docs, self.found, self.n, self.num, self.den = docs, found, n, num, den
        self.gap = 1 - num / den  # largest distance of a link
        self.parts = max(16, found.count() // 10_000)  # files of tables with a row or a few per row of the matrix

    def whole(self, rows: DataFrame) -> DataFrame:
        """row, n, set of the rows asked for (row, of a stored table): their whole sets, made again from their texts."""
        names = stored(self.found.select("row", "id", "digest", "n").join(_keys(rows), "row", "left_semi"), "names", self.parts)
        texts = self.docs.select("doc_id", "text")
        own = texts.join(_keys(names.where("id is not null").select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
        if names.where("id is null").limit(1).count():
            own = own.unionByName(texts.where("doc_id is null"))
        made = own.select("text").mapInArrow(_sets(self.n), "digest binary, set array<long>").join(_keys(names.select("digest")), "digest", "left_semi")
        return stored(made.dropDuplicates(["digest"]).join(_few(names.select("row", "n", "digest")), "digest").select("row", "n", "set"), "sets", self.parts)

    def overlaps(self, pairs: DataFrame, floor: Column | None = None) -> DataFrame:
        """a, b, distance of pairs (a, b) that the bucket counts leave possible; floor: least similarity asked for.

        The rows of b come to those of a, in parts if b has many pairs.
        """
        pairs = stored(pairs.withColumn("floor", F.lit(self.num / self.den) if floor is None else floor), "pairs", self.parts)
        degree = stored(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts")), "degrees", self.parts)
        keyed = pairs.join(F.broadcast(degree), "b") if degree.count() <= FEW else spread_join(pairs, degree, "b")
        keyed = keyed.select("a", "b", "floor", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("s"))

        def meet(keyed: DataFrame, rows: DataFrame, column: str) -> DataFrame:
            keys = degree.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
            x = rows.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col(column).alias("xa")).join(_few(keyed), "a")
            y = rows.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col(column).alias("xb")).join(_few(keys), "b")
            return x.join(y, ["b", "s"])

        total = (F.col("na") + F.col("nb")).cast("double")
        enough = F.col("floor") / (1 + F.col("floor")) * total - 1e-6
        left = stored(meet(keyed, self.found, "counts").where(_most("xa", "xb") >= enough).select("a", "b", "floor", "s"), "pairs", self.parts)
        sets = self.whole(left.select(F.col("a").alias("row")).union(left.select("b")))
        both = F.size(F.array_intersect("xa", "xb"))
        return stored(meet(left, sets, "set").select("a", "b", (1 - both / (total - both)).alias("distance"), _reaches(both.cast("long"), F.col("na"), F.col("nb"), self.num, self.den).alias("linked")), "overlaps", self.parts)

    def labelled(self, cells: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return cells.withColumn("label", F.col("row"))
        known = labels.withColumnRenamed("node", "row")
        return cells.join(F.broadcast(known) if labels.count() <= FEW else known, "row", "left").withColumn("label", F.coalesce("label", "row"))

    def mixed(self, cells: DataFrame) -> DataFrame:
        """h of columns with several labels and with a cell of a shorter row's prefix."""
        return cells.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("short").alias("short")).where("lo != hi and short").select("h")

    def stars(self, cells: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
        """a, b: for each row the pivots of other components that most of its columns name, if any."""
        ranks = [F.col("rank")] if turn == 0 else [F.xxhash64("row", F.lit(PIVOTS * turn + k)).cast("double") for k in range(PIVOTS)]
        known = self.labelled(cells, labels)
        known = stored(known, "cells") if labels is not None else known
        pivots = [F.min(F.struct(r.alias("rank"), "row", "n", "at", "label")).alias(f"p{k}") for k, r in enumerate(ranks)]
        named = known.groupBy("h").agg(*pivots, F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("short").alias("short")).where("lo != hi and short")
        named = named.select("h", F.array_distinct(F.array(*[f"p{k}" for k in range(len(ranks))])).alias("ps"))
        votes = spread_join(known, named, "h", most=FEW // 10).select("row", "n", "at", "label", F.explode("ps").alias("p")).where("label != p.label")
        votes = votes.where(_sized(F.col("n"), F.col("p.n"), self.num, self.den) & _reaches(F.least(F.col("n") - F.col("at"), F.col("p.n") - F.col("p.at")), F.col("n"), F.col("p.n"), self.num, self.den))
        counted = votes.groupBy("row", F.col("p.row").alias("pivot")).agg(F.count(F.lit(1)).alias("k"))
        best = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.xxhash64("pivot").alias("tie"), "pivot")))  # at most PIVOTS for each cell of a row
        return counted.groupBy("row").agg(best.alias("best")).select(F.col("row").alias("a"), F.explode(F.slice("best", 1, len(ranks))).alias("b")).select("a", "b.pivot").toDF("a", "b")

    def blocks(self, open_cells: DataFrame) -> DataFrame:
        """c, o: pairs of centres of blocks of different components that meet in a column, under the blocks' bounds."""
        num, den, t = self.num, self.den, self.num / self.den
        block = open_cells.groupBy("h", "c").agg(F.first("label").alias("label"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("d").alias("r"), F.max(F.col("n") - F.col("at")).alias("left"), F.bool_or("short").alias("short"))
        counts = self.found.select(F.col("row").alias("c"), F.col("n").alias("nc"), "counts")
        block = stored(block.join(counts, "c").withColumn("s", F.xxhash64("c")), "blocks")
        tiles = block.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        block = spread_join(block, tiles, "h").withColumn("tile", F.pmod("s", "tiles").cast("int"))
        others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        block = block.withColumn("other", others).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
        block = stored(block.drop("tiles", "other", "s"), "tiles")
        x, y = block.alias("x"), block.alias("y")
        col = F.col
        sizes = (col("x.hi").cast("long") * den >= col("y.lo").cast("long") * num) & (col("y.hi").cast("long") * den >= col("x.lo").cast("long") * num)
        room = _reaches(F.least("x.left", "y.left"), col("x.lo"), col("y.lo"), num, den)
        least = F.greatest(F.lit(0.0), t - col("x.r") - col("y.r") - 1e-9)
        bound = _most("x.counts", "y.counts") >= least / (1 + least) * (col("x.nc") + col("y.nc")) - 1e-6
        # a pair of one tile meets under (i, i), one of two tiles under (i, j) from either side once
        side = F.when(col("x.i") == col("x.j"), col("x.c") < col("y.c")).otherwise((col("x.tile") == col("x.i")) & (col("y.tile") == col("y.j")))
        met = x.join(y, (col("x.h") == col("y.h")) & (col("x.i") == col("y.i")) & (col("x.j") == col("y.j")) & side & (col("x.label") != col("y.label")) & (col("x.short") | col("y.short")) & sizes & room & bound)
        return met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"), F.when(col("x.c") < col("y.c"), col("x.r")).otherwise(col("y.r")).alias("ra"), F.when(col("x.c") < col("y.c"), col("y.r")).otherwise(col("x.r")).alias("rb")).groupBy("a", "b").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb"))

    def rows_between(self, open_cells: DataFrame, close: DataFrame) -> DataFrame:
        """a, b: pairs of rows inside close pairs of blocks, under all bounds."""
        num, den, col = self.num, self.den, F.col
        ends = stored(close.select(col("ca").alias("c")).union(close.select("cb")).distinct(), "ends", self.parts)
        mine = open_cells.join(ends, "c", "left_semi").join(self.found.select("row", "counts"), "row")
        mine = stored(mine.select("h", "row", "n", "at", "d", "c", "short", "counts"), "rows")
        x, y = mine.alias("x"), mine.alias("y")
        room = _reaches(F.least(col("x.n") - col("x.at"), col("y.n") - col("y.at")), col("x.n"), col("y.n"), num, den)
        apart = col("distance") - col("x.d") - col("y.d") <= self.gap + 1e-9
        bound = _reaches(_most("x.counts", "y.counts"), col("x.n"), col("y.n"), num, den)
        # a pair of blocks is opened from the side with fewer cells, whose columns then ask the other side
        cells = mine.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
        sized = close.join(cells.select(col("c").alias("ca"), col("k").alias("ka")), "ca").join(cells.select(col("c").alias("cb"), col("k").alias("kb")), "cb")
        sized = sized.select("distance", F.when(col("ka") <= col("kb"), col("ca")).otherwise(col("cb")).alias("few"), F.when(col("ka") <= col("kb"), col("cb")).otherwise(col("ca")).alias("many"))
        both = sized.join(x, col("few") == col("x.c")).join(y, (col("many") == col("y.c")) & (col("x.h") == col("y.h")) & (col("x.short") | col("y.short")) & _sized(col("x.n"), col("y.n"), num, den) & room & apart & bound)
        return both.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, part: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): rows has id, row, n, digest per document; ids has digest, component_id per class of equal sets."""
    part = part or (4 if num * 100 >= den * 88 else 3)
    source = docs.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    found = stored(source.mapInArrow(_features(n, num, den, part), "id long, row long, n int, first int, digest binary, columns array<long>, counts array<int>"), "features")
    base = found.select("id", "row", "n", "digest")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("m")
    reps = stored(base.where("n > 0").groupBy("digest").agg(least).select("digest", F.col("m.id").alias("id"), F.col("m.row").alias("row")), "classes")
    join, links, labels = _Join(docs, found, n, num, den), None, None
    kept = prefixes(join, reps)
    for turn in range(ROUNDS):
        pairs = stored(join.stars(kept, labels, turn), "stars", join.parts)
        got = join.overlaps(pairs).where("linked").select("a", "b", "distance")
        linked = got.count()
        if linked:
            links = got if links is None else links.unionByName(got)
            labels = components(links)
        if linked * 20 <= pairs.count():
            break

    # what is open: columns with several components, whose rows are blocks around the first pivot they were linked to
    cells = stored(join.labelled(kept, labels), "cells")
    open_cells = spread_join(cells, join.mixed(cells), "h")
    if links is None:
        centred = open_cells.withColumns({"c": F.col("row"), "d": F.lit(0.0)})
    else:
        centre = links.groupBy(F.col("a").alias("row")).agg(F.min_by("b", "distance").alias("c"), F.min("distance").alias("d"))
        centred = open_cells.join(centre, "row", "left").withColumns({"c": F.coalesce("c", "row"), "d": F.coalesce("d", F.lit(0.0))})
    open_cells = stored(centred, "open")
    near = stored(join.blocks(open_cells), "block_pairs")
    floor = F.greatest(F.lit(0.0), F.lit(num / den) - F.col("ra") - F.col("rb") - 1e-9)
    met = join.overlaps(near.select("a", "b", floor.alias("floor")), F.col("floor")).join(near, ["a", "b"])
    more = met.where("linked").select("a", "b", "distance")
    close = stored(met.where(~F.col("linked") & (F.col("ra") + F.col("rb") > 0) & (F.col("distance") <= join.gap + F.col("ra") + F.col("rb") + 1e-9)).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "distance"), "close", join.parts)
    if close.limit(1).count():
        pairs = join.rows_between(open_cells, close)
        more = more.unionByName(join.overlaps(pairs).where("linked").select("a", "b", "distance"))
    more = stored(more, "edges", join.parts)
    if more.limit(1).count():
        labels = components(more if links is None else links.unionByName(more))

    own = stored(join.labelled(reps, labels), "members", join.parts)
    ids = own.groupBy("label").agg(F.min("id").alias("component_id"))
    return base, stored(spread_join(own, ids, "label", parts=join.parts).select("digest", "component_id"), "components", join.parts)


def prefixes(join: _Join, reps: DataFrame) -> DataFrame:
    """h, row, n, at, short, rank: the cells of the rows' prefixes in the global order, of columns with several rows.

    at: the column's place in its row; short: it lies in the prefix that the row has as the shorter one of a pair; rank:
    rows most of whose columns others have too come first.  Only rows whose prefix is not filled by the share of the hash
    space, its hot columns aside, send other columns: the next pieces of the hash space, as many as fill it.
    """
    found, num, den = join.found, join.num, join.den
    others = found.where("n > 0").select("row").join(reps.select("row"), "row", "left_anti")
    mine = found.where("n > 0").select("row", "n", "first", "columns").join(_few(stored(others, "others", join.parts)), "row", "left_anti")
    length = F.col("n") - F.ceil(F.col("n").cast("long") * num / F.lit(den)) + 1
    short = F.col("n") - F.ceil(F.col("n").cast("long") * (2 * num) / F.lit(den + num)) + 1

    early = counted(mine.select("row", F.explode(F.slice("columns", F.lit(1), F.col("first"))).alias("h")), found.agg(F.sum("first")).first()[0] or 0, "early")
    # a column with more than a HOT_KEYS-th of the cells is hot, so there are fewer than HOT_KEYS
    hot_df = max(256, early.count() // HOT_KEYS)
    hots = stored(early.where(F.col("df") > hot_df).groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("hot")), "hot_cells", join.parts)
    needy = mine.join(_few(hots), "row", "left").withColumn("need", length - F.col("first") + F.coalesce("hot", F.lit(0))).where("need > 0 and first < n")
    needy = stored(needy.select("row", "first", "need", F.when(F.col("first") < length, F.col("columns")).alias("columns")), "needy", join.parts)
    full = needy.where("columns is not null").select("row", F.size("columns").alias("n"), "first", "need", F.col("columns").alias("set"))
    few = needy.where("columns is null").select("row", "first", "need")
    if few.limit(1).count():
        full = full.unionByName(join.whole(few.select("row")).join(few, "row").select("row", "n", "first", "need", "set"))
    rest = stored(pieces(full), "rest")
    later = counted(rest, rest.count(), "later")
    tier = F.when(F.col("df") > hot_df, PIECES + 1).otherwise(0)
    shared = early.select("row", "h", "df", tier.alias("tier"), F.lit(None).cast("int").alias("end")).unionByName(later.select("row", "h", "df", (_piece(F.col("h")) + 1).alias("tier"), "end"))
    whole, within = Window.partitionBy("row"), Window.partitionBy("row", "tier")
    number = lambda those: F.sum(F.when(those, 1).otherwise(0)).over(whole).cast("int")
    placed = shared.withColumns({"hot": number(F.col("tier") > PIECES), "known": number(F.col("end").isNull())})  # by row first: one shuffle serves both
    placed = placed.withColumns({"own": F.count(F.lit(1)).over(within), "place": F.row_number().over(within.orderBy("df", "h")) - 1})
    placed = placed.join(_few(found.select("row", "n", "first")), "row")
    # columns that nobody else has come before the shared ones of their tier
    before = F.when(F.col("tier") == 0, F.col("first") - F.col("hot")).when(F.col("tier") > PIECES, F.col("n")).otherwise(F.col("end") - F.col("hot"))
    cells = placed.withColumn("at", (before - F.col("own") + F.col("place")).cast("int")).where(F.col("at") < length)
    return stored(cells.select("h", "row", "n", "at", (F.col("at") < short).alias("short"), (-F.col("known") / F.greatest("first", F.lit(1))).alias("rank")), "prefixes")


def counted(cells: DataFrame, total: int, name: str) -> DataFrame:
    """The about total cells (h, row, ...) of columns that several rows have, with df, the number of these rows.

    Cells meet once, under their column; busy columns, found by one in SAMPLE of the rows, are counted before the shuffle and
    settled where their cells are made.  Which columns are taken for busy changes no df.
    """
    sample = cells.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    busy = stored(sample.where(F.col("df") > max(LEAST, total // HOT_KEYS) // SAMPLE).select("h"), "busy", PARTS)
    busy = stored(cells.join(F.broadcast(busy), "h").groupBy("h").agg(F.count(F.lit(1)).alias("df")), "busy", PARTS)
    often = cells.join(F.broadcast(busy), "h")
    other = cells.join(F.broadcast(busy.select("h")), "h", "left_anti").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h")))
    return stored(often.unionByName(other).where("df > 1"), name)


def _piece(h: Column) -> Column:
    """Which of the PIECES equal pieces of the hash space h lies in."""
    return F.shiftrightunsigned(h, 64 - (PIECES - 1).bit_length()).cast("int")


def pieces(rows: DataFrame) -> DataFrame:
    """row, h, end: of rows (row, n, first, need, set) the columns behind the first ones, by whole pieces of the hash space, until there
    are need of them or no more; end: the row's columns up to the end of the piece.
    """
    last = F.element_at("set", F.least(F.col("first") + F.col("need"), F.col("n")).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.size(F.filter("set", lambda h: _piece(h) <= k)))
    behind = F.filter(F.slice("set", F.col("first") + 1, F.col("n") - F.col("first")), lambda h: _piece(h) <= F.col("last"))
    sent = rows.withColumns({"last": _piece(last), "ends": ends}).select("row", "ends", F.explode(behind).alias("h"))
    return sent.select("row", "h", F.element_at("ends", _piece(F.col("h")) + 1).alias("end"))


def report(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    rows, ids = classes(docs, n, num, den)
    out = rows.join(ids, "digest", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest doc_id; documents without words stay.

    doc_id is taken as the key: rows that repeat the doc_id that stays, stay with it."""
    rows, ids = classes(docs, n, num, den)
    out = rows.join(ids, "digest", "left").where(F.col("n").eqNullSafe(0) | F.col("id").eqNullSafe(F.col("component_id")))
    boxed = docs.select(F.struct("*").alias("doc"), F.struct("doc_id").alias("key"))  # a null id is a key as well
    return boxed.join(out.select(F.struct(F.col("id").alias("doc_id")).alias("key")).distinct(), "key", "left_semi").select("doc.*")
