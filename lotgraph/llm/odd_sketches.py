"""MinHash near-dedup verified by odd sketches (operator 13).

Documents with one set of word shingles fall into one class first.  The rest:

* Bands.  BANDS x ROWS MinHash values of a set make BANDS keys; two sets of similarity s share a key with probability
  ``1 - (1 - s ** ROWS) ** BANDS``, which at 0.85 misses fewer than one pair in a million.
* Odd sketches.  The values of one more min-wise hash that lie below ``2 ** -level``, the level by the size of the set so
  that at most SAMPLES are expected, are the set's samples.  They are folded into BITS parity bits.  The population count of
  the XOR of two sketches is at most the number of samples that the sets don't share, and close to it for similar sets.
  At level 0 the samples are the whole set, so the bound on the difference of linked sets is exact; above it the bound has
  MARGIN standard deviations more.  A set near the end of its level has the next level's sketch as well.
* A group of near copies is not expanded into its pairs.  In each of up to STARS rounds every key names one pivot, and a
  row takes the pivot that most of its keys name: a pair a row, checked by the sketches, then on the full sets.  Linked
  rows become components.
* What is open are keys that rows of several components still share.  There the rows outside the key's largest component
  meet all its rows, in tiles, and a pair comes out only if it belongs to different components, its sizes and sketches
  leave a link possible and no earlier key is shared.  These pairs are checked on the full sets.  No key is too large for
  that; tiles of large keys are wider, so that a row is repeated less often.

A link of different texts is so lost only where no key is shared, or a sketch above level 0 is off by more than MARGIN
standard deviations.  In the worst case, many rows barely too different in one key, the tiles compare all of them, bit by
bit and without forming rows.

Defined cases: null or empty texts, or texts without words, have an empty set and are linked with nothing; a text with
fewer words than n has its whole word sequence as its only shingle; null doc_ids sort last; repeated rows belong to one
class; ties of pivots go by row number and do not change components; a text of any length is one row; an empty table
gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.llm.ngram_join import BUCKETS, _Join, _sized, _slices, shingles
from lotgraph.llm.scratch import stored
from lotgraph.llm.spread import HOT_KEYS, components, hot_keys, spread_join

BANDS, ROWS = 24, 5
BITS, SAMPLES, MARGIN = 1024, 512, 5
STARS, TILE, REFINE, WIDE = 2, 256, 4096, 8  # tiles of keys of more than REFINE rows are WIDE times as wide
WORDS = BITS // 64
_RNG = np.random.default_rng(13)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOUND = "id long, row long, n int, digest binary, counts array<int>, bands array<long>, level int, sketch array<long>, coarser array<long>"


def min_hashes(values: np.ndarray) -> np.ndarray:
    """The least value of the set under each multiplication."""
    out = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max)
    for k in range(0, len(values), 1024):
        np.minimum(out, (values[k : k + 1024, None] * _MULTIPLY[None]).min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = min_hashes(values).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
    for r in range(ROWS):
        key = (key ^ (rows[:, r] >> np.uint64(31)) ^ rows[:, r]) * _MIX[1]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def level_of(n: int) -> int:
    return max(0, math.ceil(math.log2(n / SAMPLES))) if n else 0


def odd_sketch(values: np.ndarray, level: int) -> np.ndarray:
    """BITS parity bits of the samples of a set at a level."""
    hashed = values * _MIX[2]
    hashed ^= hashed >> np.uint64(32)
    samples = values[(hashed * _MIX[0]) >> np.uint64(64 - level) == 0] if level else values
    place = ((samples * _MIX[1]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _features(n: int, num: int, den: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t.as_py(), n) for t in batch.column("text")]
            levels = [level_of(len(s)) for s in sets]
            # a partner of the next level has more than SAMPLES << level values
            coarser = [odd_sketch(s, k + 1).tolist() if len(s) * den >= (SAMPLES << k) * num else None for s, k in zip(sets, levels, strict=True)]
            counts = np.stack([np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) for s in sets]).astype(np.int32)
            bands = [band_keys(s).tolist() if len(s) else [] for s in sets]
            sketches = [odd_sketch(s, k).tolist() for s, k in zip(sets, levels, strict=True)]
            long = pa.list_(pa.int64())
            arrays = [batch.column("id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(list(counts), pa.list_(pa.int32())), pa.array(bands, long), pa.array(levels, pa.int32()), pa.array(sketches, long), pa.array(coarser, long)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _possible(x: str, y: str, num: int, den: int) -> Column:
    """Sizes and sketches of two rows under one level leave a similarity of num / den possible."""
    n, level = [F.col(f"{r}.n") for r in (x, y)], F.col(f"{x}.under")
    most = (n[0] + n[1]).cast("double") * ((den - num) / (den + num))
    mean = most / F.pow(F.lit(2.0), level)
    apart = sum((F.bit_count(F.col(f"{x}.u{k}").bitwiseXOR(F.col(f"{y}.u{k}"))) for k in range(WORDS)), F.lit(0))
    return (F.col(f"{x}.own") | F.col(f"{y}.own")) & _sized(*n, num, den) & (apart <= F.when(level == 0, most + 1e-6).otherwise(mean + MARGIN * F.sqrt(mean) + MARGIN))


def _sketched(found: DataFrame, *more: str) -> DataFrame:
    """row, n, under (a level), own (it is the row's own), u0 … of the sketch; a row is there under one level or two.

    Two rows meet under the higher one of their levels, so at least one of them is there under its own.
    """
    own = F.struct(F.col("level").alias("under"), F.lit(True).alias("own"), F.col("sketch").alias("bits"))
    next_one = F.struct((F.col("level") + 1).alias("under"), F.lit(False).alias("own"), F.col("coarser").alias("bits"))
    rows = found.select("row", "n", *more, F.explode(F.when(F.col("coarser").isNull(), F.array(own)).otherwise(F.array(own, next_one))).alias("s"))
    return rows.select("row", "n", *more, "s.under", "s.own", *[F.col("s.bits")[k].alias(f"u{k}") for k in range(WORDS)])


def starred(join: _Join, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible; many rows may have one pivot b."""
    own = _sketched(join.found)
    one = lambda name, row: own.select(F.col("row").alias(row), "under", F.struct(*own.columns).alias(name))
    first = stored(pairs.join(one("x", "a"), "a").withColumn("pivot", F.xxhash64("b", "under")).drop("under"), "sketched")
    second = one("y", "b").select(F.xxhash64("b", "under").alias("pivot"), "y")
    return spread_join(first, second, "pivot", hot=hot_keys(first, "pivot")).where("b = y.row").where(_possible("x", "y", join.num, join.den)).select("a", "b")


def open_pairs(join: _Join, cells: DataFrame) -> DataFrame:
    """a, b: rows of different components that share a key and whose sizes and sketches leave a link possible.

    cells: h, row, label of keys with several components.  A key's largest component is not compared with itself: the
    rows of its other components, in tiles, meet all its rows, in tiles.
    """
    parts = cells.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("h")
    sizes = stored(parts.agg(F.sum("k").alias("rows"), F.max(F.struct("k", "label")).alias("main")).select("h", "rows", F.col("main.k").alias("most"), F.col("main.label").alias("main")), "open_keys")
    known = stored(spread_join(cells, sizes, "h"), "open_cells")
    side = F.when(F.col("rows") > REFINE, WIDE * TILE).otherwise(TILE)
    tiles = {"few": F.ceil((F.col("rows") - F.col("most")) / side).cast("int"), "every": F.ceil(F.col("rows") / side).cast("int")}
    dealt = stored(known.withColumns(tiles).drop("rows", "most").join(_sketched(join.found, "bands"), "row"), "tiles")
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = dealt.where("label != main").withColumn("i", own("few")).withColumn("j", each("every")).alias("x")
    y = dealt.withColumn("j", own("every")).withColumn("i", each("few")).alias("y")
    col = F.col
    # of two rows outside the largest component each is on both sides
    once = (col("y.label") == col("y.main")) | (col("x.row") < col("y.row"))
    first = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == col("x.h")
    met = x.join(y, (col("x.h") == col("y.h")) & (col("x.i") == col("y.i")) & (col("x.j") == col("y.j")) & (col("x.under") == col("y.under")) & (col("x.label") != col("y.label")) & once & _possible("x", "y", join.num, join.den) & first)
    return met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def shared_keys(found: DataFrame, reps: DataFrame) -> DataFrame:
    """h, row, n, at, short, rank of keys with several rows; rows whose keys many others share come first as pivots."""
    each = found.join(reps.select("row"), "row", "left_semi").select("row", "n", F.explode("bands").alias("h"))
    often = stored(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "keys")
    limit = max(256, (often.agg(F.sum("df")).first()[0] or 0) // HOT_KEYS)
    shared = spread_join(each, often, "h", hot=stored(often.where(F.col("df") > limit).select("h"), "hot"))
    rank = (-F.sum("df").over(Window.partitionBy("row"))).cast("double")
    return stored(shared.select("h", "row", "n", F.lit(0).alias("at"), F.lit(True).alias("short"), rank.alias("rank")), "cells")


def classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): rows has id, row, n, digest per document; ids has digest, component_id per class of equal sets."""
    source = docs.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    found = stored(source.mapInArrow(_features(n, num, den), FOUND), "features")
    base = found.select("id", "row", "n", "digest")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("m")
    reps = stored(base.where("n > 0").groupBy("digest").agg(least).select("digest", F.col("m.id").alias("id"), F.col("m.row").alias("row")), "classes")
    join, links, labels = _Join(docs, found, n, num, den), None, None
    cells = shared_keys(found, reps)

    def linked(pairs: DataFrame) -> bool:
        nonlocal links, labels
        got = join.overlaps(pairs).where("linked").select("a", "b")
        if got.isEmpty():
            return False
        links = got if links is None else links.unionByName(got)
        labels = components(links)
        return True

    for turn in range(STARS):
        if not linked(starred(join, stored(join.stars(cells, labels, turn), "stars"))):
            break
    marked = stored(join.labelled(cells, labels), "labelled")
    mixed = stored(join.mixed(marked), "mixed")
    if mixed.limit(1).count():
        linked(open_pairs(join, stored(spread_join(marked, mixed, "h").select("h", "row", "label"), "open")))
    own = stored(join.labelled(reps, labels), "members")
    ids = own.groupBy("label").agg(F.min("id").alias("component_id"))
    return base, stored(spread_join(own, ids, "label").select("digest", "component_id"), "components")


def report(docs: DataFrame, n: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document."""
    rows, ids = classes(docs, n, num, den)
    out = rows.join(ids, "digest", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
