"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 2).

Texts and benchmark items become lower-cased words.  A passage of a document leaks an item if its word edit distance
to the item is at most ``share`` (0.2) of the item's words.  Search, in one pass over the documents without a shuffle:

1. Equal items are one.  Items of up to ``PIECE`` words are searched by item-sized windows; only longer ones are cut into
   equal pieces of at most so many words, as the walk below loses step in longer rows.  A passage within the bound is
   within it for one piece at least (pigeonhole principle).
   A hit is a run of q words that a piece has too; q (1 to 3) is so small that a piece within its bound has a hit.
   Each hit places a piece-sized window on its diagonal.
2. Each window is embedded by the CGK random walk of independent random functions, one per repetition: step j writes the
   word under the pointer and moves on or stays by a random bit of (j, word).  Edit distance becomes Hamming distance.
3. Bit sampling: ``samples`` places of each embedding, spread over the window's length, form a key; windows that share a
   key with a piece in any repetition are candidates.  Windows of up to ``CLASS`` words have ``reps``
   repetitions, and every ``CLASS`` words more add half as many, which holds recall above 0.9 at the bound (tests measure it per item length and kind of edit).
4. Candidates are verified by exact edit distance against the window, widened by the bound on either side: first the
   piece, then the whole item on the same diagonal.

The benchmark is read in blocks of at most about ``block_words`` words, however large it is; each block is one pass.  What
a pass finds is written before the next block is sent, so one block is held and broadcast at a time.

Defined cases: null or empty texts and items match nothing; a null item_id is reported as null; repeated documents each
report their leaks, repeated items are searched once and each are reported; of passages at the same distance the first is reported; texts of any
length are searched whole, their windows in slices; empty tables give an empty result; extra columns play no part and
come back as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgraph.llm.scratch import stored

SHARE = 0.2
REPS = 30  # for windows of up to CLASS words
SAMPLES = 3
PIECE = 64  # words: twelve edits at most
CLASS = 16  # words: windows of up to 16, 32, ... words are embedded together
SPAN = 1.5  # sampled places lie in so many lengths of the embedding; the walk has mostly ended after two
BLOCK_WORDS = 2_000_000
HITS = 2_000_000  # held at once, and so many pairs of a window and a piece
FOUND = "array<struct<item_id:long,start:int,words:int,distance:int>>"

_WORD = re.compile(r"[^\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) | 1
        return value


@lru_cache(1)
def _hashes() -> _Hashes:
    return _Hashes()


def words(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes().__getitem__, found), np.uint64, len(found))


def grams(h: np.ndarray, q: int) -> np.ndarray:
    out = h[: max(0, len(h) - q + 1)].copy()
    for k in range(1, q):
        out = (out ^ (out >> np.uint64(31))) * _M + h[k : len(h) - q + 1 + k]
    return out * _N


def embed(windows: np.ndarray, rep: int, steps: int) -> np.ndarray:
    """The first steps of the CGK embedding of rows of words that end in zeros, a row per step; zeros after a row's end."""
    count, length = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1).ravel()
    base = np.arange(count) * (length + 1)
    at = np.zeros(count, np.int64)
    mix = np.random.default_rng(rep).integers(0, 1 << 63, steps, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((steps, count), np.uint64)
    for j in range(steps):
        word = padded[base + at]
        out[j] = word
        at += (((word ^ (word >> np.uint64(29))) * mix[j]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, length, out=at)
    return out


def keys(windows: np.ndarray, sizes: np.ndarray, rep: int, samples: int = SAMPLES) -> np.ndarray:
    """Bit-sampling LSH keys of one repetition; sizes are the rows' lengths before their closing zeros."""
    shares = np.random.default_rng([rep, samples]).random(samples)
    places = np.floor(shares[:, None] * np.maximum(1, np.floor(SPAN * sizes))).astype(np.int64)
    rows = embed(windows, rep, int(places.max(initial=0)) + 1)
    key, every = (sizes + 1000 * rep).astype(np.uint64), np.arange(len(sizes))
    for at in places:
        key = (key ^ (key >> np.uint64(31))) * _M + rows[at, every]
    return key


def cuts(flat: np.ndarray, base: np.ndarray, ends: np.ndarray, start: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of width words of flat from base + start on; zeros beyond the row's size and outside its text (base to base + ends)."""
    at = start[:, None] + np.arange(width)
    inside = (at >= 0) & (at < ends[:, None]) & (np.arange(width) < sizes[:, None])
    return np.where(inside, flat[np.where(inside, at + base[:, None], 0)], np.uint64(0))


def distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item row to any run of words of its text row, and that run's last place."""
    count, width = texts.shape
    row = np.zeros((count, width + 1), np.int32)
    ramp = np.arange(width + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        new = np.minimum(row[:, :-1] + (texts != items[:, i : i + 1]), row[:, 1:] + 1)
        new = np.concatenate([row[:, :1] + 1, new], axis=1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min(axis=1), row.argmin(axis=1)


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places lo, lo + 1, ... of each row, n of them."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _slices(n: np.ndarray, most: int):
    """Runs of rows with at most so many places together, or of one row."""
    ends, cut = np.cumsum(n), 0
    while cut < len(n):
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + most, side="right")))
        yield slice(cut, stop)
        cut = stop


class Benchmark:
    """One block of items, its q-gram places and its LSH tables."""

    def __init__(self, items: list[tuple[int | None, str | None]], share: float = SHARE, reps: int = REPS, samples: int = SAMPLES):
        self.share, self.reps, self.samples = share, reps, samples
        same: dict[bytes, list] = {}
        for i, t in items:
            same.setdefault(words(t).tobytes(), []).append(i)
        same.pop(b"", None)
        self.ids = list(same.values())  # of each distinct item
        self.rows = [np.frombuffer(w, np.uint64) for w in same]
        self.lengths = np.array([len(w) for w in self.rows], np.int64)
        # distinct pieces, and of each the items and places that hold it
        held: dict[bytes, list[tuple[int, int]]] = {}
        for i, w in enumerate(self.rows):
            ends = np.linspace(0, len(w), -(-len(w) // PIECE) + 1).astype(np.int64).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                held.setdefault(w[a:b].tobytes(), []).append((i, a))
        self.pieces = [np.frombuffer(w, np.uint64) for w in held]
        self.sizes = np.array([len(w) for w in self.pieces], np.int64)
        self.holders = np.array([len(x) for x in held.values()], np.int64)
        self.item, self.first = np.array([x for v in held.values() for x in v], np.int64).reshape(-1, 2).T
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        q = np.clip(self.sizes // (self._bound(self.sizes) + 1), 1, 3)
        for k in sorted(set(q.tolist())):
            mine = np.flatnonzero(q == k)
            g = [grams(self.pieces[i], k) for i in mine]
            gram = np.concatenate(g)
            piece = np.repeat(mine, [len(x) for x in g])
            offset = np.concatenate([np.arange(len(x)) for x in g])
            order = np.argsort(gram, kind="stable")
            mark = np.zeros(1 << 22, bool)
            mark[(gram >> np.uint64(42)).astype(np.int64)] = True
            self.places[k] = (gram[order], piece[order], offset[order], mark)
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        flat, base = self._joined(self.pieces)
        for c in np.unique(-(-self.sizes // CLASS)).tolist():
            mine = np.flatnonzero(-(-self.sizes // CLASS) == c)
            rows_of = cuts(flat, base[mine], self.sizes[mine], np.zeros(len(mine), np.int64), self.sizes[mine], c * CLASS)
            for rep in range(self._repetitions(c)):
                key = keys(rows_of, self.sizes[mine], rep, samples)
                order = np.argsort(key, kind="stable")
                self.tables[c, rep] = (key[order], mine[order])

    def _bound(self, words):
        return np.floor(words * self.share + 1e-9).astype(np.int64)

    def _repetitions(self, c: int) -> int:
        return self.reps * (c + 1) // 2

    @staticmethod
    def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All rows behind each other, and where each begins."""
        return np.concatenate([*rows, np.zeros(1, np.uint64)]), np.cumsum([0, *map(len, rows)])[:-1].astype(np.int64)

    def windows(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the piece-sized windows on the diagonals of hits."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)]
        for q, (gram, piece, offset, mark) in self.places.items():
            g = grams(text, q)
            at = np.flatnonzero(mark[(g >> np.uint64(42)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(gram, g[at], "left"), np.searchsorted(gram, g[at], "right")
            for rows in _slices(hi - lo, HITS):  # a run that many items have gives many hits
                n = (hi - lo)[rows]
                slot = _spread(lo[rows], n)
                out.append(np.unique((np.repeat(at[rows], n) - offset[slot] + PIECE) * (PIECE + 1) + self.sizes[piece[slot]]))
        both = np.unique(np.concatenate(out))
        return both // (PIECE + 1) - PIECE, both % (PIECE + 1)

    def search(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        """Leaks of each text: (item_id, start, words, distance), the nearest and then first passage per item."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        found = [self.windows(text) for text in texts]
        own = np.repeat(np.arange(len(texts)), [len(starts) for starts, _ in found])
        if len(own):
            at, size = (np.concatenate(x) for x in zip(*found, strict=True))
            held = (*self._joined(texts), np.array([len(t) for t in texts], np.int64))
            for c in np.unique(-(-size // CLASS)).tolist():
                mine = np.flatnonzero(-(-size // CLASS) == c)
                for cut in range(0, len(mine), 4096):
                    asked = mine[cut : cut + 4096]
                    self._search(held, best, c, own[asked], at[asked], size[asked])
        out = [[(n, s, int(self.lengths[i]), d) for i, (d, s) in b.items() for n in self.ids[i]] for b in best]
        return [sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) for x in out]

    def _search(self, held, best, c: int, own: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        flat, base, ends = held
        rows = cuts(flat, base[own], ends[own], at, size, c * CLASS)
        pairs, count = [np.zeros(0, np.int64)], 0
        for rep in range(self._repetitions(c)):
            table, pieces = self.tables[c, rep]
            key = keys(rows, size, rep, self.samples)
            lo, hi = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
            for part in _slices(hi - lo, HITS):
                n = (hi - lo)[part]
                pairs.append(np.repeat(np.arange(part.start, part.start + len(n)), n) * len(self.pieces) + pieces[_spread(lo[part], n)])
                count += len(pairs[-1])
                if count > HITS:
                    pairs = [np.unique(np.concatenate(pairs))]
                    count = len(pairs[0])
                if count > HITS:  # different pairs: checked now, so that no more are held
                    self._verify(held, best, pairs.pop(), own, at)
                    pairs, count = [np.zeros(0, np.int64)], 0
        self._verify(held, best, np.unique(np.concatenate(pairs)), own, at)

    def _verify(self, held, best, pairs: np.ndarray, own: np.ndarray, at: np.ndarray) -> None:
        flat, base, ends = held
        r, p = pairs // len(self.pieces), pairs % len(self.pieces)

        def near(of: list[np.ndarray], rows: np.ndarray, lengths: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
            """Distance of each row's item or piece to its passage, a length at a time."""
            out = np.zeros(len(rows), np.int64)
            for length in np.unique(lengths[rows]).tolist():
                bound, mine = int(self._bound(length)), np.flatnonzero(lengths[rows] == length)
                width = length + 2 * bound
                step = max(1, 4_000_000 // width)
                for k in range(0, len(mine), step):
                    x = mine[k : k + step]
                    wide = cuts(flat, base[docs[x]], ends[docs[x]], starts[x] - bound, np.full(len(x), width), width)
                    out[x] = distances(np.stack([of[i] for i in rows[x]]), wide)[0]
            return out

        keep = near(self.pieces, p, self.sizes, own[r], at[r]) <= self._bound(self.sizes[p])
        r, p = r[keep], p[keep]
        slot = _spread((np.cumsum(self.holders) - self.holders)[p], self.holders[p])
        r = np.repeat(r, self.holders[p])
        # pieces of an item on one diagonal ask once
        k, i, start = np.unique(np.stack([own[r], self.item[slot], at[r] - self.first[slot]], axis=1), axis=0).T
        dist = near(self.rows, i, self.lengths, k, start)
        for x in np.flatnonzero(dist <= self._bound(self.lengths[i])).tolist():
            known, here = best[k[x]], (int(dist[x]), int(max(0, start[x])))
            known[int(i[x])] = min(known.get(int(i[x]), here), here)


@lru_cache(2)
def _benchmark(items: tuple, share: float, reps: int, samples: int) -> Benchmark:
    return Benchmark(list(items), share, reps, samples)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def block_count(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    """Blocks of about block_words words each."""
    return 1 + (_items(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0) // (6 * block_words)


def block(benchmark: DataFrame, k: int, count: int) -> list[tuple[int | None, str]]:
    """The items of one of count blocks; equal texts meet in one, but for copies beyond it."""
    rows = _items(benchmark).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(count)))
    return [(r[0], r[1]) for r in rows.where(F.col("part") == k).select("item_id", "text").collect()]


def leaks(text: Column, sent: Broadcast, share: float = SHARE, reps: int = REPS, samples: int = SAMPLES) -> Column:
    """Leaks of one broadcast block of items in each text."""

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.Series:
        block = _benchmark(sent.value, share, reps, samples)
        out: list = []
        for cut in range(0, len(texts), 2000):
            out += block.search([words(t) for t in texts.iloc[cut : cut + 2000]])
        return pd.Series([[dict(zip(("item_id", "start", "words", "distance"), x, strict=True)) for x in r] for r in out], index=texts.index, dtype=object)

    return search(text)


def _passes(docs: DataFrame, benchmark: DataFrame, block_words: int, one) -> Iterator[DataFrame]:
    """one(block) of every block.  All but the last are written before the next block is read, and their items let go."""
    spark, count = docs.sparkSession, block_count(benchmark, block_words)
    for k in range(count):
        sent = spark.sparkContext.broadcast(tuple(block(benchmark, k, count)))
        if k == count - 1:
            yield one(sent)
        else:
            done = stored(one(sent), "leaks")
            sent.destroy()
            yield done


def report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start (word), words, distance: a row per document and item that it leaks."""

    def one(sent: Broadcast) -> DataFrame:
        return docs.select("doc_id", F.explode(leaks(F.col("text"), sent)).alias("leak")).select("doc_id", "leak.*")

    return reduce(DataFrame.unionByName, _passes(docs, benchmark, block_words, one))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that leak no item."""
    out = docs.select(F.struct("*").alias("doc"))

    def one(sent: Broadcast) -> DataFrame:
        return out.withColumn("leaks", leaks(F.col("doc.text"), sent)).where(F.size("leaks") == 0).select("doc")

    for out in _passes(docs, benchmark, block_words, one):  # a pass reads what the one before kept
        pass
    return out.select("doc.*")
