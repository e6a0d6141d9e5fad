"""Periodic runs of words by power-of-two naming (operator 12).

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(LEAST, TIMES * q)`` that no
neighbouring word extends keeping period q.  Texts are taken in slices of about SLICE words, short and long ones apart, and
a slice is one array of word numbers in which the texts never match each other:

* Karp–Miller–Rosenberg naming.  Level j names the blocks of 2 ** j words: two blocks have one name if and only if they are
  equal, since a name is the rank of the pair of names of both halves.  Levels end where no name repeats within a text.
* Grid candidates.  A run of period q and at least 4 q words holds a grid point i, a multiple of q, whose next q words are
  followed by the same q words; two names of level floor(log2 q) say so, one for the first words and one for the last.
* Extension.  The run is extended from such a point by the longest common extensions of i and i + q to the right and to the
  left, by descending name levels, for all candidates of a slice at once.  No hashes are compared and no suffixes sorted.
* Candidates of one stretch are one run; the smallest period stays, as the others are its multiples.

Work is about n log n for a text of n words and the memory of a task is some arrays of a slice, or of the longest text, for
each level; candidates are taken in parts of PART.

Defined cases: a null or empty text has no words and no runs, its collapsed text is empty; texts shorter than LEAST words
have no runs; a text of any length is taken whole, in one task; repeated rows and null ids are rows like any other; of runs
with one exponent the one that starts first, then the one with the smaller period counts as the greatest; an empty table
gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4
SLICE = 1 << 16  # words
PART = 1 << 20  # candidates
BYTES = 1 << 22  # of texts that a task takes at once, or one text
RUNS = "array<struct<start:long,length:long,period:long>>"


def names(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, … words, as long as one repeats within a text; a block never crosses texts' ends.

    words: word numbers; text: the text of each.  Blocks that would cross an end get names of their own.
    """
    low = words.astype(np.int64) * (int(text[-1]) + 1) + text
    levels, j = [], 0
    while True:
        values, name = np.unique(low, return_inverse=True)
        levels.append(name.astype(np.int32))
        if len(values) == len(name) or len(name) <= 1 << j:
            return levels
        half, n = levels[-1].astype(np.int64), len(values)
        low = np.arange(len(name), dtype=np.int64) + n * n  # blocks across the end of all: no two alike
        same = text[: -(1 << j)] == text[1 << j :]
        low[: -(1 << j)] = np.where(same, half[: -(1 << j)] * n + half[1 << j :], low[: -(1 << j)])
        j += 1


def extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """How many words from a and b on, b behind a, are equal; left: how many before a and b."""
    n, done = len(levels[0]), np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        size = 1 << j
        while True:  # only the highest level can match more than once
            x, y = (a - done - size, b - done - size) if left else (a + done, b + done)
            inside = x >= 0 if left else y + size <= n
            match = np.zeros(len(a), bool)
            match[inside] = levels[j][x[inside]] == levels[j][y[inside]]
            done[match] += size
            if j < len(levels) - 1 or not match.any():
                break
    return done


def slice_runs(words: np.ndarray, text: np.ndarray, longest: int) -> np.ndarray:
    """Rows of start, end, period of all runs of a slice, by start, then period."""
    found = [np.empty((0, 3), np.int64)]
    if len(words) < LEAST:
        return found[0]
    levels, n = names(words, text), len(words)
    most = min(max(longest // TIMES, 1), (2 << (len(levels) - 1)) - 1)  # a longer period would need a name that repeats
    at, period, waiting = [], [], 0

    def settle() -> None:
        a, q = np.concatenate(at), np.concatenate(period)
        at.clear(), period.clear()
        start, end = a - extension(levels, a, a + q, True), a + q + extension(levels, a, a + q)
        long = end - start >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.column_stack([start, end, q])[long], axis=0))

    for q in range(1, most + 1):
        name = levels[q.bit_length() - 1]
        size = 1 << (q.bit_length() - 1)
        i = np.flatnonzero(name[0 : n - 2 * q + 1 : q] == name[q : n - q + 1 : q]) * q
        if size < q and len(i):
            i = i[name[i + q - size] == name[i + 2 * q - size]]
        if len(i):
            at.append(i)
            period.append(np.full(len(i), q, np.int64))
            waiting += len(i)
            if waiting > PART:
                settle()
                waiting = 0
    if at:
        settle()
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    first = np.r_[True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)][: len(runs)]
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    known: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    return words, [np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)) for ws in words]


def text_runs(numbers: list[np.ndarray]) -> list[np.ndarray]:
    """Start, end, period of the runs of each text, given as word numbers."""
    out = [np.empty((0, 3), np.int64)] * len(numbers)
    own = sorted((k for k in range(len(numbers)) if len(numbers[k]) >= LEAST), key=lambda k: len(numbers[k]))
    while own:
        take, total = [], 0
        while own and (not take or total + len(numbers[own[0]]) <= SLICE):
            take.append(own.pop(0))
            total += len(numbers[take[-1]])
        sizes = np.array([len(numbers[k]) for k in take])
        begin = np.cumsum(sizes) - sizes
        runs = slice_runs(np.concatenate([numbers[k] for k in take]), np.repeat(np.arange(len(take)), sizes), int(sizes[-1]))
        of = np.searchsorted(begin, runs[:, 0], side="right") - 1
        cuts = np.searchsorted(of, np.arange(len(take) + 1))
        for k, t in enumerate(take):
            if cuts[k] < cuts[k + 1]:
                out[t] = runs[cuts[k] : cuts[k + 1]] - np.array([begin[k], begin[k], 0])
    return out


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    return np.cumsum(step)[:n] == 0


def greatest(runs: np.ndarray) -> int:
    """The place of the run with the greatest exponent; the first on ties."""
    size = runs[:, 1] - runs[:, 0]
    near = np.flatnonzero(size / runs[:, 2] >= (size / runs[:, 2]).max() * (1 - 1e-9))
    return int(max(near, key=lambda k: (Fraction(int(size[k]), int(runs[k, 2])), -k)))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0), np.int64)) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), whole.num_rows]
        for k, end in zip(cuts, cuts[1:]):
            batch = whole.slice(k, end - k)
            words, numbers = _numbered([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")])
            runs = text_runs(numbers)
            lists = [[{"start": int(s), "length": int(e - s), "period": int(q)} for s, e, q in r] for r in runs]
            best = [x[greatest(r)] if len(r) else None for x, r in zip(lists, runs, strict=True)]
            short = [b" ".join(w if not len(r) else [w[i] for i in np.flatnonzero(kept(len(w), r))]).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)]
            run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            arrays = [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(lists, pa.list_(run)), pa.array(best, run), pa.array(short)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "greatest", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), greatest (by exponent, or null), collapsed.

    docs: doc_id, text.  collapsed: the text's words, joined by a space, less those that a run contains after its first
    period.
    """
    run = RUNS[6:-1]
    return docs.select("doc_id", "text").mapInArrow(_scanned, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, runs {RUNS}, greatest {run}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs whose texts have a periodic end where crc32 of the decimal doc_id ends in 0; the words before it stay."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(hashed / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        whole = F.sequence(F.lit(0), n - 1)
        return F.array_join(F.transform(whole, lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))), " ")

    chosen = F.coalesce((F.pmod(hashed, F.lit(10)) == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    once = F.get(F.transform(F.array(words), periodic), F.lit(0))  # the words are bound once, not made for every word
    return docs.withColumn("text", F.when(chosen, once).otherwise(F.col("text")))


def report(docs: DataFrame) -> DataFrame:
    """The digest of every text's runs, on texts with planted runs."""
    found = find_runs(with_planted_runs(docs.select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("greatest")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.expr("1000 * greatest.length div greatest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
