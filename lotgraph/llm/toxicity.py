"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 1).

Features are the distinct unigrams, bigrams and one-gap skip-grams of the lower-cased words, hashed to 2**bits
columns; all tasks make them.  Training rows are a bounded, hash-chosen sample of the labelled rows (``max_train`` in
expectation, so one task holds their features); FTRL-proximal makes ``epochs`` passes with per-coordinate rates and an L1 term that grows with the
root of the sample, which leaves a few hundred weights.  With more than one shard, each shard trains by itself and the
weights are averaged by feature.  Only the weights that are not zero are broadcast, as pairs (at most 2**bits), and
scoring is one pass without a shuffle over all rows and whole texts.

Defined cases: null and empty texts have no features and get the score of the bias alone; null labels are not used;
repeated rows count as often as they occur; of labels that contradict each other the toxic one holds; a score of exactly
0.5 is predicted 1; without any usable label every score is 0.5 less a hair, so nothing is rejected; a null doc_id is
scored and is never a training row; a text of any length has at most 2**bits features; an empty table gives an empty
result.  Extra columns play no part in the score and come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgraph.llm.scratch import stored

BITS = 18
MAX_TRAIN = 16_000  # expected size of the training sample, however many labels there are
SHARDS = 1
EPOCHS = 6
ALPHA, BETA, L2 = 2.0, 1.0, 0.0
L1_LEAST, L1_SHARE = 8.0, 1 / 9  # L1 = max(least, share * sqrt(rows))
TOXIC_WEIGHT = 3  # toxic rows are rare and count so many times

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHash(dict):
    """word → 64-bit hash, kept for as long as it is small."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(1)
def word_hashes() -> WordHash:
    return WordHash()


def _fold(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature columns of one whole text."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    out = [_fold(h, bits)]
    if len(h) > 1:
        out.append(_fold(h[:-1] * _PAIR + h[1:], bits))
    if len(h) > 2:
        out.append(_fold(h[:-2] * _SKIP + h[2:], bits))
    seen = np.concatenate(out)
    if len(seen) < 4096:
        return np.unique(seen)
    mark = np.zeros(1 << bits, bool)
    mark[seen] = True
    return np.flatnonzero(mark)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l2=L2) -> np.ndarray:
    """Weights of FTRL-proximal; the last one is the bias, which has no L1 term."""
    size = 1 << bits
    l1 = max(L1_LEAST, L1_SHARE * len(rows) ** 0.5)
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[size] = 0.0
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at = np.append(rows[k], size)
            za, na = z[at], n[at]
            root = np.sqrt(na)
            pull = np.abs(za) - penalty[at]
            w = np.where(pull > 0, -np.sign(za) * pull / ((beta + root) / alpha + l2), 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            z[at] = za + g - (np.sqrt(na + g * g) - root) / alpha * w
            n[at] = na + g * g
    pull = np.abs(z) - penalty
    return np.where(pull > 0, -np.sign(z) * pull / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN, shards: int = SHARDS) -> list[tuple[int, float]]:
    """Averaged sparse weights as (column, weight); column 2**bits is the bias.  Held-out rows take no part."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = known.count()
    if not count:
        return []
    share = min(1.0, max_train / count)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about max_train pairs of numbers: a proven bound for this broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("toxic").cast("double").alias("toxic"))), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [features(t.as_py(), bits).astype(np.int32) for t in part.column("text")]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), columns], names=["doc_id", "toxic", "columns"])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [row for pdf in frames for row in zip(pdf["doc_id"], pdf["toxic"], pdf["columns"], strict=True)]
        if found:
            # the same order however the rows arrive
            found = [x for x in sorted(found, key=lambda x: (x[0], x[1], len(x[2]), x[2][:64].tobytes())) for _ in range(TOXIC_WEIGHT if x[1] > 0.5 else 1)]
            w = ftrl([x[2] for x in found], np.array([x[1] for x in found]), bits)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"at": at, "w": w[at], "n": float(len(found))})

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(featured, "doc_id long, toxic double, columns array<int>")
    dealt = rows.repartition(1) if shards == 1 else rows.repartition(shards, F.xxhash64("doc_id", F.lit("shard")))
    parts = stored(dealt.mapInPandas(fit, "at long, w double, n double"), "weights")
    rows_of = parts.where(F.col("at") == 1 << bits).agg(F.sum("n").alias("total"))
    summed = parts.groupBy("at").agg(F.sum(F.col("w") * F.col("n")).alias("w")).crossJoin(F.broadcast(rows_of))  # one row
    got = summed.select("at", (F.col("w") / F.col("total")).alias("w")).collect()  # at most 2**bits + 1 pairs
    return [(r["at"], r["w"]) for r in got]


@lru_cache(2)
def _table(at: bytes, w: bytes, bits: int) -> np.ndarray:
    table = np.zeros((1 << bits) + 1)
    table[np.frombuffer(at, np.int32)] = np.frombuffer(w)
    return table


def score(docs: DataFrame, weights: list[tuple[int, float]], bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) with score double and predicted int."""
    pairs = sorted(weights) or [(1 << bits, -4e-6)]
    # the weights that are not zero; a task lays them out once
    sent = docs.sparkSession.sparkContext.broadcast((np.array([k for k, _ in pairs], np.int32).tobytes(), np.array([w for _, w in pairs]).tobytes()))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        w = _table(*sent.value, bits)
        margin = np.array([w[features(t, bits)].sum() + w[-1] for t in texts], np.float64)
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))))

    out = docs.withColumn("score", scored(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights = train(docs, labels)
    out = score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    weights = train(docs, labels)
    found = score(docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.text").alias("text")), weights)
    return found.where("predicted = 0").select("doc.*")
