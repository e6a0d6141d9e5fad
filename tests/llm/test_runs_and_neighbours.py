"""Hard negatives, periodic runs and odd-sketch near-dedup against brute force; nulls, empties, ties, repeats, clashes."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lotgraph.llm import hard_negatives, odd_sketches, queries, runs
from lotgraph.llm.ngram_join import shingles

# hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """rows: id, label, vector (integers)."""
    rows, out = [r for k, r in enumerate(rows) if r not in rows[:k]], set()
    score = lambda v, w: sum(a * b for a, b in zip(v, w, strict=False))
    for i, label, v in rows:
        if i not in anchors:
            continue
        near = sorted({(-score(v, w), j) for j, other, w in rows if other == label and j != i})[:positives]
        for s, j in near:
            s = -s
            hits = sorted({(-score(v, w), k) for k, other, w in rows if other != label and 100 * low * s <= 10_000 * score(v, w) <= 100 * high * s})[:negatives]
            out |= {(i, j, r + 1, k, s, -t) for r, (t, k) in enumerate(hits)}
    return sorted(out)


def mined(spark, rows, anchors, **how):
    df = spark.createDataFrame(rows, "id long, label long, v array<long>")
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id").isin(list(anchors)), **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_equal_brute_force_over_many_leaves_blocks_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 40
    rows = [(k, int(rng.integers(3)), [int(x) for x in np.floor(centres[k % 6] + rng.normal(size=8) * 25)]) for k in range(600)]
    rows += [(1000 + k, k % 2, [50, 0, 0, 0, 0, 0, 0, 1]) for k in range(120)]  # a vector that many rows share
    for name, value in {"LEAF_ROWS": 60, "BLOCK": 30, "BUCKET": 5, "CHUNK": 7}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    anchors = {*range(0, 600, 50), 1000, 1001, 1119}
    assert mined(spark, rows, anchors) == brute_negatives(rows, anchors)
    assert mined(spark, rows, anchors, positives=2, negatives=3, low=50, high=95) == brute_negatives(rows, anchors, 2, 3, 50, 95)


def test_negatives_of_ties_repeats_short_vectors_and_negative_scores(spark):
    rows = [(1, 0, [4, 0]), (2, 0, [4, 0]), (2, 0, [4, 0]), (3, 0, [-4, 0]), (4, 1, [2]), (5, 1, [2, 0]), (6, 1, [2, 9]), (7, 2, []), (8, 0, [0, 0]), (9, 1, [3, 3])]
    padded = [(i, c, v + [0] * (2 - len(v))) for i, c, v in rows]
    assert mined(spark, rows, set(range(10))) == brute_negatives(padded, set(range(10)))
    assert mined(spark, rows[:1], {1}) == []
    assert mined(spark, [], {1}) == []
    assert mined(spark, [(1, 0, [1 << 40]), *padded[1:]], set(range(10))) == brute_negatives(padded[1:], set(range(10)))


def test_negatives_leave_out_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(0, [1.0, inf], 1), (100, [nan, 1.0], 1), (200, None, 1), (300, [1.0, None], 2), (None, [1.0, 1.0], 1), (400, [1.0, 1.0], None)]
    good = [(500, [0.5, 0.25], 1), (501, [0.5, 0.5], 1), (502, [0.2, 0.2], 2), (503, [0.3, 0.1], 3), (504, [0.1, 0.1], 1)]
    df = spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in odd + good], "vec_id long, embedding array<float>, label int, id string, q int")
    whole = [(i, (c + 1) % 10 if i % 7 == 0 else c, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, c in good]
    got = sorted(tuple(r) for r in hard_negatives.report(df).collect())
    assert got == brute_negatives(whole, {500})
    assert got


def test_negatives_equal_sql(spark, oracle):
    assert oracle(spark, queries.QUERIES["op11_hard_negatives"], queries.ORACLES["op11_hard_negatives"])


# periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and all(any(words[k] != words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_equal_brute_force_in_slices_of_any_size(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        texts = [periodic(rng, rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
        monkeypatch.setattr(runs, "SLICE", rng.choice([1, 50, 300, 1 << 16]))
        monkeypatch.setattr(runs, "PART", rng.choice([1, 5, 1 << 20]))
        got = runs.text_runs([np.array(t, np.int64) for t in texts])
        assert [[tuple(map(int, r)) for r in g] for g in got] == [brute_runs(t) for t in texts]


def brute_report(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    found = brute_runs(w)
    out = {k for s, e, q in found for k in range(s + q, e)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if found else None
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (i, len(found), *first, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in out)))


def test_run_report_of_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "a  b\ta b\na b a b", "x " * 5000, "é é é é é é é", "one"]
    texts += [" ".join(map(str, periodic(rng, rng.randrange(120), 4))) for _ in range(150)]
    pairs = [(k, t) for k, t in enumerate(texts)] + [(None, "b b b b b b b"), (None, None), (3, "a a a a a")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in pairs], "doc_id long, text string, runs string, greatest int, n_words int")
    assert sorted(map(tuple, runs.report(docs).collect()), key=str) == sorted((brute_report(i, t) for i, t in pairs), key=str)
    assert runs.report(docs.limit(0)).count() == 0
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in pairs if t and i is not None) > 5


def test_run_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert [got[r.doc_id] for r in docs] == [brute_report(r.doc_id, r.text) for r in docs]


# odd sketches


def brute_components(pairs, n, num):
    sets = [(i, frozenset(shingles(t, n).tolist())) for i, t in pairs]
    own = list(range(len(sets)))

    def find(a):
        while own[a] != a:
            a = own[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                own[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), (True, 0)), (i is None, i or 0))
    out = []
    for k, (i, s) in enumerate(sets):
        null, c = least[find(k)]
        out.append((i, len(s), i if not s else None if null else c))
    return sorted(out, key=str)


def edited(rng, words, share):
    return [w if rng.random() > share else rng.randrange(100_000) for w in words]


def near_copies(rng):
    pairs, at = [], 0
    for size, copies, share in ((30, 6, 0.02), (200, 60, 0.03), (700, 12, 0.02), (1100, 12, 0.02), (3000, 6, 0.03), (120, 40, 0.06)):
        base = [rng.randrange(50_000) for _ in range(size)]
        for _ in range(copies):
            pairs.append((at, " ".join(map(str, edited(rng, base, rng.random() * share)))))
            at += 1
    passage = " ".join(str(rng.randrange(9)) for _ in range(40))
    pairs += [(at + k, f"{passage} " + " ".join(str(rng.randrange(9_000)) for _ in range(60))) for k in range(30)]
    return pairs


ODD = [(None, None), (900, ""), (901, " \n"), (902, "A b"), (903, "a  B"), (903, "a  B"), (None, "a b"), (904, "one"), (905, "w " * 40_000), (906, "W " * 30_000)]


@pytest.mark.parametrize("refine", [4096, 8])
def test_near_dedup_equals_brute_force(spark, monkeypatch, refine):
    monkeypatch.setattr(odd_sketches, "REFINE", refine)
    monkeypatch.setattr(odd_sketches, "TILE", 7)
    pairs = near_copies(random.Random(refine)) + ODD
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in pairs], "doc_id long, text string, row string, n int, label int, h int")
    got = odd_sketches.report(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(pairs, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert odd_sketches.report(docs.limit(0)).count() == 0


def test_rows_of_a_large_key_meet_without_a_second_one(spark, monkeypatch):
    monkeypatch.setattr(odd_sketches, "REFINE", 2)
    monkeypatch.setattr(odd_sketches, "TILE", 1)
    rows = [(k, k, 40, bytes([k]), [0] * 4, [7, 100 + k], 0, [0] * odd_sketches.WORDS, None) for k in range(20)]
    found = spark.createDataFrame(rows, odd_sketches.FOUND)
    cells = spark.createDataFrame([(7, k, 0 if k < 15 else k // 17) for k in range(20)], "h long, row long, label long")
    got = odd_sketches.open_pairs(odd_sketches._Join(None, found, 3, 85, 100), cells).collect()
    label = [0 if k < 15 else k // 17 for k in range(20)]
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(20) for b in range(a + 1, 20) if label[a] != label[b]]


def test_sketches_never_reject_linked_sets():
    """At level 0 for certain, above it by the margin; and tell sets apart that are well below the threshold."""
    rng = np.random.default_rng(2)
    wrong = far = 0
    for n in (20, 150, 500, 900, 2000, 9000):
        for share in (0.075, 0.2):
            for _ in range(60):
                x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
                y = x.copy()
                k = int(n * share)
                y[:k] = rng.integers(0, 1 << 64, k, dtype=np.uint64)
                level = odd_sketches.level_of(n)
                pop = int(np.bitwise_count((odd_sketches.odd_sketch(x, level) ^ odd_sketches.odd_sketch(y, level)).view(np.uint64)).sum())
                mean = 2 * n * 15 / 185 / 2**level
                most = mean + (odd_sketches.MARGIN * mean**0.5 + odd_sketches.MARGIN if level else 0)
                wrong += share < 0.1 and pop > most
                far += share > 0.1 and pop <= most
    assert wrong == 0
    assert far < 40
    assert odd_sketches.odd_sketch(np.empty(0, np.uint64), 0).sum() == 0
