"""The n-gram join's helpers, and how many jobs a group of near copies takes."""

from test_exact_and_near import brute_components, frame, near_copies

from lotgraph.llm import ngram_join
from lotgraph.llm.spread import components

EDGES = [(k, k + 1) for k in range(40)] + [(101, 100), (103, 102), (102, 104), (105, 104), (100, 105), (7, 7), (300, 200), (200, 300)]
MOST_JOBS = 290  # 345 before joins with few rows took them to all tasks
HOT = near_copies(300, 40, 5, 1) + near_copies(12, 60, 6, 2)  # columns of more than 256 rows


def test_components_hook_onto_the_least(spark):
    edges = spark.createDataFrame(EDGES, "a long, b long")
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 106)} | {200: 200, 300: 200}
    assert {r.node: r.label for r in components(edges).collect()} == want


def test_hot_columns_and_jobs(spark):
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("join-passes", "")
    got = ngram_join.report(frame(spark, HOT), 3, 90, 100).collect()
    jobs = len(tracker.getJobIdsForGroup("join-passes"))
    sc.setJobGroup("other", "")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(HOT, 3, 90, 100)
    print("jobs", jobs)
    assert jobs <= MOST_JOBS


def test_rows_of_hot_columns_send_the_pieces_they_need(spark, monkeypatch):
    made, keep = {}, ngram_join.stored

    def stored(df, name, parts=None):
        made[name] = keep(df, name, parts)
        return made[name]

    monkeypatch.setattr(ngram_join, "stored", stored)
    docs = near_copies(400, 120, 5, 3)
    got = ngram_join.report(frame(spark, docs), 3, 90, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(docs, 3, 90, 100)
    needy = {r.row for r in made["needy"].collect()}
    assert len(needy) > 100
    whole = made["features"].where("n > 0").select("row", "n", "first").collect()
    assert 0 < made["rest"].count() < 0.5 * sum(r.n - r.first for r in whole if r.row in needy)


def test_pieces_fill_the_prefix_and_no_more(spark):
    sets = [(1, 2, 5), (2, 0, 3), (3, 4, 100), (4, 20, 1)]  # row, first, need
    rows = [(row, 20, first, need, [(k << 60) + row - (1 << 64) * (k >= 8) if k < 16 else -row - 100 + k for k in [*range(12), 12, 13, 14, 15, 16, 17, 18, 19]]) for row, first, need in sets]
    got = ngram_join.pieces(spark.createDataFrame(rows, "row long, n int, first int, need int, set array<long>")).collect()
    cells = {row: sorted((r.end for r in got if r.row == row)) for row, *_ in sets}
    assert cells[1] == [3, 4, 5, 6, 7] and cells[2] == [1, 2, 3] and cells[3] == [*range(5, 16), *[20] * 5] and cells[4] == []


def test_busy_columns_are_counted_apart(spark):
    rows = [(row, h) for row in range(3000) for h in {7, 1000 + row, 10_000 + row // 2}]
    got = ngram_join.counted(spark.createDataFrame(rows, "row long, h long"), len(rows), "cells").collect()
    assert sorted((r.h, r.df) for r in got) == sorted([(7, 3000)] * 3000 + [(10_000 + row // 2, 2) for row in range(3000)])
