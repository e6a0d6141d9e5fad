"""Recall of decontamination at the bound alone, per item length and kind of edit."""

import numpy as np
import pytest

from lotgraph.llm import decontaminate

LENGTHS = [5, 10, 15, 16, 29, 40, 57, 64, 65, 100, 200]


def edited(words, n, kind, rng):
    out = list(words)
    for _ in range(n if kind == "in" else 0):
        out.insert(int(rng.integers(len(out) + 1)), f"n{rng.integers(10**6)}")
    at = set() if kind == "in" else set(rng.choice(len(out), n, replace=False).tolist())
    drop = {k for k in at if kind == "out" or kind == "mixed" and rng.integers(2)}
    return [f"n{rng.integers(10**6)}" if k in at else w for k, w in enumerate(out) if k not in drop]


@pytest.mark.parametrize("kind", ["swap", "in", "out", "mixed"])
def test_recall_at_the_bound(kind):
    rng = np.random.default_rng(7)
    items = [(k, " ".join(f"b{x}" for x in rng.integers(0, 10**5, n))) for k, n in enumerate(np.repeat(LENGTHS, 100).tolist())]
    texts = []
    for _, text in items:
        around = [f"w{x}" for x in rng.integers(0, 500, 80)]
        words = text.split()
        texts.append(decontaminate.words(" ".join([*around[:40], *edited(words, len(words) // 5, kind, rng), *around[40:]])))
    found = decontaminate.Benchmark(items).search(texts)
    recall = np.array([any(r[0] == k for r in f) for k, f in enumerate(found)]).reshape(len(LENGTHS), -1).mean(axis=1)
    assert dict(zip(LENGTHS, recall >= 0.9, strict=True)) == dict.fromkeys(LENGTHS, True), recall


def test_repeated_items_are_searched_once_and_all_reported():
    items = [(k, "one two three four five six seven eight nine ten") for k in range(3000)] + [(None, "One two, three four five six seven eight nine ten")]
    block = decontaminate.Benchmark(items)
    assert len(block.rows) == len(block.pieces) == 1
    found = block.search([decontaminate.words("zero one two three four five six seven eight nine ten eleven"), decontaminate.words("nothing here")])
    assert [r[0] for r in found[0]] == [*range(3000), None] and {r[1:] for r in found[0]} == {(1, 10, 0)}
    assert found[1] == []


def test_items_that_share_a_piece_are_told_apart():
    rng = np.random.default_rng(2)
    head = [f"h{x}" for x in range(64)]
    tails = [[f"t{x}" for x in rng.integers(0, 10**5, 64)] for _ in range(30)]
    block = decontaminate.Benchmark([(k, " ".join([*head, *t])) for k, t in enumerate(tails)])
    assert len(block.pieces) == 31
    found = block.search([decontaminate.words(" ".join(["x"] * 7 + head + tails[11])), decontaminate.words(" ".join(head))])
    assert [r[:4] for r in found[0]] == [(11, 7, 128, 0)] and found[1] == []


def test_more_pairs_than_may_be_held_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"b{x}" for x in rng.integers(0, 10**5, 20)]
    items = [(k, " ".join(edited(base, 1, "swap", rng))) for k in range(60)]
    texts = [decontaminate.words(" ".join(edited(base, 1, "mixed", rng))) for _ in range(40)]
    whole = decontaminate.Benchmark(items).search(texts)
    assert sum(map(len, whole)) > 2000
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert decontaminate.Benchmark(items).search(texts) == whole
