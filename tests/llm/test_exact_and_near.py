"""Exact dedup, n-gram Jaccard join, line dedup against brute force; nulls, empties, ties, repeats, clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

from lotgraph.llm import exact_dedup, line_dedup, ngram_join
from lotgraph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, __n int, row string"
SF = "/root/testdata/sf0.001"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in pairs], SCHEMA)


ODD = [(5, None), (3, ""), (9, " \t\n"), (1, "a  b"), (2, "a\nb"), (2, "a\nb"), (None, "a b"), (7, "same"), (7, "same"), (8, "x" * 50_000), (6, "only one")]


def brute_exact(pairs):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(pairs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i or 0, k))
    out = []
    for text, rows in groups.items():
        first = min(rows)
        for null, i, k in rows:
            out.append((None if null else i, None if first[0] else first[1], len(rows), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_with_and_without_heavy_hitters(spark):
    pairs = ODD + [(100 + k, "hot  copy" if k % 2 else "hot copy") for k in range(60)]
    for k in (1, 1024):
        got = exact_dedup.duplicates(frame(spark, pairs), heavy_k=k, tracked=2048).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(pairs)
        groups = defaultdict(list)
        for r in got:
            groups[r.text_sha256].append(r.kept)
        assert all(sum(v) == 1 for v in groups.values())
        kept = exact_dedup.keep_first(frame(spark, pairs), heavy_k=k, tracked=2048)
        assert kept.columns == ["doc_id", "text", "lang", "__n", "row"]
        assert kept.count() == len(groups)
        assert kept.where("doc_id = 100").count() == 1


CLASH = "__n int, __row string, __id long, __digest string, first string, size int, place int, digest string, row string, id string, doc string, __keep int, key int"


def clashing(spark, pairs):
    """Documents with columns named like those that operators work with, and the values they must come back with."""
    values = (7, "x", 5, "d", "f", 3, 9, "g", "r", "i", "o", 2, 4)
    return spark.createDataFrame([(i, t, *values) for i, t in pairs], "doc_id long, text string, " + CLASH), values


def test_stages_leave_clashing_columns_as_they_were(spark):
    docs, values = clashing(spark, [(1, "a b"), (2, "a  b"), (3, None), (None, "c"), (4, "w " * 3000)])
    for out, ids in ((exact_dedup.keep_first(docs), {1, 3, None, 4}), (ngram_join.keep_one(docs), {1, 3, None, 4})):
        rows = out.collect()
        assert out.columns == docs.columns
        assert {r.doc_id for r in rows} == ids
        assert all(tuple(r)[2:] == values for r in rows)
    assert exact_dedup.duplicates(docs).count() == 5
    assert ngram_join.report(docs).count() == 5


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.keep_first(frame(spark, [])).count() == 0


def sets_of(pairs, n):
    out = []
    for i, t in pairs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        out.append((i, set() if not words else {tuple(words)} if len(words) < n else {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}))
    return out


def brute_components(pairs, n, num, den):
    rows = sets_of(pairs, n)
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(rows[a][1] & rows[b][1]), len(rows[a][1] | rows[b][1])
            if both and den * both >= num * either:
                label[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, s) in enumerate(rows):
        low[find(k)].append(i)
    return sorted(((i, len(s), min((x for x in low[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(rows)), key=str)


def near_copies(count, words, seed, changes):
    import numpy as np

    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 400, words)]
    out = []
    for k in range(count):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, changes + 1)):
            own[at] = f"z{rng.integers(0, 50)}"
        out.append((1000 * seed + k, " ".join(own).title() if k % 3 else "  ".join(own)))
    return out


def test_ngram_join_is_exact(spark):
    pairs = ODD + [(20, "one"), (21, "ONE"), (22, "one two"), (23, "two one")] + near_copies(60, 120, 1, 4) + near_copies(40, 30, 2, 2) + near_copies(30, 400, 3, 12)
    for n, num in ((3, 90), (5, 80)):
        got = ngram_join.report(frame(spark, pairs), n, num, 100).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(pairs, n, num, 100)


def test_ngram_join_keeps_one_and_clean_documents(spark):
    pairs = near_copies(20, 100, 4, 1) + [(1, "alone in here"), (2, ""), (3, None)]
    kept = ngram_join.keep_one(frame(spark, pairs))
    want = {c for _, n, c in brute_components(pairs, 5, 80, 100)} | {2, 3}
    assert {r.doc_id for r in kept.collect()} == want
    assert kept.columns == ["doc_id", "text", "lang", "__n", "row"]
    assert ngram_join.report(frame(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_lines(pairs):
    places, out = [], {}
    for i, t in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0)):
        kept = []
        for raw in (t or "").split("\n"):
            line = raw.strip(" \t\r\x0b\x0c")
            lost = line != "" and any(line == o or min(len(line), len(o)) >= 20 and abs(len(line) - len(o)) <= 1 and edit(line, o) <= 1 for o in places)
            if line:
                places.append(line)
            if not lost:
                kept.append(raw)
        out[i] = ((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_is_exact(spark):
    line = "the quick brown fox jumps over it"
    pairs = [(1, f"{line}\nshort\n\nother words that are long enough"), (2, f"{line[:5]}X{line[6:]}\nshort\nshorT\n"), (3, f"  {line[1:]} \r\n{line}s"), (4, f"{line[:-1]}\n{line[:-2]}"), (None, f"{line}\nnew line that nobody has yet"), (5, None), (6, ""), (7, "aaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaaa")]
    pairs += [(10 + k, f"{line[:8]}{chr(97 + k)}{line[9:]}\nhot line\n{line[:20]}{k}{line[20:]}") for k in range(20)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.clean_sha256) for r in line_dedup.report(frame(spark, pairs)).collect()}
    assert got == brute_lines(pairs)
    assert line_dedup.near.__defaults__[1] > 0
    again = line_dedup.dedup(frame(spark, pairs))
    assert [c for c in again.columns if not c.startswith("__") or c == "__n"] == ["doc_id", "text", "lang", "__n", "row"]


def test_line_dedup_of_long_lines_and_lengths_at_a_new_width(spark):
    rng = random.Random(3)
    pairs = []
    for k, n in enumerate([21, 63, 64, 65, 255, 256, 257, 258, 1023, 1024, 1025, 30_000]):
        line = "".join(rng.choice("abcdeé ") for _ in range(n - 2)).join("xx")
        at = rng.randrange(1, n - 1)
        pairs += [(10 * k, line), (10 * k + 1, line[:at] + line[at + 1 :]), (10 * k + 2, line[:at] + "Z" + line[at:]), (10 * k + 3, line[:at] + "Y" + line[at + 1 :]), (10 * k + 4, line[: at - 1] + "QQ" + line[at + 1 :])]
    got = {r.doc_id: r.n_removed for r in line_dedup.report(frame(spark, pairs)).collect()}
    assert got == {i: int(i % 10 in (1, 2, 3)) for i, _ in pairs}


def test_line_dedup_leaves_clashing_columns_as_they_were(spark):
    docs = spark.createDataFrame([(1, "a line that stands here twice", "h", 1, "r", 2), (2, "a line that stands here twice", "h", 1, "r", 2)], "doc_id long, text string, __hash string, __raw int, __clean string, id int")
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "___clean", "__lines", "__removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a line that stands here twice", "h", 1, "r", 2, "a line that stands here twice", 1, 0), (2, "a line that stands here twice", "h", 1, "r", 2, "", 1, 1)]


def test_line_dedup_of_repeats_and_nothing(spark):
    same = [(1, "a line that stands here twice\nx")] * 2
    assert {(r.n_removed) for r in line_dedup.report(frame(spark, same)).collect()} == {0}
    assert line_dedup.report(frame(spark, [])).count() == 0
