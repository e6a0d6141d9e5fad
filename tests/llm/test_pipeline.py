"""The pipeline's stages on odd tables: nulls, repeated rows, clashing columns, long texts, nothing at all."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EXTRA = "lang string, row int, label string, doc string, id int, digest string, leaks int, score double, keep_id int, h int, sequence_id string"
VALUES = ("en", 3, "l", "d", 8, "g", 4, 0.25, 5, 6, "s")


def tables(spark, sf, docs, labels=(), items=()):
    spark.createDataFrame([(i, t, *VALUES) for i, t in docs], f"doc_id long, text string, {EXTRA}").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")


def staged(spark, sf):
    """What each stage but the last keeps, and the pieces of the last."""
    left, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, left, sf)
        assert out.columns == left.columns
        out.write.parquet(f"{sf}/stage-{k}")
        left = spark.read.parquet(f"{sf}/stage-{k}")
        assert all(tuple(r)[2:] == VALUES for r in left.collect())
        kept.append(sorted((r.doc_id for r in left.collect()), key=str))
    return kept, corpus_pipeline.STAGES[-1][1](spark, left, sf).collect()


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    sf = str(tmp_path)
    long = " ".join(f"v{k}" for k in range(40_000))
    base = " ".join(f"w{k}" for k in range(60))
    docs = [(1, base), (1, base), (2, base.upper()), (3, None), (4, ""), (None, "without an id"), (5, "without an id"), (6, long), (7, long + " tail"), (8, "x y z")]
    tables(spark, sf, docs, labels=[(1, None), (None, 1), (99, 1)], items=[(None, "x y z"), (1, None)])
    kept, pieces = staged(spark, sf)
    everything = sorted((i for i, _ in docs), key=str)
    assert kept[0] == everything  # no usable label rejects nothing
    assert kept[1] == [1, 2, 3, 5, 6, 7, 8]
    assert kept[2] == [1, 3, 5, 6, 8]
    assert kept[3] == [1, 3, 5, 6]
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(tokens) == {1, 3, 5, 6} and tokens[3] == 1
    assert sum(r.length for r in pieces) == sum(tokens.values())


def test_nothing(spark, tmp_path):
    sf = str(tmp_path)
    tables(spark, sf, [])
    kept, pieces = staged(spark, sf)
    assert kept == [[]] * 4 and pieces == []
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    sf = str(tmp_path)
    tables(spark, sf, [(k, f"a{k} b{k}") for k in range(3000)])
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        corpus_pipeline.pack(spark, docs, sf)
        sizes = docs.select("doc_id").mapInPandas(lambda frames: (f.head(1).assign(n=len(f))[["n"]] for f in frames), "n long").collect()
        assert max(r.n for r in sizes) <= 1000 and sum(r.n for r in sizes) == 3000
    finally:
        spark.conf.set(name, before)


def test_workers_forget_other_operators():
    from lotgraph.llm import ngram_join, scratch, toxicity

    toxicity.features("some words here")
    ngram_join.shingles("some words here", 3)
    scratch.only("lotgraph.llm.ngram_join")
    assert toxicity.word_hashes.cache_info().currsize == 0 and ngram_join._hashes.cache_info().currsize == 1
