"""Token-id files: written in ascending doc_id order by the range coder and read back (operator 8).

Documents are range-partitioned and sorted by doc_id (and, where many rows repeat one, by a hash of the text and the
row's number, so no doc_id has to fit one task); each task encodes its texts with the tokenizers library, appends the end
id, and packs files of at most about ``file_ids`` ids (``idcoder.pack_file``: document table, id table and
independently reset, checksummed blocks).  Spark's text writer stores each file's bytes in the shared folder, one file per row; its
closing line feed lies behind the last block and is not read.  A manifest beside the folder names every file and its length, so a
file that is lost, cut or emptied is noticed.  Reading decodes each file in a task of its own, checks
every block, and adds the ids of all files before it, known from the files' heads, to each document's start.

Defined cases: null and empty texts have only the end id; null doc_ids come first; rows that repeat a doc_id lie next
to each other in the order of their texts' hashes; a document is never cut, so a file has at most ``file_ids`` ids more
than its last document; an empty table gives an empty result, and a task without documents an empty file; a file that is
missing, cut or damaged raises an error; extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgraph.llm.idcoder import pack_file, unpack_file
from lotgraph.llm.scratch import new_path, stored
from lotgraph.llm.tokens import encoder, tokenizer_path

FILE_IDS = 6_000_000
NO_ID = -(1 << 63)  # stands for a null doc_id in the document table


def _files(path: str, end_id: int, file_ids: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, part = encoder(path), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            data = pack_file(shard, part, np.array(names, np.int64), lengths, np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for batch in batches:
            texts, owners = batch.column("text"), batch.column("doc_id").to_pylist()
            for name, b in zip(owners, encode(texts), strict=True):
                ids.append(b + tail)
                names.append(NO_ID if name is None else name)
                held += len(b) // 4 + 1
                if held >= file_ids:
                    yield flush()
                    part, held, ids, names = part + 1, 0, [], []
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all documents to files under path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_files(tokenizer or tokenizer_path(), end_id, file_ids), "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    _listed(docs.sparkSession, path).write.mode("overwrite").parquet(f"{path}-manifest")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """file, length of the files under path; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def _check(spark: SparkSession, path: str) -> None:
    """Raise if a file that the manifest names is gone, has another length, or is not named there."""
    stated = spark.read.parquet(f"{path}-manifest").withColumnRenamed("length", "stated")
    wrong = stated.join(_listed(spark, path), "file", "full").where("not (length <=> stated)").orderBy("file").limit(3).collect()
    if wrong:
        raise ValueError("files differ from the manifest: " + ", ".join(f"{r.file} has {r.length} of {r.stated} bytes" for r in wrong))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("content"):
            data = file.as_buffer().to_pybytes()
            if not data:
                continue  # a task without documents
            shard, part, names, lengths, ids = unpack_file(data)
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            n = len(names)
            columns = [pa.array(np.full(n, shard, np.int64)), pa.array(np.full(n, part, np.int64)), pa.array(names, mask=names == NO_ID), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under path."""
    _check(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = stored(files.mapInArrow(_documents, "shard long, part long, doc_id long, start long, n_tokens long, ids_crc32 long"), "ids")
    # ids of the files before: by shard, then of the shards before, of which there are as many as tasks wrote files
    files = found.groupBy("shard", "part").agg(F.sum("n_tokens").alias("size"))
    shards = files.groupBy("shard").agg(F.sum("size").alias("size"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shards = shards.select("shard", (F.sum("size").over(up_to(Window.orderBy("shard"))) - F.col("size")).alias("base"))
    files = files.withColumn("before", F.sum("size").over(up_to(Window.partitionBy("shard").orderBy("part"))) - F.col("size"))
    before = files.join(shards, "shard").select("shard", "part", (F.col("base") + F.col("before")).alias("before"))
    return found.join(before, ["shard", "part"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def report(docs: DataFrame) -> DataFrame:
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "idfiles")
    write(docs, path)
    return read(spark, path)
