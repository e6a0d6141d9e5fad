"""WARC archives written and read back, with segment reassembly (operator 5).

``write`` turns pages into WARC/1.1 records: HTTP responses in chunked transfer framing, and revisit records for
payloads that an earlier page has too.  Blocks longer than ``segment`` bytes are split into a first record and
continuation records.  Spark's text writer puts the records into gzipped files of at most ``per_file`` records in the
shared folder.  ``read`` inflates the files piece by piece, all members of each (archives usually have one per record),
parses them, groups continuation records by origin identifier, orders them by segment number, verifies the total length,
decodes the chunked framing and checks the payload digest.  Whatever does not hold is named in the column ``problem``:
damaged records and streams each give a row of their own, and parsing goes on at the next record.

Defined cases: a null payload is empty, and like all empty payloads shorter than ``least``; a null url becomes an own
urn; of equal payloads of at least ``least`` bytes the smallest page_id is the response (rows that repeat this page_id
are responses as well), a null page_id comes last; a payload that a large share of the pages has is settled by broadcast;
a payload of any length is cut into segments, of which one task holds those of one record; an empty table gives no files
and an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgraph.llm.scratch import new_path, stored
from lotgraph.llm.spread import HOT_KEYS

LEAST = 100
CHUNK = 4096
SEGMENT = 16_384
PER_FILE = 2000
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where it says")
        out.append(body[at : at + size])
        at += size + 2
    if not body.endswith(b"\r\n"):
        raise ValueError("no end of chunks")
    return b"".join(out)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record without its last line feed, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r" % (head.encode(), len(block), block)


def records(uid: str, url: str, payload: bytes, digest: str, first: str | None, segment: int = SEGMENT, date: str = EPOCH) -> list[bytes]:
    base = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = [("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{uid}>"), *base, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{first}>"), *kind], http)]
    block = http + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{uid}>"), *base, *kind]
    if len(block) <= segment:
        return [record(head, block)]
    out = [record([*head, ("WARC-Segment-Number", "1")], block[:segment])]
    count = -(-len(block) // segment)
    for k in range(1, count):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == count - 1 else []
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uid}:{k + 1}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Segment-Number", str(k + 1)), ("WARC-Segment-Origin-ID", f"<{uid}>"), *last]
        out.append(record(fields, block[k * segment : (k + 1) * segment]))
    return out


def _line(text: str) -> str:
    return "".join(c for c in text if c >= " ")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            uid = f"urn:page:{row['page_id']}:{row['seq']}"
            first = f"urn:page:{row['first']}" if row["first"] is not None else None
            out += records(uid, _line(row["url"]) if row["url"] else uid, row["payload"], row["digest"], first)
        for k in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(out[k : k + 1000], pa.binary())], names=["record"])


def write(pages: DataFrame, path: str, least: int = LEAST, per_file: int = PER_FILE) -> None:
    """Write one record (or one run of segments) per page to gzipped archives under path."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "seq": F.monotonically_increasing_id()})
    firsts = stored(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1"), "firsts")
    # payloads of more than a HOT_KEYS-th of the repeating pages, so fewer than HOT_KEYS, are settled where they are read
    limit = max(256, (firsts.agg(F.sum("k")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(firsts.where(F.col("k") > limit).select("digest", F.col("first").alias("hot"), F.lit(True).alias("is_hot")))
    marked = rows.join(hot, "digest", "left")
    # short payloads belong to no group: each has a key of its own, so that all empty pages do not meet in one task
    key = F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("short "), F.col("seq")))
    groups = firsts.where(F.col("k") <= limit).select(F.col("digest").alias("key"), "first")
    rest = marked.where("is_hot is null").withColumn("key", key).join(groups, "key", "left").drop("key")
    known = marked.where("is_hot").withColumn("first", F.col("hot")).unionByName(rest)
    known = known.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    out = known.select("page_id", "url", "payload", "digest", "seq", "first").mapInArrow(_written, "record binary")
    out.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


FIELDS = "id string, kind string, segment int, origin string, total long, refers string, digest string, block binary, problem string"
PIECE = 1 << 20


def inflated(data: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of an archive in bounded pieces: all members of a gzip file one after another, or the file as it is."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + piece] for k in range(0, len(data), piece))
        return
    at, held, member = 0, b"", zlib.decompressobj(31)
    while held or at < len(data):
        if not held:
            held, at = data[at : at + piece], at + piece
        if member.eof:
            held = held.lstrip(b"\0\r\n")  # padding between members
            if not held:
                continue
            member = zlib.decompressobj(31)
        yield member.decompress(held, 4 * piece)
        held = member.unused_data if member.eof else member.unconsumed_tail
    if not member.eof:
        raise zlib.error("gzip stream is cut off")


class _Stream:
    """What has been read and not yet parsed."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.failure = pieces, bytearray(), None

    def more(self) -> bool:
        try:
            self.held += next(self.pieces)
        except StopIteration:
            return False
        except zlib.error as e:
            self.failure = f"gzip stream is damaged: {e}"
            return False
        return True

    def has(self, size: int) -> bool:
        while len(self.held) < size:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes, start: int = 0) -> int:
        while True:
            at = self.held.find(mark, start)
            if at >= 0:
                return at
            start = max(start, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1


def parse(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of one archive; what is no record, or is cut off, has a problem."""
    stream = _Stream(pieces)
    bad = dict.fromkeys(["id", "kind", "segment", "origin", "total", "refers", "digest", "block"])
    while True:
        while stream.has(2) and stream.held[:2] == b"\r\n":
            del stream.held[:2]
        if not stream.has(2) and stream.held[:1] in (b"", b"\n", b"\r"):  # the end, or a file's last line feed
            break
        end = stream.find(b"\r\n\r\n") if stream.has(5) and stream.held[:5] == b"WARC/" else -1
        lines = stream.held[: max(0, end)].decode("utf-8", "replace").split("\r\n")
        head = {k.lower().strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        number = lambda name: int(head[name]) if head.get(name, "").isdecimal() else None  # noqa: B023, E731
        size = number("content-length")
        if size is None:
            yield bad | {"problem": "header is cut off" if end < 0 and stream.held[:5] == b"WARC/" else "no WARC record" if end < 0 else "no content length"}
            at = stream.find(b"\r\n\r\nWARC/", 1)
            if at < 0:
                break
            del stream.held[: at + 4]
            continue
        bare = lambda name: head[name].strip("<>") if name in head else None  # noqa: B023, E731
        row = {"id": bare("warc-record-id"), "kind": head.get("warc-type"), "segment": number("warc-segment-number"), "origin": bare("warc-segment-origin-id"), "total": number("warc-segment-total-length"), "refers": bare("warc-refers-to"), "digest": head.get("warc-payload-digest")}
        whole = stream.has(end + 4 + size)
        yield row | {"block": bytes(stream.held[end + 4 : end + 4 + size]), "problem": None if whole else "record is cut off"}
        del stream.held[: end + 4 + size]
    if stream.failure:
        yield bad | {"problem": stream.failure}


_ROW = pa.schema([("id", pa.string()), ("kind", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("refers", pa.string()), ("digest", pa.string()), ("block", pa.binary()), ("problem", pa.string())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("content"):
            held, size = [], 0
            for row in parse(inflated(file.as_buffer().to_pybytes())):
                held.append(row)
                size += len(row["block"] or b"")
                if len(held) == 500 or size > 8 * PIECE:
                    yield pa.RecordBatch.from_pylist(held, _ROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, _ROW)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            problem, payload = row["problem"], None
            parts = sorted(row["parts"], key=lambda p: p["segment"] or 1)
            block = b"".join(p["block"] or b"" for p in parts)
            stated = (row["digest"] or "").removeprefix("sha256:")
            if problem:
                pass
            elif [p["segment"] or 1 for p in parts] != list(range(1, len(parts) + 1)):
                problem = "segments are missing or repeated"
            elif len(parts) > 1 and row["total"] != len(block):
                problem = "total length differs"
            elif row["kind"] == "response":
                try:
                    head, gap, body = block.partition(b"\r\n\r\n")
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if stated and hashlib.sha256(payload).hexdigest() != stated:
                        problem = "payload digest differs"
                except ValueError as e:
                    problem = str(e)
            out.append({"id": row["id"], "kind": row["kind"], "refers": row["refers"], "digest": stated, "payload": payload, "problem": problem})
        yield pa.RecordBatch.from_pylist(out, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, refers, digest, payload, problem: a row per reassembled record."""
    # the records are stored, as both kinds of them are read below and an archive is inflated and parsed once
    rows = stored(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_parsed, FIELDS), "parsed")
    part = F.struct("segment", "block")
    alone = rows.where("segment is null").select("id", "kind", "refers", "digest", "total", F.array(part).alias("parts"), "problem")
    origin = F.coalesce("origin", "id")
    first = F.col("segment") == 1
    pick = lambda c: F.max(F.when(first, F.col(c))).alias(c)
    # a group is one record's segments
    joined = rows.where("segment is not null").groupBy(origin.alias("origin")).agg(pick("id"), pick("kind"), pick("refers"), pick("digest"), F.max("total").alias("total"), F.collect_list(part).alias("parts"), F.max("problem").alias("problem"))
    joined = joined.select(F.coalesce("id", "origin").alias("id"), "kind", "refers", "digest", "total", "parts", "problem")
    return alone.unionByName(joined).mapInArrow(_payloads, "id string, kind string, refers string, digest string, payload binary, problem string")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem, from archives written and read back."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write(pages, path, least)
    page = lambda c: F.split(F.col(c), ":")[2]
    found = read(spark, path).select(
        F.when(page("id") != "None", page("id").cast("long")).alias("page_id"),
        F.when(F.col("kind") == "response", F.octet_length("payload").cast("long")).alias("bytes"),
        F.when(F.col("kind") == "response", F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page("refers").cast("long").alias("refers_to"),
        "problem",
    )
    found = stored(found, "records")  # a row of numbers per record, so the archives are read once
    # a revisit's size is that of the response it refers to
    sizes = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("bytes").alias("theirs"))
    again = found.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    own = found.where("record_type != 'revisit' or record_type is null").withColumnRenamed("bytes", "payload_bytes").select(*columns)
    return own.unionByName(again.withColumnRenamed("theirs", "payload_bytes").select(*columns))


def report(pages: DataFrame) -> DataFrame:
    """The columns of round_trip(); problem is null for every record that came back whole."""
    return round_trip(pages)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest,
  CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
  CAST(NULL AS VARCHAR) AS problem
FROM f
"""
