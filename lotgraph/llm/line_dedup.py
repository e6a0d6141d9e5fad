"""Line dedup by a deletion-neighbourhood join (operator 6, DataFrame and SQL functions only).

Lines are what stands between line feeds, compared without spaces, tabs and carriage returns at either end.  A line
goes if the same line, or one within one edit (a character put in, left out or replaced), stands earlier in the order
of (doc_id, place in the text); blank lines stay, and lines under ``least`` characters are compared exactly.

1. Equal lines form one class with its earliest place (two 64-bit hashes, combined before the shuffle).
2. A line within one edit of another shares the first or the last half with it.  Only lines that do so go on, so the
   neighbourhoods of ordinary prose are never formed; nothing is lost by it.
3. Such a line emits itself and its variants with one character left out, as hashed keys; lines of equal keys meet.
   With the same place left out one character is replaced, and a variant that is a whole line has one more; of each the
   earliest place is passed on, so rows grow with the lines and not with their pairs.  A line is cut into pieces of about
   the root of its length; a key is the hash of what stands before the piece, the piece's variant, and the hash of what
   stands behind it, so all keys of a line of n characters take about n ** 1.5 steps, and a long line costs no square.
4. The pairs are verified by edit distance, and each line takes the earliest place it found.

The lines that meet under one key are equal but for one character at one place, so a key has no more lines than there
are characters; equal lines are one class before.

Defined cases: null and empty texts have one blank line, which stays; null doc_ids come last; rows that repeat a doc_id
and its text are taken as one and lose the same lines; of equal places none goes before another; lines of any length
take part whole, and one text's lost lines are one list; an empty table gives an empty result; extra columns come back
as they were, and where a caller has a column named as one that is added, the added one gets one more underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.llm.scratch import stored

LEAST = 20
BROADCAST_ROWS = 2_000_000
EDGES = " \t\r\x0b\x0c"


def _raw(docs: DataFrame) -> Column:
    return F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """id, th, no, line: every line of every text that is not blank."""
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    every = docs.select(F.col("doc_id").alias("id"), text.alias("th"), F.posexplode(_raw(docs)).alias("no", "raw"))
    return every.select("id", "th", "no", F.btrim("raw", F.lit(EDGES)).alias("line")).where("line != ''")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("ha"), F.xxhash64(line, F.lit(1)).alias("hb")]


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("no").alias("no"))


def _halves(n: Column) -> Column:
    """Keys of halves: a pair whose shorter line has m characters shares the first m // 2 or the last m - m // 2."""
    def both(m: Column) -> list[Column]:
        cut = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("first"), m, F.left(F.col("line"), cut)), F.xxhash64(F.lit("last"), m, F.right(F.col("line"), m - cut))]

    return F.array(*both(n), *both(n - 1))


def _width(short: Column) -> Column:
    """The pieces' width by the length of the shorter line of a pair: a power of two about its root."""
    return F.greatest(F.lit(8), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(short, F.lit(1)).cast("double")) / 2)).cast("int"))


def _keys(line: Column, short: Column, whole: bool) -> Column:
    """(at, v) of a line: keys of its variants with the character at a place (from 1) left out, or, as at = 0, of itself
    as another line's variant, piece by piece."""
    n, width = F.length(line), _width(short)
    size = width - 1 if whole else width
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n if whole else n - 1) / width).cast("int")))
    own = lambda k: F.substring(line, k * width + 1, size)
    around = lambda k: F.xxhash64(width, k, F.substring(line, F.lit(1), k * width), F.lit("|"), F.substring(line, k * width + 1 + size, n))
    pieces = F.transform(numbers, lambda k: F.struct((k * width).alias("start"), own(k).alias("own"), around(k).alias("around")))
    if whole:
        return F.transform(pieces, lambda p: F.struct(F.lit(0).alias("at"), F.xxhash64(p["around"], p["own"]).alias("v")))

    def variants(p: Column) -> Column:
        left_out = lambda i: F.concat(F.substring(p["own"], F.lit(1), i - 1), F.substring(p["own"], i + 1, n))
        return F.transform(F.sequence(F.lit(1), F.length(p["own"])), lambda i: F.struct((p["start"] + i).alias("at"), F.xxhash64(p["around"], left_out(i)).alias("v")))

    return F.flatten(F.transform(pieces, variants))


def near(docs: DataFrame, firsts: DataFrame, least: int = LEAST, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """ha, hb, near: lines within one edit of an earlier line and the place of the earliest such line.

    firsts: ha, hb, first, halves of each class of equal lines.
    """
    keyed = firsts.select("ha", "hb", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.min("ha").alias("lo"), F.max("ha").alias("hi")).where("lo != hi").select("half")
    asked = stored(keyed.join(shared, "half", "left_semi").select("ha", "hb").distinct(), "asked")
    found = lines(docs).where(F.length("line") >= least).select(*_hashes(F.col("line")), "line")
    # up to most_broadcast pairs of numbers are sent to all tasks, so the texts need no shuffle; more are joined by key
    sent = F.broadcast(asked) if asked.count() <= most_broadcast else asked
    kept = found.join(sent, ["ha", "hb"], "left_semi").groupBy("ha", "hb").agg(F.first("line").alias("line"))
    kept = stored(kept.join(firsts.select("ha", "hb", "first"), ["ha", "hb"]), "candidates")

    # few rows may have many keys: they are dealt to all tasks first
    dealt = kept.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ha", "hb")
    line, n = F.col("line"), F.length("line")
    # keys as the shorter or equal line of a pair, and as the longer one where that cuts other pieces
    longer = F.when(_width(n - 1) != _width(n), _keys(line, n - 1, False)).otherwise(F.array().cast("array<struct<at:int,v:long>>"))
    keys = F.explode(F.concat(_keys(line, n, True), _keys(line, n, False), longer)).alias("key")
    rows = dealt.select("ha", "hb", keys).select("ha", "hb", "key.at", "key.v")  # at 0: the line itself
    meet = Window.partitionBy("v")  # lines that are equal but for one character
    met = rows.withColumns({"lo": F.min("ha").over(meet), "hi": F.max("ha").over(meet)}).where("lo != hi").select("v", "at", "ha", "hb")
    met = stored(met.join(kept.select("ha", "hb", "first"), ["ha", "hb"]), "met")
    line = F.struct("first", "ha", "hb")
    # one character replaced: the same variant by the same place; one put in or left out: a variant that is a whole line
    same = met.where("at > 0").groupBy("v", "at").agg(F.min(line).alias("o"))
    whole = met.groupBy("v").agg(F.min(F.when(F.col("at") == 0, line)).alias("whole"), F.min(F.when(F.col("at") > 0, line)).alias("variant"))
    pairs = met.join(same, ["v", "at"]).select("ha", "hb", "first", "o").unionByName(met.join(whole, "v").select("ha", "hb", "first", F.when(F.col("at") == 0, F.col("variant")).otherwise(F.col("whole")).alias("o")))
    pairs = pairs.where("o is not null and o.first < first").select("ha", "hb", F.col("o.ha").alias("oa"), F.col("o.hb").alias("ob"), F.col("o.first").alias("near")).distinct()
    text = kept.select("ha", "hb", "line")
    verified = pairs.join(text, ["ha", "hb"]).join(text.toDF("oa", "ob", "other"), ["oa", "ob"]).where(F.levenshtein("line", "other", 1) >= 0)
    return verified.groupBy("ha", "hb").agg(F.min("near").alias("near"))


def removed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """id, th, lost: the places of the lines that go, per document."""
    n = F.length("line")
    places = stored(lines(docs).select("id", "th", "no", *_hashes(F.col("line")), F.when(n >= least, _halves(n)).alias("halves")), "lines")
    firsts = places.groupBy("ha", "hb").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("k"), F.min("halves").alias("halves"))
    firsts = stored(firsts, "firsts")
    linked = near(docs, firsts, least)
    best = firsts.join(linked, ["ha", "hb"], "left").where("k > 1 or near is not null").select("ha", "hb", F.least("first", F.coalesce("near", "first")).alias("best"))
    best = stored(best, "best")  # a plain join follows, whose hot lines Spark can split
    gone = places.join(best, ["ha", "hb"]).where(~(F.col("best") == _place()))
    return gone.groupBy("id", "th").agg(F.collect_set("no").alias("lost"))  # at most the lines of one text


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with __clean (the text without the lines that go), __lines and __removed."""
    def free(name: str) -> str:
        return free("_" + name) if name in docs.columns else name

    lost = removed(docs, least)
    boxed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"), _raw(docs).alias("raw"))
    joined = boxed.join(lost, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")), "left")
    joined = joined.withColumn("gone", F.coalesce("lost", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), "gone")
    clean = F.when(F.size("gone") == 0, F.col("doc.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("raw", i)), "\n"))
    return joined.select("doc.*", clean.alias(free("__clean")), F.size("raw").cast("long").alias(free("__lines")), F.size("gone").cast("long").alias(free("__removed")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_sha256 (of the text that stays; null counts as empty) per document."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("__clean", F.lit("")), 256).alias("clean_sha256"))


ORACLE = f"""
WITH r AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
l AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM r),
f AS (SELECT t, min(row(doc_id, no)) AS p, length(t) AS n FROM l WHERE t <> '' GROUP BY t),
m AS (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= {LEAST}),
h AS (SELECT t, p, n, unnest([m || 'f' || left(t, m // 2), m || 'l' || right(t, m - m // 2)]) AS h FROM m),
e AS (SELECT DISTINCT b.t, a.p FROM h a JOIN h b ON a.h = b.h AND a.t <> b.t AND a.p < b.p AND abs(a.n - b.n) <= 1 WHERE levenshtein(a.t, b.t) <= 1),
b AS (SELECT f.t, least(f.p, coalesce(min(e.p), f.p)) AS best FROM f LEFT JOIN e USING (t) GROUP BY f.t, f.p),
k AS (SELECT l.*, b.t IS NULL OR b.best = row(doc_id, no) AS stays FROM l LEFT JOIN b ON l.t = b.t)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (stays), '')) AS clean_sha256
FROM k GROUP BY doc_id
"""
