"""Chat formatting by quotation linking (operator 4, DataFrame and SQL functions only).

A line's quote level is the number of ``>`` at its start.  Runs of lines of one level are passages; what stands at
level 0 is the message's own text.  Passages and their lines are normalised (lower case, white space collapsed), hashed
and joined, within a conversation, to the own texts, own passages and own lines of earlier turns.  Of the matches of
level 1, or else of the deepest level's nearest, the longest passage and then the latest turn is the message that is
answered.  Following these links gives each message its thread; a conversation is ordered by thread and turn, so every
reply stands after what it answers, and carries own texts only.

Only hashes that somebody quotes take part in the join.  Each probe takes the last earlier original by a running maximum
(no pair of equal lines becomes a row), inside spans of ``SPAN`` turns, to which the maximum of the spans before is
carried, so a passage that all of a long conversation quote is spread.  Positions are counted in three steps: in buckets
of ``BUCKET`` turns of one thread, over the buckets of ``BUCKET`` roots, and over those; so neither a conversation that
holds a third of all rows nor one thread that holds all of a conversation meets in one task.

Defined cases: null text counts as empty; text that is quoted only has an empty own text; a quote without an original
links nothing; of equal originals the latest earlier one is answered; null conv_ids form one conversation, null turns
come last, in the order of role and text, and are never linked; repeated rows each get a position; a text of any length
is parsed whole, a long line is a passage like any other; an empty table gives an empty result; extra columns play no
part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.llm.scratch import stored

PREFIX = r"^[ \t]*((?:>[ \t]?)+)"
BUCKET = 256
SPAN = 1024


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with __lines (level, text), __runs (level, text) and __own (the text without quotes)."""
    raw = F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, PREFIX, 1), "[^>]", ""))
    lines = F.transform(raw, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, PREFIX, "").alias("text")))
    out = messages.withColumn("__lines", lines)
    at = F.sequence(F.lit(0), F.size("__lines") - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get("__lines", i)["level"] != F.get("__lines", i - 1)["level"]))
    out = out.withColumn("__starts", starts)
    text_of = lambda part: F.array_join(F.transform(part, lambda x: x["text"]), "\n")
    runs = F.transform("__starts", lambda s, k: F.struct(F.get("__lines", s)["level"].alias("level"), text_of(F.slice("__lines", s + 1, F.coalesce(F.get("__starts", k + 1), F.size("__lines")) - s)).alias("text")))
    own = F.btrim(text_of(F.filter("__lines", lambda x: x["level"] == 0)), F.lit(" \t\r\n"))
    return out.withColumns({"__runs": runs, "__own": own}).drop("__starts")


def links(messages: DataFrame) -> DataFrame:
    """conv, turn, reply_to: the earlier turn that a message quotes; messages has __lines, __runs, __own."""
    rows = messages.where("turn is not null").select(F.col("conv_id").alias("conv"), "turn", "__lines", "__runs", "__own")
    quotes = rows.where(F.exists("__lines", lambda x: x["level"] > 0))
    parts = F.filter(F.concat("__runs", "__lines"), lambda x: x["level"] > 0)
    probes = quotes.select("conv", "turn", F.explode(parts).alias("q")).select("conv", "turn", F.col("q.level").alias("level"), normalised(F.col("q.text")).alias("n"))
    probes = stored(probes.where("n != ''").select("conv", "turn", "level", F.length("n").alias("size"), F.xxhash64("n").alias("h")).distinct(), "probes")
    own = F.concat(F.array("__own"), F.transform(F.filter(F.concat("__runs", "__lines"), lambda x: x["level"] == 0), lambda x: x["text"]))
    originals = rows.select("conv", "turn", F.explode(own).alias("t")).select("conv", "turn", F.xxhash64(normalised(F.col("t"))).alias("h"))
    asked = probes.select(F.col("conv").alias("c"), F.col("h").alias("x")).distinct()
    originals = originals.join(asked, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("x")), "left_semi").distinct()
    none = F.lit(None)
    both = originals.select("conv", "h", "turn", none.cast("int").alias("level"), none.cast("int").alias("size")).unionByName(probes)
    both = stored(both.withColumn("span", F.floor(F.col("turn") / SPAN)), "both")
    original = F.when(F.col("level").isNull(), F.col("turn"))
    ahead = Window.partitionBy("conv", "h").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy("conv", "h", "span").agg(F.max(original).alias("last")).withColumn("carried", F.max("last").over(ahead))
    before = Window.partitionBy("conv", "h", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("here", F.max(original).over(before)).where("level is not null")
    carried = spans.where("carried is not null").select(F.col("conv").alias("c"), F.col("h").alias("x"), F.col("span").alias("s"), "carried")
    found = here.join(carried, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("x")) & (F.col("span") == F.col("s")), "left")
    found = found.withColumn("to", F.coalesce("here", "carried")).where("to is not null")
    best = F.max_by("to", F.struct(-F.col("level"), F.col("size"), F.col("to")))
    return found.groupBy("conv", "turn").agg(best.alias("reply_to"))


def threads(found: DataFrame, rounds: int = 64) -> DataFrame:
    """conv, turn, reply_to, root, depth: links followed by pointer jumping, the distance doubling each round."""
    done = stored(found.select("conv", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "threads")
    for _ in range(rounds):
        up = done.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = done.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        new = stored(step.select("conv", "turn", "reply_to", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")), "threads")
        done = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return done
    raise RuntimeError("threads did not settle")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, reply_to, root_turn, depth, content: reply-ordered messages without quotes."""
    found = parsed(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    linked = threads(links(found)).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "reply_to", "root", "depth")
    rows = found.select("conv_id", "turn", "role", F.col("__own").alias("content"))
    rows = rows.join(linked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
    rows = rows.select("conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "content")
    # roots by BUCKET, then one thread's turns by BUCKET; rows without a turn by what they are ordered by
    loose = F.when(F.col("turn").isNull(), F.struct(F.col("role").isNull().alias("no_role"), "role", F.left("content", F.lit(4)).alias("begin")))
    rows = rows.withColumns({"roots": F.floor(F.col("root_turn") / BUCKET), "part": F.struct(F.col("root_turn").alias("root"), F.floor(F.col("turn") / BUCKET).alias("turns"), loose.alias("loose"))})
    order = [F.asc_nulls_last("root_turn"), F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc("content")]
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "roots", "part").orderBy(*order)))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy("conv_id", "roots", "part").agg(F.count(F.lit(1)).alias("k"))
    many = parts.groupBy("conv_id", "roots").agg(F.sum("k").alias("k"))
    many = many.select(F.col("conv_id").alias("c"), F.col("roots").alias("r"), (F.sum("k").over(up_to(Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("roots")))) - F.col("k")).alias("base"))
    inside = F.sum("k").over(up_to(Window.partitionBy("conv_id", "roots").orderBy("part"))) - F.col("k")
    parts = parts.withColumn("inside", inside).join(many, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("roots").eqNullSafe(F.col("r"))).select("c", "r", F.col("part").alias("p"), (F.col("base") + F.col("inside")).alias("before"))
    out = placed.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("roots").eqNullSafe(F.col("r")) & F.col("part").eqNullSafe(F.col("p")))
    return out.select("conv_id", (F.col("at") + F.col("before")).alias("position"), "turn", "role", "reply_to", "root_turn", "depth", "content")


def report(messages: DataFrame) -> DataFrame:
    return conversations(messages).withColumn("content_sha256", F.sha2("content", 256)).drop("content")


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT r, conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS no FROM m),
l AS (SELECT r, conv_id, turn, no, length(regexp_replace(regexp_extract(x, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '^[ \t]*((?:>[ \t]?)+)', '') AS t FROM u),
g AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY no) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY no) AS before FROM l)),
p AS (SELECT r, conv_id, turn, level, string_agg(t, chr(10) ORDER BY no) AS t FROM g GROUP BY r, conv_id, turn, level, run
  UNION ALL SELECT r, conv_id, turn, level, t FROM g),
o AS (SELECT m.r, m.conv_id, m.turn, coalesce(trim(string_agg(t, chr(10) ORDER BY no) FILTER (level = 0), chr(32) || chr(9) || chr(13) || chr(10)), '') AS own FROM m LEFT JOIN l USING (r) GROUP BY m.r, m.conv_id, m.turn),
n AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(t), '[\x20\x09-\x0D]+', ' ', 'g')) AS n FROM p UNION ALL
  SELECT conv_id, turn, 0, trim(regexp_replace(lower(own), '[\x20\x09-\x0D]+', ' ', 'g')) FROM o),
k AS (SELECT q.conv_id, q.turn, arg_max(a.turn, row(-q.level, length(q.n), a.turn)) AS reply_to FROM n q JOIN n a
  ON a.level = 0 AND q.level > 0 AND q.n <> '' AND a.n = q.n AND a.conv_id IS NOT DISTINCT FROM q.conv_id AND a.turn < q.turn GROUP BY q.conv_id, q.turn),
c AS (SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM k UNION ALL
  SELECT c.conv_id, c.turn, k.reply_to, depth + 1 FROM c JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id AND k.turn = c.root),
e AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM c GROUP BY conv_id, turn),
f AS (SELECT m.conv_id, m.turn, m.role, k.reply_to, coalesce(e.root, m.turn) AS root_turn, coalesce(e.depth, 0) AS depth, o.own
  FROM m JOIN o USING (r) LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM m.conv_id AND k.turn = m.turn LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.turn = m.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS LAST, turn NULLS LAST, role NULLS LAST, own) AS position,
  turn, role, reply_to, root_turn, depth, sha256(own) AS content_sha256 FROM f
"""
