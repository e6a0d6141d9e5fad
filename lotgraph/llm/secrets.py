"""Secret scan over a trigram inverted index (operator 9, DataFrame and SQL functions only on the main path).

``trigram_query`` derives from each rule's regex a Boolean trigram query in disjunctive form: literal runs and small
alternatives are enumerated, each gives a conjunction of its trigrams, and a part that can be arbitrary or shorter
than three characters asks for nothing.  ``index`` is the inverted index of the trigrams that the rules ask for: sorted
posting lists by trigram, cut into blocks of about ``BLOCK`` documents so that no list is unbounded.  ``candidates``
intersects a block's lists by conjunction and unites them by rule; only the documents' keys go on, and ``scan`` verifies
the candidates' texts, where they are read, with the regex itself.  A rule without mandatory trigrams scans every text.

Posting lists hold a 64-bit hash of doc_id and text, so copies are spread; rows that repeat both share one entry, and a
collision only adds a candidate, which the regex then refuses.  Trigrams are compared in lower case, which can only add
candidates too.

Defined cases: null text counts as empty and has no spans; a null doc_id keeps its row; repeated rows each give a row;
spans of one start go by the kinds' order; a text of any length is scanned whole, its offsets summed in chunks of
``CHUNK`` matches, so what grows with the square of many matches is only a copy of one number for each chunk; an empty table gives an empty result; extra columns come back as they
were, and where a caller has a column ``__spans``, the added one gets one more underscore.  Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgraph.llm.scratch import stored

ENUMERATED = 64
BLOCK = 4096  # documents of a posting list
CHUNK = 64  # matches
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Rule:
    """kind, regex (leftmost, non-overlapping), and the least length of one of its groups (0: the match)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The base kinds in their listed order, then the kinds that this operator adds.  A maximal run that is
# too short fails whole, so the least length of access and hex can stand in the quantifier.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("hook", r"https://hooks\.[a-z]+\.com/services/[A-Za-z0-9/]{20,}"),
)
BASE = ("assign", "access", "hex")

Query = frozenset[frozenset[str]]  # OR of ANDs of trigrams; an empty conjunction asks for nothing


def _least(terms: set[frozenset[str]]) -> Query:
    return frozenset(t for t in terms if not any(o < t for o in terms))


def trigram_query(regex: str) -> Query:
    """The trigrams that any match must contain, in lower case."""
    query: Query = frozenset([frozenset()])

    def settle(texts: set[str]) -> None:
        nonlocal query
        terms = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in texts}
        query = _least({a | b for a in query for b in terms})

    def literals(items) -> set[str] | None:
        """All texts that a part can match, None if too many."""
        out = {""}
        for op, arg in items:
            if op is rc.LITERAL:
                one = {chr(arg).lower()}
            elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
                one = {chr(a).lower() for _, a in arg}
            elif op is rc.SUBPATTERN:
                one = literals(arg[3])
            elif op is rc.BRANCH:
                parts = [literals(x) for x in arg[1]]
                one = None if None in parts else set().union(*parts)
            elif op is rc.MAX_REPEAT and arg[1] is not rc.MAXREPEAT and arg[1] <= 8:
                inner = literals(arg[2])
                one = None
                if inner is not None and len(inner) ** arg[1] <= ENUMERATED:
                    one, power = set(), {""}
                    for n in range(arg[1] + 1):
                        one |= power if n >= arg[0] else set()
                        power = {a + b for a in power for b in inner}
            else:
                one = None
            if one is None or len(out) * len(one) > ENUMERATED:
                return None
            out = {a + b for a in out for b in one}
        return out

    run = {""}
    for item in parser.parse(regex):
        texts = literals([item])
        if texts is None or len(run) * len(texts) > ENUMERATED:
            settle(run)
            run = texts if texts is not None else {""}
        else:
            run = {a + b for a in run for b in texts}
    settle(run)
    return query


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], _text(docs))


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: one row (trigram, key) per trigram that a rule asks for and text that has it."""
    asked = sorted({g for r in rules for term in trigram_query(r.regex) for g in term})
    low = docs.select(_key(docs).alias("key"), F.lower(_text(docs)).alias("low"))
    has = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in asked])) if asked else F.array().cast("array<string>")
    return low.select("key", F.explode(has).alias("trigram"))


def index(docs: DataFrame, rules=RULES, block: int = BLOCK) -> DataFrame:
    """trigram, block, keys: sorted posting lists, cut by the keys' remainder; combined before the shuffle."""
    count = max(1, -(-docs.count() // block))
    found = postings(docs, rules).withColumn("block", F.pmod("key", F.lit(count)))
    return found.groupBy("trigram", "block").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def candidates(lists: DataFrame, rules=RULES) -> DataFrame:
    """key, kinds: posting lists intersected by each conjunction and united by rule, block by block."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    asked = sorted({g for q in queries.values() for term in q for g in term})
    none = F.array().cast("array<long>")
    # a block has one list per asked trigram
    row = lists.groupBy("block").agg(*[F.coalesce(F.first(F.when(F.col("trigram") == g, F.col("keys")), ignorenulls=True), none).alias(f"g{k}") for k, g in enumerate(asked)])
    column = {g: F.col(f"g{k}") for k, g in enumerate(asked)}
    found = None
    for kind, query in queries.items():
        if frozenset() in query:
            continue
        united = none
        for term in sorted(query, key=sorted):
            first, *more = sorted(term)
            own = column[first]
            for g in more:
                own = F.array_intersect(own, column[g])
            united = F.array_union(united, own)
        one = row.select(F.explode(united).alias("key"), F.lit(kind).alias("kind"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return row.select(F.lit(0).cast("long").alias("key"), F.array().cast("array<string>").alias("kinds")).where("false")
    return found.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of all leftmost non-overlapping matches: the pieces between matches give the offsets."""
    hits = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    pieces = F.split(text, rule.regex, -1)
    zero = F.lit(0).cast("int")

    def step(acc: Column, pair: Column) -> Column:
        at = acc["pos"] + F.length(pair["piece"])
        end = at + F.length(pair["hit"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        good = F.length(F.regexp_extract(pair["hit"], rule.regex, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct(end.alias("pos"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN).alias("out"))

    def chunked(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda k: F.slice(pairs, k * CHUNK + 1, CHUNK))
        first = F.struct(zero.alias("pos"), F.array().cast(SPAN).alias("out"))
        return F.transform(chunks, lambda c: F.aggregate(c, first, step))

    def moved(parts: Column) -> Column:
        # one fold carries the positions before the chunks; what grows with their square is a copy of numbers, a 64th of the matches
        before = F.aggregate(parts, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["pos"])))
        bases = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda x, base: F.struct(x["out"].alias("out"), base.alias("base")))
        move = lambda s, base: F.struct((s["start"] + base).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + base).alias("end"))
        return F.flatten(F.transform(bases, lambda x: F.transform(x["out"], lambda s: move(s, x["base"]))))

    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    pairs = F.zip_with(hits, F.slice(pieces, F.lit(1), F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p.alias("piece")))
    return let(pairs, lambda own: F.when(F.size(own) == 0, F.array().cast(SPAN)).otherwise(let(chunked(own), moved)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules=RULES, block: int = BLOCK, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs with __spans: their verified spans by start, then kind as listed."""
    name = "__spans"
    while name in docs.columns:
        name = "_" + name
    keyed = docs.select(F.struct("*").alias("doc"), _text(docs).alias("whole"), _key(docs).alias("key"))
    found = stored(candidates(index(docs, rules, block), rules), "candidates")
    # up to most_broadcast keys are sent to the texts, which then need no shuffle; more are joined by key
    joined = keyed.join(F.broadcast(found) if found.count() <= most_broadcast else found, "key", "left")
    none = F.array().cast(SPAN)
    spans = []
    for rank, r in enumerate(rules):
        asked = F.array_contains("kinds", r.kind) if frozenset() not in trigram_query(r.regex) else F.col("whole").rlike(r.regex)
        spans.append(F.when(asked, _spans(F.col("whole"), r, rank)).otherwise(none))
    return joined.select("doc.*", F.array_sort(F.concat(*spans)).alias(name))


def report(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the digest columns of scan()."""
    found = scan(docs.select("doc_id", "text"), rules).select("doc_id", "__spans")
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    only = F.filter("__spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(_joined(only), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"))


def _sql_spans(rule: Rule, rank: int) -> str:
    regex = rule.regex.replace("'", "''")
    good = f"length(regexp_extract(h[i], '{regex}', {rule.group})) >= {rule.least}" if rule.least else "true"
    return f"""
SELECT r, {rank} AS rank, '{rule.kind}' AS kind, st AS s, st + length(h[i]) AS e FROM (
  SELECT r, h, i, coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0)::BIGINT + coalesce(list_sum([length(x) FOR x IN h[1:i-1]]), 0)::BIGINT AS st
  FROM (SELECT r, h, p, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(t, '{regex}') AS h, string_split_regex(t, '{regex}') AS p FROM d WHERE regexp_matches(t, '{regex}'))))
WHERE {good}"""


def oracle(rules=RULES, base=BASE) -> str:
    kinds = ", ".join(f"'{k}'" for k in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(rules))}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IN ({kinds})) AS b,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS a FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
