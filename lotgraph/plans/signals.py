"""Queries of process control, alignment, resolution, allocation, netting and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotgraph.operators import align, forward, graph, reconstruct, resolve, spc
from lotgraph.operators.cuts import cut
from lotgraph.plans.binding import lots, orders, series, sql, table

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


_RULES = {
    1: "SELECT series, i AS start, i AS \"end\", CASE WHEN value > m THEN 'above' ELSE 'below' END AS side FROM base WHERE n >= 3 AND s > 0 AND abs(value - m) > 3 * s",
    2: "SELECT series, i AS start, i + 8 AS \"end\", CASE WHEN lo > m THEN 'above' ELSE 'below' END AS side FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS k FROM base WHERE n >= 3 WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) WHERE k = 9 AND (lo > m OR hi < m)",
    3: "SELECT series, i AS start, i + 5 AS \"end\", CASE WHEN up > 0 THEN 'rising' ELSE 'falling' END AS side FROM (SELECT *, sum(step) OVER w AS up, count(step) OVER w AS k FROM (SELECT *, sign(lead(value) OVER (PARTITION BY series ORDER BY i) - value) AS step FROM base WHERE n >= 3) WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5 AND abs(up) = 5",
    5: "SELECT series, i AS start, i + 2 AS \"end\", CASE WHEN a >= 2 THEN 'above' ELSE 'below' END AS side FROM (SELECT *, sum((value > m + 2 * s)::INT) OVER w AS a, sum((value < m - 2 * s)::INT) OVER w AS b, count(*) OVER w AS k FROM base WHERE n >= 3 AND s > 0 WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE k = 3 AND (a >= 2 OR b >= 2)",
}


@query(sql("ser base", _RULES[1]))
def spc_nelson1(spark, sf):
    return spc.nelson1(series(spark, sf))


@query(sql("ser base", _RULES[2]))
def spc_nelson2(spark, sf):
    return spc.nelson2(series(spark, sf))


@query(sql("ser base", _RULES[3]))
def spc_nelson3(spark, sf):
    return spc.nelson3(series(spark, sf))


@query(sql("ser base", _RULES[5]))
def spc_nelson5(spark, sf):
    return spc.nelson5(series(spark, sf))


FIRED = ", fired AS (" + " UNION ALL ".join(f"SELECT series, '{k}' AS rule FROM ({q})" for k, q in _RULES.items()) + ")"


@query(sql("ser base", f"{FIRED} SELECT b.series, b.n, round(b.m, 4) AS mean, round(b.s, 4) AS std, coalesce(r.rules, '') AS rules FROM (SELECT DISTINCT series, n, m, s FROM base WHERE n >= 3) b LEFT JOIN (SELECT series, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM fired GROUP BY series) r USING (series)"))
def spc_summary(spark, sf):
    return spc.summary(series(spark, sf)).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


SIGNAL = "SELECT series, least(1.0, count(fired.rule) / 20.0)::DOUBLE AS strength FROM (SELECT series FROM base GROUP BY series HAVING count(*) >= 5) LEFT JOIN fired USING (series) GROUP BY series"
DECLINE = "SELECT series, least(1.0, (1.33 - cpk) / 0.5) AS strength FROM t WHERE n >= 10 AND trend = 'DECLINING' AND coalesce(cpk, 2.0) < 1.33"


@query(sql("ser base", f"{FIRED} {SIGNAL}"))
def spc_machine_signal(spark, sf):
    return spc.machine_signal(series(spark, sf))


def capability_sql(lsl: int, usl: int) -> str:
    """t: the capability of every series of base."""
    cpk = lambda m: f"least(({usl} - {m}) / (3 * s), ({m} - {lsl}) / (3 * s))"
    return f""", h AS (SELECT *, i + 1 <= n // 2 AS first FROM base),
c AS (SELECT series, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s, avg(value) FILTER (first) AS m1, avg(value) FILTER (NOT first) AS m2 FROM h GROUP BY series),
k AS (SELECT series, n, s, {usl - lsl}.0 / (6 * s) AS cp, {cpk('m')} AS cpk, {cpk('m2')} - {cpk('m1')} AS delta FROM c),
t AS (SELECT *, CASE WHEN n < 5 THEN 'INSUFFICIENT_DATA' WHEN s = 0 THEN 'ZERO_VARIANCE' WHEN delta > 0.1 THEN 'IMPROVING' WHEN delta < -0.1 THEN 'DECLINING' ELSE 'STABLE' END AS trend FROM k)
"""


_CAP = capability_sql(0, 120)


def _limited(spark, sf):
    return series(spark, sf).withColumns({"lsl": F.lit(0.0), "usl": F.lit(120.0)})


@query(sql("ser base", f"{_CAP} SELECT series, n, CASE WHEN n >= 5 AND s > 0 THEN round(cp, 6) END AS cp, CASE WHEN n >= 5 AND s > 0 THEN round(cpk, 6) END AS cpk, CASE WHEN n >= 5 AND s > 0 THEN round(delta, 6) END AS delta, trend FROM t"))
def spc_cpk(spark, sf):
    return spc.capability(_limited(spark, sf)).withColumns({c: F.round(c, 6) for c in ("cp", "cpk", "delta")})


@query(sql("ser base", f"{_CAP} SELECT series, round(least(1.0, (1.33 - cpk) / 0.5), 6) AS strength FROM t WHERE n >= 10 AND trend = 'DECLINING' AND coalesce(cpk, 2.0) < 1.33"))
def spc_cpk_decline(spark, sf):
    return spc.decline_signal(_limited(spark, sf)).withColumn("strength", F.round("strength", 6))


def _pairs(spark, sf, seconds=43200):
    e = table(spark, sf, "events").select(F.col("user_id").alias("station"), "ts", "event_type")
    return align.anchors(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), ["station"], seconds)


# whole seconds on both sides, as the operator measures them from 1970
_PAIRS = """pairs AS (SELECT station, ts_a, arg_min(ts_b, row(abs(diff), ts_b)) AS ts_b, arg_min(diff, row(abs(diff), ts_b)) AS diff FROM (
  SELECT a.user_id AS station, a.ts AS ts_a, b.ts AS ts_b, floor(epoch(b.ts))::BIGINT - floor(epoch(a.ts))::BIGINT AS diff FROM events a JOIN events b ON a.user_id = b.user_id
  WHERE a.event_type = 'view' AND b.event_type = 'purchase') WHERE abs(diff) <= 43200 GROUP BY station, ts_a)"""


@query(f"WITH {_PAIRS} SELECT station, strftime(ts_a, '%Y-%m-%d %H:%M:%S') AS ts_a, strftime(ts_b, '%Y-%m-%d %H:%M:%S') AS ts_b, diff FROM pairs")
def anchor_match(spark, sf):
    return _pairs(spark, sf).select("station", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("ts_a", "ts_b")], "diff")


_OFFSET = f"""{_PAIRS}, f AS (SELECT station, median(diff) AS m FROM pairs GROUP BY station HAVING count(*) >= 5),
d AS (SELECT pairs.*, abs(diff - m) AS far FROM pairs JOIN f USING (station)), a AS (SELECT station, CASE WHEN median(far) < 1e-6 THEN 1.0 ELSE median(far) END AS mad FROM d GROUP BY station),
k AS (SELECT d.*, mad, far <= 3.5 * mad AS ok FROM d JOIN a USING (station)), e AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY station) AS kept FROM k),
o AS (SELECT station, median(diff) AS off, min(mad) AS mad, count(*) AS n FROM e WHERE ok OR kept < 5 GROUP BY station)"""


@query(f"WITH {_OFFSET} SELECT station, off AS \"offset\", round(mad, 4) AS mad, n, round(least(1.0, n / 50.0) / (1 + mad / 10), 6) AS confidence FROM o")
def offset_mad(spark, sf):
    return align.robust_offset(_pairs(spark, sf), "station").withColumns({"mad": F.round("mad", 4), "confidence": F.round("confidence", 6)})


@query(f"""WITH {_PAIRS}, d AS (SELECT station, date_diff('day', DATE '2024-01-01', ts_a::DATE) // 7 AS day, diff FROM pairs), c AS (SELECT *, count(*) OVER (PARTITION BY station, day) AS k FROM d)
SELECT station, round(regr_slope(diff, day), 4) AS slope, round(regr_intercept(diff, day), 4) AS intercept, round(CASE WHEN var_pop(diff) = 0 THEN 0 ELSE regr_r2(diff, day) END, 4) AS r2, count(DISTINCT day) AS days, count(*) AS n, abs(regr_slope(diff, day)) > 1 AS significant
FROM c WHERE k >= 3 GROUP BY station HAVING count(DISTINCT day) >= 3 AND count(*) >= 9""")
def drift_regr(spark, sf):
    day = F.floor(F.datediff(F.to_date("ts_a"), F.lit("2024-01-01").cast("date")) / 7)
    out = align.drift(_pairs(spark, sf).withColumn("day", day), "station", "day")
    return out.withColumns({c: F.round(c, 4) for c in ("slope", "intercept", "r2")})


@query(f"WITH {_PAIRS} SELECT station, count(diff) AS n, median(diff) AS median, round(stddev_samp(diff), 4) AS std FROM pairs GROUP BY station")
def anchor_audit(spark, sf):
    return align.anchor_audit(_pairs(spark, sf), "station").withColumn("std", F.round("std", 4))


@query(f"WITH {_OFFSET} SELECT event_id, strftime(date_trunc('second', ts) + to_microseconds((coalesce(off, 0) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS ts_aligned FROM events LEFT JOIN o ON station = user_id")
def apply_offset(spark, sf):
    offsets = align.robust_offset(_pairs(spark, sf), "station")
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("station"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return align.apply_offset(e, offsets, "station").select("event_id", F.date_format("ts_aligned", "yyyy-MM-dd HH:mm:ss").alias("ts_aligned"))


def _resolved(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("user_id")
    alias = F.when(k % 3 == 0, F.format_string("LOT-%04d", k)).when(k % 3 == 1, F.format_string("A%04d", k)).otherwise(F.format_string("odd %d", F.col("event_id")))
    rows = e.select(F.col("event_type").alias("source"), alias.alias("alias"), "ts", F.col("event_id").alias("row_id"))
    pool = e.select(F.format_string("LOT-%04d", k).alias("canonical")).distinct()
    seen = e.where(k % 3 == 0).select(F.col("event_type").alias("source"), F.format_string("LOT-%04d", k).alias("canonical"), "ts")
    return resolve.resolve(resolve.alias_sample(rows), pool, seen)


_RESOLVED = """WITH a AS (SELECT event_type AS source, CASE user_id % 3 WHEN 0 THEN printf('LOT-%04d', user_id) WHEN 1 THEN printf('A%04d', user_id) ELSE 'odd ' || event_id END AS alias, ts, event_id FROM events),
s AS (SELECT source, alias, arg_min(ts, event_id) AS ts FROM a GROUP BY source, alias), seen AS (SELECT event_type AS source, printf('LOT-%04d', user_id) AS c, ts FROM events WHERE user_id % 3 = 0),
p AS (SELECT DISTINCT printf('LOT-%04d', user_id) AS c FROM events),
m AS (SELECT s.source, s.alias, min(row(abs(floor(epoch(seen.ts))::BIGINT - floor(epoch(s.ts))::BIGINT), seen.c)) AS m FROM s JOIN seen ON s.source <> seen.source AND abs(floor(epoch(seen.ts))::BIGINT - floor(epoch(s.ts))::BIGINT) <= 300 GROUP BY s.source, s.alias),
r AS (SELECT s.source, s.alias, e.c AS c1, x.c AS c2, m.m[2] AS c3, m.m[1] AS gap FROM s LEFT JOIN p e ON e.c = s.alias
  LEFT JOIN p x ON regexp_matches(s.alias, '[0-9]{3,4}') AND x.c = 'LOT-' || lpad(regexp_extract(s.alias, '([0-9]{3,4})', 1), 4, '0') LEFT JOIN m ON m.source = s.source AND m.alias = s.alias),
z AS (SELECT source, alias, coalesce(c1, c2, c3) AS canonical, round(CASE WHEN c1 IS NOT NULL THEN 1.0 WHEN c2 IS NOT NULL THEN 0.95 WHEN c3 IS NOT NULL THEN greatest(0.5, least(0.95, 0.85 * (1 - gap / 300.0))) ELSE 0.0 END, 6) AS confidence,
  CASE WHEN c1 IS NOT NULL THEN 'exact' WHEN c2 IS NOT NULL THEN 'suffix' WHEN c3 IS NOT NULL THEN 'temporal' ELSE 'no_match' END AS method FROM r)
"""


@query(f"{_RESOLVED} SELECT *, confidence < 0.75 AS needs_review FROM z")
def resolve_tiers(spark, sf):
    return _resolved(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query(f"{_RESOLVED} SELECT method, count(*) AS n, count(*) FILTER (confidence < 0.75) AS n_review, count(*) FILTER (confidence >= 0.95) AS c_high, count(*) FILTER (confidence >= 0.75 AND confidence < 0.95) AS c_good, count(*) FILTER (confidence >= 0.5 AND confidence < 0.75) AS c_low, count(*) FILTER (confidence < 0.5) AS c_none FROM z GROUP BY method")
def resolution_audit(spark, sf):
    return resolve.resolution_audit(_resolved(spark, sf).withColumn("confidence", F.round("confidence", 6)).withColumn("needs_review", F.col("confidence") < 0.75))


_FIFO = """, so AS (SELECT product, jt_id, qty, sum(qty) OVER (PARTITION BY product ORDER BY due, jt_id ROWS UNBOUNDED PRECEDING) AS hi FROM jt),
sl AS (SELECT product, lot_id, qty, sum(qty) OVER (PARTITION BY product ORDER BY created, lot_id ROWS UNBOUNDED PRECEDING) AS hi FROM lots WHERE qty > 0),
al AS (SELECT so.product, so.jt_id, sl.lot_id, (least(so.hi, sl.hi) - greatest(so.hi - so.qty, sl.hi - sl.qty))::BIGINT AS take FROM so JOIN sl ON so.product = sl.product AND sl.hi > so.hi - so.qty AND sl.hi - sl.qty < so.hi)
"""


def _own(spark, sf):
    """The lots, made once for all branches of a plan."""
    return cut(lots(spark, sf))


def _fifo(spark, sf, own=None):
    own = _own(spark, sf) if own is None else own
    return reconstruct.fifo(orders(spark, sf, own).select("product", "jt_id", "qty", "due"), own.select("product", "lot_id", "qty", "created"))


@query(sql("lots jt", f"{_FIFO} SELECT * FROM al"))
def fifo_alloc(spark, sf):
    return _fifo(spark, sf)


@query(sql("lots jt", f"{_FIFO} SELECT jt.jt_id, qty, coalesce(a, 0)::BIGINT AS allocated, (coalesce(a, 0) - qty)::BIGINT AS diff FROM jt LEFT JOIN (SELECT jt_id, sum(take) AS a FROM al GROUP BY jt_id) x ON x.jt_id = jt.jt_id WHERE abs(coalesce(a, 0) - qty) > 5"))
def alloc_check(spark, sf):
    own = _own(spark, sf)
    return reconstruct.allocation_check(orders(spark, sf, own), _fifo(spark, sf, own))


@query(sql("lots jt", f"{_FIFO}, c AS (SELECT product, jt_id, lot_id, qty AS take FROM lots WHERE station % 5 = 0) SELECT *, 'fifo' AS origin FROM al WHERE lot_id NOT IN (SELECT lot_id FROM c) UNION ALL SELECT *, 'confirmed' FROM c"))
def alloc_overlay(spark, sf):
    own = _own(spark, sf)
    confirmed = own.where("station % 5 = 0").select("product", "jt_id", "lot_id", F.col("qty").alias("take"))
    return reconstruct.overlay(_fifo(spark, sf, own), confirmed).select("product", "jt_id", "lot_id", "take", "origin")


@query(sql("lots", """, b AS (SELECT DISTINCT product, 'C' || (length(product) % 3 + k) AS component, 1.0 + k AS per_unit FROM lots, range(0, 2) t(k)),
m AS (SELECT 'C' || (l_suppkey % 5) AS component, arg_min(l_partkey, row(l_shipdate, l_partkey)) AS mat_lot FROM lineitem GROUP BY 1)
SELECT lot_id, component, m.mat_lot, round((qty * per_unit * 1.002)::DOUBLE, 4) AS qty FROM lots JOIN b USING (product) JOIN m USING (component)"""))
def bom_explode(spark, sf):
    own = lots(spark, sf)
    bom = own.select("product").distinct().select("product", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("product", F.concat(F.lit("C"), F.length("product") % 3 + F.col("k")).alias("component"), (1.0 + F.col("k")).alias("per_unit"), F.lit(1.002).alias("scrap"))
    material = table(spark, sf, "lineitem").select(F.concat(F.lit("C"), F.col("l_suppkey") % 5).alias("component"), F.col("l_partkey").alias("mat_lot"), F.col("l_shipdate").alias("received"))
    return reconstruct.bom_explode(own, bom, material).withColumn("qty", F.round("qty", 4))


@query("""WITH c AS (SELECT l_orderkey AS parent, floor(sum(l_quantity))::BIGINT AS child_qty, count(*) AS n_children FROM lineitem GROUP BY l_orderkey)
SELECT parent, 20 + parent % 50 AS parent_qty, child_qty, n_children, child_qty - (20 + parent % 50) AS diff FROM c JOIN orders ON parent = o_orderkey WHERE abs(child_qty - (20 + parent % 50)) > 5""")
def conservation(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_quantity").cast("long").alias("child_qty"))
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("lot_id"), (20 + F.col("o_orderkey") % 50).alias("qty"))
    return reconstruct.conservation(edges, own).select("parent", "parent_qty", "child_qty", "n_children", "diff")


@query("SELECT 'O' || o_orderkey AS lot_id, 1.0::DOUBLE AS confidence FROM orders UNION ALL SELECT DISTINCT 'C' || o_custkey, 0.5 FROM orders")
def fill_missing_lots(spark, sf):
    o = table(spark, sf, "orders")
    own = o.select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("lot_id"), F.lit(1.0).alias("confidence"))
    return reconstruct.fill_missing_lots(own, o.select(F.concat(F.lit("C"), F.col("o_custkey")).alias("parent"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("child")))


def _edges(spark, sf):
    """region → nation → customer → order, and part → order of small ids."""
    e = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("parent"), F.concat(F.lit(b), F.col(y)).alias("child"))
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return e(table(spark, sf, "nation"), "R", "n_regionkey", "N", "n_nationkey").union(e(table(spark, sf, "customer"), "N", "c_nationkey", "C", "c_custkey")).union(e(table(spark, sf, "orders"), "C", "o_custkey", "O", "o_orderkey")).union(e(li, "P", "l_partkey", "O", "l_orderkey"))


_EDGES = """e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION SELECT 'P' || l_partkey, 'O' || l_orderkey FROM lineitem)"""


def _seeds(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("seed"))


_UP = f"""WITH RECURSIVE {_EDGES}, u AS (SELECT 'O' || o_orderkey AS seed, 'O' || o_orderkey AS node, 0 AS depth FROM orders UNION SELECT seed, parent, depth + 1 FROM u JOIN e ON child = node WHERE depth < 10)"""


@query(f"{_UP} SELECT seed, node, min(depth) AS depth FROM u WHERE depth > 0 GROUP BY seed, node")
def upstream(spark, sf):
    return graph.reach(_edges(spark, sf), _seeds(spark, sf))


@query(f"WITH RECURSIVE {_EDGES}, u AS (SELECT 'R' || r_regionkey AS seed, 'R' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT seed, child, depth + 1 FROM u JOIN e ON parent = node WHERE depth < 10) SELECT seed, node, min(depth) AS depth FROM u WHERE depth > 0 GROUP BY seed, node")
def downstream(spark, sf):
    seeds = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("seed"))
    return graph.reach(_edges(spark, sf), seeds, down=True)


@query(f"WITH RECURSIVE {_EDGES}, u AS (SELECT 'O' || o_orderkey AS seed, 'O' || o_orderkey AS node, 0 AS depth FROM orders UNION SELECT seed, parent, depth + 1 FROM u JOIN e ON child = node WHERE depth < 3 AND NOT starts_with(parent, 'P')) SELECT seed, node, min(depth) AS depth FROM u GROUP BY seed, node")
def bfs_depth(spark, sf):
    return graph.bfs(_edges(spark, sf), _seeds(spark, sf), max_depth=2, keep=lambda n: ~n.startswith("P"))


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT 'R' || r_regionkey AS source, 'R' || r_regionkey AS node, 'R' || r_regionkey AS path, 0 AS hops FROM region UNION ALL SELECT source, child, path || '>' || child, hops + 1 FROM u JOIN e ON parent = node WHERE hops < 3)
SELECT source, node AS target, min(hops) AS hops, min(path) AS path FROM u WHERE node IN (SELECT 'O' || o_orderkey FROM orders) GROUP BY source, node""")
def shortest_path(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("source"))
    pairs = _seeds(spark, sf).withColumnRenamed("seed", "target").join(F.broadcast(r), F.lit(True))  # five regions
    return graph.shortest_path(_edges(spark, sf), pairs)


@query(f"WITH RECURSIVE {_EDGES}, s AS (SELECT o_custkey AS customer, 'O' || o_orderkey AS seed FROM orders), u AS (SELECT seed, seed AS node FROM s UNION SELECT seed, parent FROM u JOIN e ON child = node), t AS (SELECT customer, count(*) AS total FROM s GROUP BY customer) SELECT customer, node FROM s JOIN u USING (seed) JOIN t USING (customer) GROUP BY customer, node, total HAVING count(*) = total")
def common_ancestors(spark, sf):
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("seed"))
    return graph.common_ancestors_by(_edges(spark, sf), seeds, "customer")


@query("WITH h AS (SELECT DISTINCT p_brand AS product, l_suppkey % 12 AS src, lead(l_suppkey % 12) OVER (PARTITION BY p_brand ORDER BY l_partkey, l_orderkey, l_linenumber, l_shipdate, l_suppkey) AS dst FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_shipdate, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey) SELECT src, dst, count(*) AS n_products, string_agg(product, ',' ORDER BY product) AS products FROM h WHERE dst IS NOT NULL GROUP BY src, dst")
def dependency_edges(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey").distinct()
    rows = li.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return graph.dependency(rows.select(F.col("p_brand").alias("product"), F.struct("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey").alias("seq"), (F.col("l_suppkey") % 12).alias("station")))


@query("SELECT DISTINCT 'C' || o_custkey AS node, 'BATCH' AS kind FROM orders UNION ALL SELECT 'O' || o_orderkey, 'LOT' FROM orders")
def genealogy_nodes(spark, sf):
    o = table(spark, sf, "orders")
    own = o.select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("lot_id"))
    return graph.nodes(own, o.select(F.concat(F.lit("C"), F.col("o_custkey")).alias("parent"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("child")))


@query(sql("lots", "SELECT product, round(avg(q), 1) AS daily FROM (SELECT product, created::DATE AS d, sum(qty) AS q FROM lots GROUP BY 1, 2) GROUP BY product"))
def daily_production(spark, sf):
    return forward.daily_production(lots(spark, sf))


_SCHED = ", jf AS (SELECT product || '#' || date_diff('day', DATE '1990-01-01', due::DATE) // 14 AS product, date_diff('day', DATE '1990-01-01', due::DATE) % 14 AS d, qty FROM jt), sp AS (SELECT product, d AS day_idx FROM (SELECT DISTINCT product FROM jf), range(0, 14) t(d)), sc AS (SELECT sp.product, sp.day_idx::BIGINT AS day_idx, coalesce(sum(qty), 0)::BIGINT AS qty FROM sp LEFT JOIN jf ON jf.product = sp.product AND jf.d = day_idx GROUP BY 1, 2)"


def _fortnights(spark, sf):
    """All orders; a product's fortnight stands for a product, its days for the horizon's."""
    day = F.datediff(F.to_date("due"), F.lit("1990-01-01").cast("date"))
    return orders(spark, sf).select(F.concat_ws("#", "product", F.floor(day / 14)).alias("product"), "qty", F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(day, F.lit(14)).cast("int")).alias("due"))


@query(sql("lots jt", f"{_SCHED} SELECT * FROM sc"))
def ship_schedule(spark, sf):
    return forward.ship_schedule(_fortnights(spark, sf), "1990-01-01").withColumn("day_idx", F.col("day_idx").cast("long"))


@query(sql("lots jt", f"""{_SCHED}, n AS (SELECT product, day_idx, 50 + sum(40 - qty) OVER w AS baseline, 50 + sum(CASE WHEN day_idx = 0 THEN greatest(0, 40 - 73.6) ELSE 40 END - qty) OVER w AS incident FROM sc WINDOW w AS (PARTITION BY product ORDER BY day_idx ROWS UNBOUNDED PRECEDING))
SELECT product, day_idx, round(baseline, 4)::DOUBLE AS baseline, round(incident, 4)::DOUBLE AS incident, incident < 0 AS is_short FROM n"""))
def netting(spark, sf):
    schedule = forward.ship_schedule(_fortnights(spark, sf), "1990-01-01")
    p = schedule.select("product").distinct()
    out = forward.netting(schedule, p.withColumn("opening", F.lit(50.0)), p.withColumn("daily", F.lit(40.0)), F.lit(73.6))
    return out.select("product", F.col("day_idx").cast("long").alias("day_idx"), F.round("baseline", 4).alias("baseline"), F.round("incident", 4).alias("incident"), "is_short")
