"""Queries of normalisation, mapping, quality, dedupe, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotgraph.functions import ids, values
from lotgraph.operators import dashboard, mapping, quality, reconstruct
from lotgraph.plans.binding import incidents, lots, sql, table
from lotgraph.sources import readers

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


_ALIAS = "CASE p_partkey % 6 WHEN 0 THEN printf('L-A-%04d', p_partkey % 10000) WHEN 1 THEN printf('QR260929A%04d', p_partkey % 10000) WHEN 2 THEN printf('A%04d', p_partkey % 10000) WHEN 3 THEN printf('LOT-%04d-A', p_partkey % 10000) WHEN 4 THEN printf('LOT-%04d', p_partkey % 10000) ELSE '' END"


def aliases(spark, sf):
    n = F.col("p_partkey") % 10000
    forms = ["L-A-%04d", "QR260929A%04d", "A%04d", "LOT-%04d-A", "LOT-%04d"]
    alias = F.lit("")
    for k, form in enumerate(forms):
        alias = F.when(F.col("p_partkey") % 6 == k, F.format_string(form, n)).otherwise(alias)
    return table(spark, sf, "part").select("p_partkey", alias.alias("alias"))


@query(f"SELECT p_partkey, {_ALIAS} AS alias, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE printf('LOT-%04d', p_partkey % 10000) END AS lot_id, CASE WHEN p_partkey % 6 = 5 THEN '' WHEN p_partkey % 6 = 1 THEN '0260' ELSE printf('%04d', p_partkey % 10000) END AS digits FROM part".replace("'0260'", "'2609'"))
def norm_lot_alias(spark, sf):
    return aliases(spark, sf).select("p_partkey", "alias", ids.lot_id(F.col("alias")).alias("lot_id"), ids.digits_key(F.col("alias")).alias("digits"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN printf('JT-%04d', o_orderkey) ELSE 'X' || o_orderkey END AS jt_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'STN-M1' ELSE 'STN-' || (o_custkey % 9) END AS station, 'PROD-P' || (o_custkey % 4) AS product, 'COMP-C' || (o_custkey % 7) AS component, 'BATCH-HT-' || printf('B%02d', o_custkey % 100) AS batch FROM orders""")
def norm_ids(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders")
    jt = F.when(k % 3 == 0, F.format_string("JT-%04d", k)).when(k % 3 == 1, F.format_string("JT_%d", k)).otherwise(F.format_string("X%d", k))
    stn = F.when(k % 2 == 0, F.lit("STN-M1")).otherwise(F.format_string("%d", c % 9))
    return o.select("o_orderkey", ids.order_id(jt).alias("jt_id"), ids.station_id(stn).alias("station"), ids.product_id(F.format_string("P0%d", c % 4)).alias("product"), ids.component_id(F.format_string("ITEM_COMP-C%d", c % 7)).alias("component"), ids.batch_id(F.format_string("B%02d", c % 100)).alias("batch"))


@query("""WITH c AS (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS c FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN NULL WHEN p_partkey % 5 = 4 THEN (c // 100)::DOUBLE ELSE (c / 100.0)::DOUBLE END AS value,
  CASE WHEN p_partkey % 5 = 3 THEN NULL WHEN p_partkey % 5 = 4 THEN round_even(c // 100, 0)::BIGINT ELSE round_even((c / 100.0)::DOUBLE, 0)::BIGINT END AS whole,
  CASE WHEN p_partkey % 5 = 3 THEN NULL WHEN p_partkey % 5 = 0 THEN c::DOUBLE WHEN p_partkey % 5 = 4 THEN (CASE WHEN c >= 100000 THEN (c // 100) / 1000.0 ELSE c // 100 END)::DOUBLE ELSE (c / 100.0)::DOUBLE END AS faithful FROM c""")
def norm_decimal(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    i, f = F.floor(cents / 100).cast("long"), cents % 100
    th, rest = F.floor(i / 1000).cast("long"), i % 1000
    k = F.col("p_partkey") % 5
    big = i >= 1000
    text = (
        F.when(k == 0, F.format_string("%d,%02d", i, f))
        .when(k == 1, F.when(big, F.format_string("%d.%03d,%02d", th, rest, f)).otherwise(F.format_string("%d.%02d", i, f)))
        .when(k == 2, F.when(big, F.format_string("%d,%03d.%02d", th, rest, f)).otherwise(F.format_string("%d.%02d", i, f)))
        .when(k == 3, F.lit("abc"))
        .otherwise(F.when(big, F.format_string("%d,%03d", th, rest)).otherwise(F.format_string("%d", i)))
    )
    rows = table(spark, sf, "part").select("p_partkey", text.alias("raw"))
    return rows.select("p_partkey", values.decimal(F.col("raw")).alias("value"), values.whole(F.col("raw")).alias("whole"), values.decimal(F.col("raw"), True).alias("faithful"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, min(CASE l_returnflag WHEN 'N' THEN 'OK' WHEN 'R' THEN 'NG' ELSE 'A' END) AS result, max(strftime(CASE WHEN l_orderkey % 4 = 2 THEN date_trunc('day', l_shipdate) ELSE date_trunc('minute', l_shipdate) END, '%Y-%m-%d %H:%M:%S')) AS ts FROM lineitem GROUP BY l_orderkey, l_linenumber")
def norm_result_timestamp(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = F.when(F.col("l_returnflag") == "N", " pass").when(F.col("l_returnflag") == "R", "Fail ").otherwise("a")
    k, t = F.col("l_orderkey") % 4, F.col("l_shipdate")
    text = F.when(k == 0, F.date_format(t, "dd/MM/yyyy HH:mm")).when(k == 1, F.date_format(F.date_trunc("minute", t), "dd/MM/yyyy HH:mm:ss")).when(k == 2, F.date_format(t, "dd/MM/yyyy")).otherwise(F.date_format(F.date_trunc("minute", t), "yyyy-MM-dd HH:mm:ss"))
    rows = li.select("l_orderkey", "l_linenumber", values.result(raw).alias("r"), F.date_format(values.timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("t"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("result"), F.max("t").alias("ts"))


@query("SELECT o_orderkey::VARCHAR AS order_raw, o_orderstatus AS status_raw, NULL::VARCHAR AS note_raw, 'a' AS sheet FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey::VARCHAR, o_orderstatus, NULL, 'b' FROM orders WHERE o_orderkey % 2 = 1")
def schema_map_union(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"))
    a = o.where("int(k) % 2 = 0").select(F.col("k").alias("order_no"), F.col("s").alias("status"), F.lit("a").alias("sheet"))
    b = o.where("int(k) % 2 = 1").select(F.col("k").alias("Mã đơn"), F.col("s").alias("state"), F.lit("b").alias("sheet"))
    return mapping.map_columns(readers.union_all([a, b]), {"order_raw": ("order_no", "Mã đơn"), "status_raw": ("status", "state"), "note_raw": ("note",)})


@query("SELECT 'qty_raw' AS \"column\", count(*) AS n_input, count(*) FILTER (o_orderkey % 5 <> 0) AS n_output, count(*) FILTER (o_orderkey % 5 = 0) AS n_failed FROM orders UNION ALL SELECT 'order_ref_raw', count(*), count(*), 0 FROM orders")
def normalise_audit(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(F.when(k % 5 == 0, "n/a").otherwise(k.cast("string")).alias("qty_raw"), F.format_string("JT-%04d", k).alias("order_ref_raw"))
    return mapping.normalise_audit(mapping.normalise(raw))


@query("SELECT 'b' AS \"column\", count(*) FILTER (o_orderkey % 7 = 0) AS n_null FROM orders UNION ALL SELECT 'gone', count(*) FROM orders")
def contract_check(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 7 != 0, "x").alias("b"))
    return mapping.contract(rows, ["a", "b", "gone"])


@query(sql("lots", "SELECT lot_id, product, station, mat_lot, qty, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, is_ng FROM lots"))
def dedupe_lots(spark, sf):
    return lots(spark, sf).select("lot_id", "product", "station", "mat_lot", "qty", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), "is_ng")


@query("SELECT o_custkey AS custkey, min(o_orderkey) AS orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1 GROUP BY o_custkey")
def first_order(spark, sf):
    out = reconstruct.first_per_key(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return out.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))


@query("SELECT 3 * count(*) AS n_cells, count(*) FILTER (p_size % 7 = 0) AS n_missing, round(1 - count(*) FILTER (p_size % 7 = 0) / (3.0 * count(*)), 6) AS score FROM part")
def dq_completeness(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).otherwise("").alias("brand"))
    return quality.completeness(p, ["p_partkey", "p_name", "brand"]).withColumn("score", F.round("score", 6))


@query("SELECT 'status' AS \"check\", count(o_orderstatus) AS n, count(*) FILTER (NOT o_orderstatus IN ('O', 'F')) AS n_bad FROM orders UNION ALL SELECT 'price', count(o_totalprice), count(*) FILTER (NOT o_totalprice > 1000) FROM orders UNION ALL SELECT 'number', count(*), count(*) FILTER (o_orderkey % 3 = 0) FROM orders")
def dq_validity(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderkey").cast("string"))
    return quality.validity(o, {"status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice") > 1000, "number": text.try_cast("int").isNotNull()})


@query("SELECT sum(k)::BIGINT AS n, sum(k - 1)::BIGINT AS n_repeated, round(1 - sum(k - 1) / sum(k), 6) AS score FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def dq_uniqueness(spark, sf):
    return quality.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n, count(*) FILTER (l.doc_id IS NOT NULL) AS n_found, round(count(*) FILTER (l.doc_id IS NOT NULL) / count(*), 6) AS score FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NOT NULL")
def dq_fk(spark, sf):
    return quality.referential(table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), "doc_id").withColumn("score", F.round("score", 6))


@query("WITH r AS (SELECT unnest([o_custkey, o_custkey + 100000]) AS k FROM orders) SELECT count(*) AS n, count(c_custkey) AS n_found, round(count(c_custkey) / count(*), 6) AS score FROM r LEFT JOIN customer ON k = c_custkey")
def dq_fk_list(spark, sf):
    o = table(spark, sf, "orders").select(F.array("o_custkey", F.col("o_custkey") + 100000).alias("ks"))
    return quality.referential(o, "ks", table(spark, sf, "customer"), "c_custkey").withColumn("score", F.round("score", 6))


@query("""SELECT l_orderkey, "column", rule, count(*) AS n FROM (
  SELECT l_orderkey, 'l_shipdate' AS "column", 'ships after order' AS rule FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
  UNION ALL SELECT l_orderkey, 'l_discount', 'small discount' FROM lineitem WHERE NOT l_discount <= 0.08) GROUP BY ALL""")
def dq_rules(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = quality.issues(rows, "l_orderkey", {"ships after order": ("l_shipdate", F.col("l_shipdate") >= F.col("o_orderdate")), "small discount": ("l_discount", F.col("l_discount") <= 0.08)})
    return found.groupBy("l_orderkey", "column", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, round(date_diff('second', max(ts), TIMESTAMP '2026-10-10 12:00:00') / 86400.0, 3) AS age_days FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def dq_timeliness(spark, sf):
    out = quality.timeliness(table(spark, sf, "events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts")), "ts", "2026-10-10 12:00:00")
    return out.select(F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), F.round("age_days", 3).alias("age_days"))


@query("""WITH c AS (SELECT 1 - count(*) FILTER (p_size % 7 = 0) / (3.0 * count(*)) AS a FROM part), u AS (SELECT 1 - sum(k - 1) / sum(k) AS b FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber))
SELECT round((0.6 * a + 0.4 * b) / 1.0, 6) AS score FROM c, u""")
def dq_score(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).otherwise("").alias("brand"))
    a = quality.completeness(p, ["p_partkey", "p_name", "brand"]).select(F.col("score").alias("a"))
    b = quality.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.col("score").alias("b"))
    dims = a.join(F.broadcast(b), F.lit(True)).withColumn("c", F.lit(None).cast("double"))  # one row each
    return quality.weighted_score(dims, {"a": 0.6, "b": 0.4, "c": 0.3}).select(F.round("score", 6).alias("score"))


@query("""SELECT 'lineitem has order' AS rule, count(*) AS n_bad, count(*) = 0 AS passed FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'order date before ship date', count(*), count(*) = 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'quantity positive', count(*), count(*) = 0 FROM lineitem WHERE l_quantity <= 0""")
def validator_rules(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    return quality.validator({"lineitem has order": li.join(o, on, "left_anti"), "order date before ship date": li.join(o, on).where("l_shipdate < o_orderdate"), "quantity positive": li.where("l_quantity <= 0")})


@query("SELECT station_id, strftime(day, '%Y-%m-%d') AS day, event_id AS row_id, n_same FROM (SELECT user_id AS station_id, date_trunc('day', ts) AS day, event_id, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS n_same FROM events WHERE event_type = 'error') WHERE n_same > 1")
def duplicate_incidents(spark, sf):
    i = incidents(spark, sf).select("station_id", F.date_format("start_ts", "yyyy-MM-dd").alias("day"), F.col("case_id").alias("row_id"))
    return quality.duplicates(i, ["station_id", "day"], "row_id")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders), n AS (SELECT l_orderkey AS k, max(l_linestatus) AS status FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.status, o.status) AS status, o.price AS price FROM o FULL JOIN n ON o.k = n.k""")
def upsert_merge(spark, sf):
    """All orders, whose status their line items know better; orders without line items keep theirs."""
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("status"))
    return mapping.upsert(old, new, "k")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001')")
def text_filter(spark, sf):
    return dashboard.text_filter(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), "#00000001").toDF("c_custkey", "c_name")


@query("SELECT 'both' AS op, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_ops(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    both = o.intersect(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))).select(F.lit("both").alias("op"), "k")
    return both.unionByName(c.select(F.col("c_custkey").alias("k")).subtract(o).select(F.lit("only").alias("op"), "k"))


@query("SELECT event_id, unnest(list_filter([trim(x) FOR x IN string_split('LOT-' || event_id || ', LOT-' || user_id || ',,', ',')], lambda x: x <> '')) AS lot_id FROM events WHERE event_type = 'error'")
def list_split(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select("event_id", F.explode(values.listed(F.format_string("LOT-%d, LOT-%d,,", "event_id", "user_id"))).alias("lot_id"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page(spark, sf):
    return dashboard.page(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 2, 50).select("o_orderkey")


@query("SELECT o_orderkey, substr(md5(o_orderkey || '|' || o_custkey || '|' || coalesce(o_orderpriority, '')), 1, 12) AS row_hash FROM orders")
def row_hash(spark, sf):
    return readers.row_hash(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select("o_orderkey", F.col("_row_hash").alias("row_hash"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
