"""Relational queries over the star schema and the event table.

Most statements run unchanged on either engine; where the dialects part, a pair is given.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(text):
    def query(spark, sf_dir):
        return spark.sql(text, **{name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text})

    return query


#: name -> one statement, or (Spark, DuckDB); tables stand in braces.
STATEMENTS: dict[str, str | tuple[str, str]] = {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "revenue_forecast": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM {lineitem}
WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""",
    "region_revenue": """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
GROUP BY r_name, n_name""",
    "customers_with_big_orders": """
SELECT c_custkey, c_mktsegment FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)""",
    "customers_without_orders": """
SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)""",
    "above_average_orders": """
SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o2.o_totalprice) FROM {orders} o2 WHERE o2.o_custkey = o.o_custkey)""",
    "sales_rollup": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sales_cube": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "grouping_sets": """
SELECT p_brand, p_type, CAST(grouping(p_brand) AS INT) AS g_brand, CAST(grouping(p_type) AS INT) AS g_type, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_type), ())""",
    "distinct_aggregates": """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM {lineitem} GROUP BY l_returnflag""",
    "ranking_windows": """
SELECT c_custkey, c_nationkey, rank() OVER w AS rnk, dense_rank() OVER w AS drnk, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn,
  ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quartile, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)""",
    "moving_windows": """
SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
  lag(o_orderkey) OVER w AS prev_order, lead(o_orderkey) OVER w AS next_order, first_value(o_orderkey) OVER w AS first_order,
  last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_order
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "range_frame": """
SELECT p_partkey, p_size, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {part}""",
    "top_parts_by_brand": """
SELECT p_brand, p_partkey, revenue, rn FROM (
  SELECT p_brand, p_partkey, revenue, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS rn FROM (
    SELECT p_brand, p_partkey, round(sum(l_extendedprice), 2) AS revenue FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY p_brand, p_partkey) t) u
WHERE rn <= 3""",
    "nations_of_both": "SELECT c_nationkey AS nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "nations_without_suppliers": "SELECT n_nationkey AS nationkey FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier}",
    "union_of_keys": "SELECT c_nationkey AS nationkey FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "intersect_all": "SELECT c_nationkey AS nationkey FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "except_all": "SELECT c_nationkey AS nationkey FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "union_all_counts": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}) t GROUP BY k",
    "status_pivot": """
SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p
FROM {orders} GROUP BY o_orderpriority""",
    "unpivot_parts": """
SELECT p_partkey, 'size' AS attribute, CAST(p_size AS DOUBLE) AS v FROM {part} UNION ALL SELECT p_partkey, 'price' AS attribute, p_retailprice AS v FROM {part}""",
    "event_json": (
        "SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM {events} GROUP BY event_type",
        "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM {events} GROUP BY event_type",
    ),
    "monthly_orders": """
SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price FROM {orders}
GROUP BY extract(YEAR FROM o_orderdate), extract(MONTH FROM o_orderdate)""",
    "price_percentiles": (
        "SELECT p_brand, round(percentile(p_retailprice, 0.5), 4) AS p50, round(percentile(p_retailprice, 0.9), 4) AS p90 FROM {part} GROUP BY p_brand",
        "SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.9), 4) AS p90 FROM {part} GROUP BY p_brand",
    ),
    "latency_percentiles": (
        "SELECT event_type, round(percentile(value, 0.5), 4) AS p50, round(percentile(value, 0.95), 4) AS p95, round(percentile(value, 0.99), 4) AS p99 FROM {events} GROUP BY event_type",
        "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM {events} GROUP BY event_type",
    ),
    "event_hours": (
        "SELECT date_trunc('HOUR', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY date_trunc('HOUR', ts), event_type",
        "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY date_trunc('hour', ts), event_type",
    ),
    "gap_sessions": (
        """SELECT user_id, session, min(ts) AS s_start, max(ts) AS s_end, count(*) AS n FROM (
  SELECT user_id, ts, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new_s FROM {events}) a) b
GROUP BY user_id, session""",
        """SELECT user_id, session::BIGINT AS session, min(ts) AS s_start, max(ts) AS s_end, count(*) AS n FROM (
  SELECT user_id, ts, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new_s FROM {events}) a) b
GROUP BY user_id, session""",
    ),
    "order_text_functions": """
SELECT c_custkey, upper(substring(c_name, 1, 8)) AS head, length(c_name) AS n, concat(c_mktsegment, '-', CAST(c_nationkey AS STRING)) AS tag, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'other') AS seg,
  CAST(floor(c_acctbal) AS BIGINT) AS bal, round(sqrt(abs(c_acctbal)), 6) AS root FROM {customer}""",
    "case_buckets": """
SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price FROM {lineitem}
GROUP BY CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END""",
    "supplier_parts_outer": """
SELECT s.s_suppkey, count(l.l_orderkey) AS n, round(coalesce(sum(l.l_quantity), 0), 2) AS qty FROM {supplier} s LEFT JOIN {lineitem} l ON s.s_suppkey = l.l_suppkey AND l.l_returnflag = 'R' GROUP BY s.s_suppkey""",
    "full_outer_nations": """
SELECT coalesce(c.k, s.k) AS nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) c
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s ON c.k = s.k""",
}


def range_join(spark, sf_dir):
    """Orders against ten price bands by a range condition: bands are turned into an equality on their number, so there is no nested loop."""
    orders = table(spark, sf_dir, "orders")
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 60000.0).alias("low"), ((F.col("id") + 1) * 60000.0).alias("high"))
    j = orders.withColumn("band", F.floor(F.col("o_totalprice") / 60000.0)).join(bands, "band")
    return j.where((F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def asof_purchase_view(spark, sf_dir):
    """For each purchase the user's last view before or at it: one window over the union, no join of pairs."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    w = W.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id")
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "user_id", "view_id")


def interval_join(spark, sf_dir):
    """Errors with the clicks of the same user in the ten minutes before: hour buckets make it an equality join."""
    e = table(spark, sf_dir, "events")
    err = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("error_ts"))
    err = err.withColumn("b", F.explode(F.array_distinct(F.array(F.date_trunc("hour", "error_ts"), F.date_trunc("hour", F.col("error_ts") - F.expr("INTERVAL 10 MINUTES"))))))
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts", F.date_trunc("hour", "ts").alias("b"))
    return err.join(clicks, ["user_id", "b"]).where("ts <= error_ts AND ts >= error_ts - INTERVAL 10 MINUTES").select("error_id", "click_id", "user_id")


QUERIES = {k: run_sql(v if isinstance(v, str) else v[0]) for k, v in STATEMENTS.items()} | {"range_join": range_join, "asof_purchase_view": asof_purchase_view, "interval_join": interval_join}
ORACLES = {k: (v if isinstance(v, str) else v[1]).replace("{", "").replace("}", "").replace("AS STRING", "AS VARCHAR") for k, v in STATEMENTS.items()} | {
    "range_join": "SELECT b.band, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN (SELECT range AS band, range * 60000.0 AS low, (range + 1) * 60000.0 AS high FROM range(10)) b ON o_totalprice >= low AND o_totalprice < high GROUP BY b.band",
    "asof_purchase_view": "SELECT p.event_id, p.user_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id",
    "interval_join": "SELECT e.event_id AS error_id, c.event_id AS click_id, e.user_id FROM events e JOIN events c ON e.user_id = c.user_id AND c.event_type = 'click' AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 10 MINUTE WHERE e.event_type = 'error'",
}
