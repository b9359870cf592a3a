"""SQL answers for the operators on the tables themselves."""

from __future__ import annotations

from checks.oracle_logs import ADVICE


def _top(tiles: int, output: str) -> str:
    return f"""
SELECT avg(measure) AS {output} FROM (
    SELECT o_custkey % 100 AS measure,
           ntile({tiles}) OVER (ORDER BY floor(o_totalprice) DESC, o_orderkey) AS tile
    FROM orders) WHERE tile = 1
"""


TABLES = {
    "task_distribution": """
SELECT l_orderkey, quantile_disc(price, 0.5) AS p50, quantile_disc(price, 0.75) AS p75,
       quantile_disc(price, 0.95) AS p95, quantile_disc(price, 0.99) AS p99,
       min(price) AS lowest, max(price) AS highest, avg(price) AS average, count(*) AS items,
       CASE WHEN quantile_disc(price, 0.5) > 0
            THEN round(max(price) / quantile_disc(price, 0.5), 2) END AS skew_ratio,
       max(price) - quantile_disc(price, 0.5) AS skew_gap
FROM (SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem)
GROUP BY l_orderkey
""",
    "data_skew": """
SELECT l_suppkey, round(lo / 1048576.0::DOUBLE, 2) AS min_mb,
       round(med / 1048576.0::DOUBLE, 2) AS p50_mb, round(hi / 1048576.0::DOUBLE, 2) AS max_mb,
       CASE WHEN med > 0 THEN round(hi / med, 2) END AS skew_ratio,
       round((hi - lo) / 1048576.0::DOUBLE, 2) AS gap_mb,
       round((hi - med) / 1048576.0::DOUBLE, 2) AS gap_p50_mb
FROM (SELECT l_suppkey, min(b) AS lo, max(b) AS hi, quantile_disc(b, 0.5) AS med
      FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) * 1000003 + l_partkey * 1009 AS b
            FROM lineitem) GROUP BY l_suppkey)
""",
    "exact_percentiles": """
        WITH items AS (
            SELECT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag,
                CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                CASE WHEN l_quantity > 2 THEN -CAST(trunc(l_quantity) AS BIGINT) END AS lack
            FROM lineitem
        ), placed AS (
            SELECT *,
                row_number() OVER (PARTITION BY flag ORDER BY cents) AS c,
                row_number() OVER (PARTITION BY flag, lack IS NULL ORDER BY lack) AS l,
                count(*) OVER (PARTITION BY flag) AS n,
                count(lack) OVER (PARTITION BY flag) AS m
            FROM items
        )
        SELECT flag,
            max(CASE WHEN c = ceil(0.01 * n) THEN cents END) AS p1,
            max(CASE WHEN c = ceil(0.5 * n) THEN cents END) AS p50,
            max(CASE WHEN c = ceil(0.999 * n) THEN cents END) AS p999,
            max(cents) AS most,
            max(CASE WHEN lack IS NOT NULL AND l = ceil(0.25 * m) THEN lack END) AS lack_p25,
            max(lack) AS lack_p100
        FROM placed GROUP BY flag
    """,
    "peer_load": """
WITH e AS (
    SELECT s_suppkey, s_nationkey, count(*) AS items,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_nationkey),
w AS (
    SELECT *, avg(quantity) OVER (PARTITION BY s_nationkey) AS nation_mean,
           stddev_samp(quantity) OVER (PARTITION BY s_nationkey) AS spread FROM e),
r AS (
    SELECT s_suppkey, s_nationkey, items, quantity, nation_mean,
           CASE WHEN nation_mean > 0 THEN round(quantity / nation_mean, 2) END AS load_vs_avg,
           CASE WHEN spread > 0 THEN round((quantity - nation_mean) / spread, 2) END AS z_score
    FROM w)
SELECT *, load_vs_avg > 1.5 AS is_straggler, load_vs_avg < 0.5 AS is_underutilized FROM r
""",
    "interval_concurrency": """
WITH i AS (
    SELECT o_custkey % 25 AS lane, o_orderkey, epoch_ms(o_orderdate) AS begins,
           CASE WHEN o_orderstatus <> 'O'
                THEN epoch_ms(o_orderdate) + o_orderkey % 40 * 86400000 END AS ends
    FROM orders)
SELECT a.lane, a.o_orderkey, a.begins, a.ends, count(b.o_orderkey) AS others
FROM i a LEFT JOIN i b
  ON a.lane = b.lane AND a.o_orderkey <> b.o_orderkey AND b.begins <= a.begins
 AND (b.ends IS NULL OR b.ends >= a.begins)
GROUP BY a.lane, a.o_orderkey, a.begins, a.ends
""",
    "lifecycle_pivot": """
SELECT user_id, min(epoch_us(ts)) FILTER (WHERE event_type = 'signup') AS first_signup,
       max(epoch_us(ts)) FILTER (WHERE event_type = 'error') AS last_error,
       max(value) FILTER (WHERE event_type = 'purchase') AS largest_purchase
FROM events GROUP BY user_id
""",
    "conditional_rollup": """
SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
       count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS partial,
       round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) * 100, 1) AS finished_rate
FROM orders GROUP BY o_custkey
""",
    "distinct_by_key": """
SELECT user_id, event_type, event_id, epoch_us(ts) AS at, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                 ORDER BY ts DESC, event_id DESC) AS place FROM events)
WHERE place = 1
""",
    "json_extract": """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""",
    "left_chain": """
WITH i AS (SELECT l_orderkey, count(*) AS items,
                  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
           FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_custkey, count(*) AS orders, CAST(sum(items) AS BIGINT) AS items,
             CAST(sum(quantity) AS BIGINT) AS quantity
      FROM orders LEFT JOIN i ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, orders, items, quantity
FROM customer LEFT JOIN c ON c_custkey = o_custkey
""",
    "explode_map": """
SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(*) AS items,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey
""",
    "classify": f"""
WITH m AS (
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0
                THEN 'FAILED' ELSE 'COMPLETED' END AS status,
           max(CAST(round(l_discount * 100) AS BIGINT)) * 2.5::DOUBLE AS gc,
           round(max(CAST(floor(l_extendedprice) AS BIGINT))
                 / min(CAST(floor(l_extendedprice) AS BIGINT)), 2) AS task_skew_ratio,
           coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_quantity > 49), 0) AS disk,
           coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_quantity > 47), 0) AS mem,
           sum(l_partkey) * 2000000 AS shuffled
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus),
c AS (
    SELECT *, CASE WHEN status = 'FAILED' THEN 'STAGE_FAILURE' WHEN disk > 0 THEN 'DISK_SPILL'
                   WHEN gc > 20 THEN 'HIGH_GC' WHEN task_skew_ratio > 5 THEN 'DATA_SKEW'
                   WHEN shuffled > 10737418240 THEN 'HEAVY_SHUFFLE'
                   WHEN mem > 0 THEN 'MEMORY_SPILL' WHEN gc > 10 THEN 'MODERATE_GC'
                   ELSE 'OK' END AS bottleneck_type FROM m),
advice(bottleneck_type, severity, recommendation) AS (VALUES {ADVICE})
SELECT o_orderkey, status, task_skew_ratio, bottleneck_type, severity, recommendation,
       CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS severity_order
FROM c JOIN advice USING (bottleneck_type) WHERE bottleneck_type <> 'OK'
""",
    "guarded_ratio": """
WITH g AS (
    SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
           CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
           CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount,
           CAST(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS BIGINT) AS line
    FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN tax > 0 THEN qty / tax * 100 ELSE 0.0 END AS zero_when_empty,
       CASE WHEN discount > 0 THEN qty / 1e6 / discount * 100 END AS null_when_empty,
       CASE WHEN line > 0 THEN qty / line * 100 END AS null_when_missing,
       qty / greatest(line, 1) * 100 AS at_least_one
FROM g
""",
    "top_share_5": _top(20, "mean_top_5"),
    "top_share_10": _top(10, "mean_top_10"),
    "topk_desc": """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price
FROM orders ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 5
""",
    "topk_asc": """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance
FROM customer ORDER BY balance ASC NULLS LAST, c_custkey LIMIT 5
""",
    "topk_mixed": """
SELECT p_partkey, CASE WHEN p_size > 2 THEN p_size END AS size, p_retailprice
FROM part ORDER BY size ASC NULLS FIRST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 5
""",
    "order_by_case": """
SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY 1, 2
ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, cnt DESC, o_orderpriority
""",
    "sort_all": """
SELECT c_custkey, c_acctbal, c_nationkey FROM customer
ORDER BY c_acctbal DESC NULLS LAST, c_custkey
""",
    "chart_series": """
SELECT CAST(l_suppkey AS VARCHAR) AS supplier, l_returnflag, max(l_extendedprice) AS value
FROM lineitem GROUP BY 1, 2
""",
    "chart_series_count": """
SELECT l_returnflag, l_linestatus, count(l_orderkey) AS value FROM lineitem GROUP BY 1, 2
""",
    "kpi": """
SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_qty,
       avg(CAST(l_quantity AS BIGINT)) AS mean_qty, max(l_extendedprice) AS max_price,
       count(*) AS items FROM lineitem
""",
    "plan_operators": """
WITH n AS (
    SELECT p_partkey, p_name || ' ' || p_brand AS description, p_size % 3 = 0 AS fast,
           p_size > 25 AS joins FROM part)
SELECT p_partkey, description, 5 AS total, CASE WHEN fast THEN 2 ELSE 0 END AS accelerated,
       CASE WHEN fast THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS pct,
       CASE WHEN joins AND NOT fast THEN 1 ELSE 0 END AS bhj,
       CASE WHEN joins AND fast THEN 1 ELSE 0 END AS fast_bhj, 1 AS smj,
       CASE WHEN fast THEN 'Scan, SortMergeJoin, Project'
            WHEN joins THEN 'Scan, Project, BroadcastHashJoin, SortMergeJoin'
            ELSE 'Scan, Project, Sort, SortMergeJoin' END AS plain_list
FROM n
""",
    "regex_keep": r"""
WITH h AS (
    SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS host,
           coalesce(nullif(regexp_extract(url, '/([a-z]{2})/\d+', 1), ''), '?') AS lang
    FROM pages)
SELECT page_id, host, lang FROM h
WHERE host LIKE 'm.%' OR host LIKE 'blog.%' OR host LIKE '%.example.org'
""",
    "drop_bad_lines": """
SELECT 'c-0001' AS cluster_id, 'application_1_2' AS app_id, event_type, count(*) AS events
FROM events GROUP BY event_type
""",
}
