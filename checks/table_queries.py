"""The operators applied to the TPC-H-like tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapter import CLUSTER, DAY_MS, ORDERS_PER_BLOCK, day_millis, table
from emberlog.functions import plan_text as P
from emberlog.functions.metrics import (
    count_where,
    cpu_percent,
    gc_percent,
    guarded_percent,
    in_mib,
    skew_ratio,
    to_long,
)
from emberlog.operators.concurrency import interval_concurrency
from emberlog.operators.dedup import latest_by_key
from emberlog.operators.distribution import Spread, distribution_profile
from emberlog.operators.idlists import explode_id_list
from emberlog.operators.lifecycle import lifecycle_pivot
from emberlog.operators.peers import peer_load
from emberlog.operators.rollup import chart_series, counters
from emberlog.operators.rules import classify, severity_order
from emberlog.operators.topshare import top_tile_mean
from emberlog.session import reliable_checkpoint
from emberlog.sources.eventlog import tag_events

Query = Callable[[SparkSession, str], DataFrame]


def _micros(column: str) -> Column:
    """Epoch microseconds of a zoneless timestamp, whatever the session zone."""
    second = f"hour({column}) * 3600 + minute({column}) * 60 + extract(SECOND FROM {column})"
    return F.expr(
        f"unix_date(to_date({column})) * 86400000000L + cast(({second}) * 1000000 AS bigint)"
    )


def task_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.floor("l_extendedprice").alias("price")
    )
    quantiles = {"p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return distribution_profile(
        items,
        ["l_orderkey"],
        [Spread("price", quantiles, low="lowest", high="highest", mean="average")],
        extra=[F.count(F.lit(1)).alias("items")],
    ).select(
        "*",
        skew_ratio("highest", "p50").alias("skew_ratio"),
        (F.col("highest") - F.col("p50")).alias("skew_gap"),
    )


def data_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.expr("cast(l_quantity AS bigint) * 1000003 + l_partkey * 1009").alias("bytes"),
    )
    high, median = F.col("highest"), F.col("median")
    return distribution_profile(
        items, ["l_suppkey"], [Spread("bytes", {"median": 0.5}, low="lowest", high="highest")]
    ).select(
        "l_suppkey",
        in_mib("lowest", 2).alias("min_mb"),
        in_mib(median, 2).alias("p50_mb"),
        in_mib(high, 2).alias("max_mb"),
        skew_ratio(high, median).alias("skew_ratio"),
        in_mib(high - F.col("lowest"), 2).alias("gap_mb"),
        in_mib(high - median, 2).alias("gap_p50_mb"),
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplied = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        )
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    entities = suppliers.join(supplied, suppliers.s_suppkey == supplied.l_suppkey).drop(
        "l_suppkey"
    )
    # Read twice: keep the few summed rows instead of scanning the items again.
    return peer_load(
        reliable_checkpoint(entities), ["s_nationkey"], "quantity", "nation_mean"
    )


def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups far above what a sketch holds exactly."""
    items = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("flag"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.when(F.col("l_quantity") > 2, -F.col("l_quantity").cast("long")).alias("lack"),
    )
    return distribution_profile(
        items,
        ["flag"],
        [
            Spread("cents", {"p1": 0.01, "p50": 0.5, "p999": 0.999}, high="most"),
            Spread("lack", {"lack_p25": 0.25, "lack_p100": 1.0}),
        ],
        exact=True,
    )


def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.expr("o_custkey % 25").alias("lane"),
        "o_orderkey",
        day_millis("o_orderdate").alias("begins"),
        F.when(
            F.col("o_orderstatus") != "O",
            day_millis("o_orderdate") + F.col("o_orderkey") % 40 * DAY_MS,
        ).alias("ends"),
    )
    return interval_concurrency(
        orders, ["lane"], "o_orderkey", "begins", "ends", "others", unique_ids=True
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", _micros("ts").alias("at")
    )
    return lifecycle_pivot(
        events,
        ["user_id"],
        "event_type",
        {
            "first_signup": (F.min, "signup", "at"),
            "last_error": (F.max, "error", "at"),
            "largest_purchase": (F.max, "purchase", "value"),
        },
    )


def conditional_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count("o_orderkey").alias("orders"),
            count_where(status == "F").alias("finished"),
            count_where(status == "O").alias("open"),
            count_where((status != "F") & (status != "O")).alias("partial"),
        )
        .withColumn("finished_rate", F.round(guarded_percent("finished", "orders"), 1))
    )


def distinct_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_key(
        table(spark, sf_dir, "events"),
        ["user_id", "event_type"],
        ["ts", "event_id"],
    ).select("user_id", "event_type", "event_id", _micros("ts").alias("at"), "value")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", to_long(F.get_json_object("props", "$.k")).alias("k")
    )


def left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders and items; the items meet pre-summed orders."""
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("items").alias("items"),
            F.sum("quantity").alias("quantity"),
        )
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return customers.join(
        per_customer, customers.c_custkey == per_customer.o_custkey, "left"
    ).drop("o_custkey")


def explode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lists as JSON text, parsed, exploded and joined to summed items."""
    lists = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.expr(f"o_orderkey DIV {ORDERS_PER_BLOCK}").alias("part"))
        .agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("ids"))
    )
    pairs = explode_id_list(lists, ["o_custkey"], "ids", "l_orderkey", "bigint")
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        )
    )
    return (
        pairs.join(items, "l_orderkey")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("items").alias("items"),
            F.sum("quantity").alias("quantity"),
        )
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "l_orderkey",
            "cast(l_quantity AS bigint) AS qty",
            "cast(floor(l_extendedprice) AS bigint) AS price",
            "l_partkey",
            "cast(round(l_discount * 100) AS bigint) AS discount",
        )
        .groupBy("l_orderkey")
        .agg(
            F.max("price").alias("longest"),
            F.min("price").alias("shortest"),
            F.max("discount").alias("discount"),
            F.sum(F.when(F.col("qty") > 49, F.col("qty")).otherwise(0)).alias(
                "disk_bytes_spilled"
            ),
            F.sum(F.when(F.col("qty") > 47, F.col("qty")).otherwise(0)).alias(
                "memory_bytes_spilled"
            ),
            (F.sum("l_partkey") * 2000000).alias("shuffle_read_bytes"),
        )
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "if(o_orderstatus = 'F' AND o_orderkey % 10 = 0, 'FAILED', 'COMPLETED') AS status",
    )
    measured = orders.join(items, orders.o_orderkey == items.l_orderkey, "left").withColumns(
        {
            "gc_overhead_pct": F.col("discount") * 2.5,
            "task_skew_ratio": skew_ratio("longest", "shortest"),
        }
    )
    return (
        classify(measured)
        .where(F.col("bottleneck_type") != "OK")
        .select(
            "o_orderkey",
            "status",
            "task_skew_ratio",
            "bottleneck_type",
            "severity",
            "recommendation",
            severity_order().alias("severity_order"),
        )
    )


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "cast(l_quantity AS bigint) AS qty",
        "cast(round(l_tax * 100) AS bigint) AS tax",
        "cast(round(l_discount * 100) AS bigint) AS discount",
        "if(l_returnflag = 'R', NULL, cast(l_linenumber AS bigint)) AS line",
    )
    sums = items.groupBy("l_orderkey").agg(
        *[F.sum(c).alias(c) for c in ("qty", "tax", "discount", "line")]
    )
    return sums.select(
        "l_orderkey",
        gc_percent("qty", "tax").alias("zero_when_empty"),
        cpu_percent("qty", "discount").alias("null_when_empty"),
        guarded_percent("qty", "line").alias("null_when_missing"),
        (F.col("qty") / F.greatest("line", F.lit(1)) * 100).alias("at_least_one"),
    )


def top_share(tiles: int, output: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey"), F.floor("o_totalprice").alias("price"),
            F.expr("o_custkey % 100").alias("measure"),
        )
        order = [F.desc("price"), F.asc("o_orderkey")]
        return top_tile_mean(orders, "measure", order, tiles, output, "price")

    return query


def topk_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", price.alias("price"))
        .orderBy(F.desc_nulls_last("price"), "o_orderkey")
        .limit(5)
    )


def topk_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", balance.alias("balance"))
        .orderBy(F.asc_nulls_last("balance"), "c_custkey")
        .limit(5)
    )


def topk_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") > 2, F.col("p_size"))
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", size.alias("size"), "p_retailprice")
        .orderBy(F.asc_nulls_first("size"), F.desc_nulls_last("p_retailprice"), "p_partkey")
        .limit(5)
    )


def order_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(
            F.when(F.col("o_orderstatus") == "F", 1)
            .when(F.col("o_orderstatus") == "O", 2)
            .otherwise(3),
            F.desc("cnt"),
            "o_orderpriority",
        )
    )


def sorted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_acctbal", "c_nationkey")
        .orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("supplier"), "l_returnflag", "l_extendedprice"
    )
    return chart_series(items, "supplier", "l_returnflag", "l_extendedprice", "MAX")


def series_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return chart_series(items, "l_returnflag", "l_linestatus", "l_orderkey", "COUNT")


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("long").alias("qty"),
        "l_extendedprice",
        F.when(F.col("l_returnflag") != "N", F.col("l_orderkey")).alias("returned"),
    )
    return counters(
        items,
        {
            "total_qty": ("SUM", "qty"),
            "mean_qty": ("AVG", "qty"),
            "max_price": ("MAX", "l_extendedprice"),
            "items": ("COUNT", "returned"),
        },
    )


def plan_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan text put together from part columns, then read back."""
    fast = "if(p_size % 3 = 0, 'Photon', '')"
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        f"""concat('(1) Scan parquet\\n(2) ', {fast}, 'Project\\n(3) ', {fast},
            if(p_size > 25, 'BroadcastHashJoin', 'Sort'),
            '\\n(12) SortMergeJoin Inner\\n(13) Project\\nno (x) operator') AS plan""",
        "concat('  ', p_name, '\\n\\t ', p_brand, ' ') AS description",
    )
    names = F.col("names")
    return parts.withColumn("names", P.plan_operators("plan")).select(
        "p_partkey",
        P.squeeze_spaces("description").alias("description"),
        F.array_size(names).alias("total"),
        P.count_accelerated(names).alias("accelerated"),
        F.round(guarded_percent(P.count_accelerated(names), F.array_size(names)), 1).alias("pct"),
        P.count_named(names, P.BROADCAST_HASH_JOIN).alias("bhj"),
        P.count_named(names, P.ACCELERATED_BROADCAST_HASH_JOIN).alias("fast_bhj"),
        P.count_named(names, P.SORT_MERGE_JOIN).alias("smj"),
        P.plain_operator_list(names).alias("plain_list"),
    )


def regex_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.nullif(F.regexp_extract("url", r"^https?://([^/]+)/", 1), F.lit(""))
    language = F.nullif(F.regexp_extract("url", r"/([a-z]{2})/\d+", 1), F.lit(""))
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", host.alias("host"), F.coalesce(language, F.lit("?")).alias("lang"))
        .where(F.col("host").rlike(r"^(m|blog)\.|\.example\.org$"))
    )


def drop_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are junk lines among event lines; only the events remain."""
    good = table(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.col("event_type").alias("Event"), "user_id", "props")).alias("value")
    )
    truncated = good.select(F.expr("left(value, length(value) - 3)").alias("value"))
    junk = table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    path = F.lit(f"file:/logs/{CLUSTER}/eventlog/application_1_2/run/events")
    lines = good.unionByName(truncated).unionByName(junk).withColumn("source_file", path)
    return (
        tag_events(lines, CLUSTER)
        .groupBy("cluster_id", "app_id", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


QUERIES: dict[str, Query] = {
    "task_distribution": task_distribution,
    "data_skew": data_skew,
    "peer_load": peers,
    "exact_percentiles": exact_percentiles,
    "interval_concurrency": concurrency,
    "lifecycle_pivot": lifecycle,
    "conditional_rollup": conditional_rollup,
    "distinct_by_key": distinct_by_key,
    "json_extract": json_extract,
    "left_chain": left_chain,
    "explode_map": explode_map,
    "classify": classified,
    "guarded_ratio": guarded,
    "top_share_5": top_share(20, "mean_top_5"),
    "top_share_10": top_share(10, "mean_top_10"),
    "topk_desc": topk_desc,
    "topk_asc": topk_asc,
    "topk_mixed": topk_mixed,
    "order_by_case": order_by_case,
    "sort_all": sorted_all,
    "chart_series": series,
    "chart_series_count": series_count,
    "kpi": kpi,
    "plan_operators": plan_operators,
    "regex_keep": regex_keep,
    "drop_bad_lines": drop_bad_lines,
}
