"""Operators on any table, against plain Python on small inputs."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from emberlog.operators import concurrency, selection, topshare
from emberlog.operators.concurrency import interval_concurrency, own_counts
from emberlog.operators.dedup import latest_by_key
from emberlog.operators.distribution import Spread, distribution_profile
from emberlog.operators.idlists import explode_id_list
from emberlog.operators.peers import peer_load
from emberlog.operators.rollup import chart_series, counters
from emberlog.operators.rules import bottleneck_rules, classify, severity_order
from emberlog.operators.selection import exact_quantiles
from emberlog.operators.topshare import top_tile, top_tile_mean


def pairwise(rows):
    """The definition: other ids of the key open at the start, ends included."""
    return [
        (
            key, number, start, end,
            0 if start is None or key is None else sum(
                k == key and n != number and s is not None and s <= start
                and (e is None or e >= start)
                for k, n, s, e in rows
            ),
        )
        for key, number, start, end in rows
    ]


@pytest.mark.parametrize(("seed", "width"), [(1, 1), (2, 7), (3, 64), (4, 1 << 22)])
def test_concurrency_equals_its_definition(spark, seed, width):
    draw = random.Random(seed)
    rows = []
    for _ in range(300):
        start = draw.randrange(-50, 100)
        # Some end before they start, some never end, some ids repeat, one key is hot.
        end = draw.choice([None, start + draw.randrange(-5, 40), start, start + 3])
        rows.append(("hot" if draw.random() < 0.7 else "cold", draw.randrange(200), start, end))
    df = spark.createDataFrame(rows, "k string, id int, s long, e long")
    got = interval_concurrency(df, ["k"], "id", "s", "e", "n", bucket_width=width).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(pairwise(rows), key=repr)


@pytest.mark.parametrize("width", [3, 1 << 22])
def test_concurrency_of_hot_ids_by_buckets(spark, monkeypatch, width):
    """An id with most of the intervals is counted by buckets, the others in windows."""
    monkeypatch.setattr(concurrency, "MOST_IN_WINDOW", 20)
    draw = random.Random(11)
    rows = []
    for _ in range(400):
        start = draw.choice([None, *range(60)])
        end = None if start is None else draw.choice([None, start + draw.randrange(-5, 30)])
        number = 7 if draw.random() < 0.7 else draw.randrange(100)
        rows.append((draw.choice(["hot", "hot", "cold", None]), number, start, end))
    df = spark.createDataFrame(rows, "k string, id int, s long, e long")
    ways = [own_counts(df, ["k", "id"], "s", "e", width, n).where("s IS NOT NULL AND k IS NOT NULL")
            for n in (0, 20, 10**9)]
    first, *others = [sorted(map(tuple, way.collect()), key=repr) for way in ways]
    assert others == [first, first]
    got = interval_concurrency(df, ["k"], "id", "s", "e", "n", bucket_width=width).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(pairwise(rows), key=repr)


def test_concurrency_of_unique_ids(spark):
    draw = random.Random(6)
    rows = []
    for number in range(200):
        start = draw.randrange(50)
        end = draw.choice([None, start + draw.randrange(-5, 20)])
        rows.append((draw.choice("ab"), number, start, end))
    df = spark.createDataFrame(rows, "k string, id int, s long, e long")
    got = interval_concurrency(
        df, ["k"], "id", "s", "e", "n", bucket_width=8, unique_ids=True
    ).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(pairwise(rows), key=repr)


def test_concurrency_of_null_starts_and_keys(spark):
    rows = [("a", 1, None, 5), (None, 2, 1, 5), (None, 3, 1, 5), ("a", 4, 1, None), ("a", 5, 2, 2)]
    df = spark.createDataFrame(rows, "k string, id int, s long, e long")
    got = {r["id"]: r["n"] for r in interval_concurrency(df, ["k"], "id", "s", "e", "n").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


@pytest.mark.parametrize("leading", [None, "v"])
@pytest.mark.parametrize(
    ("rows", "tiles"), [(1, 20), (7, 20), (20, 20), (101, 10), (999, 20), (50, 1)]
)
def test_top_tile_is_the_first_ntile(spark, rows, tiles, leading):
    df = spark.range(rows).select("id", (F.col("id") % 13).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    got = sorted(r["id"] for r in top_tile(df, order, tiles, leading).collect())
    ranked = sorted(range(rows), key=lambda i: (-(i % 13), i))
    assert got == sorted(ranked[: math.ceil(rows / tiles)])


@pytest.mark.parametrize("leading", [None, "v"])
def test_top_tile_when_all_values_tie(spark, leading):
    df = spark.range(1000).select("id", F.lit(1).alias("v"))
    (row,) = top_tile_mean(df, "id", [F.desc("v"), F.asc("id")], 10, "m", leading).collect()
    assert row["m"] == sum(range(100)) / 100


@pytest.mark.parametrize("leading", [None, "v"])
def test_top_tile_of_nothing(spark, leading):
    df = spark.range(0).select("id", F.lit(1).alias("v"))
    (row,) = top_tile_mean(df, "v", [F.desc("v"), F.asc("id")], 10, "m", leading).collect()
    assert row["m"] is None


def test_top_tile_orders_few_rows(spark, monkeypatch):
    ordered = []
    plain = topshare.first_rows
    monkeypatch.setattr(
        topshare, "first_rows", lambda df, order, n: ordered.append(df.count()) or plain(df, order, n)
    )
    rows = 200_000
    df = spark.range(0, rows, 1, 8).selectExpr("id", "cast(id * 7919 % 100003 AS double) / 3 AS v")
    got = top_tile(df, [F.desc("v"), F.asc("id")], 20, "v")
    assert got.count() == rows // 20 and ordered[0] < rows // 500
    expected = df.orderBy(F.desc("v"), "id").limit(rows // 20)
    total = F.sum(F.xxhash64("id", "v").cast("decimal(38,0)"))
    assert got.agg(total).first() == expected.agg(total).first()


def test_top_tile_when_the_sketch_is_off(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile_approx", lambda v, r, n: F.array(F.max(v), F.max(v)))
    df = spark.range(100).select("id", (F.col("id") % 13).alias("v"))
    got = sorted(r["id"] for r in top_tile(df, [F.desc("v"), F.asc("id")], 10, "v").collect())
    assert got == sorted(sorted(range(100), key=lambda i: (-(i % 13), i))[:10])


def test_distribution(spark):
    draw = random.Random(5)
    values = {k: [draw.randrange(1000) for _ in range(n)] for k, n in (("a", 1), ("b", 500))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    fractions = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = distribution_profile(
        df, ["k"], [Spread("v", fractions, "lo", "hi", "mean")],
        [F.count(F.lit(1)).alias("n")],
    )
    assert got.columns == ["k", "p50", "p95", "p99", "lo", "hi", "mean", "n"]
    for row in got.collect():
        ordered = sorted(values[row["k"]])
        for name, fraction in fractions.items():
            assert row[name] == ordered[math.ceil(fraction * len(ordered)) - 1]
        assert (row["lo"], row["hi"], row["n"]) == (ordered[0], ordered[-1], len(ordered))
        assert row["mean"] == pytest.approx(statistics.mean(ordered))


def test_distribution_ignores_nulls_and_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 3), ("b", None)], "k string, v long")
    got = distribution_profile(df, ["k"], [Spread("v", {"p50": 0.5}, high="hi")])
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", None, None), ("b", 3, 3)]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_exact_quantiles(spark, monkeypatch, bits):
    monkeypatch.setattr(selection, "DIGIT_BITS", bits)
    draw = random.Random(bits)
    groups = {
        "a": [draw.randrange(-(10**4), 10**4) for _ in range(500)],
        "b": [7], "c": [5, 5, 5, -3], None: [draw.randrange(3) for _ in range(90)],
    }
    rows = [(k, v, None if v % 2 else 2 * v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame([*rows, ("d", None, None)], "k string, v long, w int")
    fractions = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {
        (r.k, r.measure, r.fraction): r.value
        for r in exact_quantiles(df, ["k"], {"v": fractions, "w": [0.5]}).collect()
    }
    expected = {}
    for k, vs in groups.items():
        evens = [2 * v for v in vs if v % 2 == 0]
        for name, values, some in (("v", vs, fractions), ("w", evens, [0.5])):
            for f in some if values else ():
                expected[k, name, f] = sorted(values)[max(math.ceil(f * len(values)), 1) - 1]
    assert got == expected


def test_profile_of_a_stage_of_a_million_tasks_is_exact(spark):
    df = spark.range(0, 1_000_000, 1, 8).selectExpr(
        "if(id % 50 = 0, 'small', 'large') AS k", "id * 7919 % 1000003 * 11 AS v"
    )
    fractions = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p9999": 0.9999}
    profile = distribution_profile(
        df, ["k"], [Spread("v", fractions, high="hi")], [F.count("v").alias("n")], exact=True
    )
    assert profile.columns == ["k", *fractions, "hi", "n"]
    values = {k: sorted(r.v for r in df.where(f"k = '{k}'").collect()) for k in ("small", "large")}
    for row in profile.collect():
        ordered = values[row["k"]]
        assert (row["hi"], row["n"]) == (ordered[-1], len(ordered))
        for name, fraction in fractions.items():
            assert row[name] == ordered[math.ceil(fraction * len(ordered)) - 1]


def test_few_values_are_put_in_order_and_not_sketched(spark, monkeypatch):
    draw = random.Random(11)
    groups = {"a": 300, "b": 40, None: 39, "c": 1, "d": 41}
    rows = [
        (k, draw.choice([None, draw.randrange(-50, 50)]), draw.randrange(9))
        for k, n in groups.items()
        for _ in range(n)
    ]
    df = spark.createDataFrame([*rows, ("e", None, 1)], "k string, v long, w int")
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    spreads = [Spread("v", fractions, "lo", "hi", "mean"), Spread("w", {"w50": 0.5})]

    def profile():
        return distribution_profile(df, ["k"], spreads, [F.sum("w").alias("s")], exact=True)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    few = profile()
    assert "percentile_approx" not in plan(few)
    monkeypatch.setattr("emberlog.operators.distribution.SKETCH_ROWS", 40)
    for made in (few, profile()):
        got = {row["k"]: row for row in made.collect()}
        assert len(got) == made.count() == 6
        for k, row in got.items():
            own = [r for r in [*rows, ("e", None, 1)] if r[0] == k]
            values = sorted(v for _, v, _ in own if v is not None)
            for name, fraction in fractions.items():
                place = max(math.ceil(fraction * len(values)), 1) - 1
                assert row[name] == (values[place] if values else None)
            assert (row["lo"], row["hi"]) == ((values[0], values[-1]) if values else (None, None))
            assert row["mean"] == (pytest.approx(statistics.mean(values)) if values else None)
            others = sorted(w for _, _, w in own)
            assert row["w50"] == others[math.ceil(0.5 * len(others)) - 1]
            assert row["s"] == sum(others)


def test_peer_load(spark):
    loads = {"a": [10, 20, 60], "b": [5], "c": [0, 0]}
    rows = [(g, i, v) for g, vs in loads.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    got = {(r["g"], r["i"]): r for r in peer_load(df, ["g"], "v", "mean").collect()}
    mean, spread = statistics.mean(loads["a"]), statistics.stdev(loads["a"])
    for i, v in enumerate(loads["a"]):
        assert got["a", i]["load_vs_avg"] == round(v / mean, 2)
        assert got["a", i]["z_score"] == round((v - mean) / spread, 2)
    assert [got["a", i]["is_straggler"] for i in range(3)] == [False, False, True]
    assert [got["a", i]["is_underutilized"] for i in range(3)] == [True, False, False]
    assert (got["b", 0]["z_score"], got["b", 0]["load_vs_avg"]) == (None, 1.0)
    assert (got["c", 0]["load_vs_avg"], got["c", 0]["is_straggler"]) == (None, None)


def test_latest_by_key(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, "w"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    got = latest_by_key(df, ["k"], ["at", "v"]).collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 3, "z"), ("b", 2, "w"), (None, 1, "n")]
    # NULL is oldest.
    rows = [("a", None, "x"), ("a", 1, None), ("b", None, "y")]
    df = spark.createDataFrame(rows, "k string, at int, `v w` string")
    got = latest_by_key(df, ["k"], ["at"]).collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 1, None), ("b", None, "y")]


def test_id_lists(spark):
    rows = [(1, "[3,4]"), (2, "[]"), (3, None), (4, "oops"), (5, "[6]")]
    df = spark.createDataFrame(rows, "k int, ids string")
    got = explode_id_list(df, ["k"], "ids", "id").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (1, 4), (5, 6)]


def test_rules_are_total_and_exclusive(spark):
    names = ["status", "disk_bytes_spilled", "gc_overhead_pct", "task_skew_ratio",
             "shuffle_read_bytes", "memory_bytes_spilled"]
    draw = random.Random(9)
    rows = [
        (
            draw.choice(["FAILED", "COMPLETED", None]), draw.choice([None, 0, 1]),
            draw.choice([None, 5.0, 15.0, 25.0]), draw.choice([None, 1.0, 9.0]),
            draw.choice([None, 1, 20 * 1024**3]), draw.choice([None, 0, 1]),
        )
        for _ in range(400)
    ]
    df = spark.createDataFrame(
        rows, ", ".join(f"{n} {t}" for n, t in zip(names, "string long double double long long".split()))
    )
    rules = bottleneck_rules()
    hits = [F.coalesce(c, F.lit(False)).alias(f"_{n}") for n, c in rules]
    for row in classify(df).select("*", *hits).collect():
        first = next((name for name, _ in rules if row[f"_{name}"]), "OK")
        assert row["bottleneck_type"] == first
        assert row["severity"] is not None and row["recommendation"] is not None


def test_severity_order(spark):
    df = spark.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",), ("NONE",), (None,)], "severity string")
    assert [r[0] for r in df.select(severity_order()).collect()] == [1, 2, 3, 3, 3]


def test_counters_and_series(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 5), ("b", "y", None)], "x string, c string, v int")
    got = counters(df, {"s": ("SUM", "v"), "m": ("MAX", "v"), "a": ("AVG", "v"), "n": ("COUNT", "v")})
    assert tuple(got.first()) == (6, 5, 3.0, 3)
    assert sorted(map(tuple, chart_series(df, "x", "c", "v", "MAX").collect())) == [
        ("a", "x", 5), ("b", "y", None),
    ]
