from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows_of
from marketlens.functions import columns as C
from marketlens.functions.ordering import Buckets, down, global_row_number, running_sum
from marketlens.functions.quantiles import key_value, order_key, quantile_table, quantiles
from marketlens.functions.skew import skew_join
from marketlens.functions.staging import drop_tables, materialize, scratch_dir
from marketlens.operators.fact import order_fact, sales_fact
from marketlens.sources.tables import RetailTables

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "start, end, days",
    [
        ("2018-01-01 23:00", "2018-01-02 01:00", 0),
        ("2018-01-01 12:00", "2018-01-01 10:00", -1),
        ("2018-01-01 00:00", "2018-01-02 00:00", 1),
        ("2018-01-02 00:00", "2018-01-01 00:00", -1),
        ("2016-02-28 08:00", "2018-03-01 07:59", 731),
    ],
)
def test_elapsed_days_floor(spark, start, end, days):
    a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(start, end)], "a string, b string")
        df = df.select(F.col("a").cast(kind), F.col("b").cast(kind))
        assert df.select(C.elapsed_days("a", "b")).first()[0] == days == (b - a).days


def test_elapsed_days_of_a_microsecond(spark):
    df = spark.createDataFrame([("2018-01-02 00:00:00", "2018-01-01 23:59:59.999999")], "a string, b string")
    df = df.select(*[F.col(c).cast("timestamp_ntz") for c in "ab"])
    assert df.select(C.elapsed_days("a", "b")).first()[0] == -1


def test_sums_of_nothing(make):
    df = make([("a", None), ("b", 1.1), ("b", 2.2)], "k string, payment_value double")
    got = df.groupBy("k").agg(C.money_sum(df).alias("s"), C.money_mean(df).alias("m"), C.count_values(df, "payment_value").alias("n"))
    assert rows_of(got) == [("a", 0.0, None, 0), ("b", 3.3, 1.65, 2)]


def test_money_is_exact_and_weighted(make):
    df = make([(0.1, 3), (0.2, 1), (None, 5), (1e9, 2000)], "payment_value double, fact_rows bigint")
    got = df.agg(C.money_sum(df).alias("s"), C.count_rows(df).alias("n"), C.count_values(df, "payment_value").alias("v")).first()
    assert tuple(got) == (2e12 + 0.5, 2009, 2004)


def test_cut_is_closed_on_the_right(make):
    df = make([(v,) for v in (None, 0.0, 0.2, 0.21, 0.8, 0.81)], "v double")
    got = df.select("v", C.cut("v", (0.2, 0.8), ("Low", "Mid", "High")).alias("c"))
    assert dict(rows_of(got)) == {None: None, 0.0: "Low", 0.2: "Low", 0.21: "Mid", 0.8: "Mid", 0.81: "High"}


def test_cut_with_equal_edges_still_answers(make):
    df = make([(1.0,), (2.0,)], "v double")
    assert rows_of(df.select(C.cut("v", (1.0, 1.0), ("a", "b", "c")))) == [("a",), ("c",)]


@pytest.mark.parametrize("value", [0.125, 2.5, 1.005, -0.125, 378.085, 2.675])
def test_half_even_is_numpys(spark, value):
    assert one(spark, C.half_even("v"), v=value) == np.round(value, 2)


def test_period_keys(spark):
    ts = datetime(2018, 3, 31, 23, 59)
    assert one(spark, C.month_key("t"), t=ts) == "2018-03"
    assert one(spark, C.quarter_key("t"), t=ts) == "2018Q1"


def test_share_hash_depends_on_the_key_only(make):
    rows = [(i,) for i in range(500)]
    a = make(rows, "k bigint", 1).select("k", C.share_hash("k", 42, 10).alias("b"))
    b = make(rows, "k bigint", 7).select("k", C.share_hash("k", 42, 10).alias("b"))
    assert rows_of(a) == rows_of(b)
    assert {r["b"] for r in a.collect()} == set(range(10))


# ordering


@SLOW
@given(values=st.lists(st.integers(-5, 5), max_size=60), parts=st.integers(1, 6))
def test_row_numbers_equal_a_window(spark, values, parts):
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v bigint").repartition(parts)
    got = global_row_number(df, [down("v"), "id"], "n")
    want = df.withColumn("n", F.row_number().over(Window.orderBy(F.desc("v"), F.asc("id"))).cast("bigint"))
    assert rows_of(got.select("id", "v", "n")) == rows_of(want)


@SLOW
@given(values=st.lists(st.integers(-100, 100), max_size=60), parts=st.integers(1, 6))
def test_running_sums_equal_a_loop(spark, values, parts):
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v bigint").repartition(parts)
    got = {r["id"]: r["upto"] for r in running_sum(df, ["v", "id"], {"v": "upto"}).collect()}
    total, want = 0, {}
    for i, v in sorted(enumerate(values), key=lambda p: (p[1], p[0])):
        total += v
        want[i] = total
    assert got == want


def test_order_holds_over_many_partitions(spark):
    """Uncoalesced: every range partition has its own slots and offset."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, random.Random(i).randrange(40)) for i in range(3000)]
        df = spark.createDataFrame(rows, "id bigint, v bigint")
        numbered = global_row_number(df, ["v", "id"], "n").collect()
        assert [r["n"] for r in sorted(numbered, key=lambda r: (r["v"], r["id"]))] == list(range(1, 3001))
        summed = running_sum(df, ["v", "id"], {"v": "s"}).collect()
        assert [r["s"] for r in sorted(summed, key=lambda r: (r["v"], r["id"]))] == list(np.cumsum(sorted(v for _, v in rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# quantiles

PROBS = (0.0, 0.2, 0.25, 0.5, 0.75, 0.99, 1.0)


@SLOW
@given(values=st.lists(st.one_of(st.none(), st.integers(-20, 20)), min_size=1, max_size=80))
def test_quantiles_equal_numpy(spark, values):
    known = [v for v in values if v is not None]
    df = materialize(spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double"))
    want = [float(np.quantile(known, p)) for p in PROBS] if known else [None] * len(PROBS)
    got = quantiles(df, {"v": PROBS})["v"]
    assert got == pytest.approx(want, abs=1e-9) if known else got == want


def test_grouped_quantiles_by_rank(spark):
    rng = random.Random(3)
    # one group holds most rows and one value a third of them
    rows = [("big", 7.0 if rng.random() < 0.4 else round(rng.gauss(0, 5), 1)) for _ in range(900)]
    rows += [("small", float(v)) for v in (1, 2, 3, 4)] + [(None, 5.0), ("none", None)]
    df = materialize(spark.createDataFrame(rows, "g string, v double"))
    got = rows_of(quantile_table(df, "v", (0.25, 0.5, 0.75), ["g"]))
    whole = df.where("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", F.lit(p)) for p in (0.25, 0.5, 0.75)])
    assert got == rows_of(whole)
    assert ("small", 1.75, 2.5, 3.25) in got


# joins


@pytest.mark.parametrize("keep, how", [("big", "left"), ("small", "right"), ("neither", "inner")])
@pytest.mark.parametrize("nulls", [0, 200])
def test_skew_join_equals_the_plain_join(spark, keep, how, nulls):
    rows = [("hot", i) for i in range(300)] + [(f"k{i % 50}", i) for i in range(300)] + [(None, i) for i in range(nulls)]
    big = spark.createDataFrame(rows, "k string, v bigint").repartition(5)
    partners = [("hot", "a"), ("hot", "b"), ("k1", "c"), ("absent", "d"), (None, "e")]
    small = spark.createDataFrame(partners, "k string, w string")
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    got = skew_join(big, small, "k", keep)
    assert len(jobs.getJobIdsForGroup(None)) == before
    assert rows_of(got.select("k", "v", "w")) == rows_of(big.join(small, "k", how).select("k", "v", "w"))


@pytest.fixture
def small_skew(spark):
    """Thresholds at which a few thousand rows are skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_an_order_of_a_third_of_all_items_is_split(small_skew):
    """Also where its payments repeat, and orders without items or payments stay."""
    spark = small_skew
    n = 12_000
    item = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 900)
    items = spark.range(n).select(item.alias("order_id"), (F.col("id") % 11).cast("string").alias("product_id"), (F.col("id") * 7919).alias("price"))
    orders = spark.range(1000).select(F.col("id").alias("order_id"), F.lit("c").alias("customer_unique_id"))
    payments = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(8)).otherwise(F.col("id") % 950).alias("order_id"), (F.col("id") * 104729).alias("payment_value"))
    items, orders, payments = (materialize(x.repartition(6)) for x in (items, orders, payments))
    sold = RetailTables(orders=orders, customers=None, order_items=items, order_payments=None, order_reviews=None, products=None, category_translation=None, geolocation=None, sellers=None)
    fact = sales_fact(sold, ("customer_unique_id", "product_id", "price"))
    assert fact.count() == n + 1000 - items.select("order_id").distinct().count()
    assert rows_of(fact.select("order_id", "price")) == rows_of(orders.join(items, "order_id", "left").select("order_id", "price"))
    fact.collect()
    assert "skew=true" in fact._jdf.queryExecution().executedPlan().toString()
    paid = order_fact(replace(sold, order_items=None, order_payments=payments), ("customer_unique_id", "payment_value"))
    assert rows_of(paid.select("order_id", "payment_value")) == rows_of(orders.join(payments, "order_id", "left").select("order_id", "payment_value"))
    paid.collect()
    assert "skew=true" in paid._jdf.queryExecution().executedPlan().toString()


def test_scratch_folder_is_the_named_one(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_without_a_named_scratch_folder_there_is_an_error():
    unset = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None)
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(unset)


def test_written_tables_can_be_dropped_by_label(make):
    spark = make([(1, "a")], "k bigint, v string").sparkSession
    kept, gone = (materialize(spark.range(3).toDF("k"), label) for label in ("kept_here", "gone_soon"))
    assert drop_tables(spark, "gone_soon") == 1
    assert kept.count() == 3
    assert drop_tables(spark, "gone_soon") == 0


def test_materialized_table_is_cut_from_its_source(make):
    df = materialize(make([(1, "a"), (2, None)], "k bigint, v string").withColumn("r", F.rand()))
    assert rows_of(df) == rows_of(df)
    assert df.inputFiles()


def test_order_keys_keep_the_order_of_doubles(spark):
    """Every power of two, numbers next to them, tiny and infinite ones; the key is the value's bits."""
    import math
    import struct

    powers = [2.0**e for e in range(-1074, 1024)]
    values = {0.0, math.inf, math.pi, 1e300, 5e-324, 2.2250738585072011e-308, *powers}
    values |= {math.nextafter(v, x) for v in powers for x in (0.0, math.inf)}
    rng = random.Random(1)
    values |= {v for v in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)) if v == v}
    values = sorted(values | {-v for v in values})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", order_key(F.col("v")).alias("key"), key_value(order_key(F.col("v"))).alias("back")).collect()
    assert all(r["back"] == r["v"] for r in rows)
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["key"] == (bits if r["v"] >= 0 else -bits)
    nan = spark.createDataFrame([(math.nan,), (None,)], "v double").select(key_value(order_key(F.col("v"))).alias("back")).collect()
    assert math.isnan(nan[0]["back"]) and nan[1]["back"] is None


@pytest.mark.parametrize("scale", [1e-310, 1.0, 1e300])
def test_quantiles_of_any_size_and_sign(spark, scale):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal(300), np.zeros(120), -np.ones(40), rng.integers(-5, 5, 200)]) * scale
    df = materialize(spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5))
    got = quantiles(df, {"v": PROBS})["v"]
    ranked = np.sort(v)
    for p, q in zip(PROBS, got):
        at = p * (len(v) - 1)
        assert ranked[int(np.floor(at))] <= q <= ranked[int(np.ceil(at))]


def test_quantiles_exchange_counts_alone(spark):
    """No value crosses an exchange: what does is grouped by digit first."""
    df = materialize(spark.range(5000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v")))
    plan = quantile_table(df, "v", (0.5,), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    assert "partial_count" in plan


# one exchange


def test_running_sums_take_one_exchange_and_no_sorted_table(spark):
    df = materialize(spark.range(3000).select("id", (F.col("id") * 7919 % 101).alias("v")))
    for out in (running_sum(df, [down("v"), "id"], {"v": "s"}, written=True), global_row_number(df, [down("v"), "id"], written=True)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
        assert initial.count("Exchange") == 1 and initial.count("Sort ") == 1
        assert "/sorted-" not in plan and "rangepartitioning" not in plan


def test_buckets_equal_a_search_among_sorted_tuples():
    import bisect

    rng = random.Random(2)
    choices = ([-3, 0, 1, 3], ["a", "ab", "b", "ü", ""], [0.5, -1.0, 2.0])

    def rank(row):
        return tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in row)

    for _ in range(200):
        rows = [tuple(None if rng.random() < 0.3 else rng.choice(c) for c in choices) for _ in range(60)]
        splitters = sorted(set(rng.sample(rows, rng.randint(1, 12))), key=rank)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64()))]
        want = [bisect.bisect_right([rank(s) for s in splitters], rank(r)) for r in rows]
        assert Buckets(splitters)(columns).tolist() == want


def test_order_without_ansi_casts(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = materialize(spark.range(500).select("id", F.coalesce((F.col("id") % 7).cast("string"), F.lit("")).alias("v")))
        rows = running_sum(df, ["v", "id"], {"id": "s"}).collect()
        assert max(r["s"] for r in rows) == 500 * 499 // 2
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("kind", ["string", "double", "decimal(10,2)", "date", "timestamp", "boolean", "binary"])
def test_order_of_any_type_with_nulls_and_a_hot_value(spark, kind):
    values = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7919 % 97)
    v = {
        "string": F.concat(F.lit("it's \\ ü "), values.cast("string")),
        "double": F.when(values == 5, float("nan")).otherwise(values / 7),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), values.cast("int")),
        "timestamp": F.timestamp_micros(values * 1_000_003),
        "boolean": values > 40,
        "binary": values.cast("string").cast("binary"),
    }.get(kind, values.cast(kind))
    df = materialize(spark.range(2000).select("id", v.alias("v")))
    for key, sort in ((down("v"), F.desc_nulls_last("v")), ("v", F.asc_nulls_first("v"))):
        got = {r["id"]: r["n"] for r in global_row_number(df, [key, "id"], "n").select("id", "n").collect()}
        want = df.select("id", F.row_number().over(Window.orderBy(sort, "id")).alias("n")).collect()
        assert got == {r["id"]: r["n"] for r in want}
