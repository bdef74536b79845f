import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from relfeat import create_rdb, prepare_db, synthesize
from relfeat.sources.testdb import load_test_db, order_task

from conftest import SF


def _rows(df, key):
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def small_db(spark):
    cust = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_id long, seg string")
    orders = spark.createDataFrame([
        (10, 1, 5.0, dt.datetime(2020, 1, 1)), (11, 1, 7.0, dt.datetime(2020, 1, 2)),
        (12, 1, 9.0, dt.datetime(2020, 1, 2)), (13, 2, 1.0, dt.datetime(2020, 1, 5)),
        (14, 2, 3.0, None)], "o_id long, c_id long, price double, ts timestamp_ntz")
    return prepare_db(create_rdb("s", {"cust": cust, "orders": orders}, {"cust": "c_id", "orders": "o_id"},
                                 [("orders", "c_id", "cust", "c_id")], {"orders": "ts"}))


def _task(spark, rows):
    return spark.createDataFrame(rows, "c_id long, cutoff timestamp_ntz")


@pytest.mark.parametrize("strategy", ["join", "window"])
def test_strict_cutoff_and_edge_rows(spark, small_db, strategy):
    task = _task(spark, [
        (1, dt.datetime(2020, 1, 2)),      # boundary: the two orders at exactly the cutoff are not visible
        (1, dt.datetime(2020, 1, 2)),      # exact duplicate task row is kept
        (1, dt.datetime(2020, 1, 3)),
        (2, dt.datetime(2019, 1, 1)),      # cutoff before all facts
        (3, dt.datetime(2021, 1, 1)),      # entity with no child rows
        (99, dt.datetime(2021, 1, 1)),     # unknown key
        (None, dt.datetime(2021, 1, 1)),   # null key
        (2, None),                         # null cutoff
    ])
    res = synthesize(small_db, task, {"c_id": "cust.c_id"}, "cutoff",
                     {"max_depth": 2, "agg_primitives": ["max", "mean", "count", "std"], "cutoff_strategy": strategy})
    rows = res.df.collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault((r["c_id"], r["cutoff"]), []).append(r)
    b = by[(1, dt.datetime(2020, 1, 2))]
    assert len(b) == 2 and b[0]["cust_COUNT_orders"] == 1 and b[0]["cust_MAX_orders_price"] == 5.0
    a = by[(1, dt.datetime(2020, 1, 3))][0]
    assert a["cust_COUNT_orders"] == 3 and a["cust_MEAN_orders_price"] == 7.0 and a["cust_STD_orders_price"] == 2.0
    assert by[(2, dt.datetime(2019, 1, 1))][0]["cust_COUNT_orders"] == 0
    assert by[(3, dt.datetime(2021, 1, 1))][0]["cust_COUNT_orders"] == 0
    assert by[(3, dt.datetime(2021, 1, 1))][0]["cust_seg"] == "c"
    assert by[(99, dt.datetime(2021, 1, 1))][0]["cust_MAX_orders_price"] is None
    assert by[(None, dt.datetime(2021, 1, 1))][0]["cust_COUNT_orders"] == 0
    n = by[(2, None)][0]
    assert n["cust_COUNT_orders"] == 0 and n["cust_seg"] == "b"   # null time order is never visible


def test_leak_free(spark):
    """Changing facts at or after a row's cutoff changes none of its features."""
    db = prepare_db(load_test_db(spark, SF, tables=("customer", "orders")))
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    task = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", cut.alias("cutoff_time"))
    cfg = {"max_depth": 2}
    a = synthesize(db, task, {"c_custkey": "customer.c_custkey"}, "cutoff_time", cfg).df
    o = db.get_table("orders")
    tampered = o.withColumn("o_totalprice", F.when(F.col("o_orderdate") >= cut, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    b = synthesize(db.with_table("orders", tampered), task, {"c_custkey": "customer.c_custkey"}, "cutoff_time", cfg).df
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_join_and_window_plans_agree(spark):
    db = prepare_db(load_test_db(spark, SF, tables=("customer", "orders", "lineitem")))
    task = order_task(spark, SF).select("o_orderkey", "o_custkey", "cutoff_time")
    cfg = {"max_depth": 2, "agg_primitives": ["max", "min", "mean", "count", "mode", "std"]}
    j = synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time", {**cfg, "cutoff_strategy": "join"}).df
    w = synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time", {**cfg, "cutoff_strategy": "window"}).df
    std = [c for c in j.columns if "_STD_" in c]
    exact = [c for c in j.columns if c not in std]
    assert j.select(*exact).exceptAll(w.select(*exact)).count() == 0
    assert w.select(*exact).exceptAll(j.select(*exact)).count() == 0
    # standard deviations: same values up to floating-point summation order
    jp = j.select("o_orderkey", *std).toPandas().sort_values("o_orderkey").reset_index(drop=True)
    wp = w.select("o_orderkey", *std).toPandas().sort_values("o_orderkey").reset_index(drop=True)
    for c in std:
        assert np.allclose(jp[c].astype(float), wp[c].astype(float), rtol=1e-9, equal_nan=True)


def test_feature_names_and_depth(shop, segment_task):
    task = segment_task[1]
    db = prepare_db(shop)
    flat = synthesize(db, task, {"c_custkey": "customer.c_custkey"}, "cutoff_time", {"max_depth": 1})
    assert flat.feature_names == ["customer_c_name", "customer_c_acctbal", "customer_c_mktsegment"]
    deep = synthesize(db, task, {"c_custkey": "customer.c_custkey"}, "cutoff_time", {"max_depth": 2})
    assert "customer_MAX_orders_o_orderdate_epochtime" in deep.feature_names
    assert not any("orderkey" in n or "custkey" in n for n in deep.feature_names)      # keys are never features
    assert deep.df.count() == task.count()
    assert [f.name for f in deep.features if f.is_std_of_epoch] == ["customer_STD_orders_o_orderdate_epochtime"]
    with pytest.raises(ValueError):
        synthesize(db, task, {"c_custkey": "customer.c_custkey"}, "cutoff_time", {"max_dept": 3})


def test_parent_without_a_declared_key(spark):
    parent = spark.createDataFrame([("x1", 1.0), ("x1", 0.5), ("x2", 2.0), (None, 9.0)], "mail string, v double")
    task = spark.createDataFrame([(1, "x1"), (2, "x1"), (3, "zz"), (4, None)], "i int, who string")
    db = create_rdb("d", {"p": parent}, {}, [], {})
    rows = {r.i: r.p_v for r in synthesize(db, task, {"who": "p.mail"}, None, {"max_depth": 1}).df.collect()}
    assert rows == {1: 0.5, 2: 0.5, 3: None, 4: None}      # one row stands for x1: the smallest


def test_means_of_tiny_huge_and_non_finite_values(spark):
    kids = [(1, 1e-12), (1, 3e-12), (2, 2.0**63), (2, 2.0**64), (3, float("inf")), (3, 1.0), (4, 1e300), (5, float("nan")), (6, 0.1), (6, 0.2), (7, 9e27), (7, 9e27), (7, 9e27)]
    db = create_rdb("d", {"p": spark.createDataFrame([(i,) for i in range(1, 9)], "k long"), "c": spark.createDataFrame(kids, "k long, x double")},
                    {"p": "k"}, [("c", "k", "p", "k")], {})
    got = {r.k: r.p_MEAN_c_x for r in synthesize(db, db.get_table("p"), {"k": "p.k"}, None, {"max_depth": 2, "agg_primitives": ["mean"]}).df.collect()}
    assert got[1] == 2e-12 and got[2] == (2.0**63 + 2.0**64) / 2 and got[3] == float("inf") and got[4] == 1e300 and got[5] != got[5]
    assert got[6] == 0.3 / 2 and abs(got[7] / 9e27 - 1) < 1e-12 and got[8] is None


def test_dotted_column_names(spark):
    cust = spark.createDataFrame([(1, 2.0)], "`c.id` long, `a.b` double")
    orders = spark.createDataFrame([(10, 1, 5.0, dt.datetime(2020, 1, 1))], "`o.id` long, `c.id` long, `p.x` double, `t.s` timestamp_ntz")
    db = prepare_db(create_rdb("s", {"cust": cust, "orders": orders}, {"cust": "c.id", "orders": "o.id"},
                               [("orders", "c.id", "cust", "c.id")], {"orders": "t.s"}))
    task = spark.createDataFrame([(1, dt.datetime(2021, 1, 1))], "`k.k` long, `cut.off` timestamp_ntz")
    for strategy in ("join", "window"):
        r = synthesize(db, task, {"k.k": "cust.c.id"}, "cut.off", {"max_depth": 2, "cutoff_strategy": strategy}).df.first()
        assert r["cust_a_b"] == 2.0 and r["cust_MAX_orders_p_x"] == 5.0 and r["cust_COUNT_orders"] == 1


def test_ntz_epoch_independent_of_session_zone(spark):
    from relfeat.functions.scalar import epoch_ns
    df = spark.createDataFrame([(dt.datetime(2023, 7, 1, 12, 30, 15, 250000),), (dt.datetime(1969, 12, 31, 23, 59, 59),)],
                               "t timestamp_ntz")
    want = [1688214615250000000, -1000000000]
    for tz in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        try:
            assert [r[0] for r in df.select(epoch_ns(F.col("t"), df.schema["t"].dataType)).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hot_key_detection_switches_to_bucketed_plan(spark):
    """A key above ``hot_key_rows`` child rows routes the window plan to the time-bucketed
    variant; results equal the join plan (std up to summation order)."""
    db = prepare_db(load_test_db(spark, SF, tables=("customer", "orders")))
    task = order_task(spark, SF).select("o_orderkey", "o_custkey", "cutoff_time")
    cfg = {"max_depth": 2, "agg_primitives": ["max", "min", "mean", "count", "mode", "std"]}
    j = synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time", {**cfg, "cutoff_strategy": "join"}).df
    b = synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time",
                   {**cfg, "cutoff_strategy": "window", "hot_key_rows": 1, "prefix_bucket_seconds": 7 * 86400}).df
    std = [c for c in j.columns if "_STD_" in c]
    exact = [c for c in j.columns if c not in std]
    assert j.select(*exact).exceptAll(b.select(*exact)).count() == 0
    assert b.select(*exact).exceptAll(j.select(*exact)).count() == 0
    jp = j.select("o_orderkey", *std).toPandas().sort_values("o_orderkey").reset_index(drop=True)
    bp = b.select("o_orderkey", *std).toPandas().sort_values("o_orderkey").reset_index(drop=True)
    for c in std:
        assert np.allclose(jp[c].astype(float), bp[c].astype(float), rtol=1e-9, equal_nan=True)
