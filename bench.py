"""

Every query runs to completion through Spark's ``noop`` sink (the full plan executes, nothing
is collected).  Prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from relfeat.operators.estimator import RelationalClassifier  # noqa: E402
from relfeat.operators.prepare import prepare_db  # noqa: E402
from relfeat.plans.synthesis import synthesize  # noqa: E402
from relfeat.session import local_session  # noqa: E402
from relfeat.sources.testdb import customer_quarter_task, line_task, order_task, read_table, load_test_db  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, cpus * 2), app="relfeat-bench")
    db = prepare_db(load_test_db(spark, sf_dir))
    times = {}

    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]

    def timed(name, fn):
        if only and not any(name.startswith(o) for o in only):
            return
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    # warm-up: JVM, Parquet footers, codegen caches
    run(read_table(spark, sf_dir, "orders").groupBy("o_custkey").count())

    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("cutoff_time"))
    timed("B1_customer_depth2", lambda: run(synthesize(
        db, cust, {"c_custkey": "customer.c_custkey"}, "cutoff_time", {"max_depth": 2}).df))

    orders = order_task(spark, sf_dir).select("o_orderkey", "o_custkey", "cutoff_time")
    for strat in ("join", "window"):
        timed(f"B2_orders_depth2_{strat}", lambda s=strat: run(synthesize(
            db, orders, {"o_custkey": "customer.c_custkey"}, "cutoff_time",
            {"max_depth": 2, "cutoff_strategy": s}).df))

    lines = line_task(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cutoff_time")
    timed("B3_lineitem_depth3", lambda: run(synthesize(
        db, lines, {"l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey", "l_orderkey": "orders.o_orderkey"},
        "cutoff_time", {"max_depth": 3, "agg_primitives": ["max", "min", "mean", "count", "mode"]}).df))

    def b4():
        from pyspark.ml.classification import LogisticRegression
        full = customer_quarter_task(spark, sf_dir).select("c_custkey", "cutoff_time", "churn")
        cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
        train, test = full.where(F.col("cutoff_time") < cut), full.where(F.col("cutoff_time") >= cut).drop("churn")
        clf = RelationalClassifier(LogisticRegression(maxIter=20), {"max_train_samples": 10_000})
        clf.fit(train, "churn", load_test_db(spark, sf_dir, tables=("customer", "nation", "orders")),
                {"c_custkey": "customer.c_custkey"}, "cutoff_time")
        run(clf.predict(test))
    timed("B4_fit_score_10k", b4)

    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
