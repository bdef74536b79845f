import datetime as dt

import pytest
from pyspark.sql import functions as F

from relfeat.operators.preprocess import (DatetimeFeatureGenerator, NotFittedError, SafeLabelEncoderTransformer, TabularPreprocessor,
                                          TemporalDiffConfig, TemporalDiffTransformer, TypeCastTransformer)
from relfeat.sources.testdb import read_table

from conftest import SF

DAY = 86_400 * 10**9


@pytest.fixture(scope="module")
def orders(spark):
    """Orders with an epoch column, a nullable flag and a nullable count."""
    o = read_table(spark, SF, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.col("o_orderdate").alias("cutoff_time"),
                    F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 2 == 0).alias("even"),
                    F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("maybe_customer"),
                    F.lit(915_148_800 * 10**9).alias("seen_epochtime_max"), F.lit(5).cast("long").alias("seen_epochtime_std"))


def test_casts_follow_what_fit_saw(orders):
    fitted = TypeCastTransformer().fit(orders)
    kinds = dict(fitted.transform(orders).dtypes)
    assert kinds["even"] == kinds["maybe_customer"] == "float" and kinds["o_orderkey"] == "bigint" and kinds["o_totalprice"] == "double"
    assert kinds["seen_epochtime_max"] == "bigint"  # never narrowed
    row = fitted.transform(orders).where("o_orderkey = 12").first()
    assert row.even == 1.0 and fitted.transform(orders).where("o_orderkey % 5 = 0 AND even IS NOT NULL").count() == 0
    without = orders.drop("maybe_customer")
    assert fitted.transform(without).columns == without.columns


def test_differences_to_the_cutoff(orders):
    fitted = TemporalDiffTransformer(TemporalDiffConfig(), "cutoff_time").fit(orders)
    out = fitted.transform(orders)
    assert "seen_epochtime_std" not in out.columns and "seen_epochtime_max" not in out.columns
    for r in out.limit(20).collect():
        days = (r.cutoff_time - dt.datetime(1999, 1, 1)).total_seconds() / 86_400
        assert r.seen_epochtime_max_diff == days * DAY


def test_excluded_and_cutoff_free_columns(orders):
    kept = TemporalDiffTransformer(TemporalDiffConfig(exclude_columns=["seen_epochtime_std"]), "cutoff_time").fit(orders).transform(orders)
    assert "seen_epochtime_std" in kept.columns and "seen_epochtime_max_diff" in kept.columns
    free = TemporalDiffTransformer(TemporalDiffConfig(), "no_such_column").fit(orders).transform(orders)
    assert "seen_epochtime_max" in free.columns and "seen_epochtime_std" not in free.columns
    named = orders.withColumn("MIN_orders_stdout_epochtime", F.lit(1).cast("long"))
    assert TemporalDiffTransformer(TemporalDiffConfig()).fit(named).columns_to_drop_ == ["seen_epochtime_std"]


def test_encoding_runs_no_job_and_orders_many_unseen_values(spark, monkeypatch):
    """Three ranges over values of which most share a long beginning; nulls are one class."""
    monkeypatch.setattr("relfeat.operators.ranking.SPLITS", 3)
    names = [None if i % 17 == 0 else "Customer#" + "0" * (i % 5) + str(i * 7919 % 1000) for i in range(400)]
    frame = spark.createDataFrame([(i, n, "ab"[i % 2]) for i, n in enumerate(names)], "id long, name string, side string").repartition(5)
    fitted = SafeLabelEncoderTransformer().fit(frame.where("id < 40 AND side = 'b'"))
    spark.sparkContext.setJobGroup("encode", "transform only plans")
    out = fitted.transform(frame)
    spark.sparkContext.setJobGroup("read", "the caller's action")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("encode")
    got = {r.id: (r.name, r.side) for r in out.collect()}
    text = [n or "nan" for n in names]
    seen = sorted({text[i] for i in range(40) if i % 2})
    order = seen + sorted(set(text) - set(seen))
    assert len(got) == 400 and len(order) > 300
    assert all(got[i] == (order.index(t), 1 - i % 2) for i, t in enumerate(text))  # "a" is the unseen side


def test_codes_of_seen_unseen_and_null_values(orders):
    seen = orders.select("o_orderkey", "o_orderpriority").where("o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED')")
    encoder = SafeLabelEncoderTransformer().fit(seen)
    odd = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    pairs = odd.select("o_orderkey", F.col("o_orderpriority").alias("was")).join(encoder.transform(odd), "o_orderkey")
    codes = {r.was: r.o_orderpriority for r in pairs.distinct().collect()}
    assert codes == {"2-HIGH": 0, "4-NOT SPECIFIED": 1, "1-URGENT": 2, "3-MEDIUM": 3, "5-LOW": 4, None: 5}
    again = encoder.transform(seen)
    assert {r[0] for r in again.select("o_orderpriority").distinct().collect()} == {0, 1}  # seen codes never move


def test_encoder_broadcasts_no_value_table_by_hint(orders):
    encoder = SafeLabelEncoderTransformer().fit(orders.select("o_orderpriority"))
    plan = encoder.transform(orders.select("o_orderkey", "o_orderpriority"))._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in plan and "UnresolvedHint" not in plan


def test_datetime_parts_and_constants(orders):
    fitted = DatetimeFeatureGenerator().fit(orders)
    out = fitted.transform(orders)
    assert "seen_epochtime_max" not in out.columns and {"cutoff_time_year", "cutoff_time_dayofweek"} <= set(out.columns)
    r = out.join(orders.select("o_orderkey", F.col("cutoff_time").alias("t")), "o_orderkey").first()
    assert (r.cutoff_time_year, r.cutoff_time_month, r.cutoff_time_day, r.cutoff_time_dayofweek) == (r.t.year, r.t.month, r.t.day, r.t.weekday())
    with pytest.raises(TypeError):
        DatetimeFeatureGenerator(enable_text_ngrams=True)


def test_chain_and_unfitted_stages(orders):
    for stage in (TypeCastTransformer(), SafeLabelEncoderTransformer(), DatetimeFeatureGenerator(), TemporalDiffTransformer(TemporalDiffConfig())):
        with pytest.raises(NotFittedError):
            stage.transform(orders)
    chain = TabularPreprocessor(None, TemporalDiffConfig(), "cutoff_time", keep_columns=["o_orderkey"])
    with pytest.raises(NotFittedError):
        chain.transform(orders)
    out = chain.fit(orders).transform(orders)
    assert out.count() == orders.count() and "string" not in dict(out.dtypes).values()
    assert out.where("o_orderkey IS NULL OR o_orderstatus IS NULL").count() == 0


def test_widened_queries_return_all_rows(spark):
    from relfeat.queries import QUERIES
    from relfeat.sources.testdb import customer_quarter_task, read_table

    orders = read_table(spark, SF, "orders")
    encoded, whole = QUERIES["label_encode_all"](spark, SF), QUERIES["label_encode"](spark, SF)
    assert encoded.count() == whole.count() == orders.count()  # ``label_encode`` covers later orders too
    assert encoded.exceptAll(whole).count() == 0
    splits = {r["split"]: r["count"] for r in QUERIES["task_import_entity_splits"](spark, SF).groupBy("split").count().collect()}
    assert set(splits) == {"train", "test"} and sum(splits.values()) == customer_quarter_task(spark, SF).count()


def test_loaded_codes_are_not_broadcast(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(50)], "n long, name string")
    encoder = SafeLabelEncoderTransformer().fit(df)
    encoder.codes_.write.parquet(str(tmp_path / "codes"))
    encoder.codes_ = spark.read.parquet(str(tmp_path / "codes"))
    out = encoder.transform(df.unionByName(spark.createDataFrame([(50, "a")], df.schema)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "LeftAnti" in line and "Broadcast" in line]
    assert {r["n"]: r["name"] for r in out.collect()} == {i: i % 7 for i in range(50)} | {50: 7}


def test_whole_rows_are_shuffled_once_for_all_columns(spark):
    import re
    rows = [(i, f"a{i % 5}", None if i % 7 == 0 else f"b{i % 3}", f"c{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "payload long, a string, b string, c string").repartition(3)
    out = SafeLabelEncoderTransformer().fit(df.where("payload < 50")).transform(df)
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning", plan)
    assert len([x for x in inputs if "payload" in x]) == 1
    orders = [sorted({r[j] or "nan" for r in rows[:50]}) + sorted({r[j] or "nan" for r in rows[50:]} - {r[j] or "nan" for r in rows[:50]}) for j in (1, 2, 3)]
    want = {r[0]: tuple(o.index(r[j] or "nan") for j, o in zip((1, 2, 3), orders)) for r in rows}
    assert {r.payload: (r.a, r.b, r.c) for r in out.collect()} == want


def test_constants_are_found_without_joining_codes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "one", None, f"v{i % 4}", "nan" if i % 2 else None) for i in range(20)], "n long, same string, none string, many string, nans string")
    monkeypatch.setattr(SafeLabelEncoderTransformer, "transform", lambda *a: pytest.fail("codes were joined to find constants"))
    assert sorted(TabularPreprocessor().fit(df).steps[-1][1].constant_columns_) == ["nans", "none", "same"]
