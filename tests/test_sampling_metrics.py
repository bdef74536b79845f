from pyspark.sql import functions as F

from relfeat.operators.metrics import mean_absolute_error, roc_auc
from relfeat.operators.sampling import downsample, with_hash
from relfeat.sources.testdb import line_task, order_task

from conftest import SF


def test_uniform_exact_and_repeatable(spark):
    t = order_task(spark, SF)
    a = downsample(t, "target", 300, "regression", seed=1, id_cols=["o_orderkey"])
    b = downsample(t, "target", 300, "regression", seed=1, id_cols=["o_orderkey"])
    assert a.count() == 300 and a.exceptAll(b).count() == 0
    assert downsample(t, "target", 10**6, "regression").count() == t.count()     # L1 pass-through


def test_coverage_keeps_every_class(spark):
    t = line_task(spark, SF)
    s = downsample(t, "target", 30, "classification", False, 5, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    assert s.count() == 30
    assert {r[0] for r in s.select("target").distinct().collect()} == {r[0] for r in t.select("target").distinct().collect()}


def test_balanced_quota(spark):
    t = line_task(spark, SF)
    s = downsample(t, "target", 90, "classification", True, 5, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    counts = {r[0]: r[1] for r in s.groupBy("target").count().collect()}
    assert sum(counts.values()) == 90 and all(v >= 30 for v in counts.values())


def test_samples_are_full_where_ids_repeat(spark):
    one_id = spark.createDataFrame([(1, "ab"[i % 2], i) for i in range(100)], "id int, y string, other int")
    for stratified in (False, True):
        s = downsample(one_id, "y", 50, "classification", stratified, 1, ["id"])
        assert s.count() == 50 and s.distinct().count() == 50 and s.select("y").distinct().count() == 2
    assert downsample(one_id, "other", 30, "regression", seed=1, id_cols=["id"]).count() == 30
    nulls = spark.createDataFrame([("a", None, "b", 0), ("a", "b", None, 1), (None, None, None, 2)] * 20, "p string, q string, r string, y int")
    assert with_hash(nulls, 1, ["p", "q", "r"]).select("__h").distinct().count() == 3
    assert downsample(nulls, "y", 31, "classification", True, 1, ["p", "q", "r"]).count() == 31
    rare = spark.createDataFrame([(i, None if i % 3 else i) for i in range(90)], "id int, y int")
    assert downsample(rare, "y", 40, "classification", False, 1, ["id"]).count() == 40     # a class for each of 30 labels, and nulls


def test_rows_of_a_hot_key_are_the_same_however_they_lie(spark):
    """Half of all rows share one id and class; which of them are taken does not depend on where
    they were read."""
    rows = [(0 if i % 2 else i, "ab"[i % 4 == 2], i) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, target string, line long")
    for stratified in (False, True):
        pick = lambda n, f=stratified: downsample(frame.repartition(n, "line"), "target", 200, "classification", f, 3, ["id"])
        one, many = pick(1), pick(13)
        assert one.count() == 200 and one.exceptAll(many).count() == 0 and many.columns == frame.columns
        hashed = with_hash(frame, 3, ["id", "target"]).where("id = 0 AND target = 'a'")  # the hot key, in the order of its rows' hashes
        order = [r.line for r in hashed.orderBy(F.xxhash64(*hashed.columns)).collect()]
        taken = {r.line for r in one.where("id = 0 AND target = 'a'").collect()}
        assert 10 < len(taken) < len(order) and taken == set(order[:len(taken)])


def test_auc_ties_and_mae(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    # positives 0.9 (beats 3 negatives) and 0.5 (beats 1, ties 1): (3 + 1.5) / 6
    assert roc_auc(df, "y", "s").first()["auc"] == 0.75
    assert abs(mean_absolute_error(df, "y", "s").first()["mae"] - (0.1 + 0.8 + 0.5 + 0.5 + 0.1) / 5) < 1e-12


def test_metric_by_name():
    import pytest
    from relfeat.operators.metrics import metric_by_name
    assert metric_by_name("AUROC") is roc_auc and metric_by_name("mae") is mean_absolute_error
    with pytest.raises(ValueError):
        metric_by_name("nope")


def test_infer_text_columns(spark):
    from relfeat.operators.prepare import drop_text_columns, infer_text_columns
    from relfeat.sources.rdb import create_rdb
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    db = infer_text_columns(create_rdb("d", {"documents": docs}, {"documents": "doc_id"}))
    assert db.get_table_metadata("documents").roles == {"text": "text"}
    assert drop_text_columns(db).get_table("documents").columns == ["doc_id", "lang"]


def test_rows_are_not_dealt_out_by_class(spark):
    """Few classes are broadcast whatever Spark estimates; many meet the rows by a shuffle."""
    from relfeat.operators.sampling import _class_quota, with_hash as hashed
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "id int, y string")
    h, classes = hashed(rows, 1, ["id", "y"]), rows.groupBy(F.col("y").alias("__y")).agg(F.count("*").alias("__c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stratified in (False, True):
            s = downsample(rows, "y", 20, "classification", stratified, 1, ["id"])
            plan = s._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert s.count() == 20
        few, many = (_class_quota(h, "y", classes, 5, few).select("__h", "__y", "__take").collect() for few in (True, False))
        assert sorted(few) == sorted(many) and sum(r["__take"] for r in few) == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
