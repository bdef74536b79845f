import datetime as dt

import pytest
from pyspark.sql import functions as F

from relfeat.operators.prepare import prepare_db
from relfeat.session import ensure_checkpoint_dir
from relfeat.sources.rdb import RelationalDataset
from relfeat.sources.tasks import Dataset, Task, TaskMetadata, shift_task_time
from relfeat.sources.testdb import order_task, load_test_db

from conftest import SF


def test_round_trip(spark, tmp_path):
    t = order_task(spark, SF)
    ds = Dataset(load_test_db(spark, SF, tables=("customer", "orders")),
                 [Task("price", t, t, TaskMetadata({"o_custkey": "customer.c_custkey"}, "target", "cutoff_time",
                                                   "regression", "mae"))])
    ds.save(str(tmp_path / "ds"))
    (tmp_path / "ds" / "stray.txt").write_text("x")                    # only what the manifest names is read
    back = Dataset.load(spark, f"file:{tmp_path}/ds")                  # with or without a scheme
    assert list(Dataset.load(spark, str(tmp_path / "ds")).tasks) == ["price"]
    with pytest.raises(FileNotFoundError):
        Dataset.load(spark, str(tmp_path / "none"))
    assert list(back.tasks) == ["price"]
    task = back.task("price")
    assert task.val_df is None and task.metadata.key_mappings == {"o_custkey": "customer.c_custkey"}
    assert task.train_df.count() == t.count()
    assert set(back.rdb.table_names) == {"customer", "orders"}
    assert back.rdb.get_table_metadata("orders").time_column == "o_orderdate"
    with pytest.raises(KeyError):
        back.task("nope")


def test_imports(spark):
    t = order_task(spark, SF)
    db = prepare_db(load_test_db(spark, SF, tables=("customer", "orders")))
    ds = Dataset.from_entity_tasks(db, [
        dict(name="a", splits={"train": t, "test": t}, entity_table="customer", entity_col="o_custkey",
             target_col="target", time_col="cutoff_time", task_type="regression", metrics=["mae"]),
        dict(name="l", splits={"train": t, "test": t}, entity_table="customer", entity_col="o_custkey",
             target_col="target", task_type="link_prediction")])
    assert list(ds.tasks) == ["a"] and ds.task("a").metadata.key_mappings == {"o_custkey": "customer.c_custkey"}
    rs = Dataset.from_role_tasks(db, [dict(
        name="r", splits={"train": t, "test": t}, target_table="nope", target_col="target",
        columns=[{"name": "o_orderkey", "dtype": "primary_key"},
                 {"name": "o_custkey", "dtype": "foreign_key", "link_to": "customer.c_custkey"}])])
    assert rs.task("r").metadata.key_mappings == {"o_custkey": "customer.c_custkey"}   # unknown target table skipped
    shifted = shift_task_time(ds.task("a"), 1).train_df
    d = shifted.join(t.select("o_orderkey", F.col("cutoff_time").alias("c0")), "o_orderkey") \
        .select((F.unix_timestamp("cutoff_time") - F.unix_timestamp("c0")).alias("d")).distinct().collect()
    assert [r["d"] for r in d] == [1]


def test_dummy_and_missing_keys(spark):
    from relfeat.operators.prepare import fill_missing_primary_keys, handle_dummy_tables
    db = handle_dummy_tables(load_test_db(spark, SF, tables=("events",)))
    assert db.get_table_metadata("users").primary_key == "user_id"
    base = load_test_db(spark, SF, tables=("customer", "orders"))
    cut = base.with_table("customer", base.get_table("customer").where("c_mktsegment <> 'BUILDING'"))
    filled = fill_missing_primary_keys(cut)
    assert filled.get_table("customer").count() == base.get_table("customer").count()
    rep = {(r["table_name"], r["check"]): r["n_bad"] for r in cut.key_report().collect()}
    assert rep[("orders", "orphan_foreign_key")] > 0 and rep[("customer", "duplicate_primary_key")] == 0


def test_missing_keys_by_broadcast_and_by_shuffle(spark):
    """Both ways find the same keys; an intact edge's rows are not shuffled where the parent is small."""
    from relfeat.operators.prepare import _without_parent, fill_missing_primary_keys
    base = load_test_db(spark, SF, tables=("customer", "orders"))
    cut = base.with_table("customer", base.get_table("customer").where("c_mktsegment <> 'BUILDING'"))
    ways = [fill_missing_primary_keys(cut, True, size).get_table("customer").select("c_custkey", "c_name") for size in (0, 1 << 20)]
    assert ways[0].exceptAll(ways[1]).count() == 0 and ways[0].count() == ways[1].count() > 0
    assert ways[1].where("c_name IS NULL").count() == ways[1].count() - cut.get_table("customer").count() > 0
    fks = base.get_table("orders").select(F.col("o_custkey").alias("__fk")).unionByName(spark.createDataFrame([(None,), (-5,)], "__fk long"))
    keys = base.get_table("customer").select(F.col("c_custkey").alias("__pk")).unionByName(spark.createDataFrame([(None,)], "__pk long"))
    near = _without_parent(fks.where("__fk IS NOT NULL"), keys, True)
    assert [r[0] for r in near.collect()] == [-5]
    plan = near._jdf.queryExecution().executedPlan().toString().rsplit("== Initial Plan ==", 1)[-1]
    assert plan.index("hashpartitioning") < plan.index("BroadcastHashJoin")  # printed from the result down to the scans
    assert "hashpartitioning" not in plan[plan.index("BroadcastHashJoin"):]


def test_keys_of_dummy_tables_are_not_looked_up(spark, monkeypatch):
    from relfeat.operators import prepare
    looked = []
    own = prepare._without_parent
    monkeypatch.setattr(prepare, "_without_parent", lambda fks, keys, small: looked.append(small) or own(fks, keys, small))
    db = prepare.prepare_db(load_test_db(spark, SF, tables=("events",)))
    assert not looked and db.get_table("users").count() == load_test_db(spark, SF, tables=("events",)).get_table("events").select("user_id").distinct().count()
    prepare.prepare_db(load_test_db(spark, SF, tables=("customer", "orders")))
    assert looked and any(looked)


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_key_type_canonicalisation(spark):
    from relfeat.sources.rdb import create_rdb
    p = spark.createDataFrame([(1, "a")], "id long, v string")
    c = spark.createDataFrame([(10, "1"), (11, "1.0")], "cid long, pid string")
    db = create_rdb("k", {"p": p, "c": c}, {"p": "id", "c": "cid"}, [("c", "pid", "p", "id")])
    with pytest.raises(ValueError):
        db.validate_key_consistency()                       # long vs string
    fixed = db.canonicalize_key_types()
    fixed.validate_key_consistency()
    assert dict(fixed.get_table("p").dtypes)["id"] == "string"
    assert [r["id"] for r in fixed.get_table("p").collect()] == ["1"]


def test_failed_save_leaves_the_version_before(spark, tmp_path):
    t = order_task(spark, SF)
    md = TaskMetadata({"o_custkey": "customer.c_custkey"}, "target", "cutoff_time")
    db = load_test_db(spark, SF, tables=("customer", "orders"))
    path = str(tmp_path / "ds")
    Dataset(db, [Task("price", t, t, md)]).save(path)
    first = Dataset.load(spark, path)
    bad = t.withColumn("target", F.raise_error(F.lit("no such row")).cast("double"))
    with pytest.raises(Exception, match="no such row"):
        Dataset(db, [Task("a", t, t, md), Task("price", t.limit(1), bad, md)]).save(path)
    assert list(Dataset.load(spark, path).tasks) == ["price"] and Dataset.load(spark, path).task("price").test_df.count() == t.count()
    Dataset(db, [Task("price/2", t.limit(3), t, md)]).save(path)
    assert Dataset.load(spark, path).task("price/2").train_df.count() == 3
    assert first.task("price").train_df.count() == t.count()           # frames of an older version stay readable


def test_history_by_any_column(spark):
    from relfeat import create_rdb, synthesize
    from relfeat.operators.history import add_target_history
    shops = spark.createDataFrame([(1, "n"), (2, "n"), (3, "s")], "shop long, town string")
    day = lambda d: f"2021-01-0{d} 00:00:00"
    task = spark.createDataFrame([("n", day(1), 1.0), ("n", day(2), 3.0), ("s", day(2), 5.0), ("n", day(3), 0.0), (None, day(3), 2.0)], "town string, at string, y double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    mapping = {"town": "shops.town"}
    db = prepare_db(add_target_history(create_rdb("d", {"shops": shops}, {"shops": "shop"}), task, mapping, "at"))
    assert db.get_table("shops").count() == 3                           # a town's name makes no row
    res = synthesize(db, task.drop("y"), mapping, "at", {"agg_primitives": ["mean", "count"]})
    got = sorted((str(r.town), r["at"].day, r.shops_town, r.shops_MEAN_relfeat_target_history_y, r.shops_COUNT_relfeat_target_history) for r in res.df.collect())
    assert got == [("None", 3, None, None, 0), ("n", 1, "n", None, 0), ("n", 2, "n", 1.0, 1), ("n", 3, "n", 2.0, 2), ("s", 2, "s", None, 0)]


def test_targets_of_task_frames_are_not_broadcast(spark, tmp_path):
    """The file of orders is small however many customers it holds: Spark must not judge by it."""
    from relfeat.sources.testdb import customer_quarter_task, user_purchase_task
    day = dt.datetime(1997, 4, 2)
    orders = [(1, day, 10.0), (1, day, 5.0), (2, dt.datetime(1997, 6, 30), 7.0), (None, day, 1.0)]
    spark.createDataFrame([(1,), (2,), (2,), (None,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    bought = [(1, dt.datetime(2024, 1, 9), "purchase"), (1, dt.datetime(2024, 1, 10), "purchase"), (2, dt.datetime(2024, 1, 9), "view")]
    spark.createDataFrame(bought, "user_id long, ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    quarters, users = customer_quarter_task(spark, str(tmp_path)), user_purchase_task(spark, str(tmp_path))
    for task in (quarters, users):
        assert "BroadcastHashJoin" not in task._jdf.queryExecution().executedPlan().toString()
    assert quarters.count() == 4 * 16
    # 30 June is 90 days after 1 April, one too many
    assert [tuple(r) for r in quarters.where("churn = 0").select("c_custkey", "cutoff_time", "spend").collect()] == [(1, dt.datetime(1997, 4, 1), 15.0)]
    assert users.count() == 6 and [tuple(r) for r in users.where("target = 1").collect()] == [(1, dt.datetime(2024, 1, 8), 1)]
