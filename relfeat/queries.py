"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group of
``relfeat.oracle`` holds the independent SQL twin of each one."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.prepare import (fill_missing_primary_keys, handle_dummy_tables, prepare_db)
from .plans.synthesis import synthesize
from .sources.rdb import create_rdb
from .sources.testdb import (customer_quarter_task, doc_quality_task, line_task, order_task, read_table,
                             load_test_db, user_purchase_task)


def _db(spark, sf, tables):
    return prepare_db(load_test_db(spark, sf, tables=tuple(tables)))


def _drop_std_epoch(res) -> DataFrame:
    """P3 on a synthesis result: drop standard deviations of epoch times."""
    return res.df.drop(*[f.name for f in res.features if f.is_std_of_epoch])


# ---- synthesis (J1-J4, A1-A8, P8) --------------------------------------------------------------
def q_direct_features(spark: SparkSession, sf: str) -> DataFrame:
    """Depth 3 over customer -> nation -> region for every order (no cutoff)."""
    db = _db(spark, sf, ["customer", "nation", "region"])
    task = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return synthesize(db, task, {"o_custkey": "customer.c_custkey"}, None, {"max_depth": 3}).df


def _quarter_task(spark, sf):
    return customer_quarter_task(spark, sf).select("c_custkey", "cutoff_time")


def _numeric_cutoff(spark, sf, strategy):
    db = _db(spark, sf, ["customer", "orders"])
    res = synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                     {"max_depth": 2, "agg_primitives": ["max", "min", "mean", "count", "std"], "cutoff_strategy": strategy})
    return _drop_std_epoch(res)


def q_agg_numeric_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer x 16 quarter starts, orders strictly before the
    cutoff, join plan."""
    return _numeric_cutoff(spark, sf, "join")


def q_prefix_window_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Same features as ``agg_numeric_cutoff`` through the sorted prefix-window plan."""
    return _numeric_cutoff(spark, sf, "window")


def q_agg_mode_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """A5: most frequent order status / priority before each cutoff (smallest on ties)."""
    db = _db(spark, sf, ["customer", "orders"])
    return synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": ["mode", "count"]}).df


def q_agg_median_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Exact medians of order price and date before each cutoff."""
    db = _db(spark, sf, ["customer", "orders"])
    return synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": ["median"]}).df


def q_agg_no_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A6 with no cutoff column: all orders of each customer are visible."""
    db = _db(spark, sf, ["customer", "orders"])
    task = read_table(spark, sf, "customer").select("c_custkey")
    res = synthesize(db, task, {"c_custkey": "customer.c_custkey"}, None, {"max_depth": 2})
    return _drop_std_epoch(res)


def q_cutoff_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """P8 at the boundary: each order is a task row whose cutoff is its own date, so neither
    it nor same-day orders of the customer are visible."""
    db = _db(spark, sf, ["customer", "orders"])
    task = order_task(spark, sf).select("o_orderkey", "o_custkey", "cutoff_time")
    res = synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time",
                     {"max_depth": 2, "agg_primitives": ["max", "min", "mean", "count"]})
    return res.df


def q_stacked_agg_of_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Customer <- orders <- lineitem at depth 3, cutoff at both levels (one per customer:
    the first day of 1999)."""
    db = _db(spark, sf, ["customer", "orders", "lineitem"])
    task = read_table(spark, sf, "customer").select(
        "c_custkey", F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("cutoff_time"))
    return synthesize(db, task, {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 3, "agg_primitives": ["mean", "count"]}).df


def q_stacked_agg_of_direct(spark: SparkSession, sf: str) -> DataFrame:
    """Part <- lineitem -> supplier at depth 3: aggregates of the supplier attributes of
    each part's line items shipped before 1998."""
    db = _db(spark, sf, ["part", "lineitem", "supplier"])
    task = read_table(spark, sf, "part").select(
        "p_partkey", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("cutoff_time"))
    return synthesize(db, task, {"p_partkey": "part.p_partkey"}, "cutoff_time",
                      {"max_depth": 3, "agg_primitives": ["max", "mean", "mode", "count"]}).df


def q_stacked_direct_of_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item -> supplier -> nation -> aggregates over the nation's customers
    (an untimed sub-tree: computed once per nation, without the cutoff)."""
    db = _db(spark, sf, ["supplier", "nation", "customer"])
    task = line_task(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "cutoff_time")
    return synthesize(db, task, {"l_suppkey": "supplier.s_suppkey"}, "cutoff_time",
                      {"max_depth": 3, "agg_primitives": ["max", "min", "mean", "count", "mode"]}).df


def q_multi_key_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item mapped to two entities (part and supplier) at once."""
    db = _db(spark, sf, ["part", "supplier"])
    task = line_task(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cutoff_time")
    return synthesize(db, task, {"l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
                      "cutoff_time", {"max_depth": 2}).df


def q_dummy_table(spark: SparkSession, sf: str) -> DataFrame:
    """``events.user_id`` points at a ``users`` table that does not exist; preparation
    creates it from the distinct keys and the user task gets event aggregates through it."""
    db = _db(spark, sf, ["events"])
    task = user_purchase_task(spark, sf)
    res = synthesize(db, task, {"user_id": "users.user_id"}, "cutoff_time", {"max_depth": 2})
    return _drop_std_epoch(res)


def q_dummy_table_keys(spark: SparkSession, sf: str) -> DataFrame:
    """J6 alone: the created ``users`` table."""
    db = handle_dummy_tables(load_test_db(spark, sf, tables=("events",)))
    return db.get_table("users")


def q_fill_missing_pk(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of segment BUILDING are removed from the parent table; every order
    key that lost its parent gets a key-only customer row back."""
    db = load_test_db(spark, sf, tables=("customer", "orders"))
    db = db.with_table("customer", db.get_table("customer").where(F.col("c_mktsegment") != "BUILDING"))
    return fill_missing_primary_keys(db).get_table("customer")


def q_epoch_ns(spark: SparkSession, sf: str) -> DataFrame:
    """the prepared ``lineitem`` table (ship date also as int64 ns)."""
    return _db(spark, sf, ["lineitem"]).get_table("lineitem")


def q_drop_text(spark: SparkSession, sf: str) -> DataFrame:
    """documents' ``text`` column is declared text and never becomes a feature."""
    db = _db(spark, sf, ["documents"])
    return synthesize(db, doc_quality_task(spark, sf), {"doc_id": "documents.doc_id"}, None, {"max_depth": 2}).df


QUERIES = {
    "direct_features": q_direct_features,
    "agg_numeric_cutoff": q_agg_numeric_cutoff,
    "prefix_window_agg": q_prefix_window_agg,
    "agg_mode_cutoff": q_agg_mode_cutoff,
    "agg_median_cutoff": q_agg_median_cutoff,
    "agg_no_cutoff": q_agg_no_cutoff,
    "cutoff_boundary": q_cutoff_boundary,
    "stacked_agg_of_agg": q_stacked_agg_of_agg,
    "stacked_agg_of_direct": q_stacked_agg_of_direct,
    "stacked_direct_of_agg": q_stacked_direct_of_agg,
    "multi_key_mapping": q_multi_key_mapping,
    "dummy_table": q_dummy_table,
    "dummy_table_keys": q_dummy_table_keys,
    "fill_missing_pk": q_fill_missing_pk,
    "epoch_ns": q_epoch_ns,
    "drop_text": q_drop_text,
}


# ---- second batch: preprocessing, sampling, history, keys, metrics, datasets, estimators ----------
from .operators.estimator import RelationalClassifier, RelationalRegressor  # noqa: E402
from .operators.history import add_target_history  # noqa: E402
from .operators.merged import GaussianBayes, LeastSquares  # noqa: E402
from .operators.metrics import mean_absolute_error, roc_auc  # noqa: E402
from .operators.nearest import NearestContext  # noqa: E402
from .operators.textfeatures import ngram_counts  # noqa: E402
from .operators.preprocess import (DatetimeFeatureGenerator, SafeLabelEncoderTransformer,  # noqa: E402
                                   TabularPreprocessor, TemporalDiffConfig, TemporalDiffTransformer,
                                   TypeCastTransformer)
from .operators.sampling import downsample  # noqa: E402
from .sources.tasks import Dataset, Task, TaskMetadata, normalize_keys, shift_task_time  # noqa: E402
from .session import ensure_checkpoint_dir  # noqa: E402
from .functions.scalar import key_to_string  # noqa: E402


def _price_features(spark, sf, prims=("max", "min", "mean", "std", "count")):
    db = _db(spark, sf, ["customer", "orders"])
    return synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": list(prims)})


def q_temporal_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch features -> ``cutoff_ns - value`` (``*_diff``), std of epoch dropped."""
    df = _price_features(spark, sf).df
    return TemporalDiffTransformer(TemporalDiffConfig(), "cutoff_time").fit(df).transform(df)


def q_drop_std_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """With no cutoff column T2 only drops the std-of-epoch columns (by name)."""
    df = _price_features(spark, sf).df
    return TemporalDiffTransformer(TemporalDiffConfig(), None).fit(df).transform(df)


def q_shift_time(spark: SparkSession, sf: str) -> DataFrame:
    """every order's cutoff moved one second later, so orders of the same instant (the
    order itself included) become visible."""
    t = order_task(spark, sf).select("o_orderkey", "o_custkey", "cutoff_time", "target")
    task = shift_task_time(Task("orders", t, t, TaskMetadata({"o_custkey": "customer.c_custkey"}, "target",
                                                              "cutoff_time")), 1).train_df
    db = _db(spark, sf, ["customer", "orders"])
    return synthesize(db, task.drop("target"), {"o_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": ["max", "count"]}).df


def _typed_orders(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("boolean"))
                    .otherwise(F.col("o_orderstatus") == "F").alias("is_final"),
                    F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("int"))
                    .otherwise(F.length("o_orderpriority")).alias("prio_len"),
                    "o_totalprice", "o_orderpriority")


def q_type_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Nullable boolean and nullable integer -> float32; double and string kept."""
    df = _typed_orders(spark, sf)
    return TypeCastTransformer().fit(df).transform(df)


def q_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all orders = rank among the sorted distinct values of orders placed before
    1998; later values get codes after them."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    early = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    return SafeLabelEncoderTransformer().fit(early).transform(o.drop("o_orderdate"))


def q_label_encode_all(spark: SparkSession, sf: str) -> DataFrame:
    """As ``label_encode``, but all orders are encoded: values that only later orders
    have get codes after the earlier ones."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    train = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    return SafeLabelEncoderTransformer().fit(train).transform(o.drop("o_orderdate"))


def q_label_encode_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted without priority 5-LOW; at transform that value is unseen and gets
    the next code, seen codes unchanged."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    enc = SafeLabelEncoderTransformer().fit(o.where(F.col("o_orderpriority") != "5-LOW"))
    return enc.transform(o)


def q_datetime_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The cutoff column as int64 ns plus year, month, day, day of week (Monday 0)."""
    df = order_task(spark, sf).select("o_orderkey", "cutoff_time")
    return DatetimeFeatureGenerator().fit(df).transform(df)


def q_drop_constant(spark: SparkSession, sf: str) -> DataFrame:
    """T4: cutoff before all facts -> every aggregate is null or 0 and the cutoff itself is
    constant; all of those columns are dropped."""
    db = _db(spark, sf, ["customer", "orders"])
    task = read_table(spark, sf, "customer").select(
        "c_custkey", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("cutoff_time"))
    df = synthesize(db, task, {"c_custkey": "customer.c_custkey"}, "cutoff_time", {"max_depth": 2}).df
    return DatetimeFeatureGenerator().fit(df).transform(df)


def q_sample_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """L2: 1,000 orders (regression target) by md5 order, seed 42."""
    return downsample(order_task(spark, sf), "target", 1000, "regression", seed=42, id_cols=["o_orderkey"])


_LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def q_sample_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """L3: 1,000 line items: one per return flag, the rest uniform."""
    return downsample(line_task(spark, sf), "target", 1000, "classification", False, 42, _LINE_IDS)


def q_sample_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """L4: 1,000 line items, class-balanced (quota 333 per flag), shortfall filled uniformly."""
    return downsample(line_task(spark, sf), "target", 1000, "classification", True, 42, _LINE_IDS)


def q_sample_coverage_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """L3 where ids repeat: line items known by their order only; exactly 1,000 rows."""
    return downsample(line_task(spark, sf).select("target", "l_orderkey"), "target", 1000, "classification", False, 42, ["l_orderkey"])


def q_sample_balanced_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """L4 where ids repeat: line items known by their order only; exactly 1,000 rows."""
    return downsample(line_task(spark, sf).select("target", "l_orderkey"), "target", 1000, "classification", True, 42, ["l_orderkey"])


def q_agg_mean_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """A3 over values that fixed-point sums can't hold: prices scaled by 1e-14 and by 1e18."""
    line = read_table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * 1.234567e-14).alias("tiny"), (F.col("l_extendedprice") * 1.234567e18).alias("huge"))
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    db = create_rdb("prices", {"orders": orders, "line": line}, {"orders": "o_orderkey"}, [("line", "l_orderkey", "orders", "o_orderkey")], {})
    df = synthesize(db, orders, {"o_orderkey": "orders.o_orderkey"}, None, {"max_depth": 2, "agg_primitives": ["mean", "max", "count"]}).df
    return df.select("o_orderkey", F.col("orders_MEAN_line_tiny").alias("mean_tiny"), (F.col("orders_MEAN_line_huge") / 1e18).alias("mean_huge"),
                     F.col("orders_MAX_line_tiny").alias("max_tiny"), (F.col("orders_MAX_line_huge") / 1e18).alias("max_huge"), F.col("orders_COUNT_line").alias("lines"))


def q_map_by_column(spark: SparkSession, sf: str) -> DataFrame:
    """J1 by a column that is not the primary key: customers mapped to nations by name."""
    db = _db(spark, sf, ["region", "nation", "customer"])
    names = read_table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation_name"))
    task = read_table(spark, sf, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "nation_name")
    return synthesize(db, task, {"nation_name": "nation.n_name"}, None, {"max_depth": 2, "agg_primitives": ["count"]}).df


def q_duplicate_parent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """J2 where a parent's key repeats: each order looks up line items by order; one row stays
    for each order, the smallest line item in column order."""
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    db = create_rdb("lines", {"lineitem": line}, {}, [], {})
    task = read_table(spark, sf, "orders").select("o_orderkey")
    return synthesize(db, task, {"o_orderkey": "lineitem.l_orderkey"}, None, {"max_depth": 2}).df


def _churn_train(spark, sf):
    return customer_quarter_task(spark, sf).select("c_custkey", "cutoff_time", "churn")


def q_target_history(spark: SparkSession, sf: str) -> DataFrame:
    """The full training frame attached as the history child of ``customer``."""
    db = add_target_history(load_test_db(spark, sf, tables=("customer",)), _churn_train(spark, sf),
                            {"c_custkey": "customer.c_custkey"}, "cutoff_time")
    return prepare_db(db).get_table("_relfeat_target_history")


def q_target_history_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates of each customer's strictly earlier labels."""
    db = prepare_db(add_target_history(load_test_db(spark, sf, tables=("customer",)), _churn_train(spark, sf),
                                       {"c_custkey": "customer.c_custkey"}, "cutoff_time"))
    return synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": ["max", "mean", "count"]}).df


def q_prepare_db(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, columns, non-null values and latest epoch of every table of the prepared database
    (dummy ``users`` included)."""
    db = prepare_db(load_test_db(spark, sf))

    def contents(name):
        df = db.get_table(name)
        epochs = [F.max(c) for c in df.columns if c.endswith("_epochtime")]
        return df.agg(F.count(F.lit(1)).alias("n_rows"), sum((F.count(c) for c in df.columns), F.lit(0)).alias("n_values"),
                      (epochs[0] if epochs else F.lit(None)).cast("string").alias("last_epoch")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(sorted(df.columns))).alias("column_names"), "n_rows", "n_values", "last_epoch")

    parts = [contents(t) for t in sorted(db.table_names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_float_key_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """K1/K2/K3: integral and float-with-NaN keys in canonical string form."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(
            F.col("o_custkey").cast("double")).alias("cust_f"))
    t = Task("t", o, o, TaskMetadata({"cust_f": "customer.c_custkey"}, "o_orderkey"))
    _, tasks = normalize_keys(load_test_db(spark, sf, tables=("customer",)), [t], ["cust_f"])
    df = tasks[0].train_df
    return df.select(key_to_string(F.col("o_orderkey"), o.schema["o_orderkey"].dataType).alias("o_orderkey"), "cust_f")


def q_validate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """K5: duplicate primary keys and orphan foreign keys, with BUILDING customers removed."""
    db = load_test_db(spark, sf, tables=("nation", "customer", "orders"))
    db = db.with_table("customer", db.get_table("customer").where(F.col("c_mktsegment") != "BUILDING"))
    db.validate_key_consistency()
    return db.key_report()


def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """M1: exact AUC of order price as a score for 'status F'."""
    o = read_table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), "o_totalprice")
    return roc_auc(o, "label", "o_totalprice")


def q_mae(spark: SparkSession, sf: str) -> DataFrame:
    """M2: MAE of 'price = mean of the customer's earlier orders' over orders that have one."""
    df = q_cutoff_boundary(spark, sf).join(order_task(spark, sf).select("o_orderkey", "target"), "o_orderkey")
    return mean_absolute_error(df.where(F.col("customer_MEAN_orders_o_totalprice").isNotNull()),
                               "target", "customer_MEAN_orders_o_totalprice")


def _scratch(spark, name):
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/relfeat-{name}-{uuid.uuid4().hex}"


def q_dataset_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Database + churn task saved (Parquet + manifests) and loaded back; the
    rows of both loaded splits and loaded tables are returned, as text."""
    full = _churn_train(spark, sf)
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    task = Task("churn", full.where(F.col("cutoff_time") < cut), full.where(F.col("cutoff_time") >= cut),
                TaskMetadata({"c_custkey": "customer.c_custkey"}, "churn", "cutoff_time", "binary_classification", "auc"))
    ds = Dataset(load_test_db(spark, sf, tables=("customer", "orders")), [task])
    path = _scratch(spark, "dataset")
    ds.save(path)
    back = Dataset.load(spark, path)
    def texts(name, df, cols):
        return df.select(F.lit(name).alias("part"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("row_text"))

    t, cols = back.task("churn"), ["c_custkey", "cutoff_time", "churn"]
    parts = [texts("train", t.train_df, cols), texts("test", t.test_df, cols), texts("customer", back.rdb.get_table("customer"), ["c_custkey", "c_name", "c_nationkey"]),
             texts("orders", back.rdb.get_table("orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _imported_churn(spark, sf):
    full = _churn_train(spark, sf)
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    splits = {"train": full.where(F.col("cutoff_time") < cut), "test": full.where(F.col("cutoff_time") >= cut)}
    db = prepare_db(load_test_db(spark, sf, tables=("customer", "orders")))
    ds = Dataset.from_entity_tasks(db, [
        dict(name="churn", splits=splits, entity_table="customer", entity_col="c_custkey", target_col="churn",
             time_col="cutoff_time", task_type="binary_classification", metrics=["auc"]),
        dict(name="links", splits=splits, entity_table="customer", entity_col="c_custkey", target_col="churn",
             task_type="link_prediction")])
    return db, ds.task("churn")


def q_task_import_entity(spark: SparkSession, sf: str) -> DataFrame:
    """An entity-table task spec becomes key mapping ``c_custkey ->
    customer.c_custkey`` (a link-prediction spec is skipped); both splits get their
    entity attributes through that mapping."""
    db, t = _imported_churn(spark, sf)
    return synthesize(db, t.train_df.unionByName(t.test_df), t.metadata.key_mappings, t.metadata.time_col, {"max_depth": 1}).df


def q_task_import_entity_splits(spark: SparkSession, sf: str) -> DataFrame:
    """As ``task_import_entity``, for both splits, which ``split`` names."""
    db, t = _imported_churn(spark, sf)
    parts = [synthesize(db, df, t.metadata.key_mappings, t.metadata.time_col, {"max_depth": 1}).df.withColumn("split", F.lit(name))
             for name, df in (("train", t.train_df), ("test", t.test_df))]
    return parts[0].unionByName(parts[1])


def q_task_import_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Role-typed order task: ``o_custkey`` (foreign key) and ``o_orderkey``
    (primary key of target table ``orders``) are both mapped; the cutoff equals the order's
    own timestamp, so it is moved one second later to make the order itself visible."""
    t = order_task(spark, sf)
    db = prepare_db(load_test_db(spark, sf, tables=("customer", "orders")))
    ds = Dataset.from_role_tasks(db, [dict(
        name="price", splits={"train": t, "test": t}, target_table="orders", target_col="target",
        time_col="cutoff_time", task_type="regression", evaluation_metric="mae",
        columns=[{"name": "o_orderkey", "dtype": "primary_key"},
                 {"name": "o_custkey", "dtype": "foreign_key", "link_to": "customer.c_custkey"}])])
    task = shift_task_time(ds.task("price"), 1)
    return synthesize(db, task.test_df, task.metadata.key_mappings, task.metadata.time_col, {"max_depth": 1}).df


def _estimator_split(spark, sf, target):
    full = customer_quarter_task(spark, sf).select("c_custkey", "cutoff_time", target)
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return full.where(F.col("cutoff_time") < cut), full.where(F.col("cutoff_time") >= cut).drop(target)


def _fitted_chain(spark, sf):
    train, _ = _estimator_split(spark, sf, "churn")
    db = _db(spark, sf, ["customer", "orders"])
    res = synthesize(db, train, {"c_custkey": "customer.c_custkey"}, "cutoff_time", {"max_depth": 2})
    feats = res.df.checkpoint(eager=True)
    pp = TabularPreprocessor(None, TemporalDiffConfig(), "cutoff_time",
                             [f.name for f in res.features if f.is_std_of_epoch], keep_columns=["churn"])
    return feats, pp.fit(feats)


def q_preprocess_chain(spark: SparkSession, sf: str) -> DataFrame:
    """T5: T1 -> T2 -> T3 -> T4 fitted on the churn training features, applied to them."""
    feats, pp = _fitted_chain(spark, sf)
    return pp.transform(feats)


def q_fit_predict_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Churn classifier (label history on, 2,000-row sample) with a pyspark.ml
    logistic regression; predictions for the 2000 cutoffs."""
    from pyspark.ml.classification import LogisticRegression
    train, test = _estimator_split(spark, sf, "churn")
    clf = RelationalClassifier(LogisticRegression(maxIter=20), {"max_train_samples": 2000})
    clf.fit(train, "churn", load_test_db(spark, sf, tables=("customer", "orders")),
            {"c_custkey": "customer.c_custkey"}, "cutoff_time")
    return clf.predict(test)


def q_fit_predict_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly spend regressor with pyspark.ml linear regression, fitted on all training
    rows."""
    from pyspark.ml.regression import LinearRegression
    train, test = _estimator_split(spark, sf, "spend")
    reg = RelationalRegressor(LinearRegression(maxIter=20), {"max_train_samples": None})
    reg.fit(train, "spend", load_test_db(spark, sf, tables=("customer", "orders")),
            {"c_custkey": "customer.c_custkey"}, "cutoff_time")
    return reg.predict(test)


_EXACT = {"agg_primitives": ["max", "min", "mean", "count"]}


def q_predict_proba(spark: SparkSession, sf: str) -> DataFrame:
    """Churn probabilities from the nearest of all training rows."""
    train, test = _estimator_split(spark, sf, "churn")
    clf = RelationalClassifier(NearestContext(), {"max_train_samples": None, "dfs": _EXACT})
    clf.fit(train, "churn", load_test_db(spark, sf, tables=("customer", "orders")),
            {"c_custkey": "customer.c_custkey"}, "cutoff_time")
    return clf.predict_proba(test).select("c_custkey", "cutoff_time", F.element_at("probability", 2).alias("p_churn"))


def q_in_context_score(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly spend of the nearest of all training rows."""
    train, test = _estimator_split(spark, sf, "spend")
    reg = RelationalRegressor(NearestContext(regression=True), {"max_train_samples": None, "dfs": _EXACT})
    reg.fit(train, "spend", load_test_db(spark, sf, tables=("customer", "orders")),
            {"c_custkey": "customer.c_custkey"}, "cutoff_time")
    return reg.predict(test)


QUERIES.update({
    "temporal_diff": q_temporal_diff,
    "drop_std_epoch": q_drop_std_epoch,
    "shift_time": q_shift_time,
    "type_cast": q_type_cast,
    "label_encode": q_label_encode,
    "label_encode_all": q_label_encode_all,
    "label_encode_unseen": q_label_encode_unseen,
    "datetime_parts": q_datetime_parts,
    "drop_constant": q_drop_constant,
    "sample_uniform": q_sample_uniform,
    "sample_coverage": q_sample_coverage,
    "sample_balanced": q_sample_balanced,
    "sample_coverage_repeated": q_sample_coverage_repeated,
    "sample_balanced_repeated": q_sample_balanced_repeated,
    "agg_mean_extremes": q_agg_mean_extremes,
    "map_by_column": q_map_by_column,
    "duplicate_parent_rows": q_duplicate_parent_rows,
    "target_history": q_target_history,
    "target_history_mean": q_target_history_mean,
    "prepare_db": q_prepare_db,
    "float_key_normalize": q_float_key_normalize,
    "validate_keys": q_validate_keys,
    "roc_auc": q_roc_auc,
    "mae": q_mae,
    "dataset_round_trip": q_dataset_round_trip,
    "task_import_entity": q_task_import_entity,
    "task_import_entity_splits": q_task_import_entity_splits,
    "task_import_roles": q_task_import_roles,
    "preprocess_chain": q_preprocess_chain,
    "fit_predict_classifier": q_fit_predict_classifier,
    "fit_predict_regressor": q_fit_predict_regressor,
    "predict_proba": q_predict_proba,
    "in_context_score": q_in_context_score,
})


def q_stacked_prefix_window(spark: SparkSession, sf: str) -> DataFrame:
    """A8 through the prefix-window plan: every line item is a cutoff for its part; the part's
    earlier line items are aggregated together with their orders' attributes, each order
    visible only once its own date is before the cutoff."""
    db = _db(spark, sf, ["part", "lineitem", "orders"])
    task = line_task(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "cutoff_time")
    return synthesize(db, task, {"l_partkey": "part.p_partkey"}, "cutoff_time",
                      {"max_depth": 3, "agg_primitives": ["max", "mean", "mode", "count"],
                       "cutoff_strategy": "window"}).df


QUERIES["stacked_prefix_window"] = q_stacked_prefix_window


def q_prefix_bucketed_agg(spark: SparkSession, sf: str) -> DataFrame:
    """The hot-key prefix plan (time buckets of 30 days) on the ``agg_numeric_cutoff``
    features: no window spans a whole key."""
    db = _db(spark, sf, ["customer", "orders"])
    res = synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                     {"max_depth": 2, "agg_primitives": ["max", "min", "mean", "count", "std"],
                      "cutoff_strategy": "bucketed", "prefix_bucket_seconds": 30 * 86400})
    return _drop_std_epoch(res)


def q_prefix_bucketed_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Exact prefix mode through the hot-key bucketed plan."""
    db = _db(spark, sf, ["customer", "orders"])
    return synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": ["mode", "count"], "cutoff_strategy": "bucketed",
                       "prefix_bucket_seconds": 30 * 86400}).df


QUERIES["prefix_bucketed_agg"] = q_prefix_bucketed_agg
QUERIES["prefix_bucketed_mode"] = q_prefix_bucketed_mode


def q_sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    """Features carrying their display names (``customer.MAX(orders.o_orderdate_epochtime)``)
    go through T2; each epoch column comes out as its sanitised name plus ``_diff``."""
    res = _price_features(spark, sf, ("max", "min", "count"))
    df = res.df.select(*[F.col(c) for c in res.df.columns if c not in res.feature_names],
                       *[F.col(f.name).alias(f.display) for f in res.features])
    return TemporalDiffTransformer(TemporalDiffConfig(), "cutoff_time").fit(df).transform(df)


QUERIES["sanitize_names"] = q_sanitize_names


def q_prefix_median(spark: SparkSession, sf: str) -> DataFrame:
    """A7 without meeting rows and cutoffs: the ``agg_median_cutoff`` features from rank trees over
    sorted prefixes."""
    db = _db(spark, sf, ["customer", "orders"])
    return synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": ["median"], "cutoff_strategy": "window"}).df


def q_prefix_median_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """A7 with no task that holds a whole key: time buckets of 90 days and value ranges."""
    db = _db(spark, sf, ["customer", "orders"])
    return synthesize(db, _quarter_task(spark, sf), {"c_custkey": "customer.c_custkey"}, "cutoff_time",
                      {"max_depth": 2, "agg_primitives": ["median"], "cutoff_strategy": "bucketed", "prefix_bucket_seconds": 90 * 86400}).df


def _half_on_one_customer(orders: DataFrame) -> DataFrame:
    return orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(1)).otherwise(F.col("o_custkey")).cast("long"))


def q_skewed_key_agg(spark: SparkSession, sf: str) -> DataFrame:
    """J3/E4 with one hot key: half of all orders belong to customer 1, and each order is a cutoff.
    The plan is chosen per key: that customer's rows and cutoffs are dealt out by ranges of time."""
    db = load_test_db(spark, sf, tables=("customer", "orders"))
    db = prepare_db(db.with_table("orders", _half_on_one_customer(db.get_table("orders"))))
    task = _half_on_one_customer(order_task(spark, sf)).select("o_orderkey", "o_custkey", "cutoff_time")
    res = synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time",
                     {"max_depth": 2, "agg_primitives": ["max", "min", "mean", "std", "median", "mode", "count"], "hot_key_pairs": 100_000, "hot_bucket_rows": 500})
    return _drop_std_epoch(res)


def q_stacked_timed_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A8 with time at both levels and a cutoff per order: customer <- orders <- lineitem, where an
    order's line items appear one by one.  Spans of constant order features meet the cutoffs.
    Means of means depend on the order of summation in their last bits; they are rounded, those of
    times to milliseconds and in seconds."""
    db = load_test_db(spark, sf, tables=("customer", "orders", "lineitem"))
    db = prepare_db(db.with_table("lineitem", db.get_table("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")))
    task = order_task(spark, sf).select("o_orderkey", "o_custkey", "cutoff_time")
    df = synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time",
                    {"max_depth": 3, "agg_primitives": ["max", "min", "mean", "mode", "count"], "cutoff_strategy": "window"}).df
    rounded = {c: F.round(F.col(c) / 1e9, 3) if "epochtime" in c else F.round(c, 9) for c in df.columns if "_MEAN_orders_MEAN_" in c}
    return df.select(*[rounded.get(c, F.col(c)).alias(c) for c in df.columns])


QUERIES.update({
    "prefix_median": q_prefix_median,
    "prefix_median_bucketed": q_prefix_median_bucketed,
    "skewed_key_agg": q_skewed_key_agg,
    "stacked_timed_agg": q_stacked_timed_agg,
})


def q_target_history_by_column(spark: SparkSession, sf: str) -> DataFrame:
    """E2/J7 through a column that is not a primary key: customers' labels are the history of their
    nation, mapped by its name."""
    names = read_table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation_name"))
    home = read_table(spark, sf, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "nation_name")
    task = _churn_train(spark, sf).join(home, "c_custkey").select("c_custkey", "nation_name", "cutoff_time", "churn")
    mapping = {"nation_name": "nation.n_name"}
    db = prepare_db(add_target_history(load_test_db(spark, sf, tables=("nation",)), task.drop("c_custkey"), mapping, "cutoff_time"))
    return synthesize(db, task.drop("churn"), mapping, "cutoff_time", {"max_depth": 2, "agg_primitives": ["max", "mean", "count"]}).df


def q_preprocess_reload(spark: SparkSession, sf: str) -> DataFrame:
    """T5: the ``preprocess_chain`` stages saved, loaded and then applied."""
    feats, pp = _fitted_chain(spark, sf)
    path = _scratch(spark, "preprocessor")
    pp.save(spark, path)
    return TabularPreprocessor.load(spark, path).transform(feats)


QUERIES.update({
    "target_history_by_column": q_target_history_by_column,
    "preprocess_reload": q_preprocess_reload,
})


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def q_text_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """T4 with n-grams: all conversations' turns go through the preprocessor; the sparse vectors'
    entries in long form."""
    turns = _turns(spark, sf)
    pp = TabularPreprocessor({"enable_text_ngram_features": True}, keep_columns=["conv_id", "turn"]).fit(turns)
    out = pp.transform(turns)
    return ngram_counts(out, ["conv_id", "turn"], "text_ngrams", dict(pp.steps)["text"].vocabulary_["text"])


def q_text_special(spark: SparkSession, sf: str) -> DataFrame:
    """T4 with special features of text, through the preprocessor: the role becomes a code."""
    turns = _turns(spark, sf)
    config = {"enable_text_special_features": True, "drop_constant": False}
    return TabularPreprocessor(config, keep_columns=["conv_id", "turn"]).fit(turns).transform(turns)


QUERIES.update({
    "text_ngrams": q_text_ngrams,
    "text_special": q_text_special,
})


def q_label_encode_high_card(spark: SparkSession, sf: str) -> DataFrame:
    """Names (a value a row, most of them unseen, some null) and segments of all
    customers, by an encoder fitted on two segments."""
    c = read_table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    enc = SafeLabelEncoderTransformer().fit(c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')"))
    return enc.transform(c)


QUERIES["label_encode_high_card"] = q_label_encode_high_card


def _merged(spark, sf, estimator, target):
    train, test = _estimator_split(spark, sf, target)
    estimator.fit(train, target, load_test_db(spark, sf, tables=("customer", "orders")), {"c_custkey": "customer.c_custkey"}, "cutoff_time")
    return test


_MERGED = {"max_train_samples": None, "dfs": {"agg_primitives": ["count", "mean"]}}


def q_merged_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly spend by least squares over orders so far, their mean price and the account
    balance; a Python model fitted on all training rows in their partitions."""
    reg = RelationalRegressor(LeastSquares(["customer_COUNT_orders", "customer_MEAN_orders_o_totalprice", "customer_c_acctbal"]), _MERGED)
    test = _merged(spark, sf, reg, "spend")
    return reg.predict(test).withColumn("prediction", F.round("prediction", 1))


def q_merged_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Churn by naive Bayes over the same features, fitted likewise: its probability and
    the label of the largest one."""
    clf = RelationalClassifier(GaussianBayes(["customer_COUNT_orders", "customer_MEAN_orders_o_totalprice", "customer_c_acctbal"]), _MERGED)
    test = _merged(spark, sf, clf, "churn")
    p = clf.predict_proba(test)
    return p.select("c_custkey", "cutoff_time", F.round(F.element_at("probability", 2), 5).alias("p_churn"),
                    F.when(F.element_at("probability", 2) > F.element_at("probability", 1), 1).otherwise(0).alias("prediction"))


QUERIES.update({"merged_regressor": q_merged_regressor, "merged_classifier": q_merged_classifier})
