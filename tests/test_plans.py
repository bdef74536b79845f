"""Plans that don't meet child rows and cutoffs, held against brute force and against the join plan."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relfeat import create_rdb, synthesize
from relfeat.operators.prepare import prepare_db
from relfeat.plans.prefix_rank import bucketed_medians, place_among, range_select, whole_groups, window_medians
from relfeat.plans.spans import nodes_above, nodes_of

DAY = dt.datetime(2021, 1, 1)


def test_range_select_equals_sorting():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        code, weight = rng.integers(0, 9, n), rng.integers(0, 4, n)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 200))
        total = np.array([weight[a:b].sum() for a, b in zip(lo, hi)])
        lo, hi, total = lo[total > 0], hi[total > 0], total[total > 0]
        rank = rng.integers(0, total)
        found, rest = range_select(code, weight, lo, hi, rank)
        for a, b, r, f, left in zip(lo, hi, rank, found, rest):
            spread = np.repeat(code[a:b], weight[a:b])
            assert np.sort(spread)[r] == f and left == r - (spread < f).sum()


def _medians(rows, queries):
    out = {}
    for k, g, t in queries:
        x = [v for a, b, s, v in rows if (a, b) == (k, g) and s < t]
        if x:
            out[k, g, t] = float(np.median(x))
    return out


@pytest.fixture(scope="module")
def events(spark):
    """Half of all events on one key, a third of them at one instant, many equal values."""
    rnd = random.Random(5)
    rows = [(rnd.choice("aaaaabcd") if i % 3 else "a", i % 2, rnd.choice([50, rnd.randint(0, 100)]), float(rnd.choice([7, rnd.randint(0, 40), rnd.random()]))) for i in range(1500)]
    queries = sorted({(rnd.choice("aaabce"), rnd.randint(0, 1), rnd.randint(0, 105)) for _ in range(400)})
    frame = spark.createDataFrame(rows, "k string, g int, t long, x double").repartition(3)
    return rows, queries, frame, spark.createDataFrame(queries, "k string, g int, t long")


def test_window_medians(events):
    rows, queries, frame, asked = events
    for piece in (40, 10_000):
        got = {(r.k, r.g, r.t): r.m for r in window_medians(frame, asked, "k", "g", "t", "x", piece).collect()}
        assert got == pytest.approx(_medians(rows, queries)) and len(got) > 200


@pytest.mark.parametrize("instants", [False, True])
def test_bucketed_medians(events, instants):
    rows, queries, frame, asked = events
    bounds = F.array(*[F.lit(b).cast("long") for b in (10, 30, 50, 70, 90)])
    bucket = place_among(bounds, F.col("t")) if instants else F.floor(F.col("t") / 20)
    frame, asked = frame.withColumn("bucket", bucket), asked.withColumn("bucket", bucket)
    got = {(r.k, r.g, r.t): r.m for r in bucketed_medians(frame, asked, "k", "g", "t", "x", 5, 3, instants, 100).collect()}
    assert got == pytest.approx(_medians(rows, queries)) and len(got) > 200


def test_pieces_hold_whole_groups(spark):
    import pyarrow as pa
    values = np.sort(np.random.default_rng(1).integers(0, 30, 500))
    batches = pa.table({"k": values, "x": values}).to_batches(max_chunksize=7)
    pieces = list(whole_groups(iter(batches), 1, 40))
    assert np.concatenate([t.column("x").to_numpy() for t, _ in pieces]).tolist() == values.tolist()
    firsts = [set(t.column("k").to_pylist()) for t, _ in pieces]
    assert sum(map(len, firsts)) == len(set(values)) and len(pieces) > 5
    assert all((start == np.searchsorted(t.column("k").to_numpy(), t.column("k").to_numpy())).all() for t, start in pieces)
    assert list(whole_groups(iter([]), 1, 40)) == []


def test_nodes_cover_a_span_once_and_lie_above_its_numbers(spark):
    spans = spark.createDataFrame([(a, b) for a in range(17) for b in range(a + 1, 20)], "a long, b long")
    count = 19
    above = {r.i: {tuple(n) for n in r.n} for r in spark.range(count).select(F.col("id").alias("i"), nodes_above(F.col("id"), F.lit(count).cast("long")).alias("n")).collect()}
    for r in spans.select("a", "b", nodes_of(F.col("a"), F.col("b")).alias("n")).collect():
        nodes = [tuple(n) for n in r.n]
        assert len(nodes) <= 2 * math.log2(r.b) + 1
        assert all(sum(n in above[i] for n in nodes) == (r.a <= i < r.b) for i in range(count))


@pytest.fixture(scope="module")
def three_levels(spark):
    """users <- orders <- items, timed twice; half of all orders on one user; ties, null keys and
    times, items before their order, an order id that two orders share."""
    rnd = random.Random(11)
    day = lambda n: DAY + dt.timedelta(days=n)
    users = [(i, f"u{i}") for i in range(6)]
    orders = [(i, rnd.choice([1, 1, 1, rnd.randint(0, 5), None]), day(rnd.randint(0, 30)) if i % 17 else None, float(rnd.randint(0, 9)), rnd.choice(["x", "y", None])) for i in range(120)]
    orders.append((5, 1, day(12), 3.0, "y"))
    items = [(i, rnd.choice([7, rnd.randint(0, 125), None]), day(rnd.randint(0, 40)) if i % 19 else None, rnd.choice([None, rnd.randint(1, 5)]), rnd.choice("pqr")) for i in range(500)]
    db = create_rdb("d", {"users": spark.createDataFrame(users, "uid long, name string"),
                          "orders": spark.createDataFrame(orders, "oid long, uid long, at timestamp_ntz, price double, kind string"),
                          "items": spark.createDataFrame(items, "iid long, oid long, at timestamp_ntz, n long, flag string")},
                    {"users": "uid", "items": "iid"}, [("orders", "uid", "users", "uid"), ("items", "oid", "orders", "oid")], {"orders": "at", "items": "at"})
    task = spark.createDataFrame([(u, day(d)) for u in range(7) for d in range(0, 45, 2)] + [(None, day(3)), (1, None)], "uid long, cutoff timestamp_ntz")
    return prepare_db(db), task


def _features(db, task, **config):
    res = synthesize(db, task, {"uid": "users.uid"}, "cutoff", config)
    rows = sorted(([str(r.uid), str(r.cutoff)] + [r[n] for n in sorted(res.feature_names)] for r in res.df.collect()), key=lambda r: r[:2])
    return sorted(res.feature_names), rows


def _same(left, right):
    assert left[0] == right[0] and len(left[1]) == len(right[1])
    for a, b in zip(left[1], right[1]):
        for name, x, y in zip(["uid", "cutoff", *left[0]], a, b):
            assert x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (a[:2], name, x, y)


PRIMS = ["max", "min", "mean", "std", "mode", "count"]


def test_spans_equal_the_join_plan(three_levels):
    db, task = three_levels
    _same(_features(db, task, max_depth=3, agg_primitives=PRIMS, cutoff_strategy="window"), _features(db, task, max_depth=3, agg_primitives=PRIMS, cutoff_strategy="join"))


def test_hot_keys_are_split_off(three_levels, monkeypatch):
    from relfeat.plans.synthesis import _Planner
    db, task = three_levels
    prims = PRIMS + ["median"]
    want = _features(db, task, max_depth=2, agg_primitives=prims, cutoff_strategy="join")
    split = []
    own = _Planner._split_hot
    monkeypatch.setattr(_Planner, "_split_hot", lambda self, *a: split.append(a[-1]) or own(self, *a))
    for per_key in (1e9, 0.0):  # the others by the join plan, and by windows
        got = _features(db, task, max_depth=2, agg_primitives=prims, hot_key_pairs=500, hot_key_rows=40, hot_bucket_rows=5, window_cutoffs_per_key=per_key)
        _same(got, want)
    assert [[k for k, _, _ in hot] for hot in split] == [[1], [1]]
    _same(_features(db, task, max_depth=3, agg_primitives=["max", "mean", "count"], hot_key_pairs=500, hot_bucket_rows=5, window_cutoffs_per_key=1e9),
          _features(db, task, max_depth=3, agg_primitives=["max", "mean", "count"], cutoff_strategy="join"))
    assert len(split) == 3


def test_unknown_strategies_raise(three_levels):
    db, task = three_levels
    with pytest.raises(ValueError):
        synthesize(db, task, {"uid": "users.uid"}, "cutoff", {"cutoff_strategy": "sorted"})


def test_hot_rows_are_not_dealt_by_key(spark, shop, monkeypatch):
    """Where query sets are too large to be broadcast, rows of a hot key leave the others' join by key
    and meet their own keys in a broadcast join."""
    from relfeat.plans.synthesis import _Planner
    orders = shop.get_table("orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(1)).otherwise(F.col("o_custkey")).cast("long"))
    db = prepare_db(shop.with_table("orders", orders))
    task = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("cutoff_time"))
    asked, own = [], _Planner._meeting
    monkeypatch.setattr(_Planner, "_meeting", staticmethod(lambda q, small: asked.append((q, small)) or own(q, small)))
    dealt, window = [], _Planner._child_aggs_window
    monkeypatch.setattr(_Planner, "_child_aggs_window", lambda self, *a: dealt.append(a) or window(self, *a))
    config = {"max_depth": 2, "agg_primitives": ["max", "median", "mode", "count"], "cutoff_strategy": "window", "hot_key_rows": 100, "hot_bucket_rows": 50}
    run = lambda **more: synthesize(db, task, {"o_custkey": "customer.c_custkey"}, "cutoff_time", {**config, **more}).df
    large = run(broadcast_rows=10)
    assert [small for q, small in asked if q.columns == ["__k"]] == [False, True]
    hot = orders.where("o_custkey = 1").count()
    rows = [orders.where(a[6]).count() for a in dealt]
    assert rows == [orders.count() - hot, hot]
    plain = run(hot_key_rows=10 ** 9)
    assert large.exceptAll(plain).count() == 0 and plain.exceptAll(large).count() == 0


def _broadcasts(df):
    """How many joins of the plan broadcast a side."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("strategy", ["join", "window", "bucketed"])
def test_large_tasks_broadcast_nothing_by_estimate(spark, shop, strategy):
    """Beyond the checked sizes neither query sets (multiplied by an array) nor tables are broadcast."""
    days = F.array(*[F.lit(dt.datetime(1998, m, 1)).cast("timestamp_ntz") for m in range(1, 13)])
    task = shop.get_table("customer").select("c_custkey", F.explode(days).alias("cutoff_time"))
    prims = {"max_depth": 2, "agg_primitives": ["max", "count", "mode"], "cutoff_strategy": strategy}
    mapping = {"c_custkey": "customer.c_custkey"}
    db = prepare_db(shop)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")  # more than the tables' files, less than what joins make
    try:
        large = synthesize(db, task, mapping, "cutoff_time", {**prims, "broadcast_rows": 10}).df
        assert _broadcasts(large) == 0
        wide = synthesize(db, task, mapping, "cutoff_time", {**prims, "broadcast_bytes": 10}).df
        assert _broadcasts(wide) == 0
        small = synthesize(db, task, mapping, "cutoff_time", prims).df
        assert _broadcasts(small) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert large.exceptAll(small).count() == 0 and small.exceptAll(large).count() == 0


def test_broadcasts_are_bounded_by_bytes():
    from types import SimpleNamespace

    from pyspark.sql import types as T

    from relfeat.plans.synthesis import DFSConfig, _Planner
    frame = lambda n, kind: SimpleNamespace(schema=T.StructType([T.StructField(f"c{i}", kind) for i in range(n)]), columns=[f"c{i}" for i in range(n)])
    planner = _Planner(SimpleNamespace(), DFSConfig(), "join", 1_200_000)
    assert not planner.fits_broadcast(frame(2, T.LongType())) and not planner.fits_broadcast(frame(24, T.LongType()))
    planner.task_rows = 240_000
    assert planner.fits_broadcast(frame(2, T.LongType())) and not planner.fits_broadcast(frame(8, T.StringType()))


def test_only_groups_over_several_partitions_have_offsets(spark):
    from relfeat.operators.ranking import exclusive_prefix_sums
    rows = [(g, t, 1) for g in "abcdefgh" for t in range(5)] + [("hot", t, 1) for t in range(200)] + [(None, 1, 1)]
    got = exclusive_prefix_sums(spark.createDataFrame(rows, "g string, t int, one long").repartition(4), ["t"], ["one"], group_col="g", partitions=6)
    found = {(r.g, r.t): r.one_before for r in got.collect()}
    assert len(found) == len(rows) and all(n == (None if g is None else t) for (g, t), n in found.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__nth" in plan and "BroadcastHashJoin" in plan  # fewer rows than partitions


def test_merged_partitions_are_bounded(spark):
    from relfeat.session import ADVISORY, ADVISORY_BYTES, apply_session_defaults, size_in_bytes
    before = spark.conf.get(ADVISORY)
    try:
        for given, want in (("64MB", ADVISORY_BYTES), ("67108864b", ADVISORY_BYTES), ("1g", ADVISORY_BYTES), ("8m", 8 << 20), ("300", 300)):
            spark.conf.set(ADVISORY, given)
            apply_session_defaults(spark)
            assert size_in_bytes(spark.conf.get(ADVISORY)) == want
    finally:
        spark.conf.set(ADVISORY, before)


def test_many_parent_keys_are_not_broadcast(spark):
    from relfeat.operators.prepare import BROADCAST_BYTES, _fits_broadcast
    assert _fits_broadcast(spark.range(100_000).toDF("k"), BROADCAST_BYTES) and not _fits_broadcast(spark.range(900_000).toDF("k"), BROADCAST_BYTES)
    texts = spark.range(100_000).selectExpr("lpad(cast(id AS string), 60, '0') AS k")
    assert not _fits_broadcast(texts, BROADCAST_BYTES)


def test_events_multiply_after_their_shuffle(spark):
    """The window plan deals rows and cutoffs out by key alone, before a row becomes several events."""
    rng = random.Random(11)
    day = lambda: DAY + dt.timedelta(days=rng.randrange(30))
    parents = spark.createDataFrame([(i,) for i in range(6)], "pid long")
    orders = spark.createDataFrame([(i, rng.choice("xyz"), round(rng.random(), 2), day()) for i in range(20)], "oid long, status string, price double, ot timestamp_ntz")
    lines = spark.createDataFrame([(i, rng.choice([0, 1, 2, 3, None]), rng.choice([*range(22), None]), rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, None]), rng.choice([day(), None])) for i in range(300)],
                                  "lid long, pid long, oid long, flag string, qty double, lt timestamp_ntz")
    db = prepare_db(create_rdb("d", {"p": parents, "o": orders, "l": lines}, {"p": "pid", "o": "oid", "l": "lid"},
                               [("l", "pid", "p", "pid"), ("l", "oid", "o", "oid")], {"o": "ot", "l": "lt"}))
    task = spark.createDataFrame([(i, rng.randrange(7), day()) for i in range(80)], "n long, pid long, cutoff timestamp_ntz")
    got = {s: synthesize(db, task, {"pid": "p.pid"}, "cutoff", {"max_depth": 3, "agg_primitives": ["max", "mean", "mode", "count"], "cutoff_strategy": s}).df
           for s in ("window", "join")}
    plan = got["window"]._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(__k" in line]
    assert shuffled and not any("__ci" in line for line in shuffled)
    rows = {s: sorted(map(str, df.select("n", *sorted(df.columns)).collect())) for s, df in got.items()}
    assert rows["window"] == rows["join"]


def _exchanges(df):
    """(dealt by, columns) of each shuffle in the plan, joins and aggregates included."""
    import re
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [(by, given.split(", ")) for given, by in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*?), \d+\)", text)]


def test_features_of_cutoffs_stay_with_their_key(three_levels, monkeypatch):
    """Aggregates made by key are joined back by key and cutoff without being dealt out again; only task
    rows of few keys meet their features by both."""
    db, task = three_levels
    run = lambda: synthesize(db, task, {"uid": "users.uid"}, "cutoff", {"max_depth": 2, "agg_primitives": PRIMS, "cutoff_strategy": "window", "broadcast_rows": 0}).df
    assert len([by for by, _ in _exchanges(run()) if "coalesce" in by]) == 2  # null-safe cutoffs
    monkeypatch.setattr("relfeat.plans.synthesis.FEW_KEYS", 0)
    assert [by for by, _ in _exchanges(run()) if "coalesce" in by] == []
    _same(_features(db, task, max_depth=2, agg_primitives=PRIMS, cutoff_strategy="window", broadcast_rows=0), _features(db, task, max_depth=2, agg_primitives=PRIMS, cutoff_strategy="join"))


def test_spans_multiply_after_their_shuffle(three_levels):
    """A row goes to its key before it becomes many nodes; numbers and categories do so together."""
    db, task = three_levels
    config = {"max_depth": 3, "agg_primitives": PRIMS, "cutoff_strategy": "window"}
    found = _exchanges(synthesize(db, task, {"uid": "users.uid"}, "cutoff", {**config, "broadcast_rows": 0}).df)
    assert not [by for by, given in found if "height" in by or any(g.startswith("height") for g in given)]
    _same(_features(db, task, **config, broadcast_rows=0), _features(db, task, **{**config, "cutoff_strategy": "join"}))
