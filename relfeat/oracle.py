"""DuckDB twins of the registered queries, written by hand from the feature semantics (not
generated by the planner), over the pre-registered test tables.

Value conventions shared with the Spark side: means are an exact decimal sum divided by
the count (scale 0 for integers and epoch times, 10 for fractional columns) where decimals hold
all values, as in all queries but ``agg_mean_extremes``, whose twin is a plain average; ``mode`` is
the most frequent non-null value, smallest on ties; epoch times are ``epoch_ns``.
"""
from __future__ import annotations

import datetime as dt

from .sources.testdb import quarter_starts


def _ts(d: dt.datetime) -> str:
    return f"TIMESTAMP '{d:%Y-%m-%d %H:%M:%S}'"


QUARTERS = "(VALUES " + ", ".join(f"({_ts(q)})" for q in quarter_starts()) + ") q(cutoff_time)"
QUARTER_TASK = f"SELECT c.c_custkey, q.cutoff_time FROM customer c, {QUARTERS}"


def dbl(dec: str) -> str:
    """Correctly rounded DECIMAL -> DOUBLE (DuckDB's direct cast of wide decimals is not)."""
    return f"CAST(CAST({dec} AS VARCHAR) AS DOUBLE)"


def mean_int(x: str) -> str:
    return f"{dbl(f'SUM(CAST({x} AS DECIMAL(38,0)))')} / NULLIF(COUNT({x}), 0)"


def dec10(x: str) -> str:
    """A double as an exact decimal at scale 10: integral doubles beyond 2^53 through BIGINT,
    others through their decimal text (DuckDB's direct DOUBLE -> DECIMAL cast multiplies in
    floating point)."""
    return (f"CASE WHEN ABS({x}) >= 9007199254740992 THEN CAST(CAST({x} AS BIGINT) AS DECIMAL(38,10)) "
            f"ELSE CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10)) END")


def mean_dbl(x: str) -> str:
    return f"{dbl(f'SUM({dec10(x)})')} / NULLIF(COUNT({x}), 0)"


def mode_cte(name: str, src: str, keys: str, col: str) -> str:
    """CTE ``name(keys..., v)``: most frequent non-null ``col`` per ``keys`` in ``src``."""
    return (f"{name} AS (SELECT {keys}, v FROM (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY n DESC, v ASC) AS rn FROM (SELECT {keys}, {col} AS v, COUNT(*) AS n FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {keys}, {col})) WHERE rn = 1)")


CUST_ATTRS = ("c.c_name AS customer_c_name, c.c_acctbal AS customer_c_acctbal, "
              "c.c_mktsegment AS customer_c_mktsegment")

DIRECT_FEATURES = """
SELECT o.o_orderkey, o.o_custkey, c.c_name AS customer_c_name, c.c_acctbal AS customer_c_acctbal,
       c.c_mktsegment AS customer_c_mktsegment, n.n_name AS customer_nation_n_name,
       r.r_name AS customer_nation_region_r_name
FROM orders o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
"""

AGG_NUMERIC_CUTOFF = f"""
WITH task AS ({QUARTER_TASK}),
a AS (
  SELECT t.c_custkey, t.cutoff_time,
         MAX(o.o_totalprice) AS mx_p, MIN(o.o_totalprice) AS mn_p, {mean_dbl('o.o_totalprice')} AS av_p,
         STDDEV_SAMP(o.o_totalprice) AS sd_p,
         MAX(epoch_ns(o.o_orderdate)) AS mx_d, MIN(epoch_ns(o.o_orderdate)) AS mn_d,
         {mean_int('epoch_ns(o.o_orderdate)')} AS av_d, COUNT(*) AS n
  FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time
  GROUP BY t.c_custkey, t.cutoff_time)
SELECT t.c_custkey, t.cutoff_time, {CUST_ATTRS},
       a.mx_p AS customer_MAX_orders_o_totalprice, a.mn_p AS customer_MIN_orders_o_totalprice,
       a.av_p AS customer_MEAN_orders_o_totalprice, a.sd_p AS customer_STD_orders_o_totalprice,
       a.mx_d AS customer_MAX_orders_o_orderdate_epochtime, a.mn_d AS customer_MIN_orders_o_orderdate_epochtime,
       a.av_d AS customer_MEAN_orders_o_orderdate_epochtime, COALESCE(a.n, 0) AS customer_COUNT_orders
FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
"""

_QJOIN = "task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time"
AGG_MODE_CUTOFF = f"""
WITH task AS ({QUARTER_TASK}),
vis AS (SELECT t.c_custkey, t.cutoff_time, o.o_orderstatus, o.o_orderpriority FROM {_QJOIN}),
a AS (SELECT c_custkey, cutoff_time, COUNT(*) AS n FROM vis GROUP BY 1, 2),
{mode_cte('ms', 'vis', 'c_custkey, cutoff_time', 'o_orderstatus')},
{mode_cte('mp', 'vis', 'c_custkey, cutoff_time', 'o_orderpriority')}
SELECT t.c_custkey, t.cutoff_time, {CUST_ATTRS},
       COALESCE(a.n, 0) AS customer_COUNT_orders,
       ms.v AS customer_MODE_orders_o_orderstatus, mp.v AS customer_MODE_orders_o_orderpriority
FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
LEFT JOIN ms ON ms.c_custkey = t.c_custkey AND ms.cutoff_time = t.cutoff_time
LEFT JOIN mp ON mp.c_custkey = t.c_custkey AND mp.cutoff_time = t.cutoff_time
"""

AGG_MEDIAN_CUTOFF = f"""
WITH task AS ({QUARTER_TASK}),
a AS (SELECT t.c_custkey, t.cutoff_time, MEDIAN(o.o_totalprice) AS md_p,
             MEDIAN(CAST(epoch_ns(o.o_orderdate) AS DOUBLE)) AS md_d
      FROM {_QJOIN} GROUP BY 1, 2)
SELECT t.c_custkey, t.cutoff_time, {CUST_ATTRS},
       a.md_p AS customer_MEDIAN_orders_o_totalprice, a.md_d AS customer_MEDIAN_orders_o_orderdate_epochtime
FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
"""

AGG_NO_CUTOFF = f"""
WITH a AS (
  SELECT o.o_custkey AS k,
         MAX(o.o_totalprice) AS mx_p, MIN(o.o_totalprice) AS mn_p, {mean_dbl('o.o_totalprice')} AS av_p,
         STDDEV_SAMP(o.o_totalprice) AS sd_p,
         MAX(epoch_ns(o.o_orderdate)) AS mx_d, MIN(epoch_ns(o.o_orderdate)) AS mn_d,
         {mean_int('epoch_ns(o.o_orderdate)')} AS av_d, COUNT(*) AS n
  FROM orders o GROUP BY 1),
{mode_cte('ms', 'orders', 'o_custkey', 'o_orderstatus')},
{mode_cte('mp', 'orders', 'o_custkey', 'o_orderpriority')}
SELECT c.c_custkey, {CUST_ATTRS},
       a.mx_p AS customer_MAX_orders_o_totalprice, a.mn_p AS customer_MIN_orders_o_totalprice,
       a.av_p AS customer_MEAN_orders_o_totalprice, a.sd_p AS customer_STD_orders_o_totalprice,
       a.mx_d AS customer_MAX_orders_o_orderdate_epochtime, a.mn_d AS customer_MIN_orders_o_orderdate_epochtime,
       a.av_d AS customer_MEAN_orders_o_orderdate_epochtime, COALESCE(a.n, 0) AS customer_COUNT_orders,
       ms.v AS customer_MODE_orders_o_orderstatus, mp.v AS customer_MODE_orders_o_orderpriority
FROM customer c LEFT JOIN a ON a.k = c.c_custkey
LEFT JOIN ms ON ms.o_custkey = c.c_custkey LEFT JOIN mp ON mp.o_custkey = c.c_custkey
"""

CUTOFF_BOUNDARY = f"""
WITH task AS (SELECT o_orderkey, o_custkey, o_orderdate AS cutoff_time FROM orders),
d AS (SELECT DISTINCT o_custkey, cutoff_time FROM task),
a AS (
  SELECT d.o_custkey, d.cutoff_time,
         MAX(o.o_totalprice) AS mx_p, MIN(o.o_totalprice) AS mn_p, {mean_dbl('o.o_totalprice')} AS av_p,
         MAX(epoch_ns(o.o_orderdate)) AS mx_d, MIN(epoch_ns(o.o_orderdate)) AS mn_d,
         {mean_int('epoch_ns(o.o_orderdate)')} AS av_d, COUNT(*) AS n
  FROM d JOIN orders o ON o.o_custkey = d.o_custkey AND o.o_orderdate < d.cutoff_time
  GROUP BY 1, 2)
SELECT t.o_orderkey, t.o_custkey, t.cutoff_time, {CUST_ATTRS},
       a.mx_p AS customer_MAX_orders_o_totalprice, a.mn_p AS customer_MIN_orders_o_totalprice,
       a.av_p AS customer_MEAN_orders_o_totalprice,
       a.mx_d AS customer_MAX_orders_o_orderdate_epochtime, a.mn_d AS customer_MIN_orders_o_orderdate_epochtime,
       a.av_d AS customer_MEAN_orders_o_orderdate_epochtime, COALESCE(a.n, 0) AS customer_COUNT_orders
FROM task t LEFT JOIN customer c ON c.c_custkey = t.o_custkey
LEFT JOIN a ON a.o_custkey = t.o_custkey AND a.cutoff_time = t.cutoff_time
"""

_LI_NUM_INT = ["l_linenumber"]
_LI_NUM_DBL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_MEANS = ",\n         ".join(
    [f"{mean_int('l.' + c)} AS m_{c}" for c in _LI_NUM_INT] + [f"{mean_dbl('l.' + c)} AS m_{c}" for c in _LI_NUM_DBL]
    + [f"{mean_int('epoch_ns(l.l_shipdate)')} AS m_l_shipdate_epochtime"])
_LI_COLS = _LI_NUM_INT + _LI_NUM_DBL + ["l_shipdate_epochtime"]

STACKED_AGG_OF_AGG = f"""
WITH task AS (SELECT c_custkey, {_ts(dt.datetime(1999, 1, 1))} AS cutoff_time FROM customer),
ol AS (SELECT t.c_custkey, t.cutoff_time, o.o_orderkey, o.o_totalprice, epoch_ns(o.o_orderdate) AS od
       FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time),
li AS (SELECT ol.o_orderkey, ol.cutoff_time, {_LI_MEANS}, COUNT(*) AS n_li
       FROM ol JOIN lineitem l ON l.l_orderkey = ol.o_orderkey AND l.l_shipdate < ol.cutoff_time
       GROUP BY 1, 2),
ofe AS (SELECT ol.*, {', '.join('li.m_' + c for c in _LI_COLS)}, COALESCE(li.n_li, 0) AS n_li
        FROM ol LEFT JOIN li ON li.o_orderkey = ol.o_orderkey AND li.cutoff_time = ol.cutoff_time),
a AS (SELECT c_custkey, cutoff_time, {mean_dbl('o_totalprice')} AS av_p, {mean_int('od')} AS av_d,
             {', '.join(mean_dbl('m_' + c) + ' AS mm_' + c for c in _LI_COLS)},
             {mean_int('n_li')} AS av_n, COUNT(*) AS n
      FROM ofe GROUP BY 1, 2)
SELECT t.c_custkey, t.cutoff_time, {CUST_ATTRS},
       a.av_p AS customer_MEAN_orders_o_totalprice, a.av_d AS customer_MEAN_orders_o_orderdate_epochtime,
       {', '.join('a.mm_' + c + ' AS customer_MEAN_orders_MEAN_lineitem_' + c for c in _LI_COLS)},
       a.av_n AS customer_MEAN_orders_COUNT_lineitem, COALESCE(a.n, 0) AS customer_COUNT_orders
FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
"""

_PL = ("task t JOIN lineitem l ON l.l_partkey = t.p_partkey AND l.l_shipdate < t.cutoff_time "
       "LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey")
STACKED_AGG_OF_DIRECT = f"""
WITH task AS (SELECT p_partkey, {_ts(dt.datetime(1998, 1, 1))} AS cutoff_time FROM part),
vis AS (SELECT t.p_partkey, t.cutoff_time, l.*, epoch_ns(l.l_shipdate) AS sd, s.s_name, s.s_acctbal FROM {_PL}),
a AS (SELECT p_partkey, cutoff_time,
             MAX(l_linenumber) AS x_ln, {mean_int('l_linenumber')} AS m_ln,
             {', '.join(f'MAX({c}) AS x_{c}, ' + mean_dbl(c) + f' AS m_{c}' for c in _LI_NUM_DBL)},
             MAX(sd) AS x_sd, {mean_int('sd')} AS m_sd,
             MAX(s_acctbal) AS x_sa, {mean_dbl('s_acctbal')} AS m_sa, COUNT(*) AS n
      FROM vis GROUP BY 1, 2),
{mode_cte('mr', 'vis', 'p_partkey, cutoff_time', 'l_returnflag')},
{mode_cte('ml', 'vis', 'p_partkey, cutoff_time', 'l_linestatus')},
{mode_cte('mn', 'vis', 'p_partkey, cutoff_time', 's_name')}
SELECT t.p_partkey, t.cutoff_time, p.p_name AS part_p_name, p.p_brand AS part_p_brand, p.p_type AS part_p_type,
       CAST(p.p_size AS BIGINT) AS part_p_size, p.p_retailprice AS part_p_retailprice,
       a.x_ln AS part_MAX_lineitem_l_linenumber, a.m_ln AS part_MEAN_lineitem_l_linenumber,
       {', '.join(f'a.x_{c} AS part_MAX_lineitem_{c}, a.m_{c} AS part_MEAN_lineitem_{c}' for c in _LI_NUM_DBL)},
       a.x_sd AS part_MAX_lineitem_l_shipdate_epochtime, a.m_sd AS part_MEAN_lineitem_l_shipdate_epochtime,
       mr.v AS part_MODE_lineitem_l_returnflag, ml.v AS part_MODE_lineitem_l_linestatus,
       mn.v AS part_MODE_lineitem_supplier_s_name,
       a.x_sa AS part_MAX_lineitem_supplier_s_acctbal, a.m_sa AS part_MEAN_lineitem_supplier_s_acctbal,
       COALESCE(a.n, 0) AS part_COUNT_lineitem
FROM task t LEFT JOIN part p ON p.p_partkey = t.p_partkey
LEFT JOIN a ON a.p_partkey = t.p_partkey AND a.cutoff_time = t.cutoff_time
LEFT JOIN mr ON mr.p_partkey = t.p_partkey AND mr.cutoff_time = t.cutoff_time
LEFT JOIN ml ON ml.p_partkey = t.p_partkey AND ml.cutoff_time = t.cutoff_time
LEFT JOIN mn ON mn.p_partkey = t.p_partkey AND mn.cutoff_time = t.cutoff_time
"""

STACKED_DIRECT_OF_AGG = f"""
WITH a AS (SELECT c_nationkey AS k, MAX(c_acctbal) AS mx, MIN(c_acctbal) AS mn, {mean_dbl('c_acctbal')} AS av,
                  COUNT(*) AS n FROM customer GROUP BY 1),
{mode_cte('mc', 'customer', 'c_nationkey', 'c_name')},
{mode_cte('ms', 'customer', 'c_nationkey', 'c_mktsegment')}
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_shipdate AS cutoff_time,
       s.s_name AS supplier_s_name, s.s_acctbal AS supplier_s_acctbal, n.n_name AS supplier_nation_n_name,
       mc.v AS supplier_nation_MODE_customer_c_name, a.mx AS supplier_nation_MAX_customer_c_acctbal,
       a.mn AS supplier_nation_MIN_customer_c_acctbal, a.av AS supplier_nation_MEAN_customer_c_acctbal,
       ms.v AS supplier_nation_MODE_customer_c_mktsegment,
       CASE WHEN n.n_nationkey IS NULL THEN NULL ELSE COALESCE(a.n, 0) END AS supplier_nation_COUNT_customer
FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN a ON a.k = n.n_nationkey LEFT JOIN mc ON mc.c_nationkey = n.n_nationkey
LEFT JOIN ms ON ms.c_nationkey = n.n_nationkey
"""

MULTI_KEY_MAPPING = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate AS cutoff_time,
       p.p_name AS part_p_name, p.p_brand AS part_p_brand, p.p_type AS part_p_type,
       CAST(p.p_size AS BIGINT) AS part_p_size, p.p_retailprice AS part_p_retailprice,
       s.s_name AS supplier_s_name, s.s_acctbal AS supplier_s_acctbal
FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
"""

_DAYS = "(VALUES " + ", ".join(f"({_ts(dt.datetime(2024, 1, d))})" for d in (8, 15, 22)) + ") d(cutoff_time)"
USER_TASK = f"""
SELECT u.user_id, d.cutoff_time,
       CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = 'purchase'
                         AND e.ts >= d.cutoff_time AND e.ts < d.cutoff_time + INTERVAL 7 DAY) THEN 1 ELSE 0 END AS target
FROM (SELECT DISTINCT user_id FROM events) u, {_DAYS}
"""

DUMMY_TABLE = f"""
WITH task AS ({USER_TASK}),
vis AS (SELECT t.user_id, t.cutoff_time, e.* EXCLUDE (user_id), epoch_ns(e.ts) AS te
        FROM task t JOIN events e ON e.user_id = t.user_id AND e.ts < t.cutoff_time),
a AS (SELECT user_id, cutoff_time, MAX(te) AS x_t, MIN(te) AS n_t, {mean_int('te')} AS m_t,
             MAX(value) AS x_v, MIN(value) AS n_v, {mean_dbl('value')} AS m_v, STDDEV_SAMP(value) AS s_v,
             COUNT(*) AS n
      FROM vis GROUP BY 1, 2),
{mode_cte('me', 'vis', 'user_id, cutoff_time', 'event_type')}
SELECT t.user_id, t.cutoff_time, t.target,
       a.x_t AS users_MAX_events_ts_epochtime, a.n_t AS users_MIN_events_ts_epochtime,
       a.m_t AS users_MEAN_events_ts_epochtime, me.v AS users_MODE_events_event_type,
       a.x_v AS users_MAX_events_value, a.n_v AS users_MIN_events_value, a.m_v AS users_MEAN_events_value,
       a.s_v AS users_STD_events_value, COALESCE(a.n, 0) AS users_COUNT_events
FROM task t LEFT JOIN a ON a.user_id = t.user_id AND a.cutoff_time = t.cutoff_time
LEFT JOIN me ON me.user_id = t.user_id AND me.cutoff_time = t.cutoff_time
"""

DUMMY_TABLE_KEYS = "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL"

FILL_MISSING_PK = """
WITH kept AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT * FROM kept
UNION ALL
SELECT DISTINCT o_custkey AS c_custkey, NULL AS c_name, CAST(NULL AS INTEGER) AS c_nationkey,
       CAST(NULL AS DOUBLE) AS c_acctbal, NULL AS c_mktsegment
FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM kept)
"""

EPOCH_NS = """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
       epoch_ns(l_shipdate) AS l_shipdate_epochtime
FROM lineitem
"""

DROP_TEXT = """
SELECT l.doc_id, l.quality AS target, d.lang AS documents_lang, d.source AS documents_source,
       d.n_chars AS documents_n_chars
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id
"""

ORACLE_SQL = {
    "direct_features": DIRECT_FEATURES,
    "agg_numeric_cutoff": AGG_NUMERIC_CUTOFF,
    "prefix_window_agg": AGG_NUMERIC_CUTOFF,
    "agg_mode_cutoff": AGG_MODE_CUTOFF,
    "agg_median_cutoff": AGG_MEDIAN_CUTOFF,
    "agg_no_cutoff": AGG_NO_CUTOFF,
    "cutoff_boundary": CUTOFF_BOUNDARY,
    "stacked_agg_of_agg": STACKED_AGG_OF_AGG,
    "stacked_agg_of_direct": STACKED_AGG_OF_DIRECT,
    "stacked_direct_of_agg": STACKED_DIRECT_OF_AGG,
    "multi_key_mapping": MULTI_KEY_MAPPING,
    "dummy_table": DUMMY_TABLE,
    "dummy_table_keys": DUMMY_TABLE_KEYS,
    "fill_missing_pk": FILL_MISSING_PK,
    "epoch_ns": EPOCH_NS,
    "drop_text": DROP_TEXT,
}


# ---- second batch ------------------------------------------------------------------------------------
TEMPORAL_DIFF = f"""
WITH task AS ({QUARTER_TASK}),
a AS (
  SELECT t.c_custkey, t.cutoff_time,
         MAX(o.o_totalprice) AS mx_p, MIN(o.o_totalprice) AS mn_p, {mean_dbl('o.o_totalprice')} AS av_p,
         STDDEV_SAMP(o.o_totalprice) AS sd_p,
         MAX(epoch_ns(o.o_orderdate)) AS mx_d, MIN(epoch_ns(o.o_orderdate)) AS mn_d,
         {mean_int('epoch_ns(o.o_orderdate)')} AS av_d, COUNT(*) AS n
  FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time
  GROUP BY t.c_custkey, t.cutoff_time)
SELECT t.c_custkey, t.cutoff_time, {CUST_ATTRS},
       a.mx_p AS customer_MAX_orders_o_totalprice, a.mn_p AS customer_MIN_orders_o_totalprice,
       a.av_p AS customer_MEAN_orders_o_totalprice, a.sd_p AS customer_STD_orders_o_totalprice,
       CAST(epoch_ns(t.cutoff_time) - a.mx_d AS DOUBLE) AS customer_MAX_orders_o_orderdate_epochtime_diff,
       CAST(epoch_ns(t.cutoff_time) - a.mn_d AS DOUBLE) AS customer_MIN_orders_o_orderdate_epochtime_diff,
       CAST(epoch_ns(t.cutoff_time) AS DOUBLE) - a.av_d AS customer_MEAN_orders_o_orderdate_epochtime_diff,
       COALESCE(a.n, 0) AS customer_COUNT_orders
FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
"""

SHIFT_TIME = f"""
WITH task AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 1 SECOND AS cutoff_time FROM orders),
d AS (SELECT DISTINCT o_custkey, cutoff_time FROM task),
a AS (SELECT d.o_custkey, d.cutoff_time, MAX(o.o_totalprice) AS mx_p, MAX(epoch_ns(o.o_orderdate)) AS mx_d,
             COUNT(*) AS n
      FROM d JOIN orders o ON o.o_custkey = d.o_custkey AND o.o_orderdate < d.cutoff_time GROUP BY 1, 2)
SELECT t.o_orderkey, t.o_custkey, t.cutoff_time, {CUST_ATTRS},
       a.mx_p AS customer_MAX_orders_o_totalprice, a.mx_d AS customer_MAX_orders_o_orderdate_epochtime,
       COALESCE(a.n, 0) AS customer_COUNT_orders
FROM task t LEFT JOIN customer c ON c.c_custkey = t.o_custkey
LEFT JOIN a ON a.o_custkey = t.o_custkey AND a.cutoff_time = t.cutoff_time
"""

TYPE_CAST = """
SELECT o_orderkey,
       CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS FLOAT) AS is_final,
       CAST(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE length(o_orderpriority) END AS FLOAT) AS prio_len,
       o_totalprice, o_orderpriority
FROM orders
"""

LABEL_ENCODE_ALL = """
WITH e AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' AS early, COALESCE(o_orderstatus, 'nan') AS s, COALESCE(o_orderpriority, 'nan') AS p FROM orders),
s AS (SELECT s AS v, row_number() OVER (ORDER BY NOT bool_or(COALESCE(early, FALSE)), s) - 1 AS code FROM e GROUP BY s),
p AS (SELECT p AS v, row_number() OVER (ORDER BY NOT bool_or(COALESCE(early, FALSE)), p) - 1 AS code FROM e GROUP BY p)
SELECT e.o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority FROM e JOIN s ON s.v = e.s JOIN p ON p.v = e.p
"""

LABEL_ENCODE_UNSEEN = """
WITH tr AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'),
s_seen AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS v FROM tr)),
s_new AS (SELECT v, (SELECT COUNT(*) FROM s_seen) + dense_rank() OVER (ORDER BY v) - 1 AS code
          FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus NOT IN (SELECT v FROM s_seen))),
p_seen AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM tr)),
p_new AS (SELECT v, (SELECT COUNT(*) FROM p_seen) + dense_rank() OVER (ORDER BY v) - 1 AS code
          FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority NOT IN (SELECT v FROM p_seen))),
s AS (SELECT * FROM s_seen UNION ALL SELECT * FROM s_new),
p AS (SELECT * FROM p_seen UNION ALL SELECT * FROM p_new)
SELECT o.o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority
FROM orders o JOIN s ON s.v = o.o_orderstatus JOIN p ON p.v = o.o_orderpriority
"""

LABEL_ENCODE_HIGH_CARD = """
WITH c AS (SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_name END, 'nan') AS n, c_mktsegment AS s FROM customer),
tr AS (SELECT * FROM c WHERE s IN ('BUILDING', 'MACHINERY')),
n_code AS (SELECT v, row_number() OVER (ORDER BY late, v) - 1 AS code
           FROM (SELECT n AS v, CASE WHEN n IN (SELECT n FROM tr) THEN 0 ELSE 1 END AS late FROM c GROUP BY n)),
s_code AS (SELECT v, row_number() OVER (ORDER BY late, v) - 1 AS code
           FROM (SELECT s AS v, CASE WHEN s IN (SELECT s FROM tr) THEN 0 ELSE 1 END AS late FROM c GROUP BY s))
SELECT c.c_custkey, n_code.code AS c_name, s_code.code AS c_mktsegment
FROM c JOIN n_code ON n_code.v = c.n JOIN s_code ON s_code.v = c.s
"""

DATETIME_PARTS = """
SELECT o_orderkey, epoch_ns(o_orderdate) AS cutoff_time, CAST(year(o_orderdate) AS BIGINT) AS cutoff_time_year,
       CAST(month(o_orderdate) AS BIGINT) AS cutoff_time_month, CAST(day(o_orderdate) AS BIGINT) AS cutoff_time_day,
       CAST(isodow(o_orderdate) - 1 AS BIGINT) AS cutoff_time_dayofweek
FROM orders
"""

DROP_CONSTANT = f"SELECT c.c_custkey, {CUST_ATTRS} FROM customer c"

def row_key(*cols: str) -> str:
    parts = " || ".join(f"coalesce('|' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '|n')" for c in cols)
    return f"md5('42' || {parts})"


SAMPLE_UNIFORM = f"""
SELECT o_orderkey, o_custkey, o_orderdate AS cutoff_time, o_totalprice AS target
FROM orders ORDER BY {row_key('o_orderkey')} LIMIT 1000
"""


def _lines(*ids: str) -> str:
    return (f"SELECT l_returnflag AS target, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS cutoff_time, "
            f"{row_key(*ids, 'l_returnflag')} AS h FROM lineitem")


_LINE = _lines("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_LCOLS = "target, l_orderkey, l_linenumber, l_partkey, l_suppkey, cutoff_time"


def sample_coverage(lines: str, cols: str, n: int) -> str:
    return f"""
WITH h AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY h) AS rn FROM ({lines})),
f AS (SELECT * FROM h WHERE target IS NOT NULL AND rn = 1),
r AS (SELECT * FROM h WHERE target IS NULL OR rn > 1 ORDER BY h LIMIT ({n} - (SELECT COUNT(*) FROM f)))
SELECT {cols} FROM f UNION ALL SELECT {cols} FROM r
"""


def sample_balanced(lines: str, cols: str, n: int) -> str:
    return f"""
WITH h AS ({lines}),
k AS (SELECT COUNT(DISTINCT COALESCE(target, '<null>')) AS n_classes FROM h),
q AS (SELECT GREATEST(1, {n} // n_classes) AS quota FROM k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY h) AS rn FROM h WHERE target IS NOT NULL),
b AS (SELECT * FROM ranked WHERE rn <= (SELECT quota FROM q)),
l AS (SELECT * FROM ranked WHERE rn > (SELECT quota FROM q) ORDER BY h
      LIMIT GREATEST(0, {n} - (SELECT COUNT(*) FROM b)))
SELECT {cols} FROM b UNION ALL SELECT {cols} FROM l
"""


SAMPLE_COVERAGE = sample_coverage(_LINE, _LCOLS, 1000)
SAMPLE_BALANCED = sample_balanced(_LINE, _LCOLS, 1000)
_REPEATED = _lines("l_orderkey")
SAMPLE_COVERAGE_REPEATED = sample_coverage(_REPEATED, "target, l_orderkey", 1000)
SAMPLE_BALANCED_REPEATED = sample_balanced(_REPEATED, "target, l_orderkey", 1000)

AGG_MEAN_EXTREMES = """
SELECT o_orderkey, AVG(l_extendedprice * 1.234567e-14) AS mean_tiny, AVG(l_extendedprice * 1.234567e18) / 1e18 AS mean_huge,
       MAX(l_extendedprice * 1.234567e-14) AS max_tiny, MAX(l_extendedprice * 1.234567e18) / 1e18 AS max_huge, COUNT(l_orderkey) AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""

MAP_BY_COLUMN = """
SELECT c.c_custkey, n.n_name AS nation_name, n.n_name AS nation_n_name, r.r_name AS nation_region_r_name, k.n AS nation_COUNT_customer
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1) k ON k.c_nationkey = n.n_nationkey
"""

DUPLICATE_PARENT_ROWS = """
SELECT o.o_orderkey, l.l_orderkey AS lineitem_l_orderkey, l.l_quantity AS lineitem_l_quantity, l.l_extendedprice AS lineitem_l_extendedprice, l.l_returnflag AS lineitem_l_returnflag
FROM orders o LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_returnflag) = 1) l
ON l.l_orderkey = o.o_orderkey
"""

CHURN_TASK = f"""
SELECT c.c_custkey, q.cutoff_time,
       CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= q.cutoff_time
                         AND o.o_orderdate < q.cutoff_time + INTERVAL 90 DAY) THEN 0 ELSE 1 END AS churn
FROM customer c, {QUARTERS}
"""

TARGET_HISTORY = f"""
SELECT c_custkey, cutoff_time, epoch_ns(cutoff_time) AS cutoff_time_epochtime, CAST(churn AS BIGINT) AS churn
FROM ({CHURN_TASK})
"""

TARGET_HISTORY_MEAN = f"""
WITH h AS ({CHURN_TASK}),
task AS ({QUARTER_TASK}),
a AS (SELECT t.c_custkey, t.cutoff_time, MAX(epoch_ns(h.cutoff_time)) AS x_t, {mean_int('epoch_ns(h.cutoff_time)')} AS m_t,
             MAX(CAST(h.churn AS BIGINT)) AS x_c, {mean_int('h.churn')} AS m_c, COUNT(*) AS n
      FROM task t JOIN h ON h.c_custkey = t.c_custkey AND h.cutoff_time < t.cutoff_time GROUP BY 1, 2)
SELECT t.c_custkey, t.cutoff_time, {CUST_ATTRS},
       a.x_t AS customer_MAX_relfeat_target_history_cutoff_time_epochtime,
       a.m_t AS customer_MEAN_relfeat_target_history_cutoff_time_epochtime,
       a.x_c AS customer_MAX_relfeat_target_history_churn, a.m_c AS customer_MEAN_relfeat_target_history_churn,
       COALESCE(a.n, 0) AS customer_COUNT_relfeat_target_history
FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
"""

def _contents(table: str, columns: str, time: str | None = None, source: str | None = None) -> str:
    """``columns``: those of the prepared table; the epoch column is made of ``time``."""
    counts = " + ".join(f"COUNT({time if c == f'{time}_epochtime' else c})" for c in columns.split(","))
    last = f"MAX(epoch_ns({time}))" if time else "NULL"
    return (f"SELECT '{table}' AS table_name, '{columns}' AS column_names, COUNT(*) AS n_rows, {counts} AS n_values, "
            f"CAST({last} AS VARCHAR) AS last_epoch FROM {source or table}")


PREPARE_DB = " UNION ALL ".join([
    _contents("customer", "c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey"),
    _contents("events", "event_id,event_type,ts,ts_epochtime,user_id,value", "ts"),
    _contents("lineitem", "l_discount,l_extendedprice,l_linenumber,l_linestatus,l_orderkey,l_partkey,l_quantity,l_returnflag,"
                          "l_shipdate,l_shipdate_epochtime,l_suppkey,l_tax", "l_shipdate"),
    _contents("nation", "n_name,n_nationkey,n_regionkey"),
    _contents("orders", "o_custkey,o_orderdate,o_orderdate_epochtime,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice", "o_orderdate"),
    _contents("part", "p_brand,p_name,p_partkey,p_retailprice,p_size,p_type"),
    _contents("region", "r_name,r_regionkey"),
    _contents("supplier", "s_acctbal,s_name,s_nationkey,s_suppkey"),
    _contents("users", "user_id", source="(SELECT DISTINCT user_id FROM events)"),
])

FLOAT_KEY_NORMALIZE = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS cust_f
FROM orders
"""

VALIDATE_KEYS = """
WITH kept AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'nation' AS table_name, 'n_nationkey' AS column_name, 'duplicate_primary_key' AS "check",
       (SELECT COUNT(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING COUNT(*) > 1)) AS n_bad
UNION ALL SELECT 'customer', 'c_custkey', 'duplicate_primary_key',
       (SELECT COUNT(*) FROM (SELECT c_custkey FROM kept GROUP BY 1 HAVING COUNT(*) > 1))
UNION ALL SELECT 'orders', 'o_orderkey', 'duplicate_primary_key',
       (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1))
UNION ALL SELECT 'customer', 'c_nationkey', 'orphan_foreign_key',
       (SELECT COUNT(*) FROM kept WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation))
UNION ALL SELECT 'orders', 'o_custkey', 'orphan_foreign_key',
       (SELECT COUNT(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM kept))
"""

ROC_AUC = """
WITH g AS (SELECT o_totalprice AS s, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS pos,
                  SUM(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS neg
           FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1),
r AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT SUM(pos * (nb + neg * 0.5)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc FROM r
"""

MAE = f"""
WITH f AS ({CUTOFF_BOUNDARY})
SELECT AVG(ABS(o.o_totalprice - f.customer_MEAN_orders_o_totalprice)) AS mae
FROM f JOIN orders o ON o.o_orderkey = f.o_orderkey WHERE f.customer_MEAN_orders_o_totalprice IS NOT NULL
"""

DATASET_ROUND_TRIP = f"""
SELECT CASE WHEN cutoff_time < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS part,
       concat_ws('|', c_custkey::VARCHAR, cutoff_time::VARCHAR, churn::VARCHAR) AS row_text FROM ({CHURN_TASK})
UNION ALL SELECT 'customer', concat_ws('|', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR) FROM customer
UNION ALL SELECT 'orders', concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderdate::VARCHAR, o_orderstatus) FROM orders
"""

TASK_IMPORT_ENTITY = f"""
SELECT t.c_custkey, t.cutoff_time, t.churn, {CUST_ATTRS}
FROM ({CHURN_TASK}) t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
"""

TASK_IMPORT_ENTITY_SPLITS = f"""
SELECT t.c_custkey, t.cutoff_time, t.churn, {CUST_ATTRS}, CASE WHEN t.cutoff_time >= TIMESTAMP '2000-01-01' THEN 'test' ELSE 'train' END AS split
FROM ({CHURN_TASK}) t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
"""

TASK_IMPORT_ROLES = f"""
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate + INTERVAL 1 SECOND AS cutoff_time, o.o_totalprice AS target,
       {CUST_ATTRS}, o.o_orderstatus AS orders_o_orderstatus, o.o_totalprice AS orders_o_totalprice,
       epoch_ns(o.o_orderdate) AS orders_o_orderdate_epochtime, o.o_orderpriority AS orders_o_orderpriority
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
"""

ORACLE_SQL.update({
    "temporal_diff": TEMPORAL_DIFF,
    "drop_std_epoch": AGG_NUMERIC_CUTOFF,
    "shift_time": SHIFT_TIME,
    "type_cast": TYPE_CAST,
    "label_encode": LABEL_ENCODE_ALL,
    "label_encode_all": LABEL_ENCODE_ALL,
    "label_encode_unseen": LABEL_ENCODE_UNSEEN,
    "label_encode_high_card": LABEL_ENCODE_HIGH_CARD,
    "datetime_parts": DATETIME_PARTS,
    "drop_constant": DROP_CONSTANT,
    "sample_uniform": SAMPLE_UNIFORM,
    "sample_coverage": SAMPLE_COVERAGE,
    "sample_balanced": SAMPLE_BALANCED,
    "sample_coverage_repeated": SAMPLE_COVERAGE_REPEATED,
    "sample_balanced_repeated": SAMPLE_BALANCED_REPEATED,
    "agg_mean_extremes": AGG_MEAN_EXTREMES,
    "map_by_column": MAP_BY_COLUMN,
    "duplicate_parent_rows": DUPLICATE_PARENT_ROWS,
    "target_history": TARGET_HISTORY,
    "target_history_mean": TARGET_HISTORY_MEAN,
    "prepare_db": PREPARE_DB,
    "float_key_normalize": FLOAT_KEY_NORMALIZE,
    "validate_keys": VALIDATE_KEYS,
    "roc_auc": ROC_AUC,
    "mae": MAE,
    "dataset_round_trip": DATASET_ROUND_TRIP,
    "task_import_entity": TASK_IMPORT_ENTITY,
    "task_import_entity_splits": TASK_IMPORT_ENTITY_SPLITS,
    "task_import_roles": TASK_IMPORT_ROLES,
})

STACKED_PREFIX_WINDOW = f"""
WITH task AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS cutoff_time FROM lineitem),
d AS (SELECT DISTINCT l_partkey, cutoff_time FROM task),
vis AS (SELECT d.l_partkey AS k, d.cutoff_time AS c, l.*, epoch_ns(l.l_shipdate) AS sd,
               CASE WHEN o.o_orderdate < d.cutoff_time THEN o.o_totalprice END AS op,
               CASE WHEN o.o_orderdate < d.cutoff_time THEN epoch_ns(o.o_orderdate) END AS od,
               CASE WHEN o.o_orderdate < d.cutoff_time THEN o.o_orderstatus END AS os,
               CASE WHEN o.o_orderdate < d.cutoff_time THEN o.o_orderpriority END AS opr
        FROM d JOIN lineitem l ON l.l_partkey = d.l_partkey AND l.l_shipdate < d.cutoff_time
        LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey),
a AS (SELECT k, c, MAX(l_linenumber) AS x_ln, {mean_int('l_linenumber')} AS m_ln,
             {', '.join(f'MAX({x}) AS x_{x}, ' + mean_dbl(x) + f' AS m_{x}' for x in _LI_NUM_DBL)},
             MAX(sd) AS x_sd, {mean_int('sd')} AS m_sd, MAX(op) AS x_op, {mean_dbl('op')} AS m_op,
             MAX(od) AS x_od, {mean_int('od')} AS m_od, COUNT(*) AS n
      FROM vis GROUP BY 1, 2),
{mode_cte('mr', 'vis', 'k, c', 'l_returnflag')},
{mode_cte('ml', 'vis', 'k, c', 'l_linestatus')},
{mode_cte('ms', 'vis', 'k, c', 'os')},
{mode_cte('mp', 'vis', 'k, c', 'opr')}
SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.cutoff_time,
       p.p_name AS part_p_name, p.p_brand AS part_p_brand, p.p_type AS part_p_type,
       CAST(p.p_size AS BIGINT) AS part_p_size, p.p_retailprice AS part_p_retailprice,
       a.x_ln AS part_MAX_lineitem_l_linenumber, a.m_ln AS part_MEAN_lineitem_l_linenumber,
       {', '.join(f'a.x_{x} AS part_MAX_lineitem_{x}, a.m_{x} AS part_MEAN_lineitem_{x}' for x in _LI_NUM_DBL)},
       a.x_sd AS part_MAX_lineitem_l_shipdate_epochtime, a.m_sd AS part_MEAN_lineitem_l_shipdate_epochtime,
       mr.v AS part_MODE_lineitem_l_returnflag, ml.v AS part_MODE_lineitem_l_linestatus,
       ms.v AS part_MODE_lineitem_orders_o_orderstatus, mp.v AS part_MODE_lineitem_orders_o_orderpriority,
       a.x_op AS part_MAX_lineitem_orders_o_totalprice, a.m_op AS part_MEAN_lineitem_orders_o_totalprice,
       a.x_od AS part_MAX_lineitem_orders_o_orderdate_epochtime, a.m_od AS part_MEAN_lineitem_orders_o_orderdate_epochtime,
       COALESCE(a.n, 0) AS part_COUNT_lineitem
FROM task t LEFT JOIN part p ON p.p_partkey = t.l_partkey
LEFT JOIN a ON a.k = t.l_partkey AND a.c = t.cutoff_time
LEFT JOIN mr ON mr.k = t.l_partkey AND mr.c = t.cutoff_time
LEFT JOIN ml ON ml.k = t.l_partkey AND ml.c = t.cutoff_time
LEFT JOIN ms ON ms.k = t.l_partkey AND ms.c = t.cutoff_time
LEFT JOIN mp ON mp.k = t.l_partkey AND mp.c = t.cutoff_time
"""

ORACLE_SQL["stacked_prefix_window"] = STACKED_PREFIX_WINDOW
ORACLE_SQL["prefix_bucketed_agg"] = AGG_NUMERIC_CUTOFF
ORACLE_SQL["prefix_bucketed_mode"] = AGG_MODE_CUTOFF

SANITIZE_NAMES = f"""
WITH task AS ({QUARTER_TASK}),
a AS (SELECT t.c_custkey, t.cutoff_time, MAX(o.o_totalprice) AS mx_p, MIN(o.o_totalprice) AS mn_p,
             MAX(epoch_ns(o.o_orderdate)) AS mx_d, MIN(epoch_ns(o.o_orderdate)) AS mn_d, COUNT(*) AS n
      FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time GROUP BY 1, 2)
SELECT t.c_custkey, t.cutoff_time, c.c_name AS "customer.c_name", c.c_acctbal AS "customer.c_acctbal",
       c.c_mktsegment AS "customer.c_mktsegment",
       a.mx_p AS "customer.MAX(orders.o_totalprice)", a.mn_p AS "customer.MIN(orders.o_totalprice)",
       CAST(epoch_ns(t.cutoff_time) - a.mx_d AS DOUBLE) AS customer_MAX_orders_o_orderdate_epochtime_diff,
       CAST(epoch_ns(t.cutoff_time) - a.mn_d AS DOUBLE) AS customer_MIN_orders_o_orderdate_epochtime_diff,
       COALESCE(a.n, 0) AS "customer.COUNT(orders)"
FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey
LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
"""

ORACLE_SQL["sanitize_names"] = SANITIZE_NAMES

ORACLE_SQL["prefix_median"] = AGG_MEDIAN_CUTOFF
ORACLE_SQL["prefix_median_bucketed"] = AGG_MEDIAN_CUTOFF

SKEWED_KEY_AGG = f"""
WITH so AS (SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey END AS o_custkey) FROM orders),
d AS (SELECT DISTINCT o_custkey AS k, o_orderdate AS c FROM so),
vis AS (SELECT d.k, d.c, o.o_totalprice, epoch_ns(o.o_orderdate) AS od, o.o_orderstatus, o.o_orderpriority FROM d JOIN so o ON o.o_custkey = d.k AND o.o_orderdate < d.c),
a AS (SELECT k, c, MAX(o_totalprice) AS mx_p, MIN(o_totalprice) AS mn_p, {mean_dbl('o_totalprice')} AS av_p, STDDEV_SAMP(o_totalprice) AS sd_p, MEDIAN(o_totalprice) AS md_p,
             MAX(od) AS mx_d, MIN(od) AS mn_d, {mean_int('od')} AS av_d, MEDIAN(CAST(od AS DOUBLE)) AS md_d, COUNT(*) AS n
      FROM vis GROUP BY 1, 2),
{mode_cte('ms', 'vis', 'k, c', 'o_orderstatus')},
{mode_cte('mp', 'vis', 'k, c', 'o_orderpriority')}
SELECT t.o_orderkey, t.o_custkey, t.o_orderdate AS cutoff_time, cu.c_name AS customer_c_name, cu.c_acctbal AS customer_c_acctbal, cu.c_mktsegment AS customer_c_mktsegment,
       a.mx_p AS customer_MAX_orders_o_totalprice, a.mn_p AS customer_MIN_orders_o_totalprice, a.av_p AS customer_MEAN_orders_o_totalprice,
       a.sd_p AS customer_STD_orders_o_totalprice, a.md_p AS customer_MEDIAN_orders_o_totalprice,
       a.mx_d AS customer_MAX_orders_o_orderdate_epochtime, a.mn_d AS customer_MIN_orders_o_orderdate_epochtime,
       a.av_d AS customer_MEAN_orders_o_orderdate_epochtime, a.md_d AS customer_MEDIAN_orders_o_orderdate_epochtime,
       ms.v AS customer_MODE_orders_o_orderstatus, mp.v AS customer_MODE_orders_o_orderpriority,
       CASE WHEN cu.c_custkey IS NULL THEN 0 ELSE COALESCE(a.n, 0) END AS customer_COUNT_orders
FROM so t LEFT JOIN customer cu ON cu.c_custkey = t.o_custkey
LEFT JOIN a ON a.k = t.o_custkey AND a.c = t.o_orderdate
LEFT JOIN ms ON ms.k = t.o_custkey AND ms.c = t.o_orderdate LEFT JOIN mp ON mp.k = t.o_custkey AND mp.c = t.o_orderdate
"""
ORACLE_SQL["skewed_key_agg"] = SKEWED_KEY_AGG


def _extremes_and_mean(x: str, name: str, integral: bool) -> str:
    return f"MAX({x}) AS x_{name}, MIN({x}) AS n_{name}, {(mean_int if integral else mean_dbl)(x)} AS m_{name}"


_TIMED = ["l_quantity", "l_extendedprice", "l_shipdate_epochtime"]
_INNER = [(f"{p}_{c}", f"{fn}_lineitem_{c}", c == "l_shipdate_epochtime" and p != "m") for c in _TIMED for p, fn in (("x", "MAX"), ("n", "MIN"), ("m", "MEAN"))] + [("cnt", "COUNT_lineitem", True)]


def _outer(x: str, integral: bool) -> str:
    if not x.startswith("m_"):
        return _extremes_and_mean(x, "o_" + x, integral)
    mean = f"ROUND(AVG({x}) / 1e9, 3)" if "epochtime" in x else f"ROUND(AVG({x}), 9)"
    return f"MAX({x}) AS x_o_{x}, MIN({x}) AS n_o_{x}, {mean} AS m_o_{x}"


STACKED_TIMED_AGG = f"""
WITH task AS (SELECT DISTINCT o_custkey AS k, o_orderdate AS c FROM orders),
ol AS (SELECT t.k, t.c, o.o_orderkey, o.o_totalprice, epoch_ns(o.o_orderdate) AS od, o.o_orderstatus, o.o_orderpriority
       FROM task t JOIN orders o ON o.o_custkey = t.k AND o.o_orderdate < t.c),
lv AS (SELECT ol.k, ol.c, ol.o_orderkey, l.l_quantity, l.l_extendedprice, epoch_ns(l.l_shipdate) AS l_shipdate_epochtime, l.l_returnflag
       FROM ol JOIN lineitem l ON l.l_orderkey = ol.o_orderkey AND l.l_shipdate < ol.c),
li AS (SELECT k, c, o_orderkey, {', '.join(_extremes_and_mean(c, c, c == 'l_shipdate_epochtime') for c in _TIMED)}, COUNT(*) AS cnt FROM lv GROUP BY 1, 2, 3),
{mode_cte('lf', 'lv', 'k, c, o_orderkey', 'l_returnflag')},
ofe AS (SELECT ol.*, li.* EXCLUDE (k, c, o_orderkey, cnt), COALESCE(li.cnt, 0) AS cnt, lf.v AS flag FROM ol
        LEFT JOIN li ON li.k = ol.k AND li.c = ol.c AND li.o_orderkey = ol.o_orderkey LEFT JOIN lf ON lf.k = ol.k AND lf.c = ol.c AND lf.o_orderkey = ol.o_orderkey),
a AS (SELECT k, c, {_extremes_and_mean('o_totalprice', 'p', False)}, {_extremes_and_mean('od', 'd', True)}, {', '.join(_outer(x, i) for x, _, i in _INNER)}, COUNT(*) AS n FROM ofe GROUP BY 1, 2),
{mode_cte('ms', 'ofe', 'k, c', 'o_orderstatus')},
{mode_cte('mp', 'ofe', 'k, c', 'o_orderpriority')},
{mode_cte('mf', 'ofe', 'k, c', 'flag')}
SELECT t.o_orderkey, t.o_custkey, t.o_orderdate AS cutoff_time, cu.c_name AS customer_c_name, cu.c_acctbal AS customer_c_acctbal, cu.c_mktsegment AS customer_c_mktsegment,
       {', '.join(f'a.{p}_{x} AS customer_{fn}_orders_{n}' for x, n in [('p', 'o_totalprice'), ('d', 'o_orderdate_epochtime')] + [('o_' + x, n) for x, n, _ in _INNER] for p, fn in (('x', 'MAX'), ('n', 'MIN'), ('m', 'MEAN')))},
       ms.v AS customer_MODE_orders_o_orderstatus, mp.v AS customer_MODE_orders_o_orderpriority, mf.v AS customer_MODE_orders_MODE_lineitem_l_returnflag,
       COALESCE(a.n, 0) AS customer_COUNT_orders
FROM orders t LEFT JOIN customer cu ON cu.c_custkey = t.o_custkey LEFT JOIN a ON a.k = t.o_custkey AND a.c = t.o_orderdate
LEFT JOIN ms ON ms.k = t.o_custkey AND ms.c = t.o_orderdate LEFT JOIN mp ON mp.k = t.o_custkey AND mp.c = t.o_orderdate
LEFT JOIN mf ON mf.k = t.o_custkey AND mf.c = t.o_orderdate
"""
ORACLE_SQL["stacked_timed_agg"] = STACKED_TIMED_AGG

SPEND_TASK = f"""
SELECT c.c_custkey, q.cutoff_time, COALESCE((SELECT SUM(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= q.cutoff_time
       AND o.o_orderdate < q.cutoff_time + INTERVAL 90 DAY), 0.0) AS spend
FROM customer c, {QUARTERS}
"""


def _ctes_of_task_features(task: str, target: str, mean_target: str) -> str:
    """CTEs ending in ``f(c_custkey, cutoff_time, y, x1 ... xn)``: a task row's target and the numbers
    that the fitted preprocessor makes of its features, nulls as 0, in their order.  History and
    label codes come from the rows before 2000."""
    def code(expr):
        return f"(SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM (SELECT DISTINCT {expr} AS v FROM customer))"
    diff = lambda x: f"CAST(epoch_ns(t.cutoff_time) - {x} AS DOUBLE)"
    numbers = ["ck.code", "CAST(epoch_ns(t.cutoff_time) AS DOUBLE)", "year(t.cutoff_time)::DOUBLE", "month(t.cutoff_time)::DOUBLE", "(isodow(t.cutoff_time) - 1)::DOUBLE",
               "cn.code", "c.c_acctbal", "cm.code", "a.mx_p", "a.mn_p", "a.av_p", diff("a.mx_d"), diff("a.mn_d"), "CAST(epoch_ns(t.cutoff_time) AS DOUBLE) - a.av_d", "a.n::DOUBLE",
               diff("h.mx_t"), diff("h.mn_t"), "CAST(epoch_ns(t.cutoff_time) AS DOUBLE) - h.av_t", "h.mx_y::DOUBLE", "h.mn_y::DOUBLE", "h.av_y", "h.n::DOUBLE"]
    return f"""
task AS (SELECT c_custkey, cutoff_time, {target} AS y FROM ({task})),
past AS (SELECT * FROM task WHERE cutoff_time < TIMESTAMP '2000-01-01'),
a AS (SELECT t.c_custkey, t.cutoff_time, MAX(o.o_totalprice) AS mx_p, MIN(o.o_totalprice) AS mn_p, {mean_dbl('o.o_totalprice')} AS av_p,
             MAX(epoch_ns(o.o_orderdate)) AS mx_d, MIN(epoch_ns(o.o_orderdate)) AS mn_d, {mean_int('epoch_ns(o.o_orderdate)')} AS av_d, COUNT(*) AS n
      FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time GROUP BY 1, 2),
h AS (SELECT t.c_custkey, t.cutoff_time, MAX(epoch_ns(p.cutoff_time)) AS mx_t, MIN(epoch_ns(p.cutoff_time)) AS mn_t, {mean_int('epoch_ns(p.cutoff_time)')} AS av_t,
             MAX(p.y) AS mx_y, MIN(p.y) AS mn_y, {mean_target} AS av_y, COUNT(*) AS n
      FROM task t JOIN past p ON p.c_custkey = t.c_custkey AND p.cutoff_time < t.cutoff_time GROUP BY 1, 2),
f AS MATERIALIZED (SELECT t.c_custkey, t.cutoff_time, t.y, {', '.join(f'COALESCE({x}, 0.0) AS x{i}' for i, x in enumerate(numbers))}
      FROM task t JOIN customer c ON c.c_custkey = t.c_custkey
      JOIN {code('CAST(c_custkey AS VARCHAR)')} ck ON ck.v = CAST(t.c_custkey AS VARCHAR) JOIN {code('c_name')} cn ON cn.v = c.c_name JOIN {code('c_mktsegment')} cm ON cm.v = c.c_mktsegment
      LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time LEFT JOIN h ON h.c_custkey = t.c_custkey AND h.cutoff_time = t.cutoff_time)"""


def nearest_past_row(task: str, target: str, mean_target: str, output: str) -> str:
    """Each row from 2000 on answered by the nearest earlier row; on ties the smallest key as text,
    then the earliest."""
    distance = " + ".join(f"(n.x{i} - p.x{i}) * (n.x{i} - p.x{i})" for i in range(22))
    return f"""
WITH {_ctes_of_task_features(task, target, mean_target)},
p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR), cutoff_time) AS place FROM f WHERE cutoff_time < TIMESTAMP '2000-01-01'),
n AS MATERIALIZED (SELECT * FROM f WHERE cutoff_time >= TIMESTAMP '2000-01-01'),
d AS (SELECT n.c_custkey, n.cutoff_time, MIN({distance}) AS least FROM n, p GROUP BY 1, 2),
b AS (SELECT n.c_custkey, n.cutoff_time, MIN(p.place) AS place FROM n JOIN d ON d.c_custkey = n.c_custkey AND d.cutoff_time = n.cutoff_time, p WHERE {distance} = d.least GROUP BY 1, 2)
SELECT b.c_custkey, b.cutoff_time, p.y{output} FROM b JOIN p USING (place)
"""


ORACLE_SQL["in_context_score"] = nearest_past_row(SPEND_TASK, "spend", mean_dbl("p.y"), " AS prediction")
ORACLE_SQL["predict_proba"] = nearest_past_row(CHURN_TASK, "churn", mean_int("p.y"), "::DOUBLE AS p_churn")

TARGET_HISTORY_BY_COLUMN = f"""
WITH task AS (SELECT t.c_custkey, n.n_name AS nation_name, t.cutoff_time, CAST(t.churn AS BIGINT) AS churn FROM ({CHURN_TASK}) t
              JOIN customer c ON c.c_custkey = t.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
d AS (SELECT DISTINCT nation_name, cutoff_time FROM task),
a AS (SELECT d.nation_name, d.cutoff_time, MAX(epoch_ns(h.cutoff_time)) AS x_t, {mean_int('epoch_ns(h.cutoff_time)')} AS m_t, MAX(h.churn) AS x_c, {mean_int('h.churn')} AS m_c, COUNT(*) AS n
      FROM d JOIN task h ON h.nation_name = d.nation_name AND h.cutoff_time < d.cutoff_time GROUP BY 1, 2)
SELECT t.c_custkey, t.nation_name, t.cutoff_time, n.n_name AS nation_n_name,
       a.x_t AS nation_MAX_relfeat_target_history_cutoff_time_epochtime, a.m_t AS nation_MEAN_relfeat_target_history_cutoff_time_epochtime,
       a.x_c AS nation_MAX_relfeat_target_history_churn, a.m_c AS nation_MEAN_relfeat_target_history_churn, COALESCE(a.n, 0) AS nation_COUNT_relfeat_target_history
FROM task t LEFT JOIN nation n ON n.n_name = t.nation_name LEFT JOIN a ON a.nation_name = t.nation_name AND a.cutoff_time = t.cutoff_time
"""
ORACLE_SQL["target_history_by_column"] = TARGET_HISTORY_BY_COLUMN


def _codes(name: str, column: str) -> str:
    """CTE ``name(v, code)``: codes of the values of ``f.column``, null as a class of its own."""
    return f"{name} AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT COALESCE({column}, 'nan') AS v FROM f))"


PREPROCESS_CHAIN = f"""
WITH task AS (SELECT * FROM ({CHURN_TASK}) WHERE cutoff_time < TIMESTAMP '2000-01-01'),
vis AS (SELECT t.c_custkey, t.cutoff_time, o.o_totalprice, epoch_ns(o.o_orderdate) AS od, o.o_orderstatus, o.o_orderpriority
        FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time),
a AS (SELECT c_custkey, cutoff_time, MAX(o_totalprice) AS mx_p, MIN(o_totalprice) AS mn_p, {mean_dbl('o_totalprice')} AS av_p, STDDEV_SAMP(o_totalprice) AS sd_p,
             MAX(od) AS mx_d, MIN(od) AS mn_d, {mean_int('od')} AS av_d, COUNT(*) AS n FROM vis GROUP BY 1, 2),
{mode_cte('ms', 'vis', 'c_custkey, cutoff_time', 'o_orderstatus')},
{mode_cte('mp', 'vis', 'c_custkey, cutoff_time', 'o_orderpriority')},
f AS (SELECT t.c_custkey, t.cutoff_time, t.churn, c.c_name, c.c_acctbal, c.c_mktsegment, a.* EXCLUDE (c_custkey, cutoff_time), ms.v AS status, mp.v AS priority
      FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time
      LEFT JOIN ms ON ms.c_custkey = t.c_custkey AND ms.cutoff_time = t.cutoff_time LEFT JOIN mp ON mp.c_custkey = t.c_custkey AND mp.cutoff_time = t.cutoff_time),
{_codes('k1', 'c_name')}, {_codes('k2', 'c_mktsegment')}, {_codes('k3', 'status')}, {_codes('k4', 'priority')}
SELECT f.churn, f.c_custkey, epoch_ns(f.cutoff_time) AS cutoff_time, CAST(year(f.cutoff_time) AS BIGINT) AS cutoff_time_year, CAST(month(f.cutoff_time) AS BIGINT) AS cutoff_time_month,
       CAST(isodow(f.cutoff_time) - 1 AS BIGINT) AS cutoff_time_dayofweek, k1.code AS customer_c_name, f.c_acctbal AS customer_c_acctbal, k2.code AS customer_c_mktsegment,
       f.mx_p AS customer_MAX_orders_o_totalprice, f.mn_p AS customer_MIN_orders_o_totalprice, f.av_p AS customer_MEAN_orders_o_totalprice, f.sd_p AS customer_STD_orders_o_totalprice,
       CAST(epoch_ns(f.cutoff_time) - f.mx_d AS DOUBLE) AS customer_MAX_orders_o_orderdate_epochtime_diff, CAST(epoch_ns(f.cutoff_time) - f.mn_d AS DOUBLE) AS customer_MIN_orders_o_orderdate_epochtime_diff,
       CAST(epoch_ns(f.cutoff_time) AS DOUBLE) - f.av_d AS customer_MEAN_orders_o_orderdate_epochtime_diff, COALESCE(f.n, 0) AS customer_COUNT_orders,
       k3.code AS customer_MODE_orders_o_orderstatus, k4.code AS customer_MODE_orders_o_orderpriority
FROM f JOIN k1 ON k1.v = COALESCE(f.c_name, 'nan') JOIN k2 ON k2.v = COALESCE(f.c_mktsegment, 'nan') JOIN k3 ON k3.v = COALESCE(f.status, 'nan') JOIN k4 ON k4.v = COALESCE(f.priority, 'nan')
"""
ORACLE_SQL["preprocess_chain"] = PREPROCESS_CHAIN
ORACLE_SQL["preprocess_reload"] = PREPROCESS_CHAIN

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT_WORDS = f"regexp_extract_all({_LOWERED}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"

TEXT_NGRAMS = f"""
WITH w AS (SELECT conv_id, turn, row_number() OVER () AS r, {_TEXT_WORDS} AS words FROM conversations WHERE text IS NOT NULL),
g AS (SELECT conv_id, turn, r, CASE WHEN length(gram) > 64 THEN md5(gram) ELSE gram END AS ngram FROM (
      SELECT conv_id, turn, r, UNNEST(words || [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]
             || [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) AS gram FROM w)),
v AS (SELECT ngram FROM (SELECT ngram, COUNT(DISTINCT r) AS df FROM g GROUP BY 1) WHERE df >= 30 ORDER BY df DESC, ngram LIMIT 10000)
SELECT conv_id, turn, ngram, COUNT(*) AS n FROM g JOIN v USING (ngram) GROUP BY conv_id, turn, r, ngram
"""
ORACLE_SQL["text_ngrams"] = TEXT_NGRAMS


def _share(kind: str) -> str:
    return f"CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '{kind}', '', 'g')))::DOUBLE / length(text) WHEN length(text) = 0 THEN 0.0 END"


TEXT_SPECIAL = f"""
WITH k AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT COALESCE(role, 'nan') AS v FROM conversations))
SELECT conv_id, turn, k.code AS role, length(text)::BIGINT AS text_char_count, len({_TEXT_WORDS})::BIGINT AS text_word_count, {_share('[A-Z]')} AS text_capital_ratio,
       {_share('[a-z]')} AS text_lower_ratio, {_share('[0-9]')} AS text_digit_ratio, {_share('[!-/:-@[-`{-~]')} AS text_special_ratio,
       {", ".join(f"(length(text) - length(replace(text, '{symbol}', '')))::BIGINT AS text_count_{name}" for symbol, name in
                  (("!", "exclamation"), ("?", "question"), ("@", "at"), ("%", "percent"), ("$", "dollar"), ("#", "hash"), ("&", "ampersand"), ("*", "asterisk"), (".", "stop"), (":", "colon")))}
FROM conversations JOIN k ON k.v = COALESCE(role, 'nan')
"""
ORACLE_SQL["text_special"] = TEXT_SPECIAL


def _merged_features(task: str, target: str) -> str:
    """``f``: a task's rows with three features (missing: 0) and the answer; ``p`` the past ones."""
    return f"""
task AS MATERIALIZED (SELECT c_custkey, cutoff_time, {target} AS y FROM ({task})),
a AS (SELECT t.c_custkey, t.cutoff_time, COUNT(*) AS n, {mean_dbl('o.o_totalprice')} AS m FROM task t
      JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate < t.cutoff_time GROUP BY 1, 2),
f AS MATERIALIZED (SELECT t.c_custkey, t.cutoff_time, t.y, COALESCE(a.n, 0)::DOUBLE AS x0, COALESCE(a.m, 0)::DOUBLE AS x1, COALESCE(c.c_acctbal, 0)::DOUBLE AS x2
      FROM task t LEFT JOIN customer c ON c.c_custkey = t.c_custkey LEFT JOIN a ON a.c_custkey = t.c_custkey AND a.cutoff_time = t.cutoff_time),
p AS (SELECT * FROM f WHERE cutoff_time < TIMESTAMP '2000-01-01')"""


#: Normal equations of three centred columns, solved by Cramer's rule.
ORACLE_SQL["merged_regressor"] = f"""
WITH {_merged_features(SPEND_TASK, 'spend')},
s AS (SELECT avg(x0) AS a0, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, var_pop(x0) AS v00, var_pop(x1) AS v11, var_pop(x2) AS v22, covar_pop(x0, x1) AS v01,
             covar_pop(x0, x2) AS v02, covar_pop(x1, x2) AS v12, covar_pop(x0, y) AS r0, covar_pop(x1, y) AS r1, covar_pop(x2, y) AS r2 FROM p),
d AS (SELECT *, v00 * (v11 * v22 - v12 * v12) - v01 * (v01 * v22 - v12 * v02) + v02 * (v01 * v12 - v11 * v02) AS det FROM s),
w AS (SELECT *, (r0 * (v11 * v22 - v12 * v12) - v01 * (r1 * v22 - v12 * r2) + v02 * (r1 * v12 - v11 * r2)) / det AS w0,
             (v00 * (r1 * v22 - v12 * r2) - r0 * (v01 * v22 - v12 * v02) + v02 * (v01 * r2 - r1 * v02)) / det AS w1,
             (v00 * (v11 * r2 - r1 * v12) - v01 * (v01 * r2 - r1 * v02) + r0 * (v01 * v12 - v11 * v02)) / det AS w2 FROM d)
SELECT f.c_custkey, f.cutoff_time, round(ay + (x0 - a0) * w0 + (x1 - a1) * w1 + (x2 - a2) * w2, 1) AS prediction
FROM f, w WHERE f.cutoff_time >= TIMESTAMP '2000-01-01'
"""

_LOG_NORMAL = " + ".join(f"ln(2 * pi() * (v{i} + 1e-9)) + (x{i} - a{i}) * (x{i} - a{i}) / (v{i} + 1e-9)" for i in range(3))
ORACLE_SQL["merged_classifier"] = f"""
WITH {_merged_features(CHURN_TASK, 'churn')},
s AS (SELECT y, ln(COUNT(*) / (SELECT COUNT(*) FROM p)) AS prior, avg(x0) AS a0, avg(x1) AS a1, avg(x2) AS a2, var_pop(x0) AS v0, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM p GROUP BY y),
l AS (SELECT f.c_custkey, f.cutoff_time, SUM(CASE WHEN s.y = 1 THEN 1 ELSE -1 END * (prior - 0.5 * ({_LOG_NORMAL}))) AS odds
      FROM f, s WHERE f.cutoff_time >= TIMESTAMP '2000-01-01' GROUP BY 1, 2)
SELECT c_custkey, cutoff_time, round(1 / (1 + exp(-odds)), 5) AS p_churn, CASE WHEN odds > 0 THEN 1 ELSE 0 END AS prediction FROM l
"""
