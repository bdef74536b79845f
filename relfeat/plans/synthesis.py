"""Cutoff-safe deep feature synthesis on Spark (E4: J1-J4, A1-A8, P8).

The planner walks the key graph on the driver using metadata only and emits one
DataFrame plan; Catalyst and AQE choose the physical joins.  For every task row the
features are

* depth 1: attributes of the entity the row's key maps to (J1/J2),
* depth 2: aggregates (max, min, mean, count, mode, std, median) over the entity's child
  rows dated strictly before the row's cutoff (J3, P8), and attributes of the entity's
  parents,
* depth 3 and beyond: the same, stacked (aggregate of aggregate, aggregate of parent
  attribute, parent of aggregate) (A8).

Every hop counts towards ``max_depth``, including task row -> entity.  An edge is never
walked straight back.  The cutoff is applied at every timed table on a path: a child row
is visible when ``time < cutoff``; a timed parent's attributes are null unless
``time < cutoff``; rows with a null time are never visible when a cutoff is given.

Physical shape:

* distinct ``(key, cutoff)`` pairs are computed once per entity, features are computed
  for those pairs and joined back, so duplicate task rows cost nothing (J4);
* one ``groupBy`` per relationship path computes all primitives of all columns at once,
  with Spark's partial (map-side) aggregation;
* sub-trees with no time column are computed per key without the cutoff;
* child rows meet cutoffs in an inner equi-join with a range residual (AQE may split a
  skewed key on either side of an inner join), or, when there are many cutoffs per key,
  in one sorted window pass per key with a ``rangeBetween(unboundedPreceding, -1)`` frame
  (medians: see ``prefix_rank``);
* child rows whose own features change with time, because their child rows are timed too, become
  spans of constant features that meet cutoffs in a tree (see ``spans``);
* the plan is chosen per key: keys that a frequent-items sketch of the child rows shows to be
  heavy, and whose rows times cutoffs are many, leave the others' plan and are dealt out by
  ranges of time;
* query sets derived from a task frame of checked size (``broadcast_rows`` and
  ``broadcast_bytes``, as a hash table) are broadcast, so the large fact tables are streamed once
  without a shuffle; so are the features of parents with few keys.  Larger ones ask for a sort-merge
  join: Spark would judge by the bytes of compressed files, or of rows before they are multiplied,
  and build hash tables in the driver that grow with the input.
"""
from __future__ import annotations

import copy
import datetime
import itertools
from dataclasses import dataclass, field, replace
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import EPOCH_SUFFIX, epoch_micros, key_to_string, sanitize_name
from ..sources.rdb import CATEGORY, NUMERIC, Relationship, RelationalDataset
from .prefix_rank import bucketed_medians, place_among, window_medians
from .spans import nodes_above, nodes_of, number_cutoffs

NUMERIC_PRIMITIVES = ("max", "min", "mean", "std", "median")
CATEGORY_PRIMITIVES = ("mode",)
ALL_PRIMITIVES = NUMERIC_PRIMITIVES + CATEGORY_PRIMITIVES + ("count",)
FRAME_PRIMITIVES = ("max", "min", "mean", "std")  # computable over a window's prefix frame, and mergeable

# fixed values: the reference's default synthesis settings
DEFAULT_MAX_DEPTH = 2
DEFAULT_AGG_PRIMITIVES = ("max", "min", "mean", "count", "mode", "std")

BIG_DOUBLE = float(2 ** 53)  # doubles at or beyond this magnitude hold integers
BIG_LONG = float(2 ** 63)    # ... and from here on no ``long`` holds them
_C = "__c"  # cutoff, epoch microseconds
_K = "__k"  # key of the current query set
FEW_KEYS = 10_000  # fewer keys than this don't deal a task frame out evenly
HASHED_ROW, HASHED_TEXT = 48, 64  # bytes of a broadcast row besides 8 a column, and of a text column


@dataclass(frozen=True)
class DFSConfig:
    max_depth: int = DEFAULT_MAX_DEPTH
    agg_primitives: tuple = DEFAULT_AGG_PRIMITIVES
    engine: str = "spark"
    cutoff_strategy: str = "auto"          # auto | join | window
    window_cutoffs_per_key: float = 4.0    # auto: window plan above this many cutoffs per key
    broadcast_rows: int = 2_000_000        # query sets up to this many rows are broadcast
    broadcast_bytes: int = 16 << 20        # ... and any frame up to this estimated size of its hash table
    hot_key_rows: int = 5_000_000          # a key with more child rows leaves the window plan
    hot_key_pairs: int = 20_000_000        # a key with more child rows times cutoffs leaves the join plan
    hot_bucket_rows: int = 100_000         # rows and cutoffs of a hot key that are dealt to one task
    prefix_bucket_seconds: int = 86_400    # bucket width where "bucketed" is asked for all keys

    def __post_init__(self):
        if self.cutoff_strategy not in ("auto", "join", "window", "bucketed"):
            raise ValueError(f"unknown cutoff strategy {self.cutoff_strategy!r}")

    @classmethod
    def from_any(cls, cfg) -> "DFSConfig":
        if cfg is None:
            return cls()
        if isinstance(cfg, DFSConfig):
            return cfg
        d = dict(cfg)
        if "agg_primitives" in d:
            d["agg_primitives"] = tuple(p.lower() for p in d["agg_primitives"])
            bad = set(d["agg_primitives"]) - set(ALL_PRIMITIVES)
            if bad:
                raise ValueError(f"unknown aggregation primitives {sorted(bad)}; known: {ALL_PRIMITIVES}")
        unknown = set(d) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown synthesis options {sorted(unknown)}; known: {sorted(cls.__dataclass_fields__)}")
        return cls(**d)


@dataclass(frozen=True)
class FeatureDef:
    """One generated column: its final name, featuretools-style display name, value kind,
    primitive stack (outermost first) and whether its source is an epoch time."""
    name: str
    display: str
    kind: str
    primitives: tuple = ()
    epoch: bool = False

    @property
    def is_std_of_epoch(self) -> bool:
        return self.epoch and "std" in self.primitives


@dataclass
class SynthesisResult:
    df: DataFrame
    features: list = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return [f.name for f in self.features]


@dataclass(frozen=True)
class _Feat:
    col: str        # internal column name
    display: str    # display name relative to the frame's table
    kind: str       # numeric | category
    dtype: str      # long | double | string
    prims: tuple = ()
    epoch: bool = False
    count: bool = False
    vis: str | None = None   # deferred cutoff: column holding the time from which the value is visible


_ids = itertools.count()


def _q(name: str) -> Column:
    """Column by its literal name (user names may contain dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _tmp(prefix: str = "__f") -> str:
    return f"{prefix}{next(_ids)}"


class _Planner:
    def __init__(self, db: RelationalDataset, cfg: DFSConfig, strategy: str, task_rows: int = 0):
        self.task_rows = task_rows
        self.max_cutoff: int | None = None   # latest cutoff (epoch micros) of the task frame
        self.db = db
        self.cfg = cfg
        self.strategy = strategy
        self.hot_bounds: DataFrame | None = None   # of hot keys: the times at which they are cut
        self.hot_ranges, self.hot_chunks = 8, 1    # ... and value ranges and query shares of their medians
        self._heavy: dict = {}
        self.split = False                         # did the last aggregates have hot keys?
        prims = set(cfg.agg_primitives)
        self.num_prims = [p for p in NUMERIC_PRIMITIVES if p in prims]
        self.cat_prims = [p for p in CATEGORY_PRIMITIVES if p in prims]
        self.count = "count" in prims

    # ---- metadata ------------------------------------------------------------------------
    def parents(self, table: str, via) -> list[Relationship]:
        return [e for e in self.db.parents_of(table) if e is not via]

    def children(self, table: str, via) -> list[Relationship]:
        return [e for e in self.db.children_of(table) if e is not via]

    def timed(self, table: str, r: int, via) -> bool:
        """Do the features of ``table`` at budget ``r`` depend on the cutoff?"""
        return bool(self.db.metas[table].time_column) or self.below_timed(table, r, via)

    def below_timed(self, table: str, r: int, via) -> bool:
        if r < 1:
            return False
        for e in self.parents(table, via):
            if self.timed(e.parent, r - 1, e):
                return True
        for e in self.children(table, via):
            if self.db.metas[e.child].time_column or self.below_timed(e.child, r - 1, e):
                return True
        return False

    def attrs(self, table: str) -> list[tuple[str, str, str, bool]]:
        """(column, kind, dtype, epoch) of the table's feature columns."""
        out = []
        roles = self.db.roles(table)
        for f in self.db.tables[table].schema.fields:
            role = roles[f.name]
            if role == NUMERIC:
                dtype = "long" if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else "double"
                out.append((f.name, NUMERIC, dtype, f.name.endswith(EPOCH_SUFFIX)))
            elif role == CATEGORY:
                out.append((f.name, CATEGORY, "string", False))
        return out

    def label(self, table: str, e: Relationship, siblings: Sequence[Relationship], col: str) -> str:
        """Display label of a hop; disambiguated by the key column when a table is reached
        through several edges."""
        same = [s for s in siblings if (s.parent if col == "parent" else s.child) == table]
        return table if len(same) <= 1 else f"{table}[{e.child_col}]"

    # ---- frames ----------------------------------------------------------------------------
    def visible_rows(self, table: str) -> DataFrame:
        """Child rows that any cutoff could see: ``time <= latest cutoff`` as a literal on the
        raw time column, so Parquet skips row groups / partitions after it (a superset; the
        exact per-row condition still applies)."""
        df = self.db.tables[table]
        tc = self.db.metas[table].time_column
        if tc is None or self.max_cutoff is None:
            return df
        dt = df.schema[tc].dataType
        last = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=self.max_cutoff)
        if isinstance(dt, T.TimestampNTZType):
            lit = F.expr(f"TIMESTAMP_NTZ'{last:%Y-%m-%d %H:%M:%S.%f}'")
        elif isinstance(dt, T.DateType):
            lit = F.expr(f"DATE'{last:%Y-%m-%d}'")
        else:
            lit = F.expr(f"TIMESTAMP'{last:%Y-%m-%d %H:%M:%S.%f}+00:00'")
        return df.where(_q(tc) <= lit)

    def time_micros(self, table: str) -> Column:
        tc = self.db.metas[table].time_column
        return epoch_micros(_q(tc), self.db.tables[table].schema[tc].dataType)

    def row_feats(self, frame: DataFrame, table: str, r: int, via, has_c: bool, small: bool,
                  keep: Sequence[str], visible: Column | None = None, defer: bool = False
                  ) -> tuple[DataFrame, list[_Feat]]:
        """Features of each row of ``frame`` (which holds ``table``'s columns, ``__c`` when
        ``has_c``, and the ``keep`` columns) at budget ``r``.

        ``defer``: no cutoff is applied here; a timed parent's attributes carry that parent's
        time in a visibility column instead (used by the prefix-window plan)."""
        meta = self.db.metas[table]
        parents = self.parents(table, via) if r >= 1 else []
        children = self.children(table, via) if r >= 1 else []
        feats: list[_Feat] = []
        cols = [F.col(c) for c in keep]
        for name, kind, dtype, epoch in self.attrs(table):
            col = _tmp()
            v = _q(name) if visible is None else F.when(visible, _q(name))
            cols.append(v.alias(col))
            feats.append(_Feat(col, name, kind, dtype, (), epoch))
        needed = {e.child_col for e in parents}
        needed |= {e.parent_col for e in children}
        cols += [_q(c) for c in sorted(needed) if c not in keep]
        if has_c and _C not in keep:
            cols.append(F.col(_C))
        frame = frame.select(*cols)

        for e in parents:
            p_c = has_c and self.timed(e.parent, r - 1, e)
            vt = defer and bool(self.db.metas[e.parent].time_column)
            q = frame.select(_q(e.child_col).alias(_K), *([F.col(_C)] if p_c else [])).distinct()
            pf, pfeats = self.entity_feats(e.parent, q, r - 1, e, p_c, small, e.parent_col, emit_vt=vt)
            if vt:
                vcol = _tmp("__vt")
                pf = pf.withColumnRenamed("__vt", vcol)
                pfeats = [replace(f, vis=vcol) if f.vis == "__vt" else f for f in pfeats]
            # without cutoffs there is at most a row for each of the parent's keys
            few = not p_c and self.hashed_bytes(pf, self.keys_of(e.parent, e.parent_col)[0]) <= self.cfg.broadcast_bytes
            frame = self._join_back(frame, F.broadcast(pf) if few else pf, e.child_col, p_c, small and not few)
            lab = self.label(e.parent, e, parents, "parent")
            feats += [_prefix(f, lab) for f in pfeats]

        for e in children:
            c_c = has_c and self.timed(e.child, r - 1, e)
            q = frame.select(_q(e.parent_col).alias(_K), *([F.col(_C)] if c_c else [])).distinct()
            cf, cfeats = self.child_aggs(e.child, e, q, r - 1, c_c, small)
            if c_c and self.split and not small:  # the cutoffs of a hot key are not one task's either
                frame = _by_pair(frame, _q(e.parent_col), F.col(_C))
            frame = self._join_back(frame, cf, e.parent_col, c_c, small)
            for f in cfeats:  # an existing row without visible children has count 0
                if f.count:
                    frame = frame.withColumn(f.col, F.coalesce(F.col(f.col), F.lit(0).cast("long")))
            feats += cfeats
        return frame, feats

    @staticmethod
    def hashed_bytes(df: DataFrame, rows: int) -> int:
        """Estimated bytes of the hash table of a broadcast frame."""
        texts = sum(isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in df.schema.fields)
        return rows * (HASHED_ROW + 8 * len(df.columns) + HASHED_TEXT * texts)

    def fits_broadcast(self, df: DataFrame) -> bool:
        """A frame derived from the task frame has at most ``task_rows`` rows; broadcast it
        only if that bound times its width fits."""
        return self.task_rows <= self.cfg.broadcast_rows and self.hashed_bytes(df, self.task_rows) <= self.cfg.broadcast_bytes

    @staticmethod
    def _meeting(q: DataFrame, small: bool) -> DataFrame:
        """A query set as it is joined to a table: neither side is broadcast unless ``small``."""
        return F.broadcast(q) if small else q.hint("merge")

    def _join_back(self, frame: DataFrame, sub: DataFrame, key: str, with_c: bool, small: bool) -> DataFrame:
        small = small and self.fits_broadcast(sub)
        k2, c2 = _tmp("__jk"), _tmp("__jc")
        sub = sub.withColumnRenamed(_K, k2)
        cond = _q(key) == F.col(k2)
        if with_c:
            sub = sub.withColumnRenamed(_C, c2)
            cond = cond & F.col(_C).eqNullSafe(F.col(c2))
        if small:
            sub = F.broadcast(sub)
        return frame.join(sub, cond, "left").drop(k2, c2)

    def keys_of(self, table: str, col: str) -> tuple[int, bool]:
        """How many values ``col`` has and whether any repeats; asked once (a grouped count of the
        key column)."""
        cache = self.db.__dict__.setdefault("_keys_of", {})
        if (table, col) not in cache:
            rows = self.db.tables[table].where(_q(col).isNotNull()).groupBy(_q(col)).count()
            n, most = rows.agg(F.count(F.lit(1)), F.max("count")).first()
            cache[table, col] = n, (most or 0) > 1
        return cache[table, col]

    def one_row_per_key(self, table: str, col: str) -> DataFrame:
        """``table`` with one row per value of ``col``.  Only where values repeat are rows merged: of
        the rows that share a value, the smallest one, compared column by column (nulls first;
        columns of map type are left out), stands for them, found by partial aggregation."""
        df = self.db.tables[table]
        if not self.keys_of(table, col)[1]:
            return df
        row = F.struct(*[_q(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
        return df.where(_q(col).isNotNull()).groupBy(_q(col).alias("__kept")).agg(F.min(row).alias("__row")).select("__row.*")

    def entity_feats(self, table: str, q: DataFrame, r: int, via, has_c: bool, small: bool, key_col: str,
                     emit_vt: bool = False) -> tuple[DataFrame, list[_Feat]]:
        """Features of the ``table`` rows whose ``key_col`` is ``q.__k`` at cutoff ``q.__c``.
        Returns one row per matched ``(__k, __c)``; the caller left-joins it back.
        ``emit_vt``: no cutoff; the row's own time is returned as ``__vt`` instead and its
        attributes are marked as visible from that time."""
        meta = self.db.metas[table]
        pdf = self.one_row_per_key(table, key_col)
        qq = self._meeting(q, small)
        rows = pdf.join(qq, _q(key_col) == F.col(_K), "inner")
        visible = None
        if has_c and meta.time_column:
            visible = self.time_micros(table) < F.col(_C)
        keep = [_K] + ([_C] if has_c else [])
        if emit_vt:
            rows = rows.withColumn("__vt", self.time_micros(table))
            keep = keep + ["__vt"]
        rows, feats = self.row_feats(rows, table, r, via, has_c, small, keep, visible)
        if emit_vt:
            own = {n for n, *_ in self.attrs(table)}
            feats = [replace(f, vis="__vt") if f.display in own else f for f in feats]
        return rows.select(*keep, *[f.col for f in feats]), feats

    def child_aggs(self, child: str, e: Relationship, q: DataFrame, r: int, has_c: bool, small: bool
                   ) -> tuple[DataFrame, list[_Feat]]:
        """Aggregates, per ``(__k, __c)`` of ``q``, over the ``child`` rows with
        ``child.fk == __k`` (and ``time < __c``)."""
        meta = self.db.metas[child]
        label = self.label(child, e, self.db.children_of(e.parent), "child")
        if not self.num_prims and not self.cat_prims:
            r = 0  # only COUNT is requested: no child-row feature would be aggregated
        hot = []
        if has_c and meta.time_column is not None and (self.prefix_ok(child, e, r) or self.spans_ok(child, e, r)):
            hot = self.hot_keys(child, e, q)
        found = self._split_hot(child, e, q, r, label, small, hot) if hot else self._child_plan(child, e, q, r, has_c, label, small)
        self.split = bool(hot)  # of this call, for the caller: calls inside have set their own
        return found

    def _child_plan(self, child: str, e: Relationship, q: DataFrame, r: int, has_c: bool, label: str, small: bool,
                    share: Column | None = None) -> tuple[DataFrame, list[_Feat]]:
        """``share``: which child rows can belong to the keys of ``q``; only they are dealt out by key."""
        cdf = self.db.tables[child]
        meta = self.db.metas[child]
        if has_c and meta.time_column is not None and self.strategy in ("window", "bucketed"):
            if self.prefix_ok(child, e, r):
                return self._child_aggs_window(child, e, q, r, label, small, share)
            if self.spans_ok(child, e, r):
                return self._child_aggs_spans(child, e, q, r, label, small, share)
        qq = self._meeting(q, small)
        cond = _q(e.child_col) == F.col(_K)
        if has_c and meta.time_column:
            cdf = self.visible_rows(child) if share is None else self.visible_rows(child).where(share)
            cond = cond & (self.time_micros(child) < qq[_C])
        crows = cdf.join(qq, cond, "inner")
        keep = [_K] + ([_C] if has_c else [])
        crows, feats = self.row_feats(crows, child, r, e, has_c, False, keep)
        aggs, out = self._agg_exprs(feats, label)
        if self.count:
            cnt = _tmp()
            aggs.append(F.count(F.lit(1)).alias(cnt))
            out.append(_Feat(cnt, f"COUNT({label})", NUMERIC, "long", ("count",), False, True))
        if not aggs:
            return q.select(*keep), []
        return crows.groupBy(*keep).agg(*aggs), out

    def _agg_exprs(self, feats: Iterable[_Feat], label: str, over=None) -> tuple[list[Column], list[_Feat]]:
        aggs, out = [], []
        for f in feats:
            prims = self.num_prims if f.kind == NUMERIC else self.cat_prims
            for p in prims:
                if over is not None and p not in FRAME_PRIMITIVES:
                    continue
                col = _tmp()
                x = F.col(f.col)
                if p == "max":
                    e, dt = F.max(x), f.dtype
                elif p == "min":
                    e, dt = F.min(x), f.dtype
                elif p == "mean":
                    e, dt = self._mean(x, f.dtype, over), "double"
                elif p == "std":
                    e, dt = F.stddev_samp(x), "double"
                elif p == "median":
                    e, dt = F.median(x), "double"
                else:  # mode: most frequent value, smallest on ties
                    e, dt = F.mode(x, True), "string"
                if over is not None and p != "mean":
                    e = e.over(over)
                aggs.append(e.alias(col))
                out.append(_Feat(col, f"{p.upper()}({label}.{f.display})", NUMERIC if p != "mode" else CATEGORY,
                                 dt, (p,) + f.prims, f.epoch))
        return aggs, out

    @staticmethod
    def _sums(x: Column, dtype: str, over=None) -> tuple[Column, Column, Column, Column]:
        """Count, exact decimal sum, number of values the decimals can't hold, and double sum."""
        scaled = x.cast(T.DecimalType(38, 0)) if dtype == "long" else F.when(
            (F.abs(x) >= F.lit(BIG_DOUBLE)) & (F.abs(x) < F.lit(BIG_LONG)),  # integers: exact through ``long``
            x.try_cast("long").try_cast(T.DecimalType(38, 10))).otherwise(x.try_cast(T.DecimalType(38, 10)))
        lost = F.lit(None) if dtype == "long" else F.when(x.isNotNull() & ~F.coalesce(scaled.cast("double") == x, F.lit(False)), 1)
        parts = [F.count(x), F.try_sum(scaled), F.count(lost), F.sum(x.cast("double"))]
        return tuple(c.over(over) if over is not None else c for c in parts)

    @staticmethod
    def _ratio(n: Column, exact: Column, lost: Column, double: Column) -> Column:
        return F.when(n > 0, F.when((lost == 0) & exact.isNotNull(), exact.cast("double")).otherwise(double) / n.cast("double"))

    def _mean(self, x: Column, dtype: str, over=None) -> Column:
        """The decimal sum divided by the count wherever decimals hold every value exactly (so
        that every plan and partitioning gives the same bits), else the mean of the doubles:
        tiny, huge and non-finite values, or a sum beyond the decimals' range."""
        return self._ratio(*self._sums(x, dtype, over))

    def prefix_ok(self, child: str, e: Relationship, r: int) -> bool:
        """The prefix plans apply when every feature of a child row depends on the cutoff only
        through the row's own time or a timed parent's own time (visibility)."""
        if r >= 1:
            for g in self.children(child, e):
                if self.timed(g.child, r - 1, g):
                    return False
            for p in self.parents(child, e):
                if self.below_timed(p.parent, r - 1, p):
                    return False
        return True

    def spans_ok(self, child: str, e: Relationship, r: int) -> bool:
        """The span plan applies when a child row's features change only at its own time and at
        those of its timed child rows, all found by one column of it, and aggregates merge."""
        if r < 1 or "median" in self.num_prims or any(self.timed(p.parent, r - 1, p) for p in self.parents(child, e)):
            return False
        inner = [g for g in self.children(child, e) if self.timed(g.child, r - 1, g)]
        return (bool(inner) and len({g.parent_col for g in inner}) == 1
                and all(self.db.metas[g.child].time_column and not self.below_timed(g.child, r - 1, g) for g in inner))

    # ---- plan per key ----------------------------------------------------------------------
    def heavy_keys(self, child: str, e: Relationship, most: int = 256, tracked: int = 10_000) -> list[tuple]:
        """(key, rows) of the keys with most child rows, from one pass with a frequent-items
        sketch of ``tracked`` keys: a key that it misses has less than about ``4 / tracked`` of all
        rows.  Only rows that some cutoff can see are read."""
        if e not in self._heavy:
            key = _q(e.child_col)
            top = self.visible_rows(child).where(key.isNotNull()).agg(F.call_function("approx_top_k", key, F.lit(most), F.lit(tracked)).alias("top")).first()["top"]
            self._heavy[e] = [(t["item"], t["count"]) for t in top or []]
        return self._heavy[e]

    def hot_keys(self, child: str, e: Relationship, q: DataFrame) -> list[tuple]:
        """(key, rows, cutoffs) of the keys that must not be one task's work in the plan at hand."""
        if self.cfg.cutoff_strategy not in ("auto", "window") or self.strategy == "bucketed":
            return []
        cfg, join = self.cfg, self.strategy == "join"
        heavy = {k: n for k, n in self.heavy_keys(child, e) if (n * max(self.task_rows, 1) > cfg.hot_key_pairs if join else n > cfg.hot_key_rows)}
        if not heavy:
            return []
        cuts = q.where(F.col(_K).isin(list(heavy))).groupBy(_K).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 256 rows
        return [(c[_K], heavy[c[_K]], c["n"]) for c in cuts if not join or heavy[c[_K]] * c["n"] > cfg.hot_key_pairs]

    def _split_hot(self, child: str, e: Relationship, q: DataFrame, r: int, label: str, small: bool, hot: list) -> tuple[DataFrame, list[_Feat]]:
        """Hot keys by ranges of time, the others by the plan at hand.  Rows of hot keys are left out of
        the others' shuffle by key, and meet their own few keys without one."""
        keys = [k for k, _, _ in hot]
        is_hot, has_hot = F.col(_K).isin(keys), _q(e.child_col).isin(keys)
        cold, out = self._child_plan(child, e, q.where(~is_hot), r, True, label, small, ~has_hot)
        own = copy.copy(self)
        own.strategy = "bucketed"
        rows, most = self.cfg.hot_bucket_rows, max(n + c for _, n, c in hot)
        pieces = min(200, -(-most // rows))
        times = self.visible_rows(child).where(_q(e.child_col).isin(keys)).select(_q(e.child_col).alias(_K), self.time_micros(child).alias("__t")) \
            .unionByName(q.where(is_hot).select(_K, F.col(_C).alias("__t"))).where(F.col("__t").isNotNull())
        steps = [i / (pieces + 1) for i in range(1, pieces + 1)]
        # a time per piece and hot key: at most 256 x 200 numbers
        own.hot_bounds = times.groupBy(_K).agg(F.array_sort(F.array_distinct(F.percentile_approx("__t", steps, 10_000))).alias("__bounds")).checkpoint()
        own.hot_ranges, own.hot_chunks = max(8, pieces), max(1, -(-max(c for _, _, c in hot) // rows))
        warm, also = own._child_plan(child, e, q.where(is_hot), r, True, label, True, has_hot)  # at most 256 keys
        place = {f.display: f.col for f in out}
        names = {f.col: place[f.display] for f in also}
        warm = warm.select(*[F.col(c).alias(names.get(c, c)) for c in warm.columns])
        return cold.unionByName(warm.select(*cold.columns)), out

    def _child_aggs_window(self, child: str, e: Relationship, q: DataFrame, r: int, label: str, small: bool, share: Column | None = None
                           ) -> tuple[DataFrame, list[_Feat]]:
        """Prefix plan: child rows and cutoffs sorted together per key; each cutoff row sees
        the child rows strictly before it (``rangeBetween(unboundedPreceding, -1)``).

        Child-row features are computed once per child row, without any cutoff.  A value
        that also depends on a timed parent becomes visible at ``greatest(row time, parent
        time)``: such values travel in their own event rows with that time.  ``mode`` is exact:
        a running count per (key, value), then the prefix minimum of ``(-count, value)``."""
        cdf = self.visible_rows(child) if share is None else self.visible_rows(child).where(share)
        keys = q.select(_K).distinct()
        keys = self._meeting(keys, small)
        base = cdf.join(keys, _q(e.child_col) == F.col(_K), "inner").withColumn("__t", self.time_micros(child)) \
            .where(F.col("__t").isNotNull())
        rows, feats = self.row_feats(base, child, r, e, False, False, [_K, "__t"], defer=True)

        def when_visible(f: _Feat) -> Column:
            return F.col("__t") if f.vis is None else F.greatest(F.col("__t"), F.col(f.vis))

        num = [f for f in feats if f.kind == NUMERIC]
        cat = [f for f in feats if f.kind == CATEGORY] if self.cat_prims else []
        groups: dict = {}
        for f in num:
            groups.setdefault(f.vis, []).append(f)
        # one pass over the child rows: each row emits one event per visibility group
        # (explode), instead of one scan of the rows per group
        types = {f.col: ("long" if f.dtype == "long" else "double") for f in num}
        bucketed = self.strategy == "bucketed"
        recs = []
        for vcol, fs in [(None, groups.get(None, []))] + [(v, fs) for v, fs in groups.items() if v is not None]:
            mine = {f.col for f in fs}
            fields = [(F.col("__t") if vcol is None else F.greatest(F.col("__t"), F.col(vcol))).alias("__t"),
                      (F.lit(1) if vcol is None else F.lit(None)).cast("int").alias("__ev")]
            fields += [(F.col(c) if c in mine else F.lit(None)).cast(types[c]).alias(c) for c in types]
            rec = F.struct(*fields)
            recs.append(rec if vcol is None else F.when(F.col(vcol).isNotNull(), rec))
        qs = q.where(F.col(_C).isNotNull()).select(_K, F.col(_C).alias("__t"), F.lit(1).alias("__q"))
        exploded = lambda df, *more: df.select(_K, *more, F.explode(F.array(*recs)).alias("__r")).where(F.col("__r").isNotNull()).select(_K, *more, "__r.*")
        if bucketed or len(recs) == 1:
            u = exploded(rows).unionByName(qs, allowMissingColumns=True)
        else:  # rows go to their keys before they become several events each; a cutoff becomes one
            asked, own = F.col("__q").isNotNull(), recs[0]
            recs = [F.when(asked, own.withField("__ev", F.lit(None).cast("int"))).otherwise(own)] + [F.when(~asked, r) for r in recs[1:]]
            flat = rows.select(_K, "__t", *types, *[v for v in groups if v is not None])
            u = exploded(_by_key(flat.unionByName(qs, allowMissingColumns=True)), "__q")
        w = Window.partitionBy(_K).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
        if bucketed:
            res, out = self._bucketed_numeric(u, num if any(p in FRAME_PRIMITIVES for p in self.num_prims) else [], label)
        else:
            aggs, out = self._agg_exprs(num, label, over=w)
            if self.count:
                cnt = _tmp()
                aggs.append(F.count("__ev").over(w).alias(cnt))
                out.append(_Feat(cnt, f"COUNT({label})", NUMERIC, "long", ("count",), False, True))
            res = u.select(_K, "__t", "__q", *aggs).where(F.col("__q") == 1).withColumnRenamed("__t", _C).drop("__q")
        if cat:
            modes, mout = (self._bucketed_modes if bucketed else self._prefix_modes)(rows, q, cat, label, when_visible)
            res, out = _beside(res, modes), out + mout
        if num and "median" in self.num_prims:
            medians, mout = self._medians(rows, q, num, label, when_visible, bucketed)
            res, out = _beside(res, medians), out + mout
        return res, out

    def _medians(self, rows: DataFrame, q: DataFrame, num: list, label: str, when_visible, bucketed: bool) -> tuple[DataFrame, list[_Feat]]:
        """A7 before each cutoff, of all numeric columns in one narrow unpivoted stream."""
        ev = _column_events(rows, num, when_visible, "double")
        qs = q.where(F.col(_C).isNotNull()).select(_K, F.col(_C).alias("__t"), F.explode(F.array(*[F.lit(i) for i in range(len(num))])).alias("__ci"))
        if bucketed:
            ev, qs = (self._with_bucket(x).withColumnRenamed("__b", "bucket") for x in (ev, qs))
            found = bucketed_medians(ev, qs, _K, "__ci", "__t", "__x", self.hot_ranges, self.hot_chunks, self.hot_bounds is not None)
        else:
            found = window_medians(ev, qs, _K, "__ci", "__t", "__x")
        out, aggs = [], []
        for i, f in enumerate(num):
            col = _tmp()
            aggs.append(F.max(F.when(F.col("__ci") == i, F.col("m"))).alias(col))
            out.append(_Feat(col, f"MEDIAN({label}.{f.display})", NUMERIC, "double", ("median",) + f.prims, f.epoch))
        return found.groupBy(_K, F.col("__t").alias(_C)).agg(*aggs), out

    # ---- span plan (child rows whose features change with time) --------------------------------
    def _child_aggs_spans(self, child: str, e: Relationship, q: DataFrame, r: int, label: str, small: bool, share: Column | None = None
                          ) -> tuple[DataFrame, list[_Feat]]:
        """Child rows with timed child rows of their own: a row's states between changes become
        spans of cutoff numbers, which meet cutoffs in the nodes of a tree (see ``spans``).

        A row's states are computed as at cutoffs just after its changes, by the plans for
        ordinary child rows.  ``mode`` counts values per node; a cutoff then merges the values
        of the nodes above it."""
        keys = q.select(_K).distinct()
        keys = self._meeting(keys, small)
        cdf = self.visible_rows(child) if share is None else self.visible_rows(child).where(share)
        base = cdf.join(keys, _q(e.child_col) == F.col(_K), "inner").withColumn("__t", self.time_micros(child)) \
            .where(F.col("__t").isNotNull())
        inner = [g for g in self.children(child, e) if self.timed(g.child, r - 1, g)]
        slim = base.select(_K, _q(inner[0].parent_col).alias("__o"), "__t").distinct()
        changes = slim.withColumn("__when", F.col("__t"))
        for g in inner:
            times = self.visible_rows(g.child).select(_q(g.child_col).alias("__go"), self.time_micros(g.child).alias("__when"))
            later = slim.join(times, (F.col("__o") == F.col("__go")) & (F.col("__when") > F.col("__t")), "inner")
            changes = changes.unionByName(later.select(_K, "__o", "__t", "__when"))
        cuts, changes = number_cutoffs(q.where(F.col(_C).isNotNull()).select(_K, F.col(_C).alias("__when")), changes, _K, "__when")
        # of the changes between two cutoffs only the last is ever seen
        states = changes.groupBy(_K, "__o", "__t", "first", "count").agg(F.max("__when").alias("__when"))
        following = F.lead("first").over(Window.partitionBy(_K, "__o", "__t").orderBy("first"))
        states = states.withColumn("__last", F.coalesce(following, F.col("count"))).drop("count").withColumnsRenamed({"first": "__first", _K: "__sk", "__o": "__so", "__t": "__st"})
        on = (F.col(_K) == F.col("__sk")) & _q(inner[0].parent_col).eqNullSafe(F.col("__so")) & (F.col("__t") == F.col("__st"))
        rows = base.join(states, on, "inner").withColumn(_C, F.col("__when") + 1)
        own = copy.copy(self)  # the states' keys are not the hot ones
        own.strategy, own.hot_bounds = (self.strategy if self.hot_bounds is None else "window"), None
        rows, feats = own.row_feats(rows, child, r, e, True, False, [_K, "__first", "__last"])
        num = [f for f in feats if f.kind == NUMERIC]
        cat = [f for f in feats if f.kind == CATEGORY] if self.cat_prims else []
        # spans, numbers and categories in one stream, and cutoffs: where no key is hot they go to their
        # keys before they become many nodes each, and all that follows stays there
        deal = _by_key if self.hot_bounds is None and self.strategy == "window" else lambda df: df
        node = [F.col("__n.height").alias("height"), F.col("__n.node").alias("node")]
        above = deal(cuts.select(_K, F.col("__when").alias(_C), "number", "count"))
        above = above.select(_K, _C, F.explode(nodes_above(F.col("number"), F.col("count"))).alias("__n")).select(_K, _C, *node)
        numbers = lambda known: [(F.col(f.col) if known else F.lit(None).cast("long" if f.dtype == "long" else "double")).alias(f.col) for f in num]
        recs = [F.struct(F.lit(-1).alias("__ci"), F.lit(None).cast("string").alias("__x"), *numbers(True))]
        recs += [F.when(F.col(f.col).isNotNull(), F.struct(F.lit(i).alias("__ci"), F.col(f.col).cast("string").alias("__x"), *numbers(False))) for i, f in enumerate(cat)]
        spread = deal(rows.select(_K, "__first", "__last", *[f.col for f in num + cat]))
        spread = spread.select(_K, F.array(*recs).alias("__rs"), F.explode(nodes_of(F.col("__first"), F.col("__last"))).alias("__n"))
        spread = spread.select(_K, *node, F.explode("__rs").alias("__r")).where(F.col("__r").isNotNull()).select(_K, "height", "node", "__r.*")
        by = [_K, "height", "node"]

        parts, merged, cols, out = [F.count(F.lit(1)).alias("__rows")], [F.sum("__rows").alias("__rows")], [], []
        for f in num:
            c, x = f.col, F.col(f.col)
            if "mean" in self.num_prims:
                n, exact, lost, double = self._sums(x, f.dtype)
                parts += [n.alias(f"{c}__n"), exact.alias(f"{c}__s"), lost.alias(f"{c}__l"), double.alias(f"{c}__v")]
                overflown = F.when((F.col(f"{c}__n") > 0) & F.col(f"{c}__s").isNull(), 1).otherwise(0)
                merged += [F.sum(f"{c}__n").alias(f"{c}__n"), F.try_sum(f"{c}__s").alias(f"{c}__s"), F.sum(F.col(f"{c}__l") + overflown).alias(f"{c}__l"), F.sum(f"{c}__v").alias(f"{c}__v")]
            for p, agg in (("max", F.max), ("min", F.min)):
                if p in self.num_prims:
                    parts.append(agg(x).alias(f"{c}__{p}"))
                    merged.append(agg(f"{c}__{p}").alias(f"{c}__{p}"))
            if "std" in self.num_prims:
                parts.append(F.struct(F.count(x).alias("n"), F.avg(x).alias("a"), (F.var_pop(x) * F.count(x)).alias("q")).alias(f"{c}__m"))
                merged.append(F.sort_array(F.collect_list(F.when(F.col(f"{c}__m.n") > 0, F.col(f"{c}__m")))).alias(f"{c}__m"))  # one for each height
        for f in num:
            c = f.col
            for p in self.num_prims:
                if p == "mean":
                    v, dt = self._ratio(*[F.col(f"{c}__{k}") for k in "nslv"]), "double"
                elif p == "std":
                    v, dt = _std_of_parts(F.col(f"{c}__m")), "double"
                else:
                    v, dt = F.col(f"{c}__{p}"), f.dtype
                col = _tmp()
                cols.append(v.alias(col))
                out.append(_Feat(col, f"{p.upper()}({label}.{f.display})", NUMERIC, dt, (p,) + f.prims, f.epoch))
        if self.count:
            col = _tmp()
            cols.append(F.col("__rows").alias(col))
            out.append(_Feat(col, f"COUNT({label})", NUMERIC, "long", ("count",), False, True))
        # a row for the numbers of a cutoff, and one for each value of a category that it sees
        held = spread.groupBy(*by, "__ci", "__x").agg(*parts)
        seen = above.join(held, by).groupBy(_K, _C, "__ci", "__x").agg(*merged).select(_K, _C, "__ci", "__x", "__rows", *cols)
        aggs = [F.max(F.when(F.col("__ci") == -1, F.col(f.col))).alias(f.col) for f in out]
        for i, f in enumerate(cat):
            col = _tmp()
            best = F.min(F.when(F.col("__ci") == i, F.struct((-F.col("__rows")).alias("n"), F.col("__x").alias("v"))))
            aggs.append(best.getField("v").alias(col))
            out.append(_Feat(col, f"MODE({label}.{f.display})", CATEGORY, "string", ("mode",) + f.prims, f.epoch))
        return (seen.groupBy(_K, _C).agg(*aggs) if aggs else seen.select(_K, _C).distinct()), out

    # ---- time-bucketed prefix plan (hot keys) ------------------------------------------------
    def _bucket(self, t: Column) -> Column:
        return F.floor(t / F.lit(self.cfg.prefix_bucket_seconds * 1_000_000)).cast("long")

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        """``__b``: the bucket of ``__t``.  Hot keys are cut at quantiles of their own rows and
        cutoffs; an odd bucket is then one instant, whose rows none of its cutoffs sees."""
        if self.hot_bounds is None:
            return df.withColumn("__b", self._bucket(F.col("__t")))
        return df.join(F.broadcast(self.hot_bounds), _K).withColumn("__b", place_among(F.col("__bounds"), F.col("__t"))).drop("__bounds")

    def _bucketed_numeric(self, u: DataFrame, num: list, label: str) -> tuple[DataFrame, list[_Feat]]:
        """Prefix aggregates with no window spanning a whole key.  Events before a cutoff =
        events in earlier buckets (per-bucket summaries, prefix over at most span/width rows
        per key) + events earlier in the cutoff's own bucket (window per key and bucket).
        count/max/min/mean are exact (decimal sums); std merges (n, mean, M2) by Chan's
        formula around a per-key anchor (the mean of the key's first bucket)."""
        u = self._with_bucket(u)
        w1 = Window.partitionBy(_K, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
        ev = u.where(F.col("__q").isNull())
        dec = {f.col: f.dtype for f in num}
        part, bagg = [], []
        for f in num:
            x = F.col(f.col)
            part += [c.alias(f"{f.col}__{k}1") for k, c in zip(("n", "s", "l", "v"), self._sums(x, dec[f.col], w1))]
            part += [
                     F.max(x).over(w1).alias(f"{f.col}__x1"), F.min(x).over(w1).alias(f"{f.col}__m1"),
                     F.avg(x).over(w1).alias(f"{f.col}__a1"), (F.var_pop(x).over(w1) * F.count(x).over(w1)).alias(f"{f.col}__q1")]
            bagg += [c.alias(f"{f.col}__{k}") for k, c in zip(("n", "s", "l", "v"), self._sums(x, dec[f.col]))]
            bagg += [
                     F.max(x).alias(f"{f.col}__x"), F.min(x).alias(f"{f.col}__m"), F.avg(x).alias(f"{f.col}__a"),
                     (F.var_pop(x) * F.count(x)).alias(f"{f.col}__q")]
        part.append(F.count("__ev").over(w1).alias("__cnt1"))
        bagg.append(F.count("__ev").alias("__cnt"))
        inside = u if self.hot_bounds is None else u.where((F.col("__b") % 2 == 0) | (F.col("__q") == 1))
        within = inside.select(_K, "__t", "__b", "__q", *part).where(F.col("__q") == 1)
        bs = ev.groupBy(_K, "__b").agg(*bagg)
        qb = within.select(_K, "__b").distinct()
        allb = bs.unionByName(qb, allowMissingColumns=True)
        wb = Window.partitionBy(_K).orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
        wall = Window.partitionBy(_K).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        pre = []
        for f in num:
            c = f.col
            a = F.first(F.col(f"{c}__a"), ignorenulls=True).over(wall)
            d = F.col(f"{c}__a") - a
            pre += [F.sum(f"{c}__n").over(wb).alias(f"{c}__N"), F.try_sum(f"{c}__s").over(wb).alias(f"{c}__S"),
                    F.sum(F.col(f"{c}__l") + F.when((F.col(f"{c}__n") > 0) & F.col(f"{c}__s").isNull(), 1).otherwise(0)).over(wb).alias(f"{c}__L"),
                    F.sum(f"{c}__v").over(wb).alias(f"{c}__V"),
                    F.max(f"{c}__x").over(wb).alias(f"{c}__X"), F.min(f"{c}__m").over(wb).alias(f"{c}__M"),
                    F.sum(f"{c}__q").over(wb).alias(f"{c}__Q"), F.sum(F.col(f"{c}__n") * d).over(wb).alias(f"{c}__D1"),
                    F.sum(F.col(f"{c}__n") * d * d).over(wb).alias(f"{c}__D2"), a.alias(f"{c}__A")]
        pre.append(F.sum("__cnt").over(wb).alias("__CNT"))
        prefix = allb.select(_K, "__b", F.col("__cnt").isNull().alias("__isq"), *pre).where("__isq").drop("__isq")
        j = within.join(prefix, [_K, "__b"], "left")
        cols, out = [F.col(_K), F.col("__t").alias(_C)], []
        z = lambda c: F.coalesce(c, F.lit(0))
        for f in num:
            c = f.col
            n1, N = z(F.col(f"{c}__n1")), z(F.col(f"{c}__N"))
            n = n1 + N
            # an overflown part is null although it has values: then the doubles are used
            overflown = ((n1 > 0) & F.col(f"{c}__s1").isNull()) | ((N > 0) & F.col(f"{c}__S").isNull())
            ssum = F.when(~overflown, F.try_add(z(F.col(f"{c}__s1")), z(F.col(f"{c}__S"))))
            lost, dsum = z(F.col(f"{c}__l1")) + z(F.col(f"{c}__L")), z(F.col(f"{c}__v1")) + z(F.col(f"{c}__V"))
            for p in [p for p in self.num_prims if p in FRAME_PRIMITIVES]:
                col = _tmp()
                if p == "max":
                    e, dt = F.greatest(F.col(f"{c}__x1"), F.col(f"{c}__X")), f.dtype
                elif p == "min":
                    e, dt = F.least(F.col(f"{c}__m1"), F.col(f"{c}__M")), f.dtype
                elif p == "mean":
                    e, dt = self._ratio(n, ssum, lost, dsum), "double"
                else:  # std
                    Nd = N.cast("double")
                    m2p = z(F.col(f"{c}__Q")) + z(F.col(f"{c}__D2")) - F.when(N > 0, z(F.col(f"{c}__D1")) ** 2 / Nd).otherwise(0.0)
                    meanp = F.col(f"{c}__A") + F.when(N > 0, z(F.col(f"{c}__D1")) / Nd)
                    delta = F.col(f"{c}__a1") - meanp
                    m2 = (F.when(N == 0, z(F.col(f"{c}__q1")))
                          .when(n1 == 0, m2p)
                          .otherwise(m2p + z(F.col(f"{c}__q1")) + delta * delta * Nd * n1.cast("double") / n.cast("double")))
                    e, dt = F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1).cast("double"))), "double"
                cols.append(e.alias(col))
                out.append(_Feat(col, f"{p.upper()}({label}.{f.display})", NUMERIC, dt, (p,) + f.prims, f.epoch))
        if self.count:
            col = _tmp()
            cols.append((z(F.col("__cnt1")) + z(F.col("__CNT"))).alias(col))
            out.append(_Feat(col, f"COUNT({label})", NUMERIC, "long", ("count",), False, True))
        return j.select(*cols), out

    def _bucketed_modes(self, rows: DataFrame, q: DataFrame, cat: list, label: str, when_visible):
        """Exact prefix mode without a window over a whole key: an event's running count of its
        value = count in earlier buckets (prefix over per-bucket counts) + running count inside
        its bucket; the best ``(-count, value)`` before a cutoff is the smaller of the best in
        earlier buckets (prefix minimum over per-bucket minima) and the best earlier inside
        the cutoff's bucket."""
        ev = self._with_bucket(_column_events(rows, cat, when_visible, "string"))
        per = ev.groupBy(_K, "__ci", "__x", "__b").agg(F.count(F.lit(1)).alias("__nb"))
        per = per.withColumn("__prev", F.coalesce(F.sum("__nb").over(
            Window.partitionBy(_K, "__ci", "__x").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        run = F.count(F.lit(1)).over(Window.partitionBy(_K, "__ci", "__x", "__b").orderBy("__t")
                                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        still = None
        if self.hot_bounds is not None:  # at one instant only the last running count can be the best
            still = per.where(F.col("__b") % 2 == 1).select(_K, "__ci", "__b", F.struct((-(F.col("__prev") + F.col("__nb"))).alias("n"), F.col("__x").alias("v")).alias("__s"))
            ev = ev.where(F.col("__b") % 2 == 0)
        ev = ev.withColumn("__r", run).join(per.select(_K, "__ci", "__x", "__b", "__prev"), [_K, "__ci", "__x", "__b"])
        ev = ev.select(_K, "__t", "__ci", "__b", F.struct((-(F.col("__prev") + F.col("__r"))).alias("n"),
                                                          F.col("__x").alias("v")).alias("__s"))
        qs = self._with_bucket(q.where(F.col(_C).isNotNull()).select(
            _K, F.col(_C).alias("__t"), F.explode(F.array(*[F.lit(i) for i in range(len(cat))])).alias("__ci"), F.lit(1).alias("__q")))
        u = ev.unionByName(qs, allowMissingColumns=True)
        w1 = Window.partitionBy(_K, "__ci", "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
        within = u.select(_K, "__t", "__ci", "__b", "__q", F.min("__s").over(w1).alias("__in")).where(F.col("__q") == 1)
        ended = ev.select(_K, "__ci", "__b", "__s")
        bmin = (ended if still is None else ended.unionByName(still)).groupBy(_K, "__ci", "__b").agg(F.min("__s").alias("__bm"))
        allb = bmin.unionByName(within.select(_K, "__ci", "__b").distinct(), allowMissingColumns=True)
        wb = Window.partitionBy(_K, "__ci").orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
        prefix = allb.select(_K, "__ci", "__b", F.col("__bm").isNull().alias("__isq"),
                             F.min("__bm").over(wb).alias("__pm")).where("__isq").drop("__isq").distinct()
        best = within.join(prefix, [_K, "__ci", "__b"], "left").select(
            _K, "__t", "__ci", F.least(F.col("__in"), F.col("__pm")).getField("v").alias("__m"))
        out, aggs = [], []
        for i, f in enumerate(cat):
            col = _tmp()
            aggs.append(F.max(F.when(F.col("__ci") == i, F.col("__m"))).alias(col))
            out.append(_Feat(col, f"MODE({label}.{f.display})", CATEGORY, "string", ("mode",) + f.prims, f.epoch))
        return best.groupBy(_K, F.col("__t").alias(_C)).agg(*aggs), out

    def _prefix_modes(self, rows: DataFrame, q: DataFrame, cat: list, label: str, when_visible):
        """Exact prefix mode of every categorical column in one narrow unpivoted stream
        ``(key, time, column id, value)``: a running count per (key, column, value), the
        prefix minimum of ``(-count, value)`` per (key, column), then one pivot back."""
        qs = q.where(F.col(_C).isNotNull()).select(_K, F.col(_C).alias("__t"), F.lit(1).alias("__q"))
        used = list(dict.fromkeys([f.col for f in cat] + [f.vis for f in cat if f.vis is not None]))
        flat = _by_key(rows.select(_K, "__t", *used).unionByName(qs, allowMissingColumns=True))
        u = _column_events(flat, cat, when_visible, "string", "__q")
        run = F.count("__x").over(Window.partitionBy(_K, "__ci", "__x").orderBy("__t")
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        u = u.withColumn("__n", F.when(F.col("__x").isNotNull(), run))
        w = Window.partitionBy(_K, "__ci").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
        best = F.min(F.when(F.col("__x").isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col("__x").alias("v")))).over(w)
        picked = u.select(_K, "__t", "__ci", "__q", best.getField("v").alias("__m")).where(F.col("__q") == 1)
        out, aggs = [], []
        for i, f in enumerate(cat):
            col = _tmp()
            aggs.append(F.max(F.when(F.col("__ci") == i, F.col("__m"))).alias(col))
            out.append(_Feat(col, f"MODE({label}.{f.display})", CATEGORY, "string", ("mode",) + f.prims, f.epoch))
        modes = picked.groupBy(_K, F.col("__t").alias(_C)).agg(*aggs)
        return modes, out


def _by_key(df: DataFrame) -> DataFrame:
    """``df`` dealt out by its key alone: windows by the key and more columns then need no other
    shuffle.  The number of partitions is set, else AQE merges them by bytes that are multiplied later."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(_K))


def _by_pair(df: DataFrame, key: Column, cutoff: Column) -> DataFrame:
    """``df`` dealt out by key and cutoff, in the terms of a join on them that is null-safe in the cutoff."""
    return df.repartition(key, F.coalesce(cutoff, F.lit(0).cast("long")), F.isnull(cutoff))


def _column_events(rows: DataFrame, feats: list, when_visible, kind: str, asked: str | None = None) -> DataFrame:
    """``(key, time, column id, value)`` for every non-null value, all columns in one pass over
    ``rows`` (a parent's value only when the parent has a time).  Rows whose column ``asked`` is set
    are cutoffs and stay, without values, for every column id."""
    recs = []
    for i, f in enumerate(feats):
        ok = F.col(f.col).isNotNull()
        if f.vis is not None:
            ok = ok & F.col(f.vis).isNotNull()
        rec = F.when(ok, F.struct(when_visible(f).alias("__t"), F.lit(i).alias("__ci"),
                                  F.col(f.col).cast(kind).alias("__x")))
        if asked is not None:
            rec = F.when(F.col(asked).isNotNull(), F.struct(F.col("__t"), F.lit(i).alias("__ci"), F.lit(None).cast(kind).alias("__x"))).otherwise(rec)
        recs.append(rec)
    more = [] if asked is None else [asked]
    return rows.select(_K, *more, F.explode(F.array(*recs)).alias("__r")).where(F.col("__r").isNotNull()).select(_K, *more, "__r.*")


def _beside(res: DataFrame, more: DataFrame) -> DataFrame:
    """``res`` with the columns that ``more`` has for the same key and cutoff."""
    k2, c2 = _tmp("__jk"), _tmp("__jc")
    more = more.withColumnRenamed(_K, k2).withColumnRenamed(_C, c2)
    return res.join(more, (F.col(_K) == F.col(k2)) & (F.col(_C) == F.col(c2)), "left").drop(k2, c2)


def _std_of_parts(parts: Column) -> Column:
    """Sample deviation from an array of (n, mean a, sum q of squares about it), by Chan's formula."""
    def merge(m, p):
        n = m["n"] + p["n"]
        delta = p["a"] - m["a"]
        share = p["n"].cast("double") / n.cast("double")
        return F.struct(n.alias("n"), (m["a"] + delta * share).alias("a"), (m["q"] + p["q"] + delta * delta * m["n"].cast("double") * share).alias("q"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("q"))
    return F.aggregate(parts, none, merge, lambda m: F.when(m["n"] > 1, F.sqrt(m["q"] / (m["n"] - 1).cast("double"))))


def _prefix(f: _Feat, label: str, keep_count: bool = False) -> _Feat:
    return _Feat(f.col, f"{label}.{f.display}", f.kind, f.dtype, f.prims, f.epoch, f.count and keep_count, f.vis)


def _cast_key(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    if src == dst:
        return c
    if isinstance(dst, T.StringType):
        return key_to_string(c, src)
    return c.try_cast(dst)


def synthesize(db: RelationalDataset, task: DataFrame, key_mappings: Mapping[str, str],
               cutoff_time_column: str | None = None, config=None, task_rows: int | None = None) -> SynthesisResult:
    """Compute the feature frame for ``task``: its own columns plus the generated features,
    one output row per task row (duplicates kept, nothing dropped).

    ``key_mappings`` maps task columns to ``"table.column"``; the column need not be the
    table's primary key.  Where its values repeat, one row stands for each value.
    ``task_rows`` is an upper bound on the task frame's rows if the caller knows one
    (e.g. a bounded sample); otherwise one count job measures it, and that number decides
    whether query sets are broadcast and which cutoff plan is used.
    """
    cfg = DFSConfig.from_any(config)
    if cfg.max_depth < 1 or not key_mappings:
        return SynthesisResult(task, [])
    spark = task.sparkSession
    has_cutoff = cutoff_time_column is not None
    base = task
    if has_cutoff:
        ct = task.schema[cutoff_time_column].dataType
        base = base.withColumn(_C, epoch_micros(_q(cutoff_time_column), ct))

    mappings = []
    for tcol, ref in key_mappings.items():
        if tcol not in task.columns or "." not in ref:
            continue
        table, pk = ref.split(".", 1)
        if table not in db.tables:
            raise ValueError(f"key mapping {tcol!r} -> {ref!r}: no table {table!r}")
        mappings.append((tcol, table, pk))

    # sizing: one pass over the task frame (count and approximate distinct keys per mapping)
    strategies = {tcol: cfg.cutoff_strategy for tcol, _, _ in mappings}
    row = None
    if has_cutoff or task_rows is None or (cfg.cutoff_strategy == "auto" and has_cutoff):
        aggs = [F.count(F.lit(1)).alias("n")] + [F.approx_count_distinct(_q(t)).alias(f"d{i}") for i, (t, _, _) in enumerate(mappings)]
        if has_cutoff:
            aggs.append(F.max(_C).alias("last"))
        row = (base if has_cutoff else task).agg(*aggs).first()
        task_rows = row["n"] if task_rows is None else min(task_rows, row["n"])
        if cfg.cutoff_strategy == "auto":
            # per mapping: the prefix plan pays off when an entity has many cutoffs
            for i, (tcol, _, _) in enumerate(mappings):
                per_key = row["n"] / max(row[f"d{i}"], 1)
                strategies[tcol] = "window" if has_cutoff and per_key > cfg.window_cutoffs_per_key else "join"
    strategies = {k: ("join" if v == "auto" else v) for k, v in strategies.items()}
    planner = _Planner(db, cfg, "join", task_rows)
    if has_cutoff and row is not None:
        planner.max_cutoff = row["last"]

    out = base
    all_feats: list[tuple[_Feat, str]] = []
    tables_seen = [t for _, t, _ in mappings]
    for tcol, table, pk in mappings:
        planner.strategy = strategies[tcol]
        r = cfg.max_depth - 1
        has_c = has_cutoff and planner.timed(table, r, None)
        pk_type = db.tables[table].schema[pk].dataType
        kexpr = _cast_key(_q(tcol), task.schema[tcol].dataType, pk_type)
        q = base.select(kexpr.alias(_K), *([F.col(_C)] if has_c else [])).distinct()
        small = planner.fits_broadcast(q)
        ef, feats = planner.entity_feats(table, q, r, None, has_c, small, pk)
        k2, c2 = _tmp("__jk"), _tmp("__jc")
        ef = ef.withColumnRenamed(_K, k2)
        cond = kexpr == F.col(k2)
        if has_c:
            ef = ef.withColumnRenamed(_C, c2)
            cond = cond & F.col(_C).eqNullSafe(F.col(c2))
        if planner.fits_broadcast(ef):
            ef = F.broadcast(ef)
        elif has_c and row["d%d" % [t for t, _, _ in mappings].index(tcol)] < FEW_KEYS:  # task rows are not dealt out by few keys
            ef = _by_pair(ef, F.col(k2), F.col(c2))
        out = out.join(ef, cond, "left").drop(k2, c2)
        lab = table if tables_seen.count(table) == 1 else f"{table}[{tcol}]"
        all_feats += [(_prefix(f, lab, keep_count=True), tcol) for f in feats]

    # final names: sanitised display names, de-duplicated
    taken = set(task.columns)
    sel = [_q(c) for c in task.columns]
    defs = []
    for f, _ in all_feats:
        name = sanitize_name(f.display)
        base_name, i = name, 2
        while name in taken:
            name, i = f"{base_name}_{i}", i + 1
        taken.add(name)
        c = F.coalesce(F.col(f.col), F.lit(0).cast("long")) if f.count else F.col(f.col)
        sel.append(c.alias(name))
        defs.append(FeatureDef(name, f.display, f.kind, f.prims, f.epoch))
    return SynthesisResult(out.select(*sel), defs)


def compute_dfs_features(db: RelationalDataset, task: DataFrame, key_mappings: Mapping[str, str],
                         cutoff_time_column: str | None = None, config=None) -> DataFrame:
    """The task frame with its generated feature columns."""
    return synthesize(db, task, key_mappings, cutoff_time_column, config).df
