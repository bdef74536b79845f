"""Database preparation (E3): dummy tables (J6), missing parent rows (J5), datetime to
epoch (F1), text drop (P2) and canonical types (F8).  Every step returns a new
``RelationalDataset`` whose tables are lazy plans over the inputs."""
from __future__ import annotations

from typing import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import EPOCH_SUFFIX, epoch_ns, is_datetime_type, is_integral_type, key_to_string
from ..sources.rdb import TEXT, RelationalDataset, TableMeta


def _q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def handle_dummy_tables(db: RelationalDataset) -> RelationalDataset:
    """For every edge whose parent table does not exist, create it as a one-column
    table holding the distinct non-null key values of all edges pointing at that name."""
    missing: dict[str, list] = {}
    for r in db.relationships:
        if r.parent not in db.tables:
            missing.setdefault(r.parent, []).append(r)
    for parent, edges in missing.items():
        pk = edges[0].parent_col
        types = {db.tables[e.child].schema[e.child_col].dataType for e in edges}
        as_string = len(types) > 1
        parts = []
        for e in edges:
            c = _q(e.child_col)
            if as_string:
                c = key_to_string(c, db.tables[e.child].schema[e.child_col].dataType)
            parts.append(db.tables[e.child].select(c.alias(pk)).where(_q(pk).isNotNull()))
        keys = parts[0]
        for p in parts[1:]:
            keys = keys.unionByName(p)
        db = db.with_table(parent, keys.distinct(), TableMeta(parent, pk, None, {}))
        if as_string:
            for e in edges:
                db = db._cast_key_to_string(e.child, e.child_col)
        # edges may name a different parent column than the first edge
        rels = [r if r.parent != parent else type(r)(r.child, r.child_col, r.parent, pk) for r in db.relationships]
        db = RelationalDataset(db.name, db.tables, db.metas, rels)
    return db


#: Bytes a parent's keys may take as a broadcast hash table, about ``KEY_BYTES`` each besides their text.
#: The driver holds it several times while it is built and sent, and tables follow each other.
BROADCAST_BYTES, KEY_BYTES = 8 << 20, 48


def _fits_broadcast(keys: DataFrame, most_bytes: int) -> bool:
    """Whether a column of keys is proven to fit, by its rows and the bytes of their text."""
    c = F.col(keys.columns[0])
    size = F.octet_length(c) if isinstance(keys.schema[0].dataType, (T.StringType, T.BinaryType)) else F.lit(0)
    rows, text = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows * KEY_BYTES + text <= most_bytes


def _without_parent(fks: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """The distinct ``__fk`` that are no ``__pk``; ``small`` keys are broadcast."""
    missing = F.col("__fk") == F.col("__pk")
    if small:
        return fks.join(F.broadcast(keys), missing, "left_anti").distinct()
    return fks.distinct().join(keys.hint("merge"), missing, "left_anti")  # compressed files tell little of their keys


def fill_missing_primary_keys(db: RelationalDataset, materialize: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
                              whole: Collection[str] = ()) -> RelationalDataset:
    """Add a parent row (key only, other columns null) for every foreign-key value that
    has no parent.

    Children are looked up where they lie if the parent's keys are measured to fit
    ``broadcast_bytes``: only values without a parent are shuffled, none for an intact edge.  The
    keys of larger parents meet the children's distinct values by a shuffle on the key.  ``whole``:
    parents that are known to hold all keys, which are not looked at.

    ``materialize``: run that check once now and checkpoint the missing-key rows (to the
    cluster checkpoint dir); a parent with none keeps its plain scan, so later plans that
    read it many times carry no union and no anti join over its child tables."""
    by_parent: dict[str, list] = {}
    for r in db.relationships:
        if r.parent in db.tables and r.parent not in whole:
            by_parent.setdefault(r.parent, []).append(r)
    for parent, edges in by_parent.items():
        pk = db.metas[parent].primary_key or edges[0].parent_col
        edges = [e for e in edges if e.parent_col == pk]  # a value of another column makes no row
        if not edges:
            continue
        pdf = db.tables[parent]
        pt = pdf.schema[pk].dataType
        fks = None
        for e in edges:
            k = db.tables[e.child].select(_q(e.child_col).cast(pt).alias("__fk")).where(F.col("__fk").isNotNull())
            fks = k if fks is None else fks.unionByName(k)
        keys = pdf.select(_q(pk).alias("__pk"))
        small = materialize and _fits_broadcast(keys, broadcast_bytes)  # without materialize this step only plans
        new = _without_parent(fks, keys, small).select(F.col("__fk").alias(pk))
        if materialize:
            new = new.checkpoint(eager=True)
            if new.isEmpty():
                continue
        db = db.with_table(parent, pdf.unionByName(new, allowMissingColumns=True))
    return db


def featurize_datetime(db: RelationalDataset) -> RelationalDataset:
    """every datetime column becomes ``<col>_epochtime`` (int64 ns).  The table's time
    column is also kept as is, because cutoff filtering reads it."""
    for t, df in list(db.tables.items()):
        m = db.metas[t]
        keys = db.key_columns(t)
        cols = []
        changed = False
        for f in df.schema.fields:
            if f.name in keys or not is_datetime_type(f.dataType) or db.metas[t].roles.get(f.name) == TEXT:
                cols.append(_q(f.name))
                continue
            changed = True
            if f.name == m.time_column:
                cols.append(_q(f.name))
            cols.append(epoch_ns(_q(f.name), f.dataType).alias(f.name + EPOCH_SUFFIX))
        if changed:
            db = db.with_table(t, df.select(*cols))
    return db


def infer_text_columns(db: RelationalDataset, min_avg_len: float = 64.0, min_distinct_ratio: float = 0.5) -> RelationalDataset:
    """Opt-in: mark string columns as ``text`` when their average length exceeds
    ``min_avg_len`` and their approximate distinct ratio exceeds ``min_distinct_ratio``.
    One aggregate pass per table (approximate distinct counts, no exact distinct)."""
    for t, df in db.tables.items():
        keys = db.key_columns(t)
        strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys
                and f.name not in db.metas[t].roles]
        if not strs:
            continue
        aggs = [F.count(F.lit(1)).alias("__n")]
        for i, c in enumerate(strs):
            aggs += [F.avg(F.length(c)).alias(f"l{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        n = row["__n"] or 0
        roles = dict(db.metas[t].roles)
        for i, c in enumerate(strs):
            if n and (row[f"l{i}"] or 0) > min_avg_len and row[f"d{i}"] / n > min_distinct_ratio:
                roles[c] = TEXT
        db = db.with_meta(t, roles=roles)
    return db


def drop_text_columns(db: RelationalDataset) -> RelationalDataset:
    """Drop columns whose role is ``text`` (Parquet never reads them afterwards)."""
    for t, df in list(db.tables.items()):
        text = [c for c, r in db.metas[t].roles.items() if r == TEXT and c in df.columns]
        if text:
            db = db.with_table(t, df.drop(*text))
    return db


def canonicalize_types(db: RelationalDataset) -> RelationalDataset:
    """F8: non-key integral and boolean columns -> long, float/decimal -> double with NaN as
    null, strings kept.  Keys keep their (already consistent) types."""
    for t, df in list(db.tables.items()):
        keys = db.key_columns(t)
        cols = []
        changed = False
        for f in df.schema.fields:
            c = _q(f.name)
            if f.name in keys:
                cols.append(c)
            elif isinstance(f.dataType, T.BooleanType):
                cols.append(c.cast("long").alias(f.name)); changed = True
            elif is_integral_type(f.dataType) and not isinstance(f.dataType, T.LongType):
                cols.append(c.cast("long").alias(f.name)); changed = True
            elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
                d = c.cast("double")
                cols.append(F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d).alias(f.name)); changed = True
            else:
                cols.append(c)
        if changed:
            db = db.with_table(t, df.select(*cols))
    return db


def prepare_db(db: RelationalDataset, drop_text: bool = True, materialize_missing_keys: bool = True
               ) -> RelationalDataset:
    """E3 pipeline: J6 -> J5 -> F1 -> P2 -> F8.  Lazy except J5's one check per parent table
    (``materialize_missing_keys``, see ``fill_missing_primary_keys``)."""
    given = set(db.tables)
    db = handle_dummy_tables(db)
    made = set(db.tables) - given  # of their children's own keys
    db = db.canonicalize_key_types()
    db = fill_missing_primary_keys(db, materialize=materialize_missing_keys, whole=made)
    db = featurize_datetime(db)
    if drop_text:
        db = drop_text_columns(db)
    return canonicalize_types(db)
