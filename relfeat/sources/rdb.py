"""Relational dataset: named DataFrames plus declared keys, edges and time columns.

Everything here is metadata plus lazy DataFrame plans; no table is collected.
"""
from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field, replace
from typing import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_datetime_type, is_numeric_type, key_to_string

# column roles
KEY, FOREIGN_KEY, NUMERIC, CATEGORY, DATETIME, TEXT, TIME = (
    "primary_key", "foreign_key", "numeric", "category", "datetime", "text", "time")


@dataclass(frozen=True)
class Relationship:
    """Directed FK edge child.child_col -> parent.parent_col."""
    child: str
    child_col: str
    parent: str
    parent_col: str

    def __iter__(self):  # unpacks as the 4-tuple (child, child_col, parent, parent_col)
        return iter((self.child, self.child_col, self.parent, self.parent_col))


@dataclass(frozen=True)
class TableMeta:
    name: str
    primary_key: str | None = None
    time_column: str | None = None
    roles: Mapping[str, str] = field(default_factory=dict)  # declared roles only


class RelationalDataset:
    """Immutable view of a relational database held as Spark DataFrames."""

    def __init__(self, name: str, tables: Mapping[str, DataFrame], metas: Mapping[str, TableMeta],
                 relationships: Iterable[Relationship]):
        self.name = name
        self.tables = dict(tables)
        self.metas = dict(metas)
        self.relationships = list(relationships)
        self._check_columns()

    # ---- construction -------------------------------------------------------------
    @classmethod
    def create(cls, name: str, tables: Mapping[str, DataFrame], primary_keys: Mapping[str, str] | None = None,
               foreign_keys: Iterable[tuple] = (), time_columns: Mapping[str, str] | None = None,
               column_roles: Mapping[str, Mapping[str, str]] | None = None) -> "RelationalDataset":
        primary_keys = dict(primary_keys or {})
        time_columns = dict(time_columns or {})
        column_roles = dict(column_roles or {})
        metas = {t: TableMeta(t, primary_keys.get(t), time_columns.get(t), dict(column_roles.get(t, {})))
                 for t in tables}
        rels = [r if isinstance(r, Relationship) else Relationship(*r) for r in foreign_keys]
        return cls(name, tables, metas, rels)

    def _check_columns(self) -> None:
        for t, m in self.metas.items():
            if t not in self.tables:
                continue
            cols = set(self.tables[t].columns)
            for c in (m.primary_key, m.time_column):
                if c is not None and c not in cols:
                    raise ValueError(f"table {t!r} has no column {c!r}")
        for r in self.relationships:
            if r.child not in self.tables:
                raise ValueError(f"edge {r}: unknown child table {r.child!r}")
            if r.child_col not in self.tables[r.child].columns:
                raise ValueError(f"edge {r}: table {r.child!r} has no column {r.child_col!r}")
            if r.parent in self.tables and r.parent_col not in self.tables[r.parent].columns:
                raise ValueError(f"edge {r}: table {r.parent!r} has no column {r.parent_col!r}")

    # ---- accessors ----------------------------------------------------------------
    @property
    def table_names(self) -> list[str]:
        return list(self.tables)

    def get_table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"no table {name!r}; tables: {sorted(self.tables)}")
        return self.tables[name]

    def get_table_metadata(self, name: str) -> TableMeta:
        if name not in self.metas:
            raise ValueError(f"no table {name!r}; tables: {sorted(self.metas)}")
        return self.metas[name]

    def get_relationships(self) -> list[Relationship]:
        return list(self.relationships)

    def children_of(self, table: str) -> list[Relationship]:
        return [r for r in self.relationships if r.parent == table and r.child in self.tables]

    def parents_of(self, table: str) -> list[Relationship]:
        return [r for r in self.relationships if r.child == table and r.parent in self.tables]

    def key_columns(self, table: str) -> set[str]:
        m = self.metas[table]
        ks = {r.child_col for r in self.relationships if r.child == table}
        # an edge may name any column of its parent; one that is not the primary key stays a feature
        ks |= {r.parent_col for r in self.relationships if r.parent == table and m.primary_key in (None, r.parent_col)}
        if m.primary_key:
            ks.add(m.primary_key)
        return ks

    def column_role(self, table: str, col: str, dtype: T.DataType) -> str:
        """Role rule: key > declared > time > datetime > numeric > category."""
        m = self.metas[table]
        if col == m.primary_key:
            return KEY
        if col in self.key_columns(table):
            return FOREIGN_KEY
        if col in m.roles:
            return m.roles[col]
        if col == m.time_column:
            return TIME
        if is_datetime_type(dtype):
            return DATETIME
        if is_numeric_type(dtype):
            return NUMERIC
        if isinstance(dtype, T.StringType):
            return CATEGORY
        return "other"

    def roles(self, table: str) -> dict[str, str]:
        df = self.tables[table]
        return {f.name: self.column_role(table, f.name, f.dataType) for f in df.schema.fields}

    # ---- functional updates ---------------------------------------------------------
    def with_table(self, name: str, df: DataFrame, meta: TableMeta | None = None) -> "RelationalDataset":
        tables = dict(self.tables)
        tables[name] = df
        metas = dict(self.metas)
        metas[name] = meta or self.metas.get(name) or TableMeta(name)
        return RelationalDataset(self.name, tables, metas, self.relationships)

    def with_meta(self, name: str, **changes) -> "RelationalDataset":
        metas = dict(self.metas)
        metas[name] = replace(metas[name], **changes)
        return RelationalDataset(self.name, self.tables, metas, self.relationships)

    def add_table(self, dataframe: DataFrame, name: str, time_column: str | None = None,
                  foreign_keys: Iterable[tuple] = (), primary_key: str | None = None) -> "RelationalDataset":
        """Attach a table; ``foreign_keys`` are 3-tuples ``(col, parent_table, parent_col)``."""
        if name in self.tables:
            raise ValueError(f"table {name!r} already exists")
        tables = dict(self.tables)
        tables[name] = dataframe
        metas = dict(self.metas)
        metas[name] = TableMeta(name, primary_key, time_column, {})
        rels = list(self.relationships) + [Relationship(name, c, p, pc) for c, p, pc in foreign_keys]
        return RelationalDataset(self.name, tables, metas, rels)

    def canonicalize_key_types(self) -> "RelationalDataset":
        """K4: for every edge whose two key columns differ in type, turn both into strings.

        Matching native types are kept (long keys hash and shuffle faster than strings)."""
        ds = self
        changed = True
        while changed:  # a column cast for one edge may disagree with another edge
            changed = False
            for r in ds.relationships:
                if r.parent not in ds.tables:
                    continue
                ct = ds.tables[r.child].schema[r.child_col].dataType
                pt = ds.tables[r.parent].schema[r.parent_col].dataType
                if ct != pt:
                    ds = ds._cast_key_to_string(r.child, r.child_col)._cast_key_to_string(r.parent, r.parent_col)
                    changed = True
        return ds

    def _cast_key_to_string(self, table: str, col: str) -> "RelationalDataset":
        df = self.tables[table]
        dt = df.schema[col].dataType
        if isinstance(dt, T.StringType):
            return self
        return self.with_table(table, df.withColumn(col, key_to_string(F.col("`" + col.replace("`", "``") + "`"), dt)))

    def validate_key_consistency(self, any_column: Iterable[str] = ()) -> None:
        """K5 (metadata part): edges point at existing columns and agree on type; raises otherwise.
        Edges of the child tables ``any_column`` need not point at a primary key."""
        for r in self.relationships:
            if r.parent not in self.tables:
                raise ValueError(f"edge {tuple(r)} points at missing table {r.parent!r}")
            ct = self.tables[r.child].schema[r.child_col].dataType
            pt = self.tables[r.parent].schema[r.parent_col].dataType
            if ct != pt:
                raise ValueError(f"edge {tuple(r)}: key types differ ({ct.simpleString()} vs {pt.simpleString()})")
            if r.child not in any_column and self.metas[r.parent].primary_key not in (None, r.parent_col):
                raise ValueError(f"edge {tuple(r)} does not point at the primary key of {r.parent!r}")

    def key_report(self) -> DataFrame:
        """K5 (data part): one row per check -- duplicate primary keys and orphan foreign keys.

        Each check is one aggregate with partial (map-side) combining; the anti join shuffles
        both sides on the key, so no table passes through the driver."""
        spark = next(iter(self.tables.values())).sparkSession
        parts = []
        for t, m in self.metas.items():
            if m.primary_key and t in self.tables:
                dup = (self.tables[t].groupBy(m.primary_key).count().where("count > 1")
                       .agg(F.count(F.lit(1)).alias("n")))
                parts.append(dup.select(F.lit(t).alias("table_name"), F.lit(m.primary_key).alias("column_name"),
                                        F.lit("duplicate_primary_key").alias("check"), F.col("n").cast("long").alias("n_bad")))
        for r in self.relationships:
            if r.parent not in self.tables:
                continue
            c = self.tables[r.child].select(F.col(r.child_col).alias("k")).where("k IS NOT NULL")
            p = self.tables[r.parent].select(F.col(r.parent_col).alias("k"))
            orphans = c.join(p, "k", "left_anti").agg(F.count(F.lit(1)).alias("n"))
            parts.append(orphans.select(F.lit(r.child).alias("table_name"), F.lit(r.child_col).alias("column_name"),
                                        F.lit("orphan_foreign_key").alias("check"), F.col("n").cast("long").alias("n_bad")))
        if not parts:
            return spark.createDataFrame([], "table_name string, column_name string, check string, n_bad long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # ---- persistence (S2) --------------------------------------------------------------
    def manifest(self) -> dict:
        return {
            "name": self.name,
            "tables": {t: {"primary_key": m.primary_key, "time_column": m.time_column, "roles": dict(m.roles)}
                       for t, m in self.metas.items() if t in self.tables},
            "relationships": [list(r) for r in self.relationships],
        }

    def save(self, path: str) -> None:
        """Write every table as Parquet into a new snapshot folder, then the manifest that points at
        it (see ``write_pointer``): a save that fails leaves the version before it whole, and frames
        that were read from that version stay readable."""
        spark = next(iter(self.tables.values())).sparkSession
        folder = snapshot_name()
        for t, df in self.tables.items():
            df.write.parquet(_join(path, folder, t))
        write_pointer(spark, path, {**self.manifest(), "folder": folder})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RelationalDataset":
        man = read_pointer(spark, path)
        tables = {t: spark.read.parquet(_join(path, man["folder"], t)) for t in man["tables"]}
        metas = {t: TableMeta(t, v.get("primary_key"), v.get("time_column"), v.get("roles", {}))
                 for t, v in man["tables"].items()}
        return cls(man["name"], tables, metas, [Relationship(*r) for r in man["relationships"]])


def create_rdb(name: str, tables: Mapping[str, DataFrame], primary_keys: Mapping[str, str] | None = None,
               foreign_keys: Iterable[tuple] = (), time_columns: Mapping[str, str] | None = None,
               column_roles: Mapping[str, Mapping[str, str]] | None = None) -> RelationalDataset:
    """Declare a relational database from DataFrames."""
    return RelationalDataset.create(name, tables, primary_keys, foreign_keys, time_columns, column_roles)


def load_rdb(spark: SparkSession, path: str) -> RelationalDataset:
    return RelationalDataset.load(spark, path)


# ---- small file helpers: every path goes through the Hadoop file system that also holds the Parquet files ----
def _join(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/")] + [p.strip("/") for p in parts])


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _hadoop_fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop_fs(spark, path)
    stream = fs.open(p)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(
        spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    lines = []
    line = reader.readLine()
    while line is not None:
        lines.append(line)
        line = reader.readLine()
    reader.close()
    return "\n".join(lines)


# ---- versions: a folder for each, and a pointer written last -------------------------------------------
def snapshot_name() -> str:
    return f"snapshot-{uuid.uuid4().hex}"


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _hadoop_fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))


def write_pointer(spark: SparkSession, path: str, content: dict) -> None:
    """Make ``content`` the newest manifest under ``path``: written beside its place, then renamed to
    a number that no manifest has, so a reader sees the old manifest or the new one."""
    number = max(_versions(spark, path), default=0) + 1
    draft = _join(path, f"draft-{uuid.uuid4().hex}")
    _write_text(spark, draft, json.dumps(content, indent=1, sort_keys=True))
    while True:
        fs, target = _hadoop_fs(spark, _join(path, f"manifest-{number}.json"))
        if not fs.exists(target) and fs.rename(_hadoop_fs(spark, draft)[1], target):
            return
        number += 1  # another writer was first


def read_pointer(spark: SparkSession, path: str) -> dict:
    """The newest manifest under ``path``."""
    numbers = _versions(spark, path)
    if not numbers:
        raise FileNotFoundError(f"{path} holds no manifest: nothing was saved there, or its writing did not end")
    return json.loads(_read_text(spark, _join(path, f"manifest-{numbers[-1]}.json")))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return bool(fs.exists(p))
