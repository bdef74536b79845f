"""Prediction tasks over a relational database.

A ``Task`` is three lazy DataFrames (train, test, optional val) plus metadata: key mappings
``{task column: "table.column"}``, target column, optional cutoff column, task type and
metric name.  A ``Dataset`` is a database plus tasks by name.  Saving writes Parquet per
frame into a new snapshot folder and a manifest of all tasks last, so a save that fails leaves
the version before it whole.
"""
from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import key_to_string, shift_time
from .rdb import FOREIGN_KEY, KEY, RelationalDataset, _join, read_pointer, snapshot_name, write_pointer

SKIPPED_TASK_TYPES = ("link_prediction",)   # S10


@dataclass
class TaskMetadata:
    key_mappings: dict
    target_col: str
    time_col: str | None = None
    task_type: str | None = None
    evaluation_metric: str | None = None


@dataclass
class Task:
    name: str
    train_df: DataFrame
    test_df: DataFrame
    metadata: TaskMetadata
    val_df: DataFrame | None = None

    def frames(self) -> dict[str, DataFrame]:
        out = {"train": self.train_df, "test": self.test_df}
        if self.val_df is not None:
            out["val"] = self.val_df
        return out


def _enum_value(v):
    """Enum or plain string -> string."""
    return getattr(v, "value", v)


class Dataset:
    def __init__(self, rdb: RelationalDataset, tasks: Iterable[Task]):
        self.rdb = rdb
        self.tasks = {t.name: t for t in tasks}   # last one wins on duplicate names

    def task(self, name: str) -> Task:
        """S13."""
        if name not in self.tasks:
            raise KeyError(f"no task {name!r}; available: {sorted(self.tasks)}")
        return self.tasks[name]

    # ---- S3 / S4 --------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        """The database's tables and the tasks' frames, each in a snapshot folder of its own; the
        manifest that makes both the newest version is written last."""
        spark = self.rdb.tables[next(iter(self.rdb.tables))].sparkSession
        folder = snapshot_name()
        self.rdb.save(_join(path, folder, "rdb"))
        tasks = {}
        for number, (name, task) in enumerate(sorted(self.tasks.items())):
            own = f"task-{number}"  # a task's name need not be a file name
            frames = task.frames()
            for split, df in frames.items():
                df.write.parquet(_join(path, folder, own, split))
            tasks[name] = {"folder": own, "splits": sorted(frames), "metadata": asdict(task.metadata)}
        write_pointer(spark, path, {"folder": folder, "tasks": tasks})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Dataset":
        man = read_pointer(spark, path)
        base = _join(path, man["folder"])
        tasks = []
        for name, info in man["tasks"].items():
            frames = {split: spark.read.parquet(_join(base, info["folder"], split)) for split in info["splits"]}
            tasks.append(Task(name, frames["train"], frames["test"], TaskMetadata(**info["metadata"]), frames.get("val")))
        return cls(RelationalDataset.load(spark, _join(base, "rdb")), tasks)

    # ---- S5 / S7 --------------------------------------------------------------------------------
    @classmethod
    def from_entity_tasks(cls, rdb: RelationalDataset, specs: Sequence[Mapping]) -> "Dataset":
        """Tasks defined on an entity table: each spec has ``name``, ``splits`` (dict of
        DataFrames), ``entity_table``, ``entity_col``, ``target_col``, optional ``time_col``,
        ``task_type`` and ``metrics`` (first one's name is used).  The entity column maps to the
        entity table's primary key (S7); ``link_prediction`` tasks are skipped (S10)."""
        tasks = []
        for s in specs:
            ttype = _enum_value(s.get("task_type"))
            if ttype in SKIPPED_TASK_TYPES:
                continue
            pk = rdb.get_table_metadata(s["entity_table"]).primary_key
            metrics = s.get("metrics") or []
            metric = None
            if metrics:
                m = metrics[0]
                metric = getattr(m, "__name__", _enum_value(m))
            md = TaskMetadata({s["entity_col"]: f"{s['entity_table']}.{pk}"}, s["target_col"], s.get("time_col"),
                              ttype, metric)
            sp = s["splits"]
            tasks.append(Task(s["name"], sp["train"], sp["test"], md, sp.get("val")))
        return cls(rdb, tasks)

    # ---- S6 / S8 / S9 -----------------------------------------------------------------------------
    @classmethod
    def from_role_tasks(cls, rdb: RelationalDataset, specs: Sequence[Mapping]) -> "Dataset":
        """Tasks whose columns carry roles: spec ``columns`` is a list of dicts with ``name``,
        ``dtype`` (role) and optional ``link_to`` ("table.column").  Foreign-key columns map
        to their link (S8); the first primary-key column maps to ``target_table``'s primary
        key unless already mapped, and an unknown target table is skipped (S9)."""
        tasks = []
        for s in specs:
            km: dict[str, str] = {}
            for c in s.get("columns", []):
                if _enum_value(c.get("dtype")) == FOREIGN_KEY and c.get("link_to"):
                    km[c["name"]] = c["link_to"]
            tt = s.get("target_table")
            if tt:
                pk_col = next((c["name"] for c in s.get("columns", []) if _enum_value(c.get("dtype")) == KEY), None)
                if pk_col and pk_col not in km and tt in rdb.metas and rdb.metas[tt].primary_key:
                    km[pk_col] = f"{tt}.{rdb.metas[tt].primary_key}"
            md = TaskMetadata(km, s["target_col"], s.get("time_col"), _enum_value(s.get("task_type")),
                              _enum_value(s.get("evaluation_metric")))
            sp = s["splits"]
            tasks.append(Task(s["name"], sp["train"], sp["test"], md, sp.get("val")))
        return cls(rdb, tasks)


# ---- K3 / F5 ------------------------------------------------------------------------------------------
def normalize_keys(rdb: RelationalDataset, tasks: Iterable[Task] = (), task_key_columns: Sequence[str] = ()
                   ) -> tuple[RelationalDataset, list[Task]]:
    """K3: every primary/foreign key column of every table (and the named task columns, in
    every split, val guarded [DIV Q9]) in canonical string form (K2: ``1.0`` -> ``"1"``,
    NaN -> null)."""
    for t in list(rdb.tables):
        keys = rdb.key_columns(t) | {c for c, r in rdb.metas[t].roles.items() if r in (KEY, FOREIGN_KEY)}
        df = rdb.tables[t]
        cols = [key_to_string(F.col(f.name), f.dataType).alias(f.name) if f.name in keys else F.col(f.name)
                for f in df.schema.fields]
        rdb = rdb.with_table(t, df.select(*cols))
    out = []
    for task in tasks:
        def fix(df):
            if df is None:
                return None
            return df.select(*[key_to_string(F.col(f.name), f.dataType).alias(f.name) if f.name in task_key_columns
                               else F.col(f.name) for f in df.schema.fields])
        out.append(Task(task.name, fix(task.train_df), fix(task.test_df), task.metadata, fix(task.val_df)))
    return rdb, out


def shift_task_time(task: Task, seconds: int = 1) -> Task:
    """move the task's time column by ``seconds`` in every split (val guarded)."""
    tc = task.metadata.time_col
    if tc is None:
        return task

    def fix(df):
        if df is None or tc not in df.columns:
            return df
        return df.withColumn(tc, shift_time(F.col(tc), seconds))
    return Task(task.name, fix(task.train_df), fix(task.test_df), task.metadata, fix(task.val_df))
