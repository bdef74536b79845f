"""Session helpers: one place for the settings every job in this package relies on."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the library's plans assume.  AQE re-plans joins at runtime (skewed
# partitions are split, small sides become broadcasts); UTC keeps epoch and
# date-part features identical on every executor.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "relfeat") -> SparkSession:
    """A local session for tests and the bench (cluster jobs pass their own session)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    b = b.config("spark.driver.memory", "16g").config(BY_ALL, "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; set a scratch one only when it is unset and
    the master is local (tests).  On a cluster a machine-local folder would lose files: raise."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="relfeat-ckpt-", dir=os.environ.get("RELFEAT_SCRATCH", "/tmp"))
        spark.sparkContext.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


# Shuffled rows are narrow and alike, so 64 MB of them (AQE's own size), compressed, took over 1 GB
# as the rows of one task.
ADVISORY, ADVISORY_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16 << 20
# Whether a join on several columns deals its sides out by all of them, as Spark does by itself.  If not,
# a join on a key and a cutoff leaves rows where they lie that were dealt out by the key alone.
BY_ALL = "spark.sql.requireAllClusterKeysForCoPartition"


def size_in_bytes(text: str) -> int:
    """Bytes of a size as Spark writes it: a number and, for larger units, a letter."""
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def apply_session_defaults(spark: SparkSession, by_key: bool = True) -> None:
    """Set the runtime-modifiable defaults on an existing session (UTC, AQE): the size up to which
    AQE merges a shuffle's partitions is lowered, never raised.  ``by_key``: joins may use rows as they
    were dealt out by some of the join's columns (synthesis takes hot keys out of its plans)."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled", "spark.sql.execution.arrow.pyspark.enabled"):
        spark.conf.set(k, DEFAULT_CONF[k])
    spark.conf.set(BY_ALL, str(not by_key).lower())
    if size_in_bytes(spark.conf.get(ADVISORY)) > ADVISORY_BYTES:
        spark.conf.set(ADVISORY, str(ADVISORY_BYTES))


def free_finished(spark: SparkSession) -> None:
    """Let the driver collect its garbage: only then does Spark delete the shuffle files, and checkpoints,
    of frames that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Make ``relfeat`` importable on every executor's Python workers (``addPyFile`` of a zip
    of the package), once per SparkContext.  Needed by the Arrow scoring path."""
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_relfeat_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="relfeat-pyfile-", dir=os.environ.get("RELFEAT_SCRATCH", "/tmp"))
    path = os.path.join(out, "relfeat.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    sc._relfeat_shipped = True
