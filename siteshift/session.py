"""Session settings this workload depends on, and the shared folder for written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings, applied to whatever session the caller has.
TUNING = {
    # Wide CASE projections compile to methods beyond the JVM's 8000-byte JIT limit and would then
    # run interpreted. At this limit Spark generates split-up projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A distinct that reuses its join's partitions must not keep a hot key's partition from being split: the
    # split then pays an exchange of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins hash instead of sorting where every partition of the build side was measured to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}

# A wide row takes some ten times its shuffle bytes in the two hash maps of a distinct, and twenty times its stored
# bytes in the sorter of a shuffle's writer. Tasks of default size spill there, several times what they shuffle.
WIDE_ROWS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "800",
    "spark.sql.files.maxPartitionBytes": "16m",
}


def tune(spark: SparkSession, wide_rows: bool = True) -> SparkSession:
    """Settings for the master-data plans; ``wide_rows=False`` leaves the sizes of tasks as they are by default."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    for key, value in WIDE_ROWS.items():
        if wide_rows:
            spark.conf.set(key, value)
        elif spark.conf.get(key, None) == value:
            spark.conf.unset(key)
    # Python workers find this package where it lies
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark


def _dropped(folder: str) -> None:
    from pyarrow import fs

    try:
        system, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        system.delete_dir(path)
    except OSError:  # gone already
        pass


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder; what lies there goes when this process ends."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_dropped, folder)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A cluster without one is refused. A local run without one gets a folder of its own below the
    warehouse, which goes when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        configured = f"{warehouse.rstrip('/')}/siteshift-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", configured)
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    return configured.rstrip("/")
