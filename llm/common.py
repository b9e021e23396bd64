"""Helpers shared by the operators: shared folders, staged tables, whole-batch text access, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.session import shared_folder


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder of the cluster."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


#: Environment of Python workers: they find this package where it lies, and give memory back that they no longer use.
WORKER_ENVIRONMENT = {
    "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_TRIM_THRESHOLD_": "131072",
    "TOKENIZERS_PARALLELISM": "false",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    for name, value in WORKER_ENVIRONMENT.items():
        spark.sparkContext.environment.setdefault(name, value)
    return spark


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read back: the lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    folder = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def with_row(df: DataFrame, name: str) -> DataFrame:
    """df with a unique number per row; stage the result before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df bears it; cases of letters do not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of a slice holds about most_bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(column)
        sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
        part = (np.cumsum(sizes) // most_bytes).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def filesystem(folder: str):
    """Arrow's file system and path of a shared folder's URI (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Writes one file whole.  Names are new for each attempt, so a repeated task disturbs nothing."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)


def unsigned_crc(values) -> int:
    import zlib

    return zlib.crc32(values) & 0xFFFFFFFF


def components(spark: SparkSession, edges: DataFrame, name: str = "component") -> DataFrame:
    """Connected components of edges(a, b), longs: one row (node, <name>) per node, named by its smallest node.

    Each round hooks every component to the smallest one it touches, flattens the hooks by pointer jumping
    and contracts the edges; at least half of the components that still touch another one vanish in a round.
    Every intermediate is a written table; no row goes to the driver but counts.  Empty edges give no rows.
    """
    link = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    link = staged(link.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not link.isEmpty():
        both = link.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            link.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        hooks = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up"))
        hooks = staged(hooks, "hooks")
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = staged(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jump")
            hooks = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("root"))
        else:
            root = hooks.select(F.col("node").alias("root"), F.col("up").alias("new"))
            labels = staged(labels.join(root, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        ups = [hooks.select(F.col("node").alias(side), F.col("up").alias(f"up_{side}")) for side in "ab"]
        link = link.join(ups[0], "a").join(ups[1], "b").where("up_a <> up_b")
        link = staged(link.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
    if labels is None:
        return link.select(F.col("a").alias("node"), F.col("b").alias(name))
    return labels.select("node", F.col("root").alias(name))


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
