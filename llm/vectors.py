"""Exact metric range join of vectors by the angle between them.

Pivots partition the vectors: each vector's home is the cell of its nearest pivot.  If two vectors lie within an
angle t, and u's home is cell i, then angle(v, p_i) <= angle(v, p_home(v)) + 2t and <= radius(i) + t, so v is
copied to the cells that meet both bounds and to no others, and every linked pair meets in the home cell of one of
them.  A pair of two cells is taken in the cell of the lesser number only.  Cells are joined independently, in
blocks of bounded size; a block yields counts of links and a forest of them, never its pairs.

Angles decide what is copied (with a margin); links are decided by the cosine in double precision alone.
Equal vectors are one class with a count, so a vector that repeats is compared once.

Nulls and ties: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing
and are components of their own; vectors of unequal length are compared as if zeros followed the shorter one;
an empty table gives no rows.  Rows that share a vec_id are vectors of their own with that number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import common

COSINE = 0.9
#: Vectors that pivots are chosen among, vectors of a cell aimed at, most pivots, vectors of a block, pairs compared at once.
#: Where angles tell cells apart badly, a vector is copied to half of the cells: large cells keep the copies few.
PIVOT_SAMPLE, CELL, MOST_PIVOTS, BLOCK, PAIRS = 4096, 16384, 256, 32768, 1 << 22
MARGIN = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample, each the farthest from those before it."""
    chosen, nearest = [0], angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and nearest.max() > MARGIN:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(sample, sample[chosen[-1] :][:1])[:, 0])
    return sample[chosen]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column, zeros after the shorter ones."""
    out = np.zeros((len(column), width))
    at = column.offsets.to_numpy()
    values = column.values.to_numpy().astype(float)
    sizes = np.diff(at)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(at[0], at[-1]) - np.repeat(at[:-1], sizes)] = values[at[0] : at[-1]]
    return out


def links_of_block(left: dict, right: dict | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of one block, or two, with the vectors linked to each across them and the least class of its piece.

    left and right have cls, times and unit vectors; without right the block is joined with itself.
    """
    a, b = left["unit"], (right or left)["unit"]
    cls = left["cls"] if right is None else np.concatenate([left["cls"], right["cls"]])
    times = left["times"] if right is None else np.concatenate([left["times"], right["times"]])
    shift = 0 if right is None else len(left["cls"])
    rough_a, rough_b = a.astype(np.float32), b.astype(np.float32)
    order = np.argsort(cls, kind="stable")
    label = np.empty_like(order)
    label[order] = np.arange(len(cls))
    linked = np.zeros(len(cls), np.int64)
    step = max(1, PAIRS // len(b))
    for k in range(0, len(a), step):  # a strip of rows at a time, so that near copies never lie here as pairs of the whole block
        low = k if right is None else 0
        i, j = np.nonzero(rough_a[k : k + step] @ rough_b[low:].T >= cosine - 1e-4)
        i, j = i + k, j + low
        if right is None:
            i, j = i[i < j], j[i < j]
        exact = np.concatenate([np.einsum("ij,ij->i", a[i[m : m + 65536]], b[j[m : m + 65536]]) >= cosine for m in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[exact], j[exact] + shift
        if not len(i):
            continue
        linked += (np.bincount(i, times[j], len(cls)) + np.bincount(j, times[i], len(cls))).astype(np.int64)
        while True:  # the least rank spreads along links and shortcuts; what earlier strips joined shares a root
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            np.minimum.at(new, order[label[i]], least)
            np.minimum.at(new, order[label[j]], least)
            new = new[order[new]]
            if (new == label).all():
                break
            label = new
    some = linked > 0
    return cls[some], linked[some], cls[order[label[some]]]


def range_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    theta = float(np.arccos(cosine)) + MARGIN
    e = F.col("embedding")
    # single precision stays as it is until it is compared: half of the bytes to copy
    element = "float" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "double"
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(~odd, e.cast(f"array<{element}>")).alias("embedding"))
    rows = common.staged(rows.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding"))), "vectors")
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = common.staged(common.with_row(classes, "cls"), "classes")
    known = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width = known["width"] or 1
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(PIVOT_SAMPLE).toArrow().combine_chunks().column("embedding")
    points = unit(_matrix(sample.combine_chunks() if isinstance(sample, pa.ChunkedArray) else sample, width)) if len(sample) else np.eye(1, width)
    pivots = choose_pivots(points, int(np.clip(known["n"] // CELL, 1, MOST_PIVOTS)))
    schema = f"cls long, times long, embedding array<{element}>, home long, angle double, cells array<struct<cell:long,angle:double>>"

    def deal(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                away = angles(unit(_matrix(some.column("embedding"), width)), pivots)
                home = away.argmin(axis=1)
                own = away[np.arange(len(home)), home]
                near = (away <= own[:, None] + 2 * theta + MARGIN) & (np.arange(len(pivots)) < home[:, None])
                cells = [[{"cell": int(c), "angle": float(away[r, c])} for c in np.flatnonzero(near[r])] for r in range(len(home))]
                yield pa.RecordBatch.from_arrays([some.column("cls"), some.column("times"), some.column("embedding"), pa.array(home), pa.array(own), pa.array(cells, pa.list_(pa.struct([("cell", pa.int64()), ("angle", pa.float64())])))],
                    ["cls", "times", "embedding", "home", "angle", "cells"])

    dealt = common.staged(classes.select("cls", "times", "embedding").mapInArrow(deal, schema), "dealt")
    # one row per pivot, then few blocks per cell
    homes = {r["home"]: (r["n"], r["radius"]) for r in dealt.groupBy("home").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toLocalIterator()}
    radius = F.element_at(F.create_map(*(F.lit(x) for c in homes for x in (c, homes[c][1]))) if homes else F.create_map(F.lit(0), F.lit(0.0)), F.col("c.cell"))
    copies = dealt.select("cls", "times", "embedding", F.explode("cells").alias("c")).where(F.col("c.angle") <= radius + theta + MARGIN).select("cls", "times", "embedding", F.col("c.cell").alias("cell"))
    copied = {r["cell"]: r["n"] for r in copies.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator()}
    blocks = F.create_map(*(F.lit(x) for c in homes for x in (c, -(-homes[c][0] // BLOCK)))) if homes else F.create_map(F.lit(0), F.lit(1))
    copy_blocks = F.create_map(*(F.lit(x) for c in (homes or {0: 0}) for x in (c, -(-copied.get(c, 0) // BLOCK))))

    home = dealt.select("cls", "times", "embedding", F.col("home").alias("cell")).withColumn("of", F.element_at(blocks, F.col("cell"))).withColumn("own", F.pmod(F.hash("cls"), F.col("of")))
    inner = home.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    inner = inner.select("cell", F.lit(0).alias("kind"), F.least("own", "y").alias("x"), F.greatest("own", "y").alias("y"), (F.col("own") < F.col("y")).alias("left"), "cls", "times", "embedding")
    others = F.element_at(copy_blocks, F.col("cell"))
    outer_home = home.where(others > 0).withColumn("y", F.explode(F.sequence(F.lit(0), others - 1))).select("cell", F.lit(1).alias("kind"), F.col("own").alias("x"), "y", F.lit(True).alias("left"), "cls", "times", "embedding")
    outer_copy = copies.withColumn("y", F.pmod(F.hash("cls"), others)).withColumn("x", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("cell")) - 1)))
    outer_copy = outer_copy.select("cell", F.lit(1).alias("kind"), "x", "y", F.lit(False).alias("left"), "cls", "times", "embedding")
    keys = ["cell", "kind", "x", "y"]
    met = inner.unionByName(outer_home).unionByName(outer_copy).select(*(F.col(x).cast("long") for x in keys), "left", "cls", "times", "embedding")
    met = met.repartition(*keys).sortWithinPartitions(*keys)

    def join(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            columns = [batch.column(x).to_numpy() for x in keys]
            cuts = (np.flatnonzero(np.any([np.diff(x) != 0 for x in columns], axis=0)) + 1).tolist() if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                if held and part.num_rows and any(held[0].column(x)[0] != part.column(x)[0] for x in keys):
                    yield from joined(held)
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from joined(held)

    def joined(held):
        cls, times = (np.concatenate([h.column(x).to_numpy() for h in held]) for x in ("cls", "times"))
        left = np.concatenate([h.column("left").to_numpy(zero_copy_only=False) for h in held])
        vector = unit(np.concatenate([_matrix(h.column("embedding"), width) for h in held]))
        kind, x, y = (held[0].column(c)[0].as_py() for c in ("kind", "x", "y"))
        side = lambda mask: {"cls": cls[mask], "times": times[mask], "unit": vector[mask]}
        if kind == 0 and x == y:
            found = links_of_block(side(np.ones(len(cls), bool)), None, cosine)
        elif left.all() or not left.any():
            return
        else:
            found = links_of_block(side(left), side(~left), cosine)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["cls", "linked", "least"])

    links = common.staged(met.mapInArrow(join, "cls long, linked long, least long"), "links")
    counts = links.groupBy("cls").agg(F.sum("linked").alias("linked"))
    group = common.components(spark, links.select(F.col("cls").alias("a"), F.col("least").alias("b")), "grp").withColumnRenamed("node", "cls")
    named = classes.join(counts, "cls", "left").join(group, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    named = common.staged(named.select("embedding", "grp", "least", (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "groups")
    least = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    named = common.staged(named.join(least, "grp").select("embedding", "n_links", "component_id"), "named")
    found = rows.where("embedding is not null").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
