"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

An old shard is a sequence of blocks of rows.  Sizes by block are all that is collected: shards x BLOCKS numbers.
Sources are the old shards with their bytes, sinks the new shards with their capacities; bytes that stay cost
nothing, bytes that move cost one each.  Flow is augmented along shortest paths until all bytes are placed, and
each flow is made of whole blocks from the end of the old shard's sequence.  Then only the files that lose or
gain blocks are rewritten; the others are taken over as they are.

Law: `bytes`, shards of nearly equal size (within a block and the largest row).

Nulls and ties: a null text has size 1, as has an empty one; null doc_ids come first; rows that repeat lie in the
same block in any order of themselves; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import common

SHARDS, BLOCKS = 16, 1024
#: Files of the old layout, in shares of the whole.
FILES = 256


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost) -> dict[tuple[int, int], int]:
    """Flow (old, new) -> bytes that places all supply within the capacities at the least cost(old, new) a byte.

    Successive shortest augmenting paths with potentials over the graph of shards.
    """
    old, new = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    room, potential = dict(capacity), defaultdict(float)
    for source in old:
        left = supply[source]
        while left:
            distance, before, queue = {("o", source): 0.0}, {}, [(0.0, ("o", source))]
            while queue:
                d, node = heapq.heappop(queue)
                if d > distance[node]:
                    continue
                side, at = node
                edges = [(("n", x), cost(at, x)) for x in new] if side == "o" else [(("o", x), -cost(x, at)) for x in old if flow[x, at]]
                for other, c in edges:
                    reduced = d + max(0.0, c + potential[node] - potential[other])
                    if reduced < distance.get(other, float("inf")) - 1e-12:
                        distance[other], before[other] = reduced, node
                        heapq.heappush(queue, (reduced, other))
            ends = [("n", x) for x in new if room[x] and ("n", x) in distance]
            if not ends:
                raise ValueError("the capacities are too small")
            end = min(ends, key=lambda x: (distance[x] + potential[x], x[1]))
            path = [end]
            while path[-1] in before:
                path.append(before[path[-1]])
            path.reverse()
            steps = list(zip(path, path[1:]))
            amount = min([left, room[end[1]], *(flow[b[1], a[1]] for a, b in steps if a[0] == "n")])
            for a, b in steps:
                if a[0] == "o":
                    flow[a[1], b[1]] += amount
                else:
                    flow[b[1], a[1]] -= amount
            for node, d in distance.items():
                potential[node] += min(d, distance[end])
            for node in [("o", x) for x in old] + [("n", x) for x in new]:
                if node not in distance:
                    potential[node] += distance[end]
            left -= amount
            room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def place_blocks(sizes: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block): the least bytes move, and shards become nearly equal."""
    total = sum(sizes.values())
    supply: dict[int, int] = defaultdict(int)
    for (old, _), size in sizes.items():
        supply[old] += size
    capacity = {s: total // shards + (s < total % shards) for s in range(shards)}
    flow = min_cost_flow(dict(supply), capacity, lambda a, b: int(a != b))
    by_old = defaultdict(list)
    for old, block in sorted(sizes):
        by_old[old].append(block)
    want = {s: dict(sorted((old, v) for (old, new), v in flow.items() if new == s)) for s in capacity}
    filled, target, placed = defaultdict(int), dict(capacity), {}
    for old, blocks in by_old.items():
        shares = [(old, want.get(old, {}).get(old, 0)), *((s, want[s][old]) for s in want if s != old and old in want[s])]
        shares = [(s, v) for s, v in shares if v]
        k, used = 0, 0
        for block in blocks:
            size = sizes[old, block]
            # a block that crosses the end of a share goes where most of it lies
            while k < len(shares) - 1 and used + size / 2 > shares[k][1]:
                used -= shares[k][1]
                k += 1
            placed[old, block] = shares[k][0]
            filled[shares[k][0]] += size
            used += size
    return _even(placed, sizes, filled, target)


def _even(placed: dict, sizes: dict, filled: dict, target: dict) -> dict:
    """Moves single blocks from the fullest to the emptiest shard while that brings the two closer."""
    held = defaultdict(list)
    for key, shard in placed.items():
        held[shard].append((sizes[key], key))
    for _ in range(4 * len(target)):
        full = max(target, key=lambda s: (filled[s] - target[s], -s))
        empty = min(target, key=lambda s: (filled[s] - target[s], s))
        gap = (filled[full] - target[full]) - (filled[empty] - target[empty])
        best = min(held[full], key=lambda x: (abs(gap - 2 * x[0]), x), default=None)
        if best is None or abs(gap - 2 * best[0]) >= gap:
            break
        held[full].remove(best)
        held[empty].append(best)
        filled[full] -= best[0]
        filled[empty] += best[0]
        placed[best[1]] = empty
    return placed


def write_old(docs: DataFrame, shard: Column, folder: str, blocks: int = BLOCKS) -> DataFrame:
    """docs written below folder as an old layout; columns added: old_shard, block, file_no, size.

    Blocks are dealt by a hash of the row, so that one shard with a third of all rows has even blocks too.
    """
    rows = docs.select("*", shard.cast("int").alias("old_shard"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), (common.utf8_size(F.col("text")) + 1).alias("size"))
    sums = {r["old_shard"]: r["bytes"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).toLocalIterator()}
    total, cases, first = sum(sums.values()), F.lit(0), 0
    for old in sorted(sums):  # files of a shard in proportion to its bytes
        files = max(1, round(FILES * sums[old] / total))
        cases = F.when(F.col("old_shard") == old, F.lit(first) + F.floor(F.col("block") * files / F.lit(blocks)).cast("int")).otherwise(cases)
        first += files
    rows = rows.withColumn("file_no", cases).repartitionByRange("file_no", "block")
    rows.write.option("compression", "zstd").partitionBy("old_shard", "file_no").parquet(folder)
    schema = docs.select("*", F.lit(0).alias("block"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("old_shard"), F.lit(0).alias("file_no")).schema
    return docs.sparkSession.read.schema(schema).parquet(folder)


def reshard(old: DataFrame, shards: int, folder: str) -> DataFrame:
    """Rows of the old layout with their new shard: affected files are rewritten below folder, others are kept."""
    spark = old.sparkSession
    table = {(r["old_shard"], r["block"]): (r["bytes"], r["file_no"]) for r in old.groupBy("old_shard", "block", "file_no").agg(F.sum("size").alias("bytes")).toLocalIterator()}
    placed = place_blocks({k: v[0] for k, v in table.items()}, shards)
    moves = [(a, b, s, table[a, b][1]) for (a, b), s in placed.items()]
    touched = sorted({f for a, _, s, f in moves if a != s})
    to = spark.createDataFrame([m[:3] for m in moves], "old_shard int, block int, shard int")
    kept = old.where(~F.col("file_no").isin(touched)).withColumn("shard", F.col("old_shard")) if touched else old.withColumn("shard", F.col("old_shard"))
    if not touched:
        return kept
    rewritten = old.where(F.col("file_no").isin(touched)).join(F.broadcast(to), ["old_shard", "block"])  # shards x blocks rows
    rewritten = rewritten.select(*old.columns, "shard")
    rewritten.repartitionByRange("shard", "block").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return kept.unionByName(spark.read.schema(rewritten.schema).parquet(folder))


def slots(rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """rows(doc_id, shard, ...) with slot, gapless from 0 in every shard, counted by (shard, block) cells."""
    cell = ["shard", "old_shard", "block"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("within", within).join(sizes, cell).withColumn("slot", F.col("base") + F.col("within"))


def op6_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    # the old layout keeps each source in one shard
    old = write_old(docs, F.pmod(F.xxhash64("source"), F.lit(SHARDS)), common.new_folder(spark, "old"))
    new = reshard(old, SHARDS, common.new_folder(spark, "new"))
    rows = new.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "old_shard", "block")
    found = slots(common.staged(rows, "placed"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
