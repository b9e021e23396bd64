"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it best.

Documents are cut into whole windows and a rest.  A task pools the rests of about pool_tokens ids and packs
the pool: the longest rest opens a window, a subset-sum over bitsets (one bit per reachable length, counts
split binarily) finds the reachable filling closest to the capacity, backtracking gives its counts, and the
pattern is used as often as the counts allow.  A task never holds more than one pool; no row is shuffled.

Nulls and ties: a null text is an empty document, that is its end id alone; equal lengths are taken in the
order of their rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import common
from llm.tokens import worker_tokenizer

WINDOW = 2048
POOL_TOKENS = 4 << 20

SCHEMA = "sequence_id long, ids binary, pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to capacity from below: length -> count."""
    reach, steps, mask = 1, [], (1 << capacity + 1) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns that use up the counts of lengths from 1 to capacity: (times, length -> count)."""
    left, patterns = {x: n for x, n in counts.items() if n}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = best_filling({x: n for x, n in rest.items() if n}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        patterns.append((times, chosen))
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return patterns


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Sequences of at most `window` ids: sequence_id, ids (little-endian unsigned 32 bits), pieces in order."""

    def run(batches):
        encoder, part, made = worker_tokenizer(tokenizer), TaskContext.get().partitionId(), 0

        def rows(sequences):
            nonlocal made
            for k in range(0, len(sequences), 256):
                some = sequences[k : k + 256]
                pieces = [[dict(zip(("doc_id", "start", "length", "doc_tokens", "offset"), (*p[:4], at))) for p, at in zip(s, np.cumsum([0, *(p[2] for p in s)]).tolist())] for s in some]
                ids = [b"".join(p[4].tobytes() for p in s) for s in some]
                numbers = [(part << 33) + made + i for i in range(len(some))]
                made += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.binary()), pa.array(pieces, _PIECES)], ["sequence_id", "ids", "pieces"])

        def packed(pool):
            for times, chosen in plan({x: len(v) for x, v in pool.items()}, window):
                for _ in range(times):
                    yield [pool[x].pop() for x in sorted(chosen, reverse=True) for _ in range(chosen[x])]

        pool, held = defaultdict(list), 0
        for batch in common.slices(batches, "text", 5 << 20):
            ids, offsets = encoder.encode(batch.column("text"), end_id)
            whole = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                for start in range(0, b - a, window):
                    piece = (doc_id, start, min(window, b - a - start), b - a, ids[a + start : min(a + start + window, b)])
                    if piece[2] == window:
                        whole.append([piece])
                    else:
                        pool[piece[2]].append(piece)
                        held += piece[2]
            yield from rows(whole)
            if held >= pool_tokens:
                for pieces in pool.values():
                    pieces.reverse()
                yield from rows(list(packed(pool)))
                pool, held = defaultdict(list), 0
        for pieces in pool.values():
            pieces.reverse()
        yield from rows(list(packed(pool)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


_PIECES = pa.list_(pa.struct([(name, pa.int64()) for name in ("doc_id", "start", "length", "doc_tokens", "offset")]))


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece, its checksum taken from the packed ids."""
    digest = F.transform("pieces", lambda p: F.struct(*(p[x].alias(x) for x in ("doc_id", "start", "length")),
        F.crc32(F.substring("ids", (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), p["offset"].alias("offset")))
    piece = sequences.select("sequence_id", F.explode(digest).alias("p"))
    return piece.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1))
