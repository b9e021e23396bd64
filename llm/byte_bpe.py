"""Byte-level BPE over rank files: overlapping chunks, stitched where pre-token boundaries resynchronise.

A text longer than `chunk` code points is cut into chunks that overlap.  Each chunk is pre-tokenised by itself,
from its own beginning.  Matching depends only on what follows, so once two scans share a boundary they agree
from there on: the first boundary that a chunk's scan shares with its successor's inside their overlap is the
seam.  The pieces between seams are encoded in parallel, and a text's ids are its pieces' ids in order.  A piece
is scanned with what follows it, up to the end of the chunk that found its seam, and its own matches are kept.
A text with a seam that finds no shared boundary (a pre-token longer than the overlap) is encoded whole.
Decoding concatenates the bytes of the ids.

Nulls and ties: a null text is empty and has no ids; rows that repeat are encoded as they stand.
"""

from __future__ import annotations

import base64
from itertools import chain, repeat, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import common

CHUNK, OVERLAP = 32768, 1024
CACHE_PIECES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceIds(dict):
    """Ids of a pre-token, encoded on first sight; emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        super().__init__()
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = self[piece] = tuple(self._encode(piece))
        return ids


def boundaries(pattern, text: str) -> list[int]:
    """Where the matches of a scan from the text's beginning start."""
    return [m.start() for m in pattern.finditer(text)]


def _encoder(ranks_path: str, pattern: str, keep: tuple[str, ...], part: bool = False):
    """mapInArrow function: columns `keep` and the ids of column text, with part of its matches that start before column own."""

    def run(batches):
        import regex

        compiled, ids_of = regex.compile(pattern), PieceIds(read_ranks(ranks_path), pattern).__getitem__

        def find(text, own):
            return (m.group() for m in takewhile(lambda m: m.start() < own, compiled.finditer(text))) if part else compiled.findall(text)

        for batch in common.slices(batches, "text"):
            owns = batch.column("own").to_pylist() if part else repeat(None)
            found = [np.fromiter(chain.from_iterable(map(ids_of, find(text, own))), np.int32) if text else np.zeros(0, np.int32) for text, own in zip(batch.column("text").to_pylist(), owns)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), lists], [*keep, "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (array<int>) of every row's text."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~long).mapInArrow(_encoder(ranks_path, pattern, ("doc_id",)), "doc_id long, ids array<int>")

    kept = common.staged(common.with_row(rows.where(long), "row"), "long")
    starts = F.sequence(F.lit(0), (F.length("text") - 1), F.lit(chunk))
    chunks = kept.select("row", F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("text", s + 1, F.lit(chunk + overlap)).alias("text")))).alias("chunk", "c"))
    chunks = chunks.select("row", "chunk", F.col("c.start").cast("long").alias("start"), "c.text").repartition("row", "chunk")

    def scan(batches):
        import regex

        compiled = regex.compile(pattern)
        for batch in common.slices(batches, "text"):
            first, last = [], []
            for text, start in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist()):
                found = boundaries(compiled, text)
                first.append([start + x for x in found if x < overlap])
                last.append([start + x for x in found if x >= chunk])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk").cast(pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(last, pa.list_(pa.int64()))], ["row", "chunk", "first", "last"])

    scans = common.staged(chunks.mapInArrow(scan, "row long, chunk long, first array<long>, last array<long>"), "scans")
    before = scans.select("row", (F.col("chunk") + 1).alias("chunk"), F.col("last").alias("before"))
    seams = scans.where("chunk > 0").join(before, ["row", "chunk"]).select("row", "chunk", F.array_min(F.array_intersect("before", "first")).alias("seam"))
    seams = common.staged(seams, "seams")
    # seams of one text are few: its length over the chunk length
    cuts = seams.groupBy("row").agg(F.array_sort(F.collect_list("seam")).alias("seams"), F.count_if(F.col("seam").isNull()).alias("open"))
    cuts = kept.join(cuts, "row").select("row", "text", F.when(F.col("open") == 0, F.col("seams")).otherwise(F.array().cast("array<bigint>")).alias("seams"))
    ends = F.concat(F.array(F.lit(0).cast("long")), "seams", F.array(F.length("text").cast("long")))
    # piece i begins in chunk i, or is the whole text
    end_of = lambda i: F.when(F.size(ends) == 2, F.length("text")).otherwise((i + 1) * chunk + overlap)
    bounds = F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    pieces = F.transform(bounds, lambda p, i: F.struct((p["b"] - p["a"]).alias("own"), F.substring("text", p["a"] + 1, end_of(i) - p["a"]).alias("text")))
    pieces = cuts.select("row", F.posexplode(pieces).alias("piece", "p")).select("row", F.col("piece").cast("long"), "p.own", "p.text").repartition("row", "piece")
    encoded = pieces.mapInArrow(_encoder(ranks_path, pattern, ("row", "piece"), part=True), "row long, piece long, ids array<int>")
    joined = encoded.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(kept.select("row", "doc_id").join(joined, "row").select("doc_id", "ids"))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for."""

    def run(batches):
        token_of = {rank: token for token, rank in read_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                ids = some.column("ids")
                raw = [b"".join(map(token_of, x.values.to_numpy().tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), ids, pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def op8_overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN), ranks)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
