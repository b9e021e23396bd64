"""Token ids as binary files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

A file holds the documents of one ascending range of doc_id.  Ids are replaced by their rank among the ids
of the file, the most frequent first, so most codes take one byte.  Four ranks share a control byte with two
bits each (bytes of the code less one); control bytes and data bytes lie apart.  The decoder looks up code
lengths, offsets and masks by control byte in numpy tables and never loops over ids.

Layout, little-endian: magic, documents (u64), ids (u64), distinct ids (u32), distinct ids by rank (u32 each),
doc_id (i64 each), doc_id present (u8 each), ids of each document (u32 each), control bytes, data bytes.

Nulls and ties: a null text is an empty document, a null doc_id comes first and is read back as null, rows
that share a doc_id are ordered by a hash of their text; an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import common
from llm.tokens import worker_tokenizer

MAGIC = b"RVB1"
_HEAD = struct.Struct("<4sQQI")

_CODE = np.arange(256, dtype=np.int64)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: By control byte: code lengths, their running offsets, their sum, and masks of a four-byte read.
LENGTHS = _CODE + 1
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[_CODE]


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    width = int(code.max()) + 1 if len(code) else 1
    quads = ranks.view(np.uint8).reshape(-1, 4)[:, :width]
    return control.astype(np.uint8).tobytes(), quads[np.arange(width) <= code[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of control and data bytes (uint8), by table lookup."""
    totals = TOTALS[control]
    if n % 4:  # the last control byte also describes codes that are not there
        totals[-1] = OFFSETS[control[-1], n % 4]
    at = ((np.cumsum(totals) - totals)[:, None] + OFFSETS[control]).ravel()[:n]
    masks = MASKS[control].ravel()[:n]
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    ranks = data[at].astype(np.uint32)
    for byte in range(1, (int(masks.max()).bit_length() if n else 0) // 8):
        ranks |= data[at + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks & masks


def file_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    coded = pa.array(ids, pa.uint32()).dictionary_encode()  # hashed, not sorted
    distinct, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.lexsort((distinct, -np.bincount(codes, minlength=len(distinct))))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    control, data = pack_ranks(rank[codes])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(distinct)), distinct[order].astype("<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(), control, data,
    ])


def read_bytes(blob) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document and all ids of a file."""
    magic, docs, n, distinct = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a file of ranked ids")
    at = _HEAD.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(blob, dtype, count, at)
        at += found.nbytes
        return found

    by_rank, doc_ids, known, sizes = take("<u4", distinct), take("<i8", docs), take("u1", docs), take("<u4", docs)
    control = take("u1", -(-n // 4))
    data = take("u1", len(blob) - at)
    ids = by_rank[unpack_ranks(control, data, n)] if n else np.zeros(0, np.uint32)
    return [int(x) if k else None for x, k in zip(doc_ids, known)], sizes, ids


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int | None, folder: str, ids_a_file: int = 4 << 20) -> DataFrame:
    """Writes the files in ascending doc_id order below folder; returns their manifest, a written table.

    Columns: part and file_no (files in that order ascend), file, docs, ids.  A task holds the ids of one file.
    """

    def write(batches):
        encoder, part, number = worker_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids = [], [], []

        def flush():
            nonlocal number
            name = f"ids-{part:06d}-{number:06d}-{uuid.uuid4().hex}.rvb"
            common.write_file(folder, name, file_bytes(doc_ids, np.concatenate(sizes), np.concatenate(ids)))
            row = {"part": [part], "file_no": [number], "file": [name], "docs": [len(doc_ids)], "ids": [sum(map(len, ids))]}
            number += 1
            for held in (doc_ids, sizes, ids):
                held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in common.slices(batches, "text", 5 << 20):
            found, offsets = encoder.encode(batch.column("text"), end_id)
            doc_ids += batch.column("doc_id").to_pylist()
            sizes.append(np.diff(offsets))
            ids.append(found)
            if sum(map(len, ids)) >= ids_a_file:
                yield flush()
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    schema = "part long, file_no long, file string, docs long, ids long"
    return common.staged(ordered.mapInArrow(write, schema), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), ids (array<int>), in no order."""

    def read(batches):
        system, path = common.filesystem(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_file(f"{path}/{file}") as source:
                    doc_ids, sizes, ids = read_bytes(source.read())
                ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                step = 512
                for k in range(0, len(doc_ids), step):
                    bounds = ends[k : k + step + 1]
                    lists = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(ids[bounds[0] : bounds[-1]].view(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[k : k + step], pa.int64()), pa.array(bounds[:-1] + base), lists], ["doc_id", "start", "ids"])

    # one row per file, so this window sees a short table
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    files = max(1, manifest.count())
    return based.repartition(min(files, 100_000)).mapInArrow(read, "doc_id long, start long, ids array<int>")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.new_folder(spark, "ids")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    found = read_token_files(manifest, folder)

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            crc = [common.unsigned_crc(values[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:])]
            columns = [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
