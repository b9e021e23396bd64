"""Language identification by prediction by partial matching.

For each language a context tree of bytes up to order 3 is counted over a bounded sample of labelled rows and
then frozen.  A byte seen in its context costs -log2(n / (N + D)) bits, where n is its count, N the context's
count and D its distinct followers; an unseen byte costs the escape -log2(D / (N + D)) and is coded in the next
shorter context, below order 0 with 8 bits.  A text's language is the one with the shortest code.  All costs
are tables over the byte n-grams of the sample, so a batch of texts is scored by lookups.

Nulls and ties: a null text and a text without a letter are `und` with score 0; equal code lengths go to the
first language by name; a null doc_id is not held out but never trains; without a labelled row all are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import common

#: Labelled rows of each language that the trees are counted on, those with the smallest hash of their doc_id.
SAMPLE_DOCS = 300
ORDER = 3
UNDETERMINED = "und"

RESULT = "lang_pred string, score double, bits_per_byte double"


def grams(texts: pa.Array, most: int = ORDER + 1) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte with the ORDER bytes before it, big-endian, and where each text begins.

    Before its first byte a text has line feeds.
    """
    blob = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(blob.buffers()[1], np.int64, len(blob) + 1, blob.offset * 8)
    data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    code = data.astype(np.uint32)
    for back in range(1, most):
        earlier = np.full(len(data), 10, np.uint32)
        earlier[back:] = data[:-back] if back < len(data) else 10
        for k in range(back):  # the first bytes of a text look back before its beginning
            first = at[:-1][at[1:] - at[:-1] > k] + k
            earlier[first] = 10
        code |= earlier << np.uint32(8 * back)
    return code, at


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang and text of at most sample_docs labelled rows of each language, rows that repeat taken once.

    They are chosen by ids and hashes alone; the choice, sample_docs rows a language, is what is broadcast.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("lang"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")) & F.col("id").isNotNull())
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "tie"))
    chosen = rows.select("lang", "id", "tie").withColumn("place", place).where(F.col("place") <= sample_docs).drop("place").distinct()
    return rows.join(F.broadcast(chosen), ["lang", "id", "tie"]).dropDuplicates(["lang", "id", "tie"]).select("lang", "text")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def count_grams(table: pa.Table) -> pa.Table:
    """The 4-grams of one language's sample with their counts."""
    codes = [grams(chunk)[0] for chunk in table.column("text").chunks]
    distinct, count = np.unique(np.concatenate(codes), return_counts=True)
    lang = pa.array([table.column("lang")[0].as_py()] * len(distinct), pa.string())
    return pa.table({"lang": lang, "gram": pa.array(distinct.astype(np.int64)), "n": pa.array(count)})


class Model:
    """Frozen code lengths of every language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: by language its distinct 4-grams (ascending) and their counts."""
        self.languages = sorted(counts)
        by_order = [{} for _ in range(ORDER + 1)]
        for lang, (codes, n) in counts.items():
            for order in range(ORDER, -1, -1):
                by_order[order][lang] = self._shorten(codes, n, order)
        self.order0 = self._order0(by_order[0])
        self.known = [None] * (ORDER + 1)
        self.cost = [None] * (ORDER + 1)
        self.escape = [None] * (ORDER + 1)  # of the contexts of `order` bytes
        self.context = [None] * (ORDER + 1)
        for order in range(1, ORDER + 1):
            self._build(order, by_order[order])

    @staticmethod
    def _shorten(codes: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        short = codes.astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1)
        distinct, inverse = np.unique(short, return_inverse=True)
        return distinct.astype(np.uint32), np.bincount(inverse, weights=n)

    def _order0(self, counts: dict) -> np.ndarray:
        cost = np.empty((256, len(self.languages)))
        for k, lang in enumerate(self.languages):
            codes, n = counts[lang]
            total = n.sum() + len(codes)
            cost[:, k] = 8 - np.log2(len(codes) / total)
            cost[codes, k] = -np.log2(n / total)
        return cost

    def _build(self, order: int, counts: dict) -> None:
        self.known[order] = known = np.unique(np.concatenate([counts[x][0] for x in self.languages]))
        self.context[order] = context = np.unique(known >> np.uint32(8))
        self.escape[order] = escape = np.zeros((len(context), len(self.languages)))
        for k, lang in enumerate(self.languages):
            codes, n = counts[lang]
            own = np.searchsorted(context, codes >> np.uint32(8))
            total, distinct = np.bincount(own, weights=n, minlength=len(context)), np.bincount(own, minlength=len(context))
            seen = distinct > 0
            escape[seen, k] = -np.log2(distinct[seen] / (total + distinct)[seen])
        self.cost[order] = cost = escape[np.searchsorted(context, known >> np.uint32(8))] + self.costs(known, order - 1)
        for k, lang in enumerate(self.languages):
            codes, n = counts[lang]
            own = np.searchsorted(context, codes >> np.uint32(8))
            total, distinct = np.bincount(own, weights=n, minlength=len(context)), np.bincount(own, minlength=len(context))
            cost[np.searchsorted(known, codes), k] = -np.log2(n / (total + distinct)[own])

    def costs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each code after the `order` bytes before it: one column per language."""
        codes = codes & np.uint32((1 << 8 * (order + 1)) - 1)
        if order == 0:
            return self.order0[codes]
        known = self.known[order]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        found = self.cost[order][at]
        missed = np.flatnonzero(known[at] != codes)
        if len(missed):
            rest, context = codes[missed], self.context[order]
            shorter = self.costs(rest, order - 1)
            near = np.minimum(np.searchsorted(context, rest >> np.uint32(8)), len(context) - 1)
            there = context[near] == rest >> np.uint32(8)
            shorter[there] += self.escape[order][near[there]]
            found[missed] = shorter
        return found

    def predict(self, texts: pa.Array, most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share among all codes, its bits per byte; an empty text gets the first language."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        bits = np.zeros((len(texts), len(self.languages)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            full = np.flatnonzero(sizes[a:b])
            if len(full):
                code, at = grams(texts.slice(a, b - a))
                bits[a + full] = np.add.reduceat(self.costs(code), at[:-1][full], axis=0)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        return best, share, least / np.maximum(sizes, 1)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Counts the sample by language and freezes the trees; the counts are bounded by the sample."""
    counted = training_sample(docs, sample_docs).groupBy("lang").applyInArrow(count_grams, "lang string, gram long, n long")
    table = counted.toArrow().combine_chunks()
    counts = {}
    for lang in pc.unique(table.column("lang")).to_pylist():
        own = table.filter(pc.equal(table.column("lang"), lang)).sort_by("gram")
        counts[lang] = own.column("gram").to_numpy().astype(np.uint32), own.column("n").to_numpy().astype(float)
    return Model(counts) if counts else None


def identify(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """Struct column lang_pred, score (0 to 1), bits_per_byte of a text column."""
    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    if model is None:
        return nothing
    frozen = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(frozen.value.languages)
        for texts in batches:
            best, share, bits = frozen.value.predict(texts)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(share), pa.array(bits)], ["lang_pred", "score", "bits_per_byte"])

    return F.when(text.rlike("\\p{L}"), score(text)).otherwise(nothing)


def keep_identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows of docs, in their columns, whose text some language explains.

    Rejected are texts that are null, have no letter, or cost 8 bits a byte or more under every language's
    tree, which is what bytes cost without any tree.  A null lang gets the predicted language.
    """
    name = common.unused(docs, "__identified")
    found = docs.withColumn(name, identify(docs.sparkSession, train(docs, sample_docs), F.col("text")))
    kept = found.where((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.bits_per_byte") < 8))
    return kept.withColumn("lang", F.coalesce("lang", f"{name}.lang_pred")).drop(name)


def op10_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(spark, train(docs), F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.bits_per_byte")
