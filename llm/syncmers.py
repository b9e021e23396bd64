"""Document fingerprints from closed syncmers of words, in DataFrame operations only.

A text's words are hashed; an s-mer is S adjacent words, a k-mer K adjacent words.  A k-mer is an anchor when the
least of its s-mer hashes is its first or its last: whether it is one depends on its own words only, so equal
passages give equal anchors wherever they stand.  The fingerprint lists the anchors' hashes in text order.

Nulls and ties: a null text is empty, its fingerprint the empty string; a text with fewer than K words has one
anchor, the hash of all its words, one without words but not empty the hash of the text, and one none of whose
k-mers is closed (2 * K - S - 2 words at most) its least k-mer hash; equal s-mer hashes all count as the least.
Only empty texts have empty fingerprints: two are alike (1), one and another fingerprint are not (0).  The next
document in descending doc_id: null doc_ids come last, rows that share a doc_id are ordered by a hash of their
text; the last is followed by the first, a single row by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, S = 8, 2

#: Quantiles of doc_id that bound the cells in which successors are found, rows of a cell aimed at, most cells.
QUANTILES, CELL_ROWS, MOST_CELLS = 64, 20_000, 50_000


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of the hashes (int) of a text's closed syncmers, in text order."""
    words = F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_hashes(h):
        if s == 1:
            mers = h
        else:
            mers = h
            for _ in range(s - 1):  # join each with its right neighbour
                mers = F.zip_with(F.slice(mers, 1, F.greatest(F.size(mers) - 1, F.lit(0))), F.slice(h, F.size(h) - F.size(mers) + 2, F.greatest(F.size(mers) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        width = k - s + 1
        starts = F.sequence(F.lit(1), F.size(h) - (k - 1))

        def of_mers(m):
            closed = lambda i: F.least(F.element_at(m, i), F.element_at(m, i + (width - 1))) == F.array_min(F.slice(m, i, F.lit(width)))
            hashed = lambda i: F.hash(F.slice(h, i, F.lit(k)))
            least = lambda: F.array(F.array_min(F.transform(starts, hashed)))
            return _let(F.filter(starts, closed), lambda at: F.when(F.size(at) > 0, F.transform(at, hashed)).otherwise(least()))

        return _let(mers, of_mers)

    def whole(h):
        short = F.when(F.size(h) > 0, F.array(F.hash(h))).when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(h) >= k, of_hashes(h)).otherwise(short)

    return _let(hashes, whole)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: SQL has no local names, but a lambda over one element does."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(anchor: Column) -> Column:
    return F.array_join(F.transform(anchor, lambda h: F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints' distinct anchors."""
    left, right = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when(left + right == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (left + right))


def with_next(rows: DataFrame, columns: list[str], prepare=lambda df: df) -> DataFrame:
    """prepare(rows) with next_<column>: the columns of the row that follows in descending doc_id, round to the first.

    Rows are dealt into cells of adjacent doc_ids: bounds are quantiles, and between two of them cells lie evenly.
    The first row of a cell is also dealt, last, into the cell before it, so wide rows are shuffled once and
    successors are looked up within cells. There are at most MOST_CELLS cells besides the quantiles, and only
    their first rows' keys are broadcast. Cells are told by doubles and descending order by the inverted bits, so ids
    at either end of the range of longs lie right; null ids come last.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    known = rows.select(key.alias("k")).agg(F.count("*").alias("n"), F.percentile_approx("k", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q")).first()
    bounds = sorted(set(known["q"] or [0]))
    parts = max(1, min(known["n"] // CELL_ROWS, MOST_CELLS) // len(bounds))

    def cell(lo: int, hi: int) -> Column:
        """Number of the cell of a key between bounds lo and hi (positions), found by halving."""
        if hi - lo > 1:
            mid = (lo + hi) // 2
            return F.when(key >= bounds[mid], cell(mid, hi)).otherwise(cell(lo, mid))
        if hi < len(bounds):
            within = F.floor((key.cast("double") - float(bounds[lo])) / float(max(1, bounds[hi] - bounds[lo])) * parts)
            return F.lit(lo * (parts + 1)) + F.greatest(F.lit(0), F.least(within, F.lit(parts - 1)))
        return F.lit(lo * (parts + 1)).cast("long")

    dealt = rows.withColumn("cell", cell(0, len(bounds)).cast("long")).withColumn("tie", F.xxhash64("text"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.bitwise_not("doc_id").alias("down"), F.col("tie").alias("tie"))
    heads = dealt.groupBy("cell").agg(F.min(place).alias("head"))
    down = Window.orderBy(F.desc("cell"))  # one row per cell
    heads = heads.select("cell", "head", F.coalesce(F.lag("cell").over(down), F.min("cell").over(Window.partitionBy())).alias("before"))
    copies = dealt.join(F.broadcast(heads), "cell").where(place.eqNullSafe(F.col("head"))).dropDuplicates(["cell"])
    copies = copies.withColumn("cell", F.col("before")).select(*dealt.columns)
    both = prepare(dealt).withColumn("copy", F.lit(False)).unionByName(prepare(copies).withColumn("copy", F.lit(True)))
    order = Window.partitionBy("cell").orderBy("copy", F.desc_nulls_last("doc_id"), "tie")
    both = both.withColumn("following", F.lead(F.struct(*columns)).over(order)).where(~F.col("copy"))
    kept = [c for c in both.columns if c not in ("cell", "tie", "copy", "following")]
    return both.select(*kept, *(F.col(f"following.{c}").alias(f"next_{c}") for c in columns))


def op9_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, ["text", "anchors"], lambda df: df.withColumn("anchors", anchors(F.col("text"))))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 2).cast("int")))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", "next_anchors").withColumn("edited_anchors", anchors(F.col("edited")))
    return paired.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))
