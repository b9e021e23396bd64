"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One edit moves a word's letter counts by an L1 distance of at most two: a replaced letter takes one count down and one
up, an inserted letter takes one up.  For each word length a cut tree, fitted on a sample of that length's words,
splits the space of counts into cells.  A word lies in one cell of its own length.  It also visits the cells whose
box it can reach: of its own length, later than its home, by one count up and one down; of the next length by one
count up.  So every pair of near words meets in exactly one cell.  A cell builds a k-d tree over its words, searches it
with its words and visitors, pruning by the nodes' boxes in the same way, and verifies the order of letters of what
is left.  Cells are joined independently of each other.

Counts are kept for a-z and, together, for six classes of the other letters; folding letters together and clipping
counts at 255 never makes a distance larger, so no near pair is lost.

Nulls and ties: a null text has no words and a null doc_id counts as empty text; among near words of equal n the
smallest in code-point order is the form; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import common, words

LEAST_POINTS, LEAST_N, RATIO, DROPPED = 6, 5, 5, 199
#: Words of a cell aimed at, words in a leaf of a cell's tree, sampled words of a cell, most words sampled.
CELL, LEAF, CELL_SAMPLE, MOST_SAMPLED = 16384, 24, 64, 200_000
DIMS = 32
#: The count that each letter U+0000 to U+00FF belongs to.
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])


# --- words with one letter dropped here and there --------------------------------------------------- #

_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def _after_zero_bytes(crc: np.ndarray, most: int) -> np.ndarray:
    """Row k: what each crc contributes to the crc of its bytes with k bytes after them."""
    out = np.empty((most + 1, len(crc)), np.uint32)
    out[0] = crc
    for k in range(most):
        out[k + 1] = _CRC[out[k] & 0xFF] ^ (out[k] >> np.uint32(8))
    return out


def run_hashes(prefixes: list[bytes], found: words.Words) -> np.ndarray:
    """Crc32 of prefix and word for each run, from the crcs of both."""
    if not len(found.code):
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, found.distinct), np.int64, len(found.distinct))
    crc = np.fromiter(map(zlib.crc32, found.distinct), np.uint32, len(found.distinct))
    held, text = np.unique(found.text, return_inverse=True)
    short = min(int(size.max()), 64)
    moved = _after_zero_bytes(np.fromiter((zlib.crc32(prefixes[t]) for t in held), np.uint32, len(held)), short)
    h = moved[np.minimum(size[found.code], short), text] ^ crc[found.code]
    for k in np.flatnonzero(size[found.code] > short):
        h[k] = zlib.crc32(prefixes[found.text[k]] + found.distinct[found.code[k]])
    return h.astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text", 8 << 20):
        found = words.latin_words(batch.column("text"), LEAST_POINTS)
        prefixes = [b"%s:" % (i or "").encode() for i in batch.column("id").to_pylist()]
        h = run_hashes(prefixes, found)
        hit = h % DROPPED == 0
        counts = Counter(dict(enumerate(np.bincount(found.code[~hit], minlength=len(found.distinct)).tolist())))
        texts = [w.decode() for w in found.distinct]
        counts = Counter({w: counts[k] for k, w in enumerate(texts) if counts[k]})
        for k in np.flatnonzero(hit):
            word = texts[found.code[k]]
            at = int(h[k]) % len(word)
            if len(word) > LEAST_POINTS:
                counts[word[:at] + word[at + 1 :]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs(doc_id, text) with at least LEAST_N occurrences."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(_count_words, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


# --- k-d trees ---------------------------------------------------------------------------------- #

def letters(found: list[str]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(found).encode("latin-1"), np.uint8).reshape(len(found), -1)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    at = np.arange(len(rows))[:, None] * DIMS + _DIM[rows]
    return np.minimum(np.bincount(at.ravel(), minlength=len(rows) * DIMS), 255).reshape(-1, DIMS).astype(np.uint8)


class KdTree:
    """Boxes over points, split at medians of the widest count.  Node 0 is the root; a leaf's children are -1."""

    def __init__(self, points: np.ndarray, leaves: int, tight: bool):
        """tight: boxes bound the points; else they are the parts of the whole space that the splits make."""
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.child, self.split, self.span = [], [], [], [], []
        most = max(1, -(-len(points) // leaves))
        whole = (np.zeros(DIMS, np.uint8), np.full(DIMS, 255, np.uint8))
        self._add(0, len(points), *whole, tight)
        k = 0
        while k < len(self.span):
            a, b = self.span[k]
            mine = points[self.order[a:b]]
            wide = mine.astype(np.float32).var(axis=0) if b - a > most else np.zeros(1)
            if wide.max() > 0:
                dim = int(wide.argmax())
                value = int(np.median(mine[:, dim]))
                if (mine[:, dim] <= value).all():
                    value -= 1
                left = mine[:, dim] <= value
                own = self.order[a:b]
                self.order[a:b] = np.concatenate([own[left], own[~left]])
                middle = a + int(left.sum())
                high, low = self.high[k].copy(), self.low[k].copy()
                high[dim], low[dim] = value, value + 1
                self.child[k], self.split[k] = len(self.span), (dim, value)
                self._add(a, middle, self.low[k], high, tight)
                self._add(middle, b, low, self.high[k], tight)
            k += 1
        self.low, self.high, self.child, self.span = (np.array(x) for x in (self.low, self.high, self.child, self.span))

    def _add(self, a, b, low, high, tight):
        if tight and b > a:
            mine = self.points[self.order[a:b]]
            low, high = mine.min(axis=0), mine.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.child.append(-1)
        self.split.append(None)
        self.span.append((a, b))

    def home(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query lies in."""
        node = np.zeros(len(queries), np.int64)
        for k in range(len(self.child)):  # children come after their parents
            if self.child[k] >= 0:
                dim, value = self.split[k]
                here = np.flatnonzero(node == k)
                node[here] = self.child[k] + (queries[here, dim] > value)
        return node

    def reach(self, queries: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and leaf whose box the query meets by at most so many counts up and down."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found = []
        while len(query):
            keep = np.empty(len(query), bool)
            for a in range(0, len(query), 1 << 18):
                x, n = queries[query[a : a + (1 << 18)]], node[a : a + (1 << 18)]
                low, high = self.low[n], self.high[n]
                keep[a : a + (1 << 18)] = ((low - np.minimum(low, x)).sum(axis=1) <= up) & ((x - np.minimum(x, high)).sum(axis=1) <= down)
            query, node = query[keep], node[keep]
            leaf = self.child[node] < 0
            found.append((query[leaf], node[leaf]))
            query, first = query[~leaf], self.child[node[~leaf]]
            query, node = np.repeat(query, 2), np.stack([first, first + 1], axis=1).ravel()
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (query, node)

    def near(self, queries: np.ndarray, up: int, down: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query and point within so many counts up and down of each other, some at a time."""
        for a in range(0, len(queries), 2048):
            query, leaf = self.reach(queries[a : a + 2048], up, down)
            query += a
            size = self.span[leaf, 1] - self.span[leaf, 0]
            cuts = np.searchsorted(np.cumsum(size), np.arange(most, size.sum() + most, most)) + 1
            for x, y in zip([0, *cuts[:-1]], cuts):
                n = size[x:y]
                if not len(n):
                    continue
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.span[leaf[x:y], 0], n)
                q, p = np.repeat(query[x:y], n), self.order[place]
                there, here = self.points[p], queries[q]
                same = np.minimum(there, here)
                keep = ((there - same).sum(axis=1) <= up) & ((here - same).sum(axis=1) <= down)
                yield q[keep], p[keep]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the long word is the short one with one letter put in."""
    before = np.logical_and.accumulate(short == long[:, :-1], axis=1)
    after = short == long[:, 1:]
    return (before | after).all(axis=1)


# --- cells ----------------------------------------------------------------------------------------- #

def cut_trees(vocabulary: DataFrame) -> dict[int, KdTree]:
    """By word length a tree whose leaves are its cells."""
    sizes = {r["size"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).toLocalIterator()}
    one_of = max(CELL // CELL_SAMPLE, -(-sum(sizes.values()) // MOST_SAMPLED))
    sample = {}
    for row in vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(one_of)) == 0).select("word").toLocalIterator():
        sample.setdefault(len(row["word"]), []).append(row["word"])
    trees = {}
    for size, n in sizes.items():
        points = letter_counts(letters(sample[size])) if size in sample else np.zeros((0, DIMS), np.uint8)
        trees[size] = KdTree(points, max(1, min(n // CELL, len(points) // 2)), tight=False)
        trees[size].points = trees[size].order = None  # the sample has done its work
    return trees


HOME, VISITOR, SHORTER = 0, 1, 2


def _dealer(trees: dict[int, KdTree]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.fromiter(map(len, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            for length in np.unique(size):
                mine = batch.take(pa.array(np.flatnonzero(size == length)))
                counts = letter_counts(letters(mine.column("word").to_pylist()))
                home = trees[length].home(counts)
                query, leaf = trees[length].reach(counts, 1, 1)
                later = leaf > home[query]
                copies = [(HOME, length, np.arange(len(home)), home), (VISITOR, length, query[later], leaf[later])]
                if length + 1 in trees:
                    copies.append((SHORTER, length + 1, *trees[length + 1].reach(counts, 1, 0)))
                for kind, cell_size, row, leaf in copies:
                    some = mine.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), cell_size)), pa.array(leaf), pa.array(np.full(len(row), kind, np.int32)), some.column("word"), some.column("n")],
                        ["size", "cell", "kind", "word", "n"])

    return deal


def _join_cell(table: pa.Table) -> pa.Table:
    kinds = table.column("kind").to_numpy()
    sides = {k: table.take(pa.array(np.flatnonzero(kinds == k))).combine_chunks() for k in (HOME, VISITOR, SHORTER)}
    found = [[], [], [], []]
    home = sides[HOME]
    if home.num_rows:
        points = letters(home.column("word").to_pylist())
        tree = KdTree(letter_counts(points), max(1, len(points) // LEAF), tight=True)
        for kind, side in sides.items():
            if not side.num_rows:
                continue
            rows = points if kind == HOME else letters(side.column("word").to_pylist())
            at_once = max(1, (32 << 20) // rows.shape[1])
            for q, p in tree.near(letter_counts(rows), 1, 0 if kind == SHORTER else 1):
                if kind == HOME:
                    q, p = q[q < p], p[q < p]
                for a in range(0, len(q), at_once):
                    x, y = q[a : a + at_once], p[a : a + at_once]
                    right = one_inserted(rows[x], points[y]) if kind == SHORTER else one_replaced(rows[x], points[y])
                    x, y = pa.array(x[right]), pa.array(y[right])
                    for out, column in zip(found, (side.column("word").take(x), side.column("n").take(x), home.column("word").take(y), home.column("n").take(y))):
                        out.extend(column.chunks)
    return pa.table([pa.chunked_array(c, t) for c, t in zip(found, (pa.string(), pa.int64()) * 2)], ["a", "n_a", "b", "n_b"])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every pair of words of vocabulary(word, n) that one edit parts, once; words hold U+0000 to U+00FF."""
    trees = cut_trees(vocabulary)
    dealt = vocabulary.select("word", "n").mapInArrow(_dealer(trees), "size long, cell long, kind int, word string, n long")
    # a cell is much work for its bytes, so the number of tasks follows the cells
    cells = sum(int((t.child < 0).sum()) for t in trees.values())
    dealt = dealt.repartition(max(1, cells), "size", "cell")
    return dealt.groupBy("size", "cell").applyInArrow(_join_cell, "a string, n_a long, b string, n_b long")


# --- forms ----------------------------------------------------------------------------------------- #

def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms(word, form) ends.  A form's n is larger, so rounds double what is followed."""
    reached = common.staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = reached.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = reached.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        moved = common.staged(moved, "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def spelling_variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of vocabulary(word, n)."""
    pairs = common.staged(near_pairs(vocabulary), "near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    much = -F.col("best.less") >= RATIO * F.col("n")
    named = vocabulary.join(near, "word", "left").select(
        "word", F.when(much, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, -F.col("best.less")).alias("form_n"))
    named = common.staged(named, "forms")
    root = roots(named.where("form is not null"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_variants(common.staged(counted_words(docs), "vocabulary"))
