"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Counting goes level by level, from grams of ORDER words down.  Tasks combine the grams of their texts and deal them
as packed blocks by the grams' hash, so no word, however frequent, gathers in one task.  Each bucket adds up its
grams, writes them as a file of sorted hashes with counts, and passes on two partial tables: the context's count and
followers by class (1, 2, more), and the gram without its first word, once per distinct gram: the continuation counts
of the level below.  Raw word counts take the same way.

    p_k(w | h) = (c - D_k(c)) / C(h) + (D_1 N_1(h) + D_2 N_2(h) + D_3 N_3+(h)) / C(h) * p_{k-1}(w | h')

with p_0 = 1 / (V + 1); an unseen context leaves p_{k-1}.  Before its first word a text has begin marks.
A scoring task looks up the distinct grams of a batch bucket by bucket: a bucket's file is mapped, of which only pages
that hold a wanted hash are read, and let go.

Nulls and ties: a null text is empty and holds the end token alone; a null doc_id counts as empty text in the split;
repeated rows count each; without a training text every word has probability 1 / (V + 1) = 1; an empty table gives
no rows.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import common, words

#: Words of a gram.
ORDER = 2
#: Text bytes that a bucket of grams is made for, and grams that a counting task holds before it deals them.
BUCKET_BYTES, HELD_GRAMS = 32 << 20, 3_000_000
#: Tokens scored at once.
SCORED = 1 << 20

BLOCK = "kind string, level int, bucket long, block binary"
PART = BLOCK + ", file string, facts array<long>"


# --- hashes, and grams in bulk ------------------------------------------------------------------ #

def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each row of words; a row's hash depends on the order of its words."""
    state = np.full(len(columns[0]), len(columns), np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            state = mixed(state * np.uint64(0x9E3779B97F4A7C15) + column)
    return state


def text_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end token after each text, and where each text begins (one more at the end)."""
    found = words.spaced_words(texts)
    hashes = np.fromiter((word_hash(w) for w in found.distinct), np.uint64, len(found.distinct))
    at = np.searchsorted(found.text, np.arange(len(texts) + 1))
    tokens = hashes[found.code] if len(hashes) else np.zeros(0, np.uint64)
    return np.insert(tokens, at[1:], np.uint64(word_hash(b""))), at + np.arange(len(at))


def gram_columns(tokens: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """The order - 1 tokens before each token, the farthest first, then the tokens; begin marks before a text."""
    begin = np.uint64(word_hash(b" "))
    place = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
    columns = [tokens]
    for back in range(1, order):
        earlier = np.full(len(tokens), begin)
        earlier[back:] = tokens[:-back]
        earlier[place < back] = begin
        columns.insert(0, earlier)
    return columns


def added_up(key: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]):
    """Rows of equal key as one, by ascending key, their values added."""
    if not len(key):
        return key, columns, values
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return key[first], [c[order[first]] for c in columns], [np.add.reduceat(v[order], first) for v in values]


# --- packed blocks --------------------------------------------------------------------------- #

def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * 8).reshape(8, n).T).view("<u8").reshape(n)


def packed(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Rows as one block: each key column's distinct values and places among them, then the values."""
    import zstandard

    order = np.lexsort(columns[::-1])
    parts = [np.array([len(order), len(columns), len(values)], "<u8").tobytes()]
    for k, column in enumerate(columns):
        distinct, place = np.unique(column[order], return_inverse=True)
        place = np.diff(place, prepend=0) if k == 0 else place  # the first column is sorted
        parts += [np.array([len(distinct)], "<u8").tobytes(), _planes(np.diff(distinct, prepend=np.uint64(0))), _planes(place)]
    parts += [_planes(v[order]) for v in values]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(block: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    import zstandard

    data = memoryview(zstandard.ZstdDecompressor().decompress(block))
    n, n_columns, n_values = (int(x) for x in np.frombuffer(data, "<u8", 3))
    at, columns = 24, []
    for k in range(n_columns):
        m = int(np.frombuffer(data[at:], "<u8", 1)[0])
        distinct, place = np.cumsum(_unplanes(data[at + 8 :], m)), _unplanes(data[at + 8 + 8 * m :], n)
        columns.append(distinct[np.cumsum(place) if k == 0 else place])
        at += 8 + 8 * (m + n)
    values = [_unplanes(data[at + 8 * n * k :], n).astype(np.int64) for k in range(n_values)]
    return columns, values


def dealt(kind: str, level: int, key: np.ndarray, columns: list, values: list, bits: int) -> Iterator[tuple]:
    """Blocks of rows in ascending key, one for each bucket: the leading bits of the key."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield kind, level, int(bucket[a]), packed([c[a:b] for c in columns], [v[a:b] for v in values])


# --- files of sorted hashes ---------------------------------------------------------------------- #

def file_bytes(key: np.ndarray, values: list[np.ndarray], plain: tuple[int, ...]) -> bytes:
    """Keys whose values are the plain ones as bare hashes, then the other keys with their values."""
    bare = np.logical_and.reduce([v == p for v, p in zip(values, plain)]) if len(key) else np.zeros(0, bool)
    parts = [np.array([bare.sum(), (~bare).sum()]), key[bare], key[~bare], *(v[~bare] for v in values)]
    return b"".join(p.astype("<u8").tobytes() for p in parts)


def mapped(folder: str, name: str) -> np.ndarray:
    """A file's words: mapped where the folder is a path of this machine, else read, one bucket at a time."""
    system, path = common.filesystem(folder)
    if system.type_name == "local":
        return np.memmap(f"{path}/{name}", "<u8", "r")
    with system.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read(), "<u8")


def looked_up(file: np.ndarray, keys: np.ndarray, plain: tuple[int, ...]) -> np.ndarray:
    """One row of values for each key, zeros for keys that the file has not."""
    n_bare, n_rest = int(file[0]), int(file[1])
    out = np.zeros((len(keys), len(plain)), np.int64)
    for first, n, bare in ((2, n_bare, True), (2 + n_bare, n_rest, False)):
        if n:
            place = np.minimum(np.searchsorted(file[first : first + n], keys), n - 1)
            hit = np.flatnonzero(file[first + place] == keys)
            for k, value in enumerate(plain):
                out[hit, k] = value if bare else file[first + n * (k + 1) + place[hit]]
    return out


#: Values of a row that is stored as a bare hash: a count of 1; a context with one follower seen once.
PLAIN = {"words": (1,), "grams": (1,), "contexts": (1, 1, 0, 0)}


# --- counting ------------------------------------------------------------------------------------ #

def _batch(rows: list[tuple], schema: list[str]) -> pa.RecordBatch:
    types = {"kind": pa.string(), "level": pa.int32(), "bucket": pa.int64(), "block": pa.binary(), "file": pa.string(), "facts": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(zip(*rows), schema)] if rows else [pa.array([], types[n]) for n in schema], schema)


def _counter(order: int, bits: int):
    names = ["kind", "level", "bucket", "block"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"words": [], "grams": []}

        def together(kind):
            columns = [np.concatenate(c) for c in zip(*(h[1] for h in held[kind]))]
            return added_up(np.concatenate([h[0] for h in held[kind]]), columns, [np.concatenate([h[2][0] for h in held[kind]])])

        def flush():
            for kind, level in (("words", 1), ("grams", order)):
                for row in dealt(kind, level, *together(kind), bits):
                    yield _batch([row], names)
                held[kind] = []

        for batch in batches:
            for some in common.slices([batch], "text", 4 << 20):
                tokens, at = text_tokens(some.column("text"))
                for kind, columns in (("words", [tokens]), ("grams", gram_columns(tokens, at, order))):
                    held[kind].append(added_up(gram_hash(columns), columns, [np.ones(len(tokens), np.int64)]))
                if sum(len(h[0]) for h in held["grams"]) >= HELD_GRAMS:
                    held["grams"], held["words"] = [together("grams")], [together("words")]
                    if len(held["grams"][0][0]) >= HELD_GRAMS // 2:
                        yield from flush()
        if held["grams"]:
            yield from flush()

    return count


def _reducer(folder: str, bits: int):
    names = ["kind", "level", "bucket", "block", "file", "facts"]

    def reduce(table: pa.Table) -> pa.Table:
        kind, level, bucket = (table.column(c)[0].as_py() for c in ("kind", "level", "bucket"))
        columns, values = [], []
        for block in table.column("block"):
            c, v = unpacked(block.as_py())
            columns.append(c)
            values.append(v)
        columns, values = [np.concatenate(c) for c in zip(*columns)], [np.concatenate(v) for v in zip(*values)]
        key, columns, values = added_up(columns[0] if kind == "contexts" else gram_hash(columns), columns, values)
        name = f"{kind}-{level}-{bucket}-{uuid.uuid4().hex}"
        common.write_file(folder, name, file_bytes(key, values, PLAIN[kind]))
        n = values[0]
        facts = [len(key), int(n.sum()), *(int((n == c).sum()) for c in (1, 2, 3, 4)), int((n >= 3).sum())]
        rows = [(kind, level, bucket, None, name, facts)]
        if kind == "grams" and level > 1:
            context = gram_hash(columns[:-1])
            classes = [n, *((np.minimum(n, 3) == c).astype(np.int64) for c in (1, 2, 3))]
            at, _, classes = added_up(context, [], classes)
            rows += [(*row, None, None) for row in dealt("contexts", level, at, [at], classes, bits)]
            lower = added_up(gram_hash(columns[1:]), columns[1:], [np.ones(len(key), np.int64)])
            rows += [(*row, None, None) for row in dealt("grams", level - 1, *lower, bits)]
        return pa.Table.from_batches([_batch(rows, names)])

    return reduce


@dataclass(frozen=True)
class Model:
    """A counted model: its files by kind, level and bucket, and what is summed up over all of it."""

    folder: str
    order: int
    bits: int
    files: dict
    tokens: int
    vocabulary: int
    discounts: dict
    whole: tuple  # of level 1: count, followers by class

    def lookup(self, kind: str, level: int, keys: np.ndarray) -> np.ndarray:
        """Values of each key, zeros where it is unknown; each bucket's file is mapped once and let go."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        out = np.zeros((len(distinct), len(PLAIN[kind])), np.int64)
        bucket = distinct >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(distinct), np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(distinct)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            name = self.files.get((kind, level, int(bucket[a]))) if b > a else None
            if name:
                out[a:b] = looked_up(mapped(self.folder, name), distinct[a:b], PLAIN[kind])
        return out[inverse]

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """Probability of the last word of each row after the words before it."""
        p = np.full(len(columns[0]), 1 / (self.vocabulary + 1))
        for level in range(1, self.order + 1):
            own = columns[len(columns) - level :]
            count = self.lookup("grams", level, gram_hash(own))[:, 0]
            if level == 1:
                seen = np.broadcast_to(np.array(self.whole), (len(p), 4))
            else:
                seen = self.lookup("contexts", level, gram_hash(own[:-1]))
            total, discount = np.maximum(seen[:, 0], 1), np.array(self.discounts[level])
            rest = (seen[:, 1:] * discount[1:]).sum(axis=1) / total
            p = np.where(seen[:, 0] > 0, (count - discount[np.minimum(count, 3)]) / total + rest * p, p)
        return p


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Discounts of counts 0, 1, 2 and more from the counts of counts; a half each where these don't tell."""
    if not (n1 and n2):
        return 0.0, 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    fitted = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return 0.0, *(float(min(max(d, 0.0), most)) for d, most in zip(fitted, (1, 2, 3)))


def train(texts: DataFrame, order: int = ORDER, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Counts the model of texts(text).  The driver sees one row of facts and a file name per bucket."""
    spark = texts.sparkSession
    folder = common.new_folder(spark, "ngrams")
    size = texts.agg(F.coalesce(F.sum(common.utf8_size(F.col("text"))), F.lit(0)).alias("n")).first()["n"]
    bits = max(0, (size // bucket_bytes).bit_length())
    facts: dict = {}
    files: dict = {}
    blocks = texts.select("text").mapInArrow(_counter(order, bits), BLOCK)
    for _ in range(order):  # grams of one level with the contexts of the level above
        parts = common.staged(blocks.groupBy("kind", "level", "bucket").applyInArrow(_reducer(folder, bits), PART), "grams")
        for row in parts.where("file is not null").select("kind", "level", "bucket", "file", "facts").toLocalIterator():
            files[row["kind"], row["level"], row["bucket"]] = row["file"]
            sums = facts.setdefault((row["kind"], row["level"]), [0] * 7)
            facts[row["kind"], row["level"]] = [a + b for a, b in zip(sums, row["facts"])]
        blocks = parts.where("file is null").select("kind", "level", "bucket", "block")
    vocabulary, tokens = facts.get(("words", 1), [0, 0])[:2]
    last = facts.get(("grams", 1), [0] * 7)
    return Model(folder, order, bits, files, tokens, vocabulary,
                 {k: discounts_of(*facts.get(("grams", k), [0] * 7)[2:6]) for k in range(1, order + 1)},
                 (last[1], last[2], last[3], last[6]))


# --- scoring ------------------------------------------------------------------------------------- #

SCORE = "n_tokens long, n_known long, base_score double, score double"


def _scorer(model: Model, key: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.slices(batches, "text", 8 << 20):
            tokens, at = text_tokens(some.column("text"))
            columns = gram_columns(tokens, at, model.order)
            known, base, logp = np.empty(len(tokens), np.int64), np.empty(len(tokens)), np.empty(len(tokens))
            for a in range(0, len(tokens), SCORED):
                part = [c[a : a + SCORED] for c in columns]
                count = model.lookup("words", 1, gram_hash(part[-1:]))[:, 0]
                known[a : a + SCORED] = count > 0
                base[a : a + SCORED] = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
                logp[a : a + SCORED] = np.log10(model.probability(part))
            sums = [np.add.reduceat(x, at[:-1]) for x in (known, base, logp)]
            yield pa.RecordBatch.from_arrays([some.column(key), *(pa.array(x) for x in (np.diff(at), *sums))], [key, "n_tokens", "n_known", "base_score", "score"])

    return score


def score(rows: DataFrame, model: Model, key: str = "row") -> DataFrame:
    """Tokens, known tokens, unigram score and model score (log10) of each text of rows(key, text)."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(_scorer(model, key), f"`{key}` {kind}, {SCORE}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text"))
    scored = score(docs, model, "doc_id")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
