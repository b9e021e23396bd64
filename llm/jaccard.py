"""Exact self-join of documents by the Jaccard similarity of their word n-grams, using relations between sets.

Index lists: every set enters the lists of its prefix, its first tokens in one global order that puts common
tokens last.  Sets that link share a token of their prefixes, so all links are found within lists.
 * A list is kept in blocks by position.  The positions and sizes of two blocks bound the overlap of all their
   pairs, and block pairs that can't reach it are skipped whole.
 * Answers of a highly similar set are used again.  Equal sets are one class.  Sets that share a minimum of one
   of three hash orders are first compared with one leader, then the sets of each longer list with one of them,
   another in each list; verified links put them into the leader's family, which is linked already, so lists
   only compare families.  Within a list each family answers through its first member: its distance to another
   family's first, less the spread of both families, decides for all members; only where it doesn't are
   members' own answers derived from their differences.
 * What is left as candidates is compared by wider parities, then verified on the whole texts.
Families are components of verified links only, so nothing rests on the hash orders but work saved.

Tokens are 64-bit hashes of word n-grams and sets are told apart by 128 bits of their tokens; the text rows of
classes are found again by a 64-bit hash of doc_id and text.

Nulls and ties: a null text, or one without words, has an empty set and links with nothing; a text with fewer
than k words is one n-gram of all its words; rows that repeat are equal sets; a null doc_id takes part and is
passed over when components are named (a component of nulls alone is named null); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import common

WORDS = 5
PERCENT = 80

#: Counters of the frequency sketch, their chunks, and bits of the filter for verification: fixed sizes.
SKETCH, CHUNKS = 1 << 20, 64
FILTER_BITS = 1 << 24
#: Entries of a part of an index list, of a block by position, and of a list compared without blocks.
PART, BLOCK, SHORT = 4096, 64, 64
#: Bits of the parities that candidates are compared by before their texts are; in lists half a bit for each token.
WIDE_BITS, LEAST_BITS = 2048, 256
#: Entries of a list from which one of its sets is compared with all others first.
STAR = 16
#: Bytes of text hashed at a time.
SLICE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = tuple(np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAB5A5A5A5B))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and their inverses modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 << 20)
        base = 0x5851F42D4C957F2D
        for x in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, np.uint64(x))
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
        del _powers[:-2]
    return _powers[0], _powers[1]


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word n-grams of all texts, in order, and where each text's begin (one more at the end)."""
    blob = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(blob.buffers()[1], np.int64, len(blob) + 1, blob.offset * 8)
    data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    none = np.zeros(0, np.uint64), np.zeros(len(blob) + 1, np.int64)
    if not len(data):
        return none
    word = ~_SPACE[data]
    starts, ends = word.copy(), word.copy()
    begins = at[:-1][np.diff(at) > 0]
    cut = np.zeros(len(data) + 1, bool)
    cut[begins] = True
    starts[1:] &= ~word[:-1] | cut[1:-1]
    ends[:-1] &= ~word[1:] | cut[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    if not len(first):
        return none
    powers, inverses = _power_tables(len(data))
    running = np.cumsum(_LETTER[_LOWER[data]] * powers[: len(data)])
    before = np.where(first > 0, running[first - 1], np.uint64(0))
    words = mix((running[last] - before) * inverses[first] + (last - first + 1).astype(np.uint64) * _ODD)
    per_text = np.searchsorted(first, at)  # words before each text
    count = np.diff(per_text)
    grams = np.zeros(len(words), np.uint64)
    for i in range(k):
        grams[: len(words) - i] += words[i:] * np.uint64(2 * i + 3)
        grams = mix(grams) if i < k - 1 else grams
    keep = np.zeros(len(words) + 1, np.int64)
    long, short = count >= k, (count > 0) & (count < k)
    np.add.at(keep, per_text[:-1][long], 1)
    np.add.at(keep, per_text[1:][long] - k + 1, -1)
    keep = np.cumsum(keep)[:-1] > 0
    for t in np.flatnonzero(short):
        whole = np.array([count[t]], np.uint64)
        for x in words[per_text[t] : per_text[t + 1]]:
            whole = mix(whole * _ODD + x)
        grams[per_text[t]] = whole[0]
    keep[per_text[:-1][short]] = True
    sizes = np.where(long, count - k + 1, short.astype(np.int64))
    return mix(grams[keep]), np.concatenate([[0], np.cumsum(sizes)])


def token_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct n-gram hashes, ascending."""
    grams, at = shingles(texts, k)
    return [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:])]


def needed(total, percent: int):
    """Least overlap of two linked sets, from the sum of their sizes."""
    return -(-percent * total // (100 + percent))


def most_apart(total, percent: int):
    """Largest symmetric difference of two linked sets whose sizes add up to at most total.

    The limit of one sum falls by one where the least overlap rises, never twice in a row.
    """
    return np.maximum(total - 2 * needed(total, percent), total - 1 - 2 * needed(total - 1, percent))


def fitting_words(n: int) -> int:
    """64-bit words of the parities of a set of n tokens in index lists: a power of two times the least."""
    bits = LEAST_BITS
    while bits < min(n // 2, WIDE_BITS):
        bits *= 2
    return bits // 64


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities in fewer words."""
    while parity.shape[1] > words:
        half = parity.shape[1] // 2
        parity = parity[:, :half] ^ parity[:, half:]
    return parity


class Parities:
    """Parities of different lengths; two are compared in the shorter one's."""

    def __init__(self, column: list[np.ndarray], sizes: np.ndarray):
        self.words = sizes
        self._by_words = {}
        flat, at = np.concatenate(column) if column else np.zeros(0, np.int64), np.cumsum(sizes) - sizes
        for words in sorted(set(sizes.tolist()), reverse=True):
            rows = np.full((len(sizes), words), 0, np.int64)
            for longer in (x for x in set(sizes.tolist()) if x >= words):
                own = np.flatnonzero(sizes == longer)
                rows[own] = folded(flat[at[own][:, None] + np.arange(longer)], words)
            self._by_words[words] = rows.view(np.uint64)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of pairs of rows: at most the symmetric difference of the sets."""
        common_words, out = np.minimum(self.words[i], self.words[j]), np.zeros(len(i), np.int64)
        for words, rows in self._by_words.items():
            own = np.flatnonzero(common_words == words)
            for k in range(0, len(own), 65536):
                some = own[k : k + 65536]
                out[some] = np.bitwise_count(rows[i[some]] ^ rows[j[some]]).sum(axis=1)
        return out


def _text_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """A level for every counter of a sketch over all n-grams: 0 for rare ones, higher the more common.

    Levels only order tokens.  The sketch has SKETCH counters at any size of the input.
    """

    def count(batches):
        counters = np.zeros(SKETCH, np.int64)
        for batch in common.slices(batches, "text", SLICE):
            counters += np.bincount((shingles(batch.column("text"), k)[0] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        parts = np.minimum(counters, 65535).astype("<u2").reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "counters"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counters in zip(batch.column("chunk").to_pylist(), batch.column("counters").to_pylist()):
                totals[chunk] = totals.get(chunk, 0) + np.frombuffer(counters, "<u4" if len(counters) > 2 * SKETCH // CHUNKS else "<u2").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in totals.values()], pa.binary())], ["chunk", "counters"])

    schema = "chunk long, counters binary"
    parts = docs.select("text").mapInArrow(count, schema)
    total = np.zeros((CHUNKS, SKETCH // CHUNKS), np.int64)
    for row in parts.repartition(CHUNKS, "chunk").mapInArrow(add, schema).toLocalIterator():
        total[row.chunk] = np.frombuffer(row.counters, "<u4")
    total = total.ravel()
    usual = total.mean()
    above = total - usual - 6 * np.sqrt(usual) - 8
    return np.where(above > 0, 1 + np.log2(np.maximum(above, 1)), 0).astype(np.uint8)


def signatures(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per row: key (of its text), doc_id, n, the set's 128 bits, three minima, its parities in LEAST_BITS bits,
    in about n / 2 and in WIDE_BITS, its prefix tokens.

    A parity bit tells whether an odd number of tokens has its number; halves of parities add up to shorter ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["key", "doc_id", "n", "set_a", "set_b", "m0", "m1", "m2", "p0", "p1", "p2", "p3"]

    def run(batches):
        level = shared.value
        for batch in common.slices(batches, "text", SLICE):
            numbers, prefixes, wide, fit = np.zeros((10, batch.num_rows), np.uint64), [], [], []
            for i, tokens in enumerate(token_sets(batch.column("text"), k)):
                n = len(tokens)
                numbers[0, i] = n
                if not n:
                    prefixes.append(None)
                    wide.append(None)
                    fit.append(None)
                    continue
                mixed = [mix(tokens ^ seed) for seed in _SEEDS]
                numbers[1, i], numbers[2, i] = mixed[0].sum(), mix(mixed[1] + _ODD).sum()
                numbers[3:6, i] = [x.min() for x in mixed]
                bits = np.bincount((mixed[2] % np.uint64(WIDE_BITS)).astype(np.int64), minlength=WIDE_BITS) & 1
                parity = np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")
                wide.append(parity)
                fit.append(folded(parity[None], fitting_words(n))[0])
                numbers[6:10, i] = folded(parity[None], LEAST_BITS // 64)[0].view(np.uint64)
                order = np.lexsort((tokens, level[(tokens % np.uint64(SKETCH)).astype(np.int64)]))
                prefixes.append(tokens[order[: n - -(-percent * n // 100) + 1]].view(np.int64))
            sizes = np.array([0 if p is None else len(p) for p in prefixes])
            flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            columns = [batch.column("key"), batch.column("doc_id"), *(pa.array(x.view(np.int64)) for x in numbers), pa.array(fit, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), lists]
            yield pa.RecordBatch.from_arrays(columns, [*names, "fit", "wide", "prefix"])

    rows = docs.select(_text_key().alias("key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names) + ", fit array<long>, wide array<long>, prefix array<long>")


def _distance(a: str, b: str) -> Column:
    """Bits in which the parities of two sets differ: at most their symmetric difference."""
    return sum((F.bit_count(F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}p0").bitwiseXOR(F.col(f"{b}p0"))))


def _may_link(percent: int) -> Column:
    total = F.col("n") + F.col("l_n")
    return _distance("", "l_") <= total - 2 * F.ceil(total * percent / F.lit(100 + percent))


def leader_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each class and the leader of one of its three minima that may link."""
    minima = classes.select("cid", "n", *(f"p{i}" for i in range(4)), F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(f"m{i}").alias("m")) for i in range(3)))).alias("x"))
    minima = minima.select("cid", "n", *(f"p{i}" for i in range(4)), "x.which", "x.m")
    leaders = minima.groupBy("which", "m").agg(F.min(F.struct("cid", "n", *(f"p{i}" for i in range(4)))).alias("l"), F.count("*").alias("members"))
    leaders = leaders.where("members > 1").select("which", "m", *(F.col(f"l.{x}").alias(f"l_{x}") for x in ("cid", "n", "p0", "p1", "p2", "p3")))
    joined = minima.join(common.staged(leaders, "leaders"), ["which", "m"]).where("cid <> l_cid")
    return joined.where(_may_link(percent)).select(F.least("cid", "l_cid").alias("a"), F.greatest("cid", "l_cid").alias("b")).distinct()


def list_entries(prefixes: DataFrame, families: DataFrame) -> DataFrame:
    """cid, token, pos of the index lists that hold more than one family, a written table.

    prefixes has cid and prefix, of classes and of the rows that are equal to them; families has cid and family.
    """
    entries = prefixes.join(families, "cid").dropDuplicates(["cid"]).select("cid", "family", F.posexplode("prefix").alias("pos", "token"))
    lists = entries.groupBy("token").agg(F.min("family").alias("low"), F.max("family").alias("high"))
    lists = common.staged(lists.where("low <> high").select("token"), "lists")
    return common.staged(entries.join(lists, "token").select("cid", "token", F.col("pos").cast("long").alias("pos")), "entries")


def several_families(entries: DataFrame, families: DataFrame) -> DataFrame:
    """The entries with family and size of their list, of lists that still hold more than one family."""
    entries = entries.join(families, "cid")
    lists = entries.groupBy("token").agg(F.min("family").alias("low"), F.max("family").alias("high"), F.count("*").alias("size"))
    lists = common.staged(lists.where("low <> high").select("token", "size"), "lists")
    return common.staged(entries.join(lists, "token"), "entries")


def star_pairs(entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one set of each longer list, another one in each, with those of other families that may link."""
    parity = [f"p{i}" for i in range(4)]
    entries = entries.where(F.col("size") >= STAR).join(classes.select("cid", "n", *parity), "cid")
    lead = F.min_by(F.struct("cid", "family", "n", *parity), F.xxhash64("token", "cid"))
    leaders = entries.groupBy("token").agg(lead.alias("l")).select("token", *(F.col(f"l.{x}").alias(f"l_{x}") for x in ("cid", "family", "n", *parity)))
    joined = entries.join(common.staged(leaders, "leaders"), "token").where("family <> l_family")
    return joined.where(_may_link(percent)).select(F.least("cid", "l_cid").alias("a"), F.greatest("cid", "l_cid").alias("b")).distinct()


def list_pairs(entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different families whose prefixes share a token and that may link."""
    kept = entries.select("cid", "token", "pos", "size", "family").join(classes.select("cid", "n", "fit"), "cid")
    # a list of more than PART entries is dealt into parts, and every two parts meet in a task of their own
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.hash("cid"), parts)
    kept = kept.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    kept = kept.select("token", F.least("own", "other").cast("long").alias("x"), F.greatest("own", "other").cast("long").alias("y"), F.col("own").cast("long").alias("own"),
        "cid", "family", "n", "pos", "fit")
    dealt = kept.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    names = ["token", "x", "y", "own", "cid", "family", "n", "pos"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = [np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("token", "x", "y")]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0))
            if len(change):  # the last list may go on
                table = pa.Table.from_batches(held).combine_chunks()
                yield from pairs_of(table.slice(0, change[-1] + 1), change + 1)
                held = table.slice(change[-1] + 1).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from pairs_of(table, np.array([len(table)]))

    def pairs_of(table, ends):
        fit = table.column("fit").combine_chunks()
        fit = fit.chunk(0) if isinstance(fit, pa.ChunkedArray) else fit
        rows = {c: table.column(c).to_numpy() for c in names}
        parities = Parities([fit.flatten().to_numpy()], np.diff(fit.offsets.to_numpy()))
        sizes = np.diff(np.concatenate([[0], ends]))
        short = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
        found = [compare_short(rows, parities, short, np.repeat(np.arange(len(sizes)), sizes)[short], percent)]
        for end, size in zip(ends[sizes > SHORT], sizes[sizes > SHORT]):
            found += compare_list(rows, parities, np.arange(end - size, end), percent)
        a, b = (np.concatenate([x[k] for x in found]) for k in range(2))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)  # a pair shares several tokens
        if both.size:
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _linked_by_bound(c: dict, parities: Parities, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of entries of one list, those whose families differ and whose positions, sizes and parities allow a link."""
    total = c["n"][i] + c["n"][j]
    least = needed(total, percent)
    ok = (c["family"][i] != c["family"][j]) & (np.minimum(c["n"][i] - c["pos"][i], c["n"][j] - c["pos"][j]) >= least)
    ok &= (c["x"][i] == c["y"][i]) | (c["own"][i] != c["own"][j])
    kept = np.flatnonzero(ok)
    return kept[parities.apart(i[kept], j[kept]) <= (total - 2 * least)[kept]]


def compare_short(c: dict, parities: Parities, rows: np.ndarray, lists: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may link of many short lists at once, each entry with those that follow it in its list."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(SHORT, len(lists))):
        at = np.flatnonzero(lists[step:] == lists[:-step])
        if not len(at):
            break
        i, j = rows[at], rows[at + step]
        kept = _linked_by_bound(c, parities, i, j, percent)
        first.append(c["cid"][i[kept]])
        second.append(c["cid"][j[kept]])
    return np.concatenate(first), np.concatenate(second)


def narrowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide parities still allow a link, a written table."""
    sides = [classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}")) for s in "ab"]
    total = F.col("n_a") + F.col("n_b")
    apart = F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    away = F.aggregate(apart, F.lit(0), lambda acc, x: acc + x)
    kept = pairs.join(sides[0], "a").join(sides[1], "b").where(away <= total - 2 * F.ceil(total * percent / F.lit(100 + percent)))
    return common.staged(kept.select("a", "b"), "pairs")


def compare_list(c: dict, parities: Parities, rows: np.ndarray, percent: int):
    """Yields arrays (a, b) of the pairs of one long list, or of two parts of one, that may link.

    Members of a family with parities of one length are a group: shorter parities differ in no more bits, so a
    group's spread also holds at the length its first member is compared with another group's in.
    """
    words = parities.words[rows]
    order = np.lexsort((c["pos"][rows], words, c["family"][rows]))
    rows, words = rows[order], words[order]
    n, pos, family = c["n"][rows], c["pos"][rows], c["family"][rows]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(family) != 0) | (np.diff(words) != 0)]))
    count = np.diff(np.append(first, len(rows)))
    leads = np.repeat(np.arange(len(first)), count)
    spread = np.maximum.reduceat(parities.apart(rows, rows[first][leads]), first)
    low, high, rest = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.maximum.reduceat(n - pos, first)
    # groups in blocks by position
    by_pos = np.argsort(np.minimum.reduceat(pos, first), kind="stable")
    blocks = [by_pos[i : i + BLOCK] for i in range(0, len(by_pos), BLOCK)]
    block_rest, block_low = (np.array([f(v[b]) for b in blocks]) for f, v in ((np.max, rest), (np.min, low)))
    for i, x in enumerate(blocks):
        reach = np.minimum(block_rest[i], block_rest[i:]) >= needed(block_low[i] + block_low[i:], percent)
        for j in i + np.flatnonzero(reach):
            u, v = (g.ravel() for g in np.meshgrid(x, blocks[j], indexing="ij"))
            if i == j:
                u, v = u[u < v], v[u < v]
            may = (family[first[u]] != family[first[v]]) & (np.minimum(rest[u], rest[v]) >= needed(low[u] + low[v], percent))
            u, v = u[may], v[may]
            may = parities.apart(rows[first[u]], rows[first[v]]) - spread[u] - spread[v] <= most_apart(high[u] + high[v], percent)
            u, v = u[may], v[may]
            # the members of the groups that are left
            made = count[u] * count[v]
            step = 0
            while step < len(u):
                upto = max(step + 1, int(np.searchsorted(np.cumsum(made), made[:step].sum() + 1_000_000)))
                p, q, m = u[step:upto], v[step:upto], made[step:upto]
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                a = rows[np.repeat(first[p], m) + within // np.repeat(count[q], m)]
                b = rows[np.repeat(first[q], m) + within % np.repeat(count[q], m)]
                kept = _linked_by_bound(c, parities, a, b, percent)
                if len(kept):
                    yield c["cid"][a[kept]], c["cid"][b[kept]]
                step = upto


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of text keys whose texts link, compared whole."""
    spark = docs.sparkSession
    ends = F.explode(F.array("a", "b"))
    # a filter of fixed size keeps most other texts out of the shuffle; what passes by chance joins nothing
    slot = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    words = pairs.select(ends.alias("key")).distinct().select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {FILTER_BITS}) % 64 as int))").alias("bit"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool))

    def wanted(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value[batch.column("slot").to_numpy()])).drop_columns("slot")

    texts = docs.select(_text_key().alias("key"), "text").withColumn("slot", slot)
    texts = common.staged(texts.mapInArrow(wanted, "key long, text string"), "texts")

    def run(batches):
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(token_sets(batch.column("text_a"), k), token_sets(batch.column("text_b"), k))):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return common.staged(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct(), "links")


def families_of(classes: DataFrame, links: DataFrame) -> DataFrame:
    """cid and family, the component of the links found so far, a written table."""
    family = common.components(classes.sparkSession, links, "family").withColumnRenamed("node", "cid")
    found = classes.select("cid").join(family, "cid", "left")
    return common.staged(found.select("cid", F.coalesce("family", "cid").alias("family")), "families")


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: key (a hash of doc_id and text), doc_id, n_shingles, component_id, first_key.

    first_key is the key of the row that stands for the component: the least key among its least doc_ids.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = common.staged(signatures(docs, k, percent, frequency_levels(docs, k)), "sets")
    classes = rows.where("n > 0").groupBy("set_a", "set_b").agg(F.min("key").alias("cid"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("head"))
    classes = common.staged(classes, "classes")
    heads = rows.drop("doc_id", "set_a", "set_b", "prefix").withColumnRenamed("key", "cid").join(classes.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])
    heads = common.staged(heads, "heads")
    links = verified(docs, narrowed(common.staged(leader_pairs(heads, percent), "near"), heads, percent), k, percent)
    families = families_of(heads, links)
    # a row that repeats has its class's key too; its prefix is the same
    prefixes = rows.where("n > 0").select(F.col("key").alias("cid"), "prefix")
    entries = list_entries(prefixes, families)
    star = star_pairs(several_families(entries, families), heads, percent)
    links = links.unionByName(verified(docs, narrowed(common.staged(star, "star"), heads, percent), k, percent))
    families = families_of(heads, links)
    far = list_pairs(several_families(entries, families), heads, percent)
    links = links.unionByName(verified(docs, narrowed(common.staged(far, "far"), heads, percent), k, percent))
    group = common.components(spark, links, "grp").withColumnRenamed("node", "cid")
    named = classes.join(group, "cid", "left").withColumn("grp", F.coalesce("grp", "cid"))
    named = common.staged(named, "groups")
    least = named.groupBy("grp").agg(F.min("head").alias("head"))
    found = common.staged(named.join(least.withColumnRenamed("head", "top"), "grp").select("set_a", "set_b", "top.doc_id", "top.key"), "named")
    found = found.select("set_a", "set_b", F.col("doc_id").alias("component_id"), F.col("key").alias("first_key"), F.lit(True).alias("linked"))
    joined = rows.select("key", "doc_id", F.col("n").alias("n_shingles"), "set_a", "set_b").join(found, ["set_a", "set_b"], "left")
    alone = F.col("linked").isNull()
    return joined.select("key", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("key")).otherwise(F.col("first_key")).alias("first_key"))


def keep_first(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of docs, in their columns: of each group of linked texts the row with the least doc_id stays.

    Of rows that repeat as a whole one stays; rows without words are in no group and stay.
    """
    found = jaccard_components(docs, k, percent)
    key, n, copy = (common.unused(docs, name) for name in ("__key", "__n", "__copy"))
    stays = common.staged(found.where("n_shingles = 0 or key = first_key").select(F.col("key").alias(key), F.col("n_shingles").alias(n)).dropDuplicates([key]), "stays")
    kept = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text"))).join(stays, key)
    kept = kept.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy("doc_id")))
    return kept.where((F.col(n) == 0) | (F.col(copy) == 1)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id")
