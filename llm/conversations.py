"""Conversation structure repair by dynamic programming over a grammar.

Each row of a conversation, by turn, becomes one symbol: the initial of its role (s, u, a, or x for any other), a
capital where its text is truncated, D where it is blank or repeats an earlier role and text and must go.  Rounds of
pair replacement over the distinct symbol strings (Re-Pair: the most frequent neighbours become a rule) give one
grammar for all conversations.  A symbol's transfer matrix holds, from state to state of `(s?(ua)+)?`, the least cost
and the ASCII-least audit that takes it; a rule's is the min-plus product of its two parts', worked out once, its
audits being ropes of theirs.  A conversation is the product over what is left of its string.  Two audits of the
same rows and cost never begin with one another, so the least of parts make the least of the whole.

A long conversation is cut into segments where its sorted rows pass from task to task or reach SEGMENT rows; only its
symbols and its audit, one letter a row, meet in one task, as they do in one cell of the result.

Nulls and ties: null role or text is one space, a null conv_id is a conversation, null turns come first; rows of one
turn go by role, then by the SHA-256 of their text; a conversation without rows has zeros and an empty audit; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import common

#: Rows of a segment; rounds of pair replacement and pairs replaced in each.
SEGMENT, ROUNDS, PAIRS = 4096, 8, 128
#: Costs of the edits, and of leaving a row truncated.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role initial, by state before.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\x0b\x0c\r"


# --- ropes and transfer matrices ---------------------------------------------------------------------- #
# A rope is a string or a pair of ropes; a matrix maps (state before, state after) to (cost, rope).

def joined(a, b):
    return b if a == "" else a if b == "" else (a, b)


def flat(rope) -> str:
    parts, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            parts.append(top)
        else:
            stack += top[::-1]
    return "".join(parts)


def before(a, b) -> bool:
    """Whether rope a is ASCII-less than b; what both share is passed over."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if not isinstance(x, str):
            left += x[::-1]
            right.append(y)
        elif not isinstance(y, str):
            left.append(x)
            right += y[::-1]
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            if x[n:]:
                left.append(x[n:])
            if y[n:]:
                right.append(y[n:])
    return bool(right)


def put(matrix: dict, key, cost: int, rope) -> None:
    held = matrix.get(key)
    if held is None or cost < held[0] or cost == held[0] and before(rope, held[1]):
        matrix[key] = cost, rope


def product(a: dict, b: dict) -> dict:
    out: dict = {}
    for (i, k), (cost, rope) in a.items():
        for (m, j), (more, rest) in b.items():
            if k == m:
                put(out, (i, j), cost + more, joined(rope, rest))
    return out


def _inserts() -> dict:
    """Any number of inserted rows; more than two between two rows never pay."""
    one = {(p, q): (INSERT, "I") for letter in "ua" for p, q in NEXT[letter].items()}
    out = {(p, p): (0, "") for p in range(4)}
    for more in (one, product(one, one)):
        for key, (cost, rope) in more.items():
            put(out, key, cost, rope)
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> dict:
    """Inserted rows, then the row itself."""
    row = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "D":
        left = TRUNCATED if symbol.isupper() else 0
        for p, q in NEXT.get(symbol.lower(), {}).items():
            put(row, (p, q), left, "K")
        for letter in "ua":
            for p, q in NEXT[letter].items():
                put(row, (p, q), REROLE + left, "R")
    return product(INSERTS, row)


SYMBOLS = {x: symbol_matrix(x) for x in "DsuaxSUAX"}


@dataclass(frozen=True)
class Grammar:
    """Pairs by rule in the order they were found; rule k is the letter U+10000 + k."""

    pairs: tuple[str, ...] = ()

    def compressed(self, symbols: str) -> str:
        for k, pair in enumerate(self.pairs):
            symbols = symbols.replace(pair, chr(0x10000 + k))
        return symbols

    def matrices(self) -> dict:
        """The matrix of every symbol and rule, bottom-up."""
        out = dict(SYMBOLS)
        for k, (a, b) in enumerate(self.pairs):
            out[chr(0x10000 + k)] = product(out[a], out[b])
        return out


def pair_grammar(strings: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> Grammar:
    """Grammar of the distinct strings(symbols); each round adds the most frequent pairs that occur twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for s in batch.column("symbols").to_pylist():
                found.update(map("".join, zip(s, s[1:])))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    grammar = Grammar()
    left = common.staged(strings.distinct(), "symbols")
    for k in range(rounds):
        counted = left.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        added = [r["pair"] for r in counted.orderBy(F.desc("n"), "pair").limit(pairs).collect()]
        if not added:
            break
        grammar = Grammar(grammar.pairs + tuple(added))
        if k + 1 < rounds:
            left = common.staged(left.mapInArrow(_replacer(grammar, len(grammar.pairs) - len(added)), "symbols string").where("length(symbols) > 1"), "symbols")
    return grammar


def _replacer(grammar: Grammar, known: int):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column("symbols").to_pylist():
                for k in range(known, len(grammar.pairs)):
                    s = s.replace(grammar.pairs[k], chr(0x10000 + k))
                out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["symbols"])

    return replace


def best_audit(parts: list[str], matrices: dict) -> tuple[int, str]:
    """Least cost and its audit over compressed strings in order."""
    row = {(START, START): (0, "")}
    for part in parts:
        for symbol in part:
            row = product(row, matrices[symbol])
    row = product(row, INSERTS)
    out: dict = {}
    for end in (START, ASSISTANT):
        if (START, end) in row:
            put(out, 0, *row[START, end])
    return out[0][0], flat(out[0][1])


# --- rows to segments --------------------------------------------------------------------------------- #

def conversation_key(conv_id: Column) -> Column:
    """Text that tells conversations apart, null ones too."""
    return F.when(conv_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def faulted(rows: DataFrame) -> DataFrame:
    """Of each row what the structure needs: its fault, role initial and symbol, and what orders it."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = rows.select(
        "conv", "turn", "role", "row", F.unhex(F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x").alias("initial"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    narrow = common.staged(narrow, "faults")
    first = narrow.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise("-")
    symbol = F.when(F.col("fault").isin("b", "d"), "D").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return narrow.join(first, "row", "left").withColumn("fault", fault).select("conv", "turn", "role", "digest", "row", "fault", "initial", symbol.alias("symbol"))


SEGMENT_SCHEMA = ("conv string, segment long, symbols string, rows array<long>, blank long, duplicate long, truncated long, illegal long, "
                  "first_initial string, last_initial string, first_turn long, last_turn long, turns long")
_LEGAL = ("su", "ua", "au")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as segments; turns counts distinct ones."""
    number = TaskContext.get().partitionId() << 33
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
    names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
    held: list[tuple] = []

    def closed():
        nonlocal number
        symbols, initials, faults = ("".join(x) for x in zip(*(h[1:4] for h in held)))
        turns = [t for h in held for t in h[4] if t is not None]
        illegal = sum(initials[k : k + 2] not in _LEGAL for k in range(len(initials) - 1))
        number += 1
        return (held[0][0], number - 1, symbols, [r for h in held for r in h[5]], faults.count("b"), faults.count("d"), faults.count("t"), illegal,
                initials[0], initials[-1], turns[0] if turns else None, turns[-1] if turns else None, sum(a != b for a, b in zip(turns, [None, *turns])))

    for batch in batches:
        conv, turn, symbol, initial, fault, row = (batch.column(c).to_pylist() for c in ("conv", "turn", "symbol", "initial", "fault", "row"))
        out, a = [], 0
        while a < len(conv):
            room = SEGMENT - sum(len(h[5]) for h in held) if held and held[0][0] == conv[a] else SEGMENT
            if held and (held[0][0] != conv[a] or room <= 0):
                out.append(closed())
                held, room = [], SEGMENT
            b = a
            while b < len(conv) and conv[b] == conv[a] and b - a < room:
                b += 1
            held.append((conv[a], "".join(symbol[a:b]), "".join(initial[a:b]), "".join(fault[a:b]), turn[a:b], row[a:b]))
            a = b
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(closed()), types)], names)


# --- audits -------------------------------------------------------------------------------------------- #

AUDIT_SCHEMA = ("conv string, segment long, piece string, state int, start long, gaps long, blank long, duplicate long, truncated long, "
                "illegal long, cost long, audit string")


def pieces(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut after so many rows each; inserted rows belong to the row after them, the last to the last."""
    ends = np.flatnonzero(np.frombuffer(audit.encode(), np.uint8) != ord("I")) + 1
    cuts = [0, *(int(ends[n - 1]) for n in np.cumsum(sizes)[:-1]), len(audit)]
    return [audit[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def walked(piece: str, symbols: str, state: int) -> tuple[list[tuple[int | None, str, int]], int]:
    """What a piece makes: (row or None, letter, state after it) of each row that stays or is put in, and the last state."""
    made, k = [], 0
    for letter in piece:
        if letter in "KR" or letter == "I":
            role = symbols[k].lower() if letter == "K" else "a" if state == USER else "u"
            state = NEXT[role][state]
            made.append((None if letter == "I" else k, letter, state))
        k += letter != "I"
    return made, state


def _auditor(grammar: Grammar):
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = grammar.matrices()
        compressed = lru_cache(1 << 14)(grammar.compressed)
        best = lru_cache(1 << 14)(lambda symbols: best_audit([symbols], matrices))
        names = [x.split()[0] for x in AUDIT_SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in AUDIT_SCHEMA.split(", ")]

        def finished(held: list[dict]) -> list[tuple]:
            parts = [compressed(h["symbols"]) for h in held]
            cost, whole = best(parts[0]) if len(parts) == 1 else best_audit(parts, matrices)
            sums = {c: sum(h[c] for h in held) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
            timed = [h for h in held if h["first_turn"] is not None]
            for a, b in zip(held, held[1:]):
                sums["illegal"] += a["last_initial"] + b["first_initial"] not in _LEGAL
            for a, b in zip(timed, timed[1:]):
                sums["turns"] -= a["last_turn"] == b["first_turn"]
            gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - sums["turns"] if timed else 0
            state, start, out = START, 0, []
            for h, piece in zip(held, pieces(whole, [len(h["symbols"]) for h in held])):
                made, after = walked(piece, h["symbols"], state)
                facts = (gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, whole) if not out else (None,) * 7
                out.append((h["conv"], h["segment"], piece, state, start, *facts))
                state, start = after, start + len(made)
            return out

        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    out += finished(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*finished(held)), types)], names)

    return audit


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that stay or are put in: which, what was done, the new role where it is new, and their place."""
    for batch in batches:
        conv, number, edit, role, place = [], [], [], [], []
        for h in batch.to_pylist():
            made, _ = walked(h["piece"], h["symbols"], h["state"])
            conv += [h["conv"]] * len(made)
            number += [None if k is None else h["rows"][k] for k, _, _ in made]
            edit += [letter for _, letter, _ in made]
            role += [None if letter == "K" else ROLES[state] for _, letter, state in made]
            place += range(h["start"], h["start"] + len(made))
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(number, pa.int64()), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(place, pa.int64())],
                                         ["conv", "row", "edit", "new_role", "position"])


@dataclass(frozen=True)
class Repair:
    """conversations: conv and its audit; rows: conv, position, role, text and edit of the repaired rows."""

    conversations: DataFrame
    rows: DataFrame
    grammar: Grammar


def repair(rows: DataFrame) -> Repair:
    """Cheapest repair of the conversations of rows(conv, turn, role, text); conv is a text and never null."""
    rows = common.staged(rows.select("conv", F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
                         .withColumn("row", F.monotonically_increasing_id()), "rows")
    order = ["conv", "turn", "role", "digest", "row"]
    sorted_rows = common.staged(faulted(rows), "symbols").repartitionByRange(*order).sortWithinPartitions(*order)
    segments = common.staged(sorted_rows.select("conv", "turn", "symbol", "initial", "fault", "row").mapInArrow(_segments, SEGMENT_SCHEMA), "segments")
    grammar = pair_grammar(segments.select("symbols"))
    audits = segments.drop("rows").repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(_auditor(grammar), AUDIT_SCHEMA)
    audits = common.staged(audits, "audits")
    edits = segments.select("segment", "symbols", "rows").join(audits.select("conv", "segment", "piece", "state", "start"), "segment")
    edits = common.staged(edits.mapInArrow(_edits, "conv string, row long, edit string, new_role string, position long"), "edits")
    stay = edits.where("row is not null").drop("conv").join(rows, "row").select("conv", "position", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    new = edits.where("row is null").select("conv", "position", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return Repair(audits.where("audit is not null").drop("segment", "piece", "state", "start"), stay.unionByName(new), grammar)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which come sorted; only the hash's state is held."""
    conv, state = None, None
    for batch in batches:
        done = []
        for c, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            if c == conv:
                state.update(b"\n")
            else:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            state.update(line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], ["conv", "sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "sha256"])


def line_digests(rows: DataFrame) -> DataFrame:
    """conv, sha256: of the lines `role:text` of each conversation of a repair's rows.

    One hash runs over a conversation's lines in order, so they pass one task, streamed and never held together.
    """
    lines = rows.select("conv", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "position").select("conv", "line").mapInArrow(_digests, "conv string, sha256 string")


# --- the damage of the query ------------------------------------------------------------------------ #

def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text after the query's damage, by crc32(`conv_id:turn`) % 20; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = rows.where(kind != 0).withColumn("times", F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))))
    return rows.select(conversation_key(F.col("conv_id")).alias("conv"), "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"))


def op12_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired = repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    found = every.join(repaired.conversations, "conv", "left").join(line_digests(repaired.rows), "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
