"""Conversation repair against a search over whole audits and plain dynamic programming."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from llm import conversations as cv

LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    """rows: (conv_id, turn, role, text) -> the rows after damage, by conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range((kind != 0) + (kind == 3)):
            out.setdefault(conv, []).append((turn, "user" if kind == 4 else role, text))
    for some in out.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) by plain dynamic programming, row by row over the last states, every insert tried."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    front = {"": (0, "", ())}

    def spread(front):
        for _ in range(3):
            for state, (cost, audit, made) in list(front.items()):
                for role in "ua":
                    if role in step[state]:
                        better(front, role, (cost + 3, audit + "I", (*made, (role, None))))
        return front

    def better(front, state, value):
        if state not in front or value[:2] < front[state][:2]:
            front[state] = value

    for k, ((_, role, text), fault) in enumerate(zip(rows, faults(rows))):
        new = {}
        for state, (cost, audit, made) in spread(front).items():
            better(new, state, (cost + 4, audit + "D", made))
            if fault not in "bd":
                more = 3 if fault == "t" else 0
                if role[:1] in step[state]:
                    better(new, step[state][role[:1]], (cost + more, audit + "K", (*made, (role[0], k))))
                for to in "ua":
                    if to in step[state]:
                        better(new, to, (cost + more + 3, audit + "R", (*made, (to, k))))
        front = new
    return min(v for s, v in spread(front).items() if s in ("", "a"))


def expected(rows):
    cost, audit, made = cheapest(rows)
    kinds = Counter(faults(rows))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    lines, letters = [], [x for x in audit if x != "D"]
    for (role, k), letter in zip(made, letters):
        name = {"u": "user", "a": "assistant"}.get(role)
        lines.append(f"{name}:" if k is None else f"{rows[k][1] if letter == 'K' else name}:{rows[k][2]}")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds["b"], kinds["d"], kinds["t"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def invented(n=120, seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", None, "tool", "", "ui", "User"]
    texts = ["Hello.", "ok", "Why?  \n", "", None, " \t", "Yes!", "é. 中", "a. ", "line\nbreak."]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 4, 6, 9, 30])):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), role, f"{turn} said." if rng.random() < 0.5 else rng.choice(texts)))
    long = [(n, t, "user" if t % 3 else "assistant", f"t{t}" + "." * (t % 5 > 0)) for t in range(900)]
    return [*rows, *rows[:40], *long, (None, 3, "user", "Null here."), (None, None, None, None), (-(2**63), 2**62, "system", "Be nice.")]


def as_rows(found):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found.collect()}


@pytest.mark.parametrize("segment", [4096, 7])
def test_query(llm, rows, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    data = invented()
    rows("conv_id long, turn long, role string, text string, conv string, row int", *[(*r, "x", 1) for r in data]).write.parquet(f"{tmp_path}/conversations.parquet")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    after = damage(data)
    want = {conv: expected(after[conv]) if conv in after else nothing for conv in {r[0] for r in data}}
    assert as_rows(cv.op12_grammar_repair(llm, str(tmp_path))) == want
    assert {len(want[c][6]) > 100 for c in want} == {True, False}


def test_audits_are_the_least_of_all():
    """Against every audit of up to five letters over up to three rows."""
    matrices = cv.Grammar(("ua", "au", "\U00010000\U00010000", "DD", "uU")).matrices()
    grammar = cv.Grammar(("ua", "au", "\U00010000\U00010000", "DD", "uU"))
    for n in range(4):
        for symbols in map("".join, itertools.product("DsuaxSUA", repeat=n)):
            best = None
            for size in range(n, 6):
                for audit in map("".join, itertools.product("DIKR", repeat=size)):
                    if size - audit.count("I") != n:
                        continue
                    options, cost, k, ok = [""], 0, 0, True
                    for letter in audit:
                        symbol = symbols[k] if letter != "I" else ""
                        if letter == "D":
                            cost += 4
                        elif letter == "I":
                            cost, options = cost + 3, [o + r for o in options for r in "ua"]
                        else:
                            ok = ok and symbol != "D"
                            cost += 3 * symbol.isupper() + 3 * (letter == "R")
                            options = [o + r for o in options for r in (symbol.lower() if letter == "K" else "ua")]
                        k += letter != "I"
                    if ok and any(LEGAL.fullmatch(o) for o in options) and (best is None or (cost, audit) < best):
                        best = cost, audit
            assert cv.best_audit([grammar.compressed(symbols)], matrices) == best, symbols


def test_grammar_is_shared_and_short(llm, rows):
    texts = ["ua" * k for k in range(1, 40)] + ["s" + "ua" * 20, "uuD" * 11]
    grammar = cv.pair_grammar(rows("symbols string", *[(t,) for t in texts]), 6, 8)
    assert len(grammar.pairs) <= 48 and max(len(grammar.compressed(t)) for t in texts) <= 10
    plain = cv.SYMBOLS
    for t in texts:
        assert cv.best_audit([grammar.compressed(t)], grammar.matrices()) == cv.best_audit([t], plain)


def test_repaired_rows(llm, rows):
    found = cv.repair(rows("conv string, turn long, role string, text string", ("c", 1, "assistant", "Hi."), ("c", 2, "user", "No end")))
    got = [tuple(r) for r in found.rows.orderBy("position").select("position", "role", "text", "edit").collect()]
    assert got == [(0, "user", "", "I"), (1, "assistant", "Hi.", "K")]
    assert found.conversations.first()["audit"] == "IKD"


def test_empty(llm, rows, tmp_path):
    rows("conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert cv.op12_grammar_repair(llm, str(tmp_path)).collect() == []
