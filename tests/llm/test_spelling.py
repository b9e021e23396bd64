"""Spelling variants against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import spelling, words


def plain_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return rows


def invented(n=700, seed=5):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("aeinrstéà"), rng.integers(5, 9))) for _ in range(60)]
    found = set(stems)
    while len(found) < n:
        w = list(stems[rng.integers(len(stems))])
        for _ in range(rng.integers(1, 3)):
            at, letter = rng.integers(len(w)), "aeinrstéàçÉ÷"[rng.integers(12)]
            if rng.random() < 0.5:
                w[at] = letter
            else:
                w.insert(at, letter)
        found.add("".join(w))
    return {w: int(5 * 3 ** rng.integers(0, 6)) for w in sorted(found) if len(w) >= 6}


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in (("CELL", 40), ("LEAF", 3), ("CELL_SAMPLE", 20)):
        monkeypatch.setattr(spelling, name, value)


def as_rows(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


@pytest.mark.parametrize("cells", ["small", "one"])
def test_variants_equal_all_comparisons(llm, rows, cells, request):
    if cells == "small":
        request.getfixturevalue("small_cells")
    n = invented() | {"z" * 300 + "abc": 9, "z" * 300 + "abd": 90, "abcdef": 7, "abcdfe": 700, "bcdef" + "g" * 2: 5}
    got = spelling.spelling_variants(rows("word string, n long", *n.items()))
    assert as_rows(got) == plain_variants(n)


def test_hashes_of_runs(llm):
    import pyarrow as pa

    texts = pa.array(["Abcdef ÀÉabc x" + "y" * 90, None, "", "abcdef-abcdefĀzzzzzz"])
    found = words.latin_words(texts, 6)
    prefixes = [b"12:", b"3:", b"", b"-7:"]
    want = [zlib.crc32(prefixes[t] + found.distinct[c]) for t, c in zip(found.text, found.code)]
    assert spelling.run_hashes(prefixes, found).tolist() == want and len(want) == 5


def test_query(llm, rows, tmp_path, small_cells):
    rng = np.random.default_rng(2)
    vocabulary = sorted(invented(200))
    weight = 1 / np.arange(1, len(vocabulary) + 1) ** 1.4
    drawn = [rng.choice(vocabulary, 400, p=weight / weight.sum()) for _ in range(60)]
    docs = [(k, " ".join(v.title() if k % 3 else v for v in some)) for k, some in enumerate(drawn)]
    docs += [(None, " ".join(["nullish words"] * 9)), (61, None), (62, ""), (63, "no, 1; words中"), docs[0], docs[0], (64, "x" * 5000 + " " + "longtext " * 5)]
    rows("doc_id long, text string, word string, n int", *[(*d, "a", 1) for d in docs]).write.parquet(f"{tmp_path}/documents.parquet")
    n = plain_words(docs)
    assert any(len(w) == len("nullish") for w in n) and len(n) > 100
    assert as_rows(spelling.op11_spelling_kd(llm, str(tmp_path))) == plain_variants(n)


def test_empty(llm, rows, tmp_path):
    rows("doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op11_spelling_kd(llm, str(tmp_path)).collect() == []
