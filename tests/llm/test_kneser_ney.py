"""The n-gram model against a plain dictionary model, and the query against its contract."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import kneser_ney as kn


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens_of(text):
    return [w for w in re.split("[ \t-\r]+", lowered(text)) if w] + ["</s>"]


class Plain:
    """Modified Kneser-Ney by its formula, over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [None] * (order + 1)
        padded = [["<s>"] * (order - 1) + tokens_of(t) for t in texts]
        self.raw = Counter(w for t in texts for w in tokens_of(t))
        self.counts[order] = Counter(tuple(p[i : i + order]) for p in padded for i in range(len(p) - order + 1))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.follow = [None] * (order + 1), [None] * (order + 1)
        for k in range(1, order + 1):
            n = Counter(self.counts[k].values())
            self.discount[k] = kn.discounts_of(n[1], n[2], n[3], n[4])
            self.follow[k] = defaultdict(list)
            for g, c in self.counts[k].items():
                self.follow[k][g[:-1]].append(c)

    def p(self, gram, k=None):
        k = self.order if k is None else k
        if k == 0:
            return 1 / (len(self.raw) + 1)
        gram = gram[-k:]
        lower, seen = self.p(gram, k - 1), self.follow[k].get(gram[:-1])
        if not seen:
            return lower
        d, c = self.discount[k], self.counts[k].get(gram, 0)
        return (c - d[min(c, 3)]) / sum(seen) + sum(d[min(x, 3)] for x in seen) / sum(seen) * lower

    def score(self, text):
        t = ["<s>"] * (self.order - 1) + tokens_of(text)
        return sum(math.log10(self.p(tuple(t[i : i + self.order]))) for i in range(len(t) - self.order + 1))


def corpus(n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)] + ["Été", "Don't", "中文。", "x" * 300]
    draw = lambda: " ".join(rng.choice(words, rng.integers(0, 60), p=(w := 1 / np.arange(1, len(words) + 1)) / w.sum()))
    texts = [draw() for _ in range(n)]
    return [*texts, texts[0], texts[0], "", None, "  \t\n", " alone here", "END end", " lead and trail \r\n"]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("bucket_bytes", [1 << 30, 200])
def test_scores_equal_the_formula(llm, rows, order, bucket_bytes, monkeypatch):
    monkeypatch.setattr(kn, "HELD_GRAMS", 500)
    monkeypatch.setattr(kn, "SCORED", 37)
    texts = corpus()
    model = kn.train(rows("text string", *[(t,) for t in texts[:50]]), order, bucket_bytes)
    plain = Plain(texts[:50], order)
    assert (model.tokens, model.vocabulary) == (sum(plain.raw.values()), len(plain.raw))
    got = {r["row"]: r for r in kn.score(rows("row long, text string", *enumerate(texts)), model).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k]["n_tokens"] == len(tokens_of(text))
        assert got[k]["n_known"] == sum(w in plain.raw for w in tokens_of(text))
        assert got[k]["score"] == pytest.approx(plain.score(text), rel=1e-9)


def test_probabilities_add_up_to_one(llm, rows):
    texts = [t for t in corpus() if t]
    model = kn.train(rows("text string", *[(t,) for t in texts]), 2, 500)
    known = sorted({w for t in texts for w in tokens_of(t)})
    last = np.array([kn.word_hash(b"" if w == "</s>" else w.encode()) for w in known] + [12345], np.uint64)
    for word in ("w0", "w7", "never seen"):
        before = np.full(len(last), kn.word_hash(word.encode()), np.uint64)
        assert model.probability([before, last]).sum() == pytest.approx(1)


def test_blocks_are_read_as_written():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 2**64, 500, np.uint64)[rng.integers(0, 50, 500)] for _ in range(3)]
    values = [rng.integers(0, 2**40, 500)]
    got_columns, got_values = kn.unpacked(kn.packed(columns, values))
    assert sorted(zip(*columns, *values)) == sorted(zip(*got_columns, *got_values))


def test_query(llm, rows, tmp_path):
    texts = corpus()
    data = [(k if k != 5 else None, t, "x", 1) for k, t in enumerate(texts)]
    rows("doc_id long, text string, n_tokens string, score int", *data, data[3]).write.parquet(f"{tmp_path}/documents.parquet")
    got = kn.op13_kneser_ney(llm, str(tmp_path)).collect()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    train = [r[1] for r in [*data, data[3]] if crc(r[0]) % 10]
    plain = Plain(train, kn.ORDER)
    total, size = sum(plain.raw.values()), len(plain.raw)
    assert len(got) == len(data) + 1
    for row in got:
        text = texts[5 if row["doc_id"] is None else row["doc_id"]]
        assert row["held_out"] == (crc(row["doc_id"]) % 10 == 0) and row["train_tokens"] == total
        base = sum(math.log10((plain.raw[w] + 0.1) / (total + 0.1 * (size + 1))) for w in tokens_of(text))
        assert row["base_score"] == pytest.approx(base) and row["score"] == pytest.approx(plain.score(text))


def test_empty_table_and_nothing_to_learn(llm, rows, tmp_path):
    rows("doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert kn.op13_kneser_ney(llm, f"{tmp_path}/a").collect() == []
    model = kn.train(rows("text string"))
    assert kn.score(rows("row long, text string", (1, "a b")), model).first()["score"] == 0
