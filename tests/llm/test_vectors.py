"""Blocks of the vector join against brute force, and what the join copies."""

import numpy as np
from pyspark.sql import functions as F

from llm import common, vectors


def brute(unit, times, cosine):
    n = len(unit)
    near = (unit @ unit.T >= cosine) & ~np.eye(n, dtype=bool)
    least = np.arange(n)
    for _ in range(n):
        least = np.array([min([least[i], *least[near[i]]]) for i in range(n)])
    return (near * times).sum(1), least


def test_strips_find_the_links_and_pieces_of_a_whole_block(monkeypatch):
    monkeypatch.setattr(vectors, "PAIRS", 100, raising=False)
    random = np.random.default_rng(5)
    turn = np.deg2rad(np.concatenate([random.permutation(40) * 9.0, [100.5, 250.2]]))  # a chain that many strips join
    unit = np.stack([np.cos(turn), np.sin(turn)], 1)
    cls, times = random.permutation(len(unit)) + 7, random.integers(1, 4, len(unit))
    linked, _ = brute(unit, times, 0.98)
    order = np.argsort(cls)
    _, place = brute(unit[order], times[order], 0.98)
    piece = dict(zip(cls[order].tolist(), cls[order][place].tolist()))
    side = lambda m: {"cls": cls[m], "times": times[m], "unit": unit[m]}
    got = {c: (n, p) for c, n, p in zip(*map(list, vectors.links_of_block(side(slice(None)), None, 0.98)))}
    assert got == {c: (n, piece[c]) for c, n in zip(cls.tolist(), linked) if n}
    left, right = np.arange(len(unit)) % 2 == 0, np.arange(len(unit)) % 2 == 1
    found = vectors.links_of_block(side(left), side(right), 0.98)
    across = (unit[left] @ unit[right].T >= 0.98) * np.outer(times[left], times[right])
    assert found[1].sum() == ((across > 0) * times[right]).sum() + ((across > 0).T * times[left]).sum()


def test_vectors_that_angles_tell_apart_badly_are_copied_little(spark, monkeypatch):
    rows = np.random.default_rng(3).standard_normal((6000, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    kept = {}
    staged = common.staged

    def noted(df, what):
        kept[what] = staged(df, what)
        return kept[what]

    monkeypatch.setattr(vectors.common, "staged", noted)
    got = vectors.range_join(table)
    dealt = kept["dealt"]
    assert dict(dealt.dtypes)["embedding"] == "array<float>"
    assert dealt.agg(F.sum(F.size("cells"))).first()[0] <= len(rows)
    unit = vectors.unit(rows.astype(float))
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate(want.tolist()))
