"""SQL of the training-data queries against the queries themselves, on tables with links and odd rows."""

import duckdb
import pytest

from llm import oracles, queries


def both(llm, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    result = con.execute(oracles.ORACLE[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    got = queries.QUERIES[name](llm, folder)
    assert sorted(got.columns) == sorted(columns)
    return sorted(map(repr, map(tuple, got.select(*columns).collect()))), sorted(map(repr, want))


@pytest.fixture
def folder(llm, tmp_path):
    words = [f"W{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words).lower(), " ".join([*words[:-1], "x"]), " ".join([*words[1:-1], "x"]), " ".join(words[:40]),
             None, "", " \t\n", "one", "ONE", "one two", "é É", " ".join(["a b"] * 50), " ".join(["a b"] * 51), "Straße\x0bgroß\x0ceins zwei"]
    docs = [(i * 7 % 16 - 3, t, "en", "s", 1, "clash") for i, t in enumerate(texts)] + [(2, texts[0], "en", "s", 1, "c")] * 2
    llm.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, class string").write.parquet(f"{tmp_path}/documents.parquet")
    nan, inf = float("nan"), float("inf")
    near = [[1.0, 0.1 * k, 0.0] for k in range(12)]
    vectors = [*near, [2.0, 0.4, 0.0], near[3], [0.0, 0.0, -1.0], [0.0, 0.0, 0.0], None, [1.0, None, 0.0], [nan, 1.0, 0.0], [inf, 0.0, 0.0]]
    data = [(40 - i, v, i % 3) for i, v in enumerate(vectors)]
    llm.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, table", [("op4_set_relation_join", "documents"), ("op5_metric_range_join", "embeddings")])
def test_query_equals_its_sql(llm, folder, name, table):
    got, want = both(llm, name, folder, table)
    assert got == want
    assert len({r.split(",")[-1] for r in got}) < len(got)  # some rows are linked
