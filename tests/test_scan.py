"""Landing files: quoted line breaks, ragged lines, any preview length, refusals."""

import csv
import io
import random

import pyarrow.parquet as pq
import pytest

from siteshift.operators.lookups import ea_denominators
from siteshift.sources import scan


def extract(tmp_path, text):
    path = tmp_path / "x.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    df = scan.scan_extract(spark, extract(tmp_path, '﻿A,"B\nb"\n1,"x\ny"\n2,"say ""hi"""\n3\n4,\n5,NA\n'))
    assert df.columns == ["A", "B\nb"]
    assert [tuple(r) for r in df.collect()] == [("1", "x\ny"), ("2", 'say "hi"'), ("3", None), ("4", None), ("5", None)]


@pytest.mark.parametrize("line", ["1,2,3", "1,2,", "1,2,3,4"])
def test_longer_lines_fail(spark, tmp_path, line):
    df = scan.scan_extract(spark, extract(tmp_path, f"A,B\n{line}\n"))
    with pytest.raises(Exception, match="more than 2 cells"):
        df.select("A").collect()


def test_any_preview_length(spark, tmp_path):
    df = scan.scan_extract(spark, extract(tmp_path, "A\n" + "1\n" * 500), row_id=True)
    head, counts = scan.preview_table(df, 400)
    assert head.count() == 400 and tuple(counts.first()) == (500, 400)
    with pytest.raises(ValueError):
        scan.preview_table(df, 0)


def test_units_without_row_id_are_refused(spark):
    with pytest.raises(ValueError, match="row id"):
        ea_denominators(spark.createDataFrame([("1", "EA", "9")], "MATNR string, MEINH string, UMREN string"))


@pytest.fixture
def small_splits(spark):
    """Files are read in ranges of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def written(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("longest", [1, 12, 400])
def test_quoted_breaks_over_many_ranges(spark, tmp_path, small_splits, end, longest):
    """Cells with breaks, quotes and commas, longer than several ranges; numbered without gaps in file order."""
    rng = random.Random(longest)
    pieces = ["x", "\n", '"', ",", "\r\n", '""', " ", "é", "\n\n", "line"]
    cell = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(1, longest))) if rng.random() < 0.4 else f"v{rng.random()}"
    rows = [(str(k), cell(), cell()) for k in range(200)]
    path = extract(tmp_path, written([("ID", "A\nB", "C"), *rows], end) + end)
    df = scan.scan_extract(spark, path, row_id=True)
    got = sorted(map(tuple, df.collect()), key=lambda r: r[3])
    assert df.columns == ["ID", "A\nB", "C", "_row_id"]
    assert [r[3] for r in got] == list(range(200))
    assert [r[:3] for r in got] == rows
    assert df.select("ID").rdd.getNumPartitions() > 10


def test_unclosed_quote_runs_to_the_end(spark, tmp_path, small_splits):
    tail = "\n".join(f"{k},b" for k in range(200))
    got = scan.scan_extract(spark, extract(tmp_path, 'A,B\n1,"x\n' + tail)).collect()
    assert len(got) == 1 and got[0]["A"] == "1"


def test_many_headers_are_one_scan(spark, tmp_path):
    """200 files, 50 headers: columns in first-seen order, one scan, one plan of the same size as for two headers."""
    order, rows, paths = {}, [], []
    for k in range(200):
        names = [f"F{(k % 50 + i) % 60}" for i in range(3 + k % 4)]
        order |= dict.fromkeys(names)
        body = [[f"{k}.{r}.{i}" for i in range(len(names))] for r in range(2)]
        rows += [dict(zip(names, line)) for line in body]
        paths.append(str(tmp_path / f"x{k:03}.csv"))
        (tmp_path / f"x{k:03}.csv").write_text(written([names, *body]), encoding="utf-8")
    df = scan.union_extracts(spark, paths, row_id=True)
    assert df.columns == [*order, "_row_id"]
    got = sorted(df.collect(), key=lambda r: r["_row_id"])
    assert [{c: v for c, v in r.asDict().items() if v is not None and c != "_row_id"} for r in got] == rows
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1


def test_headers_of_one_table_meet_under_technical_names(spark, tmp_path):
    texts = ["Material,Plant,Base unit\n007, 1021 ,EA\n", "matnr,WERKS\n40.0,1025\n", "WERKS,Unused,MATNR\n1000,x,0008\n"]
    paths = []
    for k, text in enumerate(texts):
        paths.append(str(tmp_path / f"{k}.csv"))
        (tmp_path / f"{k}.csv").write_text(text)
    df = scan.union_normalized(spark, paths, "MARC")
    got = [(r["MATNR"], r["WERKS"], r["BESKZ"]) for r in sorted(df.collect(), key=lambda r: r["_row_id"])]
    assert got == [("7", "1021", None), ("40", "1025", None), ("8", "1000", None)]
    assert "Unused" not in df.columns


def test_stored_extracts_are_numbered_in_file_order(spark, tmp_path):
    path = f"{tmp_path}/x.parquet"
    spark.range(1000).selectExpr("cast(id as string) A").repartition(7).write.parquet(path)
    (tmp_path / "y.csv").write_text("A,B\nq,1\nr,2\n")
    df = scan.union_extracts(spark, [path, str(tmp_path / "y.csv")], row_id=True)
    got = sorted(df.collect(), key=lambda r: r["_row_id"])
    assert [r["_row_id"] for r in got] == list(range(1002)) and [r["A"] for r in got[:2]] == ["q", "r"]
    stored = pq.ParquetDataset(path).files
    assert [r["A"] for r in got[2:]] == [a for f in sorted(stored) for a in pq.read_table(f, partitioning=None).column("A").to_pylist()]


def test_valuation_rows_of_the_landing_set_are_worked_out_once(spark, tmp_path, monkeypatch):
    from workload import landing

    plans = {}
    write = landing._csv
    monkeypatch.setattr(landing, "_csv", lambda df, path: (plans.update({path: df._jdf.queryExecution().optimizedPlan().toString()}), write(df, path)))
    landing._write_families(spark, "/root/testdata/sf0.001", str(tmp_path))
    worked_out = [p for p, plan in plans.items() if "Aggregate" in plan]
    assert worked_out == [f"{tmp_path}/S_MBEW#FreeText.csv"]
    same = [spark.read.csv(f"{tmp_path}/{name}#FreeText.csv", header=True).select("MATNR").collect() for name in ("S_MBEW", "X_S_MARC")]
    assert sorted(same[0]) == sorted(same[1]) and same[0]
