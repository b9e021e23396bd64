"""Landing-folder sources and sinks: all-text scans of extract files.

An *extract* is one entry of a landing folder: a file, or a folder of part files. Every delimited
file begins with its header; all files of a family are one scan, whatever headers they have.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteshift.layouts import ALIASES, NA_TOKENS, REQUIRED
from siteshift.sources import records
from siteshift.sources.normalize import ROW_ID, normalize_extract, resolve_header


class ExtractNotFound(FileNotFoundError):
    """No extract matches."""


# --------------------------------------------------------------------------- #
# Finding extracts
# --------------------------------------------------------------------------- #

def list_extracts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, modification time in ms) of the entries of a landing folder, by name. Metadata only."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    entries = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)]
    return sorted(e for e in entries if not e[0].startswith(("_", ".")))


def matches(name: str, prefix: str, extensions: Sequence[str]) -> bool:
    return name.startswith(prefix) and name.lower().endswith(tuple(extensions))


def select_family(spark: SparkSession, folder: str, prefix: str,
                  extensions: Sequence[str] = (".csv",)) -> list[str]:
    """Paths of the extracts of one family."""
    return [f"{folder}/{name}" for name, _ in list_extracts(spark, folder) if matches(name, prefix, extensions)]


def latest_extract(spark: SparkSession, folder: str, label: str,
                   extensions: Sequence[str] = (".csv", ".parquet")) -> str:
    """Path of the newest extract whose name contains ``label`` in any case."""
    hits = [(modified, name) for name, modified in list_extracts(spark, folder)
            if label.lower() in name.lower() and name.lower().endswith(tuple(extensions))]
    if not hits:
        raise ExtractNotFound(f"no extract matching {label!r} in {folder}")
    newest = max(modified for modified, _ in hits)
    return f"{folder}/{next(name for modified, name in hits if modified == newest)}"


# --------------------------------------------------------------------------- #
# Reading
# --------------------------------------------------------------------------- #

def dedup_header(header: Iterable[str]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` ...; blank ones a positional name."""
    header = [h if h else f"Unnamed: {i}" for i, h in enumerate(header)]
    taken, out, next_suffix = set(header), [], {}
    seen: set[str] = set()
    for h in header:
        name = h
        if h in seen:
            n = next_suffix.get(h, 1)
            while f"{h}.{n}" in taken:
                n += 1
            name, next_suffix[h] = f"{h}.{n}", n + 1
            taken.add(name)
        seen.add(name)
        out.append(name)
    return out


def header_cells(record: str) -> list[str]:
    """Column names of a header record, repeated names resolved; a name may hold a quoted line break."""
    cells = next(csv.reader(io.StringIO(record.removeprefix("\ufeff"), newline="")), [])
    return dedup_header(cells)


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def parsed_cells(rows: DataFrame, width: Column, most: int) -> DataFrame:
    """``rows`` with ``_cells``: the cells c0, c1 ... of each record, NULL beyond its last one.

    A record with more cells than its header's ``width`` fails the read, as nothing tells what the rest means. A
    shorter one is filled up with empty cells first, so that the parser sees one width.
    """
    record = F.col("record")
    bare = F.when(record.contains('"'), F.regexp_replace(record, '"(?:[^"]|"")*+(?:"|$)', "")).otherwise(record)
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    longer = F.raise_error(F.concat(F.lit("a line has more than "), width.cast("string"), F.lit(" cells: "), record)).cast("string")
    full = F.when(commas >= width, longer).otherwise(F.concat(record, F.repeat(F.lit(","), F.lit(most - 1) - commas)))
    schema = ", ".join(f"c{i} STRING" for i in range(most))
    return rows.withColumn("_cells", F.from_csv(full, schema, {"escape": '"', "emptyValue": "", "maxColumns": str(max(20480, most + 1))}))


Resolver = Callable[[Sequence[str]], Sequence[tuple[int, str]]]


def _as_they_are(header: Sequence[str]) -> list[tuple[int, str]]:
    return list(enumerate(header))


def read_csv(spark: SparkSession, paths: Sequence[str], row_id: bool = False, resolve: Resolver = _as_they_are) -> DataFrame:
    """CSV extracts of any headers as nullable text columns in first-seen order, missing-value texts as NULL: one scan.

    Every file tells its header; ``resolve`` says which of its positions become which columns. A header is a row of
    positions by column, joined to the records by the number of their header, so the plan does not grow with the
    headers. Cells may hold line breaks, and files are split for all that.
    """
    layout = records.layout_of(spark, paths)
    texts: dict[str, int] = {}
    header = {file: texts.setdefault(layout.first[file], len(texts)) for file in layout.files if file in layout.first}
    names = [header_cells(text) for text in texts]
    kept = [dict((name, position) for position, name in reversed(list(resolve(cells)))) for cells in names]
    ordered = [[name for _, name in resolve(cells)] for cells in names]
    columns = list(dict.fromkeys(name for some in ordered for name in some))
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    most = max(len(cells) for cells in names)
    rows = records.records(spark, paths, layout, header)
    if len(names) == 1:
        found = parsed_cells(rows, F.lit(most), most)
        cells = [F.col(f"_cells.c{kept[0][name]}") for name in columns]
    else:
        # as many rows as distinct headers, which were all read here
        placed = spark.createDataFrame([(k, len(names[k]), [kept[k].get(name) for name in columns]) for k in range(len(names))],
                                       "header int, _width int, _at array<int>")
        found = parsed_cells(rows.join(F.broadcast(placed), "header"), F.col("_width"), most)
        found = found.select(records.NUMBER, "_at", F.array(*[F.col(f"_cells.c{i}") for i in range(most)]).alias("_cells"))
        cells = [F.get("_cells", F.get("_at", F.lit(j))) for j in range(len(columns))]
    return found.select(*[na_to_null(c).alias(name) for c, name in zip(cells, columns)],
                        *([F.col(records.NUMBER).alias(ROW_ID)] if row_id else []))


def read_parquet(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """A Parquet extract as text; row ids are gapless in the order of its files and of the rows in them."""
    raw = spark.read.parquet(path)
    cells = [F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns]
    if not row_id:
        return raw.select(*cells)
    file = F.col("_metadata.file_path")
    counts = {r["file"]: r["n"] for r in raw.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, before = 0, []
    for name in sorted(counts):
        before.append((name, first))
        first += counts[name]
    numbered = raw.select(*cells, file.alias("_file"), F.col("_metadata.row_index").alias("_index"))
    told = spark.createDataFrame(before, "_file string, _before long")  # as many rows as files
    return numbered.join(F.broadcast(told), "_file").select(*[f"`{c}`" for c in raw.columns], (F.col("_before") + F.col("_index")).alias(ROW_ID))


def scan_extract(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """One extract, all text."""
    return read_parquet(spark, path, row_id) if path.lower().endswith(".parquet") else read_csv(spark, [path], row_id)


def union_extracts(spark: SparkSession, paths: Sequence[str], row_id: bool = False, resolve: Resolver = _as_they_are) -> DataFrame:
    """All extracts of a family, columns in first-seen order, absent columns NULL.

    Delimited extracts are one scan whatever their headers. No path gives an empty table. Row ids number the
    delimited extracts, then each stored one, in the order of the paths.
    """
    stored = [p for p in paths if p.lower().endswith(".parquet")]
    delimited = [p for p in paths if p not in stored]
    frames = [read_csv(spark, delimited, row_id, resolve)] if delimited else []
    for path in stored:
        one = read_parquet(spark, path, row_id)
        kept = resolve([c for c in one.columns if c != ROW_ID])
        frames.append(one.select(*[F.col(f"`{one.columns[i]}`").alias(name) for i, name in kept], *([ROW_ID] if row_id else [])))
    frames = [f for f in frames if f.columns]
    if not frames:
        return spark.createDataFrame([], T.StructType([]))
    if row_id and len(frames) > 1:
        first = 0
        for k, frame in enumerate(frames):
            frames[k] = frame.withColumn(ROW_ID, F.col(ROW_ID) + first)
            first += frame.count() if k + 1 < len(frames) else 0
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_normalized(spark: SparkSession, paths: Sequence[str], table: str, required_only: bool = True, row_id: bool = True) -> DataFrame:
    """Extracts of one table under any headers - labels, aliases, technical names - as its normalised rows, in one scan."""
    def resolve(header: Sequence[str]) -> list[tuple[int, str]]:
        kept, _ = resolve_header(header, table)
        return [(i, name) for i, name in kept if not required_only or name in REQUIRED[table]]

    return normalize_extract(union_extracts(spark, paths, row_id, resolve), table, required_only)


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows, in the layout the transformation reads; of other tables the material alone."""
    columns = REQUIRED.get(table, ["MATNR"])
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


# --------------------------------------------------------------------------- #
# Combining and writing
# --------------------------------------------------------------------------- #

def combined_name(family: str, source_type: str) -> str:
    return f"{family}_{source_type}_combined"


def combined_path(root: str, family: str, source_type: str, fmt: str = "csv") -> str:
    return f"{root}/{family}/{source_type}/{combined_name(family, source_type)}.{fmt}"


def sink_combined(df: DataFrame, root: str, family: str, source_type: str, fmt: str = "parquet") -> str:
    """Write a combined table; Parquet keeps empty text and NULL apart."""
    path = combined_path(root, family, source_type, fmt)
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def extract_stats(spark: SparkSession, folder: str, families: Mapping[str, str], source_type: str,
                  extensions: Sequence[str] = (".csv",)) -> DataFrame:
    """Per family: source files and rows, zero for a family without files."""
    listed = {family: select_family(spark, folder, prefix, extensions) for family, prefix in families.items()}
    stats = None
    for family, paths in listed.items():
        one = union_extracts(spark, paths).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(f"{family}_{source_type}").alias("name"), F.lit(family).alias("family"),
            F.lit(source_type).alias("source_type"),
            F.lit(len(paths)).cast("bigint").alias("source_files"), "row_count")
        stats = one if stats is None else stats.unionByName(one)
    return stats


def fetch_families(spark: SparkSession, landing: str, root: str, families: Mapping[str, str],
                   source_type: str, extensions: Sequence[str] = (".csv",), fmt: str = "parquet") -> dict[str, str]:
    """Combine every family of a landing folder and write it; family -> written path."""
    written = {}
    for family, prefix in families.items():
        paths = select_family(spark, landing, prefix, extensions)
        combined = union_extracts(spark, paths) if paths else empty_table(spark, family)
        written[family] = sink_combined(combined, root, family, source_type, fmt)
    return written


def fetch_summary(spark: SparkSession, landing: str, root: str, families: Mapping[str, str],
                  source_type: str, extensions: Sequence[str] = (".csv",)) -> DataFrame:
    """Combine and write every family; per family its files, rows and path, with the number of all files."""
    written = fetch_families(spark, landing, root, families, source_type, extensions)
    files = {family: len(select_family(spark, landing, prefix, extensions)) for family, prefix in families.items()}
    rows = None
    for family, path in written.items():
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(f"{family}_{source_type}").alias("name"), F.lit(family).alias("family"),
            F.lit(source_type).alias("source_type"), F.lit(files[family]).cast("bigint").alias("source_files"),
            "row_count", F.lit(path).alias("saved_path"), F.lit(sum(files.values())).cast("bigint").alias("total_files_fetched"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def load_reference(spark: SparkSession, root: str, folder: str, table: str, required: bool = True) -> DataFrame | None:
    """Latest combined extract of a reference table, reduced to the columns the rules read."""
    try:
        path = latest_extract(spark, f"{root}/{folder}/ECC", combined_name(folder, "ECC"))
    except ExtractNotFound:
        if required:
            raise
        return None
    if table not in ALIASES:
        raise ValueError(f"{table} is not a reference table")
    return normalize_extract(scan_extract(spark, path, row_id=True), table, required_only=True)


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame | None]:
    """The three reference tables of a combined folder; purchasing groups are optional."""
    return {
        "MARA": load_reference(spark, root, "MARA", "MARA"),
        "MARM": load_reference(spark, root, "MARM", "MARM"),
        "EKGRP": load_reference(spark, root, "EKGRP_UPDATED", "EKGRP", required=False),
    }


def preview_table(df: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """First rows in ingest order, and the (total_rows, preview_row_count) row."""
    if limit < 1:
        raise ValueError("limit must be positive")
    head = df.orderBy(ROW_ID).limit(limit).drop(ROW_ID)
    total = F.count(F.lit(1))
    return head, df.agg(total.alias("total_rows"), F.least(total, F.lit(limit).cast("bigint")).alias("preview_row_count"))
