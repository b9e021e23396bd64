"""Records of delimited files whose quoted cells may hold line breaks, read in splits.

Whether a line break ends a record depends on how many quotes stand before it in the file. Spark reads the files
as lines, in byte ranges. A first pass tells of every range the parity of its quotes, and how many records begin in
it for either parity that it may begin with; a running parity over the ranges of each file then says which of the two
holds. The second pass turns the lines of each range into records by themselves. A record that crosses ranges is
put together from the end of the range it begins in and the heads of those it goes on in.

The driver holds one row per byte range, as it does when it plans a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Range = tuple[str, int]  # file and first byte
NUMBER = "_number"
_BLANK = ("", "\r")


def physical_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, block, value): lines in file order within each byte range; a carriage return stays at the line's end."""
    text = spark.read.option("lineSep", "\n").text(list(paths))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, pa.Array]]:
    """Lines of one byte range at a time, in pieces of batches."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column("file"), batch.column("block")
        new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield (file[a].as_py(), block[a].as_py()), batch.column("value").slice(a, b - a)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy().astype(np.int64)


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, pa.array(_BLANK)).to_numpy(zero_copy_only=False)


FACTS = "file string, block long, quotes long, odd_lines long, even_records long, odd_records long, first string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range; first: the first record of a file."""
    key, row, head = None, None, None

    def done():
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], **row}], schema=schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), *((c, pa.int64()) for c in ("quotes", "odd_lines", "even_records", "odd_records")), ("first", pa.string())])
    for found, lines in _ranges(batches):
        if found != key:
            if key is not None:
                yield done()
            key, head = found, [] if found[1] == 0 else None
            row = {"quotes": 0, "odd_lines": 0, "even_records": 0, "odd_records": 0, "first": None}
        quotes, blank = _quotes(lines), _blank(lines)
        before = (row["quotes"] + np.cumsum(quotes) - quotes) & 1
        row["even_records"] += int(((before == 0) & ~blank).sum())
        row["odd_records"] += int(((before == 1) & ~blank).sum())
        row["odd_lines"] += int((quotes & 1).sum())
        row["quotes"] += int(quotes.sum())
        at = 0
        while head is not None and at < len(lines):
            line = lines[at].as_py()
            if head or line not in _BLANK:
                head.append(line)
            if head and "\n".join(head).count('"') % 2 == 0:
                row["first"], head = "\n".join(head).removesuffix("\r"), None
            at += 1
    if key is not None:
        yield done()


@dataclass
class Layout:
    """What the ranges of some files hold, in the order of the files."""

    files: list[str] = field(default_factory=list)
    first: dict[str, str] = field(default_factory=dict)  #: the first record of each file
    base: dict[Range, int] = field(default_factory=dict)  #: records, headers left out, before each range
    odd: set[Range] = field(default_factory=set)  #: ranges that begin within a quoted cell
    going_on: set[Range] = field(default_factory=set)  #: ranges whose last record goes on in the next one
    owner: dict[Range, Range] = field(default_factory=dict)  #: range in which the record begins that goes on here
    number: dict[Range, int] = field(default_factory=dict)  #: number of the record that goes on from a range
    rows: int = 0

    def add(self, file: str, ranges: list) -> None:
        self.files.append(file)
        odd, owner = 0, None
        for k, r in enumerate(ranges):
            key = (file, r["block"])
            self.base[key] = self.rows
            if odd:
                self.odd.add(key)
                self.owner[key] = owner
            self.rows += r["odd_records"] if odd else r["even_records"]
            if r["first"] is not None:
                self.first[file] = r["first"]
                self.rows -= 1
            if not (odd and r["odd_lines"] == 0):  # else all of it belongs to one cell
                owner = key
            odd = (odd + r["quotes"]) & 1
            if odd and k + 1 < len(ranges):
                self.going_on.add(key)
                self.number[owner] = self.rows - 1


def path_of(uri: str) -> str:
    """Path of a file without scheme and authority."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", uri)


def layout_of(spark: SparkSession, paths: Sequence[str]) -> Layout:
    """Layout of all files below the paths, in the order of the paths, then by name."""
    ranges: dict[str, list] = {}
    # collected: a local iterator would read the ranges in as many jobs, one after another
    for row in physical_lines(spark, paths).mapInArrow(_facts, FACTS).collect():
        ranges.setdefault(row["file"], []).append(row)
    roots = {path_of(p).rstrip("/"): k for k, p in reversed(list(enumerate(paths)))}

    def place(file: str) -> tuple[int, str]:
        parts = unquote(path_of(file)).split("/")
        return next((roots[top] for n in range(len(parts), 0, -1) if (top := "/".join(parts[:n])) in roots), len(roots)), file

    layout = Layout()
    for file in sorted(ranges, key=place):
        layout.add(file, sorted(ranges[file], key=lambda r: r["block"]))
    return layout


RECORDS = f"record string, header int, {NUMBER} long"
PIECES = "file string, owner long, block long, text string"


def _reader(layout: Layout, header: dict[str, int], pieces: bool):
    """Second pass: the records of each range; or, as pieces, what of a range belongs to a record that crosses it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, head, held, skip, number = None, 0, None, [], False, 0

        def batch(records: list[str] | pa.Array) -> pa.RecordBatch:
            nonlocal skip, number
            records = pa.array(records, pa.string())
            records = records.filter(pa.array(~_blank(records)))
            if skip and len(records):
                records, skip = records.slice(1), False
            if pc.any(pc.ends_with(records, "\r")).as_py():
                records = pc.replace_substring_regex(records, r"\r\z", "")
            first, number = number, number + len(records)
            return pa.RecordBatch.from_arrays([records, pa.array(np.full(len(records), header[key[0]], np.int32)), pa.array(np.arange(first, number))],
                                              ["record", "header", NUMBER])

        def finished():
            if pieces:
                texts = [(layout.owner.get(key), head)] if head else []
                texts += [(key, held)] if held and key in layout.going_on else []
                rows = [{"file": key[0], "owner": o[1], "block": key[1], "text": "\n".join(t)} for o, t in texts if o]
                return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("text", pa.string())]))
            return batch(["\n".join(held)] if held and key not in layout.going_on else [])

        for found, lines in _ranges(batches):
            if found != key:
                if key is not None:
                    yield finished()
                key, held = found, []
                odd, number, skip = int(key in layout.odd), layout.base[key], key[1] == 0 and key[0] in layout.first
                head = [] if odd else None  # lines of a record that began before this range
                in_head = bool(odd)
            quotes = _quotes(lines)
            before = (odd + np.cumsum(quotes) - quotes) & 1
            after = int(odd + quotes.sum()) & 1
            odd = after
            if not before.any() and not after and not held:
                in_head = False
                if not pieces:
                    yield batch(lines)
                continue
            text, starts, out = lines.to_pylist(), np.flatnonzero(before == 0).tolist(), []
            first = starts[0] if starts else len(text)
            if in_head:
                if pieces:
                    head += text[:first]
                in_head = not starts and bool(after)
            else:
                held += text[:first]
            if held and (starts or not after):
                out.append("\n".join(held))
                held = []
            for a, b in zip(starts, [*starts[1:], len(text)]):
                if b == len(text) and after:
                    held = text[a:b]
                else:
                    out.append(text[a] if b == a + 1 else "\n".join(text[a:b]))
            if not pieces:
                yield batch(out)
        if key is not None:
            yield finished()

    return read


def records(spark: SparkSession, paths: Sequence[str], layout: Layout, header: dict[str, int]) -> DataFrame:
    """(record, header, _number): the records of all files but their first ones, numbered without gaps in file order.

    header numbers the headers; files that it does not name have no records.
    """
    whole = physical_lines(spark, paths).mapInArrow(_reader(layout, header, False), RECORDS)
    if not layout.owner:
        return whole
    crossing = sorted({file for file, _ in layout.owner})
    part = physical_lines(spark, [unquote(f) for f in crossing]).mapInArrow(_reader(layout, header, True), PIECES)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    # as many groups as ranges that a record leaves; a group is the text of one record
    one = part.groupBy("file", "owner").agg(F.rtrim(joined, F.lit("\r")).alias("record"))
    facts = [(file, block, header[file], layout.number[file, block]) for file, block in layout.number]
    told = spark.createDataFrame(facts, f"file string, owner long, header int, {NUMBER} long")
    return whole.unionByName(one.join(told, ["file", "owner"]).select("record", "header", NUMBER))
