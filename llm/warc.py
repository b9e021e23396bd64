"""WARC archives with an external index merge.

Writers put records into archives of gzip members and leave, per archive, a capture run: its index entries sorted
by URL key and timestamp.  Runs are dealt by ranges of (URL key, timestamp, archive, offset), each range a task,
and a loser tree merges the sorted pieces of all runs that fall into it; the ranges follow each other, so the
index is one capture history in global order.  Reading goes by the index: each archive's entries in order of
offset, one member at a time.

Of records with equal payloads that with the smallest page_id is the response and the others revisit it.  The
groups of equal payloads are found by digest and joined back through written tables, so that adaptive execution
can split a digest that many pages share.

Nulls and ties: a null html is an empty payload; a null url has an empty URL key and no target URI; a null
page_id never stands for others and is a response where its group has no page_id at all; rows that share the
smallest page_id of their group are all responses; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import common

#: Bytes of payload after which a writer begins a new archive.
ARCHIVE_BYTES = 32 << 20
#: Bytes of archives that a task reads.
READ_BYTES = 16 << 20
EPOCH = "2024-01-01T00:00:00Z"

ENTRY = "url_key string, timestamp string, archive string, offset long, length long, page_id long, record_type string, digest string"
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query, in lower case; the fragment is dropped."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").strip().lower()
    labels = host.removeprefix("www.").split(".")
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower() if host else (url or "").strip().lower()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{salt}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = "".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri}"] if uri else []), f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP length and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return {"headers": headers, "http_length": length, "payload": payload}


class LoserTree:
    """Merges k sorted iterators: an inner node keeps the loser of its match, the root the overall winner."""

    def __init__(self, runs: list[Iterator]):
        self._runs = [iter(r) for r in runs]
        self._k = len(runs)
        self._heads = [next(r, None) for r in self._runs]
        self._losers = [-1] * max(1, self._k)
        for run in range(self._k):
            self._play(run, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self._heads[a] is None:
            return False
        return self._heads[b] is None or (self._heads[a], a) < (self._heads[b], b)

    def _play(self, run: int, building: bool = False) -> None:
        node = (run + self._k) // 2
        while node > 0:
            held = self._losers[node]
            if building and held < 0:
                self._losers[node] = run
                return
            if self._beats(held, run):
                self._losers[node], run = run, held
            node //= 2
        self._losers[0] = run

    def __iter__(self):
        while self._k and self._heads[self._losers[0]] is not None:
            run = self._losers[0]
            yield self._heads[run]
            self._heads[run] = next(self._runs[run], None)
            self._play(run)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' records below folder; returns the capture runs, a written table of index entries.

    Payloads of fewer than least_bytes bytes are never revisited.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = common.staged(groups.where("n > 1").select("sha1", "first"), "groups")
    rows = rows.join(groups, "sha1", "left")
    refers = F.when((F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))) & (F.col("size") >= least_bytes), F.col("first"))

    def write(batches):
        part, entries, members, at, name, number = TaskContext.get().partitionId(), [], [], 0, "", 0

        def flush():
            common.write_file(folder, name, b"".join(members))
            entries.sort(key=lambda e: (e[0], e[1], e[3]))
            columns = list(zip(*entries))
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)

        for batch in common.slices(batches, "html"):
            for page_id, url, text, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if not name:
                    name = f"pages-{part:06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
                payload = text.encode()
                digest = digest_of(payload)
                member = gzip.compress(record(page_id, url, payload, digest, refers_to, EPOCH), 5, mtime=0)
                kind = "response" if refers_to is None else "revisit"
                entries.append((url_key(url), EPOCH, name, at, len(member), page_id, kind, digest))
                members.append(member)
                at += len(member)
                if at >= archive_bytes:
                    yield flush()
                    entries, members, at, name, number = [], [], 0, "", number + 1
        if entries:
            yield flush()

    made = rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(write, ENTRY)
    return common.staged(made, "runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index: entries with range_no and place, in whose order they are the capture history, a written table."""
    keys = ["url_key", "timestamp", "archive", "offset"]

    def merge(batches):
        # a run's entries arrive in their order; where the order breaks another run begins
        pieces, last = [], None
        for batch in batches:
            for entry in zip(*(batch.column(c).to_pylist() for c in [*keys, "length", "page_id", "record_type", "digest"])):
                if last is None or entry[:4] < last:
                    pieces.append([])
                pieces[-1].append((entry[:4], entry[4:]))
                last = entry[:4]
        place, part = 0, TaskContext.get().partitionId()
        merged = iter(LoserTree([[(k, i, j) for j, (k, _) in enumerate(p)] for i, p in enumerate(pieces)]))
        while some := [x for _, x in zip(range(4096), merged)]:
            rows = [(*k, *pieces[i][j][1], part, place + n) for n, (k, i, j) in enumerate(some)]
            place += len(some)
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*keys, "length", "page_id", "record_type", "digest", "range_no", "place"])

    ranged = runs.select(*keys, "length", "page_id", "record_type", "digest").repartitionByRange(*keys)
    schema = "url_key string, timestamp string, archive string, offset long, length long, page_id long, record_type string, digest string, range_no long, place long"
    return common.staged(ranged.mapInArrow(merge, schema), "index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, one row each, with payload size and digest from the archives."""

    def read(batches):
        system, path = common.filesystem(folder)
        source, opened = None, None
        for batch in batches:
            out = []
            for archive, offset, length, key, range_no, place in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length", "url_key", "range_no", "place"))):
                if archive != opened:
                    if source:
                        source.close()
                    source, opened = system.open_input_file(f"{path}/{archive}"), archive
                source.seek(offset)
                found = parse(gzip.decompress(source.read(length)))
                headers = found["headers"]
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and (digest_of(found["payload"]) != digest or len(found["payload"]) != found["http_length"]):
                    raise ValueError(f"payload differs from its digest: {archive} at {offset}")
                number = lambda name: int(headers[name]) if name in headers else None
                out.append((number("X-Page"), found["http_length"], digest, headers["WARC-Type"], number("X-Refers-To-Page"), key, range_no, place))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "range_no", "place"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if source:
            source.close()

    # index entries are small whatever they point at, so the number of tasks follows the bytes of the archives
    tasks = -(-(index.agg(F.sum("length").alias("n")).first()["n"] or 1) // READ_BYTES)
    entries = index.select("archive", "offset", "length", "url_key", "range_no", "place")
    by_archive = entries.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return by_archive.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, range_no long, place long")


def op1_external_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "warc")
    runs = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(merge_runs(runs), folder)
