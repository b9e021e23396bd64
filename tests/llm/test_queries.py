"""Registered queries against their contracts, by brute force on one fixture of odd rows."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

import __spark_entry__ as contract
from llm import queries

WITH_SQL = {"op4", "op5"}
WITHOUT_SQL = {"pipeline", *(f"op{n}" for n in range(1, 14))} - WITH_SQL


def documents():
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "the of and Straße été don't x=1 中文 ÉTÉ".split() for b in ("", "s", ",", "ing", "\n\n", "7")]
    texts = [" ".join(rng.choice(words, rng.integers(1, 400))) for _ in range(24)]
    texts += [None, "", " ", texts[0], texts[0], "word " * 3000, "\t\n \r\n", "no spaces" + "x" * 900]
    ids = [*range(len(texts) - 2), -(2**40), 2**40]
    return list(zip(ids, texts))


@pytest.fixture(scope="module")
def folder(llm, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    data = [(i, t, "en", "hot" if i % 3 else "cold", len(t or ""), "clash", 1) for i, t in documents()]
    llm.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, start string, size int").write.parquet(f"{path}/documents.parquet")
    pages = [(k, f"http://h{k % 3}.example/{k % 5}", h) for k, h in enumerate(["<p>a</p>", "<p>a</p>", None, "", "é" * 500, "<p>a</p>", "b"])]
    llm.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def by_id(llm, name, folder):
    return {r["doc_id"]: r for r in queries.QUERIES[name](llm, folder).collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_queries_without_sql_are_these():
    missing = set(contract.queries()) - set(contract.oracle_sql())
    assert {q.split("_")[0] for q in missing} <= WITHOUT_SQL
    assert {q.split("_")[0] for q in queries.QUERIES} == (WITHOUT_SQL | WITH_SQL) - {"pipeline"}
    assert {q.split("_")[0] for q in queries.ORACLE} == WITH_SQL


def test_op1(llm, folder):
    got = {r["page_id"]: r for r in queries.QUERIES["op1_external_index_merge"](llm, folder).collect()}
    payloads = {0: "<p>a</p>", 1: "<p>a</p>", 2: "", 3: "", 4: "é" * 500, 5: "<p>a</p>", 6: "b"}
    first = {}
    for page, text in payloads.items():
        leader = first.setdefault(text, page)
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        row = got.pop(page)
        assert (row["payload_bytes"], row["payload_digest"]) == (len(text.encode()), digest)
        assert (row["record_type"], row["refers_to"]) == (("response", None) if leader == page else ("revisit", leader))
    assert not got


def word_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in documents()}


def test_op2(llm, folder):
    got, start = by_id(llm, "op2_token_files", folder), 0
    for doc, ids in sorted(word_ids().items()):
        ids = [*ids, 2]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(documents())


def test_op6(llm, folder):
    got, sizes, slots = by_id(llm, "op6_min_cost_flow", folder), defaultdict(int), defaultdict(list)
    for doc, text in documents():
        row, data = got[doc], (text or "").encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
    assert set(sizes) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op7(llm, folder):
    pieces, ids = defaultdict(list), word_ids()
    sequences = defaultdict(list)
    for r in queries.QUERIES["op7_minimum_bin_slack"](llm, folder).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc, rows in pieces.items():
        own, at = [*ids[doc], 1], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[at : at + r["length"]])
            at += r["length"]
        assert at == len(own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op8(llm, folder):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(llm, "op8_overlapping_chunks", folder)
    for doc, text in documents():
        text = text or ""
        ids = whole.encode_ordinary(text)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op9_takes_ids_at_the_ends_of_longs(llm, rows, tmp_path):
    ids = [-(2**63), 2**63 - 1, 0, None, -5]
    rows("doc_id long, text string", *[(i, f"{k} " + "some words here to print " * 5) for k, i in enumerate(ids)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(llm, "op9_closed_syncmers", str(tmp_path))
    assert set(got) == set(ids)
    text = {i: f"{k} " + "some words here to print " * 5 for k, i in enumerate(ids)}
    order = [2**63 - 1, 0, -5, -(2**63), None]
    for doc, after in zip(order, [*order[1:], order[0]]):
        half = len(text[doc]) // 2
        assert got[doc]["edited_sha256"] == hashlib.sha256((text[doc][: len(text[doc]) - half] + text[after][:half]).encode()).hexdigest()
