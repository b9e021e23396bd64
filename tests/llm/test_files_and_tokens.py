"""Archives, id files, packing, byte-level BPE, fingerprints, resharding and vectors against brute force."""

import base64
import gzip
import hashlib
import itertools
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import byte_bpe, common, packing, resharding, syncmers, token_files, tokens, vectors, warc
from llm.tokens import WordTokenizer, worker_tokenizer

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, start long, ids string, file string, row long, source string"

TEXTS = [
    None, "", " ", "Plain words, and more; don't stop it's 12,5%.x", "ÉÈ été naïve ÀÖ Œuvre ẞ H̱a İstanbul ΣΑΣ", "日本語 と 한국어 <|endoftext|>", "a\x1cb c d\te\r\n", "é combined ́ alone",
    "x" * 700, "word " * 900, "line\n\n\n  end   ", "same", "same", "😀👍🏽 emoji--dash__under", "tail of three words",
]


def docs_of(rows, texts=TEXTS, ids=None):
    ids = ids or range(len(texts))
    return rows(DOCS, *((i, t, 7, "x", "f", 1, f"s{k % 3}") for k, (i, t) in enumerate(zip(ids, texts))))


@pytest.fixture(scope="module")
def word_ids():
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_tokenizer_equals_the_library(word_ids):
    encoder = WordTokenizer(WORD, cache_words=5)
    for end in (None, 2):
        ids, at = encoder.encode(pa.array(TEXTS), end)
        for text, a, b in zip(TEXTS, at[:-1], at[1:]):
            assert ids[a:b].tolist() == word_ids(text) + ([] if end is None else [end])


def test_a_worker_tokenizes_a_word_once_over_its_tasks(word_ids, monkeypatch):
    texts = [*TEXTS, "Été ÉTÉ été ÿ Þing straße WORD Word word x1 1x ½"]
    worker_tokenizer(WORD).encode(pa.array(texts), 2)
    monkeypatch.setattr(worker_tokenizer(WORD), "_tokenize", lambda words: pytest.fail(f"again: {words}"))
    ids, at = worker_tokenizer(WORD).encode(pa.array(texts[::-1]), 2)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [word_ids(t) + [2] for t in texts[::-1]]


def test_the_table_of_words_is_bounded_and_keeps_the_words_used_last(word_ids, monkeypatch):
    encoder, tokenized = WordTokenizer(WORD, cache_words=40), []
    inner = encoder._tokenize
    encoder._tokenize = lambda words: tokenized.extend(words.to_pylist()) or inner(words)
    for k in range(60):
        texts = [f"always here n{k} " + " ".join(f"word{'abcdefghij'[k % 10]}{'xyz'[i % 3] * (k % 7 + i)}" for i in range(9)), None, "always"]
        ids, at = encoder.encode(pa.array(texts), None)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [word_ids(t) for t in texts]
        assert len(encoder._words) == len(encoder._ids) == len(encoder._used) <= 40
    assert tokenized.count("always") == tokenized.count("here") == 1
    monkeypatch.setattr(tokens, "CACHE_BYTES", 10_000)
    for text in ("long" * 5000, "a b", "x" * 20_000 + " y"):
        ids, at = encoder.encode(pa.array([text]), None)
        assert ids.tolist() == word_ids(text) and encoder._words.nbytes <= 10_000
    for nothing in ([], [None], ["", " "]):
        ids, at = encoder.encode(pa.array(nothing, pa.string()), None)
        assert len(ids) == 0 and at.tolist() == [0] * (len(nothing) + 1)
        ids, at = encoder.encode(pa.array(nothing, pa.string()), 2)
        assert ids.tolist() == [2] * len(nothing) and at.tolist() == list(range(len(nothing) + 1))


def test_files_rank_any_ids_by_frequency_then_value():
    ids = np.array([2**32 - 1, 7, 7, 0, 2**32 - 1, 9, 7], np.uint32)
    blob = token_files.file_bytes([5, None], np.array([3, 4]), ids)
    assert np.frombuffer(blob, "<u4", 4, token_files._HEAD.size).tolist() == [7, 2**32 - 1, 0, 9]
    doc_ids, sizes, got = token_files.read_bytes(blob)
    assert doc_ids == [5, None] and sizes.tolist() == [3, 4] and (got == ids).all()


def test_letters_that_end_in_a_mark_before_punctuation(word_ids):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L"]
    marked = [c for c in letters if unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] != "L"]
    assert "İ" in marked and "\u0958" in marked and "\ufb2a" in marked
    texts = [f"{c}{p} a{c}{p}b" for c in marked + ["a", "é", "日", "ڪ", "٣"] for p in (".", "-,")]
    ids, at = WordTokenizer(WORD).encode(pa.array(texts), None)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [word_ids(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
@pytest.mark.parametrize("most", [200, 70_000, 2**32 - 1])
def test_variable_length_codes_round_trip(n, most):
    ranks = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    control, data = token_files.pack_ranks(ranks)
    assert (token_files.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_id_files_read_back_in_order(rows, llm, word_ids):
    ids = [None, *range(40, 40 + len(TEXTS) - 1)]
    random.Random(1).shuffle(ids)
    docs = docs_of(rows, TEXTS, ids).repartition(4)
    folder = common.new_folder(llm, "test")
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    manifest = token_files.write_token_files(llm, docs, WORD, 2, folder, ids_a_file=300)
    llm.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert manifest.count() > 1
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, text) in zip(got, sorted(zip(ids, TEXTS), key=lambda x: (x[0] is not None, x[0] or 0))):
        assert (r.doc_id, r.start, r.ids) == (doc_id, at, word_ids(text) + [2])
        at += len(r.ids)
    empty = token_files.write_token_files(llm, rows(DOCS), WORD, 2, folder)
    assert token_files.read_token_files(empty, folder).collect() == []


def test_rows_that_repeat_have_their_own_place(rows, llm):
    folder = common.new_folder(llm, "test")
    docs = docs_of(rows, ["b c", "a", "a"], [5, 5, 5])
    got = token_files.read_token_files(token_files.write_token_files(llm, docs, WORD, None, folder), folder).collect()
    assert [r.doc_id for r in got] == [5] * 3 and len({r.start for r in got}) == 3


def test_best_filling_equals_exhaustive_search():
    r = random.Random(3)
    for _ in range(60):
        counts = {r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(0, 8))}
        capacity = r.randint(0, 60)
        chosen = packing.best_filling(counts, capacity)
        reach = {0}
        for length, n in counts.items():
            reach = {a + length * k for a in reach for k in range(n + 1) if a + length * k <= capacity}
        assert sum(x * n for x, n in chosen.items()) == max(reach) and all(n <= counts[x] for x, n in chosen.items())


def test_packing_places_every_id_once(rows, word_ids):
    texts = TEXTS + [" ".join(f"w{i}" for i in range(n)) for n in (3, 30, 300, 900, 1200, 2500)]
    docs = docs_of(rows, texts, [None, *range(1, len(texts))]).repartition(2)
    sequences = packing.pack(docs, WORD, 1, window=256, pool_tokens=1500)
    got = packing.piece_digests(sequences).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text in zip([None, *range(1, len(texts))], texts):
        ids, at = np.array(word_ids(text) + [1], "<u4"), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    assert packing.pack(rows(DOCS), WORD, 1).collect() == []


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (7, 3), (32768, 1024)])
def test_chunks_encode_as_the_library(rows, chunk, overlap):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = TEXTS + ["a " * 500 + "'re we'll 123abc  \n\n x", "   " * 90 + "y", "'s't" * 60]
    docs = docs_of(rows, texts, [None, *range(1, len(texts))])
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap)
    got = {r.doc_id: r for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert len(got) == len(texts)
    for doc_id, text in zip([None, *range(1, len(texts))], texts):
        assert got[doc_id].ids == plain.encode_ordinary(text or "")
        assert bytes(got[doc_id].bytes) == (text or "").encode()


@pytest.mark.parametrize("blank", ["\n\n", "\r\n\r\n", "\t\t", "\n \n\n"])
def test_chunks_that_begin_after_blank_lines(rows, blank):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    chunk, overlap = 40, 12
    texts = ["x" * offset + f"a{blank}b" + " c" * 70 for offset in range(chunk + 2)] + [f"a{blank}b" * 40]
    encoded = byte_bpe.encode(docs_of(rows, texts), RANKS, public_tokenizers.PATTERN, chunk, overlap)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert sorted(got.values()) == sorted(plain.encode_ordinary(t) for t in texts)


def test_byte_bpe_of_empty_table(rows):
    assert byte_bpe.decode(byte_bpe.encode(rows(DOCS), RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


def spark_hash(values, width, seed=42):
    """xxhash64 of longs one after the other, each with the last hash as its seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_anchor_places(text, k, s):
    found = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in found]
    hashes = [h - 2**64 if h >= 2**63 else h for h in hashes]
    mers = hashes
    for round_ in range(1, s):
        mers = [spark_hash((a, b), 8) for a, b in zip(mers, hashes[round_:])]
    width = k - s + 1
    return [i for i in range(len(found) - k + 1) if min(mers[i], mers[i + width - 1]) == min(mers[i : i + width])], len(found)


def test_anchors_are_closed_syncmers(rows):
    texts = [" ".join(f"v{random.Random(i * n).randrange(50)}" for i in range(n)) for n in (7, 8, 9, 60)] + [None, "", "--", "one", "Ünï cödé wörds, 12 and mòre of thém hère"]
    docs = rows(DOCS, *((i, t, 1, "x", "f", 1, "s") for i, t in enumerate(texts)))
    got = {r.doc_id: r.a for r in docs.select("doc_id", syncmers.anchors(F.coalesce("text", F.lit(""))).alias("a")).collect()}
    for i, text in enumerate(texts):
        places, n = brute_anchor_places(text, syncmers.K, syncmers.S)
        assert len(got[i]) == (len(places) if n >= syncmers.K else int(bool(text)))


def test_texts_without_closed_kmers_have_an_anchor(rows):
    r = random.Random(3)
    texts = [" ".join(f"v{r.randrange(10**6)}" for _ in range(n)) for n in range(8, 13) for _ in range(40)]
    bare = [t for t in texts if not brute_anchor_places(t, syncmers.K, syncmers.S)[0]]
    assert {len(t.split()) for t in bare} >= {8, 9, 10}
    near = [f"{t} more" for t in bare if len(t.split()) == 8]
    docs = rows("doc_id long, text string", *enumerate(bare + near))
    got = {x.doc_id: x for x in docs.select("doc_id", "text", syncmers.anchors(F.col("text")).alias("a")).collect()}
    assert all(len(got[i].a) == 1 for i in range(len(bare))) and len({got[i].a[0] for i in range(len(bare))}) == len(bare)
    # the copy has two k-mers: its anchor is that of the text where it keeps the least or the same closed one
    eights = {got[i].text: got[i].a for i in range(len(bare))}
    shared = [set(eights[got[i].text.removesuffix(" more")]) & set(got[i].a) for i in range(len(bare), len(got))]
    assert any(shared)


def test_fingerprints_and_the_next_document(rows, llm, monkeypatch, tmp_path):
    monkeypatch.setattr(syncmers, "CELL_ROWS", 2)
    r = random.Random(5)
    texts = [" ".join(f"v{r.randrange(9)}é" for _ in range(n)) for n in r.choices(range(40), k=50)] + [None, "", "😀" * 9]
    ids = r.sample(range(10**6), len(texts))
    rows("doc_id long, text string, source string", *zip(ids, texts, itertools.repeat("s"))).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in syncmers.op9_closed_syncmers(llm, str(tmp_path)).collect()}
    ordered = sorted(zip(ids, (t or "" for t in texts)), reverse=True)
    assert len(got) == len(texts)
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[1][:half]
        x = got[doc_id]
        assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        other = got[following[0]]
        a, b, e = (set(f.split()) for f in (x.fingerprint, other.fingerprint, x.edited_fingerprint))
        dice = lambda p, q: 2 * len(p & q) / (len(p) + len(q)) if p or q else 1.0
        assert x.near_next == pytest.approx(dice(a, b)) and x.near_edited == pytest.approx(dice(a, e))


def test_next_document_of_ties_and_single_rows(rows):
    docs = rows("doc_id long, text string", (3, "b"), (3, "b"), (3, "a"), (None, "n"), (1, "c"))
    got = sorted((r.doc_id or 0, r.text, r.next_text) for r in syncmers.with_next(docs, ["text"]).collect())
    assert [x[:2] for x in got] == [(0, "n"), (1, "c"), (3, "a"), (3, "b"), (3, "b")]
    assert sorted(x[2] for x in got) == ["a", "b", "b", "c", "n"] and ("c", "n") in [x[1:] for x in got]
    one = rows("doc_id long, text string", (3, "b"))
    assert [r.next_text for r in syncmers.with_next(one, ["text"]).collect()] == ["b"]
    assert syncmers.with_next(rows("doc_id long, text string"), ["text"]).collect() == []


def test_flow_moves_the_fewest_bytes():
    r = random.Random(11)
    for _ in range(30):
        supply = {i: r.randint(0, 60) for i in range(r.randint(1, 5))}
        capacity = {i: r.randint(0, 40) for i in range(r.randint(1, 5))}
        capacity[0] = capacity.get(0, 0) + max(0, sum(supply.values()) - sum(capacity.values()))
        flow = resharding.min_cost_flow(supply, capacity, lambda a, b: int(a != b))
        for i, n in supply.items():
            assert sum(v for (a, _), v in flow.items() if a == i) == n
        for i, n in capacity.items():
            assert sum(v for (_, b), v in flow.items() if b == i) <= n
        assert sum(v for (a, b), v in flow.items() if a == b) == sum(min(n, capacity.get(i, 0)) for i, n in supply.items())


def test_shards_even_out_and_keep_every_row(rows, llm):
    r = random.Random(2)
    texts = [None, ""] + ["é" * r.randint(0, 200) for _ in range(400)]
    docs = docs_of(rows, texts, [None, *range(1, len(texts))]).select("doc_id", "text", "source").repartition(3)
    docs = docs.union(docs.limit(1))
    old = resharding.write_old(docs, F.when(F.col("source") == "s0", 0).otherwise(F.pmod("doc_id", F.lit(9))), common.new_folder(llm, "old"))
    new = resharding.reshard(old, 8, common.new_folder(llm, "new")).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    got = resharding.slots(new).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(((x.doc_id, x.text) for x in docs.collect()), key=str)
    total, slots = defaultdict(int), defaultdict(list)
    for x in got:
        assert x.size == len((x.text or "").encode()) + 1
        total[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert sorted(total) == list(range(8)) and max(total.values()) - min(total.values()) <= 402
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    none = resharding.write_old(docs.limit(0), F.lit(0), common.new_folder(llm, "old"))
    assert resharding.reshard(none, 8, common.new_folder(llm, "new")).count() == 0


def test_loser_tree_merges():
    r = random.Random(4)
    for k in range(12):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_archives_read_back_by_the_merged_index(rows, llm):
    html = ["<p>same</p>"] * 5 + [None, "", "é\r\n\r\nWARC/1.1\r\n", "x" * 5000] + [f"<b>{i}</b>" for i in range(60)]
    urls = [None, "", "not a url", "http://[bad", "https://www.B.example.com:8443/A?q=1#f"]
    pages = rows("page_id long, url string, html string, offset long, archive string", *((i, urls[i] if i < 5 else f"http://h{i % 7}.example.org/p{i % 3}", h, 1, "z") for i, h in enumerate(html, start=0)), (None, "http://n", "<p>same</p>", 1, "z"), (3, urls[3], "<p>same</p>", 1, "z"))
    folder = common.new_folder(llm, "test")
    runs = warc.write_archives(pages.repartition(4), folder, archive_bytes=2000)
    index = warc.merge_runs(runs)
    entries = sorted(index.collect(), key=lambda e: (e.range_no, e.place))
    keys = [(e.url_key, e.timestamp, e.archive, e.offset) for e in entries]
    assert keys == sorted(keys) and len(keys) == len(html) + 2
    got = sorted(warc.read_archives(index, folder).collect(), key=lambda x: (x.page_id is None, x.page_id or 0))
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    for x, (i, h) in zip(got, sorted([*enumerate(html), (3, "<p>same</p>")], key=lambda p: p[0]) + [(None, "<p>same</p>")]):
        data = (h or "").encode()
        revisit = first[h or ""] != i
        assert (x.page_id, x.payload_bytes, x.payload_digest) == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (x.record_type, x.refers_to) == (("revisit", first[h or ""]) if revisit else ("response", None))
    system, path = common.filesystem(folder)
    with system.open_input_file(f"{path}/{entries[0].archive}") as source:
        assert gzip.decompress(source.read()).startswith(b"WARC/1.1\r\n")  # members follow each other
    empty = warc.write_archives(pages.limit(0), folder)
    assert warc.read_archives(warc.merge_runs(empty), folder).collect() == []


def test_url_keys():
    assert warc.url_key("https://www.B.example.com:8443/A?q=1#f") == "com,example,b:8443)/a?q=1"
    assert warc.url_key("http://h.org") == "org,h)/" and warc.url_key(None) == ""


@pytest.mark.parametrize("pivots,block", [(1, 7), (9, 2048), (9, 5)])
def test_range_join_equals_brute_force(rows, monkeypatch, pivots, block):
    monkeypatch.setattr(vectors, "CELL", 200 // pivots)
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 6))
    data = [(centres[i % 12] + r.normal(scale=0.25, size=6)).astype(np.float32).tolist() for i in range(150)]
    data += [data[0]] * 20 + [[2 * x for x in data[1]]] + [[1.0, 0.0], [1.0], [0.9, 0.4358898943540674]]
    odd = [None, [], [0.0] * 6, [1.0, None], [float("nan")], [float("inf"), 1.0]]
    table = rows("vec_id long, embedding array<float>, label int, cell long", *((i, v, 0, 1) for i, v in enumerate(data + odd)), (3, data[3], 0, 1)).repartition(3)
    got = sorted((tuple(x) for x in vectors.range_join(table).collect()), key=lambda x: x[:2])
    everything = [(i, np.array([*v, *[0] * (6 - len(v))], np.float32).astype(float)) for i, v in enumerate(data)] + [(3, np.array(data[3], float))]
    units = vectors.unit(np.array([v for _, v in everything]))
    linked = np.einsum("id,jd->ij", units, units) >= 0.9
    np.fill_diagonal(linked, False)
    label = np.array([i for i, _ in everything])
    while True:
        new = np.minimum(label, np.where(linked, label[None], 10**9).min(axis=1))
        if (new == label).all():
            break
        label = new
    want = [(i, int(n), int(c), i == c) for (i, _), n, c in zip(everything, linked.sum(axis=1), label)]
    want += [(len(data) + i, 0, len(data) + i, True) for i in range(len(odd))]
    assert got == sorted(want, key=lambda x: x[:2])
    assert vectors.range_join(table.limit(0)).collect() == []


def test_components_of_chains_and_stars(rows, llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in common.components(llm, rows("a long, b long, component string", *((*e, "x") for e in edges))).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 500: 500, 501: 500}
    assert common.components(llm, rows("a long, b long")).collect() == []
