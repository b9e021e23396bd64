"""The corpus pipeline as a whole against brute force of its four stages, and its stages on odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm import secrets
from tests.llm.test_text_operators import BASE, LIVE, brute_code_length, brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is was for that on with as at by from this have are it be which were their has not".split()
DE = "der die und das von zu mit ist auf für nicht eine als auch es an werden aus er hat dass sie nach über wird".split()


def documents():
    r = random.Random(8)
    docs = []
    for i in range(40):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        docs.append((i, " ".join(r.choices(words, k=r.randrange(30, 200))), lang if i % 5 else None, "hot" if i % 3 else "cold"))
    long = docs[1][1].split()
    docs += [(100, docs[2][1], "de", "other"), (101, " ".join([*long[:-1], "changed"]), "en", "hot"), (102, " ".join(long[: len(long) // 2]), "en", "hot")]
    docs += [(110 + k, f"{docs[4 + k][1]} token = {value} and {docs[6 + k][1]}", "en", owner)
             for k, (value, owner) in enumerate([(LIVE, "hot"), ("Zz9Yy8Xx7Ww6Vv5Uu", "a"), ("Zz9Yy8Xx7Ww6Vv5Uu", "b"), ("Zz9Yy8Xx7Ww6Vv5Uu", "c"), ("plainwordvalue", "hot")])]
    docs += [(120, None, "en", "hot"), (121, "", "en", None), (122, "123 -- 456", None, "hot"), (123, "ЖЩЫБ☃q߿龘" * 9, None, "hot"), (124, "the of", None, None)]
    docs += [docs[3]] * 2  # a row three times
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs]


def identified(docs):
    """Texts with a letter that some language's tree codes below 8 bits a byte."""
    learned = defaultdict(list)
    for d, text, lang, *_ in docs:
        if lang and text is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            learned[lang].append(text)
    kept = []
    for d, text, lang, source, n in docs:
        if text and re.search(r"[^\W\d_]", text):
            bits = {x: brute_code_length(t, text) for x, t in learned.items()}
            best = min(bits, key=lambda x: (bits[x], x))
            if bits[best] < 8 * len(text.encode()):
                kept.append((d, text, lang or best, source, n))
    return kept


def firsts(docs):
    docs = list(dict.fromkeys(docs))
    least = {d: c for d, _, c in brute_components([(d, t) for d, t, *_ in docs], 5, 80)}
    return [x for x in docs if least[x[0]] == x[0]]


def masked(docs):
    found, owners = {}, defaultdict(set)
    for d, text, _, source, _ in docs:
        base = [(m.start(), m.end(), m.group(g)) for _, p, g, least in BASE for m in p.finditer(text) if len(m.group(g)) >= least]
        rare = [(m.start(), m.end(), m.group()) for m in re.finditer(secrets.RARE[1], text) if all(re.search(c, m.group()) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
        found[d] = sorted(base + [x for x in rare if not any(b[0] < x[1] and x[0] < b[1] for b in base)])
        for *_, value in found[d]:
            owners[value].add(source)

    def owned(value):
        kinds = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        return len(owners[value]) == 1 and kinds >= 2 and len(set(value)) >= 8 and not re.search(secrets.PLACEHOLDER, value)

    out = []
    for d, text, lang, source, _ in docs:
        for start, end, value in reversed(found[d]):
            if owned(value):
                text = text[:start] + secrets.MASK + text[end:]
        out.append((d, text, lang, source, len(text)))
    return out


@pytest.fixture(scope="module")
def folder(llm, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    llm.createDataFrame(documents(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_equal_brute_force(llm, folder):
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    want = documents()
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:3], (identified, firsts, masked)):
        docs, want = stage(llm, docs, folder), brute(want)
        rows = [tuple(r) for r in docs.collect()]
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        assert Counter(rows) == Counter(want)
    kept = {d: t for d, t, *_ in want}
    assert kept.keys().isdisjoint({100, 101, 120, 121, 122, 123}) and {102, 124} <= kept.keys()
    assert secrets.MASK in kept[110] and not any(secrets.MASK in kept[d] for d in (111, 112, 113, 114))


def test_run_packs_what_the_stages_keep(llm, folder):
    want = {d: t for d, t, *_ in masked(firsts(identified(documents())))}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(llm, folder).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for d, rows in pieces.items():
        ids, at = [*tokenizer.encode(want[d], add_special_tokens=False).ids, 1], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(own, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_empty_tables_and_nulls(llm):
    schema = f"{COLUMNS}, key string, lang_pred string, __N long, __key long, __copy int, ___copy int, __identified string, __doc string, __text string"
    said = "some words that are said again and again by people who have learned to say them"
    clash = [(k, said, "en", "s", len(said), "k", "p", 1, 2, 3, 4, "i", "d", "t") for k in (5, 4, 4)]
    for data in ([], [(None,) * 14] * 2, clash):
        docs = llm.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:3]:
            found = stage(llm, docs, "")
            assert found.columns == docs.columns and found.count() <= len(data)
            assert set(map(tuple, found.collect())) <= set(data)
        assert corpus_pipeline.pack_sequences(llm, docs, "").count() == len(data)
