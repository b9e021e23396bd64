"""Ids of a public word tokenizer, computed once per distinct word.

The tokenizer drops white space and never joins bytes across it, so a text's ids are the ids of its
white-space separated words in order.  Only ASCII white space is split on; any other white space stays
inside a word and is left to the tokenizer itself.  A letter or digit before ASCII punctuation is
a token boundary, so a space put there changes no id and makes words repeat more; letters that end in a
combining mark when they are composed and lower-cased are none and stay as they are.
Words are made distinct per batch with Arrow's dictionary encoding and their ids are kept in a bounded
Arrow table, so the tokenizer sees each word rarely; a worker keeps its tokenizer and table from task to
task.  Words of Latin letters are one pre-token each and go straight to the tokenizer's model; all others
take its whole path.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 400_000
CACHE_BYTES = 32 << 20

#: Letters whose NFC form or lower case ends in a mark: U+0130 and those that composition leaves apart.
_MARKED = "\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb4e"
#: Another letter, or a digit, before ASCII punctuation.
_PLAIN_BOUNDARY = rf"(\pN|[^\PL{_MARKED}])([!-/:-@\[-`{{-~]+)"

#: Letters whose composed form is their only one and whose lower case is one letter.
_LATIN_WORD = "^[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+$"
#: The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))
}
_LATIN_BYTES = {c: "".join(_BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class WordTokenizer:
    """Batch encoder over one tokenizer file; the result equals ``Tokenizer.encode`` of each whole text."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._model = self._tokenizer.model
        self._words = pa.array([], pa.large_string())
        self._ids = pa.array([], pa.large_binary())
        self._used = np.zeros(0, np.int64)  # the call that used a word last
        self._calls = 0
        self._limit = cache_words

    def _tokenize(self, words: pa.Array) -> pa.Array:
        latin = pc.match_substring_regex(words, _LATIN_WORD)
        words = pc.if_else(latin, pc.utf8_lower(words), words)
        tokenize, whole, ids, ends = self._model.tokenize, self._tokenizer.encode, array("I"), [0]
        for word, plain in zip(words.to_numpy(zero_copy_only=False), latin.to_numpy(zero_copy_only=False)):
            if plain:
                ids.extend([token.id for token in tokenize(word if word.isascii() else word.translate(_LATIN_BYTES))])
            else:
                ids.extend(whole(word, add_special_tokens=False).ids)
            ends.append(len(ids))
        return _binary(np.array(ids, np.uint32), np.array(ends, np.int64))

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Places of the distinct words in the table; words that it does not hold are added to it."""
        # the smaller side is hashed: the table's words are looked up among the batch's
        found = pc.index_in(self._words, value_set=words).fill_null(-1).to_numpy()
        known = np.flatnonzero(found >= 0)
        rows = np.full(len(words), -1, np.int64)
        rows[found[known]] = known
        unknown = rows < 0
        new = words.filter(pa.array(unknown))
        if len(new):
            rows[unknown] = np.arange(len(self._words), len(self._words) + len(new))
            self._ids = pa.concat_arrays([self._ids, self._tokenize(new)])
            self._words = pa.concat_arrays([self._words, new])
            self._used = np.concatenate([self._used, np.zeros(len(new), np.int64)])
        self._calls += 1
        self._used[rows] = self._calls
        return rows

    def _forget(self) -> None:
        """Halves a table beyond its limits; the words used last stay."""
        while len(self._words) > self._limit or self._words.nbytes + self._ids.nbytes > CACHE_BYTES:
            kept = np.zeros(len(self._words), bool)
            kept[np.argsort(-self._used, kind="stable")[: min(self._limit, len(self._words)) // 2]] = True
            self._words, self._ids, self._used = self._words.filter(pa.array(kept)), self._ids.filter(pa.array(kept)), self._used[kept]

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's first position (one more at the end).

        A null text is empty; end_id is appended to each text unless it is None.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring_regex(texts, pattern=_PLAIN_BOUNDARY, replacement=r"\1 \2")
        words = pc.ascii_split_whitespace(texts)
        text_words = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        codes = self._rows(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        table = self._ids
        if end_id is not None:  # one more word, at the end of each text
            codes = np.insert(codes, text_words[1:], len(table))
            text_words = text_words + np.arange(len(text_words))
            table = pa.concat_arrays([table, _binary(np.array([end_id], np.uint32), np.array([0, 1]))])
        self._forget()
        laid = table.take(pa.array(codes))
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1) // 4
        ids = np.frombuffer(laid.buffers()[2], np.uint32, ends[-1]) if ends[-1] else np.zeros(0, np.uint32)
        return ids, ends[text_words]


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, which it keeps for its later tasks."""
    return WordTokenizer(path)
