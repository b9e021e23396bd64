"""Words of whole texts as runs of bytes, found for a batch at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte tables: A-Z lowered, and the white space of ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Words(NamedTuple):
    """Runs in text order: the text of each, and which of the distinct words it is."""

    text: np.ndarray
    code: np.ndarray
    distinct: list[bytes]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one more at the end); a null text is empty."""
    blob = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(blob.buffers()[1], np.int64, len(blob) + 1, blob.offset * 8)
    return np.frombuffer(blob.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def runs(data: np.ndarray, at: np.ndarray, inside: np.ndarray, least_points: int = 1) -> Words:
    """Maximal runs of the bytes marked inside, A-Z lowered; runs of fewer code points are left out."""
    if not inside.any():
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = after[-1] = False
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = last - first
    kept = LOWER[data[inside]]
    if least_points > 1:
        heads = np.concatenate([[0], np.cumsum((kept & 0xC0) != 0x80)])  # code points begin at other bytes than 10xxxxxx
        ends = np.cumsum(size)
        long = heads[ends] - heads[ends - size] >= least_points
        kept = kept[np.repeat(long, size)]
        first, size = first[long], size[long]
    if not len(first):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return Words(np.searchsorted(at, first, "right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist())


def spaced_words(texts: pa.Array) -> Words:
    """Words between ASCII white space."""
    data, at = text_bytes(texts)
    return runs(data, at, ~SPACE[data])


def latin_words(texts: pa.Array, least_points: int = 1) -> Words:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, which are 0xC3 and the byte after it in UTF-8."""
    data, at = text_bytes(texts)
    lead = data == 0xC3
    inside = _ASCII_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return runs(data, at, inside, least_points)
