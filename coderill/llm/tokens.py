"""Vectorised word hashing over the UTF-8 buffers of Arrow columns.

A word is a maximal run of letters, digits and combining marks of any script, in lower case; each sign of a script that puts
no spaces between words (Han, kana, Thai, Lao, Khmer, Burmese) is a word of its own. All other signs, punctuation of every
script included, separate. A word's 64-bit hash is a polynomial over the bytes, read off one prefix sum, so that no Python
object per word is made.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64)
_ASCII_WORD = np.zeros(256, bool)
for _c in range(128):
    _ASCII_WORD[_c] = chr(_c).isalnum()
#: Ranges of code points whose letters are words of their own.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x323AF))
_classes: list[np.ndarray] = []
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, _U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null as empty) and the offsets of each, from 0."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2] if buffers[2] is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], each independent of where it stands."""
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_RANDOM[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross one of the ``offsets``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _class_of(points: np.ndarray) -> np.ndarray:
    """0 for what separates, 1 for what is in words, 2 for what is a word of its own."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        # letters, marks and numbers; beyond the last assigned plane of letters, nothing is in words
        for c in range(0x80, 0x32400):
            table[c] = unicodedata.category(chr(c))[0] in "LMN"
        for lo, hi in UNSPACED:
            table[lo : hi + 1] *= 2
        _classes.append(table)
    return _classes[0][points]


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of all words of the texts data[offsets[i]:offsets[i+1]], which are valid UTF-8."""
    inside = _ASCII_WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return runs(inside, offsets)
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
    kind = _class_of(point)
    word = kind > 0
    for k in range(4):
        inside[lead[word & (size > k)] + k] = True
    own = kind == 2
    return runs(inside, np.concatenate([offsets, lead[own], lead[own] + size[own]]) if own.any() else offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the offset of its first word (one more at the end)."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = word_runs(data, offsets)
    return run_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def hash_words(words: list[str]) -> np.ndarray:
    """The hash of each word as ``word_hashes`` would give it."""
    got, at = word_hashes(pa.array(words, pa.string()))
    assert len(got) == len(words) and (np.diff(at) == 1).all(), "each must be one word"
    return got


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for every i; documents are not told apart here."""
    if len(words) < n:
        return np.zeros(0, _U)
    last = len(words) - n + 1
    out = words[:last].copy()
    for k in range(1, n):
        out = out * _U(0xD6E8FEB86659FD93) + words[k : k + last]
    return mix(out)
