"""Words and word n-grams of UTF-8 text as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a maximal run of word bytes. Its hash is a polynomial over random byte codes modulo 2**64, taken from
prefix sums, so a buffer of many documents costs a few vector operations and no Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time. Longer documents are hashed in pieces that end between words.
PIECE = 1 << 18

_MULT = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (that of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


class Alphabet:
    """Which bytes make words, with A-Z folded to a-z."""

    def __init__(self, is_word: np.ndarray) -> None:
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT)) | np.uint64(1)
        codes[65:91] = codes[97:123]
        self.codes = np.where(is_word, codes, np.uint64(0))
        self.is_word = is_word


def _alnum() -> np.ndarray:
    b = np.arange(256)
    return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


def _not_space() -> np.ndarray:
    b = np.arange(256)
    return (b != 32) & ~((b >= 9) & (b <= 13))


#: 0-9, a-z and everything beyond ASCII.
ALNUM = Alphabet(_alnum())
#: All but ASCII white space.
NOT_SPACE = Alphabet(_not_space())


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _hash_piece(raw: np.ndarray, cuts: np.ndarray, abc: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in raw; cuts are positions that words do not cross."""
    n = len(raw)
    inside = abc.is_word[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(abc.codes[raw] * _powers(_MULT, n), out=sums[1:])
    inverse = _powers(pow(_MULT, -1, 1 << 64), n)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(column: pa.Array, abc: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column, row after row, and the n + 1 offsets of the rows in them."""
    raw, offs = text_buffers(column)
    found, places = [], []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            stop = abc.is_word[raw[at:end]]
            row_ends = offs[np.searchsorted(offs, at, "right") : np.searchsorted(offs, end, "right")]
            gap = np.flatnonzero(~stop)
            last = max(int(gap[-1]) + 1 + at if len(gap) else 0, int(row_ends[-1]) if len(row_ends) else 0)
            if last > at:
                end = last
            else:  # a word longer than a piece
                rest = np.flatnonzero(~abc.is_word[raw[end:]])
                row_end = int(offs[np.searchsorted(offs, end, "left")])
                end = min(row_end, int(rest[0]) + end if len(rest) else len(raw))
        cuts = offs[np.searchsorted(offs, at, "right") : np.searchsorted(offs, end, "left")] - at
        h, s = _hash_piece(raw[at:end], cuts, abc)
        found.append(h)
        places.append(s + at)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offs)


def prefix_hashes(column: pa.Array, abc: Alphabet, lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the first bytes of each word, for each of some lengths, and the offsets of the rows in them."""
    raw, offs = text_buffers(column)
    if not len(raw):
        return [np.zeros(0, np.uint64) for _ in lengths], np.zeros(len(offs), np.int64)
    inside = abc.is_word[raw]
    before = np.append(False, inside[:-1])
    before[offs[(offs > 0) & (offs < len(raw))]] = False
    starts = np.flatnonzero(inside & ~before)
    row_end = offs[np.searchsorted(offs, starts, "right")] if len(starts) else starts
    out = []
    for n in lengths:
        h, live = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
        for j in range(n):
            at = np.minimum(starts + j, len(raw) - 1)
            live &= (starts + j < row_end) & inside[at]
            h = np.where(live, h * np.uint64(_MULT) + abc.codes[raw[at]], h)
        out.append(mix(h + np.uint64(n)))
    return out, np.searchsorted(starts, offs)


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of hashes[i : i + k] for each i; row bounds are the caller's to mind."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_MULT)
        out += hashes[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out = values[:n].copy()
    for j in range(1, w):
        np.minimum(out, values[j : j + n], out=out)
    return out


def rows(offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        yield i, a, b
