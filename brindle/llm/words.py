"""Words of whole texts as arrays: a batch of documents is scanned once, without a Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are taken in slabs of bounded size; a
document larger than a slab is cut at white space, so that memory doesn't follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLAB = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        np.multiply(out[:take], np.uint64(pow(base, have, 1 << 64)), out=out[have : have + take])
        have += take
    return out


_POW: np.ndarray | None = None
_INV: np.ndarray | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None or len(_POW) < n:
        size = max(n, SLAB + 4096)
        _POW, _INV = _powers(_PRIME, size), _powers(pow(_PRIME, -1, 1 << 64), size)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of every word."""
    gap = np.empty(len(raw) + 2, np.int8)
    gap[0] = gap[-1] = 1
    gap[1:-1] = _SPACE[raw]
    step = np.diff(gap)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(raw: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: equal words, equal hashes, wherever they stand."""
    if not len(first):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[after] - total[first]) * inverse[first])


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about a slab, cut at white space; a longer single word stays whole."""
    at = 0
    while len(text) - at > SLAB:
        cuts = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, SLAB, at)])
        if len(cuts):
            end = at + int(cuts[-1]) + 1
        else:
            later = [p for p in (text.find(c, at + SLAB) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if p >= 0]
            end = min(later) + 1 if later else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class Slab(NamedTuple):
    """Words of some documents, all in one buffer."""

    docs: list[int]  # positions of the documents in the batch
    ends: np.ndarray  # for each document, the number of words up to its end
    text: bytes
    first: np.ndarray  # of each word, its first byte in text and the byte after its last
    after: np.ndarray
    hashes: np.ndarray


def slabs(texts: list[bytes | None]) -> Iterator[Slab]:
    """The words of a batch, for groups of documents of about a slab; a larger document is a group of its own."""
    group: list[int] = []
    size = 0

    def flush() -> Slab:
        joined = b" ".join(texts[i] or b"" for i in group)
        raw = np.frombuffer(joined, np.uint8)
        first, after = spans(raw)
        ends = np.cumsum([len(texts[i] or b"") + 1 for i in group])
        return Slab(group, np.searchsorted(first, ends), joined, first, after, word_hashes(raw, first, after))

    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if size + n > SLAB and group:
            yield flush()
            group, size = [], 0
        if n > SLAB:
            at, parts = 0, []
            for piece in pieces(text):
                raw = np.frombuffer(piece, np.uint8)
                first, after = spans(raw)
                parts.append((first + at, after + at, word_hashes(raw, first, after)))
                at += len(piece)
            first, after, hashes = (np.concatenate(c) for c in zip(*parts))
            yield Slab([i], np.array([len(first)]), text, first, after, hashes)
            continue
        group.append(i)
        size += n
    if group:
        yield flush()


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
