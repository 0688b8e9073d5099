"""Word, shingle and window hashes of whole texts, as numpy arrays inside tasks.

A word is a run of anything but space and U+0009..U+000D, i.e. what
``bytes.split`` parts at. Its hash is a polynomial over fixed random values
of its UTF-8 bytes, modulo 2**64, read off prefix sums over the text; hashes
depend on the word alone, not on where it stands.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Bases of the rolling hashes over bytes and words (odd, hence invertible modulo 2**64).
_BYTE_BASE, _WORD_BASE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
#: Bytes hashed at a time; longer texts are parted between words.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint64)
#: The same with A-Z valued as a-z.
_FOLDED = _VALUE.copy()
_FOLDED[0x41:0x5B] = _VALUE[0x61:0x7B]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (murmur3)."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0, 1, ... of the base and of its inverse, at least ``n``."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 4096, 2 * len(have[0]) if have else 0)
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        up, down = both
        have = _POWERS[base] = (up, down)
    return have


def _sums(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values * up``, with a leading 0."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def _piece_hashes(data: np.ndarray, value: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1, _BYTE_BASE)
    sums = _sums(value[data], up)
    return mix((sums[ends] - sums[starts]) * down[starts])


def pieces(data: np.ndarray, parts: np.ndarray):
    """Slices of about PIECE bytes, cut at bytes for which ``parts`` is true."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data):
            step = np.flatnonzero(parts[data[end:end + PIECE]])
            if len(step):
                end += int(step[0])
                break
            end = min(end + PIECE, len(data))
        yield data[start:end]
        start = end


def word_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the words of a text given as its UTF-8 bytes; ``lower`` folds A-Z only."""
    value = _FOLDED if lower else _VALUE
    if len(data) <= PIECE:
        return _piece_hashes(data, value)
    return np.concatenate([_piece_hashes(p, value) for p in pieces(data, _SPACE)])


def utf8(scalar) -> np.ndarray:
    """Bytes of an Arrow string scalar, empty for null."""
    return np.frombuffer(scalar.as_buffer(), np.uint8) if scalar.is_valid else np.empty(0, np.uint8)


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all k-word windows by prefix sums, in a time independent of k."""
    n, base = len(h), _WORD_BASE + 2 * seed
    up, down = _powers(n + 1, base)
    sums = _sums(h, up)
    return mix((sums[k:] - sums[:n - k + 1]) * down[:n - k + 1])


def shingle_set(data: np.ndarray, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct shingle hashes; shorter texts are one shingle, texts without words none."""
    h = word_hashes(data, lower)
    if len(h) < k:
        return windows(h, len(h), seed=len(h) + 10) if len(h) else h
    s = np.sort(windows(h, k))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]
