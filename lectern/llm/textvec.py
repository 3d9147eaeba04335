"""Vectorised words of UTF-8 texts: positions and 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_PI = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (wrapping arithmetic)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 and their inverses; up to 4 M are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for p in (_P, _PI):
        a = np.full(n, p, dtype=_U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    if n <= 4 << 20:
        _powers[:] = out
    return out[0], out[1]


_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)
_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTE >= 128)
_VALUE = np.where(_WORD, mix(_LOWER.astype(_U) + _U(1)), _U(0))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text). A word: a run of ASCII letters (lower-cased), digits and
    of all characters from U+0080 on."""
    buf = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    is_word = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    pw, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_VALUE[buf] * pw[: len(buf)], out=total[1:])
    hashes = mix((total[last] - total[first]) * inv[first] + (last - first).astype(_U))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends, side="left")
    return hashes, np.diff(np.concatenate([[0], upto]))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k adjacent words; of all of them, if fewer."""
    n = len(hashes)
    k = min(k, n)
    if not n:
        return hashes
    out = np.zeros(n - k + 1, dtype=_U)
    for i in range(k):
        out = out * _P + hashes[i : n - k + 1 + i]
    return mix(out + _U(k))
