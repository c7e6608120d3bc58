"""Vectorised tokenising and hashing of UTF-8 text, for Python workers."""

from __future__ import annotations

import numpy as np

from .common import AT_END, blocks

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
#: Token bytes are separated by the ASCII blanks 0x20 and 0x09-0x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)  # A-Z only
    return mix(lower + np.uint64(1))


_VALUE = _byte_values()
_POWERS: list[np.ndarray] = []
AT_END.append(_POWERS.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _MULT, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def _block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends_of_docs = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]  # a block ends with a blank, so edges come in pairs
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    hashes = mix((total[ends] - total[starts]) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))
    upto = np.searchsorted(starts, ends_of_docs)
    return hashes, np.diff(upto, prepend=0)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the number of words of each text.

    Words are maximal runs without ASCII blanks; A-Z count as a-z. The texts are lists of one
    block's worth of bytes or more; long lists are cut into blocks so that memory stays bounded.
    """
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    parts = [_block_words(texts[a:b]) for a, b in blocks([len(t) + 1 for t in texts])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
