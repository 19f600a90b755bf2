"""Words of whole texts as offsets and 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .batches import Powers, mix

# A word is a run of a-z, 0-9 and characters beyond ASCII; A-Z are lower-cased first.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset of every word of a lower-cased buffer that ends with a byte outside words."""
    inside = IS_WORD[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def word_hashes(buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    prefix = _BYTES.prefix(buffer.astype(np.uint64) + np.uint64(1))
    return _BYTES.ranges(prefix, first, last)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; entry i starts at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = _WORDS.prefix(hashes)
    at = np.arange(n)
    return mix(_WORDS.ranges(prefix, at, at + width) + np.uint64(width))
