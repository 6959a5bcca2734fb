"""Hashes of a text's words and of runs of them, on whole arrays of bytes."""

import re

import numpy as np

from tallymark.llm.substring_dedup import WindowHashes

_BASE = 0x9E3779B97F4A7C15
_SPACE = re.compile(rb"[\t-\r ]")
# A longer text is hashed in parts, cut at white space.
_PART_BYTES = 1 << 20


def _byte_values() -> np.ndarray:
    """Return an odd number for each byte, the same for A-Z as for a-z, and 0 for white space."""
    values = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * 2 + 1
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


_VALUES = _byte_values()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Return the powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < size:
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[at] = np.cumprod(steps)
    return _POWERS


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _part_hashes(data: np.ndarray) -> np.ndarray:
    values = _VALUES[data]
    powers, inverse = _powers(max(len(data), 4096))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(data)], out=sums[1:])
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = values != 0
    edges = np.diff(inside)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return _mixed((sums[end] - sums[begin]) * inverse[begin])


def folded_word_hashes(text: bytes) -> np.ndarray:
    """Return the 64-bit hash of each word, A-Z taken for a-z.

    Words are runs of anything but ASCII white space, in UTF-8. A hash is a sum over the bytes of
    the word, so equal words have equal hashes wherever they stand.
    """
    data, parts, begin = np.frombuffer(text, dtype=np.uint8), [], 0
    while begin < len(data):
        cut = _SPACE.search(text, begin + _PART_BYTES)
        end = cut.start() if cut else len(data)
        parts.append(_part_hashes(data[begin:end]))
        begin = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Return the sorted distinct 64-bit hashes of the runs of ``size`` words, A-Z taken for a-z.

    A text of fewer words, but not none, is one run.
    """
    words = folded_word_hashes(text)
    size = min(size, len(words))
    if not size:
        return np.empty(0, dtype=np.uint64)
    hashes = WindowHashes(words).at(np.arange(len(words) - size + 1), size)
    return np.unique(hashes.view(np.uint64))
