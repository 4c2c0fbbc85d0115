"""Words and runs of words of a text, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all their bits depend on each other."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number in the order of first appearance, and the distinct words."""
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(word, len(numbers)) for word in words]
    return np.array(ids, dtype=np.int64), list(numbers)


def shingles(data: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``width`` words.

    ``bytes.lower`` and ``bytes.split`` change and split at ASCII only: A-Z, and
    ``[\\x20\\x09-\\x0D]``. A text of fewer words is one run; one without words has none.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids, distinct = word_ids(words)
    hashes = np.array([xxhash.xxh64_intdigest(word) for word in distinct], dtype=np.uint64)[ids]
    size = min(width, len(words))
    runs = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for place in range(size):
        runs = runs * _MULTIPLIER + hashes[place : place + len(runs)]
    return np.unique(mix(runs))


def repeated_run_words(ids: np.ndarray, n_distinct: int, width: int = SHINGLE_WORDS) -> int:
    """Words that lie in a run of ``width`` words found at least twice in the text."""
    n_runs = len(ids) - width + 1
    if n_runs < 2 or n_distinct == len(ids):
        return 0
    base, bound, keys = max(n_distinct, 2), max(n_distinct, 2), ids[:n_runs]
    for place in range(1, width):
        if bound >= 2**62 // base:
            found, keys = np.unique(keys, return_inverse=True)
            bound = len(found)
        keys = keys * base + ids[place : place + n_runs]
        bound *= base
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))
