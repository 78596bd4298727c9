"""Word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mixed, prefix_sums, span_hashes

SEGMENT = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def segments(data: bytes) -> Iterator[bytes]:
    """data cut at white space into parts of about half a megabyte."""
    at = 0
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words (runs without ASCII white space) of a text, A-Z in lower case."""
    found = []
    for part in segments(data.lower()):
        b = np.frombuffer(part, np.uint8)
        gap = np.concatenate([[True], _SPACE[b], [True]])
        start = np.flatnonzero(gap[:-1] & ~gap[1:])
        end = np.flatnonzero(~gap[:-1] & gap[1:])
        found.append(span_hashes(prefix_sums(b), start, end))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def combined(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; of all words as one where there are fewer; none without words."""
    n = len(words)
    k = min(n, size)
    if not k:
        return np.empty(0, np.uint64)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h += words[i : n - k + 1 + i] * _ODD[i]
    return mixed(h)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text. Short texts are hashed together, in parts of about half a megabyte."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < SEGMENT):
            total += len(texts[end]) + 1
            end += 1
        group = texts[at:end]
        if len(group) == 1:
            yield np.unique(combined(word_hashes(group[0]), size))
        else:
            data = b"\n".join(group)
            words = word_hashes(data)
            b = np.frombuffer(data, np.uint8)
            gap = np.concatenate([[True], _SPACE[b]])
            start = np.flatnonzero(gap[:-1] & ~gap[1:])
            edges = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in group]))
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield np.unique(combined(words[lo:hi], size))
        at = end
