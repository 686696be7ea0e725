"""Vectorised word splitting and word hashing over UTF-8 bytes.

Both word definitions used by the operators cut at ASCII bytes only, so a word is a run of bytes and never splits a
character.  A word's hash is a polynomial in its (lower-cased) bytes modulo 2**64; prefix sums give the hashes of all
words of a buffer in a few array operations, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A-Z to a-z on bytes, everything else unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters a-z and every non-ASCII character.
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: Words `[^\x20\x09-\x0D]+`.
NONSPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[np.frombuffer(LOWER, np.uint8)]
#: Bytes handled at once; powers of the base are kept for one such stretch.
SEGMENT = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """base**i and its inverse modulo 2**64 for i below the longest stretch seen so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(n, factor, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def split_words(data: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in `data`; a word never crosses a position in `cuts`."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if cuts is not None and len(cuts):
        cuts = np.unique(cuts)
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 for each word, equal for equal words (A-Z and a-z count as equal)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(int(np.searchsorted(ends, at + SEGMENT, side="right")), i + 1)
        part = data[at : ends[j - 1]]
        up, down = _powers.get(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * up, out=sums[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix64(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; shorter by n - 1 than `words`."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m] + _U(n)
    for k in range(1, n):
        out = out * _U(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix64(out)


class Words:
    """The words of several texts: text i owns words at[i]:at[i + 1]."""

    def __init__(self, texts: list[bytes | None], table: np.ndarray) -> None:
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
        self.starts, self.ends = split_words(self.data, table, offsets)
        self.at = np.searchsorted(self.starts, offsets)
        self.hashes = hash_words(self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def strings(self, start: int, stop: int) -> list[bytes]:
        return [self.data[a:b].tobytes().translate(LOWER) for a, b in zip(self.starts[start:stop], self.ends[start:stop], strict=True)]


def groups(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together, or of one text that is longer."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
