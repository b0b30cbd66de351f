"""Words and word shingles of Arrow texts as 64-bit hashes, for whole batches at once.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text's shingles are its runs of WIDTH words; with fewer words,
the whole sequence is its one shingle; without words it has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are taken apart together.
PART = 4 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB], np.uint64)


def parts(texts, limit: int = PART) -> Iterator:
    """Slices of an Arrow array of strings, without nulls, of about ``limit`` bytes or of one longer text."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield pc.fill_null(texts.slice(start, end - start), "")
        start = end


def coded_words(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of a slice, the number of each word in turn, and where each text's words begin and end."""
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = words.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    bounds = words.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    vocabulary = coded.dictionary.to_pylist()
    if "" in vocabulary:  # from spaces at an end of a text
        nothing = vocabulary.index("")
        real = which != nothing
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        which = which[real]
        which = which - (which > nothing)
        vocabulary.remove("")
    return vocabulary, which, bounds


def word_hashes(texts, clean: Callable[[str], str] = str) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word in turn, after ``clean``, and each text's bounds; words that it leaves empty are left out."""
    import xxhash

    vocabulary, which, bounds = coded_words(texts)
    words = [clean(w) for w in vocabulary]
    if "" in words:
        real = np.fromiter((w != "" for w in words), bool, len(words))[which]
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        which = which[real]
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    return (hashed[which] if len(which) else np.zeros(0, np.uint64)), bounds


def run_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each run of ``width`` words; for all of them if there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, width)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out += words[k : n - size + 1 + k] * _MIX[k % len(_MIX)] + (out >> np.uint64(29))
    out += np.uint64(size)
    out ^= out >> np.uint64(32)
    return out * _MIX[1]


def shingle_sets(texts, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: the hashes of its words in order, and the sorted set of its shingles."""
    for part in parts(texts):
        words, bounds = word_hashes(part)
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = words[start:end]
            yield own, np.unique(run_hashes(own, width))


class MinHash:
    """``count`` universal hashes h(x) = (a x + b) mod 2^64 div 2^32 of the low half of a shingle, and their minima."""

    def __init__(self, count: int, seed: int):
        random = np.random.default_rng(seed)
        self._a = random.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = random.integers(0, 1 << 63, count, np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """One row of 32-bit minima; a set of any size is read in blocks."""
        low = (shingles & np.uint64(0xFFFFFFFF))[:, None]
        best = np.full(len(self._a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            hashed = low[at : at + 1024] * self._a
            hashed += self._b
            hashed >>= np.uint64(32)
            best = np.minimum(best, hashed.min(axis=0).astype(np.uint32))
        return best
