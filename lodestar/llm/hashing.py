"""Word hashes of whole texts as numpy arrays, for the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15
#: Words handled at once, which bounds a worker's arrays whatever the batch holds (a single text may exceed it).
BLOCK_WORDS = 200_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A fixed pseudo-random number for each byte value.
_BYTES = np.random.default_rng(20_240_229).integers(0, 1 << 64, 256, np.uint64)


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, words of each text), by array operations on the bytes.

    A word's hash is a polynomial of its bytes' numbers, mixed. Words as in split()."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True]))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(sizes.max() - 1, _GOLDEN, np.uint64)])
    hashes = mix(np.add.reduceat(_BYTES[data[~blank]] * powers[place], first))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(texts))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between the blanks \\x20 and \\x09-\\x0D, which are just those that bytes.split knows; lower: A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(k: int) -> np.uint64:
    return np.uint64(pow(_GOLDEN, k, 1 << 64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes: a polynomial in doubling steps, so log(k) passes."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    total, base, span, done = None, mix(words), 1, 0
    rest = k
    while rest:
        if rest & 1:
            part = base[done : len(words) - span + 1] if total is not None else base
            if total is None:
                total = part.copy()
            else:
                n = len(words) - done - span + 1
                total = total[:n] * power(span) + part[:n]
            done += span
        rest >>= 1
        if rest:
            n = len(words) - 2 * span + 1
            base = base[:n] * power(span) + base[span : span + n]
            span *= 2
    return mix(total[: len(words) - k + 1])


def blocks(sizes: list[int], most: int = BLOCK_WORDS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with at most `most` in sum; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
