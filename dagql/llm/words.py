"""Words of raw UTF-8 bytes as 64-bit hashes, for whole shards at once."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """separators: the bytes that stand between words. A-Z count as a-z. Equal words get equal hashes in any shard."""

    def __init__(self, separators: list[int]):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[separators] = False
        self.number = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
        self.number[65:91] = self.number[97:123]
        self.powers = np.ones(1, np.uint64)

    def __call__(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start byte and hash of each word."""
        at = np.flatnonzero(self.is_word[raw])
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        lengths = np.diff(np.concatenate([first, [len(at)]]))
        if len(self.powers) < (n := int(lengths.max())):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _STEP)]), dtype=np.uint64)
        offset = np.arange(len(at)) - np.repeat(first, lengths)
        return at[first], mix(np.add.reduceat(self.number[raw[at]] * self.powers[offset], first) + lengths.astype(np.uint64))


def shards(texts, limit: int = 2_000_000):
    """Runs of texts (Arrow strings, null as empty) of about limit bytes: first row and list of bytes objects."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held
