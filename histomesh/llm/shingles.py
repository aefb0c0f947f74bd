"""Words, shingles and MinHash signatures of many texts at once, in flat arrays."""

from __future__ import annotations

import re

import numpy as np

SHINGLE = 5
SEED = 7
FIND = re.compile(rb"[^\x20\x09-\x0D]+").findall
_P = np.uint64(0x9E3779B97F4A7C15)


class Known(dict):
    """Word to 64-bit hash, filled as words come; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 20:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(numbers: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the size numbers from each place on; fewer than size numbers make one shingle of all."""
    out = np.zeros(max(1, len(numbers) - size + 1), np.uint64)
    for k in range(min(size, len(numbers))):
        part = out * _P + numbers[k : k + len(out)]
        out = part ^ part >> np.uint64(29)
    return out


def shingled(numbers: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """numbers: the words of successive texts, counts of them each. Returns the texts' shingles one after the other, and where each text's begin
    (every text has one at least, as in rolled)."""
    n = np.maximum(counts - size + 1, 1)
    starts, firsts = np.cumsum(n) - n, np.cumsum(counts) - counts
    if (counts >= size).all() and len(numbers):
        place = np.repeat(firsts - starts, n) + np.arange(n.sum())
        return rolled(numbers, size)[place], starts
    parts = [rolled(numbers[a : a + c], size) for a, c in zip(firsts.tolist(), counts.tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), starts


class Signer:
    """MinHash signatures in bands."""

    def __init__(self, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band hashes, a row for each text: x has the texts' shingles, starts where each text's begin."""
        out = np.zeros((len(starts), self.bands), np.uint64)
        for r in range(self.rows):
            for band in range(self.bands):
                k = band * self.rows + r
                least = np.minimum.reduceat(x * self.a[k] + self.b[k], starts)
                out[:, band] = (out[:, band] * _P + least) ^ out[:, band] >> np.uint64(31)
        return out.view(np.int64)


def majorities(x: np.ndarray, starts: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """SimHash fingerprint of each text: a bit is 1 if it is set in over half of the text's shingles."""
    out = np.empty(len(starts), np.uint64)
    stops = np.append(starts[1:], len(x))
    for k, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        ones = np.zeros(64, np.int64)
        for at in range(a, b, chunk):
            part = x[at : min(b, at + chunk)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > b - a, bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def _powers(n: int, known: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of _P and of its inverse, modulo 2^64."""
    if not known or len(known[0]) < n:
        step = np.full(max(n, 1 << 12), _P)
        back = np.full(len(step), np.uint64(pow(int(_P), -1, 1 << 64)))
        step[0] = back[0] = 1
        known[:] = [np.multiply.accumulate(step), np.multiply.accumulate(back)]
    return known[0][:n], known[1][:n]


def marks(numbers: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the stretches of least words picked by winnowing: of any window successive ones the one of least hash. An equal
    stretch of least + window - 1 words has a common mark, whatever its words. Overlapping equal marks (a repeated word) count once."""
    m = len(numbers) - least + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(numbers))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers * up)])
    h = (sums[least:] - sums[:m]) * down[:m]
    h = (h ^ h >> np.uint64(32)) * _P
    h ^= h >> np.uint64(29)
    if m <= window:
        at = np.array([h.argmin()])
    else:
        at = np.arange(m - window + 1) + np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1)
        at = at[np.append(True, at[1:] != at[:-1])]  # never falls
    key = h[at]
    # runs of equal marks that overlap: one for each least words
    first = np.ones(len(at), bool)
    first[1:] = (key[1:] != key[:-1]) | (np.diff(at) >= least)
    part = (at - at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]) // least
    keep = first.copy()
    keep[1:] |= part[1:] != part[:-1]
    return at[keep], key[keep]
