"""Words of whole texts, hashed in vectors.

A word is a run of bytes other than space and the control characters 9 to 13: what bytes.split() finds, too.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes that are hashed at a time, so that they stay in a core's cache; one word longer than this is hashed by itself.
STEP = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finaliser of SplitMix64), so that close inputs give unrelated outputs."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in a text's bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


class Hasher:
    """64-bit hashes of words, and of windows of words; two with different seeds are independent."""

    def __init__(self, seed: int):
        odd = mix(np.arange(1, 3, dtype=U) + U(1000 * seed)) | U(5)
        self.by_byte = mix(np.arange(256, dtype=U) + U(1000 * seed + 7))
        self.base, self.step = odd
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(STEP, self.base)]))
            self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(STEP, U(pow(int(self.base), -1, 1 << 64)))]))

    def _chunk(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if len(data) > len(self.powers) - 1:  # one very long word: its pieces' hashes make its hash
            pieces = [self._chunk(data[i : i + STEP], np.zeros(1, np.int64), np.array([min(STEP, len(data) - i)]))[0] for i in range(0, len(data), STEP)]
            return mix(np.array([self.windows(np.array(pieces, U), len(pieces))[0]], U))
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.by_byte[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[starts + lengths] - sums[starts]) * self.inverse[starts] + lengths.astype(U) * self.step)

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A hash for each word of a text's bytes, given by spans()."""
        ends, out, at = starts + lengths, np.empty(len(starts), U), 0
        with np.errstate(over="ignore"):
            while at < len(starts):
                low = int(starts[at])
                to = max(at + 1, int(np.searchsorted(ends, low + STEP, "right")))
                out[at:to] = self._chunk(data[low : ends[to - 1]], starts[at:to] - low, lengths[at:to])
                at = to
        return out

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """A hash for each run of width neighbouring word hashes; empty if there are fewer words.

        A window of twice a length is made of two windows of that length, which is how the widths are built.
        """
        if len(hashes) < width:
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            done, have, part, size, factor = None, 0, hashes, 1, self.step
            while True:
                if width & size:
                    done = part[: len(hashes) - width + 1] * U(1) if done is None else done * factor + part[have : have + len(hashes) - width + 1]
                    have += size
                if have == width:
                    return mix(done)
                part = part[:-size] * factor + part[size:]
                factor, size = factor * factor, size * 2
