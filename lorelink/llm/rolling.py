"""Rolling hashes over arrays of codes, and the minimum of each window."""

from __future__ import annotations

import numpy as np

# Arrays longer than this are cut by the callers, so positions fit beside a hash in 64 bits.
POSITION_BITS = 22
LONGEST = 1 << POSITION_BITS

_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = np.uint64(LONGEST - 1)
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of ``h`` over all bits, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        full = np.full(1 << max(12, int(n - 1).bit_length()), base, np.uint64)
        full[0] = 1
        have = _tables[name] = np.multiply.accumulate(full)
    return have[:n]


class Prefix:
    """Hashes of any slices of one code array from one pass over it.

    The hash of a slice depends only on its codes, so equal slices have equal
    hashes anywhere. Codes pass through a mixer first.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        if codes.dtype == np.uint8:
            if "bytes" not in _tables:
                _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64))
            terms = _tables["bytes"][codes]
        else:
            terms = mix(codes.astype(np.uint64) + np.uint64(1))
        terms *= _powers("up", _BASE, n) if n else terms
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.down = _powers("down", _INVERSE, n + 1)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per slice; the length takes part."""
        h = self.sums[ends] - self.sums[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(np.uint64)
        return mix(h)

    def grams(self, k: int) -> np.ndarray:
        """The hash of every slice of ``k`` codes, by its start."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.down[: len(h)]
        h += np.uint64(k)
        return mix(h)


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` hashes, the position of its smallest; the rightmost of equal ones.

    Running minima from both ends of blocks of ``w``: three passes whatever ``w`` is.
    Compared are the upper bits of the hashes, which are the same wherever the codes are.
    """
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    if n > LONGEST:
        raise ValueError("cut longer arrays first")
    keys = (hashes & ~_MASK) | (_MASK - np.arange(n, dtype=np.uint64))
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (_MASK - (least & _MASK)).astype(np.int64)
