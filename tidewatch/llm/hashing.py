"""64-bit hashes of byte ranges, vectorised: polynomial prefix sums and a final mix.

Everything is fixed by a seed, so all workers agree.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(7919))


def odd(n: int) -> np.ndarray:
    """Odd multipliers, the next ones of the seeded sequence."""
    return _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = odd(256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as long as the longest text so far."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            one = np.ones(1, dtype=np.uint64)
            cls.up = np.cumprod(np.concatenate([one, np.full(size, _BASE)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([one, np.full(size, _INVERSE)]), dtype=np.uint64)
        return cls.up, cls.down


class Ranges:
    """Hashes of ranges of one byte string."""

    def __init__(self, raw: np.ndarray):
        up, self._down = _Powers.get(len(raw) + 1)
        first = np.zeros(1, dtype=np.uint64)
        self._total = np.concatenate([first, np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes ``start`` to ``stop``, whatever their place; not yet mixed."""
        return (self._total[stop] - self._total[start]) * self._down[start]

    def every(self, width: int) -> np.ndarray:
        """Hash of each range of ``width`` bytes, by start."""
        return (self._total[width:] - self._total[:-width]) * self._down[: len(self._total) - width]
