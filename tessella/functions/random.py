"""Marsaglia's multiply-with-carry generator, for samples that must repeat bit by bit on the driver."""

from __future__ import annotations

MASK = 0xFFFFFFFF


class Multicarry:
    """Two 16-bit multiply-with-carry sequences side by side; state (i1, i2), zero taken as 1."""

    def __init__(self, seed: int = 1234, second: int | None = None) -> None:
        self.i1 = seed & MASK or 1
        self.i2 = ((69069 * seed + 1) if second is None else second) & MASK or 1

    def state(self) -> tuple[int, int]:
        return self.i1, self.i2

    def random(self) -> int:
        """The next 32-bit integer."""
        low, high = self.i1 & 0xFFFF, self.i1 >> 16
        self.i1 = (36969 * low + high) & MASK
        low, high = self.i2 & 0xFFFF, self.i2 >> 16
        self.i2 = (18000 * low + high) & MASK
        return ((self.i1 << 16) & MASK) ^ (self.i2 & 0xFFFF)

    def uniform(self) -> float:
        """In [0, 1]."""
        return self.random() / MASK

    def sample(self, n: int, size: int) -> list[int]:
        """n of the numbers below ``size``, ascending, each subset alike."""
        out, left = [], n
        for k in range(size):
            if left and self.uniform() * (size - k) < left:
                out.append(k)
                left -= 1
        return out
