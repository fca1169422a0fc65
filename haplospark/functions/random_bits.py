"""Random numbers that agree, bit for bit, with the ziggurat generators of Boost.Random over a 32-bit Mersenne twister.

The layers' edges are not copied from anywhere: they follow from the condition that all layers have one area, which is
solved here in 50 decimal digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np

_TAIL = -1


class Twister:
    """32-bit outputs of MT19937."""

    def __init__(self, seed: int):
        self._bits = np.random.MT19937()
        self._bits._legacy_seeding(seed & 0xFFFFFFFF)

    def word(self) -> int:
        return int(self._bits.random_raw())

    def unit(self) -> float:
        return self.word() / 2.0**32

    def below_2_30(self) -> int:
        """Uniform on 0..2^30: thirds of the range of a word, drawn again beyond."""
        while (k := self.word() // 3) > 1 << 30:
            pass
        return k

    def layer(self) -> tuple[float, int]:
        """(fraction of 53 bits, layer number of 8 bits)."""
        first, second = self.word(), self.word()
        return ((second & 0x1FFFFFFF) + (first >> 8) / 2.0**24) / 2.0**29, first & 0xFF


def _edges(layers: int, density: Callable, inverse: Callable, area: Callable, low: Decimal, high: Decimal) -> tuple[list[float], list[float]]:
    """Right edges and heights of ``layers`` layers of one area; the bottom one has the tail."""

    def stack(r: Decimal) -> tuple[list[Decimal], bool]:
        v = area(r)
        xs = [v / density(r), r]
        while len(xs) < layers:
            y = v / xs[-1] + density(xs[-1])
            if y >= 1:
                return xs, False
            xs.append(inverse(y))
        return xs, v / xs[-1] + density(xs[-1]) < 1

    for _ in range(150):
        r = (low + high) / 2
        _, under = stack(r)
        low, high = (low, r) if under else (r, high)
    xs = [*stack(high)[0], Decimal(0)]
    return [float(x) for x in xs], [0.0, *[float(density(x)) for x in xs[1:]]]


@lru_cache
def normal_layers() -> tuple[list[float], list[float]]:
    with localcontext() as c:
        c.prec = 50

        def upper_tail(r: Decimal) -> Decimal:
            """Integral of exp(-x^2/2) beyond r, by its continued fraction."""
            down = r
            for k in range(400, 0, -1):
                down = r + k / down
            return (-r * r / 2).exp() / down

        f = lambda x: (-x * x / 2).exp()
        return _edges(128, f, lambda y: (-2 * y.ln()).sqrt(), lambda r: r * f(r) + upper_tail(r), Decimal(3), Decimal(4))


@lru_cache
def exponential_layers() -> tuple[list[float], list[float]]:
    with localcontext() as c:
        c.prec = 50
        f = lambda x: (-x).exp()
        return _edges(256, f, lambda y: -y.ln(), lambda r: (r + 1) * f(r), Decimal(7), Decimal(8))


def _under_curve(bits: Twister, fraction: float, k: int, xs: list[float], ys: list[float], density: Callable[[float], float]) -> float:
    """A point of layer k if it lies under the density, else NaN; ``_TAIL`` for one in the bottom layer beyond its edge."""
    x = fraction * xs[k]
    if x < xs[k + 1]:
        return x
    if k == 0:
        return _TAIL
    y = ys[k] + bits.unit() * (ys[k + 1] - ys[k])
    return x if y < density(x) else math.nan


def exponential(bits: Twister, rate: float = 1.0) -> float:
    xs, ys = exponential_layers()
    shift = 0.0
    while True:
        x = _under_curve(bits, *bits.layer(), xs, ys, lambda t: math.exp(-t))
        if x == _TAIL:
            shift += xs[1]  # no memory: beyond the edge all begins anew
        elif x == x:
            return (shift + x) / rate


def normal(bits: Twister) -> float:
    xs, ys = normal_layers()
    while True:
        fraction, bucket = bits.layer()
        sign = 1 if bucket & 1 else -1
        x = _under_curve(bits, fraction, bucket >> 1, xs, ys, lambda t: math.exp(-t * t / 2))
        if x == _TAIL:
            while True:
                beyond, height = exponential(bits, xs[1]), exponential(bits)
                if 2 * height > beyond * beyond:
                    return sign * (beyond + xs[1])
        if x == x:
            return sign * x


def balanced_labels(n: int, seed: int) -> np.ndarray:
    """Ones and twos, as even as can be, in a seeded order."""
    labels = np.where(np.arange(n) < n - n // 2, 1, 2)
    np.random.default_rng(seed).shuffle(labels)
    return labels
