"""Distortion polynomials: SIP on pixel offsets, TPV and TNX on intermediate coordinates (degrees).

Forward directions are closed formulas over a namespace of :mod:`algebra`; inverses iterate Newton's method in numpy
with a numerical slope, or use the file's own inverse polynomials where SIP has them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from .algebra import NP


def _newton(forward, x, y, steps: int = 30):
    """Solve forward(u, v) = (x, y) from u = x, v = y."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    u, v, h = x.copy(), y.copy(), 1e-6
    for _ in range(steps):
        fx, fy = forward(NP, u, v)
        ax, ay = forward(NP, u + h, v)
        bx, by = forward(NP, u, v + h)
        a, b, c, d = (ax - fx) / h, (bx - fx) / h, (ay - fy) / h, (by - fy) / h
        det = a * d - b * c
        det = np.where(np.abs(det) < 1e-300, np.nan, det)
        du, dv = (d * (x - fx) - b * (y - fy)) / det, (a * (y - fy) - c * (x - fx)) / det
        u, v = u + du, v + dv
        if not np.any(np.abs(du) + np.abs(dv) > 1e-13 * (1 + np.abs(u) + np.abs(v))):
            break
    return u, v


def _power(x, n: int):
    out = None
    for _ in range(n):
        out = x if out is None else out * x
    return out


def _sum(terms: dict[tuple[int, int], float], u, v):
    """Sum of c u^i v^j; starts from 0 u, so that an empty sum keeps its shape."""
    total = 0.0 * u
    for (i, j), c in sorted(terms.items()):
        t = c + 0.0 * u
        for base, n in ((u, i), (v, j)):
            if n:
                t = t * _power(base, n)
        total = total + t
    return total


@dataclass
class Sip:
    a: dict[tuple[int, int], float] = field(default_factory=dict)
    b: dict[tuple[int, int], float] = field(default_factory=dict)
    ap: dict[tuple[int, int], float] = field(default_factory=dict)
    bp: dict[tuple[int, int], float] = field(default_factory=dict)

    @staticmethod
    def parse(cards: dict[str, object]) -> Sip:
        out = Sip()
        for k, v in cards.items():
            if found := re.fullmatch(r"(A|B|AP|BP)_(\d+)_(\d+)", k):
                getattr(out, found[1].lower())[int(found[2]), int(found[3])] = float(v)
        return out

    def forward(self, m, u, v):
        return u + _sum(self.a, u, v), v + _sum(self.b, u, v)

    def inverse(self, u, v):
        if self.ap or self.bp:
            return u + _sum(self.ap, u, v), v + _sum(self.bp, u, v)
        return _newton(self.forward, u, v)


# The terms of TPV as powers of xi, eta and r.
TPV_TERMS = (
    (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (1, 1, 0), (0, 2, 0), (3, 0, 0), (2, 1, 0), (1, 2, 0), (0, 3, 0), (0, 0, 3),
    (4, 0, 0), (3, 1, 0), (2, 2, 0), (1, 3, 0), (0, 4, 0), (5, 0, 0), (4, 1, 0), (3, 2, 0), (2, 3, 0), (1, 4, 0), (0, 5, 0), (0, 0, 5),
    (6, 0, 0), (5, 1, 0), (4, 2, 0), (3, 3, 0), (2, 4, 0), (1, 5, 0), (0, 6, 0), (7, 0, 0), (6, 1, 0), (5, 2, 0), (4, 3, 0), (3, 4, 0),
    (2, 5, 0), (1, 6, 0), (0, 7, 0), (0, 0, 7),
)


@dataclass
class Tpv:
    """The published convention: on the second axis xi and eta trade places."""

    lon: dict[int, float]
    lat: dict[int, float]

    @staticmethod
    def parse(pv: dict[tuple[int, int], float], lon_axis: int = 1, lat_axis: int = 2) -> Tpv:
        own = lambda axis: {1: 1.0} | {j: v for (i, j), v in pv.items() if i == axis}
        return Tpv(own(lon_axis), own(lat_axis))

    def forward(self, m, xi, eta):
        r = m.sqrt(xi * xi + eta * eta)

        def total(terms: dict[int, float], p, q):
            out = 0.0 * p
            for k, c in sorted(terms.items()):
                if c and k < len(TPV_TERMS):
                    t = c + 0.0 * p
                    for base, n in zip((p, q, r), TPV_TERMS[k]):
                        if n:
                            t = t * _power(base, n)
                    out = out + t
            return out

        return total(self.lon, xi, eta), total(self.lat, eta, xi)

    def inverse(self, xi, eta):
        return _newton(self.forward, xi, eta)


@dataclass
class Surface:
    """A fitted surface: 1 Chebyshev, 2 Legendre, 3 power basis; cross terms none (0), all (1) or half (2)."""

    kind: int
    nx: int
    ny: int
    cross: int
    bounds: tuple[float, float, float, float]
    coefficients: list[float]

    @staticmethod
    def parse(text: str) -> Surface:
        v = [float(t) for t in text.split()]
        return Surface(int(v[0]), int(v[1]), int(v[2]), int(v[3]), tuple(v[4:8]), v[8:])

    def _basis(self, x, count: int, low: float, high: float):
        if self.kind == 3:
            z = x
        else:
            z = (2.0 * x - (high + low)) / (high - low)
        out = [1.0 + 0.0 * z, z]
        for n in range(1, count - 1):
            if self.kind == 1:
                out.append(2.0 * z * out[n] - out[n - 1])
            elif self.kind == 2:
                out.append(((2.0 * n + 1.0) * z * out[n] - float(n) * out[n - 1]) / (n + 1.0))
            else:
                out.append(out[n] * z)
        return out[:count]

    def value(self, x, y):
        bx, by = self._basis(x, self.nx, *self.bounds[:2]), self._basis(y, self.ny, *self.bounds[2:])
        total, at = 0.0 * x, 0
        top = max(self.nx, self.ny)
        for j in range(self.ny):
            for i in range(self.nx):
                if (self.cross == 0 and i and j) or (self.cross == 2 and i + j >= top):
                    continue
                if at < len(self.coefficients):
                    total = total + self.coefficients[at] * bx[i] * by[j]
                at += 1
        return total


@dataclass
class Tnx:
    lon: Surface | None
    lat: Surface | None

    @staticmethod
    def parse(cards: dict[str, object]) -> Tnx:
        def surface(axis: int, name: str) -> Surface | None:
            parts = sorted((int(k[5:]), str(v)) for k, v in cards.items() if re.fullmatch(rf"WAT{axis}_\d{{3}}", k))
            text = "".join(f"{v:<68}" for _, v in parts)
            found = re.search(rf'{name}\s*=\s*"([^"]*)"', text)
            return Surface.parse(found[1]) if found else None

        return Tnx(surface(1, "lngcor"), surface(2, "latcor"))

    def forward(self, m, xi, eta):
        return (xi + self.lon.value(xi, eta) if self.lon else xi), (eta + self.lat.value(xi, eta) if self.lat else eta)

    def inverse(self, xi, eta):
        return _newton(self.forward, xi, eta)
