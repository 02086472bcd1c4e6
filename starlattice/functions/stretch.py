"""Stretches of pixels in [0, 1] as SQL expressions, in 32-bit arithmetic where the result is 32-bit."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .layers import f32


def _asinh(x: str) -> str:
    """ln(x + sqrt(x x + 1)) of a non-negative number, in 64 bits."""
    return f"ln(CAST({x} AS DOUBLE) + sqrt(CAST({x} AS DOUBLE) * CAST({x} AS DOUBLE) + 1e0))"


def linear(x: str, black: float) -> str:
    if black <= 0:
        return x
    return f"greatest({f32(0)}, ({x} - {f32(black)}) * {f32(1 / (1 - black))})"


def asinh(x: str, beta: float, offset: float = 0.0) -> str:
    if beta == 0:
        return x
    xp = f"(({x} - {f32(offset)}) * {f32(1 / (1 - offset))})"
    return f"CASE WHEN {xp} <= 0 THEN {f32(0)} ELSE least({f32(1)}, {f32(f32(_asinh(f'({f32(beta)} * {xp})')) + ' / ' + f32(math.asinh(beta)))}) END"


def asinh_rgb(r: str, g: str, b: str, beta: float, offset: float = 0.0) -> dict[str, str]:
    """Layers' worth of columns r, g, b scaled by one factor from their mean: {'lum', then 'r', 'g', 'b'} in order."""
    raised = {c: f"greatest({f32(0)}, ({x} - {f32(offset)}) * {f32(1 / (1 - offset))})" for c, x in zip("rgb", (r, g, b))}
    third = f32(1 / 3)
    lum = f"({third} * {raised['r']} + {third} * {raised['g']} + {third} * {raised['b']})"
    factor = f32(f"{f32(_asinh(f'({f32(beta)} * lum)'))} / (lum * {f32(math.asinh(beta))})")
    return {"lum": lum, **{c: f"CASE WHEN lum <= 0 THEN {f32(0)} ELSE least({f32(1)}, greatest({f32(0)}, {raised[c]} * {factor})) END" for c in "rgb"}}


def mtf(x: str, shadows: str, midtones: str, highlights: str) -> str:
    """The midtone transfer function; parameters are expressions of 32-bit numbers."""
    # quotients are cast back, as dialects differ in the type of a quotient of 32-bit numbers
    xp = f"(({x} - {shadows}) * {f32(f'{f32(1)} / ({highlights} - {shadows})')})"
    bent = f32(f"({midtones} - {f32(1)}) * {xp} / (({f32(2)} * {midtones} - {f32(1)}) * {xp} - {midtones})")
    return f"CASE WHEN {x} <= {shadows} THEN {f32(0)} WHEN {x} >= {highlights} THEN {f32(1)} ELSE {bent} END"


def mtf_value(x: float, m: float) -> float:
    return 0.0 if x <= 0 else 1.0 if x >= 1 else (m - 1) * x / ((2 * m - 1) * x - m)


@dataclass(frozen=True)
class Ght:
    """Generalised hyperbolic stretch: strength D, shape B, and the points LP <= SP <= HP."""

    d: float
    b: float = 0.0
    lp: float = 0.0
    sp: float = 0.0
    hp: float = 1.0

    def _family(self):
        """The rising side t(u) of the curve for u = distance from SP, its slope, and t as SQL, by shape."""
        d, b = math.expm1(self.d), 0.0 if abs(self.b) < 1e-3 else self.b
        num = lambda v: f"({float(v)!r}e0)" if "e" not in repr(float(v)) else f"({float(v)!r})"
        if b == -1:
            return lambda u: math.log1p(d * u), lambda u: d / (1 + d * u), lambda u: f"ln(1e0 + {num(d)} * {u})"
        if b == 0:
            return lambda u: 1 - math.exp(-d * u), lambda u: d * math.exp(-d * u), lambda u: f"(1e0 - exp(-{num(d)} * {u}))"
        if b < 0:
            k, e = -b, (-b - 1) / -b
            return lambda u: ((1 + d * k * u) ** e - 1) / (k - 1), lambda u: d * (1 + d * k * u) ** (-1 / k), lambda u: f"((pow(1e0 + {num(d * k)} * {u}, {num(e)}) - 1e0) / {num(k - 1)})"
        return lambda u: 1 - (1 + d * b * u) ** (-1 / b), lambda u: d * (1 + d * b * u) ** (-1 / b - 1), lambda u: f"(1e0 - pow(1e0 + {num(d * b)} * {u}, {num(-1 / b)}))"

    def expression(self, x: str) -> str:
        """The curve is odd about SP, straight outside [LP, HP] and scaled so that 0 goes to 0 and 1 to 1."""
        if math.expm1(self.d) == 0:
            return f32(x)
        t, slope, text = self._family()
        hp = self.hp or 1.0
        num = lambda v: f"({float(v)!r}e0)" if "e" not in repr(float(v)) else f"({float(v)!r})"
        low, high = -t(self.sp - self.lp), t(hp - self.sp)
        at_zero, at_one = low - slope(self.sp - self.lp) * self.lp, high + slope(hp - self.sp) * (1 - hp)
        v = f"greatest(0e0, CAST({x} AS DOUBLE))"
        curve = (
            f"CASE WHEN {v} < {num(self.lp)} THEN {num(low)} - {num(slope(self.sp - self.lp))} * ({num(self.lp)} - {v})"
            f" WHEN {v} < {num(self.sp)} THEN -{text(f'({num(self.sp)} - {v})')} WHEN {v} < {num(hp)} THEN {text(f'({v} - {num(self.sp)})')}"
            f" ELSE {num(high)} + {num(slope(hp - self.sp))} * ({v} - {num(hp)}) END"
        )
        return f"CAST(least(1e0, greatest(0e0, (({curve}) - {num(at_zero)}) / {num(at_one - at_zero)})) AS FLOAT)"


def quantize8(x: str) -> str:
    """[0, 1] to 0..255, rounded half up."""
    return f"CAST(floor(least(greatest({x}, 0e0), 1e0) * 255e0 + 5e-1) AS INT)"
