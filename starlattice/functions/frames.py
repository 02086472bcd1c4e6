"""Sky frames as layered expressions: a rotation is nine constants, folded on the driver."""

from __future__ import annotations

import math

from .layers import Layer, num

Matrix = tuple[tuple[float, float, float], ...]

# Equatorial to galactic, and supergalactic to galactic (published definitions of the two frames).
GALACTIC: Matrix = (
    (-0.054875539396, -0.873437104728, -0.483834991775),
    (+0.494109453628, -0.444829594298, +0.746982248696),
    (-0.867666135683, -0.198076389613, +0.455983794521),
)
SUPERGALACTIC: Matrix = (
    (-0.735742574804, +0.677261296414, 0.0),
    (-0.074553778365, -0.080991471307, +0.993922590400),
    (+0.673145302109, +0.731271165817, +0.110081262237),
)
# Obliquity of the ecliptic (IAU 2006), arcseconds by powers of centuries from J2000.
OBLIQUITY = (84381.406, -46.836769, -0.0001831, 0.00200340, -5.76e-7, -4.34e-8)
ARCSECOND = math.pi / 648000


def transpose(m: Matrix) -> Matrix:
    return tuple(zip(*m))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def about_x(angle: float) -> Matrix:
    """Rotation of the axes about x."""
    c, s = math.cos(angle), math.sin(angle)
    return ((1.0, 0.0, 0.0), (0.0, c, s), (0.0, -s, c))


def _about_z(angle: float) -> Matrix:
    c, s = math.cos(angle), math.sin(angle)
    return ((c, s, 0.0), (-s, c, 0.0), (0.0, 0.0, 1.0))


def _about_y(angle: float) -> Matrix:
    c, s = math.cos(angle), math.sin(angle)
    return ((c, 0.0, -s), (0.0, 1.0, 0.0), (s, 0.0, c))


def obliquity(jd: float) -> float:
    t = (jd - 2451545.0) / 36525.0
    return sum(c * t**k for k, c in enumerate(OBLIQUITY)) * ARCSECOND


def precession(equinox1: float, equinox2: float) -> Matrix:
    """IAU 1976 precession from one Julian equinox to another."""
    t0, t = (equinox1 - 2000.0) / 100.0, (equinox2 - equinox1) / 100.0
    rate = 2306.2181 + 1.39656 * t0 - 0.000139 * t0 * t0
    zeta = rate * t + (0.30188 - 0.000344 * t0) * t * t + 0.017998 * t**3
    z = rate * t + (1.09468 + 0.000066 * t0) * t * t + 0.018203 * t**3
    theta = (2004.3109 - 0.85330 * t0 - 0.000217 * t0 * t0) * t - (0.42665 + 0.000217 * t0) * t * t - 0.041833 * t**3
    return product(_about_z(-z * ARCSECOND), product(_about_y(theta * ARCSECOND), _about_z(-zeta * ARCSECOND)))


def rotation_layers(matrix: Matrix, lon: str, lat: str, out_lon: str, out_lat: str, p: str = "fr_") -> list[Layer]:
    """Degrees to degrees; longitude in [0, 360)."""
    rows = [" + ".join(f"{num(c)} * {p}{axis}" for c, axis in zip(row, "xyz")) for row in matrix]
    return [
        {f"{p}a": f"radians(CAST({lon} AS DOUBLE))", f"{p}d": f"radians(CAST({lat} AS DOUBLE))"},
        {f"{p}x": f"cos({p}d) * cos({p}a)", f"{p}y": f"cos({p}d) * sin({p}a)", f"{p}z": f"sin({p}d)"},
        {f"{p}u": rows[0], f"{p}v": rows[1], f"{p}w": rows[2]},
        {f"{p}lon": f"degrees(atan2({p}v, {p}u))", out_lat: f"degrees(atan2({p}w, sqrt({p}u * {p}u + {p}v * {p}v)))"},
        {out_lon: f"CASE WHEN {p}lon < 0 THEN {p}lon + 360e0 ELSE {p}lon END"},
    ]


def frame_matrix(source: str, target: str, jd: float = 2451545.0, equinox: float = 1950.0) -> Matrix:
    """The matrix between any two of: equatorial, galactic, supergalactic, ecliptic (at jd), fk5 (of an equinox)."""
    to_equatorial = {
        "equatorial": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
        "galactic": transpose(GALACTIC),
        "supergalactic": product(transpose(GALACTIC), SUPERGALACTIC),
        "ecliptic": transpose(about_x(obliquity(jd))),
        "fk5": precession(equinox, 2000.0),
    }
    return product(transpose(to_equatorial[target]), to_equatorial[source])
