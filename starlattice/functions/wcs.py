"""World coordinates: keywords to constants on the driver, points as one projected expression.

The chain is pixel - reference pixel -> linear matrix -> projection -> spherical rotation, and back. Distortions of the
keywords (SIP before the matrix, TPV and TNX after it) are part of the chain. Pixels count from 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algebra import NP, layered
from .distortion import Sip, Tnx, Tpv
from .layers import Layer
from .layers import apply as apply_layers
from .layers import fenced
from .projections import HALF, PROJECTIONS, Projection, select

LON_NAMES, LAT_NAMES = ("RA", "GLON", "ELON", "SLON", "HLON", "TLON"), ("DEC", "GLAT", "ELAT", "SLAT", "HLAT", "TLAT")


def split_ctype(ctype: str) -> tuple[str, str, str]:
    """Axis name, projection code and distortion suffix: 'RA---TAN-SIP' -> ('RA', 'TAN', 'SIP')."""
    found = re.fullmatch(r"([A-Z][A-Z0-9]*?)-+([A-Z]{3})(?:-([A-Z]{3}))?", ctype.strip())
    return (found[1], found[2], found[3] or "") if found else (ctype.strip(), "", "")


@dataclass
class Wcs:
    """The keywords of one coordinate description."""

    naxis: int = 2
    ctype: list[str] = field(default_factory=lambda: ["", ""])
    cunit: list[str] = field(default_factory=lambda: ["", ""])
    crval: list[float] = field(default_factory=lambda: [0.0, 0.0])
    crpix: list[float] = field(default_factory=lambda: [0.0, 0.0])
    cdelt: list[float] = field(default_factory=lambda: [1.0, 1.0])
    pc: dict[tuple[int, int], float] = field(default_factory=dict)
    cd: dict[tuple[int, int], float] = field(default_factory=dict)
    pv: dict[tuple[int, int], float] = field(default_factory=dict)
    ps: dict[tuple[int, int], str] = field(default_factory=dict)
    lonpole: float | None = None
    latpole: float | None = None
    radesys: str = ""
    equinox: float | None = None
    date_obs: str = ""
    mjd_obs: float | None = None
    extra: dict[str, object] = field(default_factory=dict)

    @property
    def lon_axis(self) -> int:
        return next((i + 1 for i, c in enumerate(self.ctype) if split_ctype(c)[0] in LON_NAMES), 0)

    @property
    def lat_axis(self) -> int:
        return next((i + 1 for i, c in enumerate(self.ctype) if split_ctype(c)[0] in LAT_NAMES), 0)

    @property
    def code(self) -> str:
        return split_ctype(self.ctype[self.lon_axis - 1])[1] if self.lon_axis else ""

    @property
    def celestial(self) -> bool:
        return bool(self.lon_axis and self.lat_axis and self.code)


def parse(cards: dict[str, object], alt: str = "") -> Wcs:
    """Keyword -> value (upper case) to a description; alt is '' or A-Z. PC and CD together raise ValueError."""
    def get(name: str, default=None):
        return cards.get(f"{name}{alt}", default)

    indexed = [(m[1], int(m[2]), int(m[3]), v) for k, v in cards.items() if (m := re.fullmatch(rf"(PC|CD|PV|PS)(\d+)_(\d+){alt}", k))]
    numbered = [int(m[1]) for k in cards if (m := re.fullmatch(rf"CTYPE(\d+){alt}", k))]
    n = int(get("WCSAXES") or cards.get("NAXIS") or max(numbered, default=0) or 2)
    n = max(n, 2)
    listed = lambda name, default: [type(default)(get(f"{name}{i}", default)) for i in range(1, n + 1)]
    out = Wcs(n, listed("CTYPE", ""), listed("CUNIT", ""), listed("CRVAL", 0.0), listed("CRPIX", 0.0), listed("CDELT", 1.0))
    for kind, i, j, v in indexed:
        getattr(out, kind.lower())[i, j] = v if kind == "PS" else float(v)
    if out.pc and out.cd:
        raise ValueError("PC and CD keywords exclude each other")
    number = lambda v: None if v is None else float(v)
    out.lonpole, out.latpole = number(get("LONPOLE")), number(get("LATPOLE"))
    out.radesys = str(get("RADESYS") or cards.get("RADECSYS") or "")
    out.equinox = number(get("EQUINOX", cards.get("EPOCH")))
    out.date_obs, out.mjd_obs = str(cards.get("DATE-OBS") or ""), number(cards.get("MJD-OBS"))
    out.extra = dict(cards)
    return out


class Transform:
    """Constants of a description; points through numpy or layered expressions."""

    def __init__(self, w: Wcs):
        if not w.celestial or {w.lon_axis, w.lat_axis} != {1, 2}:
            raise ValueError("the first two axes must be celestial")
        self.lon, self.lat = w.lon_axis - 1, w.lat_axis - 1
        code, suffix = w.code, split_ctype(w.ctype[self.lon])[2]
        self.sip = Sip.parse(w.extra) if suffix == "SIP" else None
        self.tpv = Tpv.parse(w.pv, w.lon_axis, w.lat_axis) if code == "TPV" else None
        self.tnx = Tnx.parse(w.extra) if code == "TNX" else None
        pv = {} if code in ("TPV", "TNX") else {j: v for (i, j), v in w.pv.items() if i == w.lat_axis}
        self.projection: Projection = select("TAN" if code in ("TPV", "TNX") else code, pv)
        rows = [[w.cd.get((i, j), 0.0) for j in (1, 2)] for i in (1, 2)] if w.cd else [[w.cdelt[i - 1] * w.pc.get((i, j), float(i == j)) for j in (1, 2)] for i in (1, 2)]
        (a, b), (c, d) = rows
        det = a * d - b * c
        if not det or not math.isfinite(det):
            raise ValueError("the linear matrix is singular")
        self.matrix, self.inverse_matrix = rows, [[d / det, -b / det], [-c / det, a / det]]
        self.crpix = (w.crpix[0] - 1, w.crpix[1] - 1)
        theta0, delta0 = self.projection.theta0, math.radians(w.crval[self.lat])
        zenithal = theta0 == HALF
        pole = w.lonpole if w.lonpole is not None else (0.0 if zenithal and delta0 >= theta0 else 180.0)
        self.phi_p = math.radians(pole)
        self.alpha_p = math.radians(w.crval[self.lon])
        self.delta_p = delta0 if zenithal else delta0 + HALF - theta0

    @property
    def closed(self) -> dict[str, bool]:
        """Is a direction free of iteration, so that it can be a column expression?"""
        bent = any((self.sip, self.tpv, self.tnx))
        return {"inverse": "inverse" not in self.projection.numeric, "forward": "forward" not in self.projection.numeric and not bent}

    def pixel_to_sky(self, m, p1, p2):
        """Degrees; longitude in [0, 360)."""
        u, v = p1 - self.crpix[0], p2 - self.crpix[1]
        if self.sip:
            u, v = self.sip.forward(m, u, v)
        world = [u * row[0] + v * row[1] for row in self.matrix]  # degrees
        xi, eta = world[self.lon], world[self.lat]
        if self.tpv:
            xi, eta = self.tpv.forward(m, xi, eta)
        if self.tnx:
            xi, eta = self.tnx.forward(m, xi, eta)
        phi, theta = self.projection.inverse(m, xi * (math.pi / 180), eta * (math.pi / 180))
        return self._celestial(m, phi, theta)

    def _celestial(self, m, phi, theta):
        d, sp, cp = phi - self.phi_p, math.sin(self.delta_p), math.cos(self.delta_p)
        st, ct, cd = m.sin(theta), m.cos(theta), m.cos(d)
        east, north = -(ct * m.sin(d)), st * cp - ct * sp * cd
        alpha = (m.atan2(east, north) + self.alpha_p) * (180 / math.pi)
        delta = m.atan2(st * sp + ct * cp * cd, m.sqrt(east * east + north * north)) * (180 / math.pi)
        return alpha - 360.0 * m.floor(alpha / 360.0), delta

    def _native(self, m, alpha, delta):
        a, d = alpha * (math.pi / 180) - self.alpha_p, delta * (math.pi / 180)
        sp, cp = math.sin(self.delta_p), math.cos(self.delta_p)
        sd, cd, ca = m.sin(d), m.cos(d), m.cos(a)
        east, north = -(cd * m.sin(a)), sd * cp - cd * sp * ca
        phi = m.atan2(east, north) + self.phi_p
        phi = phi - (2 * math.pi) * m.floor((phi + math.pi) / (2 * math.pi))
        return phi, m.atan2(sd * sp + cd * cp * ca, m.sqrt(east * east + north * north))

    def sky_to_pixel(self, m, alpha, delta):
        phi, theta = self._native(m, alpha, delta)
        x, y = self.projection.forward(m, phi, theta)
        xi, eta = x * (180 / math.pi), y * (180 / math.pi)
        for bend in (self.tpv, self.tnx):
            if bend:
                xi, eta = bend.inverse(xi, eta)
        world = [None, None]
        world[self.lon], world[self.lat] = xi, eta
        u, v = (world[0] * row[0] + world[1] * row[1] for row in self.inverse_matrix)
        if self.sip:
            u, v = self.sip.inverse(u, v)
        return u + self.crpix[0], v + self.crpix[1]

    def numpy(self, direction: str, a, b) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            return getattr(self, direction)(NP, np.asarray(a, float), np.asarray(b, float))

    def layers(self, direction: str, a: str, b: str, out_a: str, out_b: str, prefix: str = "wcs_") -> list[Layer]:
        """The direction as layered expressions over columns of doubles; for closed directions only."""
        return layered(getattr(self, direction), [a, b], [out_a, out_b], prefix)

    def apply(self, df: DataFrame, direction: str, a: str, b: str, out_a: str, out_b: str) -> DataFrame:
        """Two new columns: an expression where the direction is closed, else a vectorised function."""
        closed = self.closed["inverse" if direction == "pixel_to_sky" else "forward"]
        if closed:
            columns = [*df.columns, out_a, out_b]
            done = apply_layers(df.withColumns({"wcs_a": F.col(a).cast("double"), "wcs_b": F.col(b).cast("double")}), self.layers(direction, "wcs_a", "wcs_b", out_a, out_b))
            return fenced(done.select(*dict.fromkeys(columns)))
        transform = self

        def run(p: pd.Series, q: pd.Series) -> pd.DataFrame:
            x, y = transform.numpy(direction, p.to_numpy(float), q.to_numpy(float))
            return pd.DataFrame({"x": x, "y": y})

        point = F.pandas_udf(run, "x double, y double")(F.col(a).cast("double"), F.col(b).cast("double"))
        clean = lambda c: F.when(~F.isnan(c), c)
        return df.withColumn("_point", point).withColumns({out_a: clean(F.col("_point.x")), out_b: clean(F.col("_point.y"))}).drop("_point")


__all__ = ["PROJECTIONS", "Transform", "Wcs", "parse", "split_ctype"]
