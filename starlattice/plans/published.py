"""Oracles written from the published equations, apart from the library's formulas.

World coordinates follow Calabretta & Greisen (2002), "Representations of celestial coordinates in FITS", with their
symbols; angles in radians. The poles below solve their equations 8 to 10 for the reference point (150, 30) by hand:
zenithal projections have it as pole with phi_p = 180, those with theta_0 = 0 have the pole (330, 60) and phi_p = 0, the
conics with theta_0 = 45 have (150, 75) and phi_p = 180.
"""

from __future__ import annotations

POLES = {"zenithal": (150, 30, 180), "equator": (330, 60, 0), "conic": (150, 75, 180)}

#: Projection -> family, native latitude's radius or (x, y) from (phi, theta), and (phi, theta) from (x, y).
#: A zenithal projection or a conic gives R(theta) and theta(R); the others give both coordinates. ``let`` names come first.
_SLANT = (
    ("a", "{x1}*{x1} + {y1}*{y1} + 1"), ("b", "{x1}*(x - {x1}) + {y1}*(y - {y1})"), ("c", "(x - {x1})*(x - {x1}) + (y - {y1})*(y - {y1}) - 1"),
    ("s", "least(1e0, (-b + sqrt(b*b - a*c)) / a)"),
)
_SIN = [(n, e.format(x1="0.1e0", y1="(-0.2e0)")) for n, e in _SLANT]
_XP, _YP, _ZP = "(-2*cos(radians(60))*sin(radians(30)))", "(2*cos(radians(60))*cos(radians(30)))", "(2*sin(radians(60)) + 1)"
_SZP = [("x1", f"(x - {_XP}) / {_ZP}"), ("y1", f"(y - {_YP}) / {_ZP}"), *[(n, e.format(x1="x1", y1="y1")) for n, e in _SLANT]]
_TAN30 = "tan(radians(30))"
_COE_G = "(1 + sin(radians(35))*sin(radians(55)))"
_COE_C = "((sin(radians(35)) + sin(radians(55))) / 2)"
_COO_C = "(ln(cos(radians(55)) / cos(radians(35))) / ln(tan(radians(17.5e0)) / tan(radians(27.5e0))))"
_COO_PSI = f"(cos(radians(35)) / ({_COO_C} * pow(tan(radians(27.5e0)), {_COO_C})))"
_COD_C = "(sin(radians(45)) * sin(radians(10)) / radians(10))"
_BON_Y = "(1 / tan(radians(40)) + radians(40))"



def _newton(start: str, step: str, name: str, times: int = 6) -> list[tuple[str, str]]:
    """Newton's method, one SELECT a step."""
    return [(f"{name}0", start), *[(f"{name}{i + 1}", step.replace("@", f"{name}{i}")) for i in range(times)]]


ZENITHAL = {
    "tan": ("1 / tan(theta)", "atan2(1e0, r)"),
    "stg": ("2 * cos(theta) / (1 + sin(theta))", "pi()/2 - 2 * atan(r / 2)"),
    "arc": ("pi()/2 - theta", "pi()/2 - r"),
    "zea": ("2 * sin((pi()/2 - theta) / 2)", "pi()/2 - 2 * asin(r / 2)"),
    "zpn": ("(pi()/2 - theta) + 0.05e0 * pow(pi()/2 - theta, 2) - 0.02e0 * pow(pi()/2 - theta, 3)", "pi()/2 - z6"),
}
#: C, Y0, R from theta, theta from R. Of COP and COD the library keeps Y0 = cot(theta_a) where the paper spreads it by eta.
CONIC = {
    "cop": ("sin(radians(45))", "1 / tan(radians(45))", "cos(radians(10)) * (1 / tan(radians(45)) - tan(theta - radians(45)))", "radians(45) + atan(1 / tan(radians(45)) - r / cos(radians(10)))"),
    "coe": (_COE_C, f"sqrt({_COE_G} - 2*{_COE_C}*sin(radians(45))) / {_COE_C}", f"sqrt({_COE_G} - 2*{_COE_C}*sin(theta)) / {_COE_C}", f"asin(({_COE_G} - r*r*{_COE_C}*{_COE_C}) / (2*{_COE_C}))"),
    "cod": (_COD_C, "1 / tan(radians(45))", "radians(45) - theta + 1 / tan(radians(45))", "radians(45) + 1 / tan(radians(45)) - r"),
    "coo": (_COO_C, f"{_COO_PSI} * pow(tan(radians(22.5e0)), {_COO_C})", f"{_COO_PSI} * pow(tan((pi()/2 - theta) / 2), {_COO_C})", f"pi()/2 - 2 * atan(pow(r / {_COO_PSI}, 1 / {_COO_C}))"),
}
#: (family, let forward, x, y, let inverse, phi, theta); the field of view lies in the middle face or facet of the cubes and HPX.
OTHER = {
    "azp": ("zenithal", [("r", f"3 * cos(theta) / (2 + sin(theta) + cos(theta)*cos(phi)*{_TAN30})")], "r*sin(phi)", "-r*cos(phi) / cos(radians(30))",
            [("r", "sqrt(x*x + pow(y*cos(radians(30)), 2))"), ("rho", "r / (3 + y*sin(radians(30)))"), ("omega", "asin(rho*2 / sqrt(rho*rho + 1))")], "atan2(x, -y*cos(radians(30)))", "atan2(1e0, rho) - omega"),
    "szp": ("zenithal", [("d", f"{_ZP} - (1 - sin(theta))")], f"({_ZP}*cos(theta)*sin(phi) - {_XP}*(1 - sin(theta))) / d", f"-({_ZP}*cos(theta)*cos(phi) + {_YP}*(1 - sin(theta))) / d",
            _SZP, "atan2(x - x1*(1 - s), -(y - y1*(1 - s)))", "asin(s)"),
    "sin": ("zenithal", [], "cos(theta)*sin(phi) + 0.1e0*(1 - sin(theta))", "-(cos(theta)*cos(phi) + 0.2e0*(1 - sin(theta)))", _SIN, "atan2(x - 0.1e0*(1 - s), -(y + 0.2e0*(1 - s)))", "asin(s)"),
    "cyp": ("equator", [], "phi", "2 * sin(theta) / (1 + cos(theta))", [("eta", "y / 2")], "x", "atan2(eta, 1e0) + asin(eta / sqrt(eta*eta + 1))"),
    "cea": ("equator", [], "phi", "sin(theta) / 0.8e0", [], "x", "asin(0.8e0 * y)"),
    "car": ("equator", [], "phi", "theta", [], "x", "y"),
    "mer": ("equator", [], "phi", "ln(tan(pi()/4 + theta/2))", [], "x", "2 * atan(exp(y)) - pi()/2"),
    "sfl": ("equator", [], "phi * cos(theta)", "theta", [], "x / cos(y)", "y"),
    "par": ("equator", [], "phi * (2*cos(2*theta/3) - 1)", "pi() * sin(theta/3)", [("t", "3 * asin(y / pi())")], "x / (1 - 4*pow(y/pi(), 2))", "t"),
    "mol": ("equator", _newton("theta", "@ - (2*@ + sin(2*@) - pi()*sin(theta)) / (2 + 2*cos(2*@))", "g"), "2*sqrt(2)/pi() * phi * cos(g6)", "sqrt(2) * sin(g6)", [("g", "asin(y / sqrt(2))")], "pi() * x / (2*sqrt(2 - y*y))", "asin((2*g + sin(2*g)) / pi())"),
    "ait": ("equator", [("g", "sqrt(2 / (1 + cos(theta)*cos(phi/2)))")], "2*g*cos(theta)*sin(phi/2)", "g*sin(theta)", [("z", "sqrt(1 - pow(x/4, 2) - pow(y/2, 2))")], "2 * atan2(z*x/2, 2*z*z - 1)", "asin(y*z)"),
    "bon": ("equator", [("r", f"{_BON_Y} - theta"), ("a", "phi*cos(theta) / r")], "r*sin(a)", f"{_BON_Y} - r*cos(a)", [("r", f"sqrt(x*x + pow({_BON_Y} - y, 2))"), ("t", f"{_BON_Y} - r")], f"atan2(x, {_BON_Y} - y) * r / cos(t)", "t"),
    "pco": ("equator", [("e", "phi*sin(theta)")], "CASE WHEN abs(theta) < 1e-12 THEN phi ELSE sin(e) / tan(theta) END", "CASE WHEN abs(theta) < 1e-12 THEN theta ELSE theta + (1 - cos(e)) / tan(theta) END",
            _newton("y", "@ - ((x*x + pow(y - @, 2)) * tan(@) - 2*(y - @)) / (2 - 2*(y - @)*tan(@) + (x*x + pow(y - @, 2)) / pow(cos(@), 2))", "t"), "CASE WHEN abs(t6) < 1e-12 THEN x ELSE atan2(x*tan(t6), 1 - (y - t6)*tan(t6)) / sin(t6) END", "t6"),
    "tsc": ("equator", [], "pi()/4 * tan(phi)", "pi()/4 * tan(theta) / cos(phi)", [("u", "x*4/pi()"), ("v", "y*4/pi()")], "atan(u)", "atan2(v, sqrt(1 + u*u))"),
    "hpx": ("equator", [], "phi", "3*pi()/8 * sin(theta)", [], "x", "asin(8*y / (3*pi()))"),
    "qsc": ("equator",
            [("xi", "cos(theta)*sin(phi)"), ("eta", "sin(theta)"), ("big", "CASE WHEN abs(xi) > abs(eta) THEN xi ELSE eta END"), ("w", "CASE WHEN big = 0 THEN 0 WHEN abs(xi) > abs(eta) THEN eta/xi ELSE xi/eta END"),
             ("size", "sign(big) * sqrt((xi*xi + eta*eta) / (1 + cos(theta)*cos(phi)) / (1 - 1/sqrt(2 + w*w)))"), ("part", "size * 12/pi() * (atan(w) - asin(w / sqrt(2*(1 + w*w))))")],
            "pi()/4 * CASE WHEN abs(xi) > abs(eta) THEN size ELSE part END", "pi()/4 * CASE WHEN abs(xi) > abs(eta) THEN part ELSE size END",
            [("u", "x*4/pi()"), ("v", "y*4/pi()"), ("big", "CASE WHEN abs(u) > abs(v) THEN u ELSE v END"), ("part", "CASE WHEN abs(u) > abs(v) THEN v ELSE u END"),
             ("w", "CASE WHEN big = 0 THEN 0 ELSE sin(pi()/12 * part/big) / (cos(pi()/12 * part/big) - sqrt(0.5e0)) END"), ("low", "big*big*(1 - 1/sqrt(2 + w*w))"), ("long", "sign(big) * sqrt(low*(2 - low) / (1 + w*w))"),
             ("m", "CASE WHEN abs(u) > abs(v) THEN long ELSE long*w END"), ("n", "CASE WHEN abs(u) > abs(v) THEN long*w ELSE long END")],
            "atan2(m, 1 - low)", "atan2(n, sqrt((1 - low)*(1 - low) + m*m))"),
}


def _chain(start: str, steps: list[tuple[str, str]]) -> str:
    """Each name in a SELECT of its own, as it may use those before it."""
    for name, expr in steps:
        start = f"SELECT *, {expr} AS {name} FROM ({start})"
    return start


def _to_sky(start: str, family: str) -> str:
    a, d, p = POLES[family]
    return _chain(start, [
        ("k", f"phi - radians({p})"),
        ("dec", f"degrees(atan2(sin(theta)*sin(radians({d})) + cos(theta)*cos(radians({d}))*cos(k), sqrt(pow(cos(theta)*sin(k), 2) + pow(sin(theta)*cos(radians({d})) - cos(theta)*sin(radians({d}))*cos(k), 2))))"),
        ("alpha", f"{a} + degrees(atan2(-cos(theta)*sin(k), sin(theta)*cos(radians({d})) - cos(theta)*sin(radians({d}))*cos(k)))"),
        ("ra", "alpha - 360 * floor(alpha / 360)"),
    ])


def _from_sky(family: str) -> str:
    a, d, p = POLES[family]
    start = "SELECT p_partkey AS id, radians((p_partkey % 61) / 10e0 + 147) AS ra, radians((p_partkey % 53) / 10e0 + 27.5e0) AS dec FROM part"
    return _chain(start, [
        ("k", f"ra - radians({a})"),
        ("theta", f"atan2(sin(dec)*sin(radians({d})) + cos(dec)*cos(radians({d}))*cos(k), sqrt(pow(cos(dec)*sin(k), 2) + pow(sin(dec)*cos(radians({d})) - cos(dec)*sin(radians({d}))*cos(k), 2)))"),
        ("turn", f"radians({p}) + atan2(-cos(dec)*sin(k), sin(dec)*cos(radians({d})) - cos(dec)*sin(radians({d}))*cos(k))"),
        ("phi", "CASE WHEN turn > pi() THEN turn - 2*pi() WHEN turn < -pi() THEN turn + 2*pi() ELSE turn END"),
    ])


def _equations(code: str):
    if code in ZENITHAL:
        radius, latitude = ZENITHAL[code]
        return "zenithal", [("r", radius)], "r*sin(phi)", "-r*cos(phi)", [("r", "sqrt(x*x + y*y)"), *(_newton("r", "@ - (@ + 0.05e0*@*@ - 0.02e0*@*@*@ - r) / (1 + 0.1e0*@ - 0.06e0*@*@)", "z") if code == "zpn" else [])], "atan2(x, -y)", latitude
    if code in CONIC:
        c, y0, radius, latitude = CONIC[code]
        return "conic", [("r", radius)], f"r*sin({c}*phi)", f"{y0} - r*cos({c}*phi)", [("r", f"sqrt(x*x + pow({y0} - y, 2))")], f"atan2(x, {y0} - y) / {c}", latitude
    return OTHER.get(code, (None,) * 7)


def pixel_to_sky(code: str) -> str | None:
    """ra and dec of the grid of pixels, or None where there is no closed form."""
    family, _, _, _, let, phi, theta = _equations(code)
    if phi is None:
        return None
    plane = "SELECT p_partkey AS id, radians(((p_partkey % 61) * 2.5e0 + 125 - 199) * -0.05e0) AS x, radians(((p_partkey % 53) * 2.5e0 + 135 - 199) * 0.05e0) AS y FROM part"
    native = _chain(plane, [*let, ("phi", phi), ("theta", theta)])
    return f"SELECT id, round(ra, 7) AS ra, round(dec, 7) AS dec FROM ({_to_sky(f'SELECT id, phi, theta FROM ({native})', family)})"


def sky_to_pixel(code: str) -> str | None:
    """Pixels of the grid of sky points, or None where there is no closed form."""
    family, let, x, y, _, _, _ = _equations(code)
    if x is None:
        return None
    return f"SELECT id, round(degrees({x}) / -0.05e0 + 199, 6) AS p1, round(degrees({y}) / 0.05e0 + 199, 6) AS p2 FROM ({_chain(_from_sky(family), let)})"


# -- frames ----------------------------------------------------------------------------------------------------------
SKY = "SELECT c_custkey AS id, radians((c_custkey * 7919 % 360000) / 1e3) AS lon, radians((c_custkey * 104729 % 180001) / 1e3 - 90) AS lat FROM customer"


def _degrees(sky: str, x: str, y: str, z: str) -> str:
    turned = f"SELECT id, degrees(atan2({y}, {x})) AS turn, degrees(atan2({z}, sqrt(pow({x}, 2) + pow({y}, 2)))) AS lat2 FROM ({sky})"
    return f"SELECT id, round(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END, 7) AS lon2, round(lat2, 7) AS lat2 FROM ({turned})"


def by_vectors(rows: tuple) -> str:
    """Three direction cosines: the place as a vector along the new axes."""
    along = lambda r: f"({r[0]!r}::DOUBLE*cos(lat)*cos(lon) + {r[1]!r}::DOUBLE*cos(lat)*sin(lon) + {r[2]!r}::DOUBLE*sin(lat))"
    return _degrees(SKY, *map(along, rows))


def ecliptic(back: bool) -> str:
    """By the obliquity (IAU 2006) at 2010.0, some ten years after J2000."""
    t = "((2455197.5e0 - 2451545) / 36525)"
    tilt = f"radians((84381.406e0 - 46.836769e0*{t} - 0.0001831e0*pow({t}, 2) + 0.0020034e0*pow({t}, 3) - 5.76e-7*pow({t}, 4) - 4.34e-8*pow({t}, 5)) / 3600)"
    sky, sign = f"SELECT *, {'-' if back else ''}{tilt} AS e FROM ({SKY})", "e"
    return _degrees(sky, "cos(lat)*cos(lon)", f"(cos(lat)*sin(lon)*cos({sign}) + sin(lat)*sin({sign}))", f"(sin(lat)*cos({sign}) - cos(lat)*sin(lon)*sin({sign}))")


def precession(back: bool) -> str:
    """IAU 1976 from 2000 to 2050, by the angles zeta, z and theta (Lieske's series with T = 0, t = 1/2)."""
    zeta, z, theta = ((f"radians(({a}*0.5e0 + {b}*0.25e0 + {c}*0.125e0) / 3600)") for a, b, c in ((2306.2181, 0.30188, 0.017998), (2306.2181, 1.09468, 0.018203), (2004.3109, -0.42665, -0.041833)))
    if back:
        zeta, z, theta = f"(-{z})", f"(-{zeta})", f"(-{theta})"
    sky = f"SELECT *, {zeta} AS zeta, {z} AS z, {theta} AS theta FROM ({SKY})"
    sky = f"SELECT *, cos(lat)*sin(lon + zeta) AS a, cos(theta)*cos(lat)*cos(lon + zeta) - sin(theta)*sin(lat) AS b, sin(theta)*cos(lat)*cos(lon + zeta) + cos(theta)*sin(lat) AS c FROM ({sky})"
    return _degrees(sky, "(b*cos(z) - a*sin(z))", "(b*sin(z) + a*cos(z))", "c")


# -- HEALPix (Gorski et al. 2005) ------------------------------------------------------------------------------------
def _interleaved(x: str, y: str) -> str:
    return " + ".join(f"(({x} >> {b}) & 1 << {2 * b}) + (({y} >> {b}) & 1 << {2 * b + 1})".replace("& 1 <<", "& 1) <<").replace(f"(({x}", f"((({x}").replace(f"(({y}", f"((({y}") for b in range(7))


def _planes(sky: str, n: int) -> str:
    """jp and jm: how many pixel edges rising and falling lie below; tt: longitude in quarters."""
    return _chain(f"SELECT id, cos(theta) AS z, phi / (pi()/2) AS tt FROM ({sky})", [
        ("tp", "tt - floor(tt)"), ("belt", "abs(z) <= 2/3e0"), ("far", f"{n} * sqrt(3 * (1 - abs(z)))"),
        ("jp", f"CAST(floor(CASE WHEN belt THEN {n}*(0.5e0 + tt) - {n}*z*0.75e0 ELSE tp*far END) AS BIGINT)"),
        ("jm", f"CAST(floor(CASE WHEN belt THEN {n}*(0.5e0 + tt) + {n}*z*0.75e0 ELSE (1 - tp)*far END) AS BIGINT)"),
    ])


_ANGLES = "SELECT o_orderkey AS id, radians(90 - ((o_orderkey * 104729 % 180001) / 1e3 - 90)) AS theta, radians((o_orderkey * 7919 % 360000) / 1e3) AS phi FROM orders"


def ang2pix_ring(n: int) -> str:
    return f"SELECT id, pix FROM ({_chain(_planes(_ANGLES, n), [('ir', f'CASE WHEN belt THEN {n} + 1 + jp - jm ELSE jp + jm + 1 END'), ('ip', f'CASE WHEN belt THEN ((jp + jm - {n} + 1 - (ir & 1) + 1) // 2) % {4 * n} ELSE CAST(floor(tt*ir) AS BIGINT) % (4*ir) END'), ('pix', f'CASE WHEN belt THEN {2 * n * (n - 1)} + (ir - 1)*{4 * n} + ip WHEN z > 0 THEN 2*ir*(ir - 1) + ip ELSE {12 * n * n} - 2*ir*(ir + 1) + ip END')])})"


def ang2pix_nest(n: int) -> str:
    """Face, then places x and y in it, whose bits alternate."""
    steps = [
        ("a", f"jp // {n}"), ("b", f"jm // {n}"), ("q", "least(3, CAST(floor(tt) AS BIGINT))"),
        ("jpc", f"least(jp, {n - 1})"), ("jmc", f"least(jm, {n - 1})"),
        ("face", "CASE WHEN belt THEN CASE WHEN a = b THEN a & 3 | 4 WHEN a < b THEN a ELSE b + 8 END WHEN z >= 0 THEN q ELSE q + 8 END"),
        ("x", f"CASE WHEN belt THEN jm % {n} WHEN z >= 0 THEN {n - 1} - jmc ELSE jpc END"),
        ("y", f"CASE WHEN belt THEN {n - 1} - jp % {n} WHEN z >= 0 THEN {n - 1} - jpc ELSE jmc END"),
    ]
    return f"SELECT id, CAST(face*{n * n} + {_interleaved('x', 'y')} AS BIGINT) AS pix FROM ({_chain(_planes(_ANGLES, n), steps)})"


def _nest_places(cells: str, n: int) -> list[tuple[str, str]]:
    """Face, x and y of a nested pixel, its ring from the north pole (jr), pixels in a quarter of it (nr) and its number there."""
    bits = lambda shift: " + ".join(f"(((nest % {n * n}) >> {2 * b + shift}) & 1) * {1 << b}" for b in range(7))
    return [
        ("face", f"nest // {n * n}"), ("x", bits(0)), ("y", bits(1)), ("jr", f"(face // 4 + 2)*{n} - x - y - 1"),
        ("nr", f"CASE WHEN jr < {n} THEN jr WHEN jr > {3 * n} THEN {4 * n} - jr ELSE {n} END"),
        ("shift", f"CASE WHEN jr < {n} OR jr > {3 * n} THEN 0 ELSE (jr - {n}) & 1 END"),
        ("jpl", "CASE WHEN face // 4 = 1 THEN (face % 4)*2 ELSE (face % 4)*2 + 1 END"),
        ("jp0", "(jpl*nr + x - y + 1 + shift) // 2"), ("jp", f"CASE WHEN jp0 > {4 * n} THEN jp0 - {4 * n} WHEN jp0 < 1 THEN jp0 + {4 * n} ELSE jp0 END"),
        ("ring", f"CASE WHEN jr < {n} THEN 2*jr*(jr - 1) + jp - 1 WHEN jr > {3 * n} THEN {12 * n * n} - 2*nr*(nr + 1) + jp - 1 ELSE {2 * n * (n - 1)} + (jr - {n})*{4 * n} + jp - 1 END"),
    ]


def _all_places(n: int) -> str:
    return _chain(f"SELECT range AS nest FROM range({12 * n * n})", _nest_places("", n))


def _cells(n: int) -> str:
    return f"SELECT o_orderkey AS id, (o_orderkey * 7919) % {12 * n * n} AS pix FROM orders"


def nest2ring(n: int) -> str:
    return f"SELECT c.id, CAST(ring AS BIGINT) AS ring FROM ({_cells(n)}) c JOIN ({_all_places(n)}) a ON a.nest = c.pix"


def ring2nest(n: int) -> str:
    """The other way round: the nested pixel whose ring number it is."""
    return f"SELECT c.id, CAST(nest AS BIGINT) AS nest FROM ({_cells(n)}) c JOIN ({_all_places(n)}) a ON a.ring = c.pix"


def pix2ang(n: int, nested: bool) -> str:
    """Centres by ring: z from the ring's number, longitude from the place in it."""
    steps = [
        ("z", f"CASE WHEN jr < {n} THEN 1 - jr*jr / {3 * n * n}e0 WHEN jr > {3 * n} THEN nr*nr / {3 * n * n}e0 - 1 ELSE ({2 * n} - jr) * 2 / {3 * n}e0 END"),
        ("theta", "acos(z)"), ("phi", "(jp - (shift + 1) / 2e0) * (pi()/2) / nr"),
    ]
    return f"SELECT c.id, round(theta, 9) AS theta, round(phi, 9) AS phi FROM ({_cells(n)}) c JOIN ({_chain(_all_places(n), steps)}) a ON a.{'nest' if nested else 'ring'} = c.pix"


def neighbours(n: int) -> str:
    """By the pixels' corners on the sphere: an edge's neighbour shares two of them, a corner's neighbour that one alone.

    Steps are numbered as the operator does: +x, -x, +y, -y, then the corners (+, +), (-, -), (+, -), (-, +).
    """
    corner = [
        ("jc", f"(face // 4 + 2)*{n} - u - v"), ("nc", f"CASE WHEN jc < {n} THEN jc WHEN jc > {3 * n} THEN {4 * n} - jc ELSE {n} END"),
        ("zc", f"CASE WHEN jc < {n} THEN 1 - nc*nc / {3 * n * n}e0 WHEN jc > {3 * n} THEN nc*nc / {3 * n * n}e0 - 1 ELSE ({2 * n} - jc) * 2 / {3 * n}e0 END"),
        ("pc", "CASE WHEN nc = 0 THEN 0 ELSE pi()/4 * (jpl*nc + u - v) / nc END"),
        ("key", "format('{:.7f} {:.7f} {:.7f}', sqrt(1 - zc*zc)*cos(pc) + 2, sqrt(1 - zc*zc)*sin(pc) + 2, zc + 2)"),
    ]
    four = f"SELECT CAST(ring AS BIGINT) AS ring, face, jpl, a, b, x + a AS u, y + b AS v FROM ({_all_places(n)}), (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b)"
    return f"""
    WITH g AS MATERIALIZED ({_chain(four, corner)}),
    pair AS (SELECT p.ring AS p, q.ring AS q, count(*) AS n FROM g p JOIN g q ON p.key = q.key AND p.ring <> q.ring GROUP BY ALL),
    found AS (SELECT k, g1.ring AS p, h1.ring AS q FROM (VALUES (0, 1, 0, 1, 1), (1, 0, 0, 0, 1), (2, 0, 1, 1, 1), (3, 0, 0, 1, 0)) AS e(k, a1, b1, a2, b2)
      JOIN g g1 ON g1.a = a1 AND g1.b = b1 JOIN g g2 ON g2.ring = g1.ring AND g2.a = a2 AND g2.b = b2
      JOIN g h1 ON h1.key = g1.key AND h1.ring <> g1.ring JOIN g h2 ON h2.ring = h1.ring AND h2.key = g2.key
      UNION ALL SELECT k, g1.ring, h1.ring FROM (VALUES (4, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, 1)) AS d(k, a1, b1)
      JOIN g g1 ON g1.a = a1 AND g1.b = b1 JOIN g h1 ON h1.key = g1.key JOIN pair ON pair.p = g1.ring AND pair.q = h1.ring AND pair.n = 1)
    SELECT c_custkey AS id, CAST(r.k AS INT) AS k, coalesce(q, -1) AS n FROM customer CROSS JOIN range(8) AS r(k) LEFT JOIN found ON found.p = (c_custkey * 7919) % {12 * n * n} AND found.k = r.k"""


_BENT = "SELECT p_partkey AS id, (p_partkey % 61) / 1e2 - 0.3e0 AS u, (p_partkey % 53) / 1e2 - 0.25e0 AS v FROM part"


# -- stretches: the published curves, in 32 bits where the results are ------------------------------------------------
_RGB = "SELECT p_partkey AS id, CAST(p_retailprice / 25e2 AS FLOAT) AS r, CAST(p_size / 51e0 AS FLOAT) AS g, CAST((p_partkey % 256) / 255e0 AS FLOAT) AS b FROM part"


def _shown(value: str, name: str = "value") -> str:
    return f"round(CAST(CAST({value} AS FLOAT) AS DOUBLE), 5) AS {name}"


def hyperbolic(q: str, slope: str, x: str = "r", d: float = 2.0, lp: float = 0.1, sp: float = 0.3, hp: float = 0.9) -> str:
    """An odd curve about sp, S(x) = sign(x - sp) q(|x - sp|), straight beyond lp and hp, scaled to go from 0 to 1."""
    rate = f"(exp({d}e0) - 1)"
    at = lambda form, u: "(" + form.replace("D", rate).replace("U", f"({u})") + ")"
    low, high = f"(-{at(q, f'{sp}e0 - {lp}e0')})", at(q, f"{hp}e0 - {sp}e0")
    below, above = at(slope, f"{sp}e0 - {lp}e0"), at(slope, f"{hp}e0 - {sp}e0")

    def curve(v: str) -> str:
        return f"(CASE WHEN {v} < {lp}e0 THEN {low} + {below}*({v} - {lp}e0) WHEN {v} < {sp}e0 THEN -{at(q, f'{sp}e0 - {v}')} WHEN {v} < {hp}e0 THEN {at(q, f'{v} - {sp}e0')} ELSE {high} + {above}*({v} - {hp}e0) END)"

    v = f"CAST({x} AS DOUBLE)"
    return f"least(1, greatest(0, ({curve(v)} - {curve('0e0')}) / ({curve('1e0')} - {curve('0e0')})))"


#: Shape b -> q(u) and its slope, with D the rate.
SHAPES = {
    "log": ("ln(1 + D*U)", "D / (1 + D*U)"),
    "exp": ("1 - exp(-D*U)", "D * exp(-D*U)"),
    "neg": ("2 * (1 - 1 / (1 + 0.5e0*D*U))", "D * pow(1 + 0.5e0*D*U, -2)"),
    "pow": ("1 - pow(1 + 1.5e0*D*U, -1/1.5e0)", "D * pow(1 + 1.5e0*D*U, -1/1.5e0 - 1)"),
}


def stretches() -> dict[str, str]:
    raised = lambda c, low: f"(({c} - {low}::FLOAT) * (1 / (1 - {low}))::FLOAT)"
    sinh = lambda x: f"CAST(ln(CAST({x} AS DOUBLE) + sqrt(pow(CAST({x} AS DOUBLE), 2) + 1)) AS FLOAT)"
    mtf_x = "((r - 0.1::FLOAT) * CAST(1::FLOAT / (0.9::FLOAT - 0.1::FLOAT) AS FLOAT))"
    out = {
        "stretch_linear": f"SELECT id, {_shown('greatest(0::FLOAT, (r - 0.2::FLOAT) * 1.25::FLOAT)')} FROM ({_RGB})",
        "stretch_asinh": f"SELECT id, {_shown(f'CASE WHEN x <= 0 THEN 0::FLOAT ELSE least(1::FLOAT, CAST({sinh("10::FLOAT * x")} / CAST(asinh(10) AS FLOAT) AS FLOAT)) END')} FROM (SELECT id, {raised('r', 0.05)} AS x FROM ({_RGB}))",
        "stretch_mtf": f"SELECT id, {_shown('CASE WHEN r <= 0.1::FLOAT THEN 0::FLOAT WHEN r >= 0.9::FLOAT THEN 1::FLOAT ELSE CAST((0.25::FLOAT - 1::FLOAT) * x / ((2::FLOAT * 0.25::FLOAT - 1::FLOAT) * x - 0.25::FLOAT) AS FLOAT) END')} FROM (SELECT *, {mtf_x} AS x FROM ({_RGB}))",
        "stretch_quantize8": f"SELECT id, CAST(floor(least(greatest(CAST(r AS DOUBLE), 0), 1) * 255 + 0.5e0) AS INT) AS level FROM ({_RGB})",
    }
    for name, (q, slope) in SHAPES.items():
        out[f"stretch_ght_{name}"] = f"SELECT id, {_shown(hyperbolic(q, slope))} FROM ({_RGB})"
    return out


def oracles() -> dict[str, str]:
    """Query name -> oracle."""
    from ..functions.frames import GALACTIC, SUPERGALACTIC

    turned = lambda m: tuple(zip(*m))
    times = lambda a, b: tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))
    both = times(GALACTIC, turned(GALACTIC))  # by way of the equatorial axes; one up to the digits of the constants
    out = {
        "frame_eq_gal": by_vectors(GALACTIC), "frame_gal_eq": by_vectors(turned(GALACTIC)), "frame_gal_sgal": by_vectors(times(turned(SUPERGALACTIC), both)), "frame_sgal_gal": by_vectors(times(both, SUPERGALACTIC)),
        "frame_eq_sgal": by_vectors(times(turned(SUPERGALACTIC), GALACTIC)), "frame_sgal_eq": by_vectors(times(turned(GALACTIC), SUPERGALACTIC)),
        "frame_eq_ecl": ecliptic(False), "frame_ecl_eq": ecliptic(True), "frame_precess": precession(False), "frame_precess_back": precession(True),
        "hpx_ring2nest": ring2nest(64), "hpx_nest2ring": nest2ring(64), "hpx_pix2ang_ring": pix2ang(16, False), "hpx_pix2ang_nest": pix2ang(16, True),
        "hpx_utils": "SELECT n AS nside, CAST(12*n*n AS BIGINT) AS npix, (n & (n - 1)) = 0 AS pow2, round(4*pi() / (12*n*n), 12) AS pixel_area, round(sqrt(4*pi() / (12*n*n)), 12) AS pixel_resolution FROM (SELECT n_nationkey + 1 AS n FROM nation)",
        "hpx_neighbors": neighbours(16), "sky_degrade": "SELECT o_orderkey AS id, (o_orderkey * 7919 % 49152) >> 4 AS parent FROM orders",
    }
    out |= {
        "sip_forward": f"SELECT id, round(u + 0.01e0*u*u + 0.02e0*u*v, 10) AS x, round(v - 0.01e0*v*v + 0.005e0*u*u*u, 10) AS y FROM ({_BENT})",
        "tnx_forward": f"SELECT id, round(u + 0.001e0 + 0.002e0*u + 0.003e0*(3*u*u - 1)/2 + 0.004e0*v + 0.005e0*u*v + 0.006e0*(3*v*v - 1)/2, 10) AS x, round(v + 0.001e0 + 0.002e0*u + 0.003e0*v + 0.004e0*u*v, 10) AS y FROM ({_BENT})",
        "tpv_forward": f"SELECT id, round(u + 0.01e0*r + 0.02e0*u*u + 0.1e0*pow(r, 7), 10) AS x, round(v + 0.01e0*v*u + 0.03e0*pow(r, 3), 10) AS y FROM (SELECT *, sqrt(u*u + v*v) AS r FROM ({_BENT}))",
    }
    for n in (16, 64):
        out |= {f"hpx_ang2pix_ring_{n}": ang2pix_ring(n), f"hpx_ang2pix_nest_{n}": ang2pix_nest(n)}
    out |= stretches()
    for code in [*ZENITHAL, *CONIC, *OTHER]:
        out |= {f"wcs_pix2sky_{code}": pixel_to_sky(code), f"wcs_sky2pix_{code}": sky_to_pixel(code)}
    return out
