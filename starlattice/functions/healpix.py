"""HEALPix pixelisation (Gorski et al. 2005) as layered SQL expressions, all integer work in 64 bits.

Faces are cut in an x axis towards north-east and a y axis towards north-west. Ring numbers come in closed form: the
polar ring from an integer square root that is corrected by one where rounding was off, the belt by division.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .layers import Layer, apply, div, fenced, num, whole

HALF_PI, PI = num(math.pi / 2), num(math.pi)


def is_power_of_two(nside: int) -> bool:
    return nside > 0 and nside & (nside - 1) == 0


def npix(nside: int) -> int:
    return 12 * nside * nside


def nside_of(count: int) -> int | None:
    """The inverse of npix, None if no map has that many pixels."""
    n = math.isqrt(count // 12) if count > 0 else 0
    return n if n and npix(n) == count else None


def pixel_area(nside: int) -> float:
    return 4 * math.pi / npix(nside)


def pixel_resolution(nside: int) -> float:
    return math.sqrt(pixel_area(nside))


def max_pixel_radius(nside: int) -> float:
    """The largest angle between a pixel's centre and one of its corners: between the centre and the top of a pixel at the cap's border."""
    za, pa = 2 / 3, math.pi / (4 * nside)
    t = 1 - 1 / nside
    zb = 1 - t * t / 3
    sa, sb = math.sqrt(1 - za * za), math.sqrt(1 - zb * zb)
    a = (sa * math.cos(pa), sa * math.sin(pa), za)
    b = (sb, 0.0, zb)
    cross = math.sqrt((a[1] * b[2] - a[2] * b[1]) ** 2 + (a[2] * b[0] - a[0] * b[2]) ** 2 + (a[0] * b[1] - a[1] * b[0]) ** 2)
    return math.atan2(cross, sum(p * q for p, q in zip(a, b)))


def utilities_layers(nside: str = "nside") -> list[Layer]:
    """npix, pixel_area and pixel_resolution of a column of resolutions; pow2 tells whether NESTED is defined."""
    return [
        {"npix": f"12 * {nside} * {nside}", "pow2": f"({nside} > 0 AND ({nside} & ({nside} - 1)) = 0)"},
        {"pixel_area": f"{num(4 * math.pi)} / npix"},
        {"pixel_resolution": "sqrt(pixel_area)"},
    ]


def _clamped(expr: str, nside: int) -> str:
    return f"least(greatest({whole(expr)}, 0), {nside - 1})"


def ang2xyf_layers(theta: str, phi: str, nside: int, p: str = "hp_") -> list[Layer]:
    """Face and cell {p}f, {p}x, {p}y of colatitude and longitude in radians."""
    n = num(nside)
    return [
        {f"{p}z": f"cos({theta})", f"{p}w": f"({phi}) - {num(2 * math.pi)} * floor(({phi}) / {num(2 * math.pi)})"},
        {f"{p}sector": f"floor({p}w / {HALF_PI})", f"{p}polar": f"abs({p}z) >= {num(2 / 3)}"},
        {f"{p}t": f"{p}w - {p}sector * {HALF_PI}", f"{p}col": f"CAST({p}sector AS BIGINT) % 4"},
        {
            f"{p}a": f"CASE WHEN {p}polar THEN {n} * sqrt(3e0 * (1e0 - abs({p}z))) * ({PI} - 2e0 * {p}t) / {PI} ELSE {n} * (({p}z + {num(2 / 3)}) * 75e-2 + {p}t / {HALF_PI}) END",
            f"{p}b": f"CASE WHEN {p}polar THEN {n} * sqrt(3e0 * (1e0 - abs({p}z))) * 2e0 * {p}t / {PI} ELSE {n} * (({p}z + {num(2 / 3)}) * 75e-2 - {p}t / {HALF_PI} + 1e0) END",
        },
        {
            f"{p}f": f"CASE WHEN {p}polar THEN CASE WHEN {p}z > 0 THEN {p}col ELSE 8 + {p}col END"
            f" WHEN {p}a >= {n} AND {p}b >= {n} THEN {p}col WHEN {p}a >= {n} THEN 4 + ({p}col + 1) % 4 WHEN {p}b >= {n} THEN 4 + {p}col ELSE 8 + {p}col END",
            f"{p}u": f"CASE WHEN {p}polar THEN CASE WHEN {p}z > 0 THEN {n} - {p}a ELSE {p}b END WHEN {p}a >= {n} THEN {p}a - {n} ELSE {p}a END",
            f"{p}v": f"CASE WHEN {p}polar THEN CASE WHEN {p}z > 0 THEN {n} - {p}b ELSE {p}a END WHEN {p}b >= {n} THEN {p}b - {n} ELSE {p}b END",
        },
        {f"{p}x": _clamped(f"{p}u", nside), f"{p}y": _clamped(f"{p}v", nside)},
    ]


def _spread(x: str) -> list[str]:
    """Expressions that put a zero between the bits of a 31-bit number, each over the one before ({0})."""
    masks = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
    return [f"({{0}} | ({{0}} << {s})) & {m}" for s, m in masks]


def xyf2nest_layers(nside: int, out: str, p: str = "hp_", source: str = "hp_") -> list[Layer]:
    layers: list[Layer] = [{f"{p}mx": f"CAST({source}x AS BIGINT)", f"{p}my": f"CAST({source}y AS BIGINT)"}]
    for k, step in enumerate(_spread("")):
        before = str(k - 1) if k else ""
        layers.append({f"{p}mx{k}": step.format(f"{p}mx{before}"), f"{p}my{k}": step.format(f"{p}my{before}")})
    layers.append({out: f"CAST({source}f AS BIGINT) * {nside * nside} + ({p}mx4 | ({p}my4 << 1))"})
    return layers


def xyf2ring_layers(nside: int, out: str, p: str = "hp_", source: str = "hp_") -> list[Layer]:
    x, y, f = f"{source}x", f"{source}y", f"{source}f"
    cap, total = 2 * nside * (nside - 1), npix(nside)
    return [
        {f"{p}row": div(f, 4), f"{p}fc": f"{f} % 4"},
        {f"{p}ring": f"({p}row + 2) * {nside} - {x} - {y} - 1"},
        {f"{p}south": f"4 * {nside} - {p}ring", f"{p}odd": f"({p}ring + {nside}) % 2", f"{p}shift": f"(2 * {p}fc - {p}row % 2 + 1) * {nside} + {x} - {y}"},
        {
            out: f"CASE WHEN {p}ring < {nside} THEN 2 * {p}ring * ({p}ring - 1) + {p}fc * {p}ring + ({nside} - 1 - {y})"
            f" WHEN {p}ring > {3 * nside} THEN {total} - 2 * {p}south * ({p}south + 1) + {p}fc * {p}south + ({p}south - 1 - {y})"
            f" ELSE {cap} + {4 * nside} * ({p}ring - {nside}) + ({whole(f'CAST({p}shift + {p}odd AS DOUBLE) / 2e0')} + {4 * nside}) % {4 * nside} END"
        },
    ]


def nest2xyf_layers(pix: str, nside: int, p: str = "hp_") -> list[Layer]:
    area = nside * nside
    layers: list[Layer] = [{f"{p}f": div(pix, area), f"{p}in": f"{pix} % {area}"}, {f"{p}cx": f"{p}in & {0x5555555555555555}", f"{p}cy": f"({p}in >> 1) & {0x5555555555555555}"}]
    steps = ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF))
    for k, (s, m) in enumerate(steps):
        before = str(k - 1) if k else ""
        layers.append({f"{p}c{a}{k}": f"({p}c{a}{before} | ({p}c{a}{before} >> {s})) & {m}" for a in "xy"})
    return [*layers, {f"{p}x": f"{p}cx4", f"{p}y": f"{p}cy4"}]


def ring2xyf_layers(pix: str, nside: int, p: str = "hp_") -> list[Layer]:
    """Ring and place in closed form; the square root is corrected so that 2 r (r - 1) <= pix < 2 r (r + 1)."""
    cap, total, four = 2 * nside * (nside - 1), npix(nside), 4 * nside
    return [
        {f"{p}north": f"{pix} < {cap}", f"{p}belt": f"{pix} >= {cap} AND {pix} < {total - cap}"},
        {f"{p}q": f"CASE WHEN {p}north THEN {pix} ELSE {total - 1} - {pix} END"},
        {f"{p}g": whole(f"(1e0 + sqrt(1e0 + 2e0 * {p}q)) / 2e0")},
        {f"{p}r": f"CASE WHEN 2 * {p}g * ({p}g - 1) > {p}q THEN {p}g - 1 WHEN 2 * {p}g * ({p}g + 1) <= {p}q THEN {p}g + 1 ELSE {p}g END"},
        {
            f"{p}i": f"CASE WHEN {p}belt THEN {div(f'({pix} - {cap})', four)} + {nside} WHEN {p}north THEN {p}r ELSE {four} - {p}r END",
            f"{p}j": f"CASE WHEN {p}belt THEN ({pix} - {cap}) % {four} WHEN {p}north THEN {pix} - 2 * {p}r * ({p}r - 1) ELSE 4 * {p}r - 1 - ({p}q - 2 * {p}r * ({p}r - 1)) END",
        },
        # belt: u and v count quarter-turn diagonals towards north-east and north-west
        {
            f"{p}u2": f"2 * {p}j - ({p}i + {nside}) % 2 + ({2 * nside} - {p}i)",
            f"{p}v2": f"2 * {p}j - ({p}i + {nside}) % 2 - ({2 * nside} - {p}i)",
        },
        {f"{p}fu": whole(f"CAST({p}u2 + {nside} AS DOUBLE) / {2 * nside}"), f"{p}fv": whole(f"CAST({p}v2 + {nside} AS DOUBLE) / {2 * nside}")},
        {
            f"{p}f": f"CASE WHEN {p}belt THEN CASE WHEN {p}fu = {p}fv THEN 4 + {p}fu % 4 WHEN {p}fu > {p}fv THEN {p}fv % 4 ELSE 8 + {p}fu % 4 END"
            f" WHEN {p}north THEN {div(f'{p}j', f'{p}r')} ELSE 8 + {div(f'{p}j', f'{p}r')} END",
        },
        {
            f"{p}x": f"CASE WHEN {p}belt THEN {whole(f'CAST({p}u2 + {nside} - {2 * nside} * {p}fu AS DOUBLE) / 2e0')}"
            f" WHEN {p}north THEN {nside} - {p}r + {p}j % {p}r ELSE {p}j % {p}r END",
            f"{p}y": f"CASE WHEN {p}belt THEN {nside} - 1 - {whole(f'CAST({p}v2 + {nside} - {2 * nside} * {p}fv AS DOUBLE) / 2e0')}"
            f" WHEN {p}north THEN {nside} - 1 - {p}j % {p}r ELSE {p}r - 1 - {p}j % {p}r END",
        },
    ]


def xyf2ang_layers(nside: int, theta: str, phi: str, p: str = "hp_") -> list[Layer]:
    """Colatitude and longitude of the centre of the cell, colatitude from the height and the radius of its circle."""
    n = num(nside)
    return [
        {f"{p}px": f"({p}x + 5e-1) / {n}", f"{p}py": f"({p}y + 5e-1) / {n}", f"{p}pf": div(f"{p}f", 4), f"{p}pc": f"{p}f % 4"},
        {f"{p}sum": f"{p}px + {p}py", f"{p}ox": f"CASE WHEN {p}f >= 8 THEN {p}py ELSE 1e0 - {p}px END", f"{p}oy": f"CASE WHEN {p}f >= 8 THEN {p}px ELSE 1e0 - {p}py END"},
        {f"{p}cap": f"({p}f < 4 AND {p}sum > 1e0) OR ({p}f >= 8 AND {p}sum < 1e0)", f"{p}s": f"{p}ox + {p}oy"},
        {
            f"{p}h": f"CASE WHEN {p}cap THEN {p}s * {p}s / 3e0 ELSE 1e0 - abs({num(2 / 3)} * ({p}sum - {p}pf)) END",
            f"{p}up": f"CASE WHEN {p}cap THEN {p}f < 4 ELSE {p}sum >= {p}pf END",
            f"{p}east": f"CASE WHEN {p}cap THEN {HALF_PI} * ({p}pc + {p}oy / {p}s) ELSE {num(math.pi / 4)} * ({p}px - {p}py + CASE WHEN {p}pf = 1 THEN 0 ELSE 1 END + 2 * {p}pc) END",
        },
        {f"{p}rho": f"sqrt({p}h * (2e0 - {p}h))"},
        {f"{theta}": f"atan2({p}rho, CASE WHEN {p}up THEN 1e0 - {p}h ELSE {p}h - 1e0 END)", f"{phi}": f"CASE WHEN {p}east < 0 THEN {p}east + {num(2 * math.pi)} ELSE {p}east END"},
    ]


def ang2pix_layers(theta: str, phi: str, nside: int, out: str, nested: bool = False, p: str = "hp_") -> list[Layer]:
    return [*ang2xyf_layers(theta, phi, nside, p), *(xyf2nest_layers if nested else xyf2ring_layers)(nside, out, p, p)]


def pix2ang_layers(pix: str, nside: int, theta: str, phi: str, nested: bool = False, p: str = "hp_") -> list[Layer]:
    return [*(nest2xyf_layers if nested else ring2xyf_layers)(pix, nside, p), *xyf2ang_layers(nside, theta, phi, p)]


def ring2nest_layers(pix: str, nside: int, out: str) -> list[Layer]:
    return [*ring2xyf_layers(pix, nside), *xyf2nest_layers(nside, out)]


def nest2ring_layers(pix: str, nside: int, out: str) -> list[Layer]:
    return [*nest2xyf_layers(pix, nside), *xyf2ring_layers(nside, out)]


#: Steps to the eight neighbours.
STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))


def with_steps(df: DataFrame) -> DataFrame:
    """Each row eight times, with k, dx and dy."""
    steps = ", ".join(f"named_struct('k', {k}, 'dx', {dx}, 'dy', {dy})" for k, (dx, dy) in enumerate(STEPS))
    return df.selectExpr("*", f"explode(array({steps})) AS hp_step").selectExpr(*[f"`{c}`" for c in df.columns], "hp_step.k AS k", "hp_step.dx AS dx", "hp_step.dy AS dy")


def neighbour_layers(nside: int, out: str, nested: bool = False, p: str = "nb_") -> list[Layer]:
    """The neighbour of cell hp_f, hp_x, hp_y at step dx, dy; -1 where a corner has none.

    A step that leaves the face continues on the face beyond that edge. Around a pole edges of one kind meet, so the
    cell's axes swap: beyond a northern face's upper edges x and y trade places and the step ends at the far border.
    """
    last, c = nside - 1, f"{p}fcol"
    side = lambda g: f"CASE WHEN {g} < 0 THEN -1 WHEN {g} > {last} THEN 1 ELSE 0 END"
    at = lambda ox, oy: f"{p}ox = {ox} AND {p}oy = {oy}"
    case = lambda *ways: "CASE " + " ".join(f"WHEN {at(ox, oy)} THEN {to}" for ox, oy, to in ways) + " ELSE -1 END"
    north = case((1, 0, f"({c} + 1) % 4"), (0, 1, f"({c} + 3) % 4"), (1, 1, f"({c} + 2) % 4"), (-1, 0, f"4 + {c}"), (0, -1, f"4 + ({c} + 1) % 4"), (-1, -1, f"8 + {c}"))
    middle = case((1, 0, c), (0, 1, f"({c} + 3) % 4"), (-1, 0, f"8 + ({c} + 3) % 4"), (0, -1, f"8 + {c}"), (1, -1, f"4 + ({c} + 1) % 4"), (-1, 1, f"4 + ({c} + 3) % 4"))
    south = case((1, 0, f"4 + ({c} + 1) % 4"), (0, 1, f"4 + {c}"), (-1, 0, f"8 + ({c} + 3) % 4"), (0, -1, f"8 + ({c} + 1) % 4"), (-1, -1, f"8 + ({c} + 2) % 4"), (1, 1, c))
    edge = f"CASE WHEN {p}frow = 0 THEN {last} ELSE 0 END"  # across a pole the border is the same one on both faces
    return [
        {f"{p}gx": "hp_x + dx", f"{p}gy": "hp_y + dy", f"{p}frow": div("hp_f", 4), c: "hp_f % 4"},
        {f"{p}ox": side(f"{p}gx"), f"{p}oy": side(f"{p}gy")},
        {
            f"{p}f": f"CASE WHEN {at(0, 0)} THEN hp_f WHEN {p}frow = 0 THEN {north} WHEN {p}frow = 1 THEN {middle} ELSE {south} END",
            f"{p}swap": f"({p}frow = 0 AND {p}ox + {p}oy > 0 AND {p}ox >= 0 AND {p}oy >= 0) OR ({p}frow = 2 AND {p}ox + {p}oy < 0 AND {p}ox <= 0 AND {p}oy <= 0)",
            f"{p}wx": f"({p}gx + {nside}) % {nside}", f"{p}wy": f"({p}gy + {nside}) % {nside}",
        },
        {
            f"{p}x": f"CASE WHEN NOT {p}swap THEN {p}wx WHEN {p}ox <> 0 AND {p}oy = 0 THEN {p}wy ELSE {edge} END",
            f"{p}y": f"CASE WHEN NOT {p}swap THEN {p}wy WHEN {p}ox <> 0 THEN {edge} ELSE {p}wx END",
        },
        *(xyf2nest_layers if nested else xyf2ring_layers)(nside, f"{p}raw", p, p),
        {out: f"CASE WHEN {p}f < 0 THEN CAST(-1 AS BIGINT) ELSE {p}raw END"},
    ]


def neighbours(df: DataFrame, pix: str, nside: int, out: str, nested: bool = False) -> DataFrame:
    """The rows of ``df`` for each of the eight steps (k) with the neighbour's number, -1 where there is none."""
    cells = apply(df, (nest2xyf_layers if nested else ring2xyf_layers)(pix, nside)).select(*df.columns, "hp_f", "hp_x", "hp_y")
    return fenced(apply(with_steps(cells), neighbour_layers(nside, out, nested)).select(*df.columns, "k", out))


def degrade(pix: str, levels: int) -> str:
    """The NESTED pixel that holds this one, so many levels up."""
    return f"({pix} >> {2 * levels})"
