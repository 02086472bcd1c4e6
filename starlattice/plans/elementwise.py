"""Queries that are layered expressions: frames, HEALPix, world coordinates, distortions, stretches, quantising."""

from __future__ import annotations

import math

from ..functions import healpix as hp
from ..functions import stretch as st
from ..functions.algebra import layered as formula
from ..functions.distortion import Sip, Surface, Tnx, Tpv
from ..functions.frames import frame_matrix, precession, rotation_layers, transpose
from ..functions.layers import f32, num, render, whole
from ..functions.projections import PROJECTIONS
from ..functions.wcs import Transform, parse
from . import published
from .tables import ORACLES, layered, query, register, rounded, sky, table

# -- frames ----------------------------------------------------------------------------------------------------------
FRAMES = {
    "frame_eq_gal": frame_matrix("equatorial", "galactic"), "frame_gal_eq": frame_matrix("galactic", "equatorial"),
    "frame_eq_ecl": frame_matrix("equatorial", "ecliptic", 2455197.5), "frame_ecl_eq": frame_matrix("ecliptic", "equatorial", 2455197.5),
    "frame_gal_sgal": frame_matrix("galactic", "supergalactic"), "frame_sgal_gal": frame_matrix("supergalactic", "galactic"),
    "frame_eq_sgal": frame_matrix("equatorial", "supergalactic"), "frame_sgal_eq": frame_matrix("supergalactic", "equatorial"),
    "frame_precess": precession(2000.0, 2050.0), "frame_precess_back": transpose(precession(2000.0, 2050.0)),
}
for _name, _matrix in FRAMES.items():
    layered(_name, "customer", sky("c_custkey"), rotation_layers(_matrix, "lon", "lat", "lon2", "lat2"), {"id": "id"} | rounded("lon2", "lat2"))

# -- HEALPix ---------------------------------------------------------------------------------------------------------
ANGLES = {"theta": f"(90e0 - lat) * {num(math.pi / 180)}", "phi": f"lon * {num(math.pi / 180)}"}
for _n in (16, 64):
    layered(f"hpx_ang2pix_ring_{_n}", "orders", sky("o_orderkey"), [ANGLES, *hp.ang2pix_layers("theta", "phi", _n, "pix")], {"id": "id", "pix": "pix"})
    layered(f"hpx_ang2pix_nest_{_n}", "orders", sky("o_orderkey"), [ANGLES, *hp.ang2pix_layers("theta", "phi", _n, "pix", True)], {"id": "id", "pix": "pix"})
_pixel = lambda n: {"id": "CAST(o_orderkey AS BIGINT)", "pix": f"CAST((o_orderkey * 7919) % {hp.npix(n)} AS BIGINT)"}
layered("hpx_ring2nest", "orders", _pixel(64), hp.ring2nest_layers("pix", 64, "nest"), {"id": "id", "nest": "nest"})
layered("hpx_nest2ring", "orders", _pixel(64), hp.nest2ring_layers("pix", 64, "ring"), {"id": "id", "ring": "ring"})
layered("hpx_pix2ang_ring", "orders", _pixel(16), hp.pix2ang_layers("pix", 16, "theta", "phi"), {"id": "id"} | rounded("theta", "phi", digits=9))
layered("hpx_pix2ang_nest", "orders", _pixel(16), hp.pix2ang_layers("pix", 16, "theta", "phi", True), {"id": "id"} | rounded("theta", "phi", digits=9))
_cells = {"id": "CAST(c_custkey AS BIGINT)", "pix": f"CAST((c_custkey * 7919) % {hp.npix(16)} AS BIGINT)"}
_steps = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(hp.STEPS))
_xyf = render(hp.ring2xyf_layers("pix", 16), f"SELECT {', '.join(f'{e} AS {n}' for n, e in _cells.items())} FROM customer", ["id", "hp_f", "hp_x", "hp_y"])


@query("hpx_neighbors", render(hp.neighbour_layers(16, "n"), f"SELECT * FROM ({_xyf}) AS c, (VALUES {_steps}) AS s(k, dx, dy)", ["id", "CAST(k AS INT) AS k", "CAST(n AS BIGINT) AS n"]))
def neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in _cells.items()])
    return hp.neighbours(rows, "pix", 16, "n").selectExpr("id", "k", "CAST(n AS BIGINT) AS n")


layered("hpx_utils", "nation", {"nside": "CAST(n_nationkey + 1 AS BIGINT)"}, hp.utilities_layers(), {"nside": "nside", "npix": "npix", "pow2": "pow2"} | rounded("pixel_area", "pixel_resolution", digits=12))
layered("sky_degrade", "orders", _pixel(64), [{"parent": hp.degrade("pix", 2)}], {"id": "id", "parent": "parent"})

# -- world coordinates -----------------------------------------------------------------------------------------------
PARAMETERS = {"AZP": {1: 2.0, 2: 30.0}, "SZP": {1: 2.0, 2: 30.0, 3: 60.0}, "SIN": {1: 0.1, 2: -0.2}, "ZPN": {1: 1.0, 2: 0.05, 3: -0.02}, "COP": {1: 45.0, 2: 10.0}, "COE": {1: 45.0, 2: 10.0}, "COD": {1: 45.0, 2: 10.0}, "COO": {1: 45.0, 2: 10.0}, "BON": {1: 40.0}, "CEA": {1: 0.8}}


def description(code: str, **more) -> dict:
    own = {f"PV2_{i}": v for i, v in PARAMETERS.get(code, {}).items()}
    return {"NAXIS": 2, "CTYPE1": f"RA---{code}", "CTYPE2": f"DEC--{code}", "CRVAL1": 150.0, "CRVAL2": 30.0, "CRPIX1": 200.0, "CRPIX2": 200.0, "CDELT1": -0.05, "CDELT2": 0.05} | own | more


GRID = {"id": "CAST(p_partkey AS BIGINT)", "p1": "CAST(p_partkey % 61 AS DOUBLE) * 25e-1 + 125e0", "p2": "CAST(p_partkey % 53 AS DOUBLE) * 25e-1 + 135e0"}
SKY_GRID = {"id": "CAST(p_partkey AS BIGINT)", "ra": "CAST(p_partkey % 61 AS DOUBLE) / 10e0 + 147e0", "dec": "CAST(p_partkey % 53 AS DOUBLE) / 10e0 + 275e-1"}


def _iterated(name: str, transform: Transform, direction: str, base: dict, ins: tuple[str, str], outs: tuple[str, str], digits: int) -> None:
    """A direction without closed form: a vectorised function, and no oracle."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in base.items()])
        return transform.apply(df, direction, *ins, *outs).selectExpr("id", *[f"round({o}, {digits}) AS {o}" for o in outs])

    register(name, run)


def _both(code: str, transform: Transform) -> None:
    for direction, base, ins, outs, digits in (("pixel_to_sky", GRID, ("p1", "p2"), ("ra", "dec"), 7), ("sky_to_pixel", SKY_GRID, ("ra", "dec"), ("p1", "p2"), 6)):
        name = f"wcs_{'pix2sky' if direction == 'pixel_to_sky' else 'sky2pix'}_{code}"
        if transform.closed["inverse" if direction == "pixel_to_sky" else "forward"]:
            out = {o: f"round({o}_o, {digits})" for o in outs}
            layered(name, "part", base, transform.layers(direction, *ins, *[f"{o}_o" for o in outs]), {"id": "id"} | out)
        else:
            _iterated(name, transform, direction, base, ins, outs, digits)


for _code in PROJECTIONS:
    _both(_code.lower(), Transform(parse(description(_code))))


def _there_and_back(name: str, transform: Transform) -> None:
    """Pixels to sky and back by iteration: the pixels again."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in GRID.items()])
        sky_ = transform.apply(df, "pixel_to_sky", "p1", "p2", "ra", "dec").select("id", "ra", "dec")
        return transform.apply(sky_, "sky_to_pixel", "ra", "dec", "q1", "q2").selectExpr("id", "round(q1, 5) + 0 AS q1", "round(q2, 5) + 0 AS q2")

    register(name, run, "SELECT p_partkey AS id, round((p_partkey % 61) * 2.5e0 + 125, 5) AS q1, round((p_partkey % 53) * 2.5e0 + 135, 5) AS q2 FROM part")


_both("tan_sip", Transform(parse(description("TAN", CTYPE1="RA---TAN-SIP", CTYPE2="DEC--TAN-SIP", A_2_0=1e-4, A_1_1=2e-5, B_0_2=-5e-5, B_2_1=1e-7))))
_both("tpv", Transform(parse(description("TPV", PV1_1=1.0, PV1_3=1e-3, PV1_4=2e-3, PV2_1=1.0, PV2_5=1e-3, PV2_11=5e-4))))
_WAT = 'wtype=tnx lngcor = "1. 3. 3. 2. -5. 5. -5. 5. 1e-3 2e-3 1e-3 5e-4 1e-3 2e-4 " '
_both("tnx", Transform(parse(description("TNX", WAT1_001=_WAT, WAT2_001=_WAT.replace("lngcor", "latcor")))))

_there_and_back("wcs_roundtrip_tan_sip", Transform(parse(description("TAN", CTYPE1="RA---TAN-SIP", CTYPE2="DEC--TAN-SIP", A_2_0=1e-4, A_1_1=2e-5, B_0_2=-5e-5, B_2_1=1e-7))))
_there_and_back("wcs_roundtrip_tpv", Transform(parse(description("TPV", PV1_1=1.0, PV1_3=1e-3, PV1_4=2e-3, PV2_1=1.0, PV2_5=1e-3, PV2_11=5e-4))))
_there_and_back("wcs_roundtrip_tnx", Transform(parse(description("TNX", WAT1_001=_WAT, WAT2_001=_WAT.replace("lngcor", "latcor")))))

_uv = {"id": "CAST(p_partkey AS BIGINT)", "u": "CAST(p_partkey % 61 AS DOUBLE) / 1e2 - 3e-1", "v": "CAST(p_partkey % 53 AS DOUBLE) / 1e2 - 25e-2"}
_bends = {
    "sip_forward": Sip({(2, 0): 1e-2, (1, 1): 2e-2}, {(0, 2): -1e-2, (3, 0): 5e-3}), "tpv_forward": Tpv({1: 1.0, 3: 0.01, 4: 0.02, 39: 0.1}, {1: 1.0, 5: 0.01, 11: 0.03}),
    "tnx_forward": Tnx(Surface(2, 3, 3, 2, (-1, 1, -1, 1), [1e-3, 2e-3, 3e-3, 4e-3, 5e-3, 6e-3]), Surface(3, 2, 2, 1, (-1, 1, -1, 1), [1e-3, 2e-3, 3e-3, 4e-3])),
}
for _name, _bend in _bends.items():
    layered(_name, "part", _uv, formula(_bend.forward, ["u", "v"], ["x", "y"], "d_"), {"id": "id"} | rounded("x", "y", digits=10))

# -- stretches -------------------------------------------------------------------------------------------------------
PIXEL = {"id": "CAST(p_partkey AS BIGINT)", "r": f32("p_retailprice / 25e2"), "g": f32("p_size / 51e0"), "b": f32("CAST(p_partkey % 256 AS DOUBLE) / 255e0")}
_float = lambda n: {n: f"round(CAST({n} AS DOUBLE), 5)"}
_single = {
    "stretch_linear": st.linear("r", 0.2), "stretch_asinh": st.asinh("r", 10.0, 0.05), "stretch_mtf": st.mtf("r", f32(0.1), f32(0.25), f32(0.9)),
    "stretch_ght_log": st.Ght(2.0, -1.0, 0.1, 0.3, 0.9).expression("r"), "stretch_ght_neg": st.Ght(2.0, -0.5, 0.1, 0.3, 0.9).expression("r"),
    "stretch_ght_exp": st.Ght(2.0, 0.0, 0.1, 0.3, 0.9).expression("r"), "stretch_ght_pow": st.Ght(2.0, 1.5, 0.1, 0.3, 0.9).expression("r"),
}
for _name, _expr in _single.items():
    layered(_name, "part", PIXEL, [{"value": _expr}], {"id": "id"} | _float("value"))
_rgb = st.asinh_rgb("r", "g", "b", 8.0, 0.02)
layered("stretch_asinh_rgb", "part", PIXEL, [{"lum": _rgb["lum"]}, {f"{c}2": _rgb[c] for c in "rgb"}], {"id": "id"} | _float("r2") | _float("g2") | _float("b2"))
layered("stretch_quantize8", "part", PIXEL, [{"level": st.quantize8("CAST(r AS DOUBLE)")}], {"id": "id", "level": "level"})

# -- physical values and quantising ----------------------------------------------------------------------------------
layered("quantize_nodither", "events", {"id": "event_id", "v": "value"}, [{"q": f"CASE WHEN v >= 0 THEN {whole('v / 25e-2 + 5e-1')} ELSE -{whole('-v / 25e-2 + 5e-1')} END"}, {"back": "CAST(q AS DOUBLE) * 25e-2"}], {"id": "id", "q": "q", "back": "back"})

# Oracles written apart from the layers take the place of the rendered ones.
ORACLES.update(published.oracles())
