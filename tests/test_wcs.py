import numpy as np
import pytest

from starlattice.functions import wcs
from starlattice.functions.distortion import Sip, Surface, Tnx, Tpv
from starlattice.functions.algebra import NP
from starlattice.functions.layers import render
from starlattice.functions.projections import PROJECTIONS
from test_projections import PV



def describe(code, **more):
    cards = {"NAXIS": 2, "CTYPE1": f"RA---{code}", "CTYPE2": f"DEC--{code}", "CRVAL1": 150.0, "CRVAL2": 30.0, "CRPIX1": 200.0, "CRPIX2": 200.0, "CDELT1": -0.01, "CDELT2": 0.01}
    cards |= {f"PV2_{i}": v for i, v in PV.get(code, {}).items()}
    return wcs.parse(cards | more)


def test_linear_part():
    """Hand-worked: PC with CDELT and the same CD, rotated by 90 degrees, on a plate carree whose sky is its plane."""
    for cards in ({"PC1_1": 0.0, "PC1_2": -1.0, "PC2_1": 1.0, "PC2_2": 0.0, "CDELT1": 0.5, "CDELT2": 0.25}, {"CD1_1": 0.0, "CD1_2": -0.5, "CD2_1": 0.25, "CD2_2": 0.0}):
        t = wcs.Transform(wcs.parse({"NAXIS": 2, "CTYPE1": "RA---CAR", "CTYPE2": "DEC--CAR", "CRVAL1": 40.0, "CRVAL2": 0.0, "CRPIX1": 11.0, "CRPIX2": 21.0} | cards))
        a, d = t.numpy("pixel_to_sky", np.array([10.0, 14.0]), np.array([20.0, 26.0]))
        assert np.allclose(a, [40.0, 37.0]) and np.allclose(d, [0.0, 1.0])
        x, y = t.numpy("sky_to_pixel", a, d)
        assert np.allclose(x, [10, 14]) and np.allclose(y, [20, 26])


@pytest.mark.parametrize("code", sorted(PROJECTIONS))
def test_round_trip(code):
    t = wcs.Transform(describe(code))
    x, y = np.array([199.0, 202, 197, 203, 194]), np.array([199.0, 203, 204, 196, 195])
    if code in ("ZPN", "SIN", "SZP", "AZP") or t.projection.theta0 == np.pi / 2:
        pass
    a, d = t.numpy("pixel_to_sky", x, y)
    u, v = t.numpy("sky_to_pixel", a, d)
    assert np.allclose(u, x, atol=0.05 if code == "CSC" else 1e-6) and np.allclose(v, y, atol=0.05 if code == "CSC" else 1e-6)


def test_engines_agree(spark):
    import duckdb
    import pandas as pd

    pts = pd.DataFrame({"p": np.arange(150.0, 250, 7), "q": np.arange(250.0, 150, -7)})
    con = duckdb.connect()
    con.register("pts", pts)
    df = spark.createDataFrame(pts)
    for code in ("TAN", "SIN", "AZP", "CYP", "AIT", "COE", "BON", "QSC", "HPX", "ZPN"):
        t = wcs.Transform(describe(code))
        want = np.stack(t.numpy("pixel_to_sky", pts.p, pts.q))
        got = t.apply(df, "pixel_to_sky", "p", "q", "a", "d").toPandas()
        assert np.allclose(got[["a", "d"]].to_numpy().T, want, atol=1e-9), code
        if t.closed["inverse"]:
            text = render(t.layers("pixel_to_sky", "p", "q", "a", "d"), "pts", ["a", "d"])
            assert np.allclose(con.sql(text).df().to_numpy().T, want, atol=1e-9), code


def test_parse():
    assert wcs.split_ctype("RA---TAN-SIP") == ("RA", "TAN", "SIP") and wcs.split_ctype("FREQ") == ("FREQ", "", "")
    with pytest.raises(ValueError):
        wcs.parse({"PC1_1": 1.0, "CD1_1": 1.0})
    w = wcs.parse({"NAXIS": 2, "CTYPE1A": "GLON-CAR", "CTYPE2A": "GLAT-CAR", "CRVAL1A": 5.0, "EPOCH": 1950.0}, "A")
    assert w.celestial and w.code == "CAR" and w.crval[0] == 5 and w.equinox == 1950
    with pytest.raises(ValueError):
        wcs.Transform(describe("TAN", CDELT1=0.0))
    with pytest.raises(ValueError):
        wcs.Transform(wcs.parse({"CTYPE1": "RA---COP", "CTYPE2": "DEC--COP"}))


def test_distortions():
    x, y = np.random.default_rng(1).uniform(-0.4, 0.4, (2, 50))
    sip = Sip.parse({"A_2_0": 1e-2, "A_1_1": 2e-2, "B_0_2": -1e-2})
    assert np.allclose(sip.inverse(*sip.forward(NP, x, y)), (x, y), atol=1e-10)
    plain = Tpv.parse({})
    assert np.allclose(plain.forward(NP, x, y), (x, y))
    tpv = Tpv.parse({(1, 3): 0.01, (1, 4): 0.02, (2, 5): 0.01, (2, 11): 0.03})
    assert np.allclose(tpv.inverse(*tpv.forward(NP, x, y)), (x, y), atol=1e-10)
    for kind in (1, 2, 3):
        s = Surface(kind, 3, 3, 2, (-1, 1, -1, 1), [1e-3, 2e-3, 3e-3, 4e-3, 5e-3, 6e-3])
        tnx = Tnx(s, s)
        assert np.allclose(tnx.inverse(*tnx.forward(NP, x, y)), (x, y), atol=1e-10)
    text = 'wtype=tnx axtype=ra lngcor = "3. 2. 2. 1. -1. 1. -1. 1. 0.1 0.2 0.3 0.4 "'
    tnx = Tnx.parse({"WAT1_001": text[:68], "WAT1_002": text[68:]})
    assert tnx.lon.coefficients == [0.1, 0.2, 0.3, 0.4] and tnx.lat is None
    t = wcs.Transform(describe("TAN-SIP", A_2_0=1e-4, B_1_1=2e-4, CTYPE1="RA---TAN-SIP", CTYPE2="DEC--TAN-SIP"))
    a, d = t.numpy("pixel_to_sky", [190.0, 215], [205.0, 180])
    assert np.allclose(t.numpy("sky_to_pixel", a, d), ([190, 215], [205, 180]), atol=1e-8)
