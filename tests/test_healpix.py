"""HEALPix against an independent form (SQL from the published definition), round trips and adjacency."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from starlattice.functions import healpix as hp
from starlattice.functions.layers import apply, fenced
from starlattice.plans import published


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("CREATE VIEW orders AS SELECT range AS o_orderkey FROM range(20000)")
    return out


@pytest.mark.parametrize("n", [2, 8, 64])
def test_ang2pix(spark, con, n):
    points = con.execute(f"SELECT id, theta, phi FROM ({published._ANGLES})").fetchall()
    df = spark.createDataFrame(points, "id long, theta double, phi double")
    got = {r.id: (r.ring, r.nest) for r in apply(df, [*hp.ang2pix_layers("theta", "phi", n, "ring"), *hp.xyf2nest_layers(n, "nest", "m_")]).select("id", "ring", "nest").collect()}
    ring, nest = dict(con.execute(published.ang2pix_ring(n)).fetchall()), dict(con.execute(published.ang2pix_nest(n)).fetchall())
    assert got == {i: (ring[i], nest[i]) for i in ring}


@pytest.mark.parametrize("n", [1, 2, 4, 32])
def test_ordering_and_centres(spark, con, n):
    want = con.execute(f"SELECT nest, ring FROM ({published._all_places(n)})").fetchall()
    assert sorted(r for _, r in want) == list(range(12 * n * n))
    df = spark.createDataFrame(want, "n long, r long")
    out = apply(apply(df, hp.ring2nest_layers("r", n, "to_nest")).select("r", "n", "to_nest"), hp.nest2ring_layers("n", n, "to_ring")).collect()
    assert all(x.to_nest == x.n and x.to_ring == x.r for x in out)
    for nested in (False, True):
        centres = dict((r[0], r[1:]) for r in con.execute(published.pix2ang(n, nested).replace("(o_orderkey * 7919)", "o_orderkey")).fetchall())
        for x in apply(spark.range(12 * n * n).withColumnRenamed("id", "pix"), hp.pix2ang_layers("pix", n, "theta", "phi", nested)).collect():
            assert abs(x.theta - centres[x.pix][0]) < 2e-9 and abs(x.phi - centres[x.pix][1]) < 2e-9


def test_known_pixels(spark):
    """Hand-worked: of twelve pixels the first has its centre at z = 2/3, 45 degrees; the fifth lies on the equator at 0."""
    r = {x.pix: x for x in apply(spark.range(12).withColumnRenamed("id", "pix"), hp.pix2ang_layers("pix", 1, "theta", "phi")).collect()}
    assert abs(math.cos(r[0].theta) - 2 / 3) < 1e-12 and abs(r[0].phi - math.pi / 4) < 1e-12
    assert abs(r[4].theta - math.pi / 2) < 1e-12 and abs(r[4].phi) < 1e-12 and abs(math.cos(r[11].theta) + 2 / 3) < 1e-12


def test_neighbours(spark, con):
    """Inside a face they are the eight places around; everywhere they are mutual, near, and eight or (24 pixels) seven."""
    n = 8
    places = {nest: (f, x, y) for nest, f, x, y in con.execute(f"SELECT nest, face, x, y FROM ({published._all_places(n)})").fetchall()}
    at = {v: k for k, v in places.items()}
    df = spark.range(12 * n * n).withColumnRenamed("id", "pix")
    got = {r.pix: set(r.got) - {-1} for r in hp.neighbours(df, "pix", n, "o", True).groupBy("pix").agg(F.collect_set("o").alias("got")).collect()}
    for p, (f, x, y) in places.items():
        if 0 < x < n - 1 and 0 < y < n - 1:
            assert got[p] == {at[f, x + i, y + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j}
        assert all(p in got[q] for q in got[p]) and p not in got[p]
    assert sorted(map(len, got.values())) == [7] * 24 + [8] * (12 * n * n - 24)
    v = {r.pix: (math.sin(r.theta) * math.cos(r.phi), math.sin(r.theta) * math.sin(r.phi), math.cos(r.theta)) for r in apply(df, hp.pix2ang_layers("pix", n, "theta", "phi", True)).collect()}
    assert all(math.dist(v[p], v[q]) < 3 * hp.pixel_resolution(n) for p in got for q in got[p])
    ring = {r.pix: set(r.got) - {-1} for r in hp.neighbours(df, "pix", n, "o").groupBy("pix").agg(F.collect_set("o").alias("got")).collect()}
    order = dict(con.execute(f"SELECT nest, ring FROM ({published._all_places(n)})").fetchall())
    assert ring == {order[p]: {order[q] for q in own} for p, own in got.items()}


def test_round_trip(spark):
    for n in (1, 2, 3, 4, 7, 16):
        df = spark.range(hp.npix(n)).withColumnRenamed("id", "pix")
        back = apply(apply(df, hp.pix2ang_layers("pix", n, "theta", "phi")).select("pix", "theta", "phi"), hp.ang2pix_layers("theta", "phi", n, "again"))
        back = fenced(back.select("pix", "again"))
        assert back.filter("pix <> again").count() == 0, n


def test_utilities():
    for n in (1, 2, 5, 64, 8192):
        assert hp.npix(n) == 12 * n * n and hp.nside_of(12 * n * n) == n and hp.nside_of(12 * n * n + 1) is None
        assert abs(hp.pixel_area(n) - math.pi / (3 * n * n)) < 1e-15 and abs(hp.pixel_resolution(n) - math.sqrt(math.pi / 3) / n) < 1e-15
        # the largest radius belongs to the pixel at the corner of polar cap and belt: from (z = 2/3, pi / 4n) to the corner on the cap's edge
        za, zb = 2 / 3, 1 - (1 - 1 / n) ** 2 / 3
        a = (math.sqrt(1 - za * za) * math.cos(math.pi / (4 * n)), math.sqrt(1 - za * za) * math.sin(math.pi / (4 * n)), za)
        b = (math.sqrt(1 - zb * zb), 0.0, zb)
        assert abs(hp.max_pixel_radius(n) - 2 * math.asin(math.dist(a, b) / 2)) < 1e-9
