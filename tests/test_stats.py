import duckdb
import numpy as np
import pytest

from starlattice.functions import frames, stretch
from starlattice.functions.layers import apply
from starlattice.operators import image, stats

F32 = np.float32


def by_histogram(v, p):
    """A percentile of 32-bit values by its definition: the first bin whose running count reaches p n, and within it."""
    v = np.asarray(v, F32)
    lo, hi, n = v.min(), v.max(), len(v)
    if lo == hi or p <= 0:
        return float(lo)
    bins = min(n, 65536)
    scale = F32((bins - 1) / (np.float64(hi) - np.float64(lo)))
    counts = np.bincount(np.minimum(np.floor(scale * (v - lo)).astype(int), bins - 1), minlength=bins)
    cum, k = np.cumsum(counts), 0
    while cum[k] < p * n or not counts[k]:
        k += 1
    return float(np.clip((k + (p * n - (cum[k] - counts[k])) / counts[k]) / np.float64(scale) + np.float64(lo), lo, hi))


def test_percentiles(spark):
    rng = np.random.default_rng(7)
    cases = {"gradient": (F32(0.01) + (F32(0.3) - F32(0.01)) * np.arange(200, dtype=F32) / F32(199)), "long": np.arange(1000, dtype=F32) / F32(999), "same": np.full(100, F32(0.42)), "single": np.array([3.14], F32), "normal": rng.normal(100, 5, 3000).astype(F32)}
    for name, values in cases.items():
        df = spark.createDataFrame([(float(v),) for v in values], "v float")
        ps = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999]
        got = stats.percentiles(df, [], "v", ps).first()
        assert np.allclose(list(got), [by_histogram(values, p) for p in ps], rtol=1e-6), name
        mm = stats.median_mad(df, [], "v").first()
        middle = by_histogram(values, 0.5)
        away = np.abs(values.astype(float) - middle)
        assert np.isclose(mm["median"], middle, rtol=1e-6) and np.isclose(mm["mad"], np.median(away), rtol=0.02, atol=1e-3), name


def test_missing_and_small(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", None), ("c", 5.0)], "k string, v double")
    got = {r.k: r for r in stats.basic(df, ["k"], "v").collect()}
    assert (got["a"].min, got["a"].max, got["a"].mean, got["a"].n) == (1, 3, 2, 2) and (got["b"].mean, got["c"].stdev) == (0, 0)
    assert {r.k: r.median for r in stats.median(df, ["k"], "v").collect()} == {"a": 3.0, "c": 5.0}  # the upper of two, as selection by histogram gives it
    assert stats.kth(df, ["k"], "v", 1).collect()[0].kth == 3.0
    skew = spark.range(30_000).selectExpr("id % 2 AS k", "CASE WHEN id < 25000 THEN 1.0 ELSE CAST(id * 7919 % 30011 AS DOUBLE) END AS v")
    stats.SORTED, kept = 100, stats.SORTED
    try:
        for k in (0, 6000, 14_000, 20_000):
            got = {r.k: r.kth for r in stats.kth(skew, ["k"], "v", k).collect()}
            assert got == {g: sorted(1.0 if i < 25_000 else float(i * 7919 % 30_011) for i in range(g, 30_000, 2))[k] for g in (0, 1) if k < 15_000}
    finally:
        stats.SORTED = kept
    h = stats.histogram(df.filter("k = 'c'"), [], "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 0, 0, 0]
    zero = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 0.0)], "k string, v double")
    assert sorted((r.k, r.v) for r in stats.filter_nonzero(zero, ["k"], "v").collect()) == [("a", 2.0), ("b", 0.0)]


def test_sigma_clip(spark):
    v = np.concatenate([np.random.default_rng(1).normal(10, 1, 400), [100.0, -80.0]])
    work = v
    for _ in range(10):
        c, s = work.mean(), work.std()
        kept = work[(work >= c - 3 * s) & (work <= c + 3 * s)]
        if len(kept) == len(work):
            break
        work = kept
    got = stats.sigma_clip(spark.createDataFrame([(float(x),) for x in v], "v double"), [], "v", 3.0, 3.0, 10).first()
    assert got.ngood == len(work) and np.isclose(got["mean"], work.mean()) and np.isclose(got.stdev, work.std())


def test_stretches(spark):
    x = np.linspace(0, 1, 41)
    con = duckdb.connect()
    df = spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("CAST(x AS FLOAT) AS x")
    con.register("px", df.toPandas())
    for b in (-1.0, -0.5, 0.0, 1.5):
        e = stretch.Ght(2.0, b, 0.1, 0.3, 0.9).expression("x")
        y = np.array([r.y for r in df.selectExpr(f"{e} AS y").collect()])
        assert y[0] == 0 and y[-1] == 1 and (np.diff(y) > 0).all()
        assert np.allclose(con.sql(f"SELECT {e} AS y FROM px").df().y, y, atol=1e-6)
    assert stretch.mtf_value(0.25, 0.25) == pytest.approx(0.5) and stretch.Ght(0.0).expression("x").startswith("CAST")


def test_frames(spark):
    df = spark.createDataFrame([(0.0, 0.0), (266.405, -28.936), (12.0, 89.0)], "lon double, lat double")
    for m in (frames.GALACTIC, frames.frame_matrix("equatorial", "ecliptic"), frames.precession(1950, 2000), frames.frame_matrix("equatorial", "supergalactic")):
        there = apply(df, frames.rotation_layers(m, "lon", "lat", "a", "b")).select("lon", "lat", "a", "b")
        back = apply(there, frames.rotation_layers(frames.transpose(m), "a", "b", "c", "d")).collect()
        assert all(abs(r.c - r.lon) < 1e-6 or abs(abs(r.c - r.lon) - 360) < 1e-6 for r in back) and all(abs(r.d - r.lat) < 1e-6 for r in back)
    g = apply(df, frames.rotation_layers(frames.GALACTIC, "lon", "lat", "l", "b")).collect()
    assert abs(g[0].l - 96.337) < 1e-2 and abs(g[0].b + 60.189) < 1e-2


def test_noise(spark):
    """The relational form equals the one on arrays, flat runs and missing values included."""
    from starlattice.sources import quantize

    rng = np.random.default_rng(3)
    v = rng.normal(50, 4, (7, 120)).astype(np.float32)
    v[2, 30:60], v[4, 5], v[6, 8:] = 9.0, np.nan, np.nan
    rows = [(y, x, None if np.isnan(v[y, x]) else float(v[y, x])) for y in range(7) for x in range(120)]
    got = image.noise(spark.createDataFrame(rows, "y int, x int, v double"), "y", ["x"], "v").first()
    want = quantize.noise(v, np.nan)
    assert got.ngood == want["ngood"] and all(np.isclose(got[k], want[k], rtol=1e-6) for k in ("min", "max", "noise2", "noise3", "noise5"))
    none = image.noise(spark.createDataFrame([], "y int, x int, v double"), "y", ["x"], "v").first()
    assert (none.ngood, none.noise3) == (0, 0.0)


def test_image(spark):
    rows = spark.createDataFrame([(0, -1.0, float("nan")), (1, 3.0, 1.0)], "id int, r double, g double")
    got = image.normalize_channels(rows, ["r", "g"]).orderBy("id").collect()
    assert [(r.r, r.g) for r in got] == [(0.0, 0.0), (1.0, 0.5)]
    flat = spark.createDataFrame([(x, y, (x * 7 + y * 3) % 40) for x in range(37) for y in range(30)], "x int, y int, level int")
    out = image.clahe(flat, 37, 30, 3.0, 4)
    assert out.count() == 37 * 30 and out.selectExpr("max(equalised) - min(equalised) AS d").first().d > 60
    one = image.clahe(spark.createDataFrame([(x, 0, x // 2) for x in range(8)], "x int, y int, level int"), 8, 1, 64.0, 1).orderBy("x").collect()
    assert [r.equalised for r in one] == [64, 64, 128, 128, 191, 191, 255, 255]  # one tile, nothing clipped: 255 times the share of pixels up to the level
    grey = spark.createDataFrame([(x, y, *[(x + y) / 60.0] * 3) for x in range(32) for y in range(28)], "x int, y int, r double, g double, b double")
    got = image.clahe_rgb(grey, 32, 28, 3.0, 4).collect()
    assert len(got) == 32 * 28 and all(abs(r.r - r.g) < 2e-3 and abs(r.g - r.b) < 2e-3 and 0 <= r.r <= 1 for r in got)  # grey stays grey
