"""Queries over the robust statistics, with oracles in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stretch as st
from ..operators import image, presets, stats
from .tables import query, table


def histogram_sql(source: str, key: str, value: str, p: float, name: str = "v") -> str:
    """A percentile by histogram selection, per key."""
    return f"""
    WITH x AS (SELECT {key} AS k, CAST({value} AS DOUBLE) AS v FROM {source}),
    s AS (SELECT k, count(*) AS n, min(v) AS lo, max(v) AS hi, least(count(*), 65536) AS bins FROM x GROUP BY k),
    b AS (SELECT s.*, least(CAST(floor((bins - 1) / (hi - lo) * (v - lo)) AS BIGINT), bins - 1) AS bin FROM x JOIN s USING (k) WHERE hi > lo),
    c AS (SELECT k, n, lo, hi, bins, bin, count(*) AS c FROM b GROUP BY ALL),
    r AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY bin) AS cum FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bin) AS rn FROM r WHERE cum >= {p} * n)
    SELECT k, least(greatest((bin + ({p} * n - (cum - c)) / c) / ((bins - 1) / (hi - lo)) + lo, lo), hi) AS {name} FROM f WHERE rn = 1
    UNION ALL SELECT k, lo FROM s WHERE hi = lo"""


@query(
    "stats_minmax_mean_stdev",
    "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS stdev FROM lineitem GROUP BY l_returnflag",
)
def minmax(spark, sf_dir):
    out = stats.basic(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", "min", "max", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@query("stats_percentile_hist", "SELECT a.k AS l_returnflag, round(p10, 6) AS p10, round(p90, 6) AS p90 FROM (" + histogram_sql("lineitem", "l_returnflag", "l_extendedprice", 0.1, "p10") + ") a JOIN (" + histogram_sql("lineitem", "l_returnflag", "l_extendedprice", 0.9, "p90") + ") b USING (k)")
def percentile(spark, sf_dir):
    out = stats.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.9])
    return out.select("l_returnflag", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


MEDIAN_MAD_SQL = f"""
WITH m AS ({histogram_sql("customer", "c_mktsegment", "c_acctbal", 0.5, "median")}),
away AS (SELECT c_mktsegment, median, abs(c_acctbal - median) AS d FROM customer JOIN m ON c_mktsegment = k),
d AS ({histogram_sql("away", "c_mktsegment", "d", 0.5, "mad")})
SELECT k AS c_mktsegment, round(median, 6) AS median, round(mad, 6) AS mad FROM m JOIN d USING (k)"""


@query("stats_median_mad", MEDIAN_MAD_SQL)
def median_mad(spark, sf_dir):
    out = stats.median_mad(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return out.select("c_mktsegment", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("stats_summary", "SELECT l_returnflag, a.n, round(a.mean, 6) AS mean, round(p.median, 6) AS median FROM (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1) a JOIN (" + histogram_sql("lineitem", "l_returnflag", "l_extendedprice", 0.5, "median") + ") p ON a.l_returnflag = p.k")
def summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    both = stats.basic(rows, ["l_returnflag"], "l_extendedprice").join(stats.median(rows, ["l_returnflag"], "l_extendedprice"), "l_returnflag")
    return both.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("stats_quickselect", "SELECT o_orderstatus, v AS kth FROM (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r FROM orders) WHERE r = 101")
def quickselect(spark, sf_dir):
    return stats.kth(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", 100)


def clip_sql(center: str) -> str:
    steps, prev = ["w0 AS (SELECT event_type AS k, CAST(value AS DOUBLE) AS v FROM events)"], "w0"
    for i in range(1, 4):
        mid = f"(SELECT k, avg(v) AS c FROM {prev} GROUP BY k)" if center == "mean" else f"({histogram_sql(prev, 'k', 'v', 0.5, 'c')})"
        steps.append(f"m{i} AS {mid}")
        steps.append(f"s{i} AS (SELECT w.k, c, sqrt(avg((v - c) * (v - c))) AS s FROM {prev} w JOIN m{i} ON w.k = m{i}.k GROUP BY w.k, c)")
        steps.append(f"w{i} AS (SELECT w.k, v FROM {prev} w JOIN s{i} ON w.k = s{i}.k WHERE s = 0 OR v BETWEEN c - 2.0 * s AND c + 2.0 * s)")
        prev = f"w{i}"
    steps.append(f"med AS ({histogram_sql(prev, 'k', 'v', 0.5, 'median')})")
    return f"WITH {', '.join(steps)} SELECT t.k AS event_type, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev, count(*) AS ngood, round(max(median), 6) AS median FROM {prev} t JOIN med ON t.k = med.k GROUP BY t.k"


def _clip(center):
    def run(spark, sf_dir):
        out = stats.sigma_clip(table(spark, sf_dir, "events"), ["event_type"], "value", 2.0, 2.0, 3, center)
        return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "ngood", F.round("median", 6).alias("median"))

    return run


for _center in ("mean", "median"):
    query(f"stats_sigma_clip_{_center}", clip_sql(_center))(_clip(_center))

HIST_SQL = """
WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) AS total FROM part),
g AS (SELECT unnest(range(0, 64))::INT AS bin),
c AS (SELECT least(floor(64.0 / (hi - lo) * (p_retailprice - lo)), 63)::INT AS bin, count(*) AS c FROM part, s GROUP BY 1),
h AS (SELECT g.bin, round(lo + bin * ((hi - lo) / 64.0), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / 64.0), 6) AS upper, coalesce(c, 0)::BIGINT AS count, total FROM g LEFT JOIN c USING (bin), s)
"""


@query("stats_histogram", HIST_SQL + "SELECT bin, lower, upper, count FROM h")
def histogram(spark, sf_dir):
    h = stats.histogram(table(spark, sf_dir, "part"), [], "p_retailprice", 64)
    return h.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count")


@query("stats_hist_cdf", HIST_SQL + "SELECT bin, round(sum(count) OVER (ORDER BY bin) / total, 9) AS cdf FROM h")
def hist_cdf(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "part"), [], "p_retailprice", 64).select("bin", F.round("cdf", 9).alias("cdf"))


@query("stats_hist_percentile", HIST_SQL + ", r AS (SELECT *, sum(count) OVER (ORDER BY bin) AS cum FROM h), f AS (SELECT * FROM r WHERE cum >= 0.3 * total ORDER BY bin LIMIT 1) SELECT round(lower + (0.3 * total - (cum - count)) / count * (upper - lower), 4) AS value FROM f")
def hist_percentile(spark, sf_dir):
    h = stats.histogram(table(spark, sf_dir, "part"), [], "p_retailprice", 64)
    return stats.histogram_percentile(h, [], 0.3).select(F.round("value", 4).alias("value"))


@query("stats_filter_nonzero", "SELECT p_brand, count(*) AS n FROM (SELECT p_brand, p_size % 7 AS v, max(p_size % 7) OVER (PARTITION BY p_brand) AS m FROM part) WHERE v <> 0 OR m = 0 GROUP BY p_brand")
def filter_nonzero(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 7).cast("double").alias("v"))
    return stats.filter_nonzero(rows, ["p_brand"], "v").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("stats_meanstd_f32", "SELECT s_nationkey, round(CAST(CAST(avg(CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE), 2) AS mean FROM supplier GROUP BY s_nationkey")
def meanstd_f32(spark, sf_dir):
    out = stats.mean_stdev_f32(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal")
    return out.select("s_nationkey", F.round(F.col("mean").cast("double"), 2).alias("mean"))


# -- images: the reference's autostretch, normalisation, noise and local equalisation --------------------------------
def _rgb_long(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    channel = lambda name, c: part.select(F.col("p_partkey").alias("id"), F.lit(name).alias("channel"), c.cast("float").alias("value"))
    return channel("r", F.col("p_retailprice") / 2500).union(channel("g", F.col("p_size") / 51)).union(channel("b", (F.col("p_partkey") % 256) / 255))


RGB_SQL = """SELECT p_partkey AS id, 'r' AS channel, CAST(p_retailprice / 2500 AS FLOAT) AS value FROM part UNION ALL SELECT p_partkey, 'g', CAST(p_size / 51 AS FLOAT) FROM part
UNION ALL SELECT p_partkey, 'b', CAST((p_partkey % 256) / 255 AS FLOAT) FROM part"""


def _median32(source: str, value: str, name: str) -> str:
    """The histogram median by channel; bins of 32-bit values are found in 32-bit arithmetic."""
    scale = "CAST(bins - 1 AS DOUBLE) / CAST(hi - lo AS DOUBLE)"
    return f"""
    (WITH x AS (SELECT channel AS k, {value} AS v FROM {source}),
    s AS (SELECT k, count(*) AS n, min(v) AS lo, max(v) AS hi, least(count(*), 65536) AS bins FROM x GROUP BY k),
    b AS (SELECT s.*, CASE WHEN typeof(v) = 'FLOAT' THEN CAST(CAST({scale} AS FLOAT) AS DOUBLE) ELSE {scale} END AS scale, v FROM x JOIN s USING (k)),
    c AS (SELECT k, n, lo, hi, scale, least(CAST(floor(CASE WHEN typeof(v) = 'FLOAT' THEN CAST(CAST(scale AS FLOAT) * (v - lo) AS DOUBLE) ELSE scale * (v - lo) END) AS BIGINT), bins - 1) AS bin, count(*) AS c FROM b GROUP BY ALL),
    r AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY bin) AS cum FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bin) AS rn FROM r WHERE cum >= 0.5 * n)
    SELECT k AS channel, least(greatest((bin + (0.5 * n - (cum - c)) / c) / scale + lo, lo), hi) AS {name} FROM f WHERE rn = 1)"""


#: Clip points and midtones from the medians and the scaled MADs of the non-zero values, in 32 bits.
_LIT = {k: f"CAST({v} AS FLOAT)" for k, v in {"norm": 1.4826, "clip": -2.8, "target": 0.25, "one": 1, "two": 2, "zero": 0}.items()}
_SPREADS = f"""
px AS ({RGB_SQL}), nz AS (SELECT * FROM px WHERE value <> 0), m AS {_median32("nz", "value", "median")},
aw AS (SELECT channel, abs(CAST(value AS DOUBLE) - median) AS away FROM nz JOIN m USING (channel)), d AS {_median32("aw", "away", "mad")},
mm AS (SELECT channel, CAST(median AS FLOAT) AS med, CAST(CAST(mad AS FLOAT) * {_LIT["norm"]} AS FLOAT) AS spread FROM m JOIN d USING (channel))"""
_MIDTONES = f"""sh AS (SELECT *, greatest({_LIT["zero"]}, med + {_LIT["clip"]} * spread) AS shadows FROM mm2),
par AS (SELECT *, CAST(CAST(({_LIT["target"]} - {_LIT["one"]}) * (med - shadows) AS DOUBLE) / CAST(({_LIT["two"]} * {_LIT["target"]} - {_LIT["one"]}) * (med - shadows) - {_LIT["target"]} AS DOUBLE) AS FLOAT) AS midtones, {_LIT["one"]} AS highlights FROM sh)"""
AUTO_SQL = f"WITH {_SPREADS}, mm2 AS (SELECT * FROM mm), {_MIDTONES} SELECT id, channel, round(CAST({st.mtf('value', 'shadows', 'midtones', 'highlights')} AS DOUBLE), 5) AS value FROM px JOIN par USING (channel)"
LINKED_SQL = f"WITH {_SPREADS}, mm2 AS (SELECT CAST(avg(CAST(med AS DOUBLE)) AS FLOAT) AS med, CAST(avg(CAST(spread AS DOUBLE)) AS FLOAT) AS spread FROM mm), {_MIDTONES} SELECT id, channel, round(CAST({st.mtf('value', 'shadows', 'midtones', 'highlights')} AS DOUBLE), 5) AS value FROM px, par"


@query("stretch_autostretch", AUTO_SQL)
def autostretch(spark, sf_dir):
    """Unlinked: parameters of each channel."""
    rows = _rgb_long(spark, sf_dir)
    joined = rows.join(F.broadcast(stats.autostretch_params(rows, ["channel"], "value")), "channel")  # three rows
    return joined.select("id", "channel", F.round(F.expr(st.mtf("value", "shadows", "midtones", "highlights")).cast("double"), 5).alias("value"))


@query("stretch_autostretch_linked", LINKED_SQL)
def autostretch_linked(spark, sf_dir):
    rows = _rgb_long(spark, sf_dir)
    joined = rows.crossJoin(F.broadcast(stats.autostretch_linked_params(rows, "channel", "value")))  # one row
    return joined.select("id", "channel", F.round(F.expr(st.mtf("value", "shadows", "midtones", "highlights")).cast("double"), 5).alias("value"))


@query("stretch_normalize", "WITH s AS (SELECT min(least(p_retailprice, p_size)) AS lo, max(greatest(p_retailprice, p_size)) AS hi FROM part) SELECT p_partkey AS id, round((p_retailprice - lo) / (hi - lo), 6) AS r, round((p_size - lo) / (hi - lo), 6) AS g FROM part, s")
def normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("r"), F.col("p_size").cast("double").alias("g"))
    return image.normalize_channels(rows, ["r", "g"]).select("id", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"))


CLAHE_SQL = """
t AS (SELECT x // 8 AS gx, y // 8 AS gy, level, count(*) AS c FROM px GROUP BY ALL),
o AS (SELECT gx, gy, greatest(1, CAST(floor(3.0 * 64 / 256) AS BIGINT)) AS most, sum(greatest(c - greatest(1, CAST(floor(3.0 * 64 / 256) AS BIGINT)), 0)) AS over FROM t GROUP BY gx, gy),
f AS (SELECT o.gx, o.gy, i, least(coalesce(c, 0), most) + over // 256 + CASE WHEN i < over % 256 THEN 1 ELSE 0 END AS n FROM o CROSS JOIN range(256) AS r(i) LEFT JOIN t ON t.gx = o.gx AND t.gy = o.gy AND t.level = i),
lut AS (SELECT gx, gy, i, CAST(floor(CAST(sum(n) OVER (PARTITION BY gx, gy ORDER BY i) AS DOUBLE) / 64 * 255 + 0.5e0) AS FLOAT) AS v FROM f),
w AS (SELECT *, (x + 0.5e0) / 8 - 0.5e0 AS tx, (y + 0.5e0) / 8 - 0.5e0 AS ty FROM px),
p AS (SELECT *, least(greatest(CAST(trunc(tx) AS BIGINT), 0), 7) AS x0, least(greatest(CAST(trunc(ty) AS BIGINT), 0), 7) AS y0 FROM w),
q AS (SELECT p.*, least(greatest(CAST(tx AS FLOAT) - CAST(x0 AS FLOAT), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) AS ax, least(greatest(CAST(ty AS FLOAT) - CAST(y0 AS FLOAT), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) AS ay,
      coalesce(a.v, 0::FLOAT) AS v00, coalesce(b.v, 0::FLOAT) AS v10, coalesce(c.v, 0::FLOAT) AS v01, coalesce(d.v, 0::FLOAT) AS v11 FROM p
      LEFT JOIN lut a ON a.gx = x0 AND a.gy = y0 AND a.i = level LEFT JOIN lut b ON b.gx = least(x0 + 1, 7) AND b.gy = y0 AND b.i = level
      LEFT JOIN lut c ON c.gx = x0 AND c.gy = least(y0 + 1, 7) AND c.i = level LEFT JOIN lut d ON d.gx = least(x0 + 1, 7) AND d.gy = least(y0 + 1, 7) AND d.i = level),
eq AS (SELECT *, CAST(floor((v00 * (1::FLOAT - ax) + v10 * ax) * (1::FLOAT - ay) + (v01 * (1::FLOAT - ax) + v11 * ax) * ay + 0.5::FLOAT) AS INT) AS equalised FROM q)"""
_IMAGE_SQL = "SELECT CAST(l_linenumber - 1 + 8 * ((l_orderkey // 64) % 8) AS BIGINT) AS x, CAST(l_orderkey % 64 AS BIGINT) AS y, max(l_extendedprice) AS v, max(l_discount) AS w FROM lineitem GROUP BY 1, 2"


def _lines_image(spark, sf_dir):
    """An image made of line items: 64 rows, one column for each line number and block."""
    lines = table(spark, sf_dir, "lineitem")
    place = [(F.col("l_linenumber") - 1 + 8 * (F.floor(F.col("l_orderkey") / 64) % 8)).cast("long").alias("x"), (F.col("l_orderkey") % 64).alias("y")]
    return lines.groupBy(*place).agg(F.max("l_extendedprice").alias("v"), F.max("l_discount").alias("w"))


@query("stretch_clahe", f"WITH px AS (SELECT x, y, CAST(least(255, floor(v / 420)) AS INT) AS level FROM ({_IMAGE_SQL})), {CLAHE_SQL} SELECT x, y, level, equalised FROM eq")
def clahe(spark, sf_dir):
    """Local equalisation of grey levels."""
    flat = _lines_image(spark, sf_dir).select("x", "y", F.least(F.lit(255), F.floor(F.col("v") / 420)).cast("int").alias("level"))
    return image.clahe(flat, 64, 64, 3.0, 8)


_LAB_SQL = f"""
WITH rgb AS (SELECT x, y, least(v / 1.1e5, 1) AS r, w * 10 AS g, x / 64e0 AS b FROM ({_IMAGE_SQL})),
li AS (SELECT x, y, {', '.join(f'CASE WHEN {c} <= 0.04045e0 THEN {c} / 12.92e0 ELSE pow(({c} + 0.055e0) / 1.055e0, 2.4e0) END AS {c}' for c in 'rgb')} FROM rgb),
xyz AS (SELECT x, y, (0.4124564e0*r + 0.3575761e0*g + 0.1804375e0*b) / 0.950456e0 AS cx, 0.2126729e0*r + 0.7151522e0*g + 0.0721750e0*b AS cy, (0.0193339e0*r + 0.1191920e0*g + 0.9503041e0*b) / 1.088754e0 AS cz FROM li),
lab AS (SELECT x, y, {', '.join(f'CASE WHEN c{c} > 0.008856e0 THEN cbrt(c{c}) ELSE 7.787e0*c{c} + 16/116e0 END AS f{c}' for c in 'xyz')} FROM xyz),
px AS (SELECT *, CAST(floor(least(255, greatest(0, (116*fy - 16) * 255 / 100)) + 0.5e0) AS INT) AS level FROM lab), {CLAHE_SQL},
ly AS (SELECT x, y, fx, fy, fz, (equalised * 100e0 / 255 + 16) / 116 AS n FROM eq),
bk AS (SELECT x, y, fx - fy + n AS a, n, n - (fy - fz) AS c FROM ly),
cu AS (SELECT x, y, {', '.join(f'{w}e0 * CASE WHEN {c} > 0.206893e0 THEN {c}*{c}*{c} ELSE ({c} - 16/116e0) / 7.787e0 END AS {o}' for c, o, w in (('a', 'cx', 0.950456), ('n', 'cy', 1.0), ('c', 'cz', 1.088754)))} FROM bk),
ln AS (SELECT x, y, least(1, greatest(0, 3.2404542e0*cx - 1.5371385e0*cy - 0.4985314e0*cz)) AS r, least(1, greatest(0, -0.9692660e0*cx + 1.8760108e0*cy + 0.0415560e0*cz)) AS g, least(1, greatest(0, 0.0556434e0*cx - 0.2040259e0*cy + 1.0572252e0*cz)) AS b FROM cu)
SELECT x, y, {', '.join(f'round(CAST(CAST(CASE WHEN {c} <= 0.0031308e0 THEN {c} * 12.92e0 ELSE 1.055e0 * pow({c}, 1/2.4e0) - 0.055e0 END AS FLOAT) AS DOUBLE), 5) AS {c}' for c in 'rgb')} FROM ln"""


@query("stretch_clahe_rgb", _LAB_SQL)
def clahe_rgb(spark, sf_dir):
    """Local equalisation of colours, in the lightness of CIE Lab."""
    flat = _lines_image(spark, sf_dir).select("x", "y", F.least(F.col("v") / 1.1e5, F.lit(1.0)).alias("r"), (F.col("w") * 10).alias("g"), (F.col("x") / 64).alias("b"))
    return image.clahe_rgb(flat, 64, 64, 3.0, 8).select("x", "y", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in "rgb"])


NOISE_SQL = """
WITH o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
d AS (SELECT user_id, abs(2 * CAST(lead(v, 2) OVER w AS FLOAT) - CAST(v AS FLOAT) - CAST(lead(v, 4) OVER w AS FLOAT)) AS d FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i)),
r AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE d IS NOT NULL)
SELECT user_id, round(CAST(d AS DOUBLE), 2) AS third FROM r WHERE k = (n + 1) // 2
"""


@query("noise_mad3", NOISE_SQL)
def noise_mad3(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return image.third_difference_median(rows, "user_id", ["ts", "event_id"], "value").select("user_id", F.round(F.col("third").cast("double"), 2).alias("third"))



LEVELS_SQL = """
WITH v AS (SELECT user_id AS r, ts, event_id, CAST(value AS FLOAT) AS v FROM events WHERE value IS NOT NULL),
w AS (SELECT r, v AS a, lead(v, 2) OVER o AS c, lead(v, 3) OVER o AS d, lead(v, 4) OVER o AS e, lead(v, 5) OVER o AS f, lead(v, 6) OVER o AS g, lead(v, 8) OVER o AS i FROM v WINDOW o AS (PARTITION BY r ORDER BY ts, event_id)),
x AS (SELECT *, e = f AND f = g AS flat2, e = f AND f = g AND c = d AND d = e AS flat3 FROM w WHERE i IS NOT NULL),
y AS (SELECT r, list_sort(list(abs(e - g)) FILTER (NOT flat2)) AS l2, list_sort(list(abs(2::FLOAT*e - c - g)) FILTER (NOT flat3)) AS l3, list_sort(list(abs(6::FLOAT*e - 4::FLOAT*c - 4::FLOAT*g + a + i)) FILTER (NOT flat3)) AS l5 FROM x GROUP BY r),
m AS (SELECT CASE WHEN len(l2) > 1 OR len(l2) = 1 AND len(l3) = 1 THEN l2[(len(l2) + 1) // 2] END AS d2, l3[(len(l3) + 1) // 2] AS d3, l5[(len(l5) + 1) // 2] AS d5 FROM y)
SELECT (SELECT count(*) FROM v) AS ngood, round(1.0483579e0 * median(CAST(d2 AS DOUBLE)), 5) AS noise2, round(0.6052697e0 * median(CAST(d3 AS DOUBLE)), 5) AS noise3, round(0.1772048e0 * median(CAST(d5 AS DOUBLE)), 5) AS noise5 FROM m"""


@query("noise_levels", LEVELS_SQL)
def noise_levels(spark, sf_dir):
    """Noise of an image whose rows are the users' values in time."""
    out = image.noise(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("ngood", *[F.round(f"noise{k}", 5).alias(f"noise{k}") for k in (2, 3, 5)])


# -- presets ---------------------------------------------------------------------------------------------------------
def _rgb_wide(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_retailprice / 25e2 AS FLOAT) AS r", "CAST(p_size / 51e0 AS FLOAT) AS g", "CAST(CAST(p_partkey % 256 AS DOUBLE) / 255e0 AS FLOAT) AS b")


def _preset(name):
    def run(spark, sf_dir):
        out = presets.apply(_rgb_wide(spark, sf_dir), name)
        return out.select("id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in "rgb"])

    return run


_WIDE_SQL = "(SELECT p_partkey AS id, CAST(p_retailprice / 25e2 AS FLOAT) AS r, CAST(p_size / 51e0 AS FLOAT) AS g, CAST(CAST(p_partkey % 256 AS DOUBLE) / 255e0 AS FLOAT) AS b FROM part)"
_ASINH = st.asinh_rgb("r", "g", "b", 50.0)
_ASINH_SQL = f"SELECT id, {', '.join(f'round(CAST({_ASINH[c]} AS DOUBLE), 5) AS {c}' for c in 'rgb')} FROM (SELECT *, {_ASINH['lum']} AS lum FROM {_WIDE_SQL} AS w) AS l"
_PIVOT = "SELECT id, max(value) FILTER (channel = 'r') AS r, max(value) FILTER (channel = 'g') AS g, max(value) FILTER (channel = 'b') AS b FROM ({}) GROUP BY id"
for _name, _sql in (("kstars1", _PIVOT.format(AUTO_SQL)), ("auto_linked", _PIVOT.format(LINKED_SQL)), ("asinh_medium", _ASINH_SQL)):
    query(f"stretch_preset_{_name}", _sql)(_preset(_name))
for _name, _form in (("linear", lambda c: st.linear(c, 0.05)), ("ght_strong", lambda c: st.Ght(5.0, 2.0, 0.0, 0.3, 1.0).expression(c))):
    query(f"stretch_preset_{_name}", f"SELECT id, {', '.join(f'round(CAST({_form(c)} AS DOUBLE), 5) AS {c}' for c in 'rgb')} FROM {_WIDE_SQL} AS w")(_preset(_name))
