"""Robust statistics per group, relationally.

Percentiles select from a histogram of min(65536, n) bins between the group's extremes and interpolate in its running
count, so a group of any size costs two aggregations and a window over at most 65536 rows. NaN and null are skipped.
A group's figures (one row a group) are stored between passes: each pass scans the values once, meets the figures by a
broadcast whose size is checked, and never shuffles the values by group.
``group`` lists key columns (an empty list: the whole table); results have one row per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable

MAX_BINS = 65_536
#: Groups whose figures may be broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 200_000
#: Rows of one group that may be sorted together.
SORTED = 100_000
MAD_NORM = 1.4826


def _clean(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Keys and v; 32-bit values stay so, as their bins are found in 32-bit arithmetic."""
    narrow = dict(df.dtypes)[value] == "float"
    v = F.col(value) if narrow else F.col(value).cast("double")
    return df.select(*group, v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))


def basic(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, min, max, mean, stdev (of the sample); zeros where there is nothing to count."""
    v = F.col(value).cast("double")
    good = F.when(~F.isnan(v), v)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*group).agg(F.count(good).alias("n"), zero(F.min(good)).alias("min"), zero(F.max(good)).alias("max"), zero(F.avg(good)).alias("mean"), zero(F.stddev_samp(good)).alias("stdev"))


def mean_stdev_f32(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Two passes in 32-bit arithmetic with 64-bit sums; NaN carries through, one value has no deviation."""
    v = F.col(value).cast("float")
    rows = df.select(*group, v.alias("v"))
    means = durable(rows.groupBy(*group).agg((F.sum(F.col("v").cast("double")) / F.count("v")).cast("float").alias("mean"), F.count("v").alias("n")), "means")
    joined = _with(rows, means, group)
    d = (F.col("v") - F.col("mean")).cast("float")
    return joined.groupBy(*group, "mean", "n").agg(F.sum((d * d).cast("double")).alias("ss")).select(*group, "mean", F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1)).cast("float")).otherwise(F.lit(float("nan")).cast("float")).alias("stdev"))


def _with(rows: DataFrame, small: DataFrame, group: list[str], few: bool | None = None) -> DataFrame:
    """Rows with the figures of their group (null is a group as well); ``small`` is stored and has one row a group.

    few: is it known that the groups are few enough for a broadcast?
    """
    if not group:
        return rows.crossJoin(F.broadcast(small))  # one row
    if few is None:
        few = small.count() <= BROADCAST_GROUPS
    keys = small.select(*[F.col(g).alias(f"_{g}") for g in group], *[c for c in small.columns if c not in group])
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(keys[f"_{g}"]) for g in group])
    return rows.join(F.broadcast(keys) if few else keys, same).drop(*[f"_{g}" for g in group])


def _spans(rows: DataFrame, group: list[str]) -> DataFrame:
    bins = F.least(F.count("v"), F.lit(MAX_BINS))
    return rows.groupBy(*group).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), bins.alias("bins"))


def percentiles(df: DataFrame, group: list[str], value: str, ps: list[float], names: list[str] | None = None) -> DataFrame:
    """One column for each p; a group without a number gives no row (the caller may coalesce to 0)."""
    names = names or [f"p{round(p * 100)}" for p in ps]
    rows = _clean(df, group, value)
    spans = durable(_spans(rows, group), "spans")
    scale = (F.col("bins") - 1) / (F.col("hi") - F.col("lo"))
    if dict(rows.dtypes)["v"] == "float":
        scale = scale.cast("float")
    flat = spans.filter("hi = lo")
    binned = _with(rows, spans.filter("hi > lo"), group).withColumn("bin", F.least(F.floor(scale * (F.col("v") - F.col("lo"))), F.col("bins") - 1))
    keys = [*group, "n", "lo", "hi", "bins"]
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
    run = counts.withColumn("cum", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin"))) if keys else counts

    def pick(p: float) -> Column:
        # The walk stops at the first occupied bin whose running count reaches p n; before the first it stands at 0.
        target = F.lit(p) * F.col("n")
        if p <= 0:
            return F.first("lo")
        hit = F.min(F.when(F.col("cum") >= target, F.struct("bin", "cum", "c")))
        place = (hit["bin"] + (F.lit(p) * F.first("n") - (hit["cum"] - hit["c"])) / hit["c"]) / F.first(scale) + F.first("lo")
        return F.least(F.greatest(place, F.first("lo")), F.first("hi"))

    found = run.groupBy(*keys).agg(*[pick(p).alias(name) for p, name in zip(ps, names)]).select(*group, *names)
    return found.unionByName(flat.select(*group, *[F.col("lo").alias(name) for name in names]))


def median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return percentiles(df, group, value, [0.5], ["median"])


def median_mad(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """median and mad, the median of the distances from it."""
    middle = durable(median(df, group, value), "median")
    away = _with(_clean(df, group, value), middle, group).withColumn("away", F.abs(F.col("v") - F.col("median")))
    return _with(percentiles(away, group, "away", [0.5], ["mad"]), middle, group).select(*group, "median", "mad")


def kth(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The exact k-th smallest (from 0) of each group that has so many.

    A group of more than SORTED values is narrowed to the histogram bin that holds the k-th, again and again, until few
    values are left or all are equal; only those are sorted.
    """
    rows = _clean(df, group, value)
    here = durable(rows.groupBy(*group).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter(F.col("n") > k).withColumn("at", F.lit(k).cast("long")), "kth")
    for _ in range(64):
        wide = here.filter((F.col("n") > SORTED) & (F.col("lo") < F.col("hi")))
        if not wide.limit(1).count():
            break
        step = (F.col("hi").cast("double") - F.col("lo")) / MAX_BINS
        bin_of = F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(MAX_BINS - 1))
        inside = _with(rows, durable(wide, "kth"), group).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*group, "n", "at", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        run = counts.withColumn("cum", F.sum("c").over(Window.partitionBy(*group, "n", "at").orderBy("bin"))).filter((F.col("cum") > F.col("at")) & (F.col("cum") - F.col("c") <= F.col("at")))
        narrow = run.select(*group, F.col("c").alias("n"), "lo", "hi", (F.col("at") - (F.col("cum") - F.col("c"))).alias("at"))
        here = durable(here.filter((F.col("n") <= SORTED) | (F.col("lo") >= F.col("hi"))).unionByName(narrow), "kth")
    flat = here.filter(F.col("lo") >= F.col("hi")).select(*group, F.col("lo").alias("kth"))
    left = _with(rows, durable(here.filter(F.col("lo") < F.col("hi")), "kth"), group).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    w = Window.partitionBy(*group).orderBy("v")
    picked = left.withColumn("r", F.row_number().over(w)).filter(F.col("r") == F.col("at") + 1).select(*group, F.col("v").alias("kth"))
    return picked.unionByName(flat)


def sigma_clip(df: DataFrame, group: list[str], value: str, low: float, high: float, max_iter: int = 5, center: str = "mean") -> DataFrame:
    """mean, stdev, median and ngood of what stays within low and high deviations of the centre.

    A round looks at groups as wholes; bounds are inclusive and a group whose deviation is 0 keeps all. The rounds end
    when none rejects anything. Between rounds only each group's bounds are kept; the values are scanned again.
    """
    rows, bounds, before, few = _clean(df, group, value), None, None, None
    reach = lambda side: F.lit(float("inf") * side).alias("lo" if side < 0 else "hi")

    def work() -> DataFrame:
        return rows if bounds is None else _with(rows, bounds, group, few).filter(F.col("v").between(F.col("lo"), F.col("hi"))).select(*group, "v")

    for _ in range(max_iter or 100):
        mids = work().groupBy(*group).agg(F.count("v").alias("n"), F.avg("v").alias("c"))
        if center == "median":
            middle = durable(median(work(), group, "v").withColumnRenamed("median", "c"), "median")
            mids = _with(mids.drop("c"), middle, group, few)
        mids = durable(mids, "centre")
        total = mids.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).first()
        if total["n"] == before:  # groups only lose values, so none has lost any
            break
        few, before = total["groups"] <= BROADCAST_GROUPS, total["n"]
        spread = _with(work(), mids.select(*group, "c"), group, few).groupBy(*group, "c").agg(F.sqrt(F.avg((F.col("v") - F.col("c")) ** 2)).alias("s"))
        edge = lambda side, k: F.when(F.col("s") == 0, F.lit(side * float("inf"))).otherwise(F.col("c") + F.lit(side * k) * F.col("s"))
        found = spread.select(*group, edge(-1, low).alias("new_lo"), edge(1, high).alias("new_hi"))
        found = found.select("*", reach(-1), reach(1)) if bounds is None else _with(found, bounds, group, few)
        bounds = durable(found.select(*group, F.greatest("lo", "new_lo").alias("lo"), F.least("hi", "new_hi").alias("hi")), "bounds")
    total = durable(work().groupBy(*group).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"), F.count("v").alias("ngood")), "clipped")
    return _with(median(work(), group, "v"), total, group, few).select(*group, "mean", "stdev", "ngood", "median")


def histogram(df: DataFrame, group: list[str], value: str, nbins: int = 256) -> DataFrame:
    """bin, lower, upper, count and cdf for every bin, empty ones too; the last bin is closed, equal values fill bin 0."""
    nbins = nbins if nbins > 0 else 256
    rows = _clean(df, group, value)
    spans = durable(rows.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("total")), "spans")
    width = F.col("hi") - F.col("lo")
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor(F.lit(float(nbins)) / F.nullif(width, F.lit(0.0)) * (F.col("v") - F.col("lo"))), F.lit(nbins - 1))).cast("int")
    counts = _with(rows, spans, group).groupBy(*group, at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    full = grid.join(counts, [*group, "bin"], "left").withColumn("count", F.coalesce("c", F.lit(0)).cast("long"))
    step = width / F.lit(float(nbins))
    cum = F.sum("count").over(Window.partitionBy(*group, "total").orderBy("bin"))
    return full.select(*group, "bin", (F.col("lo") + F.col("bin") * step).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"), "count", "total", cum.alias("cum")).withColumn("cdf", F.col("cum") / F.col("total"))


def histogram_percentile(hist: DataFrame, group: list[str], p: float) -> DataFrame:
    """A percentile from :func:`histogram`: linear within the first bin whose running count reaches it."""
    target = F.lit(p) * F.col("total")
    first = hist.filter(F.col("cum") >= target).groupBy(*group).agg(F.min_by(F.struct("lower", "upper", "count", "cum", "total"), "bin").alias("h"))
    share = F.when(F.col("h.count") == 0, F.lit(0.0)).otherwise((F.lit(p) * F.col("h.total") - (F.col("h.cum") - F.col("h.count"))) / F.nullif(F.col("h.count"), F.lit(0)))
    return first.select(*group, (F.col("h.lower") + share * (F.col("h.upper") - F.col("h.lower"))).alias("value"))


def filter_nonzero(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows whose value is neither 0 nor NaN; a group that has none such stays whole."""
    v = F.col(value).cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (v != 0)
    any_good = durable(df.groupBy(*group).agg(F.max(good).alias("_some")), "some")
    return _with(df, any_good, group).filter(good | ~F.col("_some")).drop("_some")


def autostretch_params(df: DataFrame, group: list[str], value: str, shadows_clip: float = -2.8, target: float = 0.25) -> DataFrame:
    """shadows, midtones, highlights from the median and the scaled MAD of the non-zero values, in 32 bits."""
    mm = median_mad(filter_nonzero(df, group, value), group, value)
    return _params(mm.select(*group, F.col("median").cast("float").alias("med"), _spread_of("mad").alias("mad")), group, shadows_clip, target)


def _spread_of(mad: str) -> Column:
    m = (F.col(mad).cast("float") * F.lit(MAD_NORM).cast("float")).cast("float")
    return F.when(m == 0, F.lit(0.001).cast("float")).otherwise(m)


def _params(mm: DataFrame, group: list[str], shadows_clip: float, target: float) -> DataFrame:
    f = lambda x: F.lit(x).cast("float")
    out = mm.withColumn("shadows", F.greatest(f(0.0), F.col("med") + f(shadows_clip) * F.col("mad"))).withColumn("m2", F.col("med") - F.col("shadows"))
    mid = F.when((F.col("m2") <= 0) | (F.col("m2") >= 1), f(0.5)).otherwise((f(target) - f(1.0)) * F.col("m2") / ((f(2.0) * f(target) - f(1.0)) * F.col("m2") - f(target)))
    return out.select(*group, "shadows", mid.cast("float").alias("midtones"), f(1.0).alias("highlights"))


def autostretch_linked_params(df: DataFrame, channel: str, value: str, shadows_clip: float = -2.8, target: float = 0.25) -> DataFrame:
    """One set of parameters from the mean over channels of the medians and of the clip points."""
    mm = median_mad(filter_nonzero(df, [channel], value), [channel], value).select(F.col("median").cast("float").alias("med"), _spread_of("mad").alias("mad"))
    both = mm.agg(F.avg("med").cast("float").alias("med"), F.avg("mad").cast("float").alias("mad"))
    return _params(both, [], shadows_clip, target)
