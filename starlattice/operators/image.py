"""Operators on pixel rows: shared normalisation, difference noise, local equalisation (CLAHE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Scale all channels by one minimum and maximum; no change if flat or already in [0, 1]; NaN becomes 0 if scaled.

    NaN takes no part in the extremes.
    """
    good = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    ends = df.agg(F.min(F.least(*[good(c) for c in channels]) if len(channels) > 1 else good(channels[0])).alias("_lo"), F.max(F.greatest(*[good(c) for c in channels]) if len(channels) > 1 else good(channels[0])).alias("_hi"))
    joined = df.crossJoin(F.broadcast(ends))  # one row
    idle = (F.col("_hi") <= F.col("_lo")) | ((F.col("_lo") >= 0) & (F.col("_hi") <= 1)) | F.col("_lo").isNull()

    def scaled(c: str) -> Column:
        value = (F.coalesce(good(c), F.col("_lo")) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        return F.when(idle, F.col(c).cast("double")).otherwise(F.when(good(c).isNull(), F.lit(0.0)).otherwise(value)).alias(c)

    return joined.select(*[scaled(c) if c in channels else F.col(c) for c in df.columns])


def third_difference_median(df: DataFrame, row: str, order: list[str], value: str) -> DataFrame:
    """The lower median of |2 v(i+2) - v(i) - v(i+4)| along each row, in 32 bits; nulls are left out before."""
    w = Window.partitionBy(row).orderBy(*order)
    v = F.col(value).cast("float")
    d = F.abs((F.lit(2.0).cast("float") * F.lead(v, 2).over(w) - v - F.lead(v, 4).over(w)).cast("float"))
    found = df.filter(F.col(value).isNotNull()).select(row, d.alias("d")).filter("d is not null")
    rank = found.withColumn("k", F.row_number().over(Window.partitionBy(row).orderBy("d"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(row)))
    return rank.filter(F.col("k") == F.floor((F.col("n") + 1) / 2)).select(row, F.col("d").alias("third"))


#: Scale from a median absolute difference to a deviation, for differences of 2nd, 3rd and 5th order.
NOISE_FACTORS = {2: 1.0483579, 3: 0.6052697, 5: 0.1772048}


def noise(df: DataFrame, row: str, order: list[str], value: str) -> DataFrame:
    """One row: ngood, min, max, and noise2, noise3 and noise5 of an image given by rows, in 32 bits.

    Nulls are left out and differences run over what is left; places inside flat runs do not count, nor do rows of fewer
    than nine values. A row gives its lower median for each order, the rows together their median, scaled to a
    deviation; 0 where no row gives one.
    """
    v = df.filter(F.col(value).isNotNull()).select(F.col(row).alias("r"), *order, F.col(value).cast("float").alias("v"))
    w = Window.partitionBy("r").orderBy(*order)
    lit = lambda x: F.lit(float(x)).cast("float")
    at = {i: F.col(f"v{i}") for i in (1, 3, 4, 5, 6, 7, 9)}
    wide = v.select("r", *[(F.lead("v", i - 1).over(w) if i > 1 else F.col("v")).alias(f"v{i}") for i in at]).filter("v9 IS NOT NULL")
    flat2 = (at[5] == at[6]) & (at[6] == at[7])
    flat3 = flat2 & (at[3] == at[4]) & (at[4] == at[5])
    orders = F.array(
        F.struct(F.lit(2).alias("k"), F.when(~flat2, F.abs(at[5] - at[7])).alias("d")), F.struct(F.lit(3).alias("k"), F.when(~flat3, F.abs(lit(2) * at[5] - at[3] - at[7])).alias("d")),
        F.struct(F.lit(5).alias("k"), F.when(~flat3, F.abs(lit(6) * at[5] - lit(4) * at[3] - lit(4) * at[7] + at[1] + at[9])).alias("d")),
    )
    long = wide.select("r", F.inline(orders)).filter("d IS NOT NULL")
    ranked = long.withColumn("i", F.row_number().over(Window.partitionBy("r", "k").orderBy("d"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("r", "k")))
    lower = ranked.filter(F.col("i") == F.floor((F.col("n") + 1) / 2)).groupBy("r").agg(*[F.max(F.when(F.col("k") == k, F.struct("d", "n"))).alias(f"m{k}") for k in (2, 3, 5)])
    second = F.when((F.col("m2.n") > 1) | ((F.col("m2.n") == 1) & (F.col("m3.n") == 1)), F.col("m2.d"))
    rows = lower.select(second.alias("d2"), F.col("m3.d").alias("d3"), F.col("m5.d").alias("d5"))
    levels = rows.agg(*[(F.lit(f) * F.coalesce(F.median(f"d{k}"), F.lit(0.0))).alias(f"noise{k}") for k, f in NOISE_FACTORS.items()])
    whole = v.agg(F.count(F.lit(1)).alias("ngood"), F.coalesce(F.min("v").cast("double"), F.lit(0.0)).alias("min"), F.coalesce(F.max("v").cast("double"), F.lit(0.0)).alias("max"))
    return whole.crossJoin(F.broadcast(levels))  # one row by one row


def clahe(pixels: DataFrame, width: int, height: int, clip: float = 3.0, grid: int = 8) -> DataFrame:
    """Contrast-limited equalisation of ``level`` (0 to 255): ``pixels`` with ``equalised``.

    Tiles are width // grid by height // grid, with smaller ones at the far edges. A tile's histogram is clipped; the
    excess is dealt out evenly and its rest to the lowest bins. A pixel takes the bilinear mix, in 32 bits, of the
    cumulative tables of the four tiles around it. A table is one row (tile, 256 numbers); they are joined by tile, by
    broadcast as long as they are few. Rows of the same place each count; null levels stay null.
    """
    tw, th = max(1, width // grid), max(1, height // grid)
    across, down = -(-width // tw), -(-height // th)
    tile = lambda c, size: F.floor(F.col(c) / size).cast("int")
    counts = pixels.filter("level IS NOT NULL").groupBy(tile("x", tw).alias("gx"), tile("y", th).alias("gy"), "level").agg(F.count(F.lit(1)).alias("c"))
    side = lambda g, size, whole: F.least(F.lit(whole), (F.col(g) + 1) * size) - F.col(g) * size
    counts = counts.withColumn("area", side("gx", tw, width) * side("gy", th, height)).withColumn("limit", F.greatest(F.lit(1), F.floor(F.lit(float(clip)) * F.col("area") / 256)))
    tables = counts.groupBy("gx", "gy", "area", "limit").agg(F.map_from_entries(F.collect_list(F.struct("level", "c"))).alias("h"), F.sum(F.greatest(F.col("c") - F.col("limit"), F.lit(0))).alias("over"))
    held = lambda i: F.least(F.coalesce(F.try_element_at("h", i), F.lit(0)), F.col("limit")) + F.floor(F.col("over") / 256) + F.when(i < F.col("over") % 256, 1).otherwise(0)
    sums = F.aggregate(F.sequence(F.lit(0), F.lit(255)), F.array().cast("array<bigint>"), lambda acc, i: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + held(i)).cast("bigint"))))
    lookup = tables.select("gx", "gy", "area", sums.alias("sums")).select("gx", "gy", F.transform("sums", lambda c: F.floor(c.cast("double") / F.col("area") * 255 + 0.5).cast("float")).alias("lut"))

    def around(c: str, size: int, most: int) -> list[Column]:
        """The two tiles and the weight of the second."""
        at = (F.col(c) + 0.5) / size - 0.5
        low = F.least(F.greatest(at.cast("int"), F.lit(0)), F.lit(most - 1))
        weight = (at.cast("float") - low.cast("float")).cast("float")
        one = F.lit(1.0).cast("float")
        return [low.alias(f"_{c}0"), F.least(low + 1, F.lit(most - 1)).alias(f"_{c}1"), F.greatest(F.least(weight, one), F.lit(0.0).cast("float")).alias(f"_a{c}")]

    placed = pixels.select("*", *around("x", tw, across), *around("y", th, down))
    few = across * down <= 4096
    for a in "01":
        for b in "01":
            near = lookup.select(F.col("gx").alias(f"_x{a}"), F.col("gy").alias(f"_y{b}"), F.col("lut").alias(f"_t{a}{b}"))
            placed = placed.join(F.broadcast(near) if few else near, [f"_x{a}", f"_y{b}"], "left")
    value = lambda t: F.coalesce(F.element_at(f"_t{t}", F.col("level").cast("int") + 1), F.lit(0.0).cast("float"))
    mix = lambda low, high, weight: low * (F.lit(1.0).cast("float") - F.col(weight)) + high * F.col(weight)
    mixed = mix(mix(value("00"), value("10"), "_ax"), mix(value("01"), value("11"), "_ax"), "_ay")
    return placed.select(*pixels.columns, F.when(F.col("level").isNotNull(), F.floor(mixed + F.lit(0.5).cast("float"))).cast("int").alias("equalised"))


# sRGB (D65) to XYZ and back, the white point, and the constants of the CIE Lab curve.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.950456, 1.0, 1.088754)


def _weighted(row: tuple, columns: list[Column]) -> Column:
    return F.lit(row[0]) * columns[0] + F.lit(row[1]) * columns[1] + F.lit(row[2]) * columns[2]


def clahe_rgb(pixels: DataFrame, width: int, height: int, clip: float = 3.0, grid: int = 8) -> DataFrame:
    """``pixels`` with r, g and b (0 to 1) equalised in the lightness of CIE Lab; hue and chroma stay.

    Lightness is cut to 256 levels. Results are 32-bit and lie in [0, 1]; a pixel with a null channel becomes null.
    """
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    curve = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + F.lit(16 / 116))
    back = lambda t: F.when(t > 0.206893, t * t * t).otherwise((t - F.lit(16 / 116)) / 7.787)
    shown = lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    keep = [F.col(f"`{c}`") for c in pixels.columns if c not in "rgb"]
    rows = pixels.select(*keep, *[linear(F.col(c).cast("double")).alias(f"_{c}") for c in "rgb"])
    light = [F.col(f"_{c}") for c in "rgb"]
    rows = rows.select(*keep, *[curve(_weighted(row, light) / F.lit(w)).alias(f"_f{k}") for k, (row, w) in enumerate(zip(TO_XYZ, WHITE))])
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (116 * F.col("_f1") - 16) * 255 / 100)) + 0.5).cast("int")
    rows = clahe(rows.select(*keep, "_f0", "_f1", "_f2", level.alias("level")), width, height, clip, grid)
    fy = (F.col("equalised") * 100.0 / 255 + 16) / 116
    rows = rows.select(*keep, (F.lit(WHITE[0]) * back(F.col("_f0") - F.col("_f1") + fy)).alias("_x"), (F.lit(WHITE[1]) * back(fy)).alias("_y"), (F.lit(WHITE[2]) * back(fy - (F.col("_f1") - F.col("_f2")))).alias("_z"))
    xyz = [F.col(c) for c in ("_x", "_y", "_z")]
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    out = {c: F.when(F.col("_y").isNotNull(), shown(inside(_weighted(row, xyz)))).cast("float").alias(c) for c, row in zip("rgb", FROM_XYZ)}
    return rows.select(*[out[c] if c in out else F.col(f"`{c}`") for c in pixels.columns])
