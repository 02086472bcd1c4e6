"""Named stretches of an RGB pixel table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stretch
from . import stats


@dataclass(frozen=True)
class Preset:
    """kind is auto (each channel by its own statistics), linked, asinh, ght or linear; values are its parameters."""

    name: str
    label: str
    kind: str
    values: tuple[float, ...]


# The standard presets.
PRESETS = {
    p.name: p
    for p in (
        Preset("kstars1", "KStars 1 (Default)", "auto", (-2.8, 0.25)), Preset("kstars2", "KStars 2 (Bright BG)", "auto", (-1.5, 0.25)),
        Preset("kstars3", "KStars 3 (Much Brighter)", "auto", (-1.0, 0.125)), Preset("kstars4", "KStars 4 (Very Bright)", "auto", (-0.5, 0.125)),
        Preset("kstars5", "KStars 5 (Dark BG)", "auto", (-2.0, 0.125)), Preset("kstars6", "KStars 6 (Very Dark)", "auto", (-4.0, 0.125)),
        Preset("kstars7", "KStars 7 (Extreme Dark)", "auto", (-5.5, 0.25)), Preset("custom_dark", "Custom Dark", "auto", (-6.5, 0.03)),
        Preset("custom_extreme", "Custom Extreme", "auto", (-7.5, 0.02)), Preset("custom_ultra", "Custom Ultra Dark", "auto", (-9.0, 0.01)),
        Preset("custom_mask", "Custom Mask Only", "auto", (-12.0, 0.005)), Preset("auto_linked", "Auto Linked", "linked", (-2.8, 0.25)),
        Preset("asinh_light", "Asinh Light", "asinh", (1.0,)), Preset("asinh_medium", "Asinh Medium", "asinh", (50.0,)), Preset("asinh_strong", "Asinh Strong", "asinh", (500.0,)),
        Preset("ght_mild", "GHT Mild", "ght", (2.0, 0.0, 0.0, 0.5, 1.0)), Preset("ght_strong", "GHT Strong", "ght", (5.0, 2.0, 0.0, 0.3, 1.0)), Preset("linear", "Linear", "linear", (0.05,)),
    )
}


def find(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    return PRESETS[name]


def apply(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its 32-bit columns r, g and b stretched; other columns stay."""
    p, rgb = find(name), ("r", "g", "b")
    keep = [c for c in df.columns if c not in rgb]
    if p.kind == "linear":
        return df.selectExpr(*keep, *[f"{stretch.linear(c, *p.values)} AS {c}" for c in rgb])
    if p.kind == "ght":
        return df.selectExpr(*keep, *[f"{stretch.Ght(*p.values).expression(c)} AS {c}" for c in rgb])
    if p.kind == "asinh":
        parts = stretch.asinh_rgb(*rgb, *p.values)
        return df.selectExpr("*", f"{parts['lum']} AS lum").selectExpr(*keep, *[f"{parts[c]} AS {c}" for c in rgb])
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in rgb])))
    if p.kind == "linked":
        joined = df.crossJoin(F.broadcast(stats.autostretch_linked_params(long, "channel", "value", *p.values)))  # one row
        return joined.selectExpr(*keep, *[f"{stretch.mtf(c, 'shadows', 'midtones', 'highlights')} AS {c}" for c in rgb])
    # All channels in one pass; a channel without a value has no figures, and its values are null anyway.
    own = stats.autostretch_params(long, ["channel"], "value", *p.values)
    wide = own.agg(*[F.max(F.when(F.col("channel") == c, F.col(k))).alias(f"{c}_{k}") for c in rgb for k in ("shadows", "midtones", "highlights")])
    return df.crossJoin(F.broadcast(wide)).selectExpr(*keep, *[f"{stretch.mtf(c, f'{c}_shadows', f'{c}_midtones', f'{c}_highlights')} AS {c}" for c in rgb])  # one row
