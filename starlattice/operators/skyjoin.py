"""Joins that plain equality cannot express, rewritten as equality joins: sky cross-match, cone, band and as-of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions.layers import apply, fenced, num

_ANGLES = {"sj_theta": f"(90e0 - lat) * {num(math.pi / 180)}", "sj_phi": f"lon * {num(math.pi / 180)}"}


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees between two points, by the half-angle formula (exact for small angles)."""
    d = (F.radians(lat1) - F.radians(lat2)) / 2
    a = F.radians(lon1 - lon2) / 2
    h = F.pow(F.sin(d), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(a), F.lit(2.0))
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def with_pixel(df: DataFrame, nside: int, out: str, nested: bool = True) -> DataFrame:
    keep = df.columns
    return fenced(apply(df, [_ANGLES, *hp.ang2pix_layers("sj_theta", "sj_phi", nside, out, nested)]).select(*keep, out))


def density(points: DataFrame, nside: int) -> DataFrame:
    """Points per NESTED pixel."""
    return with_pixel(points, nside, "pix").groupBy("pix").agg(F.count(F.lit(1)).alias("n"))


def nside_for(radius_deg: float, finest: int = 8192) -> int:
    """The finest resolution at which a pixel and its neighbours cover a disc around any of its points.

    The narrowest way across a pixel is not below half of its mean side, so the side is kept at four radii.
    """
    n = 1
    while n < finest and hp.pixel_resolution(2 * n) >= 4 * math.radians(radius_deg):
        n *= 2
    return n


def cone_search(points: DataFrame, lon: float, lat: float, radius_deg: float) -> DataFrame:
    """Points within the radius and their distance; a band of latitude prunes before the exact test."""
    near = points.filter(F.col("lat").between(lat - radius_deg, lat + radius_deg))
    return near.withColumn("dist", distance(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))).filter(F.col("dist") <= radius_deg)


def cross_match(a: DataFrame, b: DataFrame, radius_deg: float) -> DataFrame:
    """Pairs (id_a, id_b, dist) within the radius.

    b's points go to their pixel and its neighbours; a joins by equality on the pixel and the exact angle decides. A
    crowded pixel spreads by Spark's skew join; nothing is broadcast by force.
    """
    n = nside_for(radius_deg)
    left = with_pixel(a.select("id", "lon", "lat"), n, "pix").select(F.col("id").alias("id_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), "pix")
    right = with_pixel(b.select("id", "lon", "lat"), n, "home")
    there = ["id AS id_b", "lon AS lon_b", "lat AS lat_b"]
    around = hp.neighbours(right, "home", n, "pix", True).filter("pix >= 0").selectExpr(*there, "pix")
    spread = right.selectExpr(*there, "home AS pix").union(around).distinct()  # at the coarsest a neighbour may come twice
    pairs = left.join(spread, "pix").withColumn("dist", distance(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")))
    return pairs.filter(F.col("dist") <= radius_deg).select("id_a", "id_b", "dist")


def band_join(a: DataFrame, b: DataFrame, key_a: str, key_b: str, width: float) -> DataFrame:
    """Pairs with |a - b| < width: buckets of that width, b in its own and both next."""
    left = a.withColumn("_bucket", F.floor(F.col(key_a) / width))
    right = b.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(key_b) / width) + k)))
    return left.join(right, "_bucket").filter(F.abs(F.col(key_a) - F.col(key_b)) < width).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, ident: str) -> DataFrame:
    """Each left row with ``match_id``: the id of the key's last right row at or before it (the larger id at one time).

    One sort of both sides together and a running last value; no pairs are made.
    """
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(left.schema[ident].dataType).alias("_id")).unionByName(right.select("*", F.lit(0).alias("_side"), F.col(ident).alias("_id")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("match_id", F.last("_id", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_id")
