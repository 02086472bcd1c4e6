"""Aggregates and table functions in Python, on Arrow batches."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def harmonic_mean(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The harmonic mean of each group: partial sums in every batch, then one built-in sum. Nulls are left out."""
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    schema = rows.select(*group).schema.add("_n", "long").add("_s", "double")

    def partial(batches):
        for batch in batches:
            part = pa.Table.from_batches([batch]).append_column("_r", pc.divide(1.0, batch.column("_v")))
            out = part.group_by(group).aggregate([("_r", "count"), ("_r", "sum")]).rename_columns({"_r_count": "_n", "_r_sum": "_s"})
            yield from out.select([*group, "_n", "_s"]).combine_chunks().to_batches()

    sums = rows.mapInArrow(partial, schema).groupBy(*group).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    return sums.select(*group, (F.col("_n") / F.col("_s")).alias("harmonic"))


@udtf(returnType="id long, tile long, x0 long, y0 long")
class Tiles:
    """(id, width, height, side) -> one row a tile of the image."""

    def eval(self, id: int, width: int, height: int, side: int):
        if None in (width, height, side):
            return
        across = -(-width // side)
        for tile in range(across * -(-height // side)):
            yield id, tile, tile % across * side, tile // across * side


def tiles_of(images: DataFrame, id_col: str, width: str, height: str, side: int) -> DataFrame:
    """id, tile, x0 and y0 of each image's tiles, by a lateral table function."""
    spark = images.sparkSession
    spark.udtf.register("starlattice_tiles", Tiles)
    images.createOrReplaceTempView("starlattice_images")
    return spark.sql(f"SELECT t.* FROM starlattice_images, LATERAL starlattice_tiles(CAST({id_col} AS BIGINT), CAST({width} AS BIGINT), CAST({height} AS BIGINT), CAST({side} AS BIGINT)) AS t")
