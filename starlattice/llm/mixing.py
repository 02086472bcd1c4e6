"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the output's bytes over the bytes that it has. A document's
number of copies is the inverse of the Poisson distribution with that mean at a uniform value hashed from its id, so
reruns and other partitionings give the same copies. Rates above ``STEP`` are sums of independent Poisson draws (exact,
as such a sum is Poisson again), so that exp(-rate) never underflows. Copies are dealt out globally by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

#: Largest mean of one draw; up to COUNTS copies come from one draw (beyond lies less than 1e-17).
STEP, COUNTS = 8.0, 48
#: Sources whose rates may be broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
NO_SOURCE = "\x00none"


def uniform(seed: int, key: Column, draw: Column) -> Column:
    """52 bits of SHA-256 as a double in (0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), draw.cast("string"))
    bits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def inverse_poisson(u: Column, mean: Column) -> Column:
    """The smallest count whose distribution function reaches u; the mean is at most STEP."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i.cast("double")
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + F.when(acc["cdf"] < u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(COUNTS)), start, step, lambda acc: acc["k"])


def copies(seed: int, key: Column, rate: Column) -> Column:
    """Copies of a document: the sum of the draws that its rate is split into."""
    draws = F.greatest(F.ceil(rate / F.lit(STEP)), F.lit(1)).cast("int")
    one = lambda acc, j: acc + inverse_poisson(uniform(seed, key, j), rate / draws)
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), one)).otherwise(F.lit(0))


def rates(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.7, total_factor: float = 1.0) -> DataFrame:
    """Repetition rate of each source (``_source``, ``_rate``).

    Target shares are ``weights`` (sources not named get none), or else proportional to bytes ** ``power``. The output
    is to have ``total_factor`` times the input's bytes. Null sources form a source of their own.
    """
    sized = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("_source"), (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("_bytes"))
    totals = sized.groupBy("_source").agg(F.sum("_bytes").alias("_bytes"))
    if weights is None:
        wanted = totals.withColumn("_w", F.pow(F.col("_bytes").cast("double"), F.lit(float(power))))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        wanted = totals.withColumn("_w", F.coalesce(F.try_element_at(given, F.col("_source")), F.lit(0.0)) if weights else F.lit(0.0))
    whole = wanted.agg(F.sum("_w").alias("_sw"), F.sum("_bytes").alias("_sb"))
    share = F.when(F.col("_sw") > 0, F.col("_w") / F.col("_sw")).otherwise(F.lit(0.0))
    return wanted.join(whole).select("_source", F.round(share * F.col("_sb") * F.lit(float(total_factor)) / F.col("_bytes"), 9).alias("_rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.7, total_factor: float = 1.0, seed: int = 42) -> DataFrame:
    """``_row`` (the row as a struct), ``_rate``, ``_copies``, ``_copy`` (from 1) and ``_order`` (the shuffle's hash), dealt out by ``_order``.

    A document with a null id draws by a hash of its text; rows that repeat an id draw alike and are dealt out apart. Empty texts count one
    byte, so each source has a finite rate. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    table = rates(docs, text_col, source_col, weights, power, total_factor)
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    key = row_key(F.col("_row").getField(id_col), F.col("_row").getField(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("_source"))
    rows = rows.join(F.broadcast(table) if few else table, "_source").drop("_source").withColumn("_key", key)
    rows = rows.withColumn("_copies", copies(seed, F.col("_key"), F.col("_rate"))).filter(F.col("_copies") > 0)
    out = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    # Rows that repeat an id differ by where they stand, so that they do not all go to one task.
    order = F.xxhash64(F.lit(seed), F.col("_key"), F.col("_copy"), F.monotonically_increasing_id() % 1024)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumn("_order", order).drop("_key").repartition(parts, "_order").sortWithinPartitions("_order")
