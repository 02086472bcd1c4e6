"""Exact deduplication by skew-safe combining.

Three stages, each of which compares whole contents and not only digests:

1. *local*: within an Arrow batch equal texts fold into the row with the largest id and a count;
2. *salted*: survivors meet by (digest, salt), so a group that holds a third of all rows spreads over many tasks;
3. *global*: the at most ``salts`` winners of a digest meet and give one winner per distinct content.

Stages 2 and 3 stream over rows sorted by digest and hold only the open run's distinct contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, durable, hand_back, owns_worker, small_batches


def _newer(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _contents(batch: pa.RecordBatch, field: str) -> list[bytes]:
    texts = batch.column("_row").field(field).cast(pa.binary())
    return [(t or b"").lower() for t in texts.to_pylist()]


def _with_counts(batch: pa.RecordBatch, index: list[int], counts: list[int]) -> pa.RecordBatch:
    out = batch.take(pa.array(index, pa.int64()))
    return out.set_column(out.schema.get_field_index("_n"), "_n", pa.array(counts, pa.int64()))


def _local(field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("dedup")
        for batch in batches:
            ids, best = batch.column("_id").to_pylist(), {}
            for i, content in enumerate(_contents(batch, field)):
                held = best.setdefault(content, [i, 0])
                held[1] += 1
                if _newer(ids[i], ids[held[0]]):
                    held[0] = i
            if best:
                yield _with_counts(batch, [h[0] for h in best.values()], [h[1] for h in best.values()])

    return run


def _merge(field: str):
    """Rows come sorted by digest; equal contents of a run fold together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # of the open run: [content or None until needed, id, count, batch, index]

        def emit(done: list, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            own = [h for h in done if h[3] is batch]
            for h in done:
                if h[3] is not batch:
                    yield _with_counts(h[3], [h[4]], [h[2]])
            if own:
                yield _with_counts(batch, [h[4] for h in own], [h[2] for h in own])

        last = None
        for batch in batches:
            digests, ids, counts = (batch.column(c).to_pylist() for c in ("_digest", "_id", "_n"))
            contents, done = _contents(batch, field), []
            for i, digest in enumerate(digests):
                if digest != key:
                    done += held
                    key, held = digest, []
                for h in held:
                    if h[0] == contents[i]:
                        h[2] += counts[i]
                        if _newer(ids[i], h[1]):
                            h[1], h[3], h[4] = ids[i], batch, i
                        break
                else:
                    held.append([contents[i], ids[i], counts[i], batch, i])
            yield from emit(done, batch)
            held = [[c, d, n, b.take(pa.array([i], pa.int64())), 0] for c, d, n, b, i in held]
            last = batch
        if held:
            yield from emit(held, last)

    return run


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct text: ``_row`` (the whole winning row as a struct), ``_id``, ``_n`` (group size), ``_digest``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The largest id wins, a null id loses to
    any other; among rows that tie in id any one (they hold equal text) wins. An empty table gives no rows. Other
    columns, whatever their names, travel inside ``_row``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).cast("long").alias("_id"),
        F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256)).alias("_digest"),
        F.lit(1).cast("long").alias("_n"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in packed.schema])
    local = packed.mapInArrow(_local(text_col), schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = local.withColumn("_salt", F.pmod(F.xxhash64("_id", "_digest"), F.lit(salts))).repartition(parts, "_digest", "_salt").drop("_salt")
    once = salted.sortWithinPartitions("_digest").mapInArrow(_merge(text_col), schema)
    return once.repartition(parts, "_digest").sortWithinPartitions("_digest").mapInArrow(_merge(text_col), schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; see :func:`winners` for nulls, ties and empty tables."""
    return winners(docs, id_col, text_col, salts).select("_row.*")


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Exactly one row of each group is kept, also if rows repeat an id. If every id of a group is null, keep_id is null.
    The figures of groups that hold a large share of all rows reach those rows by a bounded broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    won = winners(narrow, "doc_id", "text", salts).select(
        F.col("_digest"), F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"), F.octet_length(F.coalesce(F.col("_row.text"), F.lit(""))).alias("_len")
    )
    rows = durable(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256)).alias("_digest"),
        F.octet_length(text).alias("_len"),
        F.monotonically_increasing_id().alias("_at"),
    ), "digests")
    # Of rows that repeat the winner's id and text one only may stay: the one that stands last.
    stays = rows.groupBy("_digest", "_len").agg(F.max_by("_at", F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "_at")).alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    groups = durable(won.join(stays, ["_digest", "_len"]), "groups")
    total = rows.count()
    return hand_back(rows, groups, ["_digest", "_len"], "_rows", total).select(
        "doc_id", "keep_id", "group_size", (F.col("_at") == F.col("_stays")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )
