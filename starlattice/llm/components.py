"""Connected components by contraction: each round hooks nodes to smaller neighbours and merges what hangs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def _rooted(hooks: DataFrame) -> DataFrame:
    """node, label with each label followed to the end of its chain; chains shorten twofold a step."""
    while True:
        far = hooks.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = durable(hooks.join(far, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
        discard(hooks)
        if _is_empty(new.filter("moved")):
            return new
        hooks = new.select("node", "label")
        hooks.stored_at = new.stored_at


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node of its component) for all nodes of ``edges`` (columns a, b of one ordered type).

    A round maps each node to the root of its chain of smallest neighbours; edges between roots go on to the next
    round, equal ones once, so a crowd that many edges hold together shrinks to a node at once. Every table is stored;
    only whether it is empty reaches the driver. No edges, no rows.
    """
    straight = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    live, found = durable(straight(edges), "edges"), None
    while found is None or not _is_empty(live):
        both = live.select(F.col("a").alias("node"), "b").union(live.select(F.col("b").alias("node"), F.col("a").alias("b")))
        roots = _rooted(durable(both.groupBy("node").agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels"))
        to = lambda name: roots.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))  # noqa: E731, B023
        rest = durable(straight(live.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "edges")
        discard(live)
        live = rest
        if found is None:
            found = roots.select("node", "label")
        else:
            step = roots.select(F.col("node").alias("label"), F.col("label").alias("far"))
            found = durable(found.join(step, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "found")
    return found
