"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are cut into blocks of about ``BLOCK`` distinct vectors; a block is indexed once, and the queries stream past
its index. In each block ``TREES`` trees hold the vectors' long
hash strings (``BITS`` random half-spaces through the centre) as sorted arrays. A query descends in every tree to its
longest matching prefix, then all trees ascend together, one bit shorter at a time. What newly shares the shorter prefix
becomes a candidate and is measured exactly. The ascent ends when a neighbour at the angle of the k-th best found so
far would have shared a prefix of the present length in some tree with probability ``RECALL``; so easy data stop early
and hard data go on, and no count of candidates is capped.

The half-spaces go through the mean of the block. Every row is indexed. Equal vectors fold into one entry that keeps its
k + 1 smallest ids, which is all that a list of k can show.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

TREES, BITS, BLOCK, RECALL = 96, 40, 16_384, 0.93
#: Queries that ascend together.
TOGETHER = 128


class Forest:
    """Sorted arrays of hash strings over one block."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 23):
        with np.errstate(over="ignore", invalid="ignore"):  # huge numbers: any centre does
            centre = vectors.mean(axis=0)
        self.x, self.centre, self.trees, self.bits = vectors, np.where(np.isfinite(centre), centre, 0.0), trees, bits
        centre = self.centre
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, vectors.shape[1], bits), np.float32)
        self.codes, self.order = [], []
        moved = vectors - centre
        self.unit = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-300)
        for t in range(trees):
            code = self.strings(moved, t)
            order = np.argsort(code, kind="stable")
            self.codes.append(code[order]), self.order.append(order)

    def strings(self, moved: np.ndarray, tree: int) -> np.ndarray:
        """Hash strings as integers, first bit highest."""
        up = (moved.astype(np.float32) @ self.planes[tree]) > 0
        packed = np.packbits(up, axis=1)  # whole bytes, highest bit first
        out = np.zeros(len(moved), np.int64)
        for k in range(packed.shape[1]):
            out = (out << 8) | packed[:, k]
        return out >> (-self.bits % 8)

    def search(self, queries: np.ndarray, k: int, recall: float = RECALL) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k nearest entries found (or all within ties of it): positions and distances."""
        moved = queries - self.centre
        unit = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-300)
        n, m = len(self.x), len(queries)
        seen = np.zeros((m, n), bool)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(m)]
        codes = np.stack([self.strings(moved, t) for t in range(self.trees)])
        lo = np.stack([np.searchsorted(self.codes[t], codes[t]) for t in range(self.trees)])
        hi = lo.copy()
        active = np.arange(m)
        for length in range(self._longest(codes, lo), -1, -1):  # the prefix length that all trees are at
            shift = self.bits - length
            low = (codes[:, active] >> shift) << shift
            new_lo = np.stack([np.searchsorted(self.codes[t], low[t]) for t in range(self.trees)])
            new_hi = np.stack([np.searchsorted(self.codes[t], low[t] + (1 << shift)) for t in range(self.trees)])
            grown = (new_lo < lo[:, active]) | (new_hi > hi[:, active])
            still = []
            for a, q in enumerate(active.tolist()):
                fresh = [part for t in np.flatnonzero(grown[:, a]).tolist() for part in (self.order[t][new_lo[t, a] : lo[t, q]], self.order[t][hi[t, q] : new_hi[t, a]])]
                if fresh:
                    at = np.concatenate(fresh)
                    at = np.unique(at[~seen[q, at]])
                    if len(at):
                        seen[q, at] = True
                        best[q] = self._nearest(queries[q], np.concatenate([best[q][0], at]), best[q], len(best[q][0]), k)
                if not self._enough(unit[q], best[q][0], k, length, recall):
                    still.append(a)
            lo[:, active], hi[:, active] = new_lo, new_hi
            active = active[still]
            if not len(active):
                break
        return best

    def _longest(self, codes: np.ndarray, at: np.ndarray) -> int:
        """The longest prefix that any query shares with an entry of any tree; the sorted neighbours have it."""
        unlike = min(int(np.minimum(own[np.maximum(i - 1, 0)] ^ c, own[np.minimum(i, len(own) - 1)] ^ c).min()) for own, c, i in zip(self.codes, codes, at))
        return self.bits - unlike.bit_length()

    def _nearest(self, query: np.ndarray, at: np.ndarray, old: tuple, known: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        away = np.concatenate([old[1], np.sqrt(((self.x[at[known:]] - query) ** 2).sum(axis=1))])
        if len(at) > k:
            keep = away <= np.partition(away, k - 1)[k - 1]  # all ties of the k-th stay
            at, away = at[keep], away[keep]
        return at, away

    def _enough(self, unit: np.ndarray, found: np.ndarray, k: int, length: int, recall: float) -> bool:
        if length == 0:
            return True
        if len(found) < k:
            return False
        angle = math.acos(float(np.clip((self.unit[found] @ unit).min(), -1, 1)))
        same = max(1 - angle / math.pi, 1e-9)
        return 1 - (1 - same**length) ** self.trees >= recall


def _search(k: int, trees: int, recall: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(index: Forest, ids: list[list[int]], queries: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        qs, vs, ds = [], [], []
        # k + 1 entries, as one of them may hold nothing but the query itself
        for (qid, _), (found, away) in zip(queries, index.search(np.stack([q[1] for q in queries]), k + 1, recall)):
            pairs = sorted((d, v) for i, d in zip(found.tolist(), away.tolist()) for v in ids[i] if v != qid)[:k]
            qs += [qid] * len(pairs)
            vs += [v for _, v in pairs]
            ds += [d for d, _ in pairs]
        return pa.RecordBatch.from_pydict({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(vs, pa.int64()), "score": pa.array(ds, pa.float64())}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block first the entries, then the queries."""
        place, index, ids, vectors, queries = None, None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *batch.column("dim").to_pylist()])
            for i, (own, dim, block, is_query) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids", "dim", "block", "is_query")))):
                if (dim, block) != place:
                    if queries:
                        yield answer(index, ids, queries)
                    place, index, ids, vectors, queries = (dim, block), None, [], [], []
                vector = data[ends[i] : ends[i + 1]].copy()
                if not is_query:
                    ids.append(own), vectors.append(vector)
                elif ids:
                    if index is None:
                        index, vectors = Forest(np.stack(vectors), trees), []
                    queries.append((own[0], vector))
                    if len(queries) == TOGETHER:
                        yield answer(index, ids, queries)
                        queries = []
        if queries:
            yield answer(index, ids, queries)

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v (array<double>): rows whose vector is neither null, empty nor zero and holds finite numbers only."""
    v = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    return rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance), k rows a query at most, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own. Vectors that are
    null, empty or zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of
    another length than most are left out of each other's searches (each length is an index of its own). Rows that repeat
    an id with the same vector count once. No usable row, no result.
    """
    spark = vectors.sparkSession
    # -0.0 and 0.0 are one value; equal vectors meet by content
    rows = usable(vectors, id_col, vec_col).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("dim", F.size("v")).distinct()
    first = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)  # cut before the shuffle as well
    entries = durable(kept.groupBy("dim", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")), "entries")
    sizes = entries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))  # each length of vector is an index of its own
    queries = rows.filter(F.col("id") % every == 0)
    stored = entries.join(sizes, "dim").select("ids", "v", "dim", F.pmod("h", "blocks").cast("int").alias("block"), F.lit(False).alias("is_query"))
    # Each query meets every block of its length: a stated query set against all rows.
    asked = queries.join(sizes, "dim").select(F.array("id").alias("ids"), "v", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_query"))
    cells = min(max(1, sizes.agg(F.sum("blocks")).first()[0] or 1), 100_000)  # a block a task, as far as tasks go
    dealt = stored.unionByName(asked).withColumn("cell", ((F.pmod(F.xxhash64("dim"), F.lit(cells)) + F.col("block")) % cells).cast("int")).repartitionById(cells, "cell").sortWithinPartitions("dim", "block", "is_query")
    found = dealt.select("ids", "v", "dim", "block", "is_query").mapInArrow(_search(k, trees, recall), "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
