"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

A text's shingles are its runs of ``n`` words (white space separates; A-Z lower-cased); a shorter text is one shingle.

1. Texts with the same shingle set form a class; a class has one representative from here on.
2. The forest: ``trees`` tries hold signatures of ``DEEPEST`` MinHash values each, as byte strings whose sorted order is
   the trie. Matching begins at full depth. Every near pair that a pass meets is counted by its similarity s; as it
   meets with probability s ** depth in one tree, the counts give the number of near pairs of each s that the data
   hold, seen or not, and so the recall of any depth. While that is below ``recall``, prefixes are shortened to the
   depth that reaches it (:func:`shortened`), at most to where a pair at the threshold itself would be found so often
   (:func:`depth_for`). A pass looks only at subtries in which shortening brought something together.
3. Within a subtrie, streamed in trie order, a representative joins every leader that its signature is near to
   (``LOOSE``) and becomes a leader itself unless it is very near to one (``TIGHT``). Distances obey the triangle
   inequality, so two texts over the threshold end up in one group; only spanning edges are emitted, never pairs.
   A subtrie of more than ``CROWD`` rows is dealt into cells of two of its slices each, so no task gets all of it.
4. Inside each group all pairs are verified exactly in blocks of at most ``BLOCK`` representatives ordered by set size.
   A block pair counts each text's links by a matrix product over shared shingles and emits counts and spanning edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, hand_back, owns_worker, row_key, small_batches, worker_memory
from .components import connected_components

LOOSE, TIGHT, BLOCK, CROWD, DEEPEST = 0.55, 0.95, 384, 256, 6
#: Members of groups (some 100 bytes each) whose list may be broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_MEMBERS = 400_000
_WORDS_KEPT = 200_000


def found_at(depth: int, trees: int, s: float) -> float:
    """The probability that a pair of similarity s shares a prefix of that depth in some tree."""
    return 1 - (1 - s**depth) ** trees


def shortened(met: dict[float, float], depth: int, trees: int, threshold: float, recall: float) -> int:
    """The depth that reaches ``recall`` on the data, as measured by a pass at ``depth``.

    met: similarity -> how often a pair of that similarity met in a tree. Each pair meets ``trees * s ** depth`` times
    on average, which turns meetings into numbers of pairs. One more pair at the threshold is always reckoned with, so
    that a pass that saw nothing proves nothing.
    """
    pairs = {s: n / (trees * s**depth) for s, n in met.items()}
    pairs[threshold] = pairs.get(threshold, 0.0) + 1.0
    for d in range(depth, 1, -1):
        if sum(n * found_at(d, trees, s) for s, n in pairs.items()) >= recall * sum(pairs.values()):
            return d
    return 1


def depth_for(trees: int, threshold: float, recall: float, deepest: int = DEEPEST) -> int:
    """Shorten the matched prefix until a pair at the threshold is seen with probability ``recall`` at least."""
    depth = deepest
    while depth > 1 and found_at(depth, trees, threshold) < recall:
        depth -= 1
    return depth


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = worker_memory("ngram_join", _WordHash())


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; empty for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def permutations(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def signature(sets: np.ndarray, mult: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The upper 16 bits of the MinHash values under each permutation, high byte first."""
    best, short = np.full(len(mult), np.uint32(0xFFFFFFFF)), (sets >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(best, (short[None, at : at + 1024] * mult[:, None] + plus[:, None]).min(axis=1), out=best)
    return (best >> np.uint32(16)).astype(">u2")


def _sign(n: int, trees: int):
    schema = pa.schema([("uid", pa.int64()), ("size", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("ngram_join")
        mult, plus = permutations(trees * DEEPEST)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text or b"", n)
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else b"")
                sigs.append(signature(own, mult, plus).tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


class _Forest:
    """Union-find over the members of one group."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple]:
        """(smallest member, member) of all groups: what stands together in many tries gives the same edges in each."""
        return [(top, x) for x in self.up if (top := self.root(x)) != x]


def _leaders(threshold: float):
    """Rows sorted by cell, slice and trie order; emits spanning edges between near representatives, and how often pairs met."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("same", pa.int32()), ("met", pa.int64())])

    def edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        n = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, count, width = None, 0, 0
        sigs = np.zeros((0, 1), np.uint16)
        names: list[bytes] = []
        forest = _Forest()
        met = np.zeros(0, np.int64)
        for batch in batches:
            done = []
            cells = zip(*(batch.column(c).to_pylist() for c in ("trie", "i", "j")))
            for where, part, key, sig in zip(cells, *(batch.column(c).to_pylist() for c in ("part", "key", "sig"))):
                mine = np.frombuffer(sig, np.uint16)
                if where != cell:
                    done += forest.stars()
                    cell, count, names, forest, width = where, 0, [], _Forest(), len(mine)
                    sigs = np.zeros((4, width), np.uint16)
                    if not len(met):
                        met = np.zeros(width + 1, np.int64)
                _, i, j = where
                within = part == i  # rows of the first slice lead; a cell of two slices compares only across them
                leads = within
                if count:
                    same = (sigs[:count] == mine).sum(axis=1)
                    if i == j or not within:
                        for at in np.flatnonzero(same >= LOOSE * width).tolist():
                            forest.join(names[at], key)
                        met += np.bincount(same[same >= threshold * width], minlength=width + 1)
                    leads = within and same.max() < TIGHT * width
                if leads:
                    if count == len(sigs):
                        sigs = np.concatenate([sigs, np.zeros_like(sigs)])
                    sigs[count] = mine
                    names.append(key)
                    count += 1
            if done:
                yield edges(done)
        if last := forest.stars():
            yield edges(last)
        seen = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.binary()), pa.nulls(len(seen), pa.binary()), pa.array(seen, pa.int32()), pa.array(met[seen], pa.int64())], schema=schema)

    return run


def _climbed(reps: DataFrame, trees: int, depth: int, before: int | None, threshold: float) -> DataFrame:
    """One pass: what meets at prefixes of ``depth`` and did not meet already at depth ``before``."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    string = lambda levels: F.substring(F.col("sig"), F.col("tree") * F.lit(2 * DEEPEST) + 1, F.lit(2 * levels))
    tries = reps.select("key", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("key", "tree", F.xxhash64("tree", string(depth)).alias("trie"), F.xxhash64(string(before or depth)).alias("was"))
    crowd = tries.groupBy("trie").agg(F.count(F.lit(1)).alias("c"), F.min("was").alias("lo"), F.max("was").alias("hi")).filter("c > 1" if before is None else "lo <> hi")
    crowd = crowd.select("trie", F.ceil(F.col("c") / CROWD).cast("int").alias("slices"))
    live = tries.join(crowd, "trie").join(reps.select("key", "sig"), "key")
    # Slices of neighbouring strings would be of uneven size; a hash of the key deals them evenly.
    live = live.withColumn("part", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = live.select("trie", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", string(DEEPEST).alias("string"), "key", "sig")
    order = ["trie", "i", "j", "part", "string", "key"]
    dealt = cells.repartition(parts, "trie", "i", "j").sortWithinPartitions(*order).drop("string")
    return durable(dealt.mapInArrow(_leaders(threshold), "a binary, b binary, same int, met long"), "near")


def near_edges(reps: DataFrame, trees: int, threshold: float, recall: float) -> DataFrame:
    """Spanning edges (a, b) of near representatives: prefixes are shortened until the measured recall is reached."""
    floor, width = depth_for(trees, threshold, recall), trees * DEEPEST
    depth, before, passes = DEEPEST, None, []
    while True:
        stored = _climbed(reps, trees, depth, before, threshold)
        passes.append(stored.filter("a is not null").select("a", "b"))
        met = {r["same"] / width: r["met"] for r in stored.filter("same is not null").groupBy("same").agg(F.sum("met").alias("met")).collect()}  # a row for each similarity
        goal = max(floor, shortened(met, depth, trees, threshold, recall))
        if goal >= depth:
            break
        depth, before = goal, depth
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    return out


def _sets(n: int):
    """Recompute the shingle sets of group members from their texts; rows of another text with the same id go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("ngram_join")
        for batch in batches:
            keep, sets = [], []
            for i, (text, key) in enumerate(zip(batch.column("text").to_pylist(), batch.column("key").to_pylist())):
                own = shingles(text or b"", n)
                if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == key:
                    keep.append(i), sets.append(own.tobytes())
            out = batch.take(pa.array(keep, pa.int64()))
            at = out.schema.get_field_index("text")
            yield out.set_column(at, pa.field("text", pa.binary()), pa.array(sets, pa.binary()))

    return run


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set with every other, by products of blocks of the 0/1 matrix of shared shingles."""
    both = sets if others is None else sets + others
    n, m = len(sets), len(both)
    owner = np.repeat(np.arange(m), [len(s) for s in both])
    values, inverse, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    renumber = np.cumsum(counts > 1) - 1
    column, owner = renumber[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int((counts > 1).sum())
    out = np.zeros((n, n if others is None else m - n), np.float64)
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, min(width, total - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x[:n] @ (x if others is None else x[n:]).T
    return out


def _verify(threshold: float):
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def judge(rows: dict[bytes, tuple[int, int, np.ndarray]], i: int, j: int) -> Iterator[tuple[bytes, int | None, bytes | None]]:
        """rows: key -> (block, copies, set)."""
        left = sorted(k for k, r in rows.items() if r[0] == i)
        right = left if i == j else sorted(k for k, r in rows.items() if r[0] == j)
        if not left or not right or len(right) + len(left) < 2:
            return
        size = lambda names: np.array([len(rows[k][2]) for k in names], np.float64)
        common = overlaps([rows[k][2] for k in left], None if i == j else [rows[k][2] for k in right])
        linked = common >= threshold * (size(left)[:, None] + size(right)[None, :] - common) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        copies = lambda names: np.array([rows[k][1] for k in names], np.int64)
        for names, counts in ((left, linked @ copies(right)), *([] if i == j else [(right, linked.T @ copies(left))])):
            for k, c in zip(names, counts.tolist()):
                if c:
                    yield k, c, None
        forest = _Forest()
        for a, b in zip(*np.nonzero(linked)):
            forest.join(left[a], right[b])
        for top, k in forest.stars():
            yield top, None, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, out = None, {}, []

        def flush():
            if place is not None:
                out.extend(judge(rows, place[1], place[2]))

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in ((0, pa.binary()), (1, pa.int64()), (2, pa.binary()))], schema=schema)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "i", "j", "block", "key", "copies", "text")]
            for grp, i, j, block, key, copies, own in zip(*cols):
                if (grp, i, j) != place:
                    flush()
                    place, rows = (grp, i, j), {}
                rows[key] = (block, copies, np.frombuffer(own, np.uint64))
            if out:
                yield packed()
                out.clear()
        flush()
        if out:
            yield packed()

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, trees: int = 20, recall: float = 0.9999) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, copy_id, n_shingles.

    ``n_links`` counts the other documents whose Jaccard similarity is ``threshold`` or more, copies included;
    ``copy_id`` is the smallest id with the same shingle set, ``class_id`` the smallest id in the connected component
    of links. A null or empty text, or one of white space, has no shingle and links to nothing (its class is its own
    id). A row with a null id takes part under a negative key made from its text, which shows as class_id and copy_id.
    Rows that repeat an id stand or fall together. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("uid"), text.cast("binary").alias("text"))
    signed = durable(base.select("uid", "text").mapInArrow(_sign(n, trees), "uid long, size long, key binary, sig binary"), "signed")
    real = signed.filter("size > 0")
    # Rows of a class have one shingle set, so one signature.
    reps = durable(real.groupBy("key").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.max("sig").alias("sig")), "reps")
    classes = reps.select("key", "rep", "copies", "size")
    groups = connected_components(near_edges(reps, trees, threshold, recall))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = durable(classes.join(groups.withColumnRenamed("node", "key").withColumnRenamed("label", "grp"), "key"), "members")
    # Sorted over all partitions, each BLOCK rows that follow one another form a block, as far as they are of one group.
    ranked = durable(members.repartitionByRange(parts, "grp", "size", "key").sortWithinPartitions("grp", "size", "key").withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)), "ranked")
    discard(members)
    ranges = ranked.groupBy("grp", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    # Block pairs whose sizes allow the threshold; a group of one block has one pair.
    x, y = ranges.alias("x"), ranges.alias("y")
    allowed = x.join(y, F.expr(f"x.grp = y.grp and x.block <= y.block and x.hi >= {threshold} * y.lo - 1e-6")).select(F.col("x.grp").alias("grp"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = allowed.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    few = ranked.count() <= BROADCAST_MEMBERS
    wanted = ranked.select(F.col("rep").alias("uid"), "key", "copies", "grp", "block")
    texts = base.select("uid", "text").join(F.broadcast(wanted) if few else wanted, "uid").select("key", "copies", "grp", "block", "text")
    sets = texts.mapInArrow(_sets(n), "key binary, copies long, grp binary, block long, text binary")
    dealt = sets.join(sides, ["grp", "block"]).repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "key")
    found = durable(dealt.select("grp", "i", "j", "block", "key", "copies", "text").mapInArrow(_verify(threshold), "key binary, links long, other binary"), "links")
    links = found.filter("links is not null").groupBy("key").agg(F.sum("links").alias("links"))
    final = connected_components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = durable(final.join(classes.select(F.col("key").alias("node"), "rep"), "node"), "named")
    heads = named.groupBy("label").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("nodes"))
    linked = hand_back(named, durable(heads, "heads"), ["label"], "nodes", named.count()).select(F.col("node").alias("key"), "head").join(links, "key", "left")
    info = durable(classes.drop("size").join(linked, "key", "left"), "info")
    rows = signed.select("uid", "size", "key")
    known = hand_back(rows.filter("size > 0"), info, ["key"], "copies", rows.count())
    out = known.select("uid", F.coalesce("head", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("copy_id"), "size")
    none = rows.filter("size = 0").select("uid", F.col("uid").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("uid").alias("copy_id"), "size")
    everyone = out.union(none)
    return everyone.select(F.when(F.col("uid") >= 0, F.col("uid")).alias("doc_id"), "class_id", "n_links", "copy_id", F.col("size").alias("n_shingles"), F.col("uid").alias("row_key"))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows whose document heads its class, with the columns of ``docs``."""
    gone = durable(ngram_join(docs, id_col, text_col, **how).filter("row_key <> class_id").select(F.col("row_key").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_MEMBERS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key(F.col(id_col), F.col(text_col)).alias("_key"))
    return rows.join(F.broadcast(gone) if few else gone, rows["_key"] == gone["_gone"], "left_anti").select("_row.*")
