"""Language-model scoring over a lattice of subwords.

A text is the sequence of its words (white space separates, A-Z lower-cased) and one end. A word is every way to cut a
blank and its bytes into vocabulary pieces; single bytes are pieces too, so each text has a positive probability. The
file's existing scores weigh the pieces, and stay as they are. As pieces that begin with a blank open the next word, the
probabilities of all words add up to one. The lattice has one more way through a word that the training texts hold: its
count there, less a discount, over all counts. What the discounts leave goes to the pieces:

    P(word) = (N + 1/2) / (N + E + 1) * (max(c - d, 0) + (d V + 1/2) * P_pieces(word)) / (N + 1/2),  P(end) = (E + 1/2) / (N + E + 1)

with N words of training texts, V of them distinct, E ends, and d = n1 / (n1 + 2 n2) from the numbers of words seen once
and twice. P_pieces is the sum over all cuts, by forward recursion in log space over words of one length at a time.

Spark: texts become blocks of about ``BLOCK_BYTES`` with a vocabulary of their own, so a word travels once a block and
not once a text; word counts and word probabilities are tables that are joined by word and never collected. Only a few
totals reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, hand_back, owns_worker, small_batches

BLOCK_BYTES, LONGEST_HOT = 8 << 20, 1024
#: Words that one step of the recursion takes together (in groups of one length).
TOGETHER = 60_000
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


class Pieces:
    """Piece byte strings and log probabilities, with a hash table that numpy can look up in bulk."""

    def __init__(self, names: list[bytes], weights: np.ndarray):
        self.names, self.logp = names, np.log(weights / weights.sum())
        self.longest = max(map(len, names))
        self.keys, self.slot = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        for i, name in enumerate(names):
            h = 0
            for byte in name:
                h = (h * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            at = ((h * int(_SPREAD)) & 0xFFFFFFFFFFFFFFFF) >> (64 - _SLOTS)
            while self.slot[at] >= 0:
                at = (at + 1) & ((1 << _SLOTS) - 1)
            self.keys[at], self.slot[at] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of the hashes, -1 where there is none."""
        at = ((h * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.slot[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << _SLOTS) - 1)
            out[wrong] = self.slot[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != h[wrong])]
        return out

    def edges(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """words: rows of bytes of one length. (start, end) -> piece numbers, where any row has a piece."""
        m, n = words.shape
        h = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            h[j + 1] = h[j] * _BASE + words[:, j].astype(np.uint64) + np.uint64(1)
        power, out = np.ones(1, np.uint64), {}  # an array, as scalars warn when they wrap
        for size in range(1, min(n, self.longest) + 1):
            power = np.multiply(power, _BASE, dtype=np.uint64)
            for i in range(n - size + 1):
                found = self.find(h[i + size] - h[i] * power)
                if (found >= 0).any():
                    out[i, i + size] = found
        return out

    def forward(self, n: int, m: int, edges: dict) -> np.ndarray:
        """Log probability of the first j bytes, for each j (rows) and word (columns)."""
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        ends: dict[int, list[int]] = {}
        for i, j in edges:
            ends.setdefault(j, []).append(i)
        padded = np.append(self.logp, -np.inf)
        for j in range(1, n + 1):
            terms = np.stack([alpha[i] + padded[edges[i, j]] for i in ends[j]])
            top = terms.max(axis=0)
            alpha[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha

    @staticmethod
    def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the words of one length and their bytes, each word after a blank; in parts of bounded size."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            most = max(1, min(8192, (1 << 18) // (size + 1)))
            for at in range(0, len(own), most):
                part = own[at : at + most]
                joined = b"".join(b" " + words[i] for i in part.tolist())
                yield part, np.frombuffer(joined, np.uint8).reshape(len(part), size + 1)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word."""
        out = np.zeros(len(words))
        for part, data in self.by_length(words):
            if data.shape[1] > 4096:
                out[part] = [self._long(row) for row in data]
            else:
                m, n = data.shape
                out[part] = self.forward(n, m, self.edges(data))[n]
        return out / math.log(10)

    def _long(self, row: np.ndarray) -> float:
        """A very long word, position by position with a window of the longest piece."""
        text, index = row.tobytes(), {n: i for i, n in enumerate(self.names)}
        alpha = [0.0]
        for j in range(1, len(text) + 1):
            terms = [alpha[i] + self.logp[p] for i in range(max(0, j - self.longest), j) if (p := index.get(text[i:j])) is not None]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return float(alpha[-1])


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces that can occur in a word after a blank, and the weights that the file's scores give them.

    Scores that are log probabilities weigh as such; scores that are negative ranks (whole numbers) weigh as Zipf's law
    over the ranks. Bytes of last resort get a tenth of the smallest weight.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    names, scores = {}, []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i).replace("▁", " ").encode()
        if name and b" " not in name[1:] and name == name.lower() and name not in names:
            names[name] = len(names)
            scores.append(model.get_score(i))
    score = np.array(scores)
    weight = 1 / (2.7 + np.maximum(-score, 0)) if np.all(score == np.round(score)) else np.exp(score)
    rest = [bytes([b]) for b in range(256) if bytes([b]) not in names]
    return [*names, *rest], np.concatenate([weight, np.full(len(rest), weight.min() / 10)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    owns_worker("lattice")
    part, number = TaskContext.get().partitionId(), 0

    def flush(docs: list, held: list, counts: list[tuple[np.ndarray, np.ndarray]], words: dict[bytes, int]):
        trained = np.zeros(len(words), np.int64)
        for out, (index, count) in zip(held, counts):
            if not out:
                trained[index] += count
        ends = np.cumsum([0, *[len(c[0]) for c in counts]])
        flat = lambda k: np.concatenate([c[k] for c in counts]).astype(np.int32) if counts else np.zeros(0, np.int32)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([part << 32 | number], pa.int64()), "words": pa.array([list(words)], pa.list_(pa.binary())), "trained": pa.array([trained], pa.list_(pa.int64())),
            "doc_id": pa.array([docs], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "ends": pa.array([ends], pa.list_(pa.int64())),
            "index": [flat(0).tobytes()], "count": [flat(1).tobytes()],
        })

    docs, held, counts, words, size = [], [], [], {}, 0
    for batch in batches:
        for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist()):
            own = text.lower().split()
            number_of = words.setdefault
            index = np.fromiter([number_of(w, len(words)) for w in own], np.int64, len(own))
            docs.append(doc), held.append(out), counts.append(np.unique(index, return_counts=True))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield flush(docs, held, counts, words)
                docs, held, counts, words, size, number = [], [], [], {}, 0, number + 1
    if docs:
        yield flush(docs, held, counts, words)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, so that the groups of one length are long."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _word_scores(shared, discount: float, rest: float, total: float, word_share: float):
    """Log10 probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("lattice")
        pieces = Pieces(*shared.value)
        for part in _gathered(batches):
            spelled = 10 ** pieces.log10(part.column("word").to_pylist())
            seen = np.maximum(part.column("c").to_numpy().astype(np.float64) - discount, 0)
            with np.errstate(divide="ignore"):
                lp = np.log10(word_share * (seen + rest * spelled) / total)
            low = np.flatnonzero(~np.isfinite(lp))  # so long a word that its probability is below the smallest double
            if len(low):
                words = part.column("word").take(pa.array(low)).to_pylist()
                lp[low] = pieces.log10(words) + math.log10(word_share * rest / total)
            yield from part.append_column("lp", pa.chunked_array([lp], pa.float64())).to_batches(max_chunksize=10_000)

    return run


_FOUND = np.dtype([("idx", "<i4"), ("c", "<i8"), ("lp", "<f8")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task found for the words of each block, as bytes of _FOUND records."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int64()), "found": pa.array([np.concatenate(v).tobytes() for v in held.values()], pa.binary())})

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, _FOUND)
        block = batch.column("block").to_numpy()
        for name in _FOUND.names:
            rows[name] = batch.column(name).to_numpy()
        order = np.argsort(block, kind="stable")
        block, rows = block[order], rows[order]
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        for b, own in zip(block[np.concatenate([[0], cuts])].tolist(), np.split(rows, cuts)):
            held.setdefault(b, []).append(own)
        size += rows.nbytes
        if size > BLOCK_BYTES:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _documents(total: int, distinct: int, ends: int, end_lp: float):
    """Sums over each text of a block."""
    floor = math.log10(total + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = np.frombuffer(b"".join(batch.column("found")[row].as_py() or []), _FOUND)
                ids, bounds = batch.column("doc_id")[row].as_py(), np.array(batch.column("ends")[row].as_py())
                index, count = (np.frombuffer(batch.column(c)[row].as_py(), np.int32) for c in ("index", "count"))
                size = int(index.max()) + 1 if len(index) else 0
                c, lp = np.zeros(size), np.zeros(size)
                c[own["idx"]], lp[own["idx"]] = own["c"], own["lp"]

                def sums(values: np.ndarray) -> np.ndarray:
                    running = np.concatenate([[0.0], np.cumsum(values)])
                    return np.array([math.fsum(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]) if values.dtype == np.float64 else running[bounds[1:]] - running[bounds[:-1]]

                base = sums((np.log10(c + 0.5) - floor)[index] * count) + math.log10(ends + 0.5) - floor
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": batch.column("held")[row].values,
                    "n_tokens": sums(count.astype(np.int64)).astype(np.int64) + 1,
                    "n_known": sums(np.where(c[index] > 0, count, 0).astype(np.int64)).astype(np.int64) + int(ends > 0),
                    "train_tokens": np.full(len(ids), total, np.int64), "base_score": base, "score": sums(lp[index] * count) + end_lp,
                })

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Null texts count as empty and score as the end alone. A null id falls into the fold of the empty string. Repeated
    rows each count. Without training rows the base gives each token probability 1 (0.5 over 0.5) and the lattice
    its pieces alone; an empty table gives an empty one. Other columns are not read. Words of any length are whole.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    shape = "block long, words array<binary>, trained array<long>, doc_id array<long>, held array<boolean>, ends array<long>, index binary, count binary"
    blocks = durable(rows.mapInArrow(_blocks, shape), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("idx", "w")).select("block", "idx", F.col("w.words").alias("word"), F.col("w.trained").alias("n"))
    words = durable(pairs.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")), "words")
    ends = blocks.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n")).first()[0] or 0
    times = lambda k: F.count(F.when(F.col("c") == k, 1))
    known = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), times(1), times(2), F.sum("blocks")).first()
    in_words, kinds, once, twice, places = (v or 0 for v in known)
    total, distinct = in_words + ends, kinds + (ends > 0)

    discount = once / (once + 2 * twice) if once and twice else 0.5
    shared = spark.sparkContext.broadcast(vocabulary(path))
    end_lp = math.log10((ends + 0.5) / (total + 1))
    how = _word_scores(shared, discount, discount * kinds + 0.5, in_words + 0.5, (in_words + 0.5) / (total + 1))
    scored = durable(words.mapInArrow(how, "word binary, c long, blocks long, lp double"), "scored")
    # A word that most blocks hold has many rows here: those words (of up to LONGEST_HOT bytes) meet their scores by a bounded broadcast.
    weighed = scored.withColumn("weight", F.when(F.octet_length("word") <= LONGEST_HOT, F.col("blocks")).otherwise(0)).drop("blocks")
    placed = hand_back(pairs.select("block", "idx", "word"), weighed, ["word"], "weight", places).select("block", "idx", "c", "lp")
    found = placed.mapInArrow(_packed, "block long, found binary").groupBy("block").agg(F.collect_list("found").alias("found"))
    joined = blocks.select("block", "doc_id", "held", "ends", "index", "count").join(found, "block", "left").drop("block")
    return joined.mapInArrow(_documents(total, distinct, ends, end_lp), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
