"""Byte-pair encoding by speculating and verifying.

A word is first cut greedily into longest vocabulary entries (the speculation). A cut is what the merges would give if
every token comes out of its own merging whole and every adjacent pair of tokens stays apart when the merges run over
the two alone; both are looked up for all pairs of a batch at once in sorted arrays of judged pairs. Only words with a
failing token or pair go through the merges themselves.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import owns_worker, small_batches, worker_memory

#: Estimated bytes of words and strings that one Python worker keeps, in two generations each.
MEMORY = 32 << 20
#: Strings encoded together.
GROUP = 120_000
#: Words of more letters are merged with a heap.
LONG_WORD = 64
#: Words of one length that are worth a step together.
TOGETHER = 24
NEVER, ID_BITS = 1 << 62, (1 << 24) - 1

def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class PairTable:
    """Merges by pair of ids, for arrays: an open hash table."""

    BITS, SPREAD = 18, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranked: dict[tuple[int, int], int]):
        bits = max(self.BITS, (4 * len(ranked)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
        pairs = np.array([a << 32 | b for a, b in ranked], np.int64)
        for at, key, value in zip(self._home(pairs).tolist(), pairs.tolist(), ranked.values()):
            while self.keys[at] >= 0:
                at = at + 1 & self.last
            self.keys[at], self.values[at] = key, value

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * self.SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 24 | id of what each pair becomes, NEVER where it stays."""
        pairs = (left << 32 | right).ravel()
        at = self._home(pairs)
        held = self.keys[at]
        lost = np.flatnonzero((held != pairs) & (held >= 0))
        while len(lost):
            at[lost] = at[lost] + 1 & self.last
            held = self.keys[at[lost]]
            lost = lost[(held != pairs[lost]) & (held >= 0)]
        return np.where(self.keys[at] == pairs, self.values[at], NEVER).reshape(left.shape)


class Memory(dict):
    """What was found lately: half of the bytes are new, the older half goes when the newer is full; hot entries stay."""

    def __init__(self, nbytes: int):
        super().__init__()
        self.most, self.held, self.old = nbytes // 2, 0, {}

    def lacking(self, keys: set) -> set:
        """Keys not held; those of the older half move to the newer."""
        gone = keys - self.keys()
        for k in gone & self.old.keys():
            self[k] = self.old.pop(k)
            self.held += self.weight(k)
        return gone - self.keys()

    @staticmethod
    def weight(key: str) -> int:
        return 200 + 8 * len(key)

    def learn(self, found: dict) -> None:
        self.update(found)
        self.held += self.weight("") * len(found) + 8 * sum(map(len, found))

    def age(self) -> None:
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0


class Codec:
    """Encoder and decoder of a BPE file with word ends, as a JSON text."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocab
        self.ranked = {(ids[a], ids[b]): rank << 24 | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.table_of_pairs = PairTable(self.ranked)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        self.table = str.maketrans(self.letters)
        self.reach: dict[str, int] = {}  # the longest entry that begins with four letters
        for t in ids:
            bare = t.removesuffix(self.end)
            if len(bare) > 3:
                self.reach[bare[:4]] = max(self.reach.get(bare[:4], 3), len(bare))
        self.final = {t.removesuffix(self.end): i for t, i in ids.items() if self.end and t.endswith(self.end) and t != self.end} if self.end else ids
        self.whole: dict[int, bool] = {}  # does a token come out of its own merging whole?
        self.pairs = np.zeros(0, np.int64)  # judged pairs, sorted, and what was found
        self.fits = np.zeros(0, bool)
        self.known = Memory(MEMORY // 2)  # words and their ids as bytes
        self.strings = Memory(MEMORY // 2)  # what stands between two blanks: its ids as bytes
        self.said = {i: " " + t for i, t in self.names.items()}

    # -- exact merging -------------------------------------------------------------------------------------------
    def _letters_of(self, word: str) -> list[int]:
        """Ids of a word's letters; its last letter carries the word end. Letters without an id are left out."""
        marked = [*word[:-1], word[-1] + self.end]
        return [self.vocab[c] for c in marked if c in self.vocab]

    def merged(self, parts: list[int]) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(parts) > LONG_WORD:
            return self._merged_long(parts)
        ranked, parts = self.ranked.get, list(parts)
        keys = [ranked(p, NEVER) for p in zip(parts, parts[1:])]
        while keys:
            best = min(keys)
            if best == NEVER:
                break
            i = keys.index(best)
            parts[i : i + 2] = [best & ID_BITS]
            del keys[i]
            if i:
                keys[i - 1] = ranked((parts[i - 1], parts[i]), NEVER)
            if i < len(keys):
                keys[i] = ranked((parts[i], parts[i + 1]), NEVER)
        return parts

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """:meth:`merged` for many words: those of one length make a step together, each losing one part by it."""
        out: list[list[int]] = [[]] * len(words)
        groups: dict[int, list[int]] = {}
        for i, parts in enumerate(words):
            groups.setdefault(len(parts), []).append(i)
        find = self.table_of_pairs.find
        for length, own in groups.items():
            if length < 2 or length > LONG_WORD or len(own) < TOGETHER:
                for i in own:
                    out[i] = self.merged(words[i])
                continue
            at, parts = np.array(own), np.array([words[i] for i in own], np.int64)
            keys = find(parts[:, :-1], parts[:, 1:])
            while True:
                first = keys.argmin(axis=1) if keys.shape[1] else np.zeros(len(at), np.int64)
                best = keys[np.arange(len(at)), first] if keys.shape[1] else np.full(len(at), NEVER)
                go = best != NEVER
                for i, done in zip(at[~go].tolist(), parts[~go].tolist()):
                    out[i] = done
                if not go.any():
                    break
                at, parts, keys, first, best = at[go], parts[go], keys[go], first[go], best[go]
                rows, n = np.arange(len(at)), parts.shape[1]
                parts[rows, first] = best & ID_BITS
                stay = np.ones(parts.shape, bool)
                stay[rows, first + 1] = False
                parts = parts[stay].reshape(len(at), n - 1)
                stay = np.ones(keys.shape, bool)
                stay[rows, first] = False
                keys = keys[stay].reshape(len(at), n - 2)
                for side in (first - 1, first):  # the pairs that the new part makes with its neighbours
                    has = np.flatnonzero((side >= 0) & (side < n - 2))
                    keys[has, side[has]] = find(parts[has, side[has]], parts[has, side[has] + 1])
        return out

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same for long words: a heap of pairs over a linked list, in n log n steps."""
        ranked, token = self.ranked.get, list(parts)
        after, before = [*range(1, len(token)), -1], [*range(-1, len(token) - 1)]
        heap = [(k, i, token[i], token[i + 1]) for i in range(len(token) - 1) if (k := ranked((token[i], token[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            key, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j < 0 or token[j] != right:
                continue
            token[i], token[j] = key & ID_BITS, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (k := ranked((token[a], token[b]), NEVER)) != NEVER:
                    heapq.heappush(heap, (k, a, token[a], token[b]))
        return [t for t in token if t >= 0]

    def _parts(self, token: int) -> list[int]:
        """The letters that a token is made of."""
        name = self.names[token]
        if self.end and name.endswith(self.end) and name != self.end:
            return self._letters_of(name.removesuffix(self.end))
        return [self.vocab[c] for c in name if c in self.vocab]

    # -- speculation ---------------------------------------------------------------------------------------------
    def guess(self, word: str) -> list[int]:
        out, i, n = [], 0, len(word)
        vocab, final, reach = self.vocab.get, self.final.get, self.reach.get
        while i < n:
            far = i + reach(word[i : i + 4], 3)
            if far >= n:
                token = final(word[i:])
                if token is not None:
                    out.append(token)
                    break
                far = n - 1
            for j in range(far, i, -1):
                token = vocab(word[i:j])
                if token is not None:
                    out.append(token)
                    i = j
                    break
            else:
                i += 1  # no id for this letter
        return out

    # -- verification --------------------------------------------------------------------------------------------
    def _stands(self, token: int) -> bool:
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(self._parts(token)) == [token]
        return found

    def _judge(self, keys: np.ndarray) -> np.ndarray:
        """For pairs as left << 32 | right: do the two stay apart? New pairs are judged once and remembered sorted."""
        distinct = np.unique(keys)
        at = np.searchsorted(self.pairs, distinct)
        new = distinct[(at >= len(self.pairs)) | (self.pairs[np.minimum(at, max(len(self.pairs) - 1, 0))] != distinct)] if len(self.pairs) else distinct
        if len(new):
            found = []
            for key in new.tolist():
                a, b = key >> 32, key & 0xFFFFFFFF
                found.append(self._stands(a) and self._stands(b) and self.merged(self._parts(a) + self._parts(b)) == [a, b])
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, np.array(found, bool))
        return self.fits[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> None:
        """Encode new words together and remember them."""
        if len(self.pairs) > MEMORY // 32:
            self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        lettered = [w.translate(self.table) if w.isascii() else w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in words]
        guesses = [self.guess(w) for w in lettered]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        fails = np.zeros(len(guesses), bool)
        inner = owner[1:] == owner[:-1]
        if inner.any():
            bad = ~self._judge((flat[:-1][inner] << 32) | flat[1:][inner])
            fails[owner[1:][inner][bad]] = True
        for i in np.flatnonzero(sizes == 1).tolist():
            fails[i] = not self._stands(guesses[i][0])
        failing = np.flatnonzero(fails).tolist()
        for i, parts in zip(failing, self.merge_all([self._letters_of(lettered[i]) for i in failing])):
            guesses[i] = parts
        self.known.learn(dict(zip(words, map(packed, guesses))))

    # -- texts ---------------------------------------------------------------------------------------------------
    @staticmethod
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()  # letter by letter: no final sigma

    def _remember(self, strings: set[str]) -> None:
        """Encode what stands between blanks. No word crosses white space, so strings can be taken one by one."""
        plain = strings - self.special.keys()
        find, normal = self.words.findall, self.normal
        cut = {s: find(s.lower() if s.isascii() else normal(s)) for s in plain}
        self.learn(sorted(self.known.lacking({w for words in cut.values() for w in words})))
        known = self.known
        found = {s: packed([self.special[s]]) for s in strings - plain}
        for s, words in cut.items():
            found[s] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        self.strings.learn(found)
        self.known.age()

    def _strings(self, text: str) -> list[str]:
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        return [s for p in parts for s in ([p] if p in self.special else p.replace("\n", " ").split(" "))]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, int, str]]:
        """Per text: ids as little-endian unsigned 32-bit integers, their number, and the decoded text."""
        at = 0
        while at < len(texts):  # as many texts at once as have GROUP strings, one text at least
            group, n = [], 0
            while at < len(texts) and (not group or n < GROUP):
                group.append(self._strings(texts[at]))
                n += len(group[-1])
                at += 1
            new = self.strings.lacking(set().union(*group))
            if new:
                self._remember(new)
            for strings in group:
                ids = b"".join(map(self.strings.__getitem__, strings))
                yield ids, len(ids) // 4, "".join(map(self.said.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]
            self.strings.age()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the names stand side by side with a space between; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spec(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


#: The codec of a Python worker, which its tasks share with all that it remembers until another operator takes the worker.
_codecs: dict[str, Codec] = worker_memory("bpe", {})


def _codec(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _mapper(spec, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("bpe")
        codec = _codec(spec.value)
        for batch in batches:
            out = list(codec.encode_batch(batch.column("_text").to_pylist()))
            found = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([o[1] for o in out], pa.int64())}
            if digests:
                found["ids_sha256"] = pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string())
                found["decoded_sha256"] = pa.array([hashlib.sha256(o[2].encode("utf-8", "replace")).hexdigest() for o in out], pa.string())
            else:
                found["ids"] = pa.array([np.frombuffer(o[0], "<u4").astype(np.int32) for o in out], pa.list_(pa.int32()))
                found["decoded"] = pa.array([o[2] for o in out], pa.string())
            yield pa.RecordBatch.from_pydict(found)

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """Encode and decode every whole text; one row per row of ``docs``.

    Returns doc_id, n_tokens, ids (array<int>) and decoded; with ``digests`` instead of the two their SHA-256 in hex.
    Null texts count as empty (no tokens). Repeated rows and null ids give rows alike; other columns are not read.
    ``vocabulary`` is the path of the tokenizer file on the driver; its content (a fixed file of a few MB) is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 1000)
    spec = spark.sparkContext.broadcast(_spec(vocabulary))
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(_mapper(spec, digests), schema)
