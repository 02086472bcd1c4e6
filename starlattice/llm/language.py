"""Language identification by hierarchical discrimination.

A text becomes counts of hashed byte n-grams (1 to 3 bytes of the lower-cased UTF-8), whole text, root-scaled and of
unit length. A linear one-against-rest machine predicts the language family; inside the family one linear support
vector machine for each pair of its languages votes. All machines are trained on the driver by averaged stochastic
sub-gradient descent on the hinge loss, from a bounded sample (see :func:`fit`). Prediction covers every row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import owns_worker, small_batches

BITS = 13
# Families by ISO 639-1 codes; any other language is a family of its own.
_MEMBERS = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la co sc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi mr ne bn as gu pa or si ur",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su tl mg",
    "bantu": "sw zu xh st sn",
    "sinitic": "zh yue",
    "tai": "th lo",
}
FAMILIES = {code: family for family, codes in _MEMBERS.items() for code in codes.split()}
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Root-scaled counts of hashed 1-, 2- and 3-grams over the whole text, of unit length."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros(1 << BITS, np.float32)
    step = 1 << 20
    for at in range(0, len(data), step):  # in pieces that overlap by two bytes, to bound memory
        x = data[at : at + step + 2].astype(np.uint32)
        own = min(step, len(x))
        a, b = x[:-1], x[1:]
        two = (a << 8) | b
        three = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        mix = lambda v, salt: ((v * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(32 - BITS)).astype(np.int64)
        for part, salt in ((x[:own], 0x1F123BB5), (two[:own], 0x51ED270B), (three[:own], 0x9E3779B9)):
            out += np.bincount(mix(part, salt), minlength=1 << BITS).astype(np.float32)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-12)


def fit_machine(x: np.ndarray, y: np.ndarray, epochs: int = 12, penalty: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """A linear support vector machine: averaged sub-gradient descent on the hinge loss; y is +1 or -1."""
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1))
    w, b, mean_w, mean_b, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    batch = 16
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            t += 1
            rate = 1.0 / (penalty * (t + 1000))
            rate = min(rate, 5.0)
            bad = y[rows] * (x[rows] @ w + b) < 1
            g = (weight[rows] * y[rows] * bad) / len(rows)
            w = w * (1 - rate * penalty) + rate * (g @ x[rows])
            b += 0.1 * rate * g.sum()
            if epoch >= epochs // 2:
                mean_w += w
                mean_b += b
    n = max(1, sum(max(1, len(y) // batch) for e in range(epochs) if e >= epochs // 2))
    return mean_w / n, mean_b / n


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1."""
        if text is None or not self.families or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        x = features(text)
        at, score = 0, 1.0
        if len(self.families) > 1:
            margins = self.family_w @ x + self.family_b
            at = int(np.argmax(margins))
            odds = np.exp(2 * (margins - margins.max()))
            score = float(odds[at] / odds.sum())
        family = self.families[at]
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], score
        votes = np.zeros(len(langs))
        soft = np.ones(len(langs))
        for i, j, w, b in self.pairs[family]:
            p = 1 / (1 + np.exp(-2 * float(np.clip(w @ x + b, -30, 30))))
            votes[i if p >= 0.5 else j] += 1
            soft[i] *= p
            soft[j] *= 1 - p
        best = int(np.lexsort((np.arange(len(langs)), -soft, -votes))[0])
        return langs[best], score * float(soft[best] / soft.sum())


def train(x: np.ndarray, langs: list[str]) -> Model:
    """Family machines over all samples (rows of features), pair machines within each family."""
    if not langs:
        return Model()
    lang = np.array(langs)
    family = np.array([FAMILIES.get(g, g) for g in lang])
    out = Model(families=sorted(set(family)))
    fits = [fit_machine(x, np.where(family == f, 1.0, -1.0)) for f in out.families] if len(out.families) > 1 else []
    if fits:
        out.family_w, out.family_b = np.stack([w for w, _ in fits]).astype(np.float32), np.array([b for _, b in fits])
    for f in out.families:
        langs = out.members[f] = sorted(set(lang[family == f]))
        out.pairs[f] = []
        for i, j in itertools.combinations(range(len(langs)), 2):
            own = (lang == langs[i]) | (lang == langs[j])
            w, b = fit_machine(x[own], np.where(lang[own] == langs[i], 1.0, -1.0))
            out.pairs[f].append((i, j, w.astype(np.float32), b))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of sample texts, so that no text goes to the driver."""
    for batch in batches:
        rows = [features(t) for t in batch.column("t").to_pylist()]
        used = [np.flatnonzero(x) for x in rows]
        yield pa.RecordBatch.from_pydict({"g": batch.column("g"), "h": batch.column("h"), "at": pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())), "x": pa.array([x[u] for x, u in zip(rows, used)], pa.list_(pa.float32()))})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 150, max_langs: int = 480, max_rows: int = 4800) -> Model:
    """Train on a bounded sample of the labelled rows of ``docs``: ``per_lang`` texts of each language, fewer where that
    would be more than ``max_rows`` in all, and of the ``max_langs`` languages with most rows; a rarer one is not learned.

    The sample is the texts whose hash is smallest, so it does not depend on partitioning. The driver gets their
    features, of fixed width. Rows without a label, a text or a letter teach nothing; with no such row every prediction
    is ``und``.
    """
    labelled = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g")).filter(F.col("t").isNotNull() & F.col("g").isNotNull() & F.rlike("t", F.lit(r"\p{L}")))
    langs = [r["g"] for r in labelled.groupBy("g").count().orderBy(F.desc("count"), "g").limit(max_langs).collect()]
    each = min(per_lang, max(1, max_rows // max(1, len(langs))))
    ranked = labelled.filter(F.col("g").isin(langs)).select("g", F.xxhash64("t").alias("h"))
    first = Window.partitionBy("g").orderBy("h")
    chosen = ranked.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= each).select("g", "h").distinct()
    marks = [(r["g"], r["h"]) for r in chosen.collect()]  # max_rows at most
    if not marks:
        return train([], [])
    rows = labelled.withColumn("h", F.xxhash64("t")).filter(F.col("h").isin(sorted({h for _, h in marks}))).dropDuplicates(["g", "h"])
    got = sorted(rows.mapInArrow(_sampled, "g string, h long, at array<int>, x array<float>").collect(), key=lambda r: (r["g"], r["h"]))
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = r["x"]
    return train(x, [r["g"] for r in got])


def _mapper(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("language")
        m = model.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]  # the text stands last
            columns = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "_lang", "_score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` and _lang (``und`` if null or without a letter) and _score.

    Repeated rows are predicted alike; an empty table gives an empty one. Kept columns that are themselves named _lang or
    _score give way to the results.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    shared = spark.sparkContext.broadcast(model)  # a matrix of fixed width for each pair of at most max_langs languages
    keep = [c for c in keep or [] if c not in ("_lang", "_score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("\x00text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("_lang", "string").add("_score", "double")
    return rows.mapInArrow(_mapper(shared), schema)
