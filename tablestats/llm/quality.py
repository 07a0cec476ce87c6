"""Quality score from compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A
text is compressed with each; the difference of the two sizes, divided by the
text's length, says which kind it resembles. A logistic curve over that
difference and its companions (either size over the length, the relative
difference) turns it into a probability, fitted on sizes under dictionaries that
were built without the text in question.

The model is fitted on a bounded sample of labelled rows (``MAX_PER_LABEL`` rows
of each label by a seeded hash; of a longer text a stretch of ``MAX_SAMPLE_CHARS``
characters, from a place given by a hash), so what reaches the driver has a fixed bound.
Every text is scored whole.

Edge cases: a null text counts as empty; empty texts get the score of their
sizes like any other; null ids are scored and never held out (crc32 of a null is
null); without labels of both kinds the score is the share of good labels, or 1
with no labels at all (nothing is rejected without evidence); repeated rows are
scored alike; an id that is labelled both good and bad is not learnt from, and of the
texts of a repeated id those with the smallest hashes are; other columns are ignored, or passed
through by ``keep_good``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestats.llm.common import column, small_batches

MAX_PER_LABEL = 2000
MAX_SAMPLE_CHARS = 20_000
DICT_BYTES = 112_640
#: Sample texts are cut into pieces of this many bytes for dictionary building.
PIECE_BYTES = 2048
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5
#: Parts for cross-fitting the curve.
CROSS = 3


@dataclass(frozen=True)
class QualityModel:
    """Everything a task needs to score texts; a few hundred KB."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weights: np.ndarray
    prior: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Sizes:
    """Compressed sizes under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self._by = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self._by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, ...]:
        raw = text.encode()
        n = len(raw) + 16
        good, bad = (len(c.compress(raw)) for c in self._by)
        return (bad - good) / n, good / n, (bad - good) / (bad + good), float(np.log(n))


def _design(x: np.ndarray) -> np.ndarray:
    """The features, their squares and products, and a constant."""
    k = x.shape[1]
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i in range(k) for j in range(i, k))])


class Scorer:
    def __init__(self, model: QualityModel):
        self.model = model
        self.sizes = Sizes(model.good, model.bad) if model.good else None

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        if not self.sizes:
            return np.full(len(texts), m.prior)
        if not texts:
            return np.zeros(0)
        x = np.array([self.sizes.features(t) for t in texts])
        # Beyond the range seen in fitting the curve stays level.
        x = (np.clip(x, m.low, m.high) - m.mean) / m.scale
        # Summed row by row, so that equal texts score alike to the last bit.
        return 1 / (1 + np.exp(-np.clip((_design(x) * m.weights).sum(1), -30, 30)))


def _dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of the texts; of the raw texts where they are too few to build one."""
    pieces = [p[i:i + PIECE_BYTES] for p in (t.encode() for t in texts) for i in range(0, len(p), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:]


def fit(rows: list[tuple[str, int]], seed: int = 17, odds: float | None = None) -> QualityModel:
    """Fit on (text, label) rows: dictionaries of all texts, the curve by cross-fitting.

    ``odds``: good to bad labels where the rows come from, if they were drawn evenly;
    the score is then a probability there.
    """
    by = {k: sorted(t for t, y in rows if y == k) for k in (0, 1)}
    none = np.zeros(0)
    if min(len(by[0]), len(by[1])) < 4:
        prior = len(by[1]) / len(rows) if rows else 1.0
        return QualityModel(b"", b"", none, none, none, none, none, prior)
    for texts in by.values():
        random.Random(seed).shuffle(texts)
    built = {k: _dictionary(t) for k, t in by.items()}
    x = {0: [], 1: []}
    for i in range(CROSS):  # the curve sees only sizes under dictionaries built without the text
        sizes = Sizes(*(_dictionary([t for j, t in enumerate(by[k]) if j % CROSS != i]) for k in (1, 0)))
        for k in (0, 1):
            x[k] += [sizes.features(t) for t in by[k][i::CROSS]]
    rest, x = x, np.array(x[0] + x[1])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    low, high, mean, scale = x.min(0), x.max(0), x.mean(0), x.std(0) + 1e-9
    a = _design((x - mean) / scale)
    w = _curve(a, y)
    if odds:
        w[0] += np.log(odds * (1 - y).sum() / y.sum())
    return QualityModel(built[1], built[0], mean, scale, low, high, w, float(y.mean()))


def _curve(a: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of ridge logistic regression, by Newton steps that are halved until they lower the loss.

    The two kinds may be told apart perfectly; then the ridge keeps the weights finite,
    and full steps would overshoot.
    """
    sign = 2 * y - 1

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (a @ w)).sum() + ridge / 2 * w @ w)

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        gradient = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), gradient)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-9:
            size /= 2
        if now - new < 1e-9:
            break
        w, now = w - size * step, new
    return w


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_per_label: int = MAX_PER_LABEL) -> QualityModel:
    """Fit a model on a bounded sample of the labelled rows outside the held-out fold."""
    known = (labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id"))))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    # A label at random by hash: a bounded top-k, then a join with at most twice that many ids.
    pick = known.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    some = [pick.where(F.col("label") == k).orderBy("h", "doc_id").limit(max_per_label).select("doc_id", "label") for k in (0, 1)]
    texts = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").withColumn("h", F.xxhash64("text"))
    more = F.greatest(F.char_length("text") - MAX_SAMPLE_CHARS, F.lit(0))
    part = F.substring("text", (F.pmod("h", more + 1) + 1).cast("int"), F.lit(MAX_SAMPLE_CHARS))
    rows = rows.select("doc_id", "label", "h", part.alias("text")).orderBy("doc_id", "h", "text").limit(4 * max_per_label).collect()
    good, bad = known.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    return fit([(r["text"], r["label"]) for r in rows], odds=good / bad if good and bad else None)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.scores([t or "" for t in b.column("text").to_pylist()]), pa.float64())], ["doc_id", "score"])

    return (rows.mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score reaches the threshold."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in batches:
            good = s.scores([t or "" for t in b.column(at).to_pylist()]) >= threshold
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(good)).columns, names)

    # Numbered for the way in: mapInArrow takes a dot in a column's name for a field's.
    return docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, docs.schema)
