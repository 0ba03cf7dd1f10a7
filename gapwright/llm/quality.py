"""Quality rules: counts of a text, and a classifier of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm import ngrams
from gapwright.llm.text import whole

LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words in repeated windows
THRESHOLD = 0.5  # least probability of good quality
SAMPLE = 1500  # labelled rows that the classifier is fitted on, at most
HELD_OUT = 4  # one row in so many calibrates
ROUNDS = 120
RATE, DECAY = 0.5, 1e-4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Model:
    """Weights of n-gram buckets; probability = sigmoid(slope * score + shift)."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -500, 500)))


def neutral() -> Model:
    """For corpora without labels of both kinds: everything passes."""
    return Model(np.zeros(3 * ngrams.BUCKETS), 0.0, 50.0)


def _adam(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, share: float) -> Model:
    """``rows``: (buckets, weights) of each text. ``share``: good texts among
    all labelled ones; the sample may hold another share, and the calibration
    weighs its rows back to this one."""
    test = np.arange(len(rows)) % HELD_OUT == 0
    if len(rows) < 2 * HELD_OUT or len({*good[test]}) < 2 or len({*good[~test]}) < 2:
        return neutral()
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows]).astype(np.float64) * 30
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    train = ~test
    weight = np.where(train, np.where(good, 0.5 / good[train].sum(), 0.5 / (~good[train]).sum()), 0)

    def score(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=value * x[at], minlength=len(rows))

    def gradient(x: np.ndarray) -> np.ndarray:
        miss = (1 / (1 + np.exp(-np.clip(score(x[:-1]) + x[-1], -500, 500))) - good) * weight
        return np.append(np.bincount(at, weights=value * miss[of], minlength=len(x) - 1) + DECAY * x[:-1], miss.sum())

    x = _adam(gradient, 3 * ngrams.BUCKETS + 1, ROUNDS, RATE)
    raw = score(x[:-1])[test]
    held = good[test]
    weigh = np.where(held, share / held.sum(), (1 - share) / (~held).sum())
    # Platt's targets keep the fit finite where the classes part cleanly
    goal = np.where(held, (held.sum() + 1) / (held.sum() + 2), 1 / ((~held).sum() + 2))
    scale = max(raw.std(), 1e-9)

    def slope(y: np.ndarray) -> np.ndarray:
        miss = (1 / (1 + np.exp(-np.clip(y[0] * raw / scale + y[1], -500, 500))) - goal) * weigh
        return np.array([(miss * raw).sum() / scale, miss.sum()])

    y = _adam(slope, 2, 600, 0.1)
    return Model(x[:-1] * 30, float(y[0] / scale), float(y[1]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngrams.features(t.as_py().encode()) for t in batch["_text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["_label"], batch["_order"], pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found], pa.list_(pa.float32()))],
            ["_label", "_order", "at", "value"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Classifier of good quality (label 1 or more) fitted on at most
    ``sample`` labelled rows, half of each kind where there are enough: those
    with the smallest hash of the id, which is a fixed random choice. The
    driver gets their n-gram counts, at most ``3 * 2^14`` pairs of 8 bytes a
    row (0.6 GB if every row held every n-gram; some 20 MB as texts are)."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.max(label_col) > 0).alias("_label"))
        .join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
        .withColumn("_order", F.xxhash64("_id"))
    )
    share = known.agg(F.avg(F.col("_label").cast("int"))).first()[0]
    if share is None or share in (0.0, 1.0):
        return neutral()
    half = [known.where(F.col("_label") == kind).orderBy("_order", "_id").limit(sample // 2) for kind in (False, True)]
    chosen = half[0].unionByName(half[1])
    texts = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    rows = (
        texts.join(F.broadcast(chosen), "_id")  # at most `sample` rows of three short columns
        .select("_label", "_order", "_text")
        .mapInArrow(_features, "_label boolean, _order long, at array<int>, value array<float>")
        .toArrow()
        .sort_by([("_order", "ascending")])
    )
    pairs = [(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(rows["at"], rows["value"], strict=True)]
    return fit(pairs, np.asarray(rows["_label"].to_pylist(), bool), float(share))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``probability`` and ``kept``.

    Words are runs of anything but the six ASCII white space characters.
    ``n_repeat_words`` counts words in windows of five found twice or more in
    the text (windows are compared by 64-bit hashes). A text fails the base
    rules with fewer than ten words or over 20 % repeated ones; else the
    classifier's calibrated probability of good quality decides, by a fixed
    threshold. Null and empty texts have no words and fail. Rows are judged
    each by itself, repeated ones alike; an empty table gives no rows; other
    columns pass through, and those named like a result are replaced.
    """
    weights = docs.sparkSession.sparkContext.broadcast((model.weights[: 2 * ngrams.BUCKETS], model.weights[2 * ngrams.BUCKETS :], model))
    results = [*((c, "long") for c in COUNTS), ("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")]
    carried = [c for c in docs.columns if c not in dict(results)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_weights, char_weights, fitted = weights.value
        for batch in ngrams.parts(batches):
            at = 0
            for group in ngrams.groups([t.encode() for t in batch["_text"].to_pylist()]):
                s = ngrams.stats(group, word_weights, char_weights)
                failed = (s.words < LEAST_WORDS) | (100 * s.repeat_words > MOST_REPEATED * s.words)
                p = fitted.probability(s.score)
                out = [s.words, s.word_chars, s.symbols, s.dup_lines, s.repeat_words, failed, p, ~failed & (p >= THRESHOLD)]
                part = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in carried), *map(pa.array, out)], [*carried, *dict(results)])

    schema = docs.select(*carried).schema
    for name, kind in results:
        schema = schema.add(name, kind)
    return docs.select(*carried, whole(text_col).alias("_text")).mapInArrow(run, schema)
