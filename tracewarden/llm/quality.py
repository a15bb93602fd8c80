"""Quality rules: counted text statistics and a hashed n-gram classifier with calibrated scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .storage import written
from .text import Words, slices, split_words

#: Hash buckets of word n-grams and of character n-grams.
BUCKETS = 1 << 15
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
KEEP_FROM = 0.5
_A, _B, _C, _D = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint32(15))) * _A) >> np.uint32(17)


def word_ngrams(hashed: np.ndarray) -> np.ndarray:
    """Buckets of the words and word pairs of a text, from 32-bit word hashes."""
    pairs = hashed[:-1] * _B + hashed[1:] * _C + _D
    return np.concatenate([_bucket(hashed), _bucket(pairs)])


def character_ngrams(text: str) -> np.ndarray:
    """Buckets of the runs of three and four characters."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    if len(c) < 3:
        return np.zeros(0, dtype=np.uint32)
    three = c[:-2] * _A + c[1:-1] * _B + c[2:] * _C
    return np.concatenate([_bucket(three), _bucket(three[:-1] + c[3:] * _D)])


def word_hashes(words: Words) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words.distinct), dtype=np.uint32, count=len(words.distinct))


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(codes) < 4:
        return 0
    c = codes.astype(np.int64)
    _, pair = np.unique(c[:-1] * distinct + c[1:], return_inverse=True)
    _, at, n = np.unique(pair[:-1] * distinct + c[2:], return_inverse=True, return_counts=True)
    again = n[at] >= 2
    covered = np.zeros(len(c), dtype=bool)
    for i in range(3):
        covered[i:len(c) - 2 + i] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


@dataclass
class QualityModel:
    """Weights by bucket, and the slope and offset that turn a margin into a probability."""

    word_weights: np.ndarray
    character_weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, words: np.ndarray, characters: np.ndarray) -> float:
        total = self.bias
        if len(words):
            total += float(self.word_weights[words].mean())
        if len(characters):
            total += float(self.character_weights[characters].mean())
        return total

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def calibrate(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins, by Newton's method."""
    x, start, prior = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0]), 1e-3
    sign = np.where(labels > 0, 1.0, -1.0)

    def loss(theta: np.ndarray) -> float:
        return float(weights @ np.logaddexp(0, -sign * (x @ theta)) + prior / 2 * ((theta - start) ** 2).sum())

    theta = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        gradient = x.T @ (weights * (p - labels)) + prior * (theta - start)
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + prior * np.eye(2), gradient)
        size = 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-10:  # a far outlier makes the full step too long
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def fit_quality(
    events: DataFrame, labels: DataFrame, event_id: str = "event_id", canonical_string: str = "canonical_string",
    label: str = "quality", where: Column | None = None, rows_per_class: int = 1500, strength: float = 0.02,
) -> QualityModel:
    """Logistic regression on relative frequencies of hashed word (1, 2) and character (3, 4) n-grams.

    Learns from a bounded sample (``labelled_sample``); a fifth of it is kept for the calibration, in
    which classes have their true weight. With labels of one class only, every text gets their share.
    """
    sample = written(labelled_sample(events, labels, label, rows_per_class, event_id, canonical_string, where), "quality-rows")
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    none = np.zeros(BUCKETS, dtype=np.float32)
    if len(classes) < 2:
        return QualityModel(none, none, 0.0, 1.0, 30.0 if classes.get(0) is None else -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                hashed, places, values = word_hashes(words), [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    row = {}
                    for shift, grams in ((0, word_ngrams(hashed[words.of(i)])), (BUCKETS, character_ngrams(text))):
                        index, n = np.unique(grams, return_counts=True)
                        row |= dict(zip((index.astype(np.int64) + shift).tolist(), (n / max(len(grams), 1)).tolist()))
                    places.append(list(row))
                    values.append(list(row.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("fold"), part.column("weight"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                    ["label", "fold", "weight", "places", "values"])

    counted = written(sample.mapInArrow(count, "label int, fold int, weight double, places array<int>, values array<double>"), "quality-grams")
    sparse = F.udf(lambda i, v: SparseVector(2 * BUCKETS, i, v), VectorUDT())  # on the bounded sample alone
    rows = counted.withColumn("features", sparse("places", "values")).select("label", "fold", "weight", "features")
    model = LogisticRegression(maxIter=40, regParam=strength, standardization=True).fit(rows.where("fold > 0"))
    weights = model.coefficients.toArray()
    fitted = QualityModel(weights[:BUCKETS].astype(np.float32), weights[BUCKETS:].astype(np.float32), float(model.intercept), 1.0, 0.0)
    held = counted.where("fold = 0").select("label", "weight", "places", "values").toPandas()  # a fifth of the sample
    if held["label"].nunique() == 2:
        margins = np.array([weights[np.asarray(i, dtype=int)] @ np.asarray(v) + model.intercept for i, v in zip(held["places"], held["values"])])
        fitted.slope, fitted.offset = calibrate(margins, held["label"].to_numpy(float), held["weight"].to_numpy(float))
    return fitted


def judge_quality(
    events: DataFrame, model: QualityModel, event_id: str = "event_id", canonical_string: str = "canonical_string", keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Base statistics and verdict of every whole text: ``event_id``, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``probability``, ``kept``.

    The project's records are machine text without quality labels, so this works on any table with an
    id and a text. ``base_failed``: fewer than 50 words, or more than half of them in repeated windows
    of three. ``kept``: not failed, and a calibrated probability of at least ``keep_from``. Null and
    empty texts have no words and fail. All rows are kept as rows, whatever their id; an empty table
    gives no rows. Texts are read in slices, so memory follows the longest text alone.
    """
    rows = events.select(F.col(event_id).alias("event_id"), F.col(canonical_string).cast("string").alias("text"))
    kind = rows.schema["event_id"].dataType.simpleString()
    shared = events.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                distinct = pa.array(words.distinct, pa.large_string())
                chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
                symbols = pc.count_substring_regex(distinct, SYMBOLS).to_numpy(zero_copy_only=False)
                hashed, out, scores = word_hashes(words), [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    codes, text = words.of(i), text or ""
                    out.append((len(codes), int(chars[codes].sum()), int(symbols[codes].sum()), duplicate_lines(text), repeated_words(codes, len(words.distinct))))
                    scores.append(own.probability(own.margin(word_ngrams(hashed[codes]), character_ngrams(text))))
                table = np.array(out, dtype=np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays(
                    [part.column("event_id"), *[pa.array(table[:, k]) for k in range(len(names))], pa.array(scores, pa.float64())],
                    ["event_id", *names, "probability"])

    judged = rows.mapInArrow(judge, f"event_id {kind}, {', '.join(n + ' long' for n in names)}, probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= keep_from))
