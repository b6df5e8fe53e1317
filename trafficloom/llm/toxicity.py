"""Toxicity as an ordinal severity: cumulative-link regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all thresholds, which are ordered. x holds log(1 + count) of
marker words, so a long text is not excused by its length. What is given per document is the expected grade.

Labels say toxic or not. Of the toxic ones, those with more marker words than the median toxic document are graded 2, the
others 1, and the rest 0; tables with grades of their own can be fitted as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.licenses import words
from trafficloom.llm.texts import emitted, narrow, rows_of
from trafficloom.plans.pinning import pin

SAMPLE = 8000
FEATURES = 500
MIN_DOCUMENTS = 4
MIN_Z = 3.0
PREFIXES = (6, 7)
RIDGE = 1e-4
STEPS = 200
_SCORES = "doc_id long, expected_severity double, grade int, rejected boolean"


def features(found: list[bytes]) -> Counter[bytes]:
    """Counts of the words and of their beginnings of 6 and 7 bytes, marked by a sign that no word holds."""
    counts = Counter(found)
    for word, n in list(counts.items()):
        if len(word) >= PREFIXES[0]:
            for size in PREFIXES:
                counts[b"^" + word[:size]] += n
    return counts


def known_features(found: list[bytes], known: Mapping[bytes, object]) -> dict[bytes, int]:
    counts: dict[bytes, int] = {}
    for word, n in Counter(found).items():
        if word in known:
            counts[word] = n
        if len(word) >= PREFIXES[0]:
            for size in PREFIXES:
                start = b"^" + word[:size]
                if start in known:
                    counts[start] = counts.get(start, 0) + n
    return counts


@dataclass(frozen=True)
class Model:
    """Weights by word and ordered thresholds; without thresholds everything has grade 0."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def grades(self, found: list[bytes]) -> np.ndarray:
        """Probability of every grade for the words of a text."""
        line = sum(self.weights[f] * np.log1p(n) for f, n in sorted(known_features(found, self.weights).items()))
        below = _sigmoid(np.array(self.thresholds) - line)
        return np.diff(np.concatenate(([0.0], below, [1.0])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that maximise the mean log-likelihood less the ridge."""
    n, k = len(grade), int(grade.max())
    upto = np.clip(np.array([(grade <= j).mean() for j in range(k)]), 1e-6, 1 - 1e-6)
    start = np.log(upto / (1 - upto))
    theta = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(x.shape[1])))
    rate = 1.0 / (0.25 * ((x * x).sum(axis=1).mean() + k + 1) + ridge)

    def unpack(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(np.concatenate((t[:1], np.exp(t[1:k])))), t[k:]

    def slope(t: np.ndarray) -> np.ndarray:
        cuts, w = unpack(t)
        line = x @ w
        upper = _sigmoid(np.append(cuts, np.inf)[grade] - line)
        lower = _sigmoid(np.concatenate(([-np.inf], cuts))[grade] - line)
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        by_cut = np.array([du[grade == j].sum() - dl[grade == j + 1].sum() for j in range(k)]) / n
        steps_in = np.exp(t[1:k]) * np.cumsum(by_cut[::-1])[::-1][1:]
        by_weight = (x * (dl - du)[:, None]).sum(axis=0) / n - ridge * w
        return np.concatenate(([by_cut.sum()], steps_in, by_weight))

    def height(t: np.ndarray) -> float:
        cuts, w = unpack(t)
        line = x @ w
        mass = _sigmoid(np.append(cuts, np.inf)[grade] - line) - _sigmoid(np.concatenate(([-np.inf], cuts))[grade] - line)
        return float(np.log(np.maximum(mass, 1e-12)).mean() - ridge / 2 * (w @ w))

    # limited-memory quasi-Newton steps with halving
    past: list[tuple[np.ndarray, np.ndarray]] = []
    now, up = height(theta), slope(theta)
    for _ in range(steps):
        way, used = up.copy(), []
        for s, y in reversed(past):
            used.append(share := (s @ way) / (s @ y))
            way -= share * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), share in zip(past, reversed(used), strict=True):
            way += (share - (y @ way) / (s @ y)) * s
        size = 1.0 if past else rate
        while (found := height(theta + size * way)) < now + 1e-4 * size * (up @ way) and size > 1e-10:
            size /= 2
        if found <= now + 1e-12:
            break
        before, theta, now = up, theta + size * way, found
        up = slope(theta)
        if (size * way) @ (before - up) > 1e-14:
            past = [*past[-9:], (size * way, before - up)]
    cuts, w = unpack(theta)
    return w, cuts


def _labelled(docs: DataFrame, labels: DataFrame, sample: int, label_col: str) -> DataFrame:
    """(doc_id, text, label) of at most `sample` labelled documents, picked by hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    picked = (
        known.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers
    return pin(narrow(docs).join(F.broadcast(picked), "doc_id"))


def _words_by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ((f, label) for text, label in rows_of(batches, "text", "label") for f in features(words(text)))
    return emitted("word binary, label int", found, size=20_000)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    features: int = FEATURES,
    label_col: str = "toxic",
    graded: bool = False,
) -> Model:
    """A model from at most `sample` labelled documents; only counts of at most `features` words come to the driver.

    With `graded` the labels are grades 0, 1, 2, .. already. Null labels and ids are left out, repeated ones count once with their
    highest label. Without toxic or without clean examples every document gets grade 0.
    """
    found = _labelled(docs, labels, sample, label_col)
    sides = {bool(r["t"]): r["n"] for r in found.groupBy((F.col("label") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sides.get(True, 0), sides.get(False, 0)
    if not toxic or not clean:
        return Model({}, ())
    counts = (
        found.mapInArrow(_words_by_label, "word binary, label int")
        .groupBy("word")
        .agg(F.sum((F.col("label") > 0).cast("long")).alias("t"), F.sum((F.col("label") <= 0).cast("long")).alias("c"))
        .where(f"t >= {MIN_DOCUMENTS}")
    )
    a, c = F.col("t") + 0.5, F.col("c") + 0.5
    b, d = F.lit(toxic) - F.col("t") + 0.5, F.lit(clean) - F.col("c") + 0.5
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    picked = counts.withColumn("z", z).where(f"z >= {MIN_Z}").orderBy(F.desc("z"), "word").limit(features).collect()
    vocabulary = {bytes(r["word"]): k for k, r in enumerate(picked)}
    if not vocabulary:
        return Model({}, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for text, label in rows_of(batches, "text", "label"):
                counts = sorted(known_features(words(text), vocabulary).items())
                yield label, [vocabulary[f] for f, _ in counts], [n for _, n in counts]

        return emitted("label int, features array<long>, counts array<long>", rows())

    rows = found.mapInArrow(run, "label int, features array<long>, counts array<long>").toArrow().to_pydict()
    x = np.zeros((len(rows["label"]), len(vocabulary)))
    for k, (at, n) in enumerate(zip(rows["features"], rows["counts"], strict=True)):
        x[k, at] = n
    grade = np.maximum(0, np.array(rows["label"], dtype=np.int64))
    if not graded:
        # markers: words that are far more usual in toxic documents; they tell the severe from the mild
        strong = [k for k, r in enumerate(picked) if (r["t"] + 0.5) * (clean + 1) >= 5 * (r["c"] + 0.5) * (toxic + 1)]
        amount = x[:, strong].sum(axis=1)
        grade = (grade > 0) * (1 + (amount > np.median(amount[grade > 0])))
    grade = np.unique(grade, return_inverse=True)[1]
    weights, thresholds = fit_ordinal(np.log1p(x), grade)
    return Model(dict(zip(vocabulary, weights.tolist(), strict=True)), tuple(thresholds.tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, rejected), one row per row of `docs`.

    A document is rejected when it is likelier to be toxic in some grade than not; its grade is then the likeliest one above 0,
    and 0 otherwise. Null text has no words and gets the
    severity of a text without markers. Null ids and repeated rows are scored like any other; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                p = model.grades(words(text))
                grade = 0 if p[0] >= 0.5 else 1 + int(np.argmax(p[1:]))
                yield doc_id, float(p @ np.arange(len(p))), grade, grade > 0

        return emitted(_SCORES, rows())

    return narrow(docs, id_col, text_col).mapInArrow(run, _SCORES)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text the model does not reject; null text is not rejected for its own sake."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                texts = ((t or "").encode() for t in batch.column(text_col).to_pylist())
                yield batch.filter(pa.array([bool(model.grades(words(t))[0] >= 0.5) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
