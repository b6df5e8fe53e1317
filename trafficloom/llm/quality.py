"""Document quality by supervised subword embeddings.

A text is a bag of its words, of the character n-grams of every word, and of marks that say how far back a repeated word
stood last. All of them are hashed into rows of one table of learned vectors. A word is the mean of its rows, a text the mean of its
words and marks, and a softmax over two classes reads it. Table and softmax are trained together by stochastic gradient descent
with steps per row (Adagrad).

The output is linear in the mean, so for scoring the table shrinks to one number per row, and texts are scored many at a time:
every distinct word of a piece of a batch is hashed once, in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.texts import emitted, rows_of
from trafficloom.plans.pinning import pin

SAMPLE = 4000
BUCKETS = 1 << 16
WIDTH = 8
EPOCHS = 5
BATCH = 32
RATE = 0.1
GRAMS = (3, 4)
NEAR = 8
THRESHOLD = 0.7
PIECE = 8 << 20
_BASE = 0x01000193
_SAMPLE = "label int, words string, counts array<long>"
_SCORES = "doc_id long, score double, predicted int"


def bag(text: str) -> Counter[str]:
    """Counts of the words, and of `=k` for every word that last stood k words back (k up to NEAR).

    A mark is told from a word by the blank in front of it.
    """
    found = text.split()
    counts = Counter(found)
    if len(counts) < len(found):
        last: dict[str, int] = {}
        near = [0] * (NEAR + 1)
        for i, word in enumerate(found):
            back = i - last.get(word, -NEAR - 1)
            if back <= NEAR:
                near[back] += 1
            last[word] = i
        counts.update({f" ={k}": n for k, n in enumerate(near) if n})
    return counts


def hashed(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, word of each row): the table rows of every word as a whole and of its n-grams; a mark has one row.

    Words stand framed, one after the other, as code points; the sums over all windows of one size are three or four
    products of shifted arrays, whatever the number of words.
    """
    framed = [w if w[0] == " " else f"<{w}>" for w in words]
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    sizes = np.array([len(w) for w in framed], dtype=np.int64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(points)) - np.repeat(ends - sizes, sizes)
    powers = np.cumprod(np.full(max(int(sizes.max(initial=0)), max(GRAMS)), _BASE, dtype=np.uint32), dtype=np.uint32)
    found = [_mixed(np.add.reduceat(points * powers[inside], ends - sizes, dtype=np.uint32), 0)] if words else []
    owners = [np.arange(len(words))]
    split = np.array([w[0] != " " for w in framed], dtype=bool)[word]
    for n in GRAMS:
        at = np.flatnonzero(split & (inside + n <= sizes[word]))
        total = np.zeros(len(at), dtype=np.uint32)
        for k in range(n):
            total += points[at + k] * powers[k]
        found.append(_mixed(total, n))
        owners.append(word[at])
    rows = np.concatenate(found) if words else np.zeros(0, dtype=np.uint32)
    return (rows % np.uint32(buckets)).astype(np.int64), np.concatenate(owners)


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    """Well-mixed 32-bit numbers; windows of different sizes don't share rows on purpose."""
    x = x + np.uint32(kind * 0x9E3779B9 & 0xFFFFFFFF)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


@dataclass(frozen=True)
class Model:
    """What each row of the table adds to the log-odds of good quality, and the log-odds of a text without any."""

    gains: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        """The mean gain of every word's rows."""
        rows, word = hashed(words, len(self.gains))
        return np.bincount(word, self.gains[rows], len(words)) / np.bincount(word, minlength=len(words))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts: words are numbered by Arrow, every distinct one is looked up once for all texts."""
        split = pc.utf8_split_whitespace(texts)
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        word = coded.indices.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(texts)), counts)
        if "" in names:  # the end of a text in white space
            whole = word != names.index("")
            word, text = word[whole], text[whole]
        known = [n for n in names if n]
        gains = np.zeros(len(names))
        gains[[k for k, n in enumerate(names) if n]] = self.of_words(known)
        total = np.bincount(text, gains[word], len(texts)).astype(float)
        size = np.bincount(text, minlength=len(texts))
        marks = self.of_words([f" ={k}" for k in range(1, NEAR + 1)])
        met = np.zeros(len(word), dtype=bool)
        for k in range(1, NEAR + 1):
            again = (word[k:] == word[:-k]) & (text[k:] == text[:-k]) & ~met[k:]
            met[k:] |= again
            n = np.bincount(text[k:][again], minlength=len(texts))
            total += n * marks[k - 1]
            size += n
        # a text without words is left with the bias
        return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(size, 1) + self.bias, -700, 700)))


def train(
    bags: list[Counter[str]],
    good: np.ndarray,
    buckets: int = BUCKETS,
    width: int = WIDTH,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    rate: float = RATE,
    seed: int = 42,
) -> Model:
    """A model from bags, none empty, and their classes (0 or 1); the same input in the same order gives the same model."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    doc_at = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    word = np.fromiter((number.setdefault(w, len(number)) for b in bags for w in b), dtype=np.int32, count=doc_at[-1])
    count = np.fromiter((n for b in bags for n in b.values()), dtype=np.int64, count=doc_at[-1])
    row, owner = hashed(list(number), buckets)
    row = row[np.argsort(owner, kind="stable")].astype(np.int32)
    sizes = np.bincount(owner, minlength=len(number))
    word_at = np.concatenate(([0], np.cumsum(sizes)))
    norm = np.add.reduceat(count, doc_at[:-1])

    # rows that no example has stay at zero and say nothing
    table = np.zeros((buckets, width))
    out, bias = rng.uniform(-1.0, 1.0, (2, width)), np.zeros(2)
    seen, seen_out, seen_bias = np.full(buckets, 1e-12), 1e-12, 1e-12

    def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Positions of the runs that begin at `starts`."""
        first = np.cumsum(lengths) - lengths
        return np.arange(lengths.sum()) + np.repeat(starts - first, lengths)

    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            lengths = doc_at[docs + 1] - doc_at[docs]
            at = spread(doc_at[docs], lengths)
            words, inverse = np.unique(word[at], return_inverse=True)
            share = count[at] / np.repeat(norm[docs], lengths)
            rows = row[spread(word_at[words], sizes[words])]
            parts = np.cumsum(sizes[words]) - sizes[words]
            vectors = np.add.reduceat(table[rows], parts) / sizes[words][:, None]
            mean = np.add.reduceat(vectors[inverse] * share[:, None], np.cumsum(lengths) - lengths)

            line = mean @ out.T + bias
            p = np.exp(line - line.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), good[docs]] -= 1.0
            p /= len(docs)
            slope_out, slope_bias, slope_mean = p.T @ mean, p.sum(axis=0), p @ out

            slope = np.repeat(slope_mean, lengths, axis=0) * share[:, None]
            by_word = np.stack([np.bincount(inverse, slope[:, j], len(words)) for j in range(width)], axis=1)
            unique, place = np.unique(rows, return_inverse=True)
            by_row = np.repeat(by_word / sizes[words][:, None], sizes[words], axis=0)
            step = np.stack([np.bincount(place, by_row[:, j], len(unique)) for j in range(width)], axis=1)
            seen[unique] += (step * step).mean(axis=1)
            table[unique] -= rate * step / np.sqrt(seen[unique])[:, None]
            seen_out += float((slope_out**2).mean())
            seen_bias += float((slope_bias**2).mean())
            out -= rate * slope_out / np.sqrt(seen_out)
            bias -= rate * slope_bias / np.sqrt(seen_bias)
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for label, text in rows_of(batches, "label", "text"):
            counts = bag(text or "")
            # no word holds a new line
            yield label, "\n".join(counts), list(counts.values())

    return emitted(_SAMPLE, rows())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, label_col: str = "quality") -> Model:
    """A model from at most `sample` labelled documents, those with the least hashes of their ids.

    `learn` says of a row of `labels` whether it may be used; null is no. Null ids and labels are left out, an id that is repeated in
    `labels` counts once with its highest label, a label above 0 is good. Of a repeated document every row is used.
    Texts without words teach nothing. With examples of one class only, or none, every text gets the score 0.5.
    """
    picked = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max(F.col(label_col)) > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # the list has at most `sample` rows of two numbers; ids that documents repeat may still make the sample longer
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = pin(told.join(F.broadcast(picked), "doc_id"))
    ordered = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(sample)
    rows = ordered.select("label", "text").mapInArrow(_bags, _SAMPLE).toArrow().to_pydict()
    filled = [k for k, counts in enumerate(rows["counts"]) if counts]
    good = np.array([rows["label"][k] for k in filled], dtype=np.int64)
    if not filled or good.min() == good.max():
        return Model(np.zeros(1), 0.0)
    bags = [Counter(dict(zip(rows["words"][k].split("\n"), rows["counts"][k], strict=True))) for k in filled]
    return train(bags, good)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of bounded bytes, or of one text."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + PIECE, side="right")))
            yield batch.column("doc_id").slice(first, last - first), texts.slice(first, last - first)
            first = last


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row per row of `docs`: the probability of good quality, and whether it reaches `threshold`.

    Only the text counts. Null text is empty; a text without words gets what the bias alone says, about 0.5. Null ids and repeated rows are
    scored like any other; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            found = model.scores(texts)
            columns = [ids, pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return told.mapInArrow(run, _SCORES)
