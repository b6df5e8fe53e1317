"""The classifier: bags, one training step by hand, held-out accuracy, odd input."""

import math
import os
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trafficloom.llm import quality

GIVEN = Path(os.environ.get("LABELLED_SF_DIR", "/root/testdata/sf0.1"))
SCHEMA = "doc_id long, text string, label string, score int"


def test_bag():
    assert quality.bag("") == Counter() and quality.bag(" \n") == Counter()
    assert quality.bag("a b a a") == Counter({"a": 3, "b": 1, " =2": 1, " =1": 1})
    far = " ".join(["a", *[f"w{k}" for k in range(quality.NEAR)], "a"])
    assert not any(w.startswith(" ") for w in quality.bag(far))


def plain_rows(word, buckets):
    """Table rows of a word, one window at a time."""
    if word[0] == " ":
        grams, framed = [(0, word)], word
    else:
        framed = f"<{word}>"
        grams = [(0, framed)] + [(n, framed[i : i + n]) for n in quality.GRAMS for i in range(len(framed) - n + 1)]
    out = []
    for kind, gram in grams:
        x = sum(ord(c) * pow(quality._BASE, k + 1, 1 << 32) for k, c in enumerate(gram)) + kind * 0x9E3779B9
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            x = ((x % (1 << 32)) ^ (x % (1 << 32) >> shift)) * factor
        x %= 1 << 32
        out.append((x ^ (x >> 16)) % buckets)
    return out


def test_rows():
    words = ["a", "ab", "the", " =3", "naïve", "🙂🙂", "x" * 3000, "z"]
    rows, owner = quality.hashed(words, 1 << 16)
    for k, w in enumerate(words):
        assert sorted(rows[owner == k].tolist()) == sorted(plain_rows(w, 1 << 16))
    assert [len(x) for x in quality.hashed([], 8)] == [0, 0]


def plain_score(model, text):
    words = quality.bag(text)
    if not words:
        return 1 / (1 + math.exp(-model.bias))
    mean = sum(n * np.mean([model.gains[r] for r in plain_rows(w, len(model.gains))]) for w, n in words.items()) / sum(words.values())
    return 1 / (1 + math.exp(-mean - model.bias))


def test_score_is_the_softmax_of_the_mean():
    bags = [quality.bag(t) for t in ("good fine good", "bad bad", "fine words", "poor bad")]
    model = quality.train(bags, np.array([1, 0, 1, 0]), buckets=512, epochs=3, batch=2)
    texts = ["good bad other good", "", " a  a\n", "\tone", "one ", "a b a b a c c c", " \n ", "a", "x" * 2000, "é é\u2003🙂 é"]
    for k in (1, 3, len(texts)):
        found = np.concatenate([model.scores(pa.array(texts[i : i + k])) for i in range(0, len(texts), k)])
        assert np.allclose(found, [plain_score(model, t) for t in texts], rtol=1e-12)
    assert (model.scores(pa.array(texts)) == found).all() and len(model.scores(pa.array([], pa.string()))) == 0
    again = quality.train(bags, np.array([1, 0, 1, 0]), buckets=512, epochs=3, batch=2)
    assert (again.gains == model.gains).all() and again.bias == model.bias


def test_one_step_by_hand():
    """One example, one step: Adagrad's first step is the rate times the slope over its root mean square."""
    bags, buckets, width = [Counter({" x": 2, " y": 1})], 64, 4
    model = quality.train(bags, np.array([1]), buckets=buckets, width=width, epochs=1, rate=0.1, seed=7)
    out = np.random.default_rng(7).uniform(-1, 1, (2, width))
    slope = (np.array([0.5, -0.5]) @ out)[None, :] * np.array([[2 / 3], [1 / 3]])
    step = 0.1 * slope / np.sqrt((slope**2).mean(axis=1, keepdims=True))
    rows = [plain_rows(" x", buckets)[0], plain_rows(" y", buckets)[0]]
    table = np.zeros((buckets, width))
    table[rows] -= step
    assert np.allclose(model.gains, table @ (out[1] - out[0]), atol=1e-6)  # the mean was zero, so `out` stayed
    assert math.isclose(model.bias, 0.2, rel_tol=1e-6)


def rows(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]
    out, labels = [], []
    for i in range(n):
        picked = rnd.choices(words, k=rnd.randint(20, 80))
        kind = i % 6
        if kind == 0:
            picked = [w + "%%%" for w in picked]
        elif kind == 1:
            picked = [picked[0]] * 60
        out.append((i, " ".join(picked), "clash", 9))
        labels.append((i, int(kind > 1), 0))
    return out, labels


def test_scores(spark):
    docs, labels = rows(400, 1)
    more = [(1000, None, None, 1), (1001, "", None, 1), (None, "abc%%% de%%%", None, 1), (1003, "calm words " * 50_000, None, 1), (1004, "x" * 300_000, None, 1)]
    df = spark.createDataFrame([*docs, *more, docs[1]], SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, labels[3], (None, 1, 0), (5000, 1, 0), (7, None, 0), (1000, 1, 0)], "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") % 4 != 2
    model = quality.fit(df, known, learn)
    out = quality.score(df, model)
    assert out.columns == ["doc_id", "score", "predicted"]
    told = out.collect()
    assert len(told) == 406 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in told)
    held = [r for r in told if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 2]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 > 1) for r in held]) >= 0.97
    by = {r["doc_id"]: r["score"] for r in told}
    assert by[1000] == by[1001] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    # what is held out teaches nothing
    turned = known.withColumn("quality", F.when(F.col("doc_id") % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.fit(df.repartition(5), turned, learn)
    assert (other.gains == model.gains).all() and other.bias == model.bias


def test_without_examples(spark):
    df = spark.createDataFrame(rows(12, 2)[0], SCHEMA)
    none = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(df, none, F.lit(True))
    assert {(r["score"], r["predicted"]) for r in quality.score(df, model).collect()} == {(0.5, 0)}
    assert quality.score(df.where("false"), model).count() == 0


@pytest.mark.skipif(not GIVEN.exists(), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    told = quality.score(docs, quality.fit(docs, labels, fold != 2)).join(labels.where(fold == 2), "doc_id").collect()
    good = [r["predicted"] for r in told if r["quality"]]
    bad = [r["predicted"] for r in told if not r["quality"]]
    assert len(good) > 500 and np.mean(good) >= 0.99 and np.mean(bad) <= 0.05
