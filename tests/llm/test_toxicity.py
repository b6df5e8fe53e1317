"""Ordinal regression: the fit, held-out accuracy, odd input."""

import math
import os
from pathlib import Path

import numpy as np
import pytest

from trafficloom.llm import toxicity

GIVEN = Path(os.environ.get("LABELLED_SF_DIR", "/root/testdata/sf0.1"))
SCHEMA = "doc_id long, text string, grade string, word int"


def test_fit_finds_the_maximum():
    rng = np.random.default_rng(1)
    x = rng.poisson(0.5, size=(4000, 4)).astype(float)
    line = x @ np.array([2.0, 1.0, 0.0, -1.0]) + rng.logistic(size=4000)
    grade = np.digitize(line, [0.5, 2.5])
    w, cuts = toxicity.fit_ordinal(x, grade)
    assert np.allclose(w, [2, 1, 0, -1], atol=0.2) and np.allclose(cuts, [0.5, 2.5], atol=0.2)
    assert cuts[0] < cuts[1]


def rows(n):
    bad = ["awful", "vile", "nasty"]
    out, labels = [], []
    for i in range(n):
        t = f"plain words number{i % 7} stand here"
        level = i % 4 if i % 2 else 0
        t += "".join(f" {bad[(i + k) % 3]}" for k in range(2 * level))
        out.append((i, t, "clash", 1))
        labels.append((i, int(level > 0), 0))
    return out, labels


def test_scores(spark):
    docs, labels = rows(240)
    more = [(1000, None, None, 1), (1001, "", None, 1), (None, "vile awful nasty", None, 1), (1002, "vile awful " * 3, None, 1), (1003, "calm " * 50_000, None, 1)]
    df = spark.createDataFrame([*docs, *more, docs[1]], SCHEMA)
    known = spark.createDataFrame([*labels, labels[3], (None, 1, 0), (5000, 1, 0), (7, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, known)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    out = toxicity.score(df, model).collect()
    assert len(out) == 246
    for r in out:
        i = r["doc_id"]
        assert r["rejected"] == (i in (None, 1002) or (i < 1000 and i % 2 == 1)), r
        assert 0.0 <= r["expected_severity"] <= 2.0
    severity = {r["doc_id"]: r["expected_severity"] for r in out}
    assert severity[1000] == severity[1001] < severity[1] < severity[3]
    kept = toxicity.without_toxic(df, model)
    assert kept.schema == df.schema and kept.count() == sum(not r["rejected"] for r in out)


def test_severity_and_grade_by_hand(spark):
    """Probabilities from the model's own weights and thresholds, counts from the words one by one."""
    model = toxicity.Model({b"vile": 1.5, b"^awfull": 0.7, b"awfully": 0.4, b"calm": -1.0}, (1.0, 4.0))
    texts = ["", None, "vile", "vile vile VILE", "awfully awfulness awfully", "calm vile", "vile awfully " * 30, "calm " * 9, "vile vile awfully"]
    told = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    grades = set()
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        counts = {b"vile": words.count("vile"), b"awfully": words.count("awfully"), b"calm": words.count("calm")}
        counts[b"^awfull"] = sum(len(w) >= 6 and w[:6] == "awfull" for w in words)
        line = sum(model.weights[f] * math.log1p(n) for f, n in counts.items())
        cut = [1 / (1 + math.exp(line - c)) for c in (1.0, 4.0)]
        p = [cut[0], cut[1] - cut[0], 1 - cut[1]]
        assert told[i]["expected_severity"] == pytest.approx(p[1] + 2 * p[2])
        assert told[i]["rejected"] == (p[0] < 0.5) == (told[i]["grade"] > 0)
        if p[0] < 0.5:
            assert told[i]["grade"] == (1 if p[1] >= p[2] else 2)
        grades.add(told[i]["grade"])
    assert grades == {0, 1, 2}


def test_without_examples(spark):
    df = spark.createDataFrame(rows(20)[0], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, none)
    assert {(r["grade"], r["rejected"]) for r in toxicity.score(df, model).collect()} == {(0, False)}
    assert toxicity.score(df.where("false"), model).count() == 0


@pytest.mark.skipif(not GIVEN.exists(), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 3 > 0"))
    told = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r["rejected"] for r in told if not r["toxic"]]
    toxic = [r["rejected"] for r in told if r["toxic"]]
    assert np.mean(clean) <= 0.01 and np.mean(toxic) >= 0.85
