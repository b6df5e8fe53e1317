"""Average precision of overlapping slices from one sort, against plain lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trafficloom.operators import evaluation, quality
from trafficloom.plans.ordered import PIECE, range_pieces

BINS = ["perfect_5", "good_4", "missing"]
SCHEMA = "set string, predicate string, relation_id long, score double, target long, sequence long, available boolean, quality_bin string"


def rows(seed, n=900):
    rnd = random.Random(seed)
    return [
        (
            rnd.choice(["a", "b", None]),
            rnd.choice(["near", "far", "rare"]),
            i,
            rnd.choice([0.1, 0.5, 0.5, 0.9, rnd.random(), float("nan"), float("inf")]),
            int(rnd.random() < 0.3),
            rnd.choice([1, 2, None, *range(20, 60)]),
            rnd.random() < 0.7,
            rnd.choice(BINS),
        )
        for i in rnd.sample(range(-n, n), n)
    ]


def plain(data):
    groups = {}
    for s, p, i, score, t, seq, available, b in data:
        own = None if seq is None else str(seq)
        slices = [(quality.ALL, quality.OVERALL), (quality.ALL, b), (own, quality.OVERALL), (own, b)] + [(quality.ALL, quality.AVAILABLE)] * available
        for slice_ in slices:
            groups.setdefault((s, p, slice_), []).append((not math.isnan(score), 0.0 if math.isnan(score) else -score, i, t))
    out = {}
    for key, found in groups.items():
        hits, total = 0, 0.0
        for rank, (*_, t) in enumerate(sorted(found), 1):
            hits += t
            total += t * hits / rank
        out[key] = total / hits if hits else None
    return out


@pytest.mark.parametrize(("seed", "pieces"), [(1, 1), (2, 7), (3, 40)])
def test_slices(spark, monkeypatch, seed, pieces):
    data = rows(seed)
    if pieces > 1:
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", pieces)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, SCHEMA).repartition(5)
        found = evaluation.sliced_average_precision(df, ["set", "predicate"], quality.slices()).collect()
    finally:
        if pieces > 1:
            for k, v in before.items():
                spark.conf.set(k, v)
    got = {(r["set"], r["predicate"], tuple(r["slice"])): r["average_precision"] for r in found}
    want = plain(data)
    assert set(got) == set(want) and len(found) == len(got)
    for key, value in want.items():
        assert got[key] is None if value is None else got[key] == pytest.approx(value, rel=1e-12), key


def test_one_slice_is_the_plain_average_precision(spark):
    data = [(s or "c", *rest) for s, *rest in rows(4)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = F.struct(F.lit("x").alias("slice_sequence"), F.lit("y").alias("stratum"))
    one = evaluation.sliced_average_precision(df, ["set", "predicate"], [whole])
    other = evaluation.average_precision(df, ["set"])
    a = {(r["set"], r["predicate"]): r["average_precision"] for r in one.collect()}
    b = {(r["set"], r["predicate"]): r["average_precision"] for r in other.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)
    assert evaluation.sliced_average_precision(df.where("false"), ["set"], [whole]).count() == 0


@pytest.mark.parametrize("limit", [1000, 5])
def test_recall_of_first_ranks_in_one_step_and_in_two(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluation, "RANK_LIMIT", limit)
    rnd = random.Random(11)
    data = [(i, f"g{rnd.randrange(3)}", rnd.random() < 0.9, [rnd.choice([-1.0, 0.0, 2.0, rnd.random()]) for _ in range(2)], [int(rnd.random() < 0.4) for _ in range(2)]) for i in range(200)]
    df = spark.createDataFrame(data, "relation_id long, group_id string, available boolean, logits array<double>, targets array<int>")
    found = {(r["k"], r["name"]): r["recall"] for r in evaluation.recall_at_k(df, ["near", "far"], (3, 20)).collect()}
    support = [sum(t[p] for *_, t in data) for p in (0, 1)]
    for k in (3, 20):
        hits = [0, 0]
        for group in {g for _, g, *_ in data}:
            ranked = sorted((-score, i, p, t[p]) for i, g, a, logits, t in data if g == group and a for p, score in enumerate(logits))
            for _, _, p, t in ranked[:k]:
                hits[p] += t
        assert found[k, "R"] == pytest.approx(sum(hits) / sum(support))
        assert [found[k, n] for n in ("near", "far")] == pytest.approx([h / s for h, s in zip(hits, support, strict=True)])


def test_pieces_are_bounded_and_give_the_same(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    by = ["set", "predicate"]

    def told(**more):
        found = evaluation.sliced_average_precision(df, by, quality.slices(), **more).collect()
        return {(r["set"], r["predicate"], r["slice"]): r["average_precision"] for r in found}

    assert told(piece_rows=40) == pytest.approx(told(), nan_ok=True)
    cut = range_pieces(df, [F.col("score").desc(), F.col("relation_id").asc()], 40)
    sizes = [r["count"] for r in cut.groupBy(PIECE).count().collect()]
    assert sum(sizes) == 900 and len(sizes) > 15 and max(sizes) < 120
