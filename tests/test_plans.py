"""Ordered and balanced building blocks against plain Python, with pieces far smaller than the data."""

import random

from pyspark.sql import functions as F

from trafficloom.plans.balanced import balanced_join, during, within_reach
from trafficloom.plans.ordered import block_scan, exact_median, positions, running_totals, with_runs
from trafficloom.plans.sieve import sieved

SEED = 7


def test_block_scan_carries_over_blocks(spark):
    rng = random.Random(SEED)
    places = sorted(rng.sample(range(200), 60))
    values = {p: (rng.randint(0, 5) if rng.random() < 0.6 else None) for p in places}
    df = spark.createDataFrame([("s", p, values[p]) for p in places], "key string, at long, v long")
    scanned = block_scan(
        df,
        ["key"],
        "at",
        sums={"total": F.lit(1).cast("long")},
        lags={"before": F.col("at")},
        lasts={"last": F.col("v")},
        nexts={"next": F.col("v")},
        block=8,
    )
    found = {r["at"]: r for r in scanned.collect()}
    for i, p in enumerate(places):
        row = found[p]
        assert row["total"] == i + 1
        assert row["before"] == (places[i - 1] if i else None)
        assert row["last"] == next((values[q] for q in reversed(places[: i + 1]) if values[q] is not None), None)
        assert row["next"] == next((values[q] for q in places[i:] if values[q] is not None), None)


def test_runs_use_the_row_before_not_its_presence(spark):
    df = spark.createDataFrame([("s", f) for f in (0, 3, 5, 10, 15, 30)], "key string, frame long")
    rows = with_runs(df, ["key"], "frame", stride=5, block=4).orderBy("frame").collect()
    assert [r["run_index"] for r in rows] == [0, 1, 2, 2, 2, 3]
    assert [r["run_position"] for r in rows] == [0, 0, 0, 1, 2, 0]


def test_running_totals_and_positions_over_many_pieces(spark):
    rng = random.Random(SEED)
    rows = [("hot" if rng.random() < 0.7 else "cold", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, score double, id long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = running_totals(df, ["key"], [F.col("score").desc(), F.col("id")], {"n": F.lit(1).cast("long")})
        got = {r["id"]: r["n"] for r in ranked.collect()}
        placed = {r["id"]: r["p"] for r in positions(df, [F.col("score"), F.col("id")], "p").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for key in ("hot", "cold"):
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert all(got[r[2]] == i + 1 for i, r in enumerate(order))
    for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2]))):
        assert placed[r[2]] == i


def test_exact_median(spark):
    data = {"a": [5, 1, 9, 9], "b": [4, 4, 1], "c": [2]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "key string, v long")
    assert {r["key"]: r["median"] for r in exact_median(df, ["key"], "v").collect()} == {"a": 7.0, "b": 4.0, "c": 2.0}


def test_balanced_join_meets_every_pair_once_on_a_hot_key(spark):
    left = spark.createDataFrame([(0 if i < 90 else i % 5, i) for i in range(130)], "key long, a long")
    right = spark.createDataFrame([(0 if i < 70 else i % 5, i) for i in range(110)], "key long, b long")
    got = sorted((r["a"], r["b"]) for r in balanced_join(left, right, ["key"], ["a"], ["b"], chunk=16).collect())
    expected = sorted((r["a"], r["b"]) for r in left.join(right, "key").collect())
    assert got == expected


def test_within_reach_equals_all_pairs(spark):
    rng = random.Random(SEED)
    points = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(120)] + [(200, 0.0, 0.0), (201, 3.0, 4.0)]
    a = spark.createDataFrame([(1, *p) for p in points], "s long, a long, ax double, ay double")
    b = spark.createDataFrame([(1, *p) for p in points], "s long, b long, bx double, by double")
    near = within_reach(a, b, ["s"], ("ax", "ay"), ("bx", "by"), 5.0, ["a"], ["b"], chunk=8)
    got = {(r["a"], r["b"]) for r in near.collect()}
    expected = {
        (p[0], q[0]) for p in points for q in points if ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 <= 5.0
    }
    assert got == expected and (200, 201) in got
    assert near.count() == len(expected)


def test_within_reach_on_crowded_and_sparse_keys(spark):
    rng = random.Random(SEED)
    points = [(0, i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(60)]
    points += [(1 + i % 20, 100 + i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)]
    a = spark.createDataFrame(points, "s long, a long, ax double, ay double")
    b = spark.createDataFrame(points, "s long, b long, bx double, by double")
    near = within_reach(a, b, ["s"], ("ax", "ay"), ("bx", "by"), 5.0, ["a"], ["b"], chunk=8, crowd=16)
    expected = sorted(
        (p[1], q[1]) for p in points for q in points if p[0] == q[0] and ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5 <= 5.0
    )
    assert sorted((r["a"], r["b"]) for r in near.collect()) == expected


def test_sparse_keys_are_not_repeated_over_cells(spark):
    points = [(i // 4, i, float(i % 4), 0.0) for i in range(200)]
    a = spark.createDataFrame(points, "s long, a long, ax double, ay double")
    b = spark.createDataFrame(points, "s long, b long, bx double, by double")
    near = within_reach(a, b, ["s"], ("ax", "ay"), ("bx", "by"), 5.0, ["a"], ["b"])
    assert near.count() == 800
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()


def test_during_equals_all_intervals(spark):
    rng = random.Random(SEED)
    spans = [(i, s, s + rng.randint(-3, 150)) for i, s in enumerate(rng.choices(range(200), k=40))]
    frames = spark.createDataFrame([("q", f) for f in range(0, 300, 3)], "k string, frame long")
    boxes = spark.createDataFrame([("q", *s) for s in spans], "k string, id long, lo long, hi long")
    met = during(frames, boxes, ["k"], "frame", "lo", "hi", ["frame"], ["id"], width=16, chunk=8).collect()
    expected = sorted((f, i) for i, lo, hi in spans for f in range(0, 300, 3) if lo <= f <= hi)
    assert sorted((r["frame"], r["id"]) for r in met) == expected


def test_shared_observations_are_read_without_another_shuffle(spark):
    from trafficloom.workload import tables

    sf = "/root/testdata/sf0.001"
    shared = tables.shared_observations(spark, sf)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan
    assert sorted(map(str, shared.collect())) == sorted(map(str, tables.observations(spark, sf).collect()))


def test_sieved_rows_keep_every_partner(spark):
    rows = spark.range(20000).selectExpr("nullif(id, 3) AS k", "id")
    keys = rows.where("id % 100 = 3").select("k")
    may, none = sieved(rows, keys, "k")
    may, none = ({r["id"] for r in part.collect()} for part in (may, none))
    wanted = {r["id"] for r in rows.where("id % 100 = 3").collect()}
    assert wanted <= may and len(may) + len(none) == 20000 and not may & none
    assert len(may) < len(wanted) + 20000 // 40
    may, none = sieved(rows, keys.where("false"), "k")
    assert may.count() == 0 and none.count() == 20000
