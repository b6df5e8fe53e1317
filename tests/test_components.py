"""Components that are kept up to date, and nodes with very many edges."""

import random

import pytest
from pyspark.sql import functions as F

from trafficloom.plans import components as module
from trafficloom.plans.components import ComponentStore, components
from trafficloom.plans.lookup import lookup

SCHEMA = "a long, b long, note string"


def plain(edges):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(label)}


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "x") for a, b in edges], SCHEMA).repartition(3)


def state(store):
    rows = store.labels().collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["component"] for r in rows}


@pytest.mark.parametrize("seed", [1])
def test_deliveries_give_what_one_run_gives(spark, tmp_path, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 430)] + [(600, 600 + k) for k in range(40)]
    rnd.shuffle(edges)
    edges += [(9, 9), (1000, 1000), edges[0], edges[1][::-1], (429, 3), (640, 3)]
    store, seen = ComponentStore(spark, f"{tmp_path}/store"), []
    assert store.last() is None and state(store) == {}
    cuts = [0, 41, 150, len(edges) - 2, len(edges)]
    for number, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        seen += edges[start:end]
        delivery = frame(spark, [*edges[start:end], (None, 7), (7, None)])
        store.add(delivery, "a", "b", number)
        assert store.last() == number and state(store) == plain(seen)
    store.add(frame(spark, [(10_000, 10_001)]), "a", "b", 2)  # came before
    store.add(frame(spark, []), "a", "b", 9)
    assert store.last() == 9 and state(store) == plain(seen) == state(ComponentStore(spark, f"{tmp_path}/store/"))
    found = components(frame(spark, edges), "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {k: v for k, v in plain(edges).items() if k != 1000}


def test_a_failed_delivery_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    store = ComponentStore(spark, str(tmp_path / "s"))
    store.add(frame(spark, [(1, 2), (3, 4)]), "a", "b", 0)
    broken = ComponentStore(spark, str(tmp_path / "s"))
    monkeypatch.setattr(broken, "spark", None)  # fails when the number is to be written
    monkeypatch.setattr(broken, "_read", store._read)
    monkeypatch.setattr(broken, "_nodes", store._nodes)
    monkeypatch.setattr(broken, "_merged", store._merged)
    with pytest.raises(AttributeError):
        broken.add(frame(spark, [(2, 3), (5, 6)]), "a", "b", 1)
    assert store.last() == 0 and state(store) == plain([(1, 2), (3, 4)])
    store.add(frame(spark, [(2, 3)]), "a", "b", 1)
    assert state(store) == plain([(1, 2), (3, 4), (2, 3)])


def test_a_delivery_only_meets_the_components_it_touches(spark, tmp_path, monkeypatch):
    store = ComponentStore(spark, str(tmp_path))
    store.add(frame(spark, [(10 * k, 10 * k + i) for k in range(50) for i in range(10)]), "a", "b", 0)
    asked, real = [], module.components
    monkeypatch.setattr(module, "components", lambda e, a, b: asked.append(sorted(tuple(r) for r in e.collect())) or real(e, a, b))
    store.add(frame(spark, [(13, 27), (29, 14), (495, 1), (7777, 8888)]), "a", "b", 1)
    assert asked == [[(10, 20), (20, 10), (490, 0), (7777, 8888)]]
    found = state(store)
    assert found[25] == 10 and found[499] == 0 and found[8888] == 7777 and found[35] == 30
    assert spark.read.parquet(f"{tmp_path}/nodes/number=1").count() == 2


@pytest.fixture
def fixed_plans(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hub_is_spread_over_tasks(spark, fixed_plans, monkeypatch):
    """One node with 10^5 edges; neither skew handling nor small tables come to help."""
    n = 100_000
    hub = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id") + 5).otherwise(4).alias("a"), F.when(F.col("id") % 2 == 0, 4).otherwise(F.col("id") + 5).alias("b"))
    more = spark.range(50).select((F.col("id") + 500_000).alias("a"), (F.col("id") + 500_001).alias("b"))
    shares = []

    def watched(rows, table, key, weight, by, how="inner", total=None):
        found = lookup(rows, table, key, weight, by, how, total)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        shares.append((max(sizes, default=0), sum(sizes)))
        return found

    monkeypatch.setattr(module, "lookup", watched)
    found = components(hub.unionByName(more), "a", "b")
    heads = {r["component"]: r["count"] for r in found.groupBy("component").count().collect()}
    assert heads == {4: n + 1, 500_000: 51}
    large = [(most, every) for most, every in shares if every > n // 2]
    assert large and all(most <= every / 4 for most, every in large)
