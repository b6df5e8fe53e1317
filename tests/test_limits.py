"""What former caps, switches and silent drops would have got wrong."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from trafficloom.operators import matching, observations, recovery, review, timeline
from trafficloom.params import CHANNELS
from trafficloom.plans.components import components
from trafficloom.plans.lookup import lookup
from trafficloom.plans.ordered import block_scan
from trafficloom.sources import readers


def test_a_ring_of_links_is_one_track(spark):
    rows = spark.createDataFrame([(i, True) for i in range(4)], "row long, eligible boolean")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "source long, target long")
    assert {r["row"]: r["track_id"] for r in matching.components(rows, links).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(150)] + [(1000, 2000 + i) for i in range(40)] + [(5000, 5000), (None, 7)]
    rnd = random.Random(1)
    df = spark.createDataFrame([e if rnd.random() < 0.5 else e[::-1] for e in edges], "a long, b long")
    found = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(151), 0), 1000: 1000, **dict.fromkeys(range(2000, 2040), 1000)}


PAIRS = "sequence long, group long, source long, target long, margin double, score double"


def plain_greedy(pairs):
    out, used = set(), set()
    for s, g, a, b, margin, score in sorted(pairs, key=lambda p: (-p[4], -p[5], p[2], p[3])):
        if not {(s, g, 0, a), (s, g, 1, b)} & used:
            used |= {(s, g, 0, a), (s, g, 1, b)}
            out.add((s, g, a, b))
    return out


def links_of(df):
    rows = df.collect()
    found = {(r["sequence"], r["group"], r["source"], r["target"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("task_pairs", [1, 3, 20, 1 << 20])
def test_greedy_choice_is_the_same_in_tasks_components_and_rounds(spark, task_pairs):
    rnd = random.Random(task_pairs)
    pairs = [(0, 0, i, i + d, 1.0 - 0.01 * (2 * i + d), 0.0) for i in range(8) for d in (0, 1)]
    for group in range(1, 7):
        ends = [(a, b) for a in range(group * 2) for b in range(group * 2) if rnd.random() < 1.5 / group]
        pairs += [(1, group, a, b, rnd.choice([0.1, 0.2, 0.3]), rnd.choice([1.0, 2.0])) for a, b in ends]
    df = spark.createDataFrame(pairs, PAIRS).repartition(3)
    found = recovery.greedy_links(df, task_pairs=task_pairs)
    assert found.columns == df.columns and links_of(found) == plain_greedy(pairs)
    assert recovery.greedy_links(df.where("false"), task_pairs=task_pairs).count() == 0


def test_a_long_chain_takes_a_fixed_number_of_jobs(spark):
    """Margins that fall along a chain, so that every choice depends on the one before."""

    def jobs(n):
        pairs = [(0, 0, i, i + d, -0.001 * (2 * i + d), 0.0) for i in range(n) for d in (0, 1)]
        df = spark.createDataFrame(pairs, PAIRS)
        spark.sparkContext.setJobGroup(f"chain-{n}", "greedy links")
        found = links_of(recovery.greedy_links(df))
        assert found == {(0, 0, i, i) for i in range(n)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))

    assert jobs(5000) == jobs(5) <= 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_manifest_tree_over_many_nodes(spark):
    frames = [0, 1, 3, 4, 17, 65535, 65536, 1 << 40]
    rows = [("s", f, c, f"{f}/{c}", f % 7) for f in frames for c in CHANNELS[:2]]
    df = spark.createDataFrame(rows, "sequence string, frame long, channel string, path string, size long").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level, depth = {}, -(-64 // 2)
    for _, f, _, path, size in rows:
        level[f >> 2] = level.get(f >> 2, "") + f"{path}|{size}"
    level = {k: sha(t) for k, t in sorted(level.items())}
    for _ in range(depth - 1):
        above = {}
        for k, t in sorted(level.items()):
            above[k >> 2] = above.get(k >> 2, "") + t
        level = {k: sha(t) for k, t in above.items()}
    got = timeline.manifest_hash(df, bits=2).first()
    assert got["manifest_sha256"] == sha("".join(t for _, t in sorted(level.items())))


def test_looking_ahead_is_linear(spark):
    df = spark.range(120_000).select(
        F.lit("s").alias("key"), F.col("id").alias("at"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("v")
    )
    start = time.time()
    found = block_scan(df, ["key"], "at", nexts={"n": F.col("v")}).where("n <> at - at % 1000 + 999").count()
    assert found == 0 and time.time() - start < 60


def test_lookup_of_hot_keys_without_broadcasts(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(600)] + [(None, "hot"), (700, None)]
    df = spark.createDataFrame(rows, "id long, key string")
    table = df.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup(df, table, "key", "n", "id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = {r["key"]: r["n"] for r in table.collect()}
    assert sorted((r["id"] or -1, r["key"], r["n"]) for r in found) == sorted((i or -1, k, counts[k]) for i, k in rows if k)


def test_boxes_with_attributes_comments_and_nesting(spark):
    def box(tag, attributes="", inside=""):
        m = lambda name, n, data: f"<{name} a='1'><rows>{n}</rows><cols>{len(data.split()) // n}</cols><data>{data}</data></{name}>"
        return f"<{tag}{attributes}>{inside}{m('transform', 4, ' '.join('1' * 16))}{m('vertices', 2, '1 2 3 4 5 6')}</{tag}>"

    document = (
        "<?xml version='1.0'?><!-- head --><root>"
        + box("plain")
        + box("with", " id='a&gt;b'", "<label>car</label>")
        + box("hy-phen.x", "", "<index>7</index>")
        + "<!-- " + box("gone") + " -->"
        + box("nested", "", "<nested><transform>no</transform></nested><label>in</label>")
        + "<group>" + box("deep") + "</group></root>"
    )
    out = readers.boxes_xml(spark.createDataFrame([("p", document)], "path string, value string")).collect()
    assert sorted((r["document_order"], r["label"], r["annotation_index"]) for r in out) == [
        *[(0, "unknown", -1), (1, "car", -1), (2, "unknown", 7), (3, "in", -1)]
    ]
    with pytest.raises(Exception, match="ParseError"):
        readers.boxes_xml(spark.createDataFrame([("p", "<root><a></root>")], "path string, value string")).collect()


def test_json_arrays_are_whole_or_fail(spark, tmp_path):
    for name, text in (("good", '[{"a": 1}, {"a": 2}]'), ("mixed", '[{"a": 1}, 5, {"a": 2}]'), ("cut", '[{"a": 1}, {"a": 2}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(text)
    assert readers.json_array(spark, str(tmp_path / "good"), "a long").count() == 2
    for name in ("mixed", "cut"):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
            readers.json_array(spark, str(tmp_path / name), "a long").collect()


def test_missing_folder_has_no_files(spark, tmp_path):
    assert readers.list_files(spark, str(tmp_path / "none")).count() == 0


def test_a_reviewers_last_decision_counts(spark):
    given = [("spatial", 1, r, d, o) for r, d, o in (("a", False, 1), ("a", True, 2), ("b", True, 1), ("c", None, 1), ("c", True, 2))]
    given += [("spatial", 2, r, d, o) for r, d, o in (("a", True, 1), ("b", True, 1), ("c", True, 1), ("c", None, 2))]
    df = spark.createDataFrame(given, "kind string, relation_id long, reviewer string, decision boolean, order int")
    out = {r["relation_id"]: (r["complete"], r["unanimous"]) for r in review.agreement_items(df).collect()}
    assert out == {1: (True, True), 2: (False, False)}


def test_large_boxes_lie_in_coarse_grids(spark):
    """One box of a kilometre among many small ones: few cells each, and the same points as by comparison."""
    rnd = random.Random(12)
    boxes = [("s", "large", -400.0, 620.0, -500.0, 480.0, -1.0, 1.0), ("s", "flat", 3.0, 3.0, 0.0, 64.0, 0.0, 0.0)]
    for i in range(60):
        x, y, w = rnd.uniform(-30, 30), rnd.uniform(-30, 30), rnd.choice([0.5, 3.9, 4.0, 7.99, 8.0, 30.0])
        boxes.append((rnd.choice("st"), f"b{i}", x, x + w, y, y + w / 2, -0.5, 0.5))
    boxes.append(("t", "none", None, 1.0, 0.0, 1.0, 0.0, 1.0))
    points = [(rnd.choice("st"), i, rnd.choice([rnd.uniform(-40, 40), 4.0, -8.0]), rnd.uniform(-40, 40), rnd.uniform(-0.6, 0.6)) for i in range(500)]
    points += [("s", 900, 620.0005, 0.0, 0.0), ("s", 901, 3.0, 64.0, 0.0), ("s", 902, -400.002, 0.0, 0.0)]
    df = spark.createDataFrame(boxes, "sample_token string, token string, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    cells = {r["token"]: r["count"] for r in observations.box_cells(df, 1e-3, 4.0).groupBy("token").count().collect()}
    assert max(cells.values()) <= 9 and set(cells) == {b[1] for b in boxes} - {"none"}
    found = observations.object_points(spark.createDataFrame(points, "sample_token string, point_id long, x double, y double, z double"), df)
    got = {(r["token"], r["point_id"]) for r in found.collect()}
    want = {
        (b[1], p[1])
        for b in boxes if b[2] is not None
        for p in points
        if b[0] == p[0] and all(b[2 + 2 * k] - 1e-3 <= p[2 + k] <= b[3 + 2 * k] + 1e-3 for k in range(3))
    }
    assert got == want and ("large", 900) in got and ("flat", 901) in got


def test_budget_takes_equal_priorities_by_sequence(spark):
    files = [(s, f"{s}/{k}", 10) for s in range(6) for k in range(2)] + [(5, "0/0", 10)]
    priority = [(0, 1), (1, 0), (2, 1), (3, 0), (4, 2), (5, 0)]
    chosen = timeline.budget_prefix(
        spark.createDataFrame(files, "sequence long, path string, size long"), spark.createDataFrame(priority, "sequence long, priority long"), 75
    )
    found = {r["sequence"]: (r["bytes"], r["cumulative_bytes"]) for r in chosen.collect()}
    # the shared file counts for sequence 5, which comes before sequence 0
    assert found == {1: (20, 20), 3: (20, 40), 5: (30, 70), 0: (10, 80)}
    with pytest.raises(Exception, match="never reached"):
        timeline.budget_prefix(
            spark.createDataFrame(files, "sequence long, path string, size long"), spark.createDataFrame(priority, "sequence long, priority long"), 1000
        ).collect()
