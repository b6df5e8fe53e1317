"""Relations on predicted tracks: looked up per window and paired once, against the way by relations."""

from pyspark.sql import functions as F

from trafficloom.operators import matching, relation_index, tracklets
from trafficloom.workload import matching_queries, tables

SF = "/root/testdata/sf0.001"


def test_windows_bring_what_the_way_by_relations_finds(spark):
    scored = matching_queries.Scored(spark, SF)
    tracks = scored.tracks().localCheckpoint()
    windows = tracklets.windows(tables.observations(spark, SF), tables.samples(spark, SF)).localCheckpoint()
    of_windows = relation_index.tracklet_rows(windows, scored.features)
    kept = relation_index.temporal_index(tracklets.relations(windows, tables.TEMPORAL), of_windows).select(
        F.col("token").alias("relation_id"), "source_rows", "target_rows", F.col("raw_frame_indices").alias("frames"),
        "approaching", "moving_away", "same_motion_direction",
    )
    want = matching.availability(matching.predicted_rows(kept, tracks, scored.rows))
    got = matching_queries.resolved(scored, tracks)
    columns = [c for c in want.columns if c != "timestamps_ns"]
    rows = [sorted(map(str, df.select(*columns).collect())) for df in (want, got)]
    assert rows[0] == rows[1] and len(rows[0]) > 10


def test_pairs_are_made_once_and_shuffled_no_further(spark):
    found = matching_queries.tk_availability(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found.select("*")._jdf.queryExecution().sparkPlan().toString()
        prepared = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Join") == 1
    assert prepared.count("Exchange hashpartitioning") <= 2


def test_windows_keep_only_the_steps_asked_for(spark):
    obs, samples = tables.observations(spark, SF), tables.samples(spark, SF)
    slim = tracklets.windows(obs, samples, steps={"raw_frame_index": "raw_frame_indices", "n": "ns"})
    assert not {"boxes", "visible", "filenames", "sample_tokens", "annotation_tokens"} & set(slim.columns)
    whole = tracklets.windows(obs, samples)
    same = ["token", "raw_frame_indices", "xs", "speed"]
    assert sorted(map(str, slim.select(same).collect())) == sorted(map(str, whole.select(same).collect()))
    assert all(len(r["ns"]) == 5 for r in slim.select("ns").collect())


def test_windows_that_can_be_an_end(spark):
    cases = [([0, 1, 2, 3, 4], [True] * 5, True), ([0, 1, 2, 3, 4], [True, True, False, True, True], False),
             ([0, 1, 2, 3, 4], [True, False, True, False, False], False), ([-1, -1, 2, 3, 4], [False, False, True, True, True], True)]
    df = spark.createDataFrame([(i, r, c, w) for i, (r, c, w) in enumerate(cases)], "i int, rows array<long>, complete array<boolean>, want boolean")
    assert df.where(relation_index.usable("rows", "complete") != F.col("want")).count() == 0
