"""Files of pinned tables follow from their rows, whatever number of partitions the session asks for."""

import random
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from trafficloom.llm import jaccard, packing
from trafficloom.llm.registry import tokenizer
from trafficloom.plans.components import components
from trafficloom.plans.ordered import range_pieces, running_totals
from trafficloom.plans.pinning import FILE_ROWS, gathered, pin

PARTITIONS = 64


@pytest.fixture
def fixed(spark):
    """A session that keeps PARTITIONS however small the tables, with the number of files that checkpoints have."""
    settings = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    pin(spark.range(1))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield lambda: sum(1 for _ in folder.rglob("part-*"))
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(spark, n=60):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(200)]
    rows = [" ".join(rnd.choices(words, k=rnd.randint(5, 80))) for _ in range(n)]
    rows += [f"{t} end" for t in rows[: n // 2]]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_partitions_are_put_together_and_never_split(spark):
    df = spark.range(0, 1000, 1, PARTITIONS)
    cores = spark.sparkContext.defaultParallelism
    assert gathered(df, 1000).rdd.getNumPartitions() == 2 * cores
    assert gathered(df, 30 * FILE_ROWS).rdd.getNumPartitions() == 30
    assert gathered(spark.range(0, 10, 1, 3), 10).rdd.getNumPartitions() == 3
    assert sorted(r["id"] for r in pin(df, 1000).collect()) == list(range(1000))


def test_near_copies_write_few_files(spark, fixed):
    docs, before = texts(spark), fixed()
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()}
    # all pins but that of the candidate pairs are bounded by known rows: 64 files each before
    assert fixed() - before < 4 * PARTITIONS
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()}
    assert len(set(found.values())) < len(found)


def test_components_write_few_files(spark, fixed):
    edges, before = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 7], "a long, b long"), fixed()
    found = {r["node"]: r["component"] for r in components(edges, "a", "b", 40).collect()}
    assert found == {k: max(1, (k - 1) // 7 * 7 + 1) for k in range(1, 41)}
    assert fixed() - before < 2 * PARTITIONS


def test_pieces_stay_apart_in_few_files(spark, fixed):
    df, before = spark.range(500).select(F.col("id"), (F.col("id") % 5).alias("key")), fixed()
    tagged = range_pieces(df, [F.col("id")], at_most=500)
    pieces = tagged.groupBy("_piece").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_piece").collect()
    assert len(pieces) > PARTITIONS // 2 and all(x["b"] < y["a"] for x, y in zip(pieces, pieces[1:], strict=False))
    total = running_totals(df, ["key"], [F.col("id")], {"upto": F.col("id")}, at_most=500)
    assert all(r["upto"] == sum(range(r["key"], r["id"] + 1, 5)) for r in total.collect())
    assert fixed() - before < PARTITIONS


def test_packing_and_stages_write_few_files(spark, fixed, tmp_path):
    docs, before = texts(spark), fixed()
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"))
    assert fixed() - before < PARTITIONS
    assert pieces.agg(F.sum("length")).first()[0] == sum({r["doc_id"]: r["doc_tokens"] for r in pieces.collect()}.values())
    for k, stage in enumerate((corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats)):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        assert len([*Path(f"{tmp_path}/{k}").glob("part-*")]) <= 2 * spark.sparkContext.defaultParallelism
