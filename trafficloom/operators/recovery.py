"""Additional links between rows the mutual matching left over, and their assessment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.numbers import count_where, flag, ratio, sigmoid
from trafficloom.operators import matching
from trafficloom.plans.components import components
from trafficloom.plans.lookup import lookup
from trafficloom.plans.pinning import pin

TASK_PAIRS = 1 << 18
MODES = ("one_way", "all")


def margins(scores: DataFrame) -> DataFrame:
    """How far a pair lies above the better of its two dustbins."""
    score = F.col("score")
    return scores.withColumn("margin", F.least(score - F.col("source_dustbin"), score - F.col("target_dustbin")))


def fallback_candidates(
    scores: DataFrame,
    source_choices: DataFrame,
    target_choices: DataFrame,
    links: DataFrame,
    mode: str = "all",
    threshold: float = 0.0,
    keys: Sequence[str] = ("sequence", "group"),
) -> DataFrame:
    """Pairs of rows still without a link whose margin reaches the threshold.

    `one_way` also asks that at least one of the two ends chose the other.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    keys = list(keys)
    free = (
        margins(scores)
        .where(F.col("margin") >= threshold)
        .join(links.select(*keys, "source"), [*keys, "source"], "left_anti")
        .join(links.select(*keys, "target"), [*keys, "target"], "left_anti")
    )
    if mode == "all":
        return free
    ends = [*keys, "source", "target"]
    chosen = source_choices.select(*ends).union(target_choices.select(*ends)).where(
        F.col("source").isNotNull() & F.col("target").isNotNull()
    )
    return free.join(chosen, ends, "left_semi")


def _place() -> Column:
    """Sorts pairs into the order in which they are chosen."""
    return F.struct((-F.col("margin")).alias("m"), (-F.col("score")).alias("s"), "source", "target")


def _first_come(keys: Sequence[str]):
    """Keeps, of pairs in order, those whose source and target no earlier pair of the group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sources, targets = None, set(), set()
        for batch in batches:
            kept = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "source", "target")]
            for *group, source, target in zip(*columns, strict=True):
                if group != now:
                    now, sources, targets = group, set(), set()
                free = source not in sources and target not in targets
                if free:
                    sources.add(source)
                    targets.add(target)
                kept.append(free)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def _in_turn(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The greedy choice with every group in one task, which reads it in order and keeps the ends in use."""
    dealt = candidates.repartition(*keys).sortWithinPartitions(*keys, _place())
    return dealt.mapInArrow(_first_come(keys), candidates.schema)


def greedy_links(
    candidates: DataFrame, keys: Sequence[str] = ("sequence", "group"), task_pairs: int = TASK_PAIRS
) -> DataFrame:
    """Greedy one-to-one choice in the order margin, score (both falling), source, target (both rising).

    Groups of up to `task_pairs` pairs are chosen in turn, each in one task. Larger groups are parted first: pairs conflict only
    within a connected component of sources and targets, so components are groups of their own. What is still larger
    goes by rounds, which no task holds as a whole. All ways give the same choice.
    """
    keys, columns = list(keys), candidates.columns
    pairs = pin(candidates)
    over = F.col("_n") > task_pairs
    large = pin(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(over).drop("_n"))
    if large.isEmpty():
        return _in_turn(pairs, keys)
    # at most one large group per `task_pairs` pairs
    chosen = _in_turn(pairs.join(F.broadcast(large), keys, "left_anti"), keys)

    def node(side: int, end: str) -> Column:
        return F.struct(*keys, F.lit(side).alias("side"), F.col(end).alias("end"))

    rest = pin(
        pairs.join(F.broadcast(large), keys, "left_semi").withColumns({"_u": node(0, "source"), "_v": node(1, "target")})
    )
    found = components(rest, "_u", "_v")
    degrees = rest.groupBy(F.col("_u").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    table = pin(degrees.join(found, "node").select(F.col("node").alias("_u"), F.col("component").alias("_c"), "_n"))
    parted = pin(lookup(rest, table, "_u", "_n", "_v").select(*columns, "_c"))
    sized = parted.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    huge = pin(sized.where(over).select("_c"))
    chosen = chosen.unionByName(_in_turn(parted.join(F.broadcast(huge), "_c", "left_anti"), ["_c"]).select(*columns))
    if huge.isEmpty():
        return chosen
    return chosen.unionByName(_rounds(parted.join(F.broadcast(huge), "_c", "left_semi").select(*columns), keys))


def _rounds(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The greedy choice without ordering a group in one task.

    The order is strict, so a pair that comes first for its source and for its target is chosen whatever happens
    elsewhere. Every round takes all such pairs of all groups at once and drops the pairs that touch them. A round with
    open pairs takes at least one of them, so the rounds end by themselves; taken and open pairs are one table, which only
    shrinks.
    """
    keys = list(keys)
    columns, place = candidates.columns, _place()
    state = pin(candidates.withColumn("_taken", F.lit(False)))
    while True:
        remaining = state.where("NOT _taken")
        if remaining.isEmpty():
            return state.select(*columns)
        first_of_source = remaining.groupBy(*keys, "source").agg(F.min(place).alias("_p"))
        first_of_target = remaining.groupBy(*keys, "target").agg(F.min(place).alias("_p"))
        agreed = first_of_source.select(*keys, "source", F.col("_p.target").alias("target")).join(
            first_of_target.select(*keys, "target", F.col("_p.source").alias("source")), [*keys, "source", "target"]
        )
        by_source = agreed.select(*keys, "source", F.col("target").alias("_partner"))
        by_target = agreed.select(*keys, "target", F.lit(True).alias("_used"))
        told = state.join(by_source, [*keys, "source"], "left").join(by_target, [*keys, "target"], "left")
        now = F.coalesce(F.col("_partner") == F.col("target"), F.lit(False))
        touched = F.col("_partner").isNotNull() | F.col("_used").isNotNull()
        state = pin(
            told.where(F.col("_taken") | now | ~touched).select(*columns, (F.col("_taken") | now).alias("_taken"))
        )


def _as_links(pairs: DataFrame, keys: Sequence[str], fallback: bool) -> DataFrame:
    return pairs.select(
        *keys,
        "source",
        "target",
        "score",
        "margin",
        sigmoid(F.col("score")).alias("confidence"),
        F.lit(fallback).alias("fallback"),
    )


def select_links(
    scores: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    mode: str = "all",
    threshold: float = 0.0,
    keys: Sequence[str] = ("sequence", "group"),
) -> DataFrame:
    """Mutual links and fallback links of all groups."""
    keys = list(keys)
    by_source, by_target = (pin(c) for c in matching.argmax_choices(scores, sources, targets, keys))
    mutual = pin(matching.mutual_matches(by_source, by_target, keys).select(*keys, "source", "target"))
    kept = margins(scores).join(mutual, [*keys, "source", "target"])
    extra = greedy_links(fallback_candidates(scores, by_source, by_target, mutual, mode, threshold, keys), keys)
    return _as_links(kept, keys, False).unionByName(_as_links(extra, keys, True))


def recover(
    scores: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    rows: DataFrame,
    mode: str = "all",
    threshold: float = 0.0,
    keys: Sequence[str] = ("sequence", "group"),
) -> tuple[DataFrame, DataFrame]:
    """(links, tracks) after recovery."""
    links = pin(select_links(scores, sources, targets, mode, threshold, keys))
    return links, matching.components(rows, links)


def link_quality(
    links: DataFrame,
    truth: DataFrame,
    by: Sequence[str] = (),
    keys: Sequence[str] = ("sequence", "group"),
) -> DataFrame:
    """Counts of mutual, fallback and all links, how many are right, precision and recall."""
    by = list(by)
    real = truth.select(*keys, "source", "target").withColumn("_hit", F.lit(True))
    hit = links.join(real, [*keys, "source", "target"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    fallback, right = F.col("fallback"), F.col("_hit")
    counted = hit.groupBy(*by).agg(
        count_where(~fallback).alias("mutual_links"),
        count_where(~fallback & right).alias("correct_mutual_links"),
        count_where(fallback).alias("fallback_links"),
        count_where(fallback & right).alias("correct_fallback_links"),
        F.count(F.lit(1)).alias("links"),
        count_where(right).alias("correct_links"),
    )
    # The number of true links is one row.
    whole = truth.agg(F.count(F.lit(1)).alias("true_links"))
    return counted.crossJoin(F.broadcast(whole)).withColumns(
        {
            "precision": ratio(F.col("correct_links"), F.col("links")),
            "recall": ratio(F.col("correct_links"), F.col("true_links")),
        }
    )


def sweep(
    scores: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    modes: Sequence[str] = MODES,
    thresholds: Sequence[float] = (0.0, 0.5, 1.0, 2.0),
    keys: Sequence[str] = ("sequence", "group"),
) -> DataFrame:
    """Links of every (mode, threshold), found in the same rounds."""
    keys = list(keys)
    by_source, by_target = (pin(c) for c in matching.argmax_choices(scores, sources, targets, keys))
    mutual = pin(matching.mutual_matches(by_source, by_target, keys).select(*keys, "source", "target"))
    lowest = min(thresholds)
    fallback = [
        fallback_candidates(scores, by_source, by_target, mutual, mode, lowest, keys).withColumn("mode", F.lit(mode))
        for mode in modes
    ]
    every = F.array(*[F.lit(float(t)) for t in thresholds])
    tried = reduce(DataFrame.unionByName, fallback).withColumn("threshold", F.explode(every))
    variant = ["mode", "threshold"]
    extra = greedy_links(tried.where(F.col("margin") >= F.col("threshold")), [*variant, *keys])
    kept = margins(scores).join(mutual, [*keys, "source", "target"])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(t)).alias("threshold")) for m in modes for t in thresholds]))
    repeated = kept.withColumn("_v", each).select("*", "_v.mode", "_v.threshold").drop("_v")
    return _as_links(repeated, [*variant, *keys], False).unionByName(_as_links(extra, [*variant, *keys], True))


def select_variant(results: DataFrame) -> DataFrame:
    """The best variant by macro F1, mAP, low identity error and coverage; the first of equals wins.

    `results` has `variant_index` giving the order, and the four figures. A null or zero score counts as -1,
    a null rate as 0.
    """

    def score(name: str) -> Column:
        value = F.col(name)
        return F.when(F.coalesce(value, F.lit(0.0)) == 0, F.lit(-1.0)).otherwise(value)

    order = F.struct(
        score("macro_f1").alias("f"),
        score("mean_average_precision").alias("p"),
        (-F.coalesce("identity_error_rate", F.lit(0.0))).alias("e"),
        F.coalesce("coverage", F.lit(0.0)).alias("c"),
        (-F.col("variant_index")).alias("i"),
    )
    return results.groupBy().agg(F.max_by(F.struct(*results.columns), order).alias("_best")).select("_best.*")


def frozen_check(
    selection: DataFrame, expected_mode: str, expected_threshold: float, sequences: DataFrame, expected: Sequence
) -> DataFrame:
    """(rule, violations): the selection is the frozen one, and the test sequences are exactly the expected."""
    differs = (F.col("mode") != expected_mode) | (F.col("threshold") != expected_threshold)
    rule = selection.agg(count_where(F.coalesce(differs, F.lit(True))).alias("violations"), F.count(F.lit(1)).alias("n"))
    chosen = rule.select(
        F.lit("selection_is_frozen_rule").alias("rule"),
        (F.col("violations") + flag(F.col("n") != 1)).alias("violations"),
    )
    wanted = F.array(*[F.lit(e) for e in expected])
    seen = sequences.select("sequence").distinct()
    unexpected = seen.agg(
        count_where(~F.array_contains(wanted, F.col("sequence"))).alias("more"),
        count_where(F.array_contains(wanted, F.col("sequence"))).alias("found"),
    )
    return chosen.unionByName(
        unexpected.select(
            F.lit("test_sequences_exact").alias("rule"),
            (F.col("more") + F.lit(len(set(expected))) - F.col("found")).alias("violations"),
        )
    )


TOTALS = (
    "mutual_links",
    "fallback_links",
    "correct_fallback_links",
    "links",
    "correct_links",
    "true_links",
)


def totals(reports: DataFrame) -> DataFrame:
    """Six counters summed over reports, precision and recall."""
    summed = reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])
    return summed.withColumns(
        {
            "precision": ratio(F.col("correct_links"), F.col("links")),
            "recall": ratio(F.col("correct_links"), F.col("true_links")),
        }
    )
