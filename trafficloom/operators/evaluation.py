"""Multilabel, object and ranking metrics.

Predictions have one row per relation: `relation_id` (unique), `logits` and `targets` as arrays in predicate
order, and where needed `group_id`, `sequence`, `available`. Everything is counted with plain aggregates but
average precision, which needs the global order of the scores and gets it in pieces (`running_totals`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficloom.functions.numbers import count_where, f1_score, flag, ratio, sigmoid
from trafficloom.operators.checks import required
from trafficloom.plans.ordered import PIECE, range_pieces, running_totals

UNAVAILABLE_LOGIT = -20.0
RANK_LIMIT = 1000
PARTS = 64
PIECE_ROWS = 250_000


def to_long(predictions: DataFrame, predicates: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per relation and predicate with its score and target."""
    names = F.array(*[F.lit(p) for p in predicates])
    both = F.posexplode(F.arrays_zip("logits", "targets")).alias("predicate_index", "_v")
    kept = ["relation_id", *[k for k in keep if k != "relation_id"]]
    return predictions.select(*kept, both).select(
        *kept,
        "predicate_index",
        F.get(names, F.col("predicate_index")).alias("predicate"),
        sigmoid(F.col("_v.logits")).alias("score"),
        F.col("_v.targets").cast("long").alias("target"),
    )


def average_precision(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean precision at the positives, scores falling, ties in the order of the relation id; null without positives."""
    keys = [*by, "predicate"]
    narrow = long.select(*keys, "relation_id", "score", "target")
    ranked = running_totals(
        narrow,
        keys,
        [F.col("score").desc(), F.col("relation_id").asc()],
        {"rank": F.lit(1).cast("long"), "hits": F.col("target")},
    )
    return ranked.groupBy(*keys).agg(
        (
            F.sum(F.when(F.col("target") == 1, F.col("hits") / F.col("rank")))
            / F.sum(F.when(F.col("target") == 1, F.lit(1)))
        ).alias("average_precision")
    )


def _of_piece(keys: Sequence[str], kinds: Sequence[str], schema: pa.Schema):
    """What a piece adds to the precision of every slice, given what precedes the piece in each (`carried`)."""

    def run(rows: pa.Table, carried: pa.Table) -> pa.Table:
        # Spark's order: what is no number lies above all numbers
        odd = pc.is_nan(rows.column("score")).cast(pa.int8())
        ordered = rows.append_column("_odd", odd).sort_by(
            [("_odd", "descending"), ("score", "descending"), ("relation_id", "ascending")]
        )
        both = [rows_.select(list(keys)).to_pandas() for rows_ in (ordered, carried)]
        group = pd.concat(both, ignore_index=True).groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        mine, theirs = group[: ordered.num_rows], group[ordered.num_rows :]
        target = ordered.column("target").to_numpy()
        code = carried.column("code").to_numpy()
        place = np.lexsort((code, theirs))
        sums, positives = np.zeros(len(code)), np.zeros(len(code), dtype=np.int64)
        for kind in kinds:
            inside = np.flatnonzero(ordered.column(kind).is_valid().to_numpy(zero_copy_only=False))
            of = ordered.column(kind).take(pa.array(inside)).to_numpy()
            by = np.lexsort((of, mine[inside]))  # stable: rows of a slice stay in their order
            g, c, t = mine[inside][by], of[by], target[inside][by]
            starts = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))[: len(g)]
            length = np.diff(np.append(starts, len(g)))
            # every slice of the piece has a row in `carried`
            pair = np.rec.fromarrays([theirs[place], code[place]])
            row = place[np.searchsorted(pair, np.rec.fromarrays([g[starts], c[starts]], dtype=pair.dtype))]
            seen = np.cumsum(t)
            rank = np.arange(1, len(g) + 1) - np.repeat(starts, length) + np.repeat(carried.column("n").to_numpy()[row], length)
            hits = seen - np.repeat(seen[starts] - t[starts], length) + np.repeat(carried.column("t").to_numpy()[row], length)
            share = np.where(t == 1, hits / rank, 0.0)
            if len(starts):
                np.add.at(sums, row, np.add.reduceat(share, starts))
                np.add.at(positives, row, np.add.reduceat(t, starts))
        columns = [*[carried.column(k) for k in keys], carried.column("code"), pa.array(sums), pa.array(positives)]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def sliced_average_precision(
    long: DataFrame, keys: Sequence[str], slices: Sequence[Column], piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """`average_precision` per (*keys, slice) of rows that belong to several slices, from one sort of the rows.

    Each of `slices` gives a row's slice of one kind, or null; all have the same type, and slices of different kinds must
    differ. The rows are ranged once by falling score and met once more, piece by piece, with what precedes the piece in every
    slice: one row per piece and slice. Ranks and hits are counted for all kinds where the rows lie. A piece is held in
    memory as a whole; it has about `piece_rows` rows, so that larger inputs have more pieces and not larger ones.
    """
    keys = list(keys)
    kinds = [f"_kind{i}" for i in range(len(slices))]
    codes = [F.when(s.isNotNull(), F.xxhash64(s)).alias(k) for s, k in zip(slices, kinds, strict=True)]
    met = [F.when(s.isNotNull(), F.struct(F.xxhash64(s).alias("code"), s.alias("slice"))) for s in slices]
    wide = long.select(*keys, "relation_id", "score", "target", F.array_compact(F.array(*met)).alias("_slices"), *codes)
    cut = range_pieces(wide.drop("_slices"), [F.col("score").desc(), F.col("relation_id").asc()], piece_rows)
    names = wide.select(F.explode("_slices").alias("_s")).groupBy("_s.code").agg(
        F.min("_s.slice").alias("slice"), F.max("_s.slice").alias("_other")
    )
    named = names.select("code", required(F.col("slice"), F.col("slice") == F.col("_other"), "two slices have one hash").alias("slice"))

    each = cut.select(PIECE, *keys, "target", F.explode(F.array_compact(F.array(*kinds))).alias("code"))
    totals = each.groupBy(PIECE, *keys, "code").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("t"))
    before = Window.partitionBy(*keys, "code").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(PIECE, *keys, "code", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "t")])

    kept = long.select(*keys).schema
    out = T.StructType([*kept.fields, T.StructField("code", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("positives", T.LongType())])
    run = _of_piece(keys, kinds, to_arrow_schema(out))
    parts = cut.groupBy(PIECE).cogroup(carried.groupBy(PIECE)).applyInArrow(run, out)
    precision = parts.groupBy(*keys, "code").agg(F.sum("total").alias("_total"), F.sum("positives").alias("_n"))
    return precision.join(named, "code").select(
        *keys, "slice", F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")).alias("average_precision")
    )


def _hit(i: int, threshold: float) -> tuple[Column, Column]:
    actual = F.get("targets", F.lit(i)) == 1
    return actual, sigmoid(F.get("logits", F.lit(i))) >= threshold


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}).withColumn(
        "f1", f1_score(F.col("precision"), F.col("recall"))
    )


def _counts(predictions: DataFrame, predicates: Sequence[str], by: Sequence[str], threshold: float) -> DataFrame:
    """One row per `by` with counts of every predicate side by side, from one aggregation."""
    aggregates = [F.count(F.lit(1)).alias("examples")]
    exact = F.lit(True)
    for i, _ in enumerate(predicates):
        actual, guessed = _hit(i, threshold)
        aggregates += [
            count_where(actual & guessed).alias(f"tp{i}"),
            count_where(~actual & guessed).alias(f"fp{i}"),
            count_where(actual & ~guessed).alias(f"fn{i}"),
        ]
        exact = exact & (actual == guessed)
    aggregates.append(count_where(exact).alias("exact"))
    return predictions.groupBy(*by).agg(*aggregates)


def _per_predicate(counts: DataFrame, predicates: Sequence[str], by: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(p).alias("predicate"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn")])
        for i, p in enumerate(predicates)
    ]
    return counts.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def confusion(
    predictions: DataFrame, predicates: Sequence[str], by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Per predicate: support, tp, fp, fn, precision, recall, F1."""
    long = _per_predicate(_counts(predictions, predicates, by, threshold), predicates, by)
    return _rates(long.withColumn("support", F.col("tp") + F.col("fn")))


def predicate_metrics(
    predictions: DataFrame, predicates: Sequence[str], by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """`confusion` with average precision."""
    return confusion(predictions, predicates, by, threshold).join(
        average_precision(to_long(predictions, predicates, by), by), [*by, "predicate"], "left"
    )


def multilabel(
    predictions: DataFrame,
    predicates: Sequence[str],
    by: Sequence[str] = (),
    threshold: float = 0.5,
    precise: DataFrame | None = None,
) -> DataFrame:
    """Macro F1 and mAP over supported predicates, micro figures, exact match and unsupported predicates.

    `precise` has (*by, predicate, average_precision) where these are known already.
    """
    by = list(by)
    counts = _counts(predictions, predicates, by, threshold)
    rated = _rates(_per_predicate(counts, predicates, by).withColumn("support", F.col("tp") + F.col("fn")))
    if precise is None:
        precise = average_precision(to_long(predictions, predicates, by), by)
    order = F.array(*[F.lit(p) for p in predicates])
    lacking = F.collect_list(F.when(F.col("support") == 0, F.array_position(order, F.col("predicate")) - 1))
    macro = rated.join(precise, [*by, "predicate"], "left").groupBy(*by).agg(
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"),
        F.avg("average_precision").alias("mean_average_precision"),
        F.array_join(
            F.transform(F.array_sort(lacking), lambda i: F.get(order, i.cast("int"))), ","
        ).alias("unsupported_predicates"),
    )
    micro = counts.select(
        *by,
        "examples",
        *[reduce(lambda a, b: a + b, [F.col(f"{c}{i}") for i, _ in enumerate(predicates)]).alias(c) for c in ("tp", "fp", "fn")],
        (F.col("exact") / F.col("examples")).alias("exact_match_accuracy"),
    )
    micro = (
        _rates(micro)
        .withColumnsRenamed({"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1"})
        .drop("tp", "fp", "fn")
    )
    if by:
        return micro.join(macro, by)
    # Both sides are one row.
    return micro.crossJoin(F.broadcast(macro))


def object_metrics(predictions: DataFrame, classes: int) -> DataFrame:
    """Per class: support, precision, recall, F1; the row of class -1 has accuracy and macro F1 over supported ones.

    `predictions` has `scores` (array) and `label`; the first of equal scores wins.
    """
    guess = (F.array_position("scores", F.array_max("scores")) - 1).alias("guess")
    made = predictions.select(F.col("label").cast("long").alias("label"), guess)
    cells = made.groupBy("label", "guess").agg(F.count(F.lit(1)).alias("n"))
    right, n = F.col("label") == F.col("guess"), F.col("n")
    # The confusion cells number at most classes x classes.
    per = (
        cells.select(
            F.explode(
                F.array(
                    F.struct(
                        F.col("label").alias("class"),
                        F.when(right, n).otherwise(0).alias("tp"),
                        F.lit(0).cast("long").alias("fp"),
                        F.when(right, 0).otherwise(n).alias("fn"),
                    ),
                    F.struct(
                        F.col("guess").alias("class"),
                        F.lit(0).cast("long").alias("tp"),
                        F.when(right, 0).otherwise(n).alias("fp"),
                        F.lit(0).cast("long").alias("fn"),
                    ),
                )
            ).alias("c")
        )
        .groupBy(F.col("c.class").alias("class"))
        .agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn")])
    )
    listed = predictions.sparkSession.range(classes).select(F.col("id").alias("class")).join(per, "class", "left")
    rated = _rates(listed.select("class", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]))
    rated = rated.withColumn("support", F.col("tp") + F.col("fn"))
    whole = rated.agg(
        F.sum("support").alias("support"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("f1"),
    )
    nothing = F.lit(None).cast("double")
    return rated.select("class", "support", "precision", "recall", "f1", nothing.alias("accuracy")).unionByName(
        whole.select(
            F.lit(-1).cast("long").alias("class"), "support", nothing.alias("precision"), nothing.alias("recall"), "f1", "accuracy"
        )
    )


def mask_unavailable(predictions: DataFrame, value: float = UNAVAILABLE_LOGIT) -> DataFrame:
    low = F.transform("logits", lambda _: F.lit(value))
    return predictions.withColumn("logits", F.when(F.col("available"), F.col("logits")).otherwise(low))


def recall_at_k(
    predictions: DataFrame, predicates: Sequence[str], ks: Sequence[int] = (10, 20, 50, 100)
) -> DataFrame:
    """(k, name, recall): `R` over all positives, `mR` over supported predicates, and per predicate.

    All (relation, predicate) pairs of a group are ranked together, ties by relation and predicate.
    Unavailable relations cannot be ranked but stay in the denominator. Only the first max(ks) ranks of a
    group are kept. Up to RANK_LIMIT ranks Spark applies this limit before the shuffle; beyond, the first ranks of
    hashed parts of a group are taken first, so a large group costs no task more than PARTS times its first ranks.
    """
    order = [F.col("score").desc(), F.col("relation_id"), F.col("predicate_index")]
    leading = (
        to_long(predictions, predicates, ["group_id", "available"])
        .where("available")
        .select("group_id", "relation_id", "predicate_index", "predicate", "score", "target")
    )
    if max(ks) > RANK_LIMIT:
        parted = leading.withColumn("_part", F.pmod(F.xxhash64("relation_id"), F.lit(PARTS)))
        inside = Window.partitionBy("group_id", "_part").orderBy(*order)
        leading = parted.withColumn("_at", F.row_number().over(inside)).where(F.col("_at") <= max(ks)).drop("_at", "_part")
    over = Window.partitionBy("group_id").orderBy(*order)
    ranked = leading.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= max(ks))
    found = ranked.where("target = 1").groupBy("predicate").agg(
        *[count_where(F.col("rank") <= k).alias(f"at{k}") for k in ks]
    )
    support = predictions.agg(
        *[F.coalesce(F.sum(F.get("targets", F.lit(i))), F.lit(0)).cast("long").alias(p) for i, p in enumerate(predicates)]
    ).unpivot([], list(predicates), "predicate", "support")
    per = support.join(found, "predicate", "left")
    each = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"at{k}", F.lit(0)).alias("found")) for k in ks])
    )
    rows = per.select("predicate", "support", each.alias("_k")).select("predicate", "support", "_k.k", "_k.found")
    named = rows.select("k", F.col("predicate").alias("name"), ratio(F.col("found"), F.col("support")).alias("recall"))
    over_all = rows.groupBy("k").agg(
        ratio(F.sum("found"), F.sum("support")).alias("R"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("found") / F.greatest("support", F.lit(1)))), F.lit(0.0)).alias("mR"),
    )
    return named.unionByName(over_all.unpivot(["k"], ["R", "mR"], "name", "recall"))


def coverage(predictions: DataFrame) -> DataFrame:
    """Rows and positives, all and available."""
    positives = F.aggregate("targets", F.lit(0).cast("long"), lambda s, t: s + t.cast("long"))
    return predictions.agg(
        F.count(F.lit(1)).alias("examples"),
        count_where(F.col("available")).alias("eligible_examples"),
        F.avg(flag(F.col("available"))).alias("candidate_coverage"),
        F.sum(positives).alias("positive_triplets"),
        F.coalesce(F.sum(F.when(F.col("available"), positives)), F.lit(0)).alias("eligible_positive_triplets"),
    )


def combined(*metrics: DataFrame) -> DataFrame:
    """Mean F1 and mean average precision over the supported predicates of several tasks."""
    stacked = reduce(
        DataFrame.unionByName, [m.select("predicate", "support", "f1", "average_precision") for m in metrics]
    )
    supported = stacked.where(F.col("support") > 0)
    return supported.agg(
        F.count(F.lit(1)).alias("predicates"),
        F.avg("f1").alias("macro_f1"),
        F.avg("average_precision").alias("mean_average_precision"),
    )


def selection_score(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean of those of the named scores that are not null; 0 when all are."""
    values = F.filter(F.array(*[F.col(n) for n in names]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return scores.withColumn(
        "selection_score", F.when(F.size(values) > 0, total / F.greatest(F.size(values), F.lit(1))).otherwise(0.0)
    )


def relation_metadata(parts: Sequence[DataFrame]) -> DataFrame:
    """Ids of all parts in one table; a group's name gets its sequence in front."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.withColumn(
        "group_id", F.concat_ws(":", F.col("sequence").cast("string"), F.col("group_id").cast("string"))
    )


def provenance_check(tracks: DataFrame, expected: DataFrame, part: str = "sequence") -> DataFrame:
    """Parts whose `checkpoint` is not the expected one, or that are missing."""
    wanted = expected.select(part, F.col("checkpoint").alias("expected_checkpoint"))
    found = tracks.select(part, "checkpoint").distinct()
    same = F.coalesce(F.col("checkpoint") == F.col("expected_checkpoint"), F.lit(False))
    return wanted.join(found, part, "left").where(~same)


def available_only(
    predictions: DataFrame, predicates: Sequence[str], by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    return multilabel(predictions.where("available"), predicates, by, threshold)
