"""Queries on links and association candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficloom.operators import association
from trafficloom.workload import tables
from trafficloom.workload.common import registry, rounded

QUERIES, query = registry()


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tables.observations(spark, sf), tables.samples(spark, sf)


def candidates(spark: SparkSession, sf: str, obs: DataFrame | None = None) -> DataFrame:
    own, samples = _inputs(spark, sf)
    return association.candidates(own if obs is None else obs, samples, tables.GATE)


@query
def as_links(spark, sf):
    return association.links(*_inputs(spark, sf))


@query
def as_object_pairs(spark, sf):
    pairs = association.object_pairs(*_inputs(spark, sf), tables.GATE)
    return rounded(pairs, "delta_x", "delta_y", "delta_z", "center_distance")


@query
def as_dustbins(spark, sf):
    return association.dustbins(*_inputs(spark, sf)).drop("delta_x", "delta_y", "delta_z", "center_distance")


@query
def as_candidates(spark, sf):
    return rounded(candidates(spark, sf), "delta_x", "delta_y", "delta_z", "center_distance")


@query
def as_counts(spark, sf):
    return association.counts(candidates(spark, sf))


@query
def as_validate(spark, sf):
    """Broken choices after the candidates of supervised pairs only are kept."""
    return association.violations(candidates(spark, sf).where("supervised_eligible"))
