"""Vocabularies and thresholds. Every operator takes its thresholds from here or from keyword arguments."""

from __future__ import annotations

from dataclasses import dataclass

# Predicate names and their order.
SPATIAL_PREDICATES = ("left_of", "in_front_of", "near", "overlapping", "occluding")
SYMMETRIC_SPATIAL = ("near", "overlapping")
ASYMMETRIC_SPATIAL = ("left_of", "in_front_of", "occluding")
TEMPORAL_PREDICATES = ("approaching", "moving_away", "same_motion_direction")
EXPLORATORY_PREDICATES = ("crossing_path",)

# Sensor channels of one frame and the kind of data each carries.
CHANNELS = ("CAM0", "CAM1", "LIDAR_TOP", "SEMANTIC_CAM0", "INSTANCE_CAM0")
MODALITIES = {
    "CAM0": "camera",
    "CAM1": "camera",
    "LIDAR_TOP": "lidar",
    "SEMANTIC_CAM0": "label",
    "INSTANCE_CAM0": "label",
}

# Quality bins of a relation built from predicted tracks.
QUALITY_BINS = ("perfect_5", "good_4", "partial_3", "poor_identity", "missing")

# Decisions a reviewer may record for a sampled relation.
REVIEW_DECISIONS = ("correct", "incorrect", "ambiguous")


@dataclass(frozen=True)
class SpatialParams:
    candidate_distance: float = 30.0
    relation_distance: float = 20.0
    near_distance: float = 3.0
    overlap_bev_iou: float = 0.01
    overlap_vertical: float = 0.10
    occlusion_overlap: float = 0.25
    occlusion_depth_margin: float = 0.5
    minimum_mask_pixels: int = 20
    lateral_min_margin: float = 0.5
    longitudinal_min_margin: float = 1.0


@dataclass(frozen=True)
class TemporalParams:
    window_size: int = 5
    candidate_distance: float = 30.0
    minimum_motion_speed: float = 0.5
    step_distance_epsilon: float = 0.05
    minimum_radial_speed: float = 0.25
    minimum_distance_change: float = 1.0
    trend_fraction: float = 0.75
    same_direction_cosine: float = 0.80
    crossing_max_cosine: float = 0.50
    crossing_path_distance: float = 2.0
    minimum_joint_visible_steps: int = 3
