"""SQL for the queries on spatial relations."""

from oracles.base import cte, r6, sql, tok

cte(
    "sp_pair",
    """
SELECT a.sample_token, a.sequence, a.raw_frame_index, a.token AS a_token, b.token AS b_token,
       a.instance_token AS a_instance, b.instance_token AS b_instance, a.label AS a_label, b.label AS b_label,
       a.filename, sqrt((a.center_x-b.center_x)*(a.center_x-b.center_x)+(a.center_y-b.center_y)*(a.center_y-b.center_y)) AS center_distance,
       a.center_x-b.center_x AS delta_x, a.center_y-b.center_y AS delta_y, a.center_z-b.center_z AS delta_z,
       least(a.max_x,b.max_x)-greatest(a.min_x,b.min_x) AS ox, least(a.max_y,b.max_y)-greatest(a.min_y,b.min_y) AS oy,
       least(a.max_z,b.max_z)-greatest(a.min_z,b.min_z) AS oz,
       (a.max_x-a.min_x)*(a.max_y-a.min_y) AS area_a, (b.max_x-b.min_x)*(b.max_y-b.min_y) AS area_b,
       greatest(a.max_z-a.min_z, 1e-6) AS a_height, greatest(b.max_z-b.min_z, 1e-6) AS b_height,
       greatest(0.5::DOUBLE, 0.25::DOUBLE*((a.max_y-a.min_y)+(b.max_y-b.min_y))) AS lateral_margin,
       greatest(1.0::DOUBLE, 0.25::DOUBLE*((a.max_x-a.min_x)+(b.max_x-b.min_x))) AS longitudinal_margin,
       greatest(a.volume,1e-6)/greatest(b.volume,1e-6) AS volume_ratio,
       a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
       a.depth AS a_depth, b.depth AS b_depth, a.mask_pixels AS subject_mask_pixels, b.mask_pixels AS object_mask_pixels,
       a.mask_available AND b.mask_available AND a.mask_pixels >= 20 AND b.mask_pixels >= 20 AS occlusion_mask_supported,
       a.supervised_eligible AND b.supervised_eligible AS supervised_eligible
FROM obs a JOIN obs b ON a.sample_token = b.sample_token AND a.token <> b.token
WHERE sqrt((a.center_x-b.center_x)*(a.center_x-b.center_x)+(a.center_y-b.center_y)*(a.center_y-b.center_y)) <= 15""",
)
cte(
    "sp_meas",
    """
SELECT *, CASE WHEN area_a+area_b-bev_intersection > 0 THEN bev_intersection/(area_a+area_b-bev_intersection) ELSE 0 END AS bev_iou,
       a_height/b_height AS height_ratio
FROM (SELECT *, greatest(0.0::DOUBLE,ox)*greatest(0.0::DOUBLE,oy) AS bev_intersection,
             sqrt(greatest(0.0::DOUBLE,-ox)*greatest(0.0::DOUBLE,-ox)+greatest(0.0::DOUBLE,-oy)*greatest(0.0::DOUBLE,-oy)) AS box_distance,
             greatest(0.0::DOUBLE,oz) AS vertical_overlap,
             CASE WHEN ax1 IS NOT NULL AND bx1 IS NOT NULL AND least((ax2-ax1)*(ay2-ay1),(bx2-bx1)*(by2-by1)) > 0
                  THEN greatest(0.0::DOUBLE,least(ax2,bx2)-greatest(ax1,bx1))*greatest(0.0::DOUBLE,least(ay2,by2)-greatest(ay1,by1))
                       /least((ax2-ax1)*(ay2-ay1),(bx2-bx1)*(by2-by1)) ELSE 0.0::DOUBLE END AS image_overlap
      FROM sp_pair WHERE area_a > 0 AND area_b > 0)""",
)
cte(
    "sp_rel",
    f"""
SELECT *, NOT (left_of OR in_front_of OR near OR overlapping OR occluding) AS no_relation,
       {tok('spatial-relation', 'sample_token', 'a_token', 'b_token')} AS token,
       array_to_string(list_filter([CASE WHEN left_of THEN 'left_of' END, CASE WHEN in_front_of THEN 'in_front_of' END,
         CASE WHEN near THEN 'near' END, CASE WHEN overlapping THEN 'overlapping' END,
         CASE WHEN occluding THEN 'occluding' END], lambda x: x IS NOT NULL), ',') AS positive_predicates,
       concat_ws(',', left_of::INT, in_front_of::INT, near::INT, overlapping::INT, occluding::INT) AS predicate_vector
FROM (SELECT *, center_distance <= 10 AND delta_y > lateral_margin AS left_of,
             center_distance <= 10 AND delta_x > longitudinal_margin AS in_front_of,
             box_distance <= 1 AS near, bev_iou >= 0.01 AND vertical_overlap >= 0.1 AS overlapping,
             occlusion_mask_supported AND image_overlap >= 0.25 AND a_depth + 0.5::DOUBLE < b_depth AS occluding
      FROM sp_meas)""",
)
cte(
    "sp_long",
    """
SELECT token, sequence, p AS predicate,
       CASE p WHEN 'left_of' THEN left_of WHEN 'in_front_of' THEN in_front_of WHEN 'near' THEN near
              WHEN 'overlapping' THEN overlapping ELSE occluding END AS positive
FROM sp_rel, (VALUES ('left_of'),('in_front_of'),('near'),('overlapping'),('occluding')) v(p)""",
)
MEASURES = (
    "delta_x delta_y delta_z center_distance box_distance bev_intersection bev_iou vertical_overlap image_overlap "
    "lateral_margin longitudinal_margin volume_ratio height_ratio"
).split()
STATS = """SELECT predicate, (SELECT count(*) FROM sp_rel) AS relations, (SELECT count(*) FROM sp_rel WHERE no_relation) AS no_relation,
  count(*) FILTER (WHERE positive) AS positives FROM sp_long GROUP BY predicate"""

SQL = {
    "sp_candidate_pairs": sql(f"SELECT sample_token, a_token, b_token, {r6('center_distance', 'center_distance')} FROM sp_pair"),
    "sp_bev_overlap": sql(
        f"SELECT a_token, b_token, {r6('bev_intersection', 'bev_intersection')}, {r6('bev_iou', 'bev_iou')}, "
        f"{r6('box_distance', 'box_distance')} FROM sp_meas"
    ),
    "sp_vertical_overlap": sql(
        f"SELECT a_token, b_token, {r6('greatest(0.0::DOUBLE, oz)', 'vertical_overlap')}, {r6('a_height', 'a_height')}, "
        f"{r6('b_height', 'b_height')} FROM sp_pair"
    ),
    "sp_margins": sql(
        f"SELECT a_token, b_token, {r6('lateral_margin', 'lateral_margin')}, "
        f"{r6('longitudinal_margin', 'longitudinal_margin')} FROM sp_pair"
    ),
    "sp_image_overlap": sql(f"SELECT a_token, b_token, {r6('image_overlap', 'image_overlap')} FROM sp_meas"),
    "sp_predicates": sql("SELECT a_token, b_token, left_of, in_front_of, near, overlapping, occluding FROM sp_rel"),
    "sp_relations": sql(
        f"""SELECT token, sample_token, sequence, raw_frame_index, a_token AS subject_token, b_token AS object_token,
  a_label AS subject_label, b_label AS object_label, {', '.join(r6(m, m) for m in MEASURES)},
  subject_mask_pixels, object_mask_pixels, occlusion_mask_supported, predicate_vector, positive_predicates,
  no_relation, supervised_eligible FROM sp_rel"""
    ),
    "sp_canonical_check": sql(
        """WITH dmg AS (SELECT sample_token, a_token, b_token, left_of OR a_label = b_label AS left_of, in_front_of,
    near AND a_label <> 'unknown' AS near, overlapping, occluding
  FROM sp_rel WHERE NOT (a_label = 'c3' AND b_label = 'unknown')),
both_ways AS (SELECT h.*, r.a_token IS NULL AS missing, r.left_of AS rl, r.in_front_of AS rf, r.near AS rn,
    r.overlapping AS ro, r.occluding AS rc
  FROM dmg h LEFT JOIN dmg r ON h.sample_token = r.sample_token AND h.a_token = r.b_token AND h.b_token = r.a_token)
SELECT error, predicate, count(*) AS violations FROM (
  SELECT 'missing_reverse_pair' AS error, '' AS predicate FROM both_ways WHERE missing
  UNION ALL SELECT 'symmetric_predicate_mismatch', CASE WHEN near <> rn THEN 'near' ELSE 'overlapping' END
    FROM both_ways WHERE NOT missing AND (near <> rn OR overlapping <> ro)
  UNION ALL SELECT 'asymmetric_predicate_true_in_both_directions',
    CASE WHEN left_of AND rl THEN 'left_of' WHEN in_front_of AND rf THEN 'in_front_of' ELSE 'occluding' END
    FROM both_ways WHERE NOT missing AND ((left_of AND rl) OR (in_front_of AND rf) OR (occluding AND rc)))
GROUP BY ALL"""
    ),
    "sp_statistics": sql(
        f"SELECT *, {r6('100.0::DOUBLE*positives/relations', 'positive_rate_percent')} FROM ({STATS})"
    ),
    "sp_parts_summary": sql(
        """WITH listed AS (
  SELECT 'missing' AS section, CAST(sequence AS VARCHAR) AS name FROM (SELECT DISTINCT o_orderkey % 6 AS sequence FROM orders)
    WHERE sequence NOT IN (SELECT sequence FROM sp_rel)
  UNION ALL SELECT DISTINCT 'unexpected', CAST(sequence AS VARCHAR) FROM sp_rel
    WHERE sequence NOT IN (SELECT o_orderkey % 6 FROM orders)
  UNION ALL SELECT DISTINCT 'schema', 'v0' FROM sp_rel WHERE sequence = 2)
SELECT 'total' AS section, predicate AS name, CAST(count(*) FILTER (WHERE positive) AS BIGINT) AS value FROM sp_long GROUP BY predicate
UNION ALL SELECT 'total', 'relation_candidates', count(*) FROM sp_rel
UNION ALL SELECT 'total', 'no_relation', count(*) FROM sp_rel WHERE no_relation
UNION ALL SELECT section, name, 1 FROM listed
UNION ALL SELECT 'passed', 'passed', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM listed"""
    ),
    "sp_validate_part": sql(
        """WITH rep AS (SELECT sequence, count(*) - 40 AS n FROM sp_rel GROUP BY sequence)
SELECT 'no_candidates' AS rule, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS violations FROM sp_rel
UNION ALL SELECT 'missing_column', 1
UNION ALL SELECT 'missing_required_field', count(*) FROM sp_rel WHERE raw_frame_index % 7 = 0 OR raw_frame_index % 11 = 3
UNION ALL SELECT 'wrong_vector_length', count(*) FROM sp_rel WHERE raw_frame_index % 5 = 2
UNION ALL SELECT 'label_outside_vocabulary', count(*) FROM sp_rel WHERE raw_frame_index % 5 = 1
UNION ALL SELECT 'vector_disagrees_with_labels', count(*) FROM sp_rel WHERE raw_frame_index % 5 = 2
UNION ALL SELECT 'missing_report', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT FROM rep
UNION ALL SELECT 'wrong_schema_version', count(*) FROM rep WHERE sequence % 2 <> 0
UNION ALL SELECT 'build_failed', count(*) FROM rep WHERE sequence % 3 = 0
UNION ALL SELECT 'no_reported_candidates', count(*) FROM rep WHERE n <= 0
UNION ALL SELECT 'wrong_predicate_vocabulary', count(*) FROM rep WHERE sequence % 4 = 0
UNION ALL SELECT 'wrong_predicate_order', count(*) FROM rep WHERE sequence % 5 = 0
UNION ALL SELECT 'missing_canonical_inverse_encoding', count(*) FROM rep WHERE sequence % 7 = 0"""
    ),
    "sp_support_flags": sql(
        f"""SELECT predicate, positives, CASE WHEN positives = 0 THEN 'unsupported' ELSE 'rare' END AS support
FROM ({STATS}) WHERE positives < 6000"""
    ),
}
