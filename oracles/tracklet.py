"""SQL for the queries on tracklet windows and temporal relations."""

from oracles.base import cte, r6, sql, tok

_W = "OVER (PARTITION BY scene_token, instance_token ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"
cte(
    "trk",
    f"""
SELECT *, {tok('tracklet', 'scene_token', 'start_sample_index', 'instance_token')} AS token,
       (xs[5]-xs[1])/duration_seconds AS velocity_x, (ys[5]-ys[1])/duration_seconds AS velocity_y,
       0.0::DOUBLE AS velocity_z,
       sqrt(((xs[5]-xs[1])/duration_seconds)*((xs[5]-xs[1])/duration_seconds)+((ys[5]-ys[1])/duration_seconds)*((ys[5]-ys[1])/duration_seconds)) AS speed
FROM (SELECT scene_token, sequence, instance_token, user_id, label, dynamic, supervised_eligible,
             sample_index AS start_sample_index, list(sample_index) {_W} AS idx, list(token) {_W} AS annotation_tokens,
             list(raw_frame_index) {_W} AS frames, list(timestamp_ns) {_W} AS times,
             list(center_x) {_W} AS xs, list(center_y) {_W} AS ys, list(x1 IS NOT NULL) {_W} AS vis,
             (max(timestamp_ns) {_W} - min(timestamp_ns) {_W})/1e9 AS duration_seconds
      FROM obs)
WHERE len(idx) = 5 AND idx[5]-idx[1] = 4""",
)


def _d(i: int) -> str:
    return f"sqrt((a.xs[{i}]-b.xs[{i}])*(a.xs[{i}]-b.xs[{i}])+(a.ys[{i}]-b.ys[{i}])*(a.ys[{i}]-b.ys[{i}]))"


cte(
    "tp_pair",
    f"""
SELECT a.scene_token, a.sequence, a.start_sample_index, a.token AS a_token, b.token AS b_token, a.frames,
       a.label AS a_label, b.label AS b_label, a.user_id AS a_user, b.user_id AS b_user,
       a.annotation_tokens AS a_annotations, b.annotation_tokens AS b_annotations,
       a.xs AS axs, a.ys AS ays, b.xs AS bxs, b.ys AS bys, a.speed AS sa, b.speed AS sb,
       a.velocity_x AS avx, a.velocity_y AS avy, b.velocity_x AS bvx, b.velocity_y AS bvy,
       {', '.join(f'{_d(i)} AS d{i}' for i in range(1, 6))},
       (SELECT count(*) FROM (SELECT unnest(a.vis) v) WHERE v) AS a_vis, (SELECT count(*) FROM (SELECT unnest(b.vis) v) WHERE v) AS b_vis,
       (SELECT count(*) FROM (SELECT unnest(a.vis) v, unnest(b.vis) w) WHERE v AND w) AS ab_vis,
       a.supervised_eligible AND b.supervised_eligible AS supervised_eligible
FROM trk a JOIN trk b ON a.scene_token = b.scene_token AND a.start_sample_index = b.start_sample_index
     AND a.instance_token <> b.instance_token
WHERE {_d(3)} <= 15 AND greatest(a.speed, b.speed) >= 0.5""",
)
_FALL = "+".join(f"(d{i+1}-d{i} <= -0.05)::INT" for i in range(1, 5))
_RISE = "+".join(f"(d{i+1}-d{i} >= 0.05)::INT" for i in range(1, 5))
cte(
    "tp_path",
    """
SELECT a_token, b_token, min(CASE WHEN o1*o2 < 0 AND o3*o4 < 0 THEN 0.0::DOUBLE ELSE least(
    CASE WHEN cc <= 1e-12 THEN sqrt((ax-cx)**2+(ay-cy)**2) ELSE sqrt((ax-(cx+t1*ux2))**2+(ay-(cy+t1*uy2))**2) END,
    CASE WHEN cc <= 1e-12 THEN sqrt((bx-cx)**2+(by_-cy)**2) ELSE sqrt((bx-(cx+t2*ux2))**2+(by_-(cy+t2*uy2))**2) END,
    CASE WHEN aa <= 1e-12 THEN sqrt((cx-ax)**2+(cy-ay)**2) ELSE sqrt((cx-(ax+t3*ux1))**2+(cy-(ay+t3*uy1))**2) END,
    CASE WHEN aa <= 1e-12 THEN sqrt((dx-ax)**2+(dy-ay)**2) ELSE sqrt((dx-(ax+t4*ux1))**2+(dy-(ay+t4*uy1))**2) END) END) AS path_distance
FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((ax-cx)*ux2+(ay-cy)*uy2)/nullif(cc,0))) AS t1,
             greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((bx-cx)*ux2+(by_-cy)*uy2)/nullif(cc,0))) AS t2,
             greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((cx-ax)*ux1+(cy-ay)*uy1)/nullif(aa,0))) AS t3,
             greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((dx-ax)*ux1+(dy-ay)*uy1)/nullif(aa,0))) AS t4
      FROM (SELECT *, bx-ax AS ux1, by_-ay AS uy1, dx-cx AS ux2, dy-cy AS uy2,
                   (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS aa, (dx-cx)*(dx-cx)+(dy-cy)*(dy-cy) AS cc,
                   (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS o1, (bx-ax)*(dy-ay)-(by_-ay)*(dx-ax) AS o2,
                   (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) AS o3, (dx-cx)*(by_-cy)-(dy-cy)*(bx-cx) AS o4
            FROM (SELECT a_token, b_token, axs[i] AS ax, ays[i] AS ay, axs[i+1] AS bx, ays[i+1] AS by_,
                         bxs[j] AS cx, bys[j] AS cy, bxs[j+1] AS dx, bys[j+1] AS dy
                  FROM tp_pair, range(1,5) r(i), range(1,5) s(j) WHERE sa >= 0.5 AND sb >= 0.5)))
GROUP BY ALL""",
)
cte(
    "tp_meas",
    f"""
SELECT p.*, q.path_distance, d5-d1 AS distance_change, ({_FALL})/4.0::DOUBLE AS decreasing_fraction,
       ({_RISE})/4.0::DOUBLE AS increasing_fraction,
       CASE WHEN d3 > 1e-6 THEN avx*((bxs[3]-axs[3])/d3)+avy*((bys[3]-ays[3])/d3) ELSE 0.0::DOUBLE END AS rs,
       CASE WHEN d3 > 1e-6 THEN bvx*-((bxs[3]-axs[3])/d3)+bvy*-((bys[3]-ays[3])/d3) ELSE 0.0::DOUBLE END AS ro,
       CASE WHEN sa >= 0.5 AND sb >= 0.5 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (avx*bvx+avy*bvy)/(sa*sb))) ELSE 0.0::DOUBLE END AS cosine,
       CASE WHEN NOT supervised_eligible THEN 'not_supervised_eligible' WHEN ab_vis < 3 THEN 'insufficient_joint_rgb_visibility'
            ELSE 'eligible' END AS review_reason
FROM tp_pair p LEFT JOIN tp_path q USING (a_token, b_token)""",
)


def _labels(directed: bool) -> str:
    toward = "toward AND falling" if directed else "falling"
    away = "away AND rising" if directed else "rising"
    return f"""SELECT *, {toward} AS approaching, {away} AS moving_away,
       sa >= 0.5 AND sb >= 0.5 AND cosine >= 0.8 AS same_motion_direction,
       coalesce(sa >= 0.5 AND sb >= 0.5 AND cosine <= 0.5 AND path_distance <= 2.0, false) AS crossing_path
FROM (SELECT *, sa >= 0.5 AND rs >= 0.25 AS toward, sa >= 0.5 AND rs <= -0.25 AS away,
             distance_change <= -1 AND decreasing_fraction >= 0.75 AS falling,
             distance_change >= 1 AND increasing_fraction >= 0.75 AS rising FROM tp_meas)"""


cte("tp_lab", _labels(True))
cte("tp_old", _labels(False))
cte(
    "tp_rel",
    f"""
SELECT *, {tok('temporal-relation', 'a_token', 'b_token')} AS token,
       NOT (approaching OR moving_away OR same_motion_direction OR crossing_path) AS no_relation,
       array_to_string(list_filter([CASE WHEN approaching THEN 'approaching' END, CASE WHEN moving_away THEN 'moving_away' END,
         CASE WHEN same_motion_direction THEN 'same_motion_direction' END, CASE WHEN crossing_path THEN 'crossing_path' END],
         lambda x: x IS NOT NULL), ',') AS positive_predicates
FROM tp_lab""",
)
_COUNTERS = {
    "relation_candidates": "true",
    "no_relation": "no_relation",
    "review_eligible": "review_reason = 'eligible'",
    "insufficient_visibility": "review_reason = 'insufficient_joint_rgb_visibility'",
    "approaching": "approaching",
    "moving_away": "moving_away",
    "same_motion_direction": "same_motion_direction",
    "crossing_path": "crossing_path",
}
_NUM = {
    "subject_speed": "sa",
    "object_speed": "sb",
    "subject_velocity_x": "avx",
    "subject_velocity_y": "avy",
    "object_velocity_x": "bvx",
    "object_velocity_y": "bvy",
    "subject_radial_speed": "rs",
    "object_radial_speed": "ro",
    "distance_change": "distance_change",
    "decreasing_fraction": "decreasing_fraction",
    "increasing_fraction": "increasing_fraction",
    "direction_cosine": "cosine",
    "path_distance": "path_distance",
    "middle_distance": "d3",
}

SQL = {
    "tp_tracklet_windows": sql(
        f"""SELECT token, scene_token, sequence, instance_token, label, dynamic, start_sample_index,
  start_sample_index+2 AS middle_sample_index, start_sample_index+4 AS end_sample_index,
  array_to_string(annotation_tokens, ',') AS annotation_tokens, array_to_string(frames, ',') AS raw_frame_indices,
  array_to_string(times, ',') AS timestamps_ns, {r6('duration_seconds', 'duration_seconds')},
  {r6('velocity_x', 'velocity_x')}, {r6('velocity_y', 'velocity_y')}, {r6('velocity_z', 'velocity_z')}, {r6('speed', 'speed')} FROM trk"""
    ),
    "tp_candidate_pairs": sql(
        f"SELECT scene_token, start_sample_index, a_token, b_token, {r6('d3', 'middle_distance')} FROM tp_pair"
    ),
    "tp_distance_trend": sql(
        f"""SELECT a_token, b_token, {', '.join(r6(f'd{i+1}', f'distance_{i}') for i in range(5))},
  {r6('distance_change', 'distance_change')}, {r6('decreasing_fraction', 'decreasing_fraction')},
  {r6('increasing_fraction', 'increasing_fraction')} FROM tp_meas"""
    ),
    "tp_radial_speed": sql(
        f"SELECT a_token, b_token, {r6('rs', 'subject_radial_speed')}, {r6('ro', 'object_radial_speed')} FROM tp_meas"
    ),
    "tp_direction_cosine": sql(f"SELECT a_token, b_token, {r6('cosine', 'direction_cosine')} FROM tp_meas"),
    "tp_path_distance": sql(f"SELECT a_token, b_token, {r6('path_distance', 'path_distance')} FROM tp_meas"),
    "tp_visibility": sql(
        "SELECT a_token, b_token, a_vis AS subject_visible_steps, b_vis AS object_visible_steps, "
        "ab_vis AS joint_visible_steps FROM tp_pair"
    ),
    "tp_review_eligibility": sql(
        "SELECT a_token, b_token, review_reason = 'eligible' AS review_eligible, review_reason FROM tp_meas"
    ),
    "tp_predicates": sql(
        "SELECT a_token, b_token, approaching, moving_away, same_motion_direction, crossing_path FROM tp_lab"
    ),
    "tp_predicates_legacy": sql(
        "SELECT a_token, b_token, approaching, moving_away, same_motion_direction, crossing_path FROM tp_old"
    ),
    "tp_relations": sql(
        f"""SELECT token, scene_token, sequence, start_sample_index, start_sample_index+2 AS middle_sample_index,
  frames[3] AS middle_raw_frame_index, a_token AS subject_tracklet, b_token AS object_tracklet, a_label AS subject_label,
  b_label AS object_label, toward AS subject_motion_toward_object, away AS subject_motion_away_from_object,
  falling AS pair_distance_decreasing, rising AS pair_distance_increasing, toward AND falling AS approaching_agreement,
  away AND rising AS moving_away_agreement, ab_vis AS joint_visible_steps, review_reason, no_relation, supervised_eligible,
  {', '.join(r6(e, n) for n, e in _NUM.items())}, array_to_string(frames, ',') AS raw_frame_indices, positive_predicates
FROM tp_rel"""
    ),
    "tp_symmetry_check": sql(
        """WITH dmg AS (SELECT a_token, b_token, same_motion_direction AND a_label <> 'c2' AS smd, crossing_path AS cp FROM tp_rel
    WHERE NOT (a_label = 'c1' AND b_label = 'unknown'))
SELECT CASE WHEN r.a_token IS NULL THEN 'missing_reverse_pair' ELSE 'symmetric_label_mismatch' END AS error, count(*) AS violations
FROM dmg h LEFT JOIN dmg r ON h.a_token = r.b_token AND h.b_token = r.a_token
WHERE r.a_token IS NULL OR h.smd <> r.smd OR h.cp <> r.cp GROUP BY 1"""
    ),
    "tp_statistics": sql(
        "SELECT 'tracklet_windows' AS counter, count(*) AS value FROM trk "
        "UNION ALL SELECT 'tracklet_instances', count(DISTINCT instance_token) FROM trk "
        "UNION ALL SELECT 'dynamic_tracklet_windows', count(*) FROM trk WHERE dynamic "
        + " ".join(f"UNION ALL SELECT '{n}', count(*) FROM tp_rel WHERE {c}" for n, c in _COUNTERS.items())
    ),
}
