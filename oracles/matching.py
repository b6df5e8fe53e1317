"""SQL for the queries on matching, tracks and recovery."""

from oracles.base import cte, r6, sql

cte("cmp", "SELECT * FROM feat WHERE complete")
cte(
    "msrc",
    """SELECT f.sequence, p.token AS grp, f.feature_row AS source, f.identity, f.center_x, f.center_y
FROM cmp f JOIN smp p ON p.token = f.sample_token WHERE p.next <> ''""",
)
cte(
    "mtgt",
    """SELECT f.sequence, p.token AS grp, f.feature_row AS target, f.identity, f.center_x, f.center_y
FROM cmp f JOIN smp p ON p.next = f.sample_token WHERE p.next <> ''""",
)
_DIST = "sqrt((s.center_x-t.center_x)*(s.center_x-t.center_x)+(s.center_y-t.center_y)*(s.center_y-t.center_y))"
cte("psc", f"SELECT s.sequence, s.grp, source, target, 5.0::DOUBLE - {_DIST} AS score FROM msrc s JOIN mtgt t USING (grp) WHERE {_DIST} <= 15")
cte("mtru", "SELECT s.sequence, s.grp, source, target FROM msrc s JOIN mtgt t ON s.grp = t.grp AND s.identity = t.identity")
cte(
    "chs",
    """SELECT sequence, grp, source, target, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, bin, target) AS rn
  FROM (SELECT sequence, grp, source, target, score, 0 AS bin FROM psc UNION ALL SELECT sequence, grp, source, NULL, 0.0::DOUBLE, 1 FROM msrc)) WHERE rn = 1""",
)
cte(
    "cht",
    """SELECT sequence, grp, target, source, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, bin, source) AS rn
  FROM (SELECT sequence, grp, target, source, score, 0 AS bin FROM psc UNION ALL SELECT sequence, grp, target, NULL, 0.0::DOUBLE, 1 FROM mtgt)) WHERE rn = 1""",
)
cte("mut", "SELECT s.sequence, s.grp, s.source, s.target, s.score FROM chs s JOIN cht t ON s.source = t.source AND s.target = t.target")


def _tracks(name: str, links: str) -> None:
    cte(
        f"{name}_walk",
        f"""SELECT feature_row AS row_id, feature_row AS head FROM cmp WHERE feature_row NOT IN (SELECT target FROM {links})
UNION ALL SELECT l.target, w.head FROM {name}_walk w JOIN {links} l ON l.source = w.row_id""",
    )
    cte(
        name,
        f"""SELECT f.feature_row AS row_id, coalesce(t.track_id, -1) AS track_id FROM feat f
LEFT JOIN (SELECT row_id, dense_rank() OVER (ORDER BY head) - 1 AS track_id FROM {name}_walk) t ON t.row_id = f.feature_row""",
    )


_tracks("trks", "mut")
cte("mem", "SELECT t.track_id, f.* FROM trks t JOIN feat f ON f.feature_row = t.row_id WHERE t.track_id >= 0")
cte(
    "cnt",
    """
SELECT d.sequence, count(DISTINCT d.grp) AS association_groups, count(*) AS association_decisions, count(*) FILTER (WHERE ok) AS association_correct,
  (SELECT count(*) FROM mtru m WHERE m.sequence = d.sequence) AS true_links, (SELECT count(*) FROM mut m WHERE m.sequence = d.sequence) AS predicted_links,
  (SELECT count(*) FROM mut m JOIN mtru r ON r.source = m.source AND r.target = m.target WHERE m.sequence = d.sequence) AS correct_links
FROM (SELECT c.sequence, c.grp, c.target IS NOT DISTINCT FROM m.target AS ok FROM chs c LEFT JOIN mtru m ON m.source = c.source
      UNION ALL SELECT c.sequence, c.grp, c.source IS NOT DISTINCT FROM m.source FROM cht c LEFT JOIN mtru m ON m.target = c.target) d
GROUP BY d.sequence""",
)
_RATIOS = f"""{r6('association_correct/greatest(association_decisions,1)', 'association_accuracy')},
  {r6('correct_links/greatest(predicted_links,1)', 'link_precision')}, {r6('correct_links/greatest(true_links,1)', 'link_recall')}"""

# Relations on predicted tracks: one row per relation and step.
cte(
    "prl",
    """
SELECT token AS relation_id, sequence, group_id_, s_rows, t_rows, frames, coalesce(a.track_id, -1) AS st, coalesce(b.track_id, -1) AS tt
FROM (SELECT *, scene_token || ':' || start_sample_index AS group_id_ FROM tixall WHERE state = 'kept') r
LEFT JOIN trks a ON a.row_id = r.s_rows[3] LEFT JOIN trks b ON b.row_id = r.t_rows[3]""",
)
cte(
    "pst",
    """
SELECT p.relation_id, i, p.frames[i] AS frame, coalesce(a.feature_row, -1) AS ps, coalesce(b.feature_row, -1) AS pt,
       a.feature_row IS NOT NULL AND b.feature_row IS NOT NULL AS joint
FROM prl p, range(1, 6) r(i)
LEFT JOIN mem a ON a.track_id = p.st AND a.raw_frame_index = p.frames[i]
LEFT JOIN mem b ON b.track_id = p.tt AND b.raw_frame_index = p.frames[i]""",
)
cte(
    "pav",
    """
SELECT *, CASE WHEN st < 0 AND tt < 0 THEN 'both_middle_rows_unassigned' WHEN st < 0 THEN 'source_middle_row_unassigned'
  WHEN tt < 0 THEN 'target_middle_row_unassigned' WHEN st = tt THEN 'source_target_track_collision'
  WHEN NOT jm[3] THEN 'middle_step_missing' WHEN joint_steps < 3 THEN 'fewer_than_three_joint_steps' ELSE 'available' END AS unavailable_reason
FROM (SELECT p.*, q.ps, q.pt, q.jm, q.joint_steps FROM prl p JOIN (
  SELECT relation_id, list(ps ORDER BY i) AS ps, list(pt ORDER BY i) AS pt, list(joint ORDER BY i) AS jm, count(*) FILTER (WHERE joint) AS joint_steps
  FROM pst GROUP BY relation_id) q USING (relation_id))""",
)
cte(
    "pus",
    """
SELECT relation_id, i, CASE WHEN jm[3] THEN ps[i] ELSE s_rows[i] END AS su, CASE WHEN jm[3] THEN pt[i] ELSE t_rows[i] END AS tu,
       CASE WHEN jm[3] THEN jm[i] ELSE i = 3 AND s_rows[3] >= 0 AND t_rows[3] >= 0 END AS used, frames[i] AS frame
FROM pav, range(1, 6) r(i)""",
)
cte(
    "pvl",
    """
SELECT u.relation_id, u.i, u.frame, a.center_x AS sx, a.center_y AS sy, b.center_x AS tx, b.center_y AS ty
FROM pus u JOIN feat a ON a.feature_row = u.su JOIN feat b ON b.feature_row = u.tu WHERE u.used""",
)
_FILL = ", ".join(
    f"CASE WHEN l.i IS NULL THEN r.{c} WHEN r.i IS NULL OR r.i = l.i THEN l.{c} ELSE (r.{c}-l.{c})/(r.i-l.i)*(u.i-l.i)+l.{c} END AS {c}"
    for c in ("sx", "sy", "tx", "ty")
)
cte(
    "pfl",
    f"""
SELECT u.relation_id, u.i, u.used, u.frame, {_FILL}
FROM (SELECT p.*, (SELECT max(v.i) FROM pvl v WHERE v.relation_id = p.relation_id AND v.i <= p.i) AS li,
             (SELECT min(v.i) FROM pvl v WHERE v.relation_id = p.relation_id AND v.i >= p.i) AS ri FROM pus p) u
LEFT JOIN pvl l ON l.relation_id = u.relation_id AND l.i = u.li LEFT JOIN pvl r ON r.relation_id = u.relation_id AND r.i = u.ri""",
)
cte("pdv", "SELECT relation_id, i, sqrt((sx-tx)*(sx-tx)+(sy-ty)*(sy-ty)) AS d FROM pvl")
cte(
    "pds",
    """
SELECT u.relation_id, u.i, CASE WHEN l.i IS NULL THEN r.d WHEN r.i IS NULL OR r.i = l.i THEN l.d ELSE (r.d-l.d)/(r.i-l.i)*(u.i-l.i)+l.d END AS d
FROM (SELECT p.*, (SELECT max(v.i) FROM pvl v WHERE v.relation_id = p.relation_id AND v.i <= p.i) AS li,
             (SELECT min(v.i) FROM pvl v WHERE v.relation_id = p.relation_id AND v.i >= p.i) AS ri FROM pus p) u
LEFT JOIN pdv l ON l.relation_id = u.relation_id AND l.i = u.li LEFT JOIN pdv r ON r.relation_id = u.relation_id AND r.i = u.ri""",
)
cte(
    "pgv",
    """
SELECT relation_id, count(*)/5.0::DOUBLE AS visible_fraction, max(frame)-min(frame) AS secs,
  arg_max(sx,i)-arg_min(sx,i) AS msx, arg_max(sy,i)-arg_min(sy,i) AS msy, arg_max(tx,i)-arg_min(tx,i) AS mtx, arg_max(ty,i)-arg_min(ty,i) AS mty,
  max(sx) FILTER (WHERE i = 3) AS sx3, max(sy) FILTER (WHERE i = 3) AS sy3, max(tx) FILTER (WHERE i = 3) AS tx3, max(ty) FILTER (WHERE i = 3) AS ty3
FROM pvl GROUP BY relation_id""",
)
cte(
    "pgd",
    """
SELECT relation_id, max(d) FILTER (WHERE i=1) AS d1, max(d) FILTER (WHERE i=2) AS d2, max(d) FILTER (WHERE i=3) AS d3,
  max(d) FILTER (WHERE i=4) AS d4, max(d) FILTER (WHERE i=5) AS d5 FROM pds GROUP BY relation_id""",
)
cte(
    "pgm",
    """
SELECT *, sqrt(svx*svx+svy*svy) AS sps, sqrt(tvx*tvx+tvy*tvy) AS spt,
  d5-d1 AS change, ((d2-d1 <= -0.05)::INT+(d3-d2 <= -0.05)::INT+(d4-d3 <= -0.05)::INT+(d5-d4 <= -0.05)::INT)/4.0::DOUBLE AS dec,
  ((d2-d1 >= 0.05)::INT+(d3-d2 >= 0.05)::INT+(d4-d3 >= 0.05)::INT+(d5-d4 >= 0.05)::INT)/4.0::DOUBLE AS inc
FROM (SELECT v.*, d1, d2, d3, d4, d5, CASE WHEN secs > 0 THEN msx/secs ELSE 0.0::DOUBLE END AS svx, CASE WHEN secs > 0 THEN msy/secs ELSE 0.0::DOUBLE END AS svy,
        CASE WHEN secs > 0 THEN mtx/secs ELSE 0.0::DOUBLE END AS tvx, CASE WHEN secs > 0 THEN mty/secs ELSE 0.0::DOUBLE END AS tvy
      FROM pgv v JOIN pgd USING (relation_id))""",
)
cte(
    "psg",
    """
SELECT * FROM (SELECT relation_id, sx AS x1_, sy AS y1_, lead(sx) OVER w AS x2_, lead(sy) OVER w AS y2_, tx AS u1, ty AS v1, lead(tx) OVER w AS u2, lead(ty) OVER w AS v2
  FROM pvl WINDOW w AS (PARTITION BY relation_id ORDER BY i)) WHERE x2_ IS NOT NULL""",
)


def _psd(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    n = f"(({bx}-{ax})**2+({by}-{ay})**2)"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/nullif({n},0)))"
    return f"""CASE WHEN {n} <= 1e-12 THEN sqrt(({px}-{ax})**2+({py}-{ay})**2)
  ELSE sqrt(({px}-({ax}+{t}*({bx}-{ax})))**2+({py}-({ay}+{t}*({by}-{ay})))**2) END"""


def _or(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    return f"(({bx}-{ax})*({cy}-{ay})-({by}-{ay})*({cx}-{ax}))"


_A, _B = ("a.x1_", "a.y1_"), ("a.x2_", "a.y2_")
_C, _D = ("b.u1", "b.v1"), ("b.u2", "b.v2")
cte(
    "ppd",
    f"""
SELECT a.relation_id, min(CASE WHEN {_or(*_A, *_B, *_C)}*{_or(*_A, *_B, *_D)} <= 0 AND {_or(*_C, *_D, *_A)}*{_or(*_C, *_D, *_B)} <= 0 THEN 0.0::DOUBLE
  ELSE least({_psd(*_A, *_C, *_D)}, {_psd(*_B, *_C, *_D)}, {_psd(*_C, *_A, *_B)}, {_psd(*_D, *_A, *_B)}) END) AS path
FROM psg a JOIN psg b USING (relation_id) GROUP BY 1""",
)

# Greedy choice in order, one step per rank and group.
cte("mrg", "SELECT *, least(score, score) AS margin FROM psc")
cte(
    "fbc",
    """
SELECT m.mode, p.* FROM mrg p, (VALUES ('one_way'), ('all')) m(mode)
WHERE p.source NOT IN (SELECT source FROM mut) AND p.target NOT IN (SELECT target FROM mut)
  AND (m.mode = 'all' OR EXISTS (SELECT 1 FROM chs c WHERE c.source = p.source AND c.target = p.target)
       OR EXISTS (SELECT 1 FROM cht c WHERE c.source = p.source AND c.target = p.target))""",
)


def _greedy(name: str, rows: str, keys: str) -> None:
    """`rows` has the key columns, source, target, margin and score."""
    cte(
        f"{name}_ord",
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY margin DESC, score DESC, source, target) AS rn FROM ({rows})",
    )
    each = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"c.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    free = "NOT list_contains(g.us, c.source) AND NOT list_contains(g.ut, c.target)"
    cte(
        f"{name}_rec",
        f"""SELECT {each}, rn, [source] AS us, [target] AS ut, source, target, true AS ok FROM {name}_ord c WHERE rn = 1
UNION ALL SELECT {each}, c.rn, CASE WHEN {free} THEN list_append(g.us, c.source) ELSE g.us END,
  CASE WHEN {free} THEN list_append(g.ut, c.target) ELSE g.ut END, c.source, c.target, {free}
FROM {name}_rec g JOIN {name}_ord c ON {same} AND c.rn = g.rn + 1""",
    )
    cte(name, f"SELECT o.* FROM {name}_rec c JOIN {name}_ord o USING ({keys}, rn) WHERE c.ok")


_greedy("gall", "SELECT * FROM mrg WHERE margin >= -5", "grp")
_greedy("grec", "SELECT * FROM fbc WHERE mode = 'all' AND margin >= -5", "grp")
_greedy("gswp", "SELECT f.*, t.threshold FROM fbc f, (VALUES (-5.0::DOUBLE), (-2.0), (0.0), (2.0)) t(threshold) WHERE margin >= threshold", "mode, threshold, grp")
cte("rlk", "SELECT sequence, source, target, false AS fallback FROM mut UNION ALL SELECT sequence, source, target, true FROM grec")
_tracks("rtrk", "rlk")
cte(
    "swl",
    """SELECT m.mode, t.threshold, sequence, source, target, false AS fallback FROM mut, (VALUES ('one_way'), ('all')) m(mode), (VALUES (-5.0::DOUBLE), (-2.0), (0.0), (2.0)) t(threshold)
UNION ALL SELECT mode, threshold, sequence, source, target, true FROM gswp""",
)


def _quality(links: str, by: str) -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT *, {r6('correct_links/greatest(links,1)', 'precision')}, {r6('correct_links/greatest(true_links,1)', 'recall')}
FROM (SELECT {lead}count(*) FILTER (WHERE NOT fallback) AS mutual_links, count(*) FILTER (WHERE NOT fallback AND hit) AS correct_mutual_links,
  count(*) FILTER (WHERE fallback) AS fallback_links, count(*) FILTER (WHERE fallback AND hit) AS correct_fallback_links,
  count(*) AS links, count(*) FILTER (WHERE hit) AS correct_links, (SELECT count(*) FROM mtru) AS true_links
FROM (SELECT l.*, EXISTS (SELECT 1 FROM mtru m WHERE m.source = l.source AND m.target = l.target) AS hit FROM {links} l) {group})"""


def _sinkhorn() -> str:
    steps = [
        """k0 AS (SELECT sequence, grp, i, j, s/0.1::DOUBLE AS v FROM (SELECT sequence, grp, source AS i, target AS j, score AS s FROM psc
  UNION ALL SELECT sequence, grp, source, -1, 0.0::DOUBLE FROM msrc UNION ALL SELECT sequence, grp, -1, target, 0.0::DOUBLE FROM mtgt
  UNION ALL SELECT sequence, grp, -1, -1, 0.0::DOUBLE FROM (SELECT sequence, grp FROM msrc UNION SELECT sequence, grp FROM mtgt)))"""
    ]
    for n in range(16):
        axis = "i" if n % 2 == 0 else "j"
        steps.append(
            f"""k{n+1} AS (SELECT sequence, grp, i, j, v - (top + ln(sum(exp(v-top)) OVER (PARTITION BY grp, {axis}))) AS v
  FROM (SELECT *, max(v) OVER (PARTITION BY grp, {axis}) AS top FROM k{n}))"""
        )
    return "WITH " + ",\n".join(steps) + f'\nSELECT sequence, grp AS "group", i AS source, j AS target, {r6("exp(v)", "weight")} FROM k16'


_G = 'grp AS "group"'
SQL = {
    "tk_argmax": sql(
        f"""SELECT sequence, {_G}, 'source' AS side, source AS row, coalesce(target, -1) AS choice, {r6('score', 'score')} FROM chs
UNION ALL SELECT sequence, {_G}, 'target', target, coalesce(source, -1), {r6('score', 'score')} FROM cht"""
    ),
    "tk_mutual_matches": sql(f"SELECT sequence, {_G}, source, target, {r6('score', 'score')} FROM mut"),
    "tk_link_confidence": sql(
        f"SELECT source, target, {r6('1/(1+exp(-greatest(-30, least(30, score))))', 'confidence')} FROM mut"
    ),
    "tk_link_checks": sql(
        """WITH e AS (SELECT a.sample_index AS ai, b.sample_index AS bi, a.scene_token = b.scene_token AS same FROM mut m
  JOIN feat a ON a.feature_row = m.source JOIN feat b ON b.feature_row = m.target)
SELECT 'link_crosses_scene' AS rule, count(*) FILTER (WHERE NOT same OR ai//3 <> bi//3) AS violations FROM e
UNION ALL SELECT 'link_not_adjacent', count(*) FILTER (WHERE bi + bi//7 <> ai + ai//7 + 1) FROM e"""
    ),
    "tk_components": sql("SELECT row_id AS row, track_id FROM trks"),
    "tk_components_merged": sql("SELECT row_id AS row, track_id FROM trks"),
    "tk_duplicate_check": sql(
        """SELECT track_id, scene_token, sample_index//2 AS sample_index, count(*) AS rows FROM mem GROUP BY 1, 2, 3 HAVING count(*) > 1"""
    ),
    "tk_purity": sql(
        f"""SELECT track_id, sum(n)::BIGINT AS length, {r6('max(n)/sum(n)', 'purity')}
FROM (SELECT track_id, identity, count(*) AS n FROM mem GROUP BY ALL) GROUP BY track_id"""
    ),
    "tk_report": sql(
        f"""SELECT c.*, {_RATIOS}, t.predicted_tracks, {r6('t.ml', 'mean_track_length')}, t.maximum_track_length, {r6('t.pu', 'identity_purity')}
FROM cnt c JOIN (SELECT sequence, count(*) AS predicted_tracks, avg(length) AS ml, max(length)::BIGINT AS maximum_track_length, avg(purity) AS pu
  FROM (SELECT sequence, track_id, sum(n) AS length, max(n)/sum(n) AS purity
        FROM (SELECT sequence, track_id, identity, count(*) AS n FROM mem GROUP BY ALL) GROUP BY ALL) GROUP BY sequence) t USING (sequence)"""
    ),
    "tk_association_summary": sql(
        f"""SELECT *, {_RATIOS} FROM (SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('association_groups', 'association_decisions', 'association_correct', 'true_links', 'predicted_links', 'correct_links'))} FROM cnt)"""
    ),
    "tk_members": sql("SELECT track_id, raw_frame_index AS frame, feature_row AS row FROM mem"),
    "tk_predicted_rows": sql(
        """SELECT relation_id, st AS source_track, tt AS target_track, array_to_string(ps, ',') AS predicted_source_rows,
  array_to_string(pt, ',') AS predicted_target_rows FROM pav"""
    ),
    "tk_availability": sql(
        "SELECT relation_id, joint_steps, unavailable_reason, unavailable_reason = 'available' AS available FROM pav"
    ),
    "tk_availability_by_part": sql(
        """SELECT sequence, count(*) AS relations, count(*) FILTER (WHERE unavailable_reason = 'available') AS available,
  count(*) FILTER (WHERE unavailable_reason <> 'available') AS unavailable FROM pav GROUP BY sequence"""
    ),
    "tk_fallback_rows": sql(
        """SELECT relation_id, string_agg(su::VARCHAR, ',' ORDER BY i) AS source_used_rows, string_agg(tu::VARCHAR, ',' ORDER BY i) AS target_used_rows,
  string_agg(used::VARCHAR, ',' ORDER BY i) AS used_mask FROM pus GROUP BY relation_id"""
    ),
    "tk_interpolate": sql(
        "SELECT relation_id, "
        + ", ".join(
            r6(f"max({e[0]}{a}) FILTER (WHERE i = {i+1})", f"{e}_{a}{i}")
            for e in ("source", "target")
            for a in "xy"
            for i in range(5)
        )
        + " FROM pfl GROUP BY relation_id"
    ),
    "tk_predicted_geometry": sql(
        f"""SELECT m.relation_id, {', '.join(r6(f'd{i+1}', f'distance_{i}') for i in range(5))}, {r6('change', 'distance_change')},
  {r6('dec', 'decreasing_fraction')}, {r6('inc', 'increasing_fraction')}, {r6('sps', 'source_speed')}, {r6('spt', 'target_speed')},
  {r6('svx', 'source_velocity_x')}, {r6('svy', 'source_velocity_y')}, 0.0::DOUBLE AS source_velocity_z,
  {r6('tvx', 'target_velocity_x')}, {r6('tvy', 'target_velocity_y')}, 0.0::DOUBLE AS target_velocity_z,
  {r6('CASE WHEN d3 > 1e-6 THEN svx*((tx3-sx3)/d3)+svy*((ty3-sy3)/d3) ELSE 0 END', 'source_radial_speed')},
  {r6('CASE WHEN d3 > 1e-6 THEN tvx*-((tx3-sx3)/d3)+tvy*-((ty3-sy3)/d3) ELSE 0 END', 'target_radial_speed')},
  {r6('CASE WHEN sps >= 0.5 AND spt >= 0.5 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (svx*tvx+svy*tvy)/(sps*spt))) ELSE 0 END', 'direction_cosine')},
  {r6('d3', 'middle_distance')}, {r6('visible_fraction', 'visible_fraction')},
  {r6('CASE WHEN sps >= 0.5 AND spt >= 0.5 THEN p.path ELSE 0 END', 'path_distance')}
FROM pgm m LEFT JOIN ppd p USING (relation_id)"""
    ),
    "tk_sinkhorn": sql(_sinkhorn()),
    "rc_margin": sql(f"SELECT source, target, {r6('margin', 'margin')} FROM mrg"),
    "rc_fallback_candidates": sql(f"SELECT mode, source, target, {r6('margin', 'margin')} FROM fbc WHERE margin >= 0"),
    "rc_greedy_links": sql(f"SELECT sequence, {_G}, source, target, {r6('margin', 'margin')} FROM gall"),
    "rc_recover_tracks": sql("SELECT row_id AS row, track_id FROM rtrk"),
    "rc_link_quality": sql(_quality("rlk", "")),
    "rc_sweep": sql(_quality("swl", "mode, threshold")),
    "rc_select_variant": sql(
        f"""WITH q AS ({_quality('swl', 'mode, threshold')})
SELECT mode, threshold, recall AS macro_f1, precision AS mean_average_precision, {r6('links/true_links', 'coverage')}, variant_index
FROM (SELECT *, (CASE mode WHEN 'one_way' THEN 0 ELSE 4 END + list_position([-5.0, -2.0, 0.0, 2.0], threshold))::BIGINT AS variant_index FROM q)
ORDER BY correct_links/true_links DESC, correct_links/links DESC, links/true_links DESC, variant_index LIMIT 1"""
    ),
    "rc_frozen_check": sql(
        f"""WITH q AS ({_quality('swl', 'mode, threshold')}),
b AS (SELECT mode, threshold FROM q ORDER BY correct_links DESC, threshold DESC, mode LIMIT 1)
SELECT 'selection_is_frozen_rule' AS rule, count(*) FILTER (WHERE mode <> 'all' OR threshold <> 0) AS violations FROM b
UNION ALL SELECT 'test_sequences_exact', count(*) FILTER (WHERE sequence NOT IN (0, 1, 2, 7)) + 4 - count(*) FILTER (WHERE sequence IN (0, 1, 2, 7))
FROM (SELECT DISTINCT sequence FROM obs)"""
    ),
    "rc_totals": sql(
        f"""SELECT mutual_links, fallback_links, correct_fallback_links, links, correct_links, true_links, precision, recall FROM ({_quality('rlk', '')})"""
    ),
}
