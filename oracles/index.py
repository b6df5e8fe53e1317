"""SQL for the queries on feature rows joined to relations and candidates."""

from oracles.base import cte, r6, sql

_SP = "left_of in_front_of near overlapping occluding".split()
_TP = "approaching moving_away same_motion_direction".split()
cte("known", "SELECT * FROM feat WHERE supervised_eligible")


def _tracklet_rows(features: str) -> str:
    return f"""SELECT t.token AS tracklet, list(coalesce(f.feature_row, -1) ORDER BY s.i) AS rows,
       list(coalesce(f.complete, false) ORDER BY s.i) AS complete
FROM trk t, range(1, 6) s(i) LEFT JOIN {features} f ON f.annotation_token = t.annotation_tokens[s.i] GROUP BY t.token"""


def _ends(rows: str) -> str:
    return f"""SELECT *, CASE WHEN ns < 3 OR nt < 3 THEN 'insufficient_tracklets'
       WHEN nj < 3 OR NOT jm[3] THEN 'non_multimodal_tracklets' ELSE 'kept' END AS state
FROM (SELECT *, len(list_filter(s_rows, lambda x: x >= 0)) AS ns, len(list_filter(t_rows, lambda x: x >= 0)) AS nt,
             len(list_filter(jm, lambda x: x)) AS nj
      FROM (SELECT r.*, a.rows AS s_rows, b.rows AS t_rows, [a.complete[i] AND b.complete[i] FOR i IN range(1, 6)] AS jm
            FROM tp_rel r JOIN {rows} a ON a.tracklet = r.a_token JOIN {rows} b ON b.tracklet = r.b_token))"""


cte("trr", _tracklet_rows("known"))
cte("trall", _tracklet_rows("feat"))
cte("tix", _ends("trr"))
cte("tixall", _ends("trall"))
cte(
    "asts",
    """
SELECT e.*, f.feature_row, f.complete FROM (
  SELECT DISTINCT source_sample, target_sample, 'source' AS side, source_token AS annotation_token FROM as_all WHERE supervised_eligible AND source_token <> ''
  UNION ALL SELECT DISTINCT source_sample, target_sample, 'target', target_token FROM as_all WHERE supervised_eligible AND target_token <> '') e
LEFT JOIN feat f USING (annotation_token)""",
)
cte(
    "asgr",
    """
SELECT source_sample, target_sample, bool_or(feature_row IS NULL) AS missing, count(*) FILTER (WHERE side = 'source' AND complete) AS ns,
       count(*) FILTER (WHERE side = 'target' AND complete) AS nt FROM asts GROUP BY ALL""",
)
cte(
    "asix",
    """
SELECT s.source_sample, s.target_sample, s.side, s.annotation_token, s.feature_row, g.ns, g.nt,
       row_number() OVER (PARTITION BY s.source_sample, s.target_sample, s.side ORDER BY s.feature_row) - 1 AS idx
FROM asts s JOIN asgr g USING (source_sample, target_sample) WHERE s.complete AND NOT g.missing AND g.ns > 0 AND g.nt > 0""",
)
cte(
    "asch",
    """
SELECT i.source_sample, i.target_sample, i.side, i.annotation_token, i.feature_row, i.idx,
       coalesce((SELECT o.idx FROM as_obj p JOIN asix o ON o.source_sample = p.source_sample AND o.side <> i.side
                 AND o.annotation_token = CASE i.side WHEN 'source' THEN p.target_token ELSE p.source_token END
                 WHERE p.is_match AND p.supervised_eligible AND p.source_sample = i.source_sample
                   AND i.annotation_token = CASE i.side WHEN 'source' THEN p.source_token ELSE p.target_token END),
                CASE i.side WHEN 'source' THEN i.nt ELSE i.ns END) AS choice
FROM asix i""",
)
_SG = {
    **{c: c for c in "delta_x delta_y delta_z center_distance box_distance bev_intersection bev_iou vertical_overlap image_overlap".split()},
    "log_volume_ratio": "ln(greatest(volume_ratio, 1e-8))",
    "log_height_ratio": "ln(greatest(height_ratio, 1e-8))",
    "lateral_margin": "lateral_margin",
    "longitudinal_margin": "longitudinal_margin",
    "subject_masked": "(subject_mask_pixels > 0)::INT",
    "object_masked": "(object_mask_pixels > 0)::INT",
    "occlusion_supported": "occlusion_mask_supported::INT",
}
_TG = (
    "d1 d2 d3 d4 d5 distance_change decreasing_fraction increasing_fraction sa sb avx avy 0 bvx bvy 0 rs ro cosine d3 "
    "a_vis/5.0 b_vis/5.0 ab_vis/5.0 coalesce(path_distance,0)"
).split()
_AG = [
    *[f"t.center_{a}-s.center_{a}" for a in "xyz"],
    "dist",
    *[f"(t.center_{a}-s.center_{a})/greatest(dist,1e-6)" for a in "xyz"],
    *[f"greatest(t.{n},1e-4)-greatest(s.{n},1e-4)" for n in ("length", "width", "height")],
    *[f"ln(greatest(t.{n},1e-4)/greatest(s.{n},1e-4))" for n in ("length", "width", "height")],
    *[f"(s.m{i} AND t.m{i})::INT" for i in (1, 2, 3)],
]


def _f4(expr: str, name: str) -> str:
    return f"round(CAST(CAST(CAST({expr} AS DOUBLE) AS FLOAT) AS DOUBLE), 4) + 0.0 AS {name}"


def _pos(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS predicate, count(*) AS total, count(*) FILTER (WHERE {n}) AS positives FROM {table}" for n in names
    )


def _audit(rows: str, counters: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT p.split, coalesce(r.sequence::VARCHAR, 'ALL') AS sequence, '{n}' AS counter, count(*) FILTER (WHERE {c}) AS value
  FROM {rows} r JOIN split p ON p.sequence = r.sequence GROUP BY GROUPING SETS ((p.split), (p.split, r.sequence))"""
        for n, c in counters.items()
    )


cte("sixall", "SELECT r.* FROM sp_rel r JOIN feat a ON a.annotation_token = r.a_token AND a.complete JOIN feat b ON b.annotation_token = r.b_token AND b.complete")
cte("asgs", "SELECT DISTINCT i.source_sample, s.sequence FROM asix i JOIN smp s ON s.token = i.source_sample")
cte("tixk", "SELECT * FROM tixall WHERE state = 'kept'")
_AUDIT = " UNION ALL ".join(
    [
        _audit(
            "feat",
            {
                "objects": "true",
                "complete_objects": "complete",
                **{f"class_{c}": f"complete AND category = {c}" for c in range(12)},
            },
        ),
        _audit("sixall", {"spatial_examples": "true", **{p: p for p in _SP}}),
        _audit("tixk", {"temporal_examples": "true", **{p: p for p in _TP}}),
        _audit("asgs", {"association_sample_pairs": "true"}),
    ]
)

_ERRORS = f"""SELECT w.split, CASE WHEN w.counter LIKE '%examples' OR w.counter LIKE 'association%' THEN 'empty_task' ELSE 'unsupported_predicate' END AS error, w.counter
FROM w LEFT JOIN aud a ON a.split = w.split AND a.counter = w.counter AND a.sequence = 'ALL' WHERE coalesce(a.value, 0) = 0"""
_WANTED = f"""WITH aud AS ({_AUDIT}), asked AS (SELECT DISTINCT split FROM split UNION SELECT 'unassigned' AS split),
w AS (SELECT split, counter FROM asked, (VALUES {', '.join(f"('{n}')" for n in ['spatial_examples', 'temporal_examples', 'association_sample_pairs', *_SP, *_TP])}) v(counter))"""

_LOOSE = {
    "spatial_examples": "(SELECT r.*, NOT (a.complete AND b.complete) AS loose FROM sixall r JOIN feat a ON a.annotation_token = r.a_token JOIN feat b ON b.annotation_token = r.b_token)",
    "temporal_examples": "(SELECT *, NOT (nj >= 3 AND jm[3]) AS loose FROM tixk)",
    "association_sample_pairs": """(SELECT g.source_sample, g.sequence, bool_or(NOT f.complete) AS loose FROM asgs g JOIN asix i ON i.source_sample = g.source_sample
    JOIN feat f ON f.annotation_token = i.annotation_token GROUP BY ALL)""",
}
_CLASSES = {f"class_{c}": f"complete AND category = {c}" for c in range(26)}
_EACH = ["objects", "complete_objects", *_CLASSES, *_LOOSE, *_SP, *_TP, *[f"loose_{t}" for t in _LOOSE]]
_COUNTED = " UNION ALL ".join(
    [
        _audit("feat", {"objects": "true", "complete_objects": "complete", **_CLASSES}),
        *[_audit(rows, {t: "true", f"loose_{t}": "loose", **{p: p for p in names}}) for (t, rows), names in zip(_LOOSE.items(), (_SP, _TP, []), strict=True)],
    ]
)


def _names(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_WHOLE_AUDIT = f"""WITH aud AS ({_COUNTED}),
listed AS (SELECT split, sequence::VARCHAR AS sequence FROM split WHERE sequence IS NOT NULL UNION SELECT split, 'ALL' FROM split),
filled AS (SELECT l.split, l.sequence, c.counter, coalesce(a.value, 0)::DOUBLE AS value FROM listed l CROSS JOIN (SELECT unnest([{_names(_EACH)}]) AS counter) c
  LEFT JOIN aud a ON a.split = l.split AND a.sequence = l.sequence AND a.counter = c.counter),
err AS (SELECT s.split,
    (SELECT sum(value) FROM filled f WHERE f.split = s.split AND sequence = 'ALL' AND counter = 'objects') AS objects,
    (SELECT sum(value) FROM filled f WHERE f.split = s.split AND sequence = 'ALL' AND counter = 'complete_objects') AS complete_objects,
    (SELECT count(*) FROM filled f WHERE f.split = s.split AND sequence <> 'ALL' AND counter = 'objects' AND value = 0) AS missing_shards,
    (SELECT count(DISTINCT sequence) FROM filled f WHERE f.split = s.split AND sequence <> 'ALL' AND counter LIKE 'loose%' AND value > 0) AS loose_shards,
    (SELECT count(*) FROM filled f WHERE f.split = s.split AND sequence = 'ALL' AND counter IN ({_names(list(_LOOSE))}) AND value = 0) AS empty_tasks,
    (SELECT count(*) FROM filled f WHERE f.split = s.split AND sequence = 'ALL' AND counter IN ({_names([*_SP, *_TP])}) AND value = 0) AS unsupported_predicates
  FROM (SELECT DISTINCT split FROM split) s),
summed AS (SELECT *, missing_shards + loose_shards + empty_tasks + unsupported_predicates AS errors FROM err),
told AS (SELECT split, unnest(['complete_percent', 'missing_shards', 'loose_shards', 'empty_tasks', 'unsupported_predicates', 'errors', 'passed']) AS counter,
    unnest([CASE WHEN objects > 0 THEN 100.0::DOUBLE * complete_objects / objects ELSE 0 END, missing_shards, loose_shards, empty_tasks, unsupported_predicates, errors, (errors = 0)::INT]) AS value FROM summed
  UNION ALL SELECT 'ALL', unnest(['errors', 'passed']), unnest([coalesce(sum(errors), 0), (coalesce(sum(errors), 0) = 0)::INT]) FROM summed)
SELECT split, sequence, counter, value FROM filled UNION ALL SELECT split, 'ALL', counter, round(value::DOUBLE, 6) + 0.0::DOUBLE FROM told"""

SQL = {
    "ri_complete_rows": sql("SELECT feature_row, annotation_token, category FROM feat WHERE complete"),
    "ri_feature_timeline": sql("SELECT feature_row, sample_token, sample_index, timestamp_ns FROM feat"),
    "ri_modality_counts": sql(
        """SELECT 'objects' AS counter, count(*) AS value FROM feat UNION ALL SELECT 'rgb', count(*) FROM feat WHERE m1
UNION ALL SELECT 'lidar', count(*) FROM feat WHERE m2 UNION ALL SELECT 'text', count(*) FROM feat WHERE m3
UNION ALL SELECT 'complete', count(*) FROM feat WHERE complete"""
    ),
    "src_jsonl_metadata": sql(
        """WITH m AS (SELECT * FROM feat WHERE category <> 3)
SELECT 'feature_row_not_unique' AS rule, count(*) - count(DISTINCT feature_row) AS violations FROM m
UNION ALL SELECT 'first_row_not_zero', (min(feature_row) <> 0)::BIGINT FROM m
UNION ALL SELECT 'rows_not_dense', (max(feature_row) <> count(*) - 1)::BIGINT FROM m"""
    ),
    "ri_spatial": sql(
        f"""SELECT r.token, a.feature_row AS source_row, b.feature_row AS target_row, {', '.join(_SP)}, r.raw_frame_index, r.sample_token
FROM sp_rel r JOIN known a ON a.annotation_token = r.a_token JOIN known b ON b.annotation_token = r.b_token WHERE a.complete AND b.complete"""
    ),
    "ri_spatial_counts": sql(
        """WITH e AS (SELECT a.complete AS ac, b.complete AS bc FROM sp_rel r LEFT JOIN known a ON a.annotation_token = r.a_token
  LEFT JOIN known b ON b.annotation_token = r.b_token)
SELECT 'seen' AS counter, count(*) AS value FROM e UNION ALL SELECT 'kept', count(*) FROM e WHERE ac AND bc
UNION ALL SELECT 'missing_features', count(*) FROM e WHERE ac IS NULL OR bc IS NULL
UNION ALL SELECT 'non_multimodal_pairs', count(*) FROM e WHERE ac IS NOT NULL AND bc IS NOT NULL AND NOT (ac AND bc)"""
    ),
    "ri_spatial_geometry": sql(f"SELECT token, {', '.join(_f4(e, n) for n, e in _SG.items())} FROM sp_rel"),
    "ri_tracklet_rows": sql(
        "SELECT tracklet, array_to_string(rows, ',') AS rows, array_to_string(complete, ',') AS complete FROM trr"
    ),
    "ri_joint_mask": sql("SELECT token, array_to_string(jm, ',') AS joint_mask, state FROM tix"),
    "ri_temporal": sql(
        f"""SELECT token, scene_token || ':' || start_sample_index AS group_id, array_to_string(s_rows, ',') AS source_rows,
  array_to_string(t_rows, ',') AS target_rows, array_to_string(jm, ',') AS source_mask, {', '.join(_TP)} FROM tix WHERE state = 'kept'"""
    ),
    "ri_temporal_counts": sql(
        """SELECT 'seen' AS counter, count(*) AS value FROM tix UNION ALL SELECT 'kept', count(*) FROM tix WHERE state = 'kept'
UNION ALL SELECT 'insufficient_tracklets', count(*) FROM tix WHERE state = 'insufficient_tracklets'
UNION ALL SELECT 'non_multimodal_tracklets', count(*) FROM tix WHERE state = 'non_multimodal_tracklets'
UNION ALL SELECT 'exploratory_ignored', count(*) FROM tix WHERE state = 'kept' AND crossing_path"""
    ),
    "ri_temporal_geometry": sql(f"SELECT token, {', '.join(_f4(e, f'g{i:02d}') for i, e in enumerate(_TG))} FROM tp_rel"),
    "ri_exploratory_count": sql(
        "SELECT sequence, count(*) FILTER (WHERE state = 'kept' AND crossing_path) AS exploratory_ignored FROM tix GROUP BY sequence"
    ),
    "ri_association_groups": sql(
        'SELECT source_sample, target_sample, side, annotation_token, feature_row, idx AS "index", choice FROM asch'
    ),
    "ri_association_counts": sql(
        """SELECT 'sample_pairs_seen' AS counter, count(*) AS value FROM asgr
UNION ALL SELECT 'sample_pairs_kept', count(*) FROM asgr WHERE NOT missing AND ns > 0 AND nt > 0
UNION ALL SELECT 'missing_features', count(*) FROM asgr WHERE missing
UNION ALL SELECT 'non_multimodal_source_objects', count(*) FROM asts JOIN asgr USING (source_sample, target_sample) WHERE NOT missing AND side = 'source' AND NOT complete
UNION ALL SELECT 'non_multimodal_target_objects', count(*) FROM asts JOIN asgr USING (source_sample, target_sample) WHERE NOT missing AND side = 'target' AND NOT complete"""
    ),
    "ri_association_geometry": sql(
        f"""SELECT s.feature_row AS source_row, t.feature_row AS target_row, source_index, target_index,
  {', '.join(_f4(e, f'g{i:02d}') for i, e in enumerate(_AG))}
FROM (SELECT p.*, a.idx AS source_index, b.idx AS target_index, sqrt(p.delta_x**2+p.delta_y**2+p.delta_z**2) AS dist FROM as_obj p
  JOIN asix a ON a.annotation_token = p.source_token AND a.side = 'source' AND a.source_sample = p.source_sample
  JOIN asix b ON b.annotation_token = p.target_token AND b.side = 'target' AND b.source_sample = p.source_sample
  WHERE p.supervised_eligible) q
JOIN feat s ON s.annotation_token = q.source_token JOIN feat t ON t.annotation_token = q.target_token"""
    ),
    "ri_class_weights": sql(
        f"""WITH c AS (SELECT i AS category, (SELECT count(*) FROM feat WHERE complete AND category = i) AS count FROM range(0, 26) r(i)),
w AS (SELECT *, CASE WHEN count > 0 THEN sqrt(sum(count) OVER () / (count(*) FILTER (WHERE count > 0) OVER () * count)) END AS raw FROM c)
SELECT category, count, {r6('CASE WHEN count > 0 THEN least(raw / avg(raw) OVER (), 5.0) ELSE 0 END', 'weight')} FROM w"""
    ),
    "ri_pos_weights": sql(
        f"""SELECT total, predicate, positives, {r6('CASE WHEN positives > 0 THEN greatest(1.0::DOUBLE, least(20.0::DOUBLE, (total-positives)/positives)) ELSE 1.0::DOUBLE END', 'weight')}
FROM ({_pos('sp_rel', _SP)} UNION ALL {_pos('tp_rel', _TP)})"""
    ),
    "ri_multimodal_audit": sql(_WHOLE_AUDIT),
    "ri_audit_errors": sql(f"{_WANTED} {_ERRORS}"),
    "ri_audit_summary": sql(
        f"""{_WANTED}, err AS ({_ERRORS}),
num AS (SELECT k.split, coalesce(sum(a.value) FILTER (a.counter = 'objects'), 0)::BIGINT AS objects,
    coalesce(sum(a.value) FILTER (a.counter = 'complete_objects'), 0)::BIGINT AS complete_objects,
    (SELECT count(*) FROM err e WHERE e.split = k.split) AS errors
  FROM asked k LEFT JOIN aud a ON a.split = k.split AND a.sequence = 'ALL' GROUP BY k.split),
every AS (SELECT * FROM num UNION ALL SELECT 'ALL', sum(objects)::BIGINT, sum(complete_objects)::BIGINT, sum(errors)::BIGINT FROM num)
SELECT split, objects, complete_objects, errors,
  round(CASE WHEN objects > 0 THEN 100.0::DOUBLE * complete_objects / objects ELSE 0.0::DOUBLE END, 6) + 0.0::DOUBLE AS complete_percent, errors = 0 AS passed
FROM every"""
    ),
    "ri_vocabulary_audit": sql(
        """WITH want AS (SELECT 'c' || (p_size % 3) AS label FROM part UNION SELECT lower(p_type) FROM part)
SELECT 'not_configured' AS finding, label FROM (SELECT DISTINCT label FROM obs) WHERE label NOT IN (SELECT label FROM want)
UNION ALL SELECT 'not_observed', label FROM want WHERE label NOT IN (SELECT label FROM obs)
UNION ALL SELECT 'several_semantic_ids', label FROM obs GROUP BY label HAVING count(DISTINCT semantic_id) > 1"""
    ),
    "ri_split_overlap": sql(
        """SELECT o_custkey AS sequence, count(DISTINCT year(o_orderdate) < 1996) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate) < 1996) > 1"""
    ),
}
