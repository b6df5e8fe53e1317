"""SQL for the queries on frames, scenes, samples and poses."""

from oracles.base import cte, r6, sql, tok

cte(
    "frt",
    """
SELECT sequence, frame, max(path) FILTER (WHERE channel = 'CAM0') AS c0, max(path) FILTER (WHERE channel = 'CAM1') AS c1,
       max(path) FILTER (WHERE channel = 'LIDAR_TOP') AS li, max(path) FILTER (WHERE channel = 'SEMANTIC_CAM0') AS se,
       max(path) FILTER (WHERE channel = 'INSTANCE_CAM0') AS ins,
       max(timestamp_ns) FILTER (WHERE channel = 'LIDAR_TOP') AS timestamp_ns
FROM chan GROUP BY sequence, frame""",
)
cte("syn", "SELECT * FROM frt WHERE c0 IS NOT NULL AND li IS NOT NULL")
cte(
    "runs",
    """
SELECT *, frame - first_value(frame) OVER (PARTITION BY sequence, run_index ORDER BY frame) AS run_position
FROM (SELECT *, sum(b) OVER (PARTITION BY sequence ORDER BY frame)::BIGINT - 1 AS run_index
      FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY sequence ORDER BY frame) = 1 THEN 0 ELSE 1 END AS b FROM syn))""",
)
cte(
    "pieces",
    """
SELECT *, sum(long_enough::INT) OVER (PARTITION BY sequence ORDER BY start_frame)::BIGINT - 1 AS clip_index
FROM (SELECT sequence, run_index, run_position//20 AS chunk, min(frame) AS start_frame, max(frame) AS end_frame,
             count(*) AS frames, arg_min(timestamp_ns, frame) AS start_ns, arg_max(timestamp_ns, frame) AS end_ns,
             count(*) = 20 AS complete, count(*) >= 10 AS long_enough
      FROM runs GROUP BY ALL)""",
)
cte(
    "scn",
    f"""
SELECT {tok('scene', 'sequence', 'clip_index', 'start_frame', 'end_frame')} AS token, {tok('log', 'sequence')} AS log_token,
       sequence, clip_index, run_index, start_frame, end_frame, frames, start_ns, end_ns,
       (end_ns-start_ns)/1e9 AS duration_sec, (frames+4)//5 AS nbr_samples, complete
FROM pieces WHERE long_enough""",
)
cte(
    "clf",
    """
SELECT r.sequence, r.frame, r.timestamp_ns, r.frame - s.start_frame AS raw_index, s.token AS scene_token, s.frames AS clip_frames,
       s.clip_index, s.start_frame
FROM syn r JOIN scn s ON r.sequence = s.sequence AND r.frame BETWEEN s.start_frame AND s.end_frame""",
)
cte(
    "key",
    f"""
SELECT token, scene_token, sequence, raw_frame_index, timestamp_ns, sample_index,
       coalesce(lag(token) OVER w, '') AS prev, coalesce(lead(token) OVER w, '') AS next
FROM (SELECT {tok('sample', 'sequence', 'frame')} AS token, scene_token, sequence, frame AS raw_frame_index, timestamp_ns,
             raw_index//5 AS sample_index FROM clf WHERE raw_index % 5 = 0)
WINDOW w AS (PARTITION BY scene_token ORDER BY sample_index)""",
)
cte(
    "fts",
    f"""
SELECT c.sequence, c.frame, c.timestamp_ns, c.raw_index, c.scene_token, c.clip_frames,
       {tok('raw_frame', 'c.sequence', 'c.frame')} AS token, k.sample_index, k.token AS sample_token, c.raw_index % 5 = 0 AS is_key_frame
FROM clf c JOIN key k ON k.scene_token = c.scene_token AND k.raw_frame_index = c.frame - c.raw_index % 5""",
)
cte(
    "sdt",
    f"""
SELECT *, coalesce(lag(token) OVER w, '') AS prev, coalesce(lead(token) OVER w, '') AS next
FROM (SELECT f.sequence, f.frame, f.scene_token, f.sample_token, f.token AS raw_frame_token, f.is_key_frame, c.channel, c.timestamp_ns,
             c.path, c.size, {tok('sample_data', 'f.sequence', 'f.frame', 'c.channel')} AS token,
             CASE WHEN c.channel LIKE 'CAM%' THEN 'camera' WHEN c.channel LIKE 'LIDAR%' THEN 'lidar' ELSE 'label' END AS modality,
             {tok('calibrated_sensor', 'c.channel')} AS calibrated_sensor_token
      FROM fts f JOIN chan c ON c.sequence = f.sequence AND c.frame = f.frame)
WINDOW w AS (PARTITION BY scene_token, channel ORDER BY frame)""",
)
cte(
    "brk",
    """
SELECT f.sequence, f.frame, (SELECT max(p.frame) FROM pose p WHERE p.sequence = f.sequence AND p.frame <= f.frame) AS left_frame,
       (SELECT min(p.frame) FROM pose p WHERE p.sequence = f.sequence AND p.frame >= f.frame) AS right_frame
FROM syn f""",
)
cte(
    "brs",
    """
SELECT *, CASE WHEN left_frame = frame THEN 'exact' WHEN left_frame IS NOT NULL AND right_frame IS NOT NULL THEN 'interpolated'
          ELSE 'missing' END AS pose_source,
       CASE WHEN left_frame = frame THEN 0 WHEN left_frame IS NOT NULL AND right_frame IS NOT NULL THEN right_frame-left_frame END AS span_frames
FROM brk""",
)
cte(
    "itp",
    """
SELECT sequence, frame, pose_source, span_frames, x, y, CASE WHEN pose_source <> 'missing' THEN 0.0::DOUBLE END AS z, yaw
FROM (SELECT b.*, CASE pose_source WHEN 'exact' THEN l.x WHEN 'interpolated' THEN (1-t)*l.x+t*r.x END AS x,
             CASE pose_source WHEN 'exact' THEN l.y WHEN 'interpolated' THEN (1-t)*l.y+t*r.y END AS y,
             CASE pose_source WHEN 'exact' THEN l.k*pi()/101.0::DOUBLE WHEN 'interpolated' THEN ((1-t)*l.k+t*r.k)*pi()/101.0::DOUBLE END AS yaw
      FROM (SELECT *, (frame-left_frame)::DOUBLE/nullif(right_frame-left_frame, 0) AS t FROM brs) b
      LEFT JOIN pose l ON l.sequence = b.sequence AND l.frame = b.left_frame
      LEFT JOIN pose r ON r.sequence = b.sequence AND r.frame = b.right_frame)""",
)
_EXPECTED = "(SELECT DISTINCT o_orderkey % 6 AS sequence FROM orders)"


def _fk(table: str, column: str, target: str, name: str) -> str:
    return f"""SELECT 'unknown_reference:{name}.{column}' AS rule, count(*) AS violations FROM {table}
  WHERE {column} <> '' AND {column} NOT IN (SELECT token FROM {target})"""


SQL = {
    "tl_complete_sequences": sql(
        """SELECT sequence FROM chan WHERE channel = 'CAM0' INTERSECT SELECT sequence FROM chan WHERE channel = 'LIDAR_TOP'
INTERSECT SELECT sequence FROM pose"""
    ),
    "tl_sync_frames": sql("SELECT sequence, frame, timestamp_ns FROM syn"),
    "tl_manifest": sql(
        """SELECT sequence, frame, c0 AS rgb_left, c1 AS rgb_right, li AS lidar, se AS semantic, ins AS instance,
  EXISTS (SELECT 1 FROM pose p WHERE p.sequence = s.sequence AND p.frame = s.frame) AS exact_refined_pose,
  CASE WHEN EXISTS (SELECT 1 FROM ev e WHERE e.sequence = s.sequence AND e.frame = s.frame AND e.event_type = 'view') THEN 'train'
       WHEN EXISTS (SELECT 1 FROM ev e WHERE e.sequence = s.sequence AND e.frame = s.frame AND e.event_type = 'signup') THEN 'val'
       ELSE 'unlabelled' END AS semantic_split FROM syn s"""
    ),
    "tl_manifest_summary": sql(
        """WITH w AS (SELECT sequence, frame, lead(frame, 4) OVER (PARTITION BY sequence ORDER BY frame) - frame AS span FROM syn),
per AS (SELECT sequence, count(c0) AS left_rgb, count(li) AS lidar, count(*) FILTER (WHERE c0 IS NOT NULL AND li IS NOT NULL) AS synchronized_frames,
  count(ins) AS instance_masks, (SELECT count(*) FROM w WHERE w.sequence = frt.sequence AND span = 4) AS windows FROM frt GROUP BY sequence)
SELECT coalesce(sequence::VARCHAR, 'ALL') AS sequence, sum(left_rgb)::BIGINT AS left_rgb, sum(lidar)::BIGINT AS lidar,
  sum(synchronized_frames)::BIGINT AS synchronized_frames, sum(instance_masks)::BIGINT AS instance_masks, sum(windows)::BIGINT AS windows
FROM per GROUP BY ROLLUP (sequence)"""
    ),
    "tl_contiguous_runs": sql(
        'SELECT sequence, run_index, min(frame) AS start, max(frame) AS "end", count(*) AS length FROM runs GROUP BY ALL'
    ),
    "tl_scene_clips": sql(
        f"""SELECT token, log_token, sequence, clip_index, run_index, start_frame, end_frame, frames, start_ns, end_ns,
  {r6('duration_sec', 'duration_sec')}, nbr_samples, complete FROM scn"""
    ),
    "tl_rejected_segments": sql(
        f"""WITH lim AS (SELECT sequence, run_index, min(start_frame) AS start_frame FROM pieces WHERE long_enough AND clip_index >= 3 GROUP BY ALL)
SELECT e.sequence, NULL::BIGINT AS run_index, NULL::BIGINT AS start_frame, NULL::BIGINT AS end_frame, NULL::BIGINT AS frames,
  'no_synchronized_frames' AS reason FROM {_EXPECTED} e WHERE e.sequence NOT IN (SELECT sequence FROM syn)
UNION ALL SELECT sequence, run_index, start_frame, last_frame, last_frame-start_frame+1, 'development_scene_limit'
  FROM (SELECT l.*, (SELECT max(frame) FROM runs r WHERE r.sequence = l.sequence AND r.run_index = l.run_index) AS last_frame FROM lim l)
UNION ALL SELECT p.sequence, p.run_index, p.start_frame, p.end_frame, p.frames, 'short_tail' FROM pieces p
  WHERE NOT long_enough AND NOT EXISTS (SELECT 1 FROM lim l WHERE l.sequence = p.sequence AND l.run_index = p.run_index)"""
    ),
    "tl_keyframes": sql("SELECT * FROM key"),
    "tl_frame_to_sample": sql("SELECT * FROM fts"),
    "tl_sample_data": sql("SELECT * FROM sdt"),
    "tl_nominal_fps": sql(
        f"""WITH st AS (SELECT sequence, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY sequence ORDER BY frame) AS step FROM syn),
md AS (SELECT sequence, trunc(quantile_cont(step, 0.5))::BIGINT AS m FROM st WHERE step > 0 GROUP BY sequence),
fp AS (SELECT DISTINCT s.sequence, coalesce(m, 100000000) AS period_ns FROM syn s LEFT JOIN md USING (sequence))
SELECT sequence, period_ns, {r6('1e9/period_ns', 'nominal_fps')} FROM fp"""
    ),
    "tl_pose_asof": sql("SELECT * FROM brs"),
    "tl_pose_interpolate": sql(
        f"""SELECT sequence, frame, pose_source, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')}, {r6('cos(yaw)', 'cos_yaw')},
  {r6('sin(yaw)', 'sin_yaw')} FROM itp"""
    ),
    "tl_ego_pose": sql(
        f"""SELECT {tok('ego_pose', 'sequence', 'frame')} AS token, sequence, frame,
  {r6('x - (cos(w)*0.5 + sin(w)*0.25)', 'x')}, {r6('y - (sin(w)*0.5 - cos(w)*0.25)', 'y')}, {r6('z - 1.5', 'z')},
  0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, {r6('sin(w/2)', 'qz')}, {r6('cos(w/2)', 'qw')}, pose_source, span_frames
FROM (SELECT *, yaw - pi()/4 AS w FROM itp WHERE pose_source <> 'missing')"""
    ),
    "tl_pose_counts": sql(
        """SELECT sequence, count(*) FILTER (WHERE pose_source = 'exact') AS exact, count(*) FILTER (WHERE pose_source = 'interpolated') AS interpolated,
  count(*) FILTER (WHERE pose_source = 'missing') AS missing FROM brs GROUP BY sequence"""
    ),
    "tl_sensor_table": sql(
        f"""WITH rg AS (SELECT user_id AS rig, sum(k)/(count(*)*40.0::DOUBLE) AS yaw, sum(cents)/(count(*)*10000.0::DOUBLE) AS sh FROM ev GROUP BY user_id),
ch AS (SELECT rig, channel, modality, CASE WHEN channel = 'LIDAR_TOP' THEN NULL ELSE 1408 END AS width,
    CASE WHEN channel = 'LIDAR_TOP' THEN NULL ELSE 376 END AS height,
    CASE channel WHEN 'LIDAR_TOP' THEN 0 WHEN 'CAM1' THEN sh + cos(yaw)*0.6 ELSE sh END AS t0,
    CASE channel WHEN 'CAM1' THEN sin(yaw)*0.6 ELSE 0 END AS t1,
    CASE channel WHEN 'LIDAR_TOP' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS t2,
    CASE channel WHEN 'LIDAR_TOP' THEN 0 WHEN 'CAM1' THEN yaw*1.1 ELSE yaw*0.9 END AS w,
    CASE WHEN channel <> 'LIDAR_TOP' THEN sh END AS focal
  FROM rg, (VALUES ('CAM0','camera'),('CAM1','camera'),('LIDAR_TOP','lidar'),('SEMANTIC_CAM0','label'),('INSTANCE_CAM0','label')) v(channel, modality))
SELECT {tok('calibrated_sensor', 'rig', 'channel')} AS token, rig, channel, modality, width, height,
  {r6('t0', 't0')}, {r6('t1', 't1')}, {r6('t2', 't2')}, {r6('cos(w)', 'cos_yaw')}, {r6('sin(w)', 'sin_yaw')},
  {r6('-(cos(w)*t0 + sin(w)*t1)', 'back_x')}, {r6('focal', 'focal')} FROM ch"""
    ),
    "tl_log_summary": sql(
        f"""SELECT {tok('log', 'f.sequence')} AS token, f.sequence, first_raw_frame, last_raw_frame, synchronized_frames,
  coalesce(accepted_raw_frames, 0)::BIGINT AS accepted_raw_frames, coalesce(scene_count, 0) AS scene_count,
  coalesce(first_scene_token, '') AS first_scene_token, coalesce(last_scene_token, '') AS last_scene_token
FROM (SELECT sequence, min(frame) AS first_raw_frame, max(frame) AS last_raw_frame, count(*) AS synchronized_frames FROM syn GROUP BY 1) f
LEFT JOIN (SELECT sequence, sum(frames) AS accepted_raw_frames, count(*) AS scene_count, arg_min(token, clip_index) AS first_scene_token,
  arg_max(token, clip_index) AS last_scene_token FROM scn GROUP BY 1) s USING (sequence)"""
    ),
    "tl_manifest_hash": sql(
        """WITH t1 AS (SELECT c.sequence, c.frame >> 13 AS node, sha256(string_agg(c.path || '|' || c.size, '' ORDER BY c.frame,
  CASE c.channel WHEN 'CAM0' THEN 0 WHEN 'CAM1' THEN 1 WHEN 'LIDAR_TOP' THEN 2 WHEN 'SEMANTIC_CAM0' THEN 3 ELSE 4 END)) AS t
  FROM chan c JOIN clf f ON f.sequence = c.sequence AND f.frame = c.frame GROUP BY ALL),
"""
        + ",\n".join(
            f"t{n + 1} AS (SELECT sequence, p.node >> 13 AS node, sha256(string_agg(t, '' ORDER BY p.node)) AS t FROM t{n} p GROUP BY ALL)"
            for n in range(1, 5)
        )
        + """
SELECT sequence, sha256(string_agg(t, '' ORDER BY node)) AS manifest_sha256 FROM t5 GROUP BY sequence"""
    ),
    "tl_validate": sql(
        """WITH d_scn AS (SELECT * FROM scn WHERE clip_index <> 1),
d_key AS (SELECT * FROM key WHERE sample_index <> 1)
SELECT 'duplicate_token:scenes' AS rule, count(*) - count(DISTINCT token) AS violations FROM d_scn
UNION ALL SELECT 'duplicate_token:samples', count(*)-count(DISTINCT token) FROM d_key
UNION ALL SELECT 'duplicate_token:raw_frames', count(*)-count(DISTINCT token) FROM fts
UNION ALL SELECT 'duplicate_token:sample_data', count(*)-count(DISTINCT token) FROM sdt
UNION ALL """
        + "\nUNION ALL ".join(
            [
                _fk("d_key", "scene_token", "d_scn", "samples"),
                _fk("fts", "scene_token", "d_scn", "raw_frames"),
                _fk("fts", "sample_token", "d_key", "raw_frames"),
                _fk("sdt", "sample_token", "d_key", "sample_data"),
                _fk("sdt", "raw_frame_token", "fts", "sample_data"),
                _fk("sdt", "prev", "sdt", "sample_data"),
                _fk("sdt", "next", "sdt", "sample_data"),
            ]
        )
        + """
UNION ALL SELECT 'complete_scene_sample_count', count(*) FROM d_scn WHERE complete AND nbr_samples <> 4
UNION ALL SELECT 'scene_clips_overlap', count(*) FROM scn a JOIN scn b ON a.sequence = b.sequence AND a.clip_index = b.clip_index-1 WHERE b.start_frame <= a.end_frame
UNION ALL SELECT 'sample_stride', count(*) FROM (SELECT raw_frame_index - lag(raw_frame_index) OVER (PARTITION BY scene_token ORDER BY sample_index) AS st FROM d_key) WHERE st <> 5"""
    ),
    "tl_parts_report": sql(
        f"""WITH rep AS (SELECT sequence, count(*) AS observations, count(DISTINCT sample_token) AS samples, count(DISTINCT instance_token) AS instances,
  sequence <> 3 AS passed FROM obs GROUP BY sequence),
st AS (SELECT e.sequence, r.*, CASE WHEN r.sequence IS NULL THEN 'missing' WHEN r.passed THEN 'complete' ELSE 'failed' END AS state
  FROM {_EXPECTED} e LEFT JOIN rep r ON r.sequence = e.sequence)
SELECT 'count' AS section, 'observations' AS name, coalesce(sum(observations), 0)::BIGINT AS value FROM st WHERE state = 'complete'
UNION ALL SELECT 'count', 'samples', coalesce(sum(samples), 0)::BIGINT FROM st WHERE state = 'complete'
UNION ALL SELECT 'count', 'instances', coalesce(sum(instances), 0)::BIGINT FROM st WHERE state = 'complete'
UNION ALL SELECT 'result', 'passed', (count(*) FILTER (WHERE state <> 'complete') = 0)::BIGINT FROM st
UNION ALL SELECT 'sequence:' || state, sequence::VARCHAR, 1 FROM st"""
    ),
    "tl_budget_prefix": sql(
        """WITH per AS (SELECT sequence, (sequence*3) % 5 AS priority, sum(size)::BIGINT AS bytes FROM chan GROUP BY ALL),
cum AS (SELECT *, sum(bytes) OVER (ORDER BY priority, sequence)::BIGINT AS cumulative_bytes FROM per)
SELECT c.sequence, c.bytes, c.cumulative_bytes, f.start_frame, f.end_frame, f.selected_frames, f.frames_with_instance_masks,
  (SELECT count(*) FROM ev e JOIN syn s ON s.sequence = e.sequence AND s.frame = e.frame
   WHERE e.sequence = c.sequence AND e.event_type = 'signup' AND e.user_id % 3 = 0) AS dynamic_box_observations
FROM cum c JOIN (SELECT sequence, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS selected_frames, count(ins) AS frames_with_instance_masks
  FROM syn GROUP BY sequence) f USING (sequence) WHERE cumulative_bytes - bytes < (SELECT count(*) FROM ev)"""
    ),
    "tl_split_assign": sql(
        """SELECT s.sequence, s.frame, s.timestamp_ns, coalesce(p.split, 'unassigned') AS split
FROM syn s LEFT JOIN (SELECT * FROM split WHERE split <> 'validation') p ON p.sequence = s.sequence"""
    ),
}
