"""SQL for the queries on object observations."""

from oracles.base import cte, r6, sql, tok

cte("obc", "SELECT *, semantic_id*1000 + instance_id AS combined_id FROM obs")
cte(
    "pix",
    f"""SELECT {tok('sample', 'sequence', 'day')} AS sample_token, user_id % 6 * 1000 + user_id // 6 AS value, cents // 50 AS px, k*2 AS py FROM ev""",
)
cte(
    "hit",
    """
SELECT o.token, p.point_id, p.x, p.y, p.z FROM obs o JOIN pts p ON p.sample_token = o.sample_token
WHERE p.x BETWEEN o.min_x-1e-3 AND o.max_x+1e-3 AND p.y BETWEEN o.min_y-1e-3 AND o.max_y+1e-3 AND p.z BETWEEN o.min_z-1e-3 AND o.max_z+1e-3""",
)
cte("lpt", "SELECT o.token, count(h.token) AS lidar_points FROM obs o LEFT JOIN hit h ON h.token = o.token GROUP BY o.token")
cte(
    "msk",
    """SELECT o.token, count(p.value) AS mask_count FROM obc o LEFT JOIN pix p ON p.sample_token = o.sample_token AND p.value = o.combined_id GROUP BY o.token""",
)
cte(
    "usb",
    """
SELECT o.* EXCLUDE (mask_pixels), l.lidar_points, m.mask_count AS mask_pixels, l.lidar_points >= 2 AS lidar_usable,
       coalesce(o.x1 IS NOT NULL AND o.x2-o.x1 >= 25 AND o.y2-o.y1 >= 25 AND (NOT o.mask_available OR m.mask_count >= 2), false) AS rgb_usable
FROM obc o JOIN lpt l USING (token) JOIN msk m USING (token)""",
)
cte(
    "ann",
    f"""SELECT *, NOT starts_with(lower(label), 'unknown') AS sup FROM usb WHERE (rgb_usable OR lidar_usable)
  AND sample_token IN (SELECT {tok('sample', 'sequence', 'day')} FROM ev WHERE event_type = 'purchase')""",
)
cte(
    "bxs",
    """
SELECT sequence, user_id*100 + raw_frame_index AS document_order, user_id % 2 AS semantic_id, user_id // 20 AS instance_id, dynamic,
       raw_frame_index AS timestamp, start_frame, end_frame
FROM (SELECT sequence, user_id, raw_frame_index, dynamic, min(raw_frame_index) OVER (PARTITION BY user_id) AS start_frame,
             max(raw_frame_index) OVER (PARTITION BY user_id) AS end_frame FROM obs)
WHERE dynamic OR raw_frame_index = start_frame""",
)
cte(
    "cor",
    """
SELECT token, user_id, length, width, height, raw_frame_index AS day, user_id % 9 = 0 AS singular, raw_frame_index*0.1::DOUBLE AS turn,
       cos(yaw)*length*vx - sin(yaw)*width*vy + center_x AS wx, sin(yaw)*length*vx + cos(yaw)*width*vy + center_y AS wy, height*vz AS wz
FROM (SELECT *, (user_id % 8)*0.39269908169872414::DOUBLE AS yaw FROM obs), (VALUES (-0.5::DOUBLE),(0.5)) a(vx), (VALUES (-0.5::DOUBLE),(0.5)) b(vy), (VALUES (-0.5::DOUBLE),(0.5)) c(vz)""",
)
cte(
    "ego",
    """SELECT *, cos(turn)*(wx-day) + sin(turn)*(wy-2.0::DOUBLE*day) AS ex, -sin(turn)*(wx-day) + cos(turn)*(wy-2.0::DOUBLE*day) AS ey, wz-0.5::DOUBLE AS ez FROM cor""",
)
cte(
    "prj",
    """
SELECT token, zc, 500.0::DOUBLE*xc/zc + 320.0::DOUBLE AS u, 500.0::DOUBLE*yc/zc + 120.0::DOUBLE AS v
FROM (SELECT token, x - 30.0::DOUBLE AS zc, -(y - 10.0::DOUBLE) AS xc, -(z - 1.0::DOUBLE) AS yc
      FROM (SELECT token, unnest([min_x, max_x]) AS x, min_y, max_y, min_z, max_z FROM obs) a,
           LATERAL (SELECT unnest([a.min_y, a.max_y]) AS y) b, LATERAL (SELECT unnest([a.min_z, a.max_z]) AS z) c)
WHERE zc > 0.1""",
)
cte(
    "prb",
    """
SELECT token, n, greatest(0, least(639, ux)) AS x1, greatest(0, least(239, vx)) AS y1, greatest(0, least(639, um)) AS x2, greatest(0, least(239, vm)) AS y2, depth
FROM (SELECT token, count(*) AS n, min(u) AS ux, max(u) AS um, min(v) AS vx, max(v) AS vm, quantile_cont(zc, 0.5) AS depth FROM prj GROUP BY token)""",
)
cte(
    "crp",
    """
SELECT *, greatest(0, least(599, floor(x1)))::BIGINT AS cx1, greatest(0, least(149, floor(y1)))::BIGINT AS cy1,
       greatest(0, least(600, ceil(x2)))::BIGINT AS cx2, greatest(0, least(150, ceil(y2)))::BIGINT AS cy2
FROM obc""",
)
cte("crk", "SELECT *, x1 IS NOT NULL AND depth > 0 AND cx2-cx1 >= 2 AND cy2-cy1 >= 2 AS ok FROM crp")
cte("rnk", "SELECT *, row_number() OVER (PARTITION BY token ORDER BY md5(concat_ws('|', token, point_id)), point_id) AS rk, count(*) OVER (PARTITION BY token) AS n FROM hit")
cte("drw", "SELECT r.token, r.point_id, p.i AS position, r.x, r.y, r.z FROM rnk r, range(0, 4) p(i) WHERE r.n >= 2 AND r.rk <= 4 AND p.i % least(r.n, 4) = r.rk - 1")
_CH = {"CAM0": "CAM0", "CAM1": "CAM1", "LIDAR_TOP": "LIDAR_TOP", "SEMANTIC_CAM0": "SEMANTIC_CAM0", "INSTANCE_CAM0": "INSTANCE_CAM0"}
_REAL = "p.n >= 2 AND p.x2 > p.x1 AND p.y2 > p.y1"


def _axis(a: str) -> str:
    return ", ".join(
        [
            r6(f"CASE WHEN NOT bool_or(singular) THEN min(e{a}) END", f"min_{a}"),
            r6(f"CASE WHEN NOT bool_or(singular) THEN max(e{a}) END", f"max_{a}"),
            r6(f"CASE WHEN NOT bool_or(singular) THEN avg(e{a}) END", f"center_{a}"),
        ]
    )


SQL = {
    "ob_uniform_subset": sql(
        """WITH s AS (SELECT sequence, raw_frame_index, row_number() OVER (PARTITION BY sequence ORDER BY raw_frame_index) - 1 AS p,
  count(*) OVER (PARTITION BY sequence) AS n FROM smp)
SELECT DISTINCT sequence, raw_frame_index FROM s, range(0, 12) r(i) WHERE n <= 12 OR p = (i*(n-1))//11"""
    ),
    "ob_active_boxes": sql(
        """SELECT * EXCLUDE (rn) FROM (SELECT s.sequence, s.raw_frame_index AS frame, b.* EXCLUDE (sequence),
  row_number() OVER (PARTITION BY s.sequence, s.raw_frame_index, semantic_id, instance_id ORDER BY dynamic DESC, document_order DESC) AS rn
  FROM smp s JOIN bxs b ON b.sequence = s.sequence AND CASE WHEN dynamic THEN b.timestamp = s.raw_frame_index
    ELSE s.raw_frame_index BETWEEN b.start_frame AND b.end_frame END) WHERE rn = 1"""
    ),
    "ob_transform_corners": sql(
        f"""SELECT token, {_axis('x')}, {_axis('y')}, {_axis('z')}, {r6('any_value(CASE WHEN singular THEN 0 ELSE length END)', 'length')},
  {r6('any_value(width)', 'width')}, {r6('any_value(CASE WHEN singular THEN 0 ELSE length*width*height END)', 'volume')},
  CASE WHEN any_value(singular) THEN NULL ELSE 4 END AS hull_corners FROM ego GROUP BY token"""
    ),
    "ob_corner_failures": sql("SELECT count(*) AS boxes, count(*) FILTER (WHERE user_id % 9 = 0) AS singular_boxes FROM obs"),
    "ob_project_box": sql(
        "SELECT o.token, "
        + ", ".join(r6(f"CASE WHEN {_REAL} THEN p.{c}::DOUBLE END", c) for c in ("x1", "y1", "x2", "y2"))
        + f""", {r6(f'CASE WHEN {_REAL} THEN ((p.x2-p.x1)*(p.y2-p.y1))::DOUBLE ELSE 0.0::DOUBLE END', 'image_area')},
  {r6('CASE WHEN p.n >= 2 THEN p.depth END', 'depth')} FROM obs o LEFT JOIN prb p ON p.token = o.token"""
    ),
    "ob_points_in_box": sql("SELECT token, lidar_points FROM lpt"),
    "ob_object_points": sql(f"SELECT token, point_id, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')} FROM hit"),
    "ob_mask_histogram": sql("SELECT token, mask_count AS mask_pixels FROM msk"),
    "ob_usability": sql("SELECT token, lidar_points, mask_pixels, rgb_usable, lidar_usable FROM usb"),
    "ob_usability_counts": sql(
        """SELECT 'boxes' AS counter, count(*) AS value FROM usb UNION ALL SELECT 'rgb_usable', count(*) FROM usb WHERE rgb_usable
UNION ALL SELECT 'lidar_usable', count(*) FROM usb WHERE lidar_usable UNION ALL SELECT 'unusable', count(*) FROM usb WHERE NOT rgb_usable AND NOT lidar_usable"""
    ),
    "ob_annotations": sql(
        f"""SELECT token, sample_token, instance_token, label, {r6('center_x', 'center_x')}, {r6('center_y', 'center_y')}, {r6('length', 'length')},
  {r6('volume', 'volume')}, rgb_usable::INT AS rgb, lidar_usable::INT AS lidar, lidar_points, mask_pixels, sup AS supervised_eligible FROM ann"""
    ),
    "ob_keyframe_files": sql(
        "SELECT sample_token, "
        + ", ".join(f"max(path) FILTER (WHERE channel = '{c}') AS {n}" for c, n in _CH.items())
        + " FROM sdt WHERE is_key_frame GROUP BY sample_token"
    ),
    "ob_categories": sql(
        "SELECT semantic_id, label, count(*) AS observations, count(DISTINCT instance_token) AS instances FROM ann GROUP BY ALL"
    ),
    "ob_instances": sql(
        """SELECT instance_token, bool_or(dynamic) AS dynamic, min(raw_frame_index) AS first_frame, max(raw_frame_index) AS last_frame,
  count(*) AS observations, count(*) FILTER (WHERE rgb_usable) AS rgb_usable, count(*) FILTER (WHERE lidar_usable) AS lidar_usable FROM ann GROUP BY ALL"""
    ),
    "ob_crop_window": sql(
        "SELECT token, " + ", ".join(f"CASE WHEN ok THEN c{c} END AS crop_{c}" for c in ("x1", "y1", "x2", "y2")) + " FROM crk"
    ),
    "ob_crop_source": sql(
        """SELECT c.token, CASE WHEN EXISTS (SELECT 1 FROM pix p WHERE p.sample_token = c.sample_token AND p.value = c.combined_id
  AND p.px >= cx1 AND p.px < cx2 AND p.py >= cy1 AND p.py < cy2) THEN 'matched_instance_mask' ELSE 'projected_3d_box' END AS crop_source FROM crk c WHERE ok"""
    ),
    "ob_fixed_sample": sql(
        f"""SELECT token, point_id, position::INT AS position, {', '.join(r6(f'{a} - avg({a}) OVER (PARTITION BY token)', a) for a in 'xyz')} FROM drw"""
    ),
    "ob_normals": sql(
        f"""WITH mid AS (SELECT token, position, {', '.join(f'{a} - avg({a}) OVER (PARTITION BY token) AS {a}' for a in 'xyz')} FROM drw),
near AS (SELECT a.token, a.position, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.token, a.position
    ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.position) AS r FROM mid a JOIN mid b ON b.token = a.token),
edge AS (SELECT token, position, {', '.join(f'max({a}) FILTER (r = {k}) - max({a}) FILTER (r = 1) AS {a}{k}' for k in (2, 3) for a in 'xyz')}
  FROM near GROUP BY token, position),
nrm AS (SELECT token, position, y2*z3 - z2*y3 AS x, z2*x3 - x2*z3 AS y, x2*y3 - y2*x3 AS z FROM edge),
len AS (SELECT *, x*x + y*y + z*z AS s FROM nrm)
SELECT token, position::INT AS position, {', '.join(r6(f'CASE WHEN s > 1e-9 THEN {a}*{b}/s END', f'n{a}{b}') for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))}, true AS outward FROM len"""
    ),
}
