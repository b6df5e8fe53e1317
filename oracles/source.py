"""SQL for the queries on sources and sinks."""

from oracles.base import r6, sql

SQL = {
    "src_file_index": sql("SELECT sequence, day AS frame, 16 * count(*) AS length FROM ev GROUP BY sequence, day"),
    "src_keyed_text": sql(
        f"""SELECT sequence, 'P_' || k AS key, 2 AS count, {r6('arg_max(value, event_id)', 'first')}, {r6('max(event_id)::DOUBLE', 'second')}
FROM ev WHERE event_type NOT IN ('view', 'error') GROUP BY sequence, k"""
    ),
    "src_pose_text": sql(
        f"""SELECT event_id AS frame, 16 AS entries, 1.0::DOUBLE AS m0, {r6('value', 'm3')}, {r6('k::DOUBLE', 'm7')}, 0.5::DOUBLE AS m11, 1.0::DOUBLE AS m15 FROM ev WHERE event_type <> 'view'"""
    ),
    "src_timestamps_text": sql(
        """SELECT sequence, day, row_number() OVER (PARTITION BY sequence, day ORDER BY time_ns) - 1 AS frame,
  time_ns + epoch_us(TIMESTAMP '2024-01-01')*1000 + 123 AS timestamp_ns,
  strftime(make_timestamp(time_ns//1000 + epoch_us(TIMESTAMP '2024-01-01')), '%Y-%m-%d %H:%M:%S.%f') || '123' AS timestamp_text FROM ev"""
    ),
    "src_boxes_xml": sql(
        f"""SELECT user_id AS annotation_index, semantic_id, instance_id, label, dynamic, raw_frame_index AS timestamp,
  raw_frame_index - (NOT dynamic)::INT AS start_frame, raw_frame_index + (NOT dynamic)::INT AS end_frame, {r6('center_x', 'x')}, {r6('center_y', 'y')}, 8 AS corners
FROM obs WHERE user_id % 11 <> 0"""
    ),
    "src_split_json": sql(
        """SELECT 'order_' || o_orderkey AS sequence, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS split FROM orders"""
    ),
    "src_json_array": sql("SELECT conv_id, turn, role FROM conversations"),
    "src_lidar_bin": sql(
        """SELECT sequence, day AS frame, row_number() OVER (PARTITION BY sequence, day ORDER BY event_id) - 1 AS point_id,
  round((cents / 500.0)::FLOAT::DOUBLE, 3) + 0.0 AS x, round((k / 5.0)::FLOAT::DOUBLE, 3) + 0.0 AS y,
  (event_id % 3)::DOUBLE AS z, (event_id % 7)::DOUBLE AS intensity FROM ev"""
    ),
    "sink_tables": sql(f"SELECT sequence, label, count(*) AS rows, {r6('sum(volume)', 'volume')} FROM obs GROUP BY ALL UNION ALL SELECT sequence, '(samples)', count(*), 0.0 FROM smp GROUP BY sequence"),
    "sink_json_records": sql(
        f"""SELECT token, sequence, {r6('CASE WHEN x1 IS NOT NULL AND n <= 2 THEN depth END', 'depth')},
  {r6('CASE WHEN x1 IS NOT NULL AND n <= 2 THEN depth END', 'first')}, {r6('volume', 'second')} FROM obs"""
    ),
    "sink_records_csv_gz": sql(
        """SELECT p.relation_id, p.sequence, concat_ws('|', t1, t2, t3) AS targets, quality_bin, identity_error FROM pred p JOIN oql USING (relation_id)"""
    ),
    "ingest_incremental": sql(
        """SELECT (raw_frame_index >= 15)::BIGINT AS batch, sequence, count(*) AS rows, count(DISTINCT token) AS tokens, count(*) FILTER (WHERE near) AS near
FROM sp_rel GROUP BY ALL"""
    ),
    "ingest_frames": sql(
        """WITH one AS (SELECT sequence, token, raw_frame_index FROM sp_rel WHERE (raw_frame_index >= 15) = (sequence % 2 = 0)),
last AS (SELECT sequence, max(raw_frame_index) AS f FROM one GROUP BY sequence),
two AS (SELECT r.sequence, r.token, r.raw_frame_index FROM sp_rel r LEFT JOIN last USING (sequence) WHERE f IS NULL OR r.raw_frame_index > f)
SELECT batch, sequence, count(*) AS rows, count(DISTINCT token) AS tokens, max(raw_frame_index) AS last_frame
FROM (SELECT 0::BIGINT AS batch, * FROM one UNION ALL SELECT 1::BIGINT, * FROM two) GROUP BY ALL"""
    ),
}
