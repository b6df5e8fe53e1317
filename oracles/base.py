"""Named common table expressions in SQL; `sql(body)` puts the ones a body uses in front of it."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def _uses(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", text)]


def sql(body: str, recursive: bool = False) -> str:
    """WITH clause holding every expression the body needs, directly or through others, in order."""
    done: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for name in _uses(text):
            if name in inside or name in done:
                continue
            visit(CTES[name], (*inside, name))
            done.append(name)

    visit(body, ())
    recursive = recursive or any(re.search(rf"\b{n}\b", CTES[n]) for n in done)
    body = body.strip()
    parts = [f"{n} AS ({CTES[n]})" for n in done]
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        recursive = recursive or bool(own.group(1))
        body = body[own.end() :]
        joined = ",\n".join([*parts, body])
    else:
        joined = ",\n".join(parts) + "\n" + body if parts else body
        if not parts:
            return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}"


def tok(kind: str, *parts: str) -> str:
    return f"substr(sha1(concat_ws('|','v1','{kind}',{','.join(parts)})),1,32)"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


cte(
    "ev",
    """
SELECT event_id, user_id, event_type, value, CAST(round(value*100) AS BIGINT) AS cents,
       CAST(props->>'k' AS BIGINT) AS k,
       CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
       user_id % 5 + 5 * (user_id // 50) AS sequence,
       CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT)*8 + hour(ts)//3 AS frame,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS time_ns
FROM events""",
)
cte(
    "obs",
    f"""
SELECT *, center_x - length/2.0 AS min_x, center_x + length/2.0 AS max_x,
       center_y - width/2.0 AS min_y, center_y + width/2.0 AS max_y,
       center_z - height/2.0 AS min_z, center_z + height/2.0 AS max_z,
       {tok('annotation', 'sample_token', 'user_id')} AS token,
       length*width*height AS volume, center_x AS depth,
       CASE WHEN user_id % 9 <> 0 THEN 10.0::DOUBLE*center_x END AS x1,
       CASE WHEN user_id % 9 <> 0 THEN 10.0::DOUBLE*center_y END AS y1,
       CASE WHEN user_id % 9 <> 0 THEN 10.0::DOUBLE*center_x + 20.0::DOUBLE + user_id % 15 END AS x2,
       CASE WHEN user_id % 9 <> 0 THEN 10.0::DOUBLE*center_y + 20.0::DOUBLE + user_id % 11 END AS y2
FROM (
  SELECT user_id, sequence, day AS raw_frame_index, n,
         concat_ws('-', 'scene', sequence, day//10) AS scene_token, day % 10 AS sample_index,
         {tok('sample', 'sequence', 'day')} AS sample_token,
         'i' || user_id AS instance_token,
         cents/(n*500.0::DOUBLE) AS center_x, ks/(n*5.0::DOUBLE) AS center_y, 0.0::DOUBLE AS center_z,
         (2 + user_id % 3)::DOUBLE AS length, (1 + user_id % 2)::DOUBLE AS width, 1.0::DOUBLE + n/4.0::DOUBLE AS height,
         day*1000000000 AS timestamp_ns,
         CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'c' || (user_id % 4) END AS label,
         user_id % 6 AS semantic_id, user_id // 6 AS instance_id, user_id % 3 = 0 AS dynamic,
         user_id % 7 <> 0 AS supervised_eligible, user_id % 4 <> 0 AS mask_available, n*10 AS mask_pixels,
         concat_ws('/', sequence, 'CAM0', day) AS filename
  FROM (SELECT user_id, sequence, day, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(k) AS BIGINT) AS ks
        FROM ev GROUP BY ALL))""",
)
cte(
    "smp",
    f"""
SELECT *, coalesce(lag(token) OVER (PARTITION BY scene_token ORDER BY sample_index), '') AS prev,
       coalesce(lead(token) OVER (PARTITION BY scene_token ORDER BY sample_index), '') AS next
FROM (SELECT DISTINCT sequence, day AS raw_frame_index, concat_ws('-', 'scene', sequence, day//10) AS scene_token,
             day % 10 AS sample_index, {tok('sample', 'sequence', 'day')} AS token, day*1000000000 AS timestamp_ns
      FROM ev)""",
)
cte(
    "feat",
    """
SELECT token AS annotation_token, sequence, scene_token, sample_token, sample_index, raw_frame_index, timestamp_ns,
       instance_token AS identity, user_id, center_x, center_y, center_z, length, width, height, supervised_eligible,
       user_id % 9 <> 0 AS m1, n >= 2 AS m2, user_id % 9 <> 0 AS m3,
       user_id % 9 <> 0 AND n >= 2 AS complete, user_id % 26 AS category,
       row_number() OVER (ORDER BY sequence, scene_token, sample_index, user_id) - 1 AS feature_row
FROM obs""",
)
cte(
    "pred",
    """
SELECT o_orderkey AS relation_id, o_custkey AS group_id, o_orderkey % 9 AS sequence,
       o_totalprice/100000.0::DOUBLE - 2.0::DOUBLE AS l1,
       1.0::DOUBLE - (o_orderkey % 7)/3.0::DOUBLE AS l2,
       o_totalprice/100000.0::DOUBLE - 1.5::DOUBLE AS l3,
       CAST(o_orderstatus = 'F' AS INT) AS t1, CAST(o_orderstatus = 'O' AS INT) AS t2,
       CAST(o_totalprice > 200000 AS INT) AS t3, o_orderkey % 6 <> 0 AS available
FROM orders""",
)
cte(
    "chan",
    """
SELECT sequence, frame, channel, min(time_ns) AS timestamp_ns, count(*) AS size,
       concat_ws('/', sequence, channel, lpad(frame::VARCHAR, 10, '0')) AS path
FROM (SELECT sequence, frame, time_ns, CASE WHEN event_id % 2 = 0 THEN 'CAM0' ELSE 'LIDAR_TOP' END AS channel FROM ev
      UNION ALL
      SELECT sequence, frame, time_ns, CASE event_type WHEN 'click' THEN 'CAM1' WHEN 'view' THEN 'SEMANTIC_CAM0'
             ELSE 'INSTANCE_CAM0' END FROM ev WHERE event_type IN ('click', 'view', 'error'))
GROUP BY ALL""",
)
cte(
    "pose",
    """
SELECT sequence, frame, arg_min(value, event_id) AS x, arg_min(k, event_id)::DOUBLE AS y,
       arg_min(k, event_id) AS k
FROM ev WHERE event_type = 'purchase' GROUP BY ALL""",
)
cte(
    "pts",
    f"""
SELECT {tok('sample', 'sequence', 'day')} AS sample_token, event_id AS point_id,
       cents/500.0::DOUBLE AS x, k/5.0::DOUBLE AS y, (event_id % 3)::DOUBLE AS z
FROM ev""",
)
cte(
    "split",
    """
SELECT DISTINCT sequence, CASE WHEN sequence <= 2 THEN 'train' WHEN sequence = 3 THEN 'validation' ELSE 'test' END AS split
FROM ev""",
)
