"""SQL for the queries on links and association candidates."""

from oracles.base import cte, r6, sql, tok

cte(
    "as_obj",
    f"""
SELECT {tok('association-pair', 's.token', 't.token')} AS token, p.token AS source_sample, p.next AS target_sample,
       s.token AS source_token, t.token AS target_token, 'object_pair' AS candidate_type, s.label AS source_label,
       t.label AS target_label, t.center_x-s.center_x AS delta_x, t.center_y-s.center_y AS delta_y, t.center_z-s.center_z AS delta_z,
       sqrt((s.center_x-t.center_x)*(s.center_x-t.center_x)+(s.center_y-t.center_y)*(s.center_y-t.center_y)) AS center_distance,
       s.user_id = t.user_id AS is_match, false AS is_dustbin,
       s.user_id = t.user_id AND sqrt((s.center_x-t.center_x)*(s.center_x-t.center_x)+(s.center_y-t.center_y)*(s.center_y-t.center_y)) > 15 AS forced_outside_gate,
       s.user_id = t.user_id AS forward_target, s.user_id = t.user_id AS reverse_target,
       s.supervised_eligible AND t.supervised_eligible AS supervised_eligible
FROM smp p JOIN obs s ON s.sample_token = p.token JOIN obs t ON t.sample_token = p.next
WHERE s.user_id = t.user_id OR
      sqrt((s.center_x-t.center_x)*(s.center_x-t.center_x)+(s.center_y-t.center_y)*(s.center_y-t.center_y)) <= 15""",
)


def _bin(kind: str, own: str, other: str, near: str, far: str, parts: str, source: bool) -> str:
    alone = f"NOT EXISTS (SELECT 1 FROM obs o WHERE o.sample_token = p.{far} AND o.user_id = s.user_id)"
    return f"""SELECT {tok('association-' + kind, *parts.split(','))} AS token, p.token AS source_sample, p.next AS target_sample,
  {"s.token" if source else "''"} AS source_token, {"''" if source else "s.token"} AS target_token, '{kind}' AS candidate_type,
  {"s.label" if source else "'__dustbin__'"} AS source_label, {"'__dustbin__'" if source else "s.label"} AS target_label,
  0.0::DOUBLE AS delta_x, 0.0::DOUBLE AS delta_y, 0.0::DOUBLE AS delta_z, NULL::DOUBLE AS center_distance, false AS is_match, true AS is_dustbin,
  false AS forced_outside_gate, {alone if source else "false"} AS forward_target, {"false" if source else alone} AS reverse_target,
  s.supervised_eligible
FROM smp p JOIN obs s ON s.sample_token = p.{near} WHERE p.next <> ''"""


cte(
    "as_bin",
    _bin("source_to_dustbin", "s", "t", "token", "next", "s.token,p.next", True)
    + "\nUNION ALL BY NAME\n"
    + _bin("dustbin_to_target", "t", "s", "next", "token", "p.token,s.token", False),
)
cte("as_all", "SELECT * FROM as_obj UNION ALL BY NAME SELECT * FROM as_bin")
_COLS = (
    "token, source_sample, target_sample, source_token, target_token, candidate_type, source_label, target_label, "
    "is_match, is_dustbin, forced_outside_gate, forward_target, reverse_target, supervised_eligible"
)
_NUM = ", ".join(r6(c, c) for c in ("delta_x", "delta_y", "delta_z", "center_distance"))
_C = {
    "association_candidates": "true",
    "object_pair_candidates": "candidate_type = 'object_pair'",
    "positive_identity_pairs": "candidate_type = 'object_pair' AND is_match",
    "negative_identity_pairs": "candidate_type = 'object_pair' AND NOT is_match",
    "source_dustbin_candidates": "candidate_type = 'source_to_dustbin'",
    "positive_disappearances": "candidate_type = 'source_to_dustbin' AND forward_target",
    "target_dustbin_candidates": "candidate_type = 'dustbin_to_target'",
    "positive_births": "candidate_type = 'dustbin_to_target' AND reverse_target",
    "forced_outside_gate": "forced_outside_gate",
}


def _wrong(end: str, target: str, rule: str) -> str:
    return f"""SELECT '{rule}' AS rule, count(*) AS violations FROM (SELECT count(*) FILTER (WHERE {target}) AS n FROM as_all
  WHERE supervised_eligible AND {end} <> '' GROUP BY source_sample, target_sample, {end}) WHERE n <> 1"""


SQL = {
    "as_links": sql(
        """SELECT annotation_token, sample_token, scene_token, sample_index, prev, next, prev <> '' AS has_prev, next <> '' AS has_next
FROM (SELECT o.token AS annotation_token, o.sample_token, o.scene_token, o.sample_index,
        coalesce(p.token, '') AS prev, coalesce(n.token, '') AS next
      FROM obs o LEFT JOIN obs p ON p.scene_token = o.scene_token AND p.user_id = o.user_id AND p.sample_index = o.sample_index-1
      LEFT JOIN obs n ON n.scene_token = o.scene_token AND n.user_id = o.user_id AND n.sample_index = o.sample_index+1)"""
    ),
    "as_object_pairs": sql(f"SELECT {_COLS}, {_NUM} FROM as_obj"),
    "as_dustbins": sql(f"SELECT {_COLS} FROM as_bin"),
    "as_candidates": sql(f"SELECT {_COLS}, {_NUM} FROM as_all"),
    "as_counts": sql(
        "SELECT 'adjacent_sample_pairs' AS counter, count(*) AS value FROM (SELECT DISTINCT source_sample, target_sample FROM as_all) "
        + " ".join(f"UNION ALL SELECT '{n}', count(*) FROM as_all WHERE {c}" for n, c in _C.items())
    ),
    "as_validate": sql(
        _wrong("source_token", "forward_target", "forward_choice_not_unique")
        + "\nUNION ALL "
        + _wrong("target_token", "reverse_target", "reverse_choice_not_unique")
        + "\nUNION ALL SELECT 'token_not_unique', count(*) - count(DISTINCT token) FROM as_all WHERE supervised_eligible"
    ),
}
