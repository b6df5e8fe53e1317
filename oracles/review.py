"""SQL for the queries on human review and on views of frames."""

from oracles.base import cte, r6, sql

_SP = ["left_of", "in_front_of", "near", "overlapping", "occluding"]
_TP = ["approaching", "moving_away", "same_motion_direction", "crossing_path"]


def _labelled(rows: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{n}' AS sampled_for FROM {rows} WHERE {n}" for n in names)


cte("rsp_lab", _labelled("(SELECT * FROM sp_rel WHERE supervised_eligible AND ax1 IS NOT NULL AND bx1 IS NOT NULL)", [*_SP, "no_relation"]))
cte("rtp_lab", _labelled("(SELECT * FROM tp_rel WHERE review_reason = 'eligible')", [*_TP, "no_relation"]))


def _drawn(rows: str, many: int, few: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sampled_for ORDER BY md5(token || '|42|' || sampled_for), token) AS rank FROM {rows})
WHERE rank <= CASE sampled_for WHEN 'no_relation' THEN {few} ELSE {many} END"""


cte("rsp", _drawn("rsp_lab", 20, 10))
cte("rtp", _drawn("rtp_lab", 15, 5))
cte(
    "rec",
    """
SELECT token AS relation_id, 'spatial' AS kind, sampled_for, rank, a_label AS subject_label, b_label AS object_label, positive_predicates,
       raw_frame_index, NULL::DOUBLE AS distance_change FROM rsp
UNION ALL SELECT token, 'temporal', sampled_for, rank, a_label, b_label, positive_predicates, NULL, distance_change FROM rtp""",
)
cte(
    "rvw",
    """
SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'spatial' ELSE 'temporal' END AS kind, lang, quality = 1 AS human_valid, quality, toxic,
       coalesce(toxic = 1, false) AS odd, 'member_' || (d.doc_id % 3) AS reviewer, n_chars % 9 AS sequence, source
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
cte(
    "crr",
    """
SELECT CASE WHEN doc_id <> 7 THEN doc_id // 2 END AS relation_id, kind, source AS folder,
       CASE WHEN odd THEN 'wrong' WHEN human_valid THEN 'correct' WHEN NOT human_valid THEN 'incorrect' END AS decision,
       CASE WHEN lang = 'de' THEN NULL WHEN odd THEN 'toxic,' || lang ELSE '' END AS corrected, lang, odd
FROM rvw""",
)
cte("vis", "SELECT token FROM obs WHERE x1 IS NOT NULL")
cte(
    "tex",
    """
SELECT sampled_for, rank, token, clarity FROM (SELECT *, row_number() OVER (PARTITION BY sampled_for ORDER BY clarity DESC, token) AS rank
  FROM (SELECT *, CASE sampled_for WHEN 'left_of' THEN abs(delta_y) WHEN 'in_front_of' THEN abs(delta_x) WHEN 'near' THEN -box_distance
          WHEN 'overlapping' THEN bev_iou ELSE image_overlap END AS clarity FROM rsp_lab WHERE sampled_for <> 'no_relation')) WHERE rank <= 8
UNION ALL SELECT sampled_for, rank, token, clarity FROM (SELECT *, row_number() OVER (PARTITION BY sampled_for ORDER BY clarity DESC, token) AS rank
  FROM (SELECT *, CASE sampled_for WHEN 'approaching' THEN -distance_change WHEN 'moving_away' THEN distance_change
          WHEN 'same_motion_direction' THEN cosine ELSE -path_distance END AS clarity FROM tlb)) WHERE rank = 1""",
)
cte("tlb", _labelled("(SELECT * FROM tp_rel WHERE supervised_eligible)", _TP))
cte(
    "sup_",
    """
SELECT sequence, raw_frame_index AS frame, sum((left_of::INT+in_front_of::INT+near::INT+overlapping::INT+occluding::INT)
  * CASE WHEN ax1 IS NOT NULL AND bx1 IS NOT NULL THEN 2 ELSE 1 END)::BIGINT AS score, min(filename) AS filename FROM sp_rel GROUP BY ALL""",
)
cte(
    "frel",
    """
SELECT sequence, raw_frame_index AS frame, 'spatial' AS kind, token AS relation_id, a_instance AS si, b_instance AS oi, positive_predicates AS predicates,
       ax1 AS sl, bx1 AS ol, NULL::DOUBLE AS radial_speed, a_label, b_label FROM sp_rel WHERE NOT no_relation
UNION ALL
SELECT t.sequence, t.frames[3], 'temporal', t.token, 'i' || a_user, 'i' || b_user, positive_predicates, a.x1, b.x1, rs, a_label, b_label
FROM tp_rel t JOIN obs a ON a.user_id = t.a_user AND a.raw_frame_index = t.frames[3] JOIN obs b ON b.user_id = t.b_user AND b.raw_frame_index = t.frames[3]
WHERE NOT no_relation""",
)
cte("fob", "SELECT sequence, raw_frame_index AS frame, instance_token AS key, label, x1 FROM obs")


def _window(count: int, start: int | None) -> str:
    where = "WHERE n = {0} AND last - frame = {1}".format(count, count - 1)
    if start is not None:
        where += f" AND frame >= {start}"
    order = "ws DESC, frame" if start is None else "frame"
    name = "best" if start is None else "from_start"
    return f"""SELECT sequence, ws AS window_score, unnest(range(frame, frame + {count})) AS frame, '{name}' AS choice
FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY {order}) AS rn FROM (
  SELECT sequence, frame, sum(score) OVER w::BIGINT AS ws, count(*) OVER w AS n, max(frame) OVER w AS last FROM sup_
  WINDOW w AS (PARTITION BY sequence ORDER BY frame ROWS BETWEEN CURRENT ROW AND {count-1} FOLLOWING)) {where}) WHERE rn = 1"""


SQL = {
    "rv_sample_spatial": sql("SELECT sampled_for, rank, token FROM rsp"),
    "rv_sample_temporal": sql("SELECT sampled_for, rank, token FROM rtp"),
    "rv_unsupported": sql(
        f"SELECT p AS predicate FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in [*_TP, 'left_of', 'near'])}) v(p) WHERE p NOT IN (SELECT sampled_for FROM rtp)"
    ),
    "rv_records": sql(
        f"""SELECT relation_id, kind, sampled_for, subject_label, object_label, positive_predicates AS automatic_predicates,
  sampled_for || '_' || lpad(rank::VARCHAR, 3, '0') || '.jpg' AS image_filename, NULL::VARCHAR AS human_decision, '' AS corrected_predicates,
  raw_frame_index, {r6('distance_change', 'distance_change')} FROM rec"""
    ),
    "rv_manifest": sql(
        "SELECT coalesce(kind, 'ALL') AS kind, coalesce(sampled_for, 'ALL') AS sampled_for, count(*) AS examples FROM rec GROUP BY ROLLUP (kind, sampled_for)"
    ),
    "rv_assign_reviewers": sql(
        "SELECT doc_id AS relation_id, 'member_' || i AS reviewer, 'common_overlap' AS review_set FROM labels, range(1, 4) r(i)"
    ),
    "rv_status": sql(
        """SELECT kind, coalesce(lang, 'ALL') AS reviewed_as, count(*) AS records, count(*) FILTER (WHERE human_valid IS NULL) AS pending,
  count(*) FILTER (WHERE human_valid) AS valid, count(*) FILTER (WHERE NOT human_valid) AS invalid FROM rvw GROUP BY GROUPING SETS ((kind), (kind, lang))"""
    ),
    "rv_invalid_corrections": sql(
        "SELECT doc_id AS relation_id, kind, 'toxic,' || lang AS corrected_predicates FROM rvw WHERE odd AND lang NOT IN ('en', 'fr')"
    ),
    "rv_packages": sql(
        """WITH p AS (SELECT reviewer, sequence FROM rvw GROUP BY ALL HAVING count(DISTINCT kind) = 2)
SELECT r.reviewer, (SELECT count(*) FROM p WHERE p.reviewer = r.reviewer) AS packages, NULL::BOOLEAN AS complete FROM (SELECT DISTINCT reviewer FROM rvw) r
UNION ALL SELECT 'ALL', count(*), count(*) = 27 FROM p"""
    ),
    "rv_agreement": sql(
        f"""WITH i AS (SELECT quality IS NOT NULL AS complete, quality = 1 AND toxic = 0 AND doc_id % 2 = 1 OR quality = 0 AND toxic = 1 AND doc_id % 2 = 0 AS una FROM rvw)
SELECT count(*) AS items_found, count(*) FILTER (WHERE complete) AS items_reviewed_by_all, count(*) FILTER (WHERE una) AS unanimous_items,
  count(*) FILTER (WHERE complete AND NOT una) AS disagreements, {r6('100.0::DOUBLE*count(*) FILTER (WHERE una)/count(*) FILTER (WHERE complete)', 'unanimous_percent')} FROM i"""
    ),
    "rv_corrections": sql(
        """SELECT 'decision' AS section, coalesce(decision, 'pending') AS name, count(*) AS value FROM crr GROUP BY 2
UNION ALL SELECT 'folder', folder || ':' || coalesce(decision, 'pending'), count(*) FROM crr GROUP BY 2
UNION ALL SELECT 'error', 'missing_relation_id', count(*) FROM crr WHERE relation_id IS NULL
UNION ALL SELECT 'error', 'invalid_human_decision', count(*) FROM crr WHERE decision = 'wrong'
UNION ALL SELECT 'error', 'invalid_corrected_predicates', count(*) FROM crr WHERE corrected IS NULL OR (odd AND lang <> CASE kind WHEN 'spatial' THEN 'en' ELSE 'fr' END)
UNION ALL SELECT 'error', 'incorrect_without_correction_list', count(*) FROM crr WHERE decision = 'incorrect' AND corrected IS NULL
UNION ALL SELECT 'error', 'inconsistent_duplicates', count(*) FROM (SELECT relation_id FROM crr WHERE relation_id IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT coalesce(decision, '-') || '/' || coalesce(corrected, '-')) > 1)"""
    ),
    "rv_top_examples": sql(f"SELECT sampled_for, rank, token, {r6('clarity', 'clarity')} FROM tex"),
    "vw_frame_support": sql("SELECT * FROM sup_"),
    "vw_best_window": sql(f"{_window(6, None)} UNION ALL {_window(4, 9)}"),
    "vw_frame_relations": sql(
        f"""SELECT sequence, frame, kind, relation_id, si AS subject_instance, oi AS object_instance, predicates, {r6('sl', 'subject_box_left')},
  {r6('ol', 'object_box_left')}, {r6('radial_speed', 'radial_speed')} FROM frel"""
    ),
    "vw_frame_objects": sql(f"SELECT sequence, frame, key, label, {r6('x1', 'box_left')} FROM fob"),
    "vw_display_ids": sql(
        """SELECT sequence, frame, key, 'O' || row_number() OVER (PARTITION BY sequence, frame ORDER BY x1 IS NULL, x1, label, key) AS display_id FROM fob"""
    ),
    "vw_frame_document": sql(
        f"""WITH ent AS (
  SELECT sequence, frame, 'object' AS kind, key,
    concat_ws(' ', 'O' || row_number() OVER (PARTITION BY sequence, frame ORDER BY x1 IS NULL, x1, label, key), label) AS shown, x1 AS measure FROM fob
  UNION ALL SELECT sequence, frame, kind, relation_id, concat_ws(' ', si, oi, predicates), radial_speed FROM frel
), num AS (SELECT *, (row_number() OVER (PARTITION BY sequence, frame ORDER BY kind, key) - 1) // 500 AS part FROM ent)
SELECT sequence, frame, part, kind, row_number() OVER (PARTITION BY sequence, frame, part, kind ORDER BY key) - 1 AS position,
  key, shown, {r6('measure', 'measure')} FROM num"""
    ),
}
