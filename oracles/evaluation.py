"""SQL for the queries on metrics and track quality."""

from oracles.base import cte, r6, sql

_SIG = "1/(1+exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, {}))))"
_NAMES = "CASE i WHEN 1 THEN 'approaching' WHEN 2 THEN 'moving_away' ELSE 'same_motion_direction' END"


def _r8(expr: str, name: str) -> str:
    return f"round({expr}, 8) + 0.0 AS {name}"


def _long(rows: str) -> str:
    return f"""SELECT p.*, i, {_NAMES} AS predicate, {_SIG.format('[l1,l2,l3][i]')} AS score, [t1,t2,t3][i] AS t
FROM {rows} p, range(1, 4) r(i)"""


cte("plg", _long("pred"))
cte("tch", "SELECT * REPLACE (l1 + 0.3::DOUBLE AS l1, l2 + 0.3::DOUBLE AS l2, l3 + 0.3::DOUBLE AS l3) FROM pred")
cte("tlg", _long("tch"))
cte("pmk", "SELECT * REPLACE (CASE WHEN available THEN l1 ELSE -20 END AS l1, CASE WHEN available THEN l2 ELSE -20 END AS l2, CASE WHEN available THEN l3 ELSE -20 END AS l3) FROM pred")
cte("mlg", _long("pmk"))


def _per(long: str, by: str) -> str:
    """Per predicate metrics of a long table; `by` is a comma list, maybe empty."""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}predicate, tp, fp, fn, tp+fn AS support, tp/greatest(tp+fp,1) AS precision, tp/greatest(tp+fn,1) AS recall,
  2.0::DOUBLE*(tp/greatest(tp+fp,1))*(tp/greatest(tp+fn,1))/greatest(tp/greatest(tp+fp,1)+tp/greatest(tp+fn,1), 1e-12) AS f1, ap
FROM (SELECT {lead}predicate, count(*) FILTER (WHERE t = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE t = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE t = 1 AND score < 0.5) AS fn, sum(CASE WHEN t = 1 THEN hits/rk END)/nullif(sum(t), 0) AS ap
  FROM (SELECT *, row_number() OVER w AS rk, sum(t) OVER w AS hits FROM {long}
        WINDOW w AS (PARTITION BY {lead}predicate ORDER BY score DESC, relation_id ROWS UNBOUNDED PRECEDING)) GROUP BY {lead}predicate)"""


def _multi(long: str, by: str) -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN ex USING ({by})" if by else ", ex"
    inner = f"""SELECT {lead}avg(f1) FILTER (WHERE support > 0) AS macro_f1, avg(ap) AS mean_average_precision,
    coalesce(string_agg(predicate, ',' ORDER BY predicate) FILTER (WHERE support = 0), '') AS unsupported_predicates, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn
  FROM ({_per(long, by)}) {group}"""
    return f"""WITH ex AS (SELECT {lead}count(*) AS examples, avg(ok::INT) AS exact_match_accuracy FROM (
    SELECT {lead}relation_id, bool_and((t = 1) = (score >= 0.5)) AS ok FROM {long} GROUP BY {lead}relation_id) {group}),
mm AS ({inner})
SELECT *, tp/greatest(tp+fp,1) AS micro_precision, tp/greatest(tp+fn,1) AS micro_recall,
  2.0::DOUBLE*(tp/greatest(tp+fp,1))*(tp/greatest(tp+fn,1))/greatest(tp/greatest(tp+fp,1)+tp/greatest(tp+fn,1), 1e-12) AS micro_f1
FROM mm {join}"""


_FIG = "macro_f1 mean_average_precision micro_precision micro_recall micro_f1 exact_match_accuracy".split()
_FIGR = ", ".join(r6(f, f) for f in _FIG)
cte("pav_l", "SELECT * FROM plg WHERE available")
cte(
    "oql",
    """
SELECT *, CASE WHEN NOT available THEN 'missing' WHEN identity_error THEN 'poor_identity' WHEN correct_joint_steps = 5 THEN 'perfect_5'
  WHEN correct_joint_steps = 4 THEN 'good_4' WHEN correct_joint_steps = 3 THEN 'partial_3' ELSE 'poor_identity' END AS quality_bin
FROM (SELECT o_orderkey AS relation_id, o_orderkey % 9 AS sequence, o_orderkey % 6 <> 0 AS available, o_orderkey % 11 = 0 AS identity_error,
  o_orderkey % 6 AS correct_joint_steps FROM orders)""",
)
cte(
    "sli",
    """
SELECT q.*, s.slice_sequence, s.stratum FROM oql q, LATERAL (
  SELECT 'ALL' AS slice_sequence, 'overall' AS stratum UNION ALL SELECT 'ALL', 'available_only' WHERE q.available
  UNION ALL SELECT 'ALL', q.quality_bin UNION ALL SELECT q.sequence::VARCHAR, 'overall' UNION ALL SELECT q.sequence::VARCHAR, q.quality_bin) s""",
)
cte(
    "slg",
    """
SELECT s.slice_sequence, s.stratum, 'teacher' AS kind, l.relation_id, l.predicate, l.score, l.t FROM sli s JOIN tlg l USING (relation_id)
UNION ALL SELECT s.slice_sequence, s.stratum, 'predicted', l.relation_id, l.predicate, l.score, l.t FROM sli s JOIN plg l USING (relation_id)""",
)
cte("smt", _multi("slg", "kind, slice_sequence, stratum"))
cte(
    "str",
    f"""
SELECT d.*, a.examples, {', '.join(f'a.{f} AS teacher_{f}, b.{f} AS predicted_{f}' for f in _FIG)},
  {', '.join(f'b.{f} - a.{f} AS difference_{f}' for f in ('macro_f1', 'mean_average_precision', 'micro_recall'))}
FROM (SELECT slice_sequence, stratum, sum(t1+t2+t3)::BIGINT AS positive_labels, avg(s.available::INT) AS tracklet_availability,
  avg(identity_error::INT) AS identity_error_rate, avg(correct_joint_steps) AS mean_correct_joint_steps
  FROM sli s JOIN pred p USING (relation_id) GROUP BY ALL) d
JOIN smt a ON a.kind = 'teacher' AND a.slice_sequence = d.slice_sequence AND a.stratum = d.stratum
JOIN smt b ON b.kind = 'predicted' AND b.slice_sequence = d.slice_sequence AND b.stratum = d.stratum""",
)
_STR = [
    "tracklet_availability",
    "identity_error_rate",
    "mean_correct_joint_steps",
    *[f"{s}_{f}" for s in ("teacher", "predicted") for f in _FIG],
    *[f"difference_{f}" for f in ("macro_f1", "mean_average_precision", "micro_recall")],
]
_SUM = [
    "tracklet_availability",
    "identity_error_rate",
    *[f"{s}_{f}" for f in ("macro_f1", "mean_average_precision", "micro_recall") for s in ("teacher", "predicted", "difference")],
]
# Quality of temporal relations on predicted tracks.
cte("lkc", "SELECT source, target, 1/(1+exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, score)))) AS confidence FROM mut")
cte(
    "qst",
    """
SELECT p.relation_id, i, e1.identity AS se, e2.identity AS te, a1.identity AS sa_, a2.identity AS ta, p.ps[i] AS psr, p.pt[i] AS ptr,
       c1.confidence AS cs, c2.confidence AS ct
FROM pav p, range(1, 6) r(i)
LEFT JOIN feat e1 ON e1.feature_row = p.s_rows[i] LEFT JOIN feat e2 ON e2.feature_row = p.t_rows[i]
LEFT JOIN feat a1 ON a1.feature_row = p.ps[i] LEFT JOIN feat a2 ON a2.feature_row = p.pt[i]
LEFT JOIN lkc c1 ON i < 5 AND c1.source = p.ps[i] AND c1.target = p.ps[i+1]
LEFT JOIN lkc c2 ON i < 5 AND c2.source = p.pt[i] AND c2.target = p.pt[i+1]""",
)


def _pur(column: str) -> str:
    return f"""(SELECT max(n)/sum(n) FROM (SELECT count(*) AS n FROM (SELECT unnest({column}) AS v) WHERE v IS NOT NULL GROUP BY v))"""


cte(
    "qre",
    f"""
SELECT p.relation_id, p.sequence, p.group_id_ AS group_id, p.unavailable_reason = 'available' AS available, p.unavailable_reason,
  p.frames[1] AS start_frame, p.frames[3] AS middle_frame, p.frames[5] AS end_frame, q.teacher_joint_steps, q.predicted_source_steps,
  q.predicted_target_steps, p.joint_steps AS predicted_joint_steps, q.correct_source_steps, q.correct_target_steps, q.correct_joint_steps,
  q.correct_joint_steps/greatest(q.teacher_joint_steps,1) AS relative_joint_recall, {_pur('q.sl')} AS source_purity, {_pur('q.tl')} AS target_purity,
  q.source_switch, q.target_switch, q.source_switch OR q.target_switch OR q.bad AS identity_error,
  CASE WHEN q.cn > 0 THEN q.csum/q.cn END AS mean_link_confidence, q.cmin AS minimum_link_confidence
FROM pav p JOIN (SELECT relation_id, count(*) FILTER (WHERE se IS NOT NULL AND te IS NOT NULL) AS teacher_joint_steps,
  count(*) FILTER (WHERE psr >= 0) AS predicted_source_steps, count(*) FILTER (WHERE ptr >= 0) AS predicted_target_steps,
  count(*) FILTER (WHERE se = sa_) AS correct_source_steps, count(*) FILTER (WHERE te = ta) AS correct_target_steps,
  count(*) FILTER (WHERE se = sa_ AND te = ta) AS correct_joint_steps, list(sa_) AS sl, list(ta) AS tl,
  count(DISTINCT sa_) > 1 AS source_switch, count(DISTINCT ta) > 1 AS target_switch,
  coalesce(bool_or(se <> sa_), false) OR coalesce(bool_or(te <> ta), false) AS bad,
  coalesce(sum(cs),0)+coalesce(sum(ct),0) AS csum, count(cs)+count(ct) AS cn, least(min(cs), min(ct)) AS cmin
  FROM qst GROUP BY relation_id) q USING (relation_id)""",
)
cte(
    "qrb",
    """
SELECT *, CASE WHEN NOT available THEN 'missing' WHEN identity_error THEN 'poor_identity' WHEN correct_joint_steps = 5 THEN 'perfect_5'
  WHEN correct_joint_steps = 4 THEN 'good_4' WHEN correct_joint_steps = 3 THEN 'partial_3' ELSE 'poor_identity' END AS quality_bin FROM qre""",
)
_QN = "relative_joint_recall source_purity target_purity mean_link_confidence minimum_link_confidence".split()
_BINS = ("perfect_5", "good_4", "partial_3", "poor_identity", "missing")


def _rates(columns: str) -> str:
    return f"{columns}, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')}"


def _recall() -> str:
    return """WITH rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, relation_id, i) AS rank FROM plg WHERE available),
su AS (SELECT predicate, sum(t)::BIGINT AS support FROM plg GROUP BY predicate),
fo AS (SELECT k, s.predicate, s.support, (SELECT count(*) FROM rk WHERE rk.predicate = s.predicate AND t = 1 AND rank <= k) AS found
  FROM su s, (VALUES (10), (20), (50), (100)) v(k))
SELECT k, predicate AS name, round(found/greatest(support,1), 6) + 0.0 AS recall FROM fo
UNION ALL SELECT k, 'R', round(sum(found)/greatest(sum(support),1), 6) + 0.0 FROM fo GROUP BY k
UNION ALL SELECT k, 'mR', round(coalesce(avg(found/support) FILTER (WHERE support > 0), 0), 6) + 0.0 FROM fo GROUP BY k"""


SQL = {
    "ev_average_precision": sql(f"SELECT predicate, {r6('ap', 'average_precision')} FROM ({_per('plg', '')})"),
    "ev_confusion": sql(f"SELECT {_rates('predicate, tp, fp, fn, support')} FROM ({_per('plg', '')})"),
    "ev_multilabel": sql(f"SELECT examples, unsupported_predicates, {_FIGR} FROM ({sql(_multi('plg', ''))})"),
    "ev_object": sql(
        f"""WITH g AS (SELECT label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS guess FROM embeddings),
c AS (SELECT i AS class, (SELECT count(*) FROM g WHERE label = i AND guess = i) AS tp, (SELECT count(*) FROM g WHERE label <> i AND guess = i) AS fp,
  (SELECT count(*) FROM g WHERE label = i AND guess <> i) AS fn FROM range(0, 10) r(i)),
m AS (SELECT *, tp+fn AS support, tp/greatest(tp+fp,1) AS precision, tp/greatest(tp+fn,1) AS recall,
  2.0::DOUBLE*(tp/greatest(tp+fp,1))*(tp/greatest(tp+fn,1))/greatest(tp/greatest(tp+fp,1)+tp/greatest(tp+fn,1), 1e-12) AS f1 FROM c)
SELECT {_rates('class, support')}, NULL::DOUBLE AS accuracy FROM m
UNION ALL SELECT -1, sum(support)::BIGINT, NULL, NULL, {r6('avg(f1) FILTER (WHERE support > 0)', 'f1')}, round(sum(tp)/greatest(sum(support),1), 6) FROM m"""
    ),
    "ev_mask_unavailable": sql(
        f"SELECT relation_id, {_r8('l1::DOUBLE', 'logit_0')}, {_r8('l2::DOUBLE', 'logit_1')}, {_r8('l3::DOUBLE', 'logit_2')} FROM pmk"
    ),
    "ev_recall_at_k": sql(_recall()),
    "ev_coverage": sql(
        f"""SELECT count(*) AS examples, count(*) FILTER (WHERE available) AS eligible_examples, {r6('avg(available::INT)', 'candidate_coverage')},
  sum(t1+t2+t3)::BIGINT AS positive_triplets, sum(t1+t2+t3) FILTER (WHERE available)::BIGINT AS eligible_positive_triplets FROM pred"""
    ),
    "ev_combined": sql(
        f"""SELECT count(*) AS predicates, {r6('avg(f1)', 'macro_f1')}, {r6('avg(ap)', 'mean_average_precision')}
FROM (SELECT * FROM ({_per('tlg', '')}) UNION ALL SELECT * FROM ({_per('mlg', '')})) WHERE support > 0"""
    ),
    "ev_selection_score": sql(
        f"""SELECT sequence, {r6('CASE WHEN sequence % 2 = 0 THEN (mean_average_precision+macro_f1+exact_match_accuracy)/3 ELSE (mean_average_precision+macro_f1)/2 END', 'selection_score')}
FROM ({sql(_multi('plg', 'sequence'))})"""
    ),
    "ev_relation_metadata": sql(
        "SELECT relation_id, sequence || ':' || group_id AS group_id, sequence, CASE WHEN sequence < 5 THEN available END AS available FROM pred"
    ),
    "ev_provenance_check": sql(
        """SELECT DISTINCT c.c_custkey AS sequence, md5((c.c_custkey % 5 + 1)::VARCHAR) AS expected_checkpoint, md5(o.o_orderpriority[1]) AS checkpoint
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
WHERE o.o_orderpriority IS NULL OR o.o_orderpriority[1] <> (c.c_custkey % 5 + 1)::VARCHAR"""
    ),
    "ev_available_only": sql(f"SELECT examples, unsupported_predicates, {_FIGR} FROM ({sql(_multi('pav_l', ''))})"),
    "an_align": sql(
        f"""SELECT t.relation_id, t.sequence, {', '.join(_r8(f'{a}.l{i+1}', f'{n}_{i}') for a, n in (('t', 'teacher'), ('p', 'predicted')) for i in range(3))}
FROM tch t JOIN pred p USING (relation_id)"""
    ),
    "an_align_violations": sql(
        """SELECT 'teacher_only' AS rule, 0::BIGINT AS violations
UNION ALL SELECT 'predicted_only', count(*) FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'duplicate_ids', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'sequence_differs', count(*) FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'P'
UNION ALL SELECT 'targets_differ', 0"""
    ),
    "an_records": sql(f"SELECT * REPLACE ({', '.join(r6(n, n) for n in _QN)}) FROM qrb"),
    "an_quality_bin": sql("SELECT sequence, quality_bin, count(*) AS relations FROM qrb GROUP BY ALL"),
    "an_token_check": sql(
        """WITH rt AS (SELECT p.relation_id, p.t_rows, r.b_annotations, p.jm, p.joint_steps, p.unavailable_reason FROM pav p JOIN tp_rel r ON r.token = p.relation_id)
SELECT 'source_token_mismatch' AS rule, 0::BIGINT AS violations
UNION ALL SELECT 'target_token_mismatch', count(*) FROM (SELECT DISTINCT t_rows[i], b_annotations[i % 5 + 1] FROM rt, range(1, 6) s(i))
UNION ALL SELECT 'availability_differs', count(*) FROM rt WHERE (unavailable_reason = 'available') <> (joint_steps >= 3)"""
    ),
    "an_stratified_metrics": sql(
        f"SELECT slice_sequence, stratum, positive_labels, examples, {', '.join(r6(n, n) for n in _STR)} FROM str"
    ),
    "an_reason_counts": sql(
        "SELECT 'reason' AS kind, CASE WHEN available THEN 'available' ELSE 'middle_step_missing' END AS name, count(*) AS relations FROM oql GROUP BY available "
        + " ".join(f"UNION ALL SELECT 'quality_bin', '{b}', count(*) FROM oql WHERE quality_bin = '{b}'" for b in _BINS)
    ),
    "an_summary_table": sql(
        f"""SELECT slice_sequence AS sequence, stratum AS quality_bin, examples, positive_labels, {', '.join(r6(n, n) for n in _SUM)}
FROM str WHERE stratum <> 'available_only'"""
    ),
}
