"""Queries on learning events and on retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..operators import learning as ln
from ..operators import maintenance, retrieval
from .maintenance_queries import SQL as MAINTENANCE_SQL
from .maintenance_queries import _pairs
from .retrieval_queries import CHUNK_TEXT, SYMBOL_SQL, _bm25_sql, _hints


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def idempotent_events(spark, d):
    return ln.unique_events(_t(spark, d, "learning_events")).select("event_id", "idempotency_key")


def event_order_faults(spark, d):
    return ln.order_faults(ln.unique_events(_t(spark, d, "learning_events")))


def learning_state(spark, d):
    return ln.learning_states(_t(spark, d, "learning_events"))


def learner_depth(spark, d):
    return ln.learner_depth(ln.learning_states(_t(spark, d, "learning_events")))


def review_queue(spark, d):
    return ln.review_queue(ln.learning_states(_t(spark, d, "learning_events")))


def next_orders(spark, d):
    return ln.next_orders(_t(spark, d, "learning_events"))


def rubric_verdict(spark, d):
    return ln.rubric_verdicts(_t(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_returnflag") == "N", F.col("l_linenumber") == 1)


def continuity_mapping(spark, d):
    return ln.continuity(maintenance.manifest_diff(maintenance.snapshot_entries(_t(spark, d, "repo_files")), _pairs(spark, d)))


def _ranked(spark, d):
    chunks = _t(spark, d, "code_chunks")
    asked = chunks.where("id % 50 = 0").select(F.col("id").alias("hint_id"), F.col("qualified_name").alias("value"))
    lexical = retrieval.bm25(chunks, "id", retrieval.chunk_text(), asked, "hint_id", F.col("value"), ["path", "start_line", "end_line", "id"], 8)
    # gold is the chunk itself and the first copy of its content
    first = chunks.groupBy("content_hash").agg(F.min("id").alias("id"))
    own = chunks.where("id % 50 = 0").select(F.col("id").alias("hint_id"), "content_hash")
    gold = own.select("hint_id", F.col("hint_id").alias("id")).unionByName(own.join(first, "content_hash").select("hint_id", "id")).distinct()
    return lexical, retrieval.symbol_matches(chunks, _hints(spark, d), 8), gold


def gold_metrics(spark, d):
    lexical, _, gold = _ranked(spark, d)
    return e.query_metrics(lexical, gold, "hint_id", "id")


def metric_rollups(spark, d):
    lexical, _, gold = _ranked(spark, d)
    scored = e.query_metrics(lexical, gold, "hint_id", "id").join(_t(spark, d, "code_chunks").select(F.col("id").alias("hint_id"), "project_id", "chunk_type"), "hint_id")
    return e.roll_up(scored, "project_id", "chunk_type", ["hit_at_1", "hit_at_5", "mrr_at_8", "ndcg_at_8"])


def paired_effects(spark, d):
    lexical, symbol, gold = _ranked(spark, d)
    return e.paired_effects(e.query_metrics(lexical, gold, "hint_id", "id"), e.query_metrics(symbol, gold, "hint_id", "id"), "hint_id", "mrr_at_8")


def bootstrap_ci(spark, d):
    lexical, _, gold = _ranked(spark, d)
    scored = e.query_metrics(lexical, gold, "hint_id", "id").join(_t(spark, d, "code_chunks").select(F.col("id").alias("hint_id"), "chunk_type"), "hint_id")
    return e.bootstrap(scored, "chunk_type", "hint_id", "mrr_at_8")


def latency_percentiles(spark, d):
    return e.percentiles(_t(spark, d, "events"), "event_type", "value")


def cost_rollup_unknown(spark, d):
    return e.poisoned_sum(_t(spark, d, "events"), "user_id", F.col("value"), F.col("event_type") != "signup")


def round_robin_batches(spark, d):
    return e.round_robin(_t(spark, d, "eval_questions"), "item_id", 4)


def dataset_faults(spark, d):
    return e.dataset_faults(_t(spark, d, "eval_questions"), _t(spark, d, "code_chunks"), _t(spark, d, "repo_files"))


QUERIES = {
    f.__name__: f
    for f in (
        idempotent_events, event_order_faults, learning_state, learner_depth, review_queue, next_orders, rubric_verdict, continuity_mapping, gold_metrics,
        metric_rollups, paired_effects, bootstrap_ci, latency_percentiles, cost_rollup_unknown, round_robin_batches, dataset_faults,
    )
}

UNIQUE = """u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY event_order, event_id) AS at_row FROM learning_events WHERE idempotency_key IS NOT NULL) WHERE at_row = 1
  UNION ALL SELECT *, 1 FROM learning_events WHERE idempotency_key IS NULL)"""
_J = lambda f: f"CASE WHEN json_valid(j) THEN json_extract_string(j, '$.{f}') END"
_SHAKEN = "('changed', 'missing', 'ambiguous', 'stale')"
_TASKS = ", ".join(f"'{t}'" for t in sorted(ln.QUALIFYING))
#: the states event by event: a recursive walk, where the operator aggregates latest positions
STATES = f"""{UNIQUE},
o0 AS (SELECT learner_id, project_id, target_id, event_id, event_order, event_type, provenance, task_id, validated_outcome_json AS j FROM u),
fx AS (SELECT rev AS event_id, arg_max({{'v': nv, 't': tt}}, {{'o': event_order, 'e': event_id}}) AS fix FROM (SELECT event_id, event_order, {_J("reverses_event_id")} AS rev, {_J("corrected_verdict")} AS nv, {_J("task_type")} AS tt FROM o0 WHERE event_type = 'evaluation_corrected') WHERE rev IS NOT NULL GROUP BY 1),
o AS (SELECT o0.*, fix, row_number() OVER (PARTITION BY learner_id, project_id, target_id ORDER BY event_order, o0.event_id) AS n, count(*) OVER (PARTITION BY learner_id, project_id, target_id) AS total FROM o0 LEFT JOIN fx ON fx.event_id = o0.event_id),
x AS (SELECT *, CASE WHEN fix IS NULL THEN {_J("verdict")} ELSE fix.v END AS verdict, CASE WHEN fix IS NULL THEN {_J("task_type")} ELSE fix.t END AS tt, coalesce(nullif({_J("availability")}, ''), 'stale') AS av,
  coalesce(nullif({_J("mapping_status")}, ''), 'unmapped') AS mp, coalesce({_J("source_mastery_status")}, 'unseen') AS came,
  greatest(coalesce(try_cast({_J("source_verified_pass_count")} AS BIGINT), 0), 0) AS cp, greatest(coalesce(try_cast({_J("source_qualifying_pass_count")} AS BIGINT), 0), 0) AS cq,
  CASE WHEN provenance = 'explicit_self_report' THEN 's' WHEN event_type = 'attempt_evaluated' AND provenance = 'verified_assessment' THEN 'a' WHEN event_type = 'revision_revalidated' THEN 'r'
    WHEN event_type = 'continuity_state_derived' AND provenance = 'revision_continuity' THEN CASE WHEN {_J("mapping_status")} IN ('unchanged_exact', 'renamed_exact') THEN 'e' ELSE 'c' END ELSE '-' END AS k FROM o),
y AS (SELECT *, k = 'a' AND verdict = 'pass' AND coalesce(task_id, '') <> '' AS won, CASE WHEN k = 'a' AND verdict = 'pass' AND coalesce(task_id, '') <> '' AND tt IN ({_TASKS}) THEN [task_id] ELSE [] END AS good FROM x),
f AS (
  SELECT learner_id, project_id, target_id, 0::BIGINT AS n, 'unseen' AS mastery, 'current' AS availability, []::VARCHAR[] AS passed, []::VARCHAR[] AS qualified, 0::BIGINT AS bp, 0::BIGINT AS bq, '' AS reason, NULL::VARCHAR AS last_event_id, total FROM y WHERE n = 1
  UNION ALL
  SELECT f.learner_id, f.project_id, f.target_id, y.n,
    CASE WHEN won THEN CASE WHEN len(list_distinct(list_append(passed, task_id))) + bp >= 2 AND len(list_distinct(list_concat(qualified, good))) + bq >= 1 THEN 'mastered' ELSE 'demonstrated' END
      WHEN k = 's' THEN CASE WHEN mastery = 'unseen' THEN 'introduced' ELSE mastery END
      WHEN k = 'a' AND verdict = 'partial' AND mastery IN ('unseen', 'introduced', 'practicing') THEN 'practicing'
      WHEN k = 'a' AND verdict = 'fail' THEN CASE WHEN len(passed) + bp > 0 THEN 'needs_review' ELSE 'practicing' END
      WHEN k = 'r' AND av IN {_SHAKEN} OR k = 'c' THEN 'needs_review' WHEN k = 'e' THEN CASE WHEN came IN ({", ".join(f"'{m}'" for m in ln.MASTERY)}) THEN came ELSE 'needs_review' END ELSE mastery END,
    CASE WHEN k = 'a' THEN 'current' WHEN k IN ('r', 'c', 'e') THEN av ELSE availability END,
    CASE WHEN won THEN list_distinct(list_append(passed, task_id)) WHEN k = 'e' THEN [] ELSE passed END,
    CASE WHEN won THEN list_distinct(list_concat(qualified, good)) WHEN k = 'e' THEN [] ELSE qualified END,
    CASE WHEN k = 'e' THEN cp ELSE bp END, CASE WHEN k = 'e' THEN cq ELSE bq END,
    CASE WHEN won OR k = 'e' THEN '' WHEN k = 'a' AND verdict = 'fail' THEN 'validated_failure' WHEN k = 'r' AND av IN {_SHAKEN} THEN 'revision_' || av WHEN k = 'c' THEN 'revision_' || mp ELSE reason END,
    y.event_id, f.total
  FROM f JOIN y ON y.learner_id IS NOT DISTINCT FROM f.learner_id AND y.project_id IS NOT DISTINCT FROM f.project_id AND y.target_id IS NOT DISTINCT FROM f.target_id AND y.n = f.n + 1),
st AS (SELECT learner_id, project_id, target_id, mastery, availability, len(passed) + bp AS passes, len(qualified) + bq AS qualifying_passes, reason AS review_reason, last_event_id, total AS events FROM f WHERE n = total)"""
RANKED = _bm25_sql("x", "code_chunks", "id", CHUNK_TEXT, "SELECT id AS q, qualified_name AS qtext FROM code_chunks WHERE id % 50 = 0", "c.path, c.start_line, c.end_line, c.id", 8)
GOLD = "gd AS (SELECT id AS hint_id, id FROM code_chunks WHERE id % 50 = 0 UNION SELECT c.id, f.id FROM code_chunks c JOIN (SELECT content_hash, min(id) AS id FROM code_chunks GROUP BY 1) f USING (content_hash) WHERE c.id % 50 = 0), gs AS (SELECT hint_id, count(*) AS gold FROM gd GROUP BY 1)"


def _metrics(name: str, ranked: str) -> str:
    cuts = ", ".join(
        f"CASE WHEN coalesce(n{k}, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_{k}, round(coalesce(n{k}, 0) / gold, 6) AS recall_at_{k},"
        f" round(coalesce(g{k}, 0) / list_sum(list_transform(range(1, least(gold, {k}) + 1), lambda r: 1.0::DOUBLE / log2(r + 1.0))), 6) AS ndcg_at_{k}"
        for k in e.CUTS
    )
    aggs = ", ".join(f"count(*) FILTER (place <= {k}) AS n{k}, sum(1.0::DOUBLE / log2(place + 1.0)) FILTER (place <= {k}) AS g{k}" for k in e.CUTS)
    return f"""h{name} AS (SELECT hint_id, min(place) AS first, {aggs} FROM ({ranked}) JOIN gd USING (hint_id, id) GROUP BY 1),
m{name} AS (SELECT hint_id, gold, {cuts}, round(CASE WHEN first <= 8 THEN 1.0::DOUBLE / first ELSE 0 END, 6) AS mrr_at_8 FROM gs LEFT JOIN h{name} USING (hint_id))"""


LEXICAL = _metrics("l", "SELECT q AS hint_id, k AS id, place FROM xrk")
SYMBOL = _metrics("s", "SELECT hint_id, id, place FROM sy WHERE place <= 8")

SQL = {
    "idempotent_events": f"WITH {UNIQUE} SELECT event_id, idempotency_key FROM u",
    "event_order_faults": f"""
WITH {UNIQUE}, p AS (SELECT event_id, event_order, created_at, lag(event_order) OVER w AS po, lag(created_at) OVER w AS pc, lag(event_id) OVER w AS before FROM u WINDOW w AS (PARTITION BY learner_id, project_id, target_id ORDER BY event_order, event_id))
SELECT event_id, before FROM p WHERE po >= event_order OR pc > created_at
""",
    "learning_state": f"WITH RECURSIVE {STATES} SELECT * FROM st",
    "learner_depth": f"WITH RECURSIVE {STATES}, c AS (SELECT learner_id, count(*) AS targets, "
    + ", ".join(f"count(*) FILTER (mastery = '{m}') AS {m}" for m in ln.MASTERY)
    + " FROM st GROUP BY 1) SELECT *, CASE WHEN needs_review > 0 THEN 'foundational_review' WHEN mastered > 0 THEN 'advanced' WHEN demonstrated > 0 THEN 'intermediate' ELSE 'novice' END AS depth FROM c",
    "review_queue": f"""
WITH RECURSIVE {STATES} SELECT * FROM (SELECT learner_id, project_id, target_id, mastery, row_number() OVER (PARTITION BY learner_id ORDER BY
  CASE mastery WHEN 'needs_review' THEN 0 WHEN 'practicing' THEN 1 WHEN 'introduced' THEN 2 WHEN 'demonstrated' THEN 3 WHEN 'mastered' THEN 4 ELSE 6 END, project_id NULLS FIRST, target_id NULLS FIRST) AS place FROM st) WHERE place <= 16
""",
    "next_orders": "SELECT learner_id, project_id, target_id, max(event_order) + 1 AS next_order FROM learning_events GROUP BY 1, 2, 3",
    "rubric_verdict": """
WITH r AS (SELECT l_orderkey, round(coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 0), 6) AS ratio, count(*) FILTER (l_linenumber = 1 AND l_returnflag <> 'N') AS broken FROM lineitem GROUP BY 1)
SELECT l_orderkey, ratio, CASE WHEN broken = 0 AND ratio >= 0.8 THEN 'pass' WHEN ratio > 0 THEN 'partial' ELSE 'fail' END AS verdict FROM r
""",
    "continuity_mapping": f"""
SELECT new_id, coalesce(old_path, path) AS path, CASE change WHEN 'unchanged' THEN 'unchanged_exact' WHEN 'renamed' THEN 'renamed_exact' ELSE change END AS status, CASE WHEN change <> 'deleted' THEN path END AS target
FROM ({MAINTENANCE_SQL["manifest_diff"]}) WHERE change <> 'added'
""",
    "gold_metrics": f"WITH {RANKED}, {GOLD}, {LEXICAL} SELECT * FROM ml",
    "metric_rollups": f"""
WITH {RANKED}, {GOLD}, {LEXICAL}, z AS (SELECT ml.*, project_id, chunk_type FROM ml JOIN code_chunks c ON c.id = hint_id),
a AS (SELECT project_id, chunk_type, count(*) AS queries, avg(hit_at_1) AS a1, avg(hit_at_5) AS a5, avg(mrr_at_8) AS am, avg(ndcg_at_8) AS an, grouping(project_id) AS gp, grouping(chunk_type) AS gc FROM z GROUP BY GROUPING SETS ((project_id), (chunk_type), ()))
SELECT CASE WHEN gp = 0 THEN 'repository' WHEN gc = 0 THEN 'stratum' ELSE 'micro' END AS level, project_id AS repository, chunk_type AS stratum, queries, round(a1, 6) AS hit_at_1, round(a5, 6) AS hit_at_5, round(am, 6) AS mrr_at_8, round(an, 6) AS ndcg_at_8 FROM a
UNION ALL SELECT 'macro', NULL, NULL, sum(queries)::BIGINT, round(avg(a1), 6), round(avg(a5), 6), round(avg(am), 6), round(avg(an), 6) FROM a WHERE gp = 0
""",
    "paired_effects": f"""
WITH {RANKED}, {SYMBOL_SQL}, {GOLD}, {LEXICAL}, {SYMBOL}, p AS (SELECT ms.mrr_at_8 - ml.mrr_at_8 AS d FROM ml JOIN ms USING (hint_id))
SELECT count(*) AS queries, count(*) FILTER (d > 0) AS improved, count(*) FILTER (d = 0) AS unchanged, count(*) FILTER (d < 0) AS regressed, round(avg(d), 6) AS mean_difference FROM p
""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "cost_rollup_unknown": "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN round(sum(value), 4) END AS total, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'unknown' ELSE 'calculated' END AS status FROM events GROUP BY 1",
    "round_robin_batches": "SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 4 AS batch FROM eval_questions",
    "dataset_faults": rf"""
WITH t AS (SELECT question, min(item_id) AS first FROM eval_questions GROUP BY 1 HAVING count(*) > 1)
SELECT item_id, 'duplicate_question' AS fault FROM eval_questions JOIN t USING (question) WHERE item_id <> first
UNION ALL SELECT item_id, 'unknown_path' FROM eval_questions WHERE expected_file_path IS NOT NULL AND expected_file_path NOT IN (SELECT regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') FROM repo_files WHERE path IS NOT NULL)
UNION ALL SELECT item_id, 'unknown_symbol' FROM eval_questions WHERE expected_symbol IS NOT NULL AND expected_symbol NOT IN (SELECT symbol_name FROM code_chunks WHERE symbol_name IS NOT NULL)
UNION ALL SELECT item_id, 'no_expectation' FROM eval_questions WHERE answerable AND expected_file_path IS NULL AND expected_symbol IS NULL
""",
}
