"""Queries on citations, stored-table scans and targets, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import LANGUAGE_BY_SUFFIX
from ..operators import citations as c
from ..operators import evaluation as ev
from ..operators import learning as ln
from ..operators import lookups as k
from ..operators import structure
from .catalog_queries import P
from .indexing_queries import XRK
from .learning_queries import GOLD, LEXICAL, RANKED, STATES, SYMBOL, UNIQUE, _ranked
from .maintenance_queries import _pairs
from .retrieval_queries import SYMBOL_SQL, bm25_topk


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cited(spark, d):
    """All chunks as evidence; of every twenty most have one thing wrong, each rule in its turn."""
    rows = c.evidence(_t(spark, d, "code_chunks"), _t(spark, d, "projects")).withColumn("key", F.col("chunk_id"))
    n = F.col("key") % 20
    put = lambda name, when, value: F.when(n == when, value).otherwise(F.col(name)).alias(name)
    tail = lambda name: F.concat(name, F.lit("x"))
    faults = {
        "chunk_id": (1, F.lit(0).cast("long")), "path": (2, F.concat(F.lit("../"), "path")), "project_id": (3, F.lit("nowhere")), "repository_id": (4, tail("repository_id")), "repository_url": (5, tail("repository_url")),
        "repository_revision": (6, tail("repository_revision")), "language": (7, F.lit("Ada")), "start_line": (8, F.lit(0)), "content_hash": (11, tail("content_hash")), "symbol_name": (12, tail("symbol_name")),
        "qualified_name": (13, tail("qualified_name")), "chunk_identity": (14, tail("chunk_identity")), "excerpt": (15, tail("excerpt")),
    }
    end = F.when(n == 9, F.col("end_line") + 100_000).when((n == 10) & (F.col("end_line") > F.col("start_line")), F.col("end_line") - 1).otherwise(F.col("end_line")).alias("end_line")
    return rows.select("key", end, *[put(name, *faults[name]) if name in faults else F.col(name) for name in rows.columns if name not in ("key", "end_line")])


def citation_checks(spark, d):
    return c.citation_checks(_cited(spark, d), _t(spark, d, "code_chunks"), _t(spark, d, "repo_files"), _t(spark, d, "projects"))


def citation_batches(spark, d):
    return c.split_checks(citation_checks(spark, d))


def evidence_store(spark, d):
    chunks = _t(spark, d, "code_chunks")
    shown = bm25_topk(spark, d).join(chunks.select("id", F.col("content_hash").alias("chunk_identity")), "id").select("item_id", "chunk_identity", "place")
    return c.evidence_store(shown, "item_id", 12)


def rendered_answers(spark, d):
    """Every question as an answer of two parts citing the first results; some name none, too many or unknown ones."""
    aliases = bm25_topk(spark, d).select("item_id", F.concat(F.lit("A"), F.col("place")).alias("alias"), F.concat(F.lit("[E"), F.col("place"), F.lit("]")).alias("token"))
    asked = _t(spark, d, "eval_questions").where("item_id % 50 = 0")
    n = F.floor(F.col("item_id") / 50) % 4
    second = F.when(n == 1, F.array(F.lit("A99"))).when(n == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("A2"), F.lit("A1")))
    parts = asked.select("item_id", F.lit(1).alias("part_no"), F.col("question").alias("text"), F.array(F.lit("A1")).alias("aliases")).unionByName(
        asked.select("item_id", F.lit(2).alias("part_no"), F.when(n == 3, "as [E1] says").otherwise("and so").alias("text"), second.alias("aliases"))
    )
    out = c.rendered_answers(parts, aliases, "item_id")
    return out.select("item_id", F.sha2("answer", 256).alias("answer_hash"), "failure")


def project_bundle(spark, d):
    return k.project_bundle(_t(spark, d, "repo_files"), _t(spark, d, "code_chunks"))


def method_scan(spark, d):
    return k.chunk_scan(_t(spark, d, "code_chunks"), chunk_type="method", language="PYTHON").select("id", "place")


def chunks_by_ids(spark, d):
    chunks = _t(spark, d, "code_chunks")
    return k.by_ids(chunks, chunks.where("id % 50 = 0").select("id"), "id")


def project_lookup(spark, d):
    return k.project_lookup(_t(spark, d, "projects"))


def project_workspaces(spark, d):
    return k.workspaces(_t(spark, d, "projects"), _t(spark, d, "repo_files"), _t(spark, d, "code_chunks"), 5, 100)


def directory_files(spark, d):
    chunks = _t(spark, d, "code_chunks")
    places = chunks.select("project_id", F.element_at(F.split("path", "/"), 1).alias("directory")).unionByName(chunks.where("id % 50 = 0").select("project_id", F.col("path").alias("directory")))
    return k.in_directory(_t(spark, d, "repo_files"), places)


def unit_norms(spark, d):
    return k.unit_norms(_t(spark, d, "embeddings"), "vec_id", "embedding")


def embedding_identities(spark, d):
    return k.embedding_identities(_t(spark, d, "code_chunk_embeddings"))


def readme_excerpts(spark, d):
    return k.readme_excerpts(_t(spark, d, "repo_files"))


def file_summaries(spark, d):
    return k.file_summaries(_t(spark, d, "repo_files").where("symbols_json IS NULL OR try_parse_json(symbols_json) IS NOT NULL"))


def priced_usage(spark, d):
    rows = _t(spark, d, "documents").select("project_id", F.char_length("text").alias("i"), "n_chars")
    return k.priced_usage(rows, "project_id", "i", "n_chars", 3.0, 15.0)


def dataset_shape(spark, d):
    return k.dataset_shape(_t(spark, d, "eval_questions"), 80)


def run_differences(spark, d):
    lexical, symbol, _ = _ranked(spark, d)
    return k.run_differences(lexical, symbol, "hint_id")


def containment_matches(spark, d):
    lexical, _, gold = _ranked(spark, d)
    return k.containment_matches(lexical, gold, _t(spark, d, "code_chunks"), "hint_id")


def learning_targets(spark, d):
    return ln.targets(_t(spark, d, "learning_events"))


def _ordered(spark, d):
    events = _t(spark, d, "learning_events")
    return ln.states_of_targets(ln.targets(events), ln.learning_states(events.where("event_type != 'self_reported'")))


def target_states(spark, d):
    return _ordered(spark, d)


def next_actions(spark, d):
    return ln.next_actions(_ordered(spark, d))


def last_events(spark, d):
    return ln.last_events(_t(spark, d, "learning_events"))


def state_audit(spark, d):
    """States stored before the revalidations came, against all events."""
    events = _t(spark, d, "learning_events")
    return ln.state_audit(ln.learning_states(events.where("event_type != 'revision_revalidated'")), ln.learning_states(events))


def target_checks(spark, d):
    """The files of each delivery as targets in the next one; names are the projects' pairs and file names."""
    pairs = _pairs(spark, d)
    files = _t(spark, d, "repo_files").where("content IS NOT NULL AND path IS NOT NULL")
    path = F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", "")
    side = lambda one: files.join(pairs.select(F.col(one).alias("project_id"), F.col("new_id").alias("pair")), "project_id").select(
        F.concat_ws("\t", "pair", F.element_at(F.split(path, "/"), -1)).alias("name"), path.alias("path"), F.sha2(F.concat_ws("\t", "pair", "content"), 256).alias("digest")
    )
    old = side("old_id").distinct()
    return ln.target_checks(old, old, side("new_id").distinct())


def path_labels(spark, d):
    """Five runs of the chunk questions: eight and five results by words and by symbols, and the first three of either."""
    lexical, symbol, gold = _ranked(spark, d)
    a, b = (ev.query_metrics(x, gold, "hint_id", "id") for x in (lexical, symbol))
    hit = lambda c: F.col(c) > 0
    runs = a.select("hint_id", hit("hit_at_8").alias("A"), hit("hit_at_5").alias("C"), hit("hit_at_3").alias("x")).join(b.select("hint_id", hit("hit_at_8").alias("B"), hit("hit_at_5").alias("D"), hit("hit_at_3").alias("y")), "hint_id")
    return ev.path_labels(runs.withColumn("E", F.col("x") | F.col("y")), "hint_id")


def snapshot_faults(spark, d):
    return k.snapshot_faults(_t(spark, d, "projects"), _t(spark, d, "code_chunks"), _t(spark, d, "code_chunk_embeddings"))


def validated_policies(spark, d):
    """Weights and pools that run over the bounds with the questions' numbers."""
    n = F.col("item_id")
    rows = _t(spark, d, "eval_questions").select("item_id", (n / 40).alias("dense_weight"), F.when(n % 7 == 0, F.lit(float("nan"))).otherwise(1.0).alias("lexical_weight"), F.when(n % 11 != 0, n / 30).alias("symbol_weight"), (n % 60).alias("pool"))
    return k.validated_policies(rows, "item_id")


def _mappings(spark, d):
    """A status for every target, by the number in its name."""
    n = F.regexp_extract("target_id", r"(\d+)$", 1).try_cast("int") % 5
    names = F.element_at(F.array(*map(F.lit, ("unchanged_exact", "modified", "ambiguous", "unmapped", "renamed_exact"))), F.coalesce(n, F.lit(3)) + 1)
    return _t(spark, d, "learning_events").select(*ln.KEY).distinct().select("*", names.alias("status"))


def _ruled(spark, d):
    """The events with outcomes that bring every rule to bear: qualifying tasks, exact mappings, availabilities, corrections of a key's first attempt."""
    events = _t(spark, d, "learning_events")
    tried = events.where("event_type = 'attempt_evaluated'").groupBy(*[F.col(c).alias(f"_{c}") for c in ln.KEY]).agg(F.min(F.struct("event_order", "event_id")).alias("f"))
    rows = events.join(tried, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ln.KEY], "left")
    n, kind = F.col("event_order"), F.col("event_type")
    verdict = F.coalesce(F.get_json_object("validated_outcome_json", "$.verdict"), F.lit("none"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (n % by + 1).cast("int"))
    told = (
        F.when(kind == "attempt_evaluated", F.format_string('{"verdict": "%s", "task_type": "%s"}', verdict, pick(("explain_symbol", "recall"), 2)))
        .when(kind == "revision_revalidated", pick(('{"availability": "current"}', '{"availability": "changed"}', "{}"), 3))
        .when(kind == "continuity_state_derived", pick(RULED_MAPPINGS, 4))
        .when(kind == "evaluation_corrected", F.format_string('{"reverses_event_id": "%s", "corrected_verdict": "%s", "task_type": "explain_symbol"}', F.coalesce("f.event_id", F.lit("")), pick(("pass", "fail", "partial"), 3)))
        .otherwise(F.col("validated_outcome_json"))
    )
    return rows.withColumn("validated_outcome_json", told).select(*events.columns)


RULED_MAPPINGS = (
    '{"mapping_status": "unchanged_exact", "availability": "current", "source_mastery_status": "mastered", "source_verified_pass_count": 2, "source_qualifying_pass_count": 1}',
    '{"mapping_status": "renamed_exact", "availability": "current", "source_mastery_status": "introduced"}', '{"mapping_status": "ambiguous", "availability": "ambiguous"}', '{"mapping_status": "modified"}',
)


def learning_state_ruled(spark, d):
    return ln.learning_states(_ruled(spark, d))


def published_states(spark, d):
    return ln.published_states(ln.learning_states(_t(spark, d, "learning_events").where("event_type != 'revision_revalidated'")), _mappings(spark, d))


def goal_lineage(spark, d):
    return ln.goal_lineage(_t(spark, d, "learning_events").where("goal_id IS NOT NULL"), _mappings(spark, d))


def fitted_events(spark, d):
    events = ln.unique_events(_t(spark, d, "learning_events")).where("validated_outcome_json IS NOT NULL AND learner_id IS NOT NULL")
    kept = ln.fitted(events, "learner_id", [F.desc("created_at"), F.desc("event_order"), F.desc("event_id")], F.col("validated_outcome_json"), 512)
    return kept.select("event_id", "used", "truncated")


def task_checks(spark, d):
    events = _ruled(spark, d)
    return ln.task_checks(events, ln.learning_states(events))


def redacted_json(spark, d):
    return k.redacted_json(_t(spark, d, "repo_files").where(F.lower("path").endswith(".json")), "id", "content")


def paired_by_repository(spark, d):
    lexical, symbol, gold = _ranked(spark, d)
    of = _t(spark, d, "code_chunks").select(F.col("id").alias("hint_id"), "project_id")
    a, b = (ev.query_metrics(x, gold, "hint_id", "id").join(of, "hint_id") for x in (lexical, symbol))
    return ev.paired_by_repository(a, b, "hint_id", "project_id", "mrr_at_8")


def scenario_metrics(spark, d):
    lexical, _, gold = _ranked(spark, d)
    return ev.scenario_metrics(lexical, gold, _t(spark, d, "code_chunks"), "hint_id")


def python_profiles(spark, d):
    rows = structure.python_profiles(_t(spark, d, "repo_files"))
    return rows.select("file_id", F.array_join("imports", ",").alias("imports"), F.array_join("symbols", ",").alias("symbols"))


QUERIES = {
    f.__name__: f
    for f in (
        citation_checks, citation_batches, evidence_store, rendered_answers, project_bundle, method_scan, chunks_by_ids, project_lookup, project_workspaces, directory_files, unit_norms,
        embedding_identities, readme_excerpts, file_summaries, priced_usage, dataset_shape, run_differences, containment_matches, learning_targets, target_states, next_actions, last_events, state_audit, target_checks, path_labels, snapshot_faults,
        validated_policies, published_states, goal_lineage, fitted_events, paired_by_repository, scenario_metrics, python_profiles, learning_state_ruled, task_checks, redacted_json,
    )
}

_ID = "concat_ws('|', {t}project_id, {t}repository_revision, {t}path, {t}start_line::VARCHAR, {t}end_line::VARCHAR, {t}content_hash, {t}id::VARCHAR)"
CITED = f"""
fl AS (SELECT project_id, {P} AS path, arg_min(content, id) AS c FROM repo_files WHERE content IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
k AS (SELECT c.*, {_ID.format(t="c.")} AS ident, concat_ws('/', owner, repo) AS rid, coalesce(p.repo_url, '') AS url, p.repository_revision AS prev, c.id % 20 AS n FROM code_chunks c JOIN projects p ON p.id = c.project_id),
e AS (SELECT k.*, c, string_split(c, chr(10)) AS l, CASE WHEN n = 9 THEN end_line + 100000 WHEN n = 10 AND end_line > start_line THEN end_line - 1 ELSE end_line END AS el FROM k LEFT JOIN fl USING (project_id, path)),
w AS (SELECT *, CASE WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END AS m, array_to_string(list_slice(l, start_line, el), chr(10)) || CASE WHEN el < len(l) THEN chr(10) ELSE '' END AS now FROM e),
ck AS (SELECT id AS key, CASE WHEN n = 1 THEN 'invalid chunk identity' WHEN n = 2 THEN 'unsafe repository path' WHEN n = 3 OR c IS NULL THEN 'source file or code chunk no longer exists' WHEN n = 4 THEN 'repository identity mismatch'
  WHEN n = 5 THEN 'repository URL mismatch' WHEN n = 6 OR prev IS DISTINCT FROM repository_revision THEN 'repository revision mismatch' WHEN n = 7 THEN 'language mismatch' WHEN n = 8 THEN 'invalid line range' WHEN el > m THEN 'line range exceeds stored source'
  WHEN now <> content THEN 'stored source no longer matches code chunk' WHEN n = 11 OR sha256(now) <> content_hash THEN 'content hash mismatch' WHEN n = 12 THEN 'symbol identity mismatch' WHEN n = 13 THEN 'qualified symbol identity mismatch'
  WHEN n = 14 THEN 'chunk identity mismatch' WHEN n = 15 AND NOT starts_with(now, substr(content, 1, 2000) || 'x') THEN 'excerpt mismatch' END AS reason FROM w)"""
_LAST = "list_extract(string_split({x}, '/'), -1)"
_LANG = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) = '{s}' THEN '{n}'" for s, n in LANGUAGE_BY_SUFFIX.items()) + " ELSE 'Text' END"
TARGETS = f"{UNIQUE}, tg AS (SELECT learner_id, project_id, target_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT attempt_id) AS attempts, count(DISTINCT evaluation_id) AS evaluations FROM u GROUP BY 1, 2, 3)"
_OF = lambda where: STATES.replace("FROM learning_events WHERE idempotency_key", f"FROM learning_events WHERE {where} AND idempotency_key")
_SAME = "{a}.learner_id IS NOT DISTINCT FROM {b}.learner_id AND {a}.project_id IS NOT DISTINCT FROM {b}.project_id AND {a}.target_id IS NOT DISTINCT FROM {b}.target_id"
_TESTED = "tg AS (SELECT learner_id, project_id, target_id, max(created_at) AS last_seen FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY event_order, event_id) AS r FROM learning_events WHERE idempotency_key IS NOT NULL) WHERE r = 1 UNION ALL SELECT *, 1 FROM learning_events WHERE idempotency_key IS NULL) GROUP BY 1, 2, 3)"
ORDERED = f"""{_OF("event_type <> 'self_reported'")}, {_TESTED},
ot AS (SELECT tg.learner_id, tg.project_id, tg.target_id, coalesce(mastery, 'unseen') AS mastery, row_number() OVER (PARTITION BY tg.learner_id ORDER BY list_position(['needs_review', 'practicing', 'introduced', 'demonstrated', 'mastered', 'unseen'], coalesce(mastery, 'unseen')),
  last_seen DESC, tg.project_id NULLS FIRST, tg.target_id NULLS FIRST) AS place FROM tg LEFT JOIN st ON {_SAME.format(a="tg", b="st")})"""

SQL = {
    "citation_checks": f"WITH {CITED} SELECT * FROM ck",
    "citation_batches": f"WITH {CITED} SELECT key, reason IS NULL AS valid, 'Evidence E' || key || ' was rejected: ' || reason || '.' AS warning FROM ck",
    "evidence_store": f"""
WITH {XRK}, f AS (SELECT q, content_hash, min(place) AS first FROM xrk JOIN code_chunks c ON c.id = k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first, content_hash) AS place FROM f)
SELECT q AS item_id, content_hash AS chunk_identity, 'A' || place AS alias, place FROM r WHERE place <= 12
""",
    "rendered_answers": f"""
WITH {XRK}, a AS (SELECT item_id, question, (item_id // 50) % 4 AS n, (SELECT count(*) FROM xrk WHERE q = item_id) AS hits FROM eval_questions WHERE item_id % 50 = 0),
f AS (SELECT *, CASE WHEN hits < 1 THEN 'citation_alias_unknown' WHEN regexp_matches(question, '\\[E[0-9]+\\]') THEN 'model_supplied_location_forbidden' WHEN n = 1 THEN 'citation_alias_unknown' WHEN n = 2 THEN 'citation_alias_missing' WHEN hits < 2 THEN 'citation_alias_unknown' WHEN n = 3 THEN 'model_supplied_location_forbidden' END AS failure FROM a)
SELECT item_id, CASE WHEN failure IS NULL THEN sha256(question || ' [E1]' || chr(10) || chr(10) || 'and so [E2] [E1]') END AS answer_hash, failure FROM f
""",
    "project_bundle": f"""
WITH f AS (SELECT project_id, {P} AS p, coalesce(importance, 0.0) AS i, id FROM repo_files WHERE path IS NOT NULL), m AS (SELECT DISTINCT project_id, string_split(p, '/')[1] AS k FROM f)
SELECT * FROM (SELECT project_id, 'file' AS kind, row_number() OVER (PARTITION BY project_id ORDER BY -i, p, id) AS place, p AS key FROM f
UNION ALL SELECT project_id, 'module', row_number() OVER (PARTITION BY project_id ORDER BY k), k FROM m
UNION ALL SELECT project_id, 'chunk', row_number() OVER (PARTITION BY project_id ORDER BY concat_ws(chr(9), path, lpad(start_line::VARCHAR, 9, '0'), qualified_name), id), qualified_name FROM code_chunks) WHERE place <= 20
""",
    "method_scan": "SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY path, start_line, qualified_name, id) AS place FROM code_chunks WHERE chunk_type = 'method' AND lower(language) = 'python'",
    "chunks_by_ids": "SELECT * FROM (SELECT id, row_number() OVER (ORDER BY id) AS place, count(*) OVER () > 64 AS truncated FROM code_chunks WHERE id % 50 = 0) WHERE place <= 64",
    "project_lookup": "SELECT source_identity, arg_min(id, (created_at, id)) AS id, count(*) AS deliveries FROM projects WHERE source_identity IS NOT NULL GROUP BY 1",
    "project_workspaces": """
WITH r AS (SELECT p.id, status, CASE WHEN status = 'ready' THEN coalesce(primary_language, 'Unknown') ELSE '' END AS language, (SELECT count(*) FROM repo_files f WHERE f.project_id = p.id) AS files, (SELECT count(*) FROM code_chunks c WHERE c.project_id = p.id) AS chunks,
  row_number() OVER (ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, lower(repo), p.id) AS place FROM projects p) SELECT * FROM r WHERE place > 5 AND place <= 105
""",
    "directory_files": f"""
WITH d AS (SELECT DISTINCT project_id, string_split(path, '/')[1] AS directory FROM code_chunks UNION SELECT project_id, path FROM code_chunks WHERE id % 50 = 0), f AS (SELECT project_id, {P} AS p FROM repo_files WHERE path IS NOT NULL)
SELECT d.project_id, directory, count(*) AS files FROM d JOIN f ON f.project_id = d.project_id AND (p = directory OR starts_with(p, directory || '/')) GROUP BY 1, 2
""",
    "unit_norms": "WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, abs(n - 1) <= 0.001 * greatest(n, 1.0) AS unit FROM n",
    "embedding_identities": """
SELECT sha256(to_json({'embedding_config_hash': coalesce(embedding_config_hash, ''), 'embedding_dimension': coalesce(embedding_dimension::VARCHAR, ''), 'embedding_dtype': coalesce(embedding_dtype, ''), 'identity_schema_version': coalesce(identity_schema_version, ''),
  'model_name': coalesce(model_name, ''), 'resolved_revision': coalesce(resolved_revision, ''), 'text_format_version': coalesce(text_format_version, '')})::VARCHAR) AS identity, model_name, embedding_dimension AS dimension, count(*) AS vectors FROM code_chunk_embeddings GROUP BY 1, 2, 3
""",
    "readme_excerpts": f"""
WITH f AS (SELECT project_id, {P} AS path, id, content FROM repo_files WHERE path IS NOT NULL AND content IS NOT NULL), r AS (SELECT * FROM f WHERE starts_with(lower({_LAST.format(x="path")}), 'readme'))
SELECT project_id, arg_min(path, (path, id)) AS path, sha256(substr(arg_min(content, (path, id)), 1, 1200)) AS excerpt_hash FROM r GROUP BY 1
""",
    "file_summaries": f"""
WITH f AS (SELECT id, path, CASE WHEN json_valid(symbols_json) THEN from_json(symbols_json, '["VARCHAR"]') END AS s, CASE WHEN json_valid(imports_json) THEN from_json(imports_json, '["VARCHAR"]') END AS i FROM repo_files WHERE symbols_json IS NULL OR json_valid(symbols_json))
SELECT id, CASE WHEN len(s) > 0 THEN 'Defines ' || array_to_string(s[1:3], ', ') || '.' WHEN len(i) > 0 THEN 'Uses ' || array_to_string(i[1:3], ', ') || '.' ELSE 'A file of ' || {_LANG} || '.' END AS summary FROM f
""",
    "priced_usage": """
WITH g AS (SELECT project_id, sum(length(text)) AS i, sum(n_chars) AS o, count(*) FILTER (text IS NULL OR n_chars IS NULL) AS m FROM documents GROUP BY 1)
SELECT project_id, CASE WHEN m = 0 THEN round((i * 3.0::DOUBLE + o * 15.0::DOUBLE) / 1000000, 9) END AS cost, CASE WHEN m > 0 THEN 'unknown' WHEN i = 0 AND o = 0 THEN 'known_zero' ELSE 'calculated' END AS status FROM g
""",
    "dataset_shape": "SELECT category, count(*) AS items, count(*) FILTER (answerable) AS answerable, count(*) < 80 AS short FROM eval_questions GROUP BY 1",
    "learning_targets": f"WITH {TARGETS} SELECT * FROM tg",
    "target_states": f"WITH RECURSIVE {ORDERED} SELECT * FROM ot",
    "next_actions": f"""
WITH RECURSIVE {ORDERED} SELECT learner_id, CASE WHEN mastery = 'needs_review' THEN 'review' WHEN mastery IN ('practicing', 'introduced') THEN 'practise' WHEN mastery = 'demonstrated' THEN 'prove' WHEN mastery = 'mastered' THEN 'done' ELSE 'start' END AS action, project_id, target_id FROM ot WHERE place = 1
""",
    "last_events": f"WITH {UNIQUE} SELECT * FROM (SELECT learner_id, event_id, row_number() OVER (PARTITION BY learner_id ORDER BY created_at DESC, event_order DESC, event_id DESC) AS place FROM u) WHERE place <= 8",
    "target_checks": rf"""
WITH d AS (SELECT lower(concat_ws('/', owner, repo)) AS r, id, created_at FROM projects WHERE status IS DISTINCT FROM 'failed'), pp AS (SELECT id AS new_id, lag(id) OVER (PARTITION BY r ORDER BY created_at, id) AS old_id FROM d),
f AS (SELECT project_id, {P} AS path, content FROM repo_files WHERE content IS NOT NULL AND path IS NOT NULL),
o AS (SELECT DISTINCT new_id || chr(9) || {_LAST.format(x="path")} AS name, path, sha256(new_id || chr(9) || content) AS digest FROM f JOIN pp ON f.project_id = old_id),
n AS (SELECT DISTINCT new_id || chr(9) || {_LAST.format(x="path")} AS name, path, sha256(new_id || chr(9) || content) AS digest FROM f JOIN pp ON f.project_id = new_id WHERE old_id IS NOT NULL),
bd AS (SELECT digest, count(DISTINCT (path, name)) AS c, min((path, name)) AS t FROM n GROUP BY 1), bn AS (SELECT name, count(DISTINCT path) AS c, min(path) AS t FROM n GROUP BY 1),
s AS (SELECT o.name, o.path, bd.t AS dt, bn.t AS nt, CASE WHEN (o.name, o.path, o.digest) IN (SELECT (name, path, digest) FROM n) THEN 'unchanged_exact' WHEN bd.c = 1 THEN 'renamed_exact' WHEN bd.c > 1 THEN 'ambiguous'
  WHEN (o.name, o.path) IN (SELECT (name, path) FROM n) THEN 'modified' WHEN bn.c = 1 THEN 'moved' WHEN bn.c > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status FROM o LEFT JOIN bd USING (digest) LEFT JOIN bn ON bn.name = o.name),
t AS (SELECT *, CASE WHEN status = 'renamed_exact' THEN dt[1] || chr(9) || dt[2] WHEN status = 'moved' THEN nt || chr(9) || name END AS too FROM s)
SELECT name, path, CASE WHEN too IS NOT NULL AND count(*) OVER (PARTITION BY too) > 1 THEN 'ambiguous' ELSE status END AS status FROM t
""",
    "containment_matches": f"""
WITH {RANKED}, {GOLD} SELECT q AS hint_id, a.id, b.id AS gold_id FROM xrk JOIN code_chunks a ON a.id = k JOIN gd ON hint_id = q JOIN code_chunks b ON b.id = gd.id
WHERE a.project_id = b.project_id AND a.repository_revision = b.repository_revision AND a.path = b.path AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND a.id <> b.id
""",
}
_COLUMNS = ("mastery", "availability", "passes", "qualifying_passes", "review_reason", "last_event_id", "events")
_PART = _OF("event_type <> 'revision_revalidated'")
SQL["state_audit"] = f"""
WITH a AS (WITH RECURSIVE {STATES} SELECT * FROM st), b AS (WITH RECURSIVE {_PART} SELECT * FROM st)
SELECT coalesce(a.learner_id, b.learner_id, '') AS learner_id, coalesce(a.project_id, b.project_id, '') AS project_id, coalesce(a.target_id, b.target_id, '') AS target_id,
  CASE WHEN b.events IS NULL THEN 'missing' WHEN a.events IS NULL THEN 'orphan' WHEN b.mastery = 'mastered' AND b.availability <> 'current' THEN 'stale_mastered' {" ".join(f"WHEN a.{x} IS DISTINCT FROM b.{x} THEN '{x}'" for x in _COLUMNS)} END AS fault
FROM a FULL JOIN b ON {_SAME.format(a="a", b="b")} WHERE fault IS NOT NULL
"""
SQL["path_labels"] = f"""
WITH {RANKED}, {SYMBOL_SQL}, {GOLD}, {LEXICAL}, {SYMBOL}, hp AS (SELECT hint_id, ml.hit_at_8 > 0 AS A, ms.hit_at_8 > 0 AS B, ml.hit_at_5 > 0 AS C, ms.hit_at_5 > 0 AS D, greatest(ml.hit_at_3, ms.hit_at_3) > 0 AS E FROM ml JOIN ms USING (hint_id))
{" UNION ALL ".join(f"SELECT hint_id, '{name}' AS label FROM hp WHERE {rule}" for name, rule in ev.PATH_LABELS.items())}
"""
SQL |= {
    "snapshot_faults": """
WITH b AS (SELECT DISTINCT project_id FROM code_chunks WHERE (id, content_hash) NOT IN (SELECT (code_chunk_id, content_hash) FROM code_chunk_embeddings)), m AS (SELECT DISTINCT c.project_id FROM code_chunks c JOIN projects p ON p.id = c.project_id AND p.repository_revision IS DISTINCT FROM c.repository_revision)
SELECT id, CASE WHEN coalesce(status, '') <> 'ready' THEN 'snapshot_incomplete' WHEN id IN (SELECT * FROM m) THEN 'revision_mixed' WHEN id IN (SELECT * FROM b) THEN 'embeddings_incomplete' END AS fault FROM projects
""",
    "validated_policies": """
WITH r AS (SELECT item_id, item_id / 40 AS d, item_id % 7 = 0 AS nan, CASE WHEN item_id % 11 <> 0 THEN item_id / 30 END AS s, item_id % 60 AS p FROM eval_questions), f AS (SELECT *, p BETWEEN 1 AND 50 AND NOT nan AND d BETWEEN 0.05 AND 10 AND coalesce(s BETWEEN 0.05 AND 10, false) AS ok FROM r)
SELECT item_id, CASE WHEN ok THEN d ELSE 1.0 END AS dense_weight, 1.0::DOUBLE AS lexical_weight, CASE WHEN ok THEN s ELSE 1.0 END AS symbol_weight, CASE WHEN ok THEN p ELSE 24 END AS pool, NOT ok AS neutral FROM f
""",
    "fitted_events": f"""
WITH {UNIQUE}, w AS (SELECT event_id, learner_id, sum(strlen(validated_outcome_json)) OVER (PARTITION BY learner_id ORDER BY created_at DESC, event_order DESC, event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM u WHERE validated_outcome_json IS NOT NULL AND learner_id IS NOT NULL)
SELECT event_id, used, truncated FROM (SELECT *, max(used) OVER (PARTITION BY learner_id) > 512 AS truncated FROM w) WHERE used <= 512
""",
    "paired_by_repository": f"""
WITH {RANKED}, {SYMBOL_SQL}, {GOLD}, {LEXICAL}, {SYMBOL}, p AS (SELECT project_id, ml.mrr_at_8 AS x, ms.mrr_at_8 AS y FROM ml JOIN ms USING (hint_id) JOIN code_chunks c ON c.id = hint_id)
SELECT project_id, count(*) AS queries, count(*) FILTER (y > x) AS improved, count(*) FILTER (y = x) AS unchanged, count(*) FILTER (y < x) AS regressed, count(*) FILTER (y > 0 AND x = 0) AS gained, count(*) FILTER (x > 0 AND y = 0) AS lost,
  round(avg(x), 6) AS mean_first, round(avg(y), 6) AS mean_second, round(avg(y - x), 6) AS mean_difference FROM p GROUP BY 1
""",
    "scenario_metrics": f"""
WITH {RANKED}, {GOLD}, w AS (SELECT DISTINCT hint_id, path, symbol_name FROM gd JOIN code_chunks c ON c.id = gd.id), gt AS (SELECT q AS hint_id, k AS id, place, path, symbol_name FROM xrk JOIN code_chunks c ON c.id = k WHERE place <= 10),
fs AS (SELECT hint_id, path, min(place) AS place FROM gt GROUP BY 1, 2), rg AS (SELECT hint_id, count(*) AS r, min(place) AS first FROM fs WHERE (hint_id, path) IN (SELECT (hint_id, path) FROM w) GROUP BY 1),
rv AS (SELECT gt.hint_id, count(DISTINCT gt.id) AS rel FROM gt JOIN w ON w.hint_id = gt.hint_id AND (w.path = gt.path OR w.symbol_name = gt.symbol_name) GROUP BY 1),
n AS (SELECT hint_id, count(DISTINCT path) AS f, count(*) AS res FROM gt GROUP BY 1), z AS (SELECT hint_id, coalesce(f, 0) AS files, gold_files, coalesce(r, 0) / greatest(coalesce(f, 0), 1) AS p, coalesce(r, 0) / gold_files AS rc, first, coalesce(rel, 0) / greatest(coalesce(res, 0), 1) AS rel
  FROM (SELECT hint_id, count(DISTINCT path) AS gold_files FROM w GROUP BY 1) LEFT JOIN n USING (hint_id) LEFT JOIN rg USING (hint_id) LEFT JOIN rv USING (hint_id))
SELECT hint_id, files, gold_files, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1, coalesce(first <= 1, false) AS hit_at_1, coalesce(first <= 5, false) AS hit_at_5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr_at_10, round(rel, 6) AS relevant FROM z
""",
}
_MAPPED = r"""mp AS (SELECT DISTINCT learner_id, project_id, target_id, (['unchanged_exact', 'modified', 'ambiguous', 'unmapped', 'renamed_exact'])[coalesce(try_cast(regexp_extract(target_id, '(\d+)$', 1) AS INT) % 5, 3) + 1] AS status FROM learning_events)"""
SQL["published_states"] = f"""
WITH {_MAPPED}, b AS (WITH RECURSIVE {_PART} SELECT * FROM st)
SELECT learner_id, project_id, target_id, CASE WHEN status LIKE '%_exact' THEN mastery ELSE 'needs_review' END AS mastery, CASE WHEN status LIKE '%_exact' THEN '' ELSE 'revision_modified' END AS review_reason FROM b JOIN mp USING (learner_id, project_id, target_id) WHERE status LIKE '%_exact' OR status = 'modified'
"""
SQL["goal_lineage"] = f"""
WITH {_MAPPED}, g AS (SELECT DISTINCT learner_id, goal_id, project_id, target_id FROM learning_events WHERE goal_id IS NOT NULL)
SELECT learner_id, goal_id, count(*) AS targets, CASE WHEN bool_and(coalesce(status, '') LIKE '%_exact') THEN 'carried' WHEN bool_or(coalesce(status, '') LIKE '%_exact' OR status = 'modified') THEN 'needs_review' ELSE 'history_only' END AS lineage FROM g LEFT JOIN mp USING (learner_id, project_id, target_id) GROUP BY 1, 2
"""
_LX = f"""
lx AS (WITH t AS (SELECT learner_id, project_id, target_id, arg_min(event_id, (event_order, event_id)) AS f FROM learning_events WHERE event_type = 'attempt_evaluated' GROUP BY 1, 2, 3)
SELECT e.* REPLACE (CASE event_type WHEN 'attempt_evaluated' THEN '{{{{"verdict": "' || coalesce(CASE WHEN json_valid(validated_outcome_json) THEN json_extract_string(validated_outcome_json, '$.verdict') END, 'none') || '", "task_type": "' || CASE WHEN event_order % 2 = 0 THEN 'explain_symbol' ELSE 'recall' END || '"}}}}'
  WHEN 'revision_revalidated' THEN (['{{{{"availability": "current"}}}}', '{{{{"availability": "changed"}}}}', '{{{{}}}}'])[event_order % 3 + 1] WHEN 'continuity_state_derived' THEN (MAPPINGS)[event_order % 4 + 1]
  WHEN 'evaluation_corrected' THEN '{{{{"reverses_event_id": "' || coalesce(f, '') || '", "corrected_verdict": "' || (['pass', 'fail', 'partial'])[event_order % 3 + 1] || '", "task_type": "explain_symbol"}}}}' ELSE validated_outcome_json END AS validated_outcome_json)
FROM learning_events e LEFT JOIN t ON {_SAME.format(a="e", b="t")}),""".replace("{{", "{").replace("}}", "}").replace("MAPPINGS", "[" + ", ".join(f"'{m}'" for m in RULED_MAPPINGS) + "]")
SQL["learning_state_ruled"] = f"WITH RECURSIVE {_LX} {STATES.replace('FROM learning_events', 'FROM lx')} SELECT * FROM st"
SQL["task_checks"] = f"""
WITH RECURSIVE {_LX} {STATES.replace('FROM learning_events', 'FROM lx')}, tk AS (SELECT learner_id, project_id, target_id, task_id, bool_or(k = 'a' AND coalesce(verdict, '') = 'pass') AS passed FROM x WHERE task_id IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT tk.learner_id, tk.project_id, tk.target_id, task_id, CASE WHEN coalesce(availability, 'current') <> 'current' THEN 'stale' WHEN passed THEN 'passed' ELSE 'open' END AS status FROM tk LEFT JOIN st ON {_SAME.format(a="tk", b="st")}
"""
_KEYS = k.SECRET_KEYS
SQL["redacted_json"] = f"""
SELECT id, len(regexp_extract_all(content, '{_KEYS}')) AS redacted, sha256(regexp_replace(content, '{_KEYS}', '\\1"[redacted]"', 'g')) AS text_hash FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.json'
"""
