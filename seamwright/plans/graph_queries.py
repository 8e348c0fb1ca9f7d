"""Queries on the stored relation graph and on the hierarchy of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import hierarchy as h
from ..operators import structure
from ..session import checkpointed
from .indexing_queries import XRK
from .retrieval_queries import SQL as RETRIEVAL_SQL
from .retrieval_queries import bm25_topk, rrf_two_lists
from .structure_queries import PARENTS


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark, d):
    return _t(spark, d, "code_chunks")


def _seeds(spark, d):
    """Nodes of the chunks whose id is divisible by 50."""
    return g.relation_nodes(_chunks(spark, d)).where("chunk_id % 50 = 0")


def _snapshots(spark, d):
    return structure.latest_ready(_t(spark, d, "projects"))


def relation_nodes(spark, d):
    return g.relation_nodes(_chunks(spark, d))


def stored_edges(spark, d):
    edges = g.stored_edges(_chunks(spark, d))
    return g.bounded(edges, ["project_id", "repository_revision"], g.edge_order(), 2**31).select("edge_id", "source_id", "target_id", "relation", "status", "place")


def neighbour_edges(spark, d):
    return g.neighbour_edges(g.stored_edges(_chunks(spark, d)), _seeds(spark, d))


def outgoing_edges(spark, d):
    return g.neighbour_edges(g.stored_edges(_chunks(spark, d)), _seeds(spark, d), "outgoing", 2)


def edge_rejections(spark, d):
    return g.edge_rejections(g.stored_edges(_chunks(spark, d)), _seeds(spark, d), _snapshots(spark, d))


def node_resolutions(spark, d):
    return g.node_resolutions(g.relation_nodes(_chunks(spark, d)), _chunks(spark, d).where("chunk_type != 'class'"), _snapshots(spark, d))


def graph_identities(spark, d):
    return g.graph_identities(g.stored_edges(_chunks(spark, d)))


def graph_expand(spark, d):
    nodes = g.relation_nodes(_chunks(spark, d))
    return g.expand(g.stored_edges(_chunks(spark, d)), nodes.where("kind = 'file' OR chunk_id % 50 = 0"))


def chunk_ancestors(spark, d):
    return h.ancestors(structure.span_parents(_chunks(spark, d)))


def hierarchy_cycles(spark, d):
    return h.cycles(structure.span_parents(_chunks(spark, d)))


def hierarchy_relations(spark, d):
    """Every chunk against itself, the two before it in its file, and the chunk of the id before it."""
    chunks = _chunks(spark, d)
    parents = structure.span_parents(chunks)
    one = structure.span_sequence(chunks).where("before IS NOT NULL").select(F.col("before").alias("left"), F.col("id").alias("right"))
    two = one.select("left", F.col("right").alias("mid")).join(one.select(F.col("left").alias("mid"), "right"), "mid").select("left", "right")
    self = chunks.select(F.col("id").alias("left"), F.col("id").alias("right"))
    other = chunks.select(F.col("id").alias("left")).join(chunks.select((F.col("id") - 1).alias("left"), F.col("id").alias("right")), "left")
    back = one.select(F.col("right").alias("left"), F.col("left").alias("right"))
    return h.relations(one.unionByName(two).unionByName(self).unionByName(other).unionByName(back).distinct(), chunks, parents, h.ancestors(parents))


def exact_spans(spark, d):
    return h.exact_spans(_chunks(spark, d))


def group_ids(spark, d):
    parents = structure.span_parents(_chunks(spark, d))
    return h.group_ids(_chunks(spark, d), structure.family_roots(parents), parents)


def hierarchy_expand(spark, d):
    return h.expand(bm25_topk(spark, d), h.ancestors(structure.span_parents(_chunks(spark, d))), "item_id")


def hierarchy_normalised(spark, d):
    chunks = _chunks(spark, d)
    parents = structure.span_parents(chunks)
    found = h.expand(bm25_topk(spark, d), h.ancestors(parents), "item_id")
    return h.normalised(found, structure.family_roots(parents), parents, h.exact_spans(chunks), "item_id")


def fused_search(spark, d):
    """The search in stages: word and symbol lists fused, widened in the hierarchy, normalised."""
    chunks = _chunks(spark, d)
    parents = structure.span_parents(chunks)
    fused = checkpointed(rrf_two_lists(spark, d).select("hint_id", "id", "place"))
    above = h.ancestors(parents)
    kept = h.normalised(h.expand(fused, above, "hint_id"), structure.family_roots(parents), parents, h.exact_spans(chunks), "hint_id")
    return kept.select("hint_id", "id", "place")


def hierarchy_scope(spark, d):
    chunks = _chunks(spark, d)
    return h.in_scope(chunks, chunks.where("id % 50 = 0"), 6)


def chain_checks(spark, d):
    """The chains of all walks, one in eight with another's seed; nodes of classes count as stale."""
    chunks = _chunks(spark, d)
    nodes, edges = g.relation_nodes(chunks), g.stored_edges(chunks)
    made = g.path_chains(g.expand(edges, nodes.where("kind = 'file' OR chunk_id % 50 = 0")), edges).withColumn("key", F.col("chain_id"))
    odd = F.substring("chain_id", 3, 1).isin("0", "8")
    stored = made.withColumn("seed", F.when(odd, F.concat("seed", F.lit("x"))).otherwise(F.col("seed")))
    return g.chain_checks(stored, nodes, edges, nodes.join(chunks.where("chunk_type != 'class'").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"))


def _walks(spark, d):
    nodes = g.relation_nodes(_chunks(spark, d))
    return g.expand(g.stored_edges(_chunks(spark, d)), nodes.where("kind = 'file' OR chunk_id % 50 = 0")), nodes


def reached_chunks(spark, d):
    return g.reached_chunks(*_walks(spark, d))


def walk_diagnostics(spark, d):
    return g.walk_diagnostics(*_walks(spark, d))


def relation_aware(spark, d):
    """Questions' results with the chunks that the walk of their definitions reaches."""
    ranked = bm25_topk(spark, d)
    near = h.ancestors(structure.span_parents(_chunks(spark, d)), 1).select(F.col("id").alias("seed"), F.col("ancestor").alias("id"), F.lit("defined_by").alias("family"))
    near = near.unionByName(near.select(F.col("id").alias("seed"), F.col("seed").alias("id"), F.lit("defines").alias("family")))
    related = ranked.select("item_id", F.col("id").alias("seed"), "place").join(near, "seed").select("item_id", "id", "seed", "family", (F.lit(0.7) / (1 + F.col("place"))).alias("priority"))
    return g.relation_aware(ranked, related, "item_id")


QUERIES = {
    f.__name__: f
    for f in (
        relation_nodes, stored_edges, neighbour_edges, outgoing_edges, edge_rejections, node_resolutions, graph_identities, graph_expand, chunk_ancestors, hierarchy_cycles,
        hierarchy_relations, exact_spans, group_ids, hierarchy_expand, hierarchy_normalised, fused_search, hierarchy_scope, chain_checks, relation_aware, reached_chunks, walk_diagnostics,
    )
}

_FID = "'n:' || sha256(to_json(['file', project_id, repository_revision, path])::VARCHAR)"
_CID = "'n:' || sha256(to_json(['chunk', project_id, repository_revision, path, qualified_name, start_line::VARCHAR, end_line::VARCHAR, id::VARCHAR])::VARCHAR)"
NODES = f"""
nd AS (SELECT DISTINCT {_FID} AS node_id, 'file' AS kind, project_id, repository_revision, path, '' AS qualified_name, NULL::BIGINT AS chunk_id FROM code_chunks
  UNION ALL SELECT {_CID}, 'chunk', project_id, repository_revision, path, qualified_name, id FROM code_chunks)"""
EDGES = f"""
eg AS (WITH r AS (SELECT project_id, repository_revision, path, coalesce(parent_symbol, '') AS up, {_CID} AS target_id, {_FID} AS file_id, start_line AS line, qualified_name AS raw_target FROM code_chunks),
  n AS (SELECT project_id, repository_revision, path, qualified_name AS up, min({_CID}) AS one FROM code_chunks GROUP BY ALL HAVING count(*) = 1),
  s AS (SELECT r.*, CASE WHEN one <> target_id THEN one ELSE file_id END AS source_id FROM r LEFT JOIN n USING (project_id, repository_revision, path, up))
  SELECT 'e:' || sha256(to_json([source_id, 'defines', target_id, line::VARCHAR])::VARCHAR) AS edge_id, source_id, target_id, 'defines' AS relation, 'resolved' AS status, project_id, repository_revision, path, line, raw_target FROM s)"""
ORDER = "path, line, relation, raw_target, coalesce(target_id, ''), edge_id"
TOUCH = "tc AS (SELECT *, source_id AS cur, target_id AS nb FROM eg UNION ALL SELECT *, target_id, source_id FROM eg)"
READY = """
lr AS (WITH f AS (SELECT lower(concat_ws('/', owner, repo)) AS r, repository_revision, min((created_at, id)) AS a FROM projects WHERE status = 'ready' GROUP BY 1, 2)
  SELECT arg_max(a, (a, repository_revision))[2] AS project_id, arg_max(repository_revision, (a, repository_revision)) AS repository_revision FROM f GROUP BY r)"""
ABOVE = f"""{PARENTS},
ab AS (SELECT id, parent_id AS ancestor, 1::BIGINT AS depth FROM pm WHERE parent_id IS NOT NULL UNION ALL SELECT ab.id, pm.parent_id, depth + 1 FROM ab JOIN pm ON pm.id = ab.ancestor WHERE pm.parent_id IS NOT NULL AND depth < 16)"""
ROOTS = "up AS (SELECT id, id AS root, 0 AS lv FROM pm UNION ALL SELECT up.id, pm.parent_id, lv + 1 FROM up JOIN pm ON pm.id = up.root WHERE pm.parent_id IS NOT NULL), rt AS (SELECT id, arg_max(root, lv) AS root FROM up GROUP BY 1)"
SPANS = """
sp AS (SELECT id, count(*) OVER w AS n, min(concat_ws(chr(0), content_hash, chunk_type, qualified_name)) OVER w = max(concat_ws(chr(0), content_hash, chunk_type, qualified_name)) OVER w AS compatible, min(id) OVER w AS one
  FROM code_chunks WINDOW w AS (PARTITION BY project_id, repository_revision, path, start_line, end_line)),
es AS (SELECT id, CASE WHEN compatible THEN one ELSE id END AS representative, compatible FROM sp WHERE n > 1)"""
EXPAND = """
st AS (SELECT q, k AS anchor, place FROM xrk WHERE place <= 24), nr2 AS (SELECT id AS anchor, ancestor AS id, depth, CASE WHEN depth = 1 THEN 0 ELSE 2 END AS rnk FROM ab WHERE depth <= 2 UNION ALL SELECT ancestor, id, depth, CASE WHEN depth = 1 THEN 1 ELSE 3 END FROM ab WHERE depth <= 2),
ht AS (SELECT q, anchor, place, id, depth, rnk FROM (SELECT *, row_number() OVER (PARTITION BY q, anchor ORDER BY depth, rnk, id) AS n FROM st JOIN nr2 USING (anchor)) WHERE n <= 8 AND (q, id) NOT IN (SELECT (q, anchor) FROM st)),
bs AS (SELECT q, id, min((place, depth, rnk, anchor)) AS b FROM ht GROUP BY 1, 2), bk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY b[1], b[2], b[3], id) AS k FROM bs),
xp AS (SELECT q AS item_id, id, kind, depth, anchor, row_number() OVER (PARTITION BY q ORDER BY o1, o2) AS place FROM (SELECT q, anchor AS id, 'direct' AS kind, 0::BIGINT AS depth, anchor, 0 AS o1, place AS o2 FROM st
  UNION ALL SELECT q, id, list_extract(['parent', 'child', 'ancestor', 'descendant'], b[3] + 1), b[2], b[4], 1, k FROM bk WHERE k <= 24))"""

_WALK_END = "SELECT * FROM (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY depth, e) AS place"

SQL = {
    "relation_nodes": f"WITH {NODES} SELECT * FROM nd",
    "stored_edges": f"WITH {EDGES} SELECT edge_id, source_id, target_id, relation, status, row_number() OVER (PARTITION BY project_id, repository_revision ORDER BY {ORDER}) AS place FROM eg",
    "neighbour_edges": f"""
WITH {NODES}, {EDGES}, {TOUCH}, r AS (SELECT cur AS seed, edge_id, nb AS neighbour, row_number() OVER (PARTITION BY cur ORDER BY {ORDER}) AS place, count(*) OVER (PARTITION BY cur) > 96 AS truncated FROM tc WHERE cur IN (SELECT node_id FROM nd WHERE chunk_id % 50 = 0))
SELECT * FROM r WHERE place <= 96
""",
    "outgoing_edges": f"""
WITH {NODES}, {EDGES}, r AS (SELECT source_id AS seed, edge_id, target_id AS neighbour, row_number() OVER (PARTITION BY source_id ORDER BY {ORDER}) AS place, count(*) OVER (PARTITION BY source_id) > 2 AS truncated FROM eg WHERE source_id IN (SELECT node_id FROM nd WHERE chunk_id % 50 = 0))
SELECT * FROM r WHERE place <= 2
""",
    "edge_rejections": f"""
WITH {NODES}, {EDGES}, {READY}, sd AS (SELECT node_id FROM nd WHERE chunk_id % 50 = 0)
SELECT edge_id, CASE WHEN (project_id, repository_revision) NOT IN (SELECT (project_id, repository_revision) FROM lr) THEN 'scope_conflict' WHEN source_id NOT IN (SELECT node_id FROM sd) AND target_id NOT IN (SELECT node_id FROM sd) THEN 'touches_no_seed' END AS reason FROM eg
""",
    "node_resolutions": f"""
WITH {NODES}, {READY}, c AS (SELECT project_id, repository_revision, id AS chunk_id, count(*) AS n FROM code_chunks WHERE chunk_type <> 'class' GROUP BY ALL)
SELECT node_id, CASE WHEN (nd.project_id, nd.repository_revision) NOT IN (SELECT (project_id, repository_revision) FROM lr) THEN 'scope_conflict' WHEN chunk_id IS NULL THEN 'unsupported' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS resolution
FROM nd LEFT JOIN c USING (project_id, repository_revision, chunk_id)
""",
    "graph_identities": f"""
WITH {EDGES}, l AS (SELECT project_id, substr(edge_id, 3, 2) AS lane, count(*) AS n, sha256(string_agg(concat_ws(chr(9), edge_id, relation, status), chr(10) ORDER BY edge_id)) AS h FROM eg GROUP BY 1, 2)
SELECT project_id, sum(n)::BIGINT AS edges, sha256(string_agg(h, '' ORDER BY lane)) AS identity FROM l GROUP BY 1
""",
    "graph_expand": f"""
WITH {NODES}, {EDGES}, {TOUCH}, sd AS (SELECT DISTINCT node_id AS seed FROM nd WHERE kind = 'file' OR chunk_id % 50 = 0),
lk AS (SELECT cur, nb, edge_id, status, (path, line, relation, raw_target, coalesce(target_id, ''), edge_id) AS o FROM tc),
f1 AS (SELECT seed, nb, edge_id, o, row_number() OVER (PARTITION BY seed ORDER BY o) AS e FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY o) AS n FROM sd JOIN lk ON cur = seed) WHERE n <= 20),
mt AS (SELECT seed, nb, arg_min(edge_id, e) AS edge_1, min(e) AS e FROM f1 WHERE nb <> seed GROUP BY 1, 2), mk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY e) AS k FROM mt),
ct AS (SELECT seed, count(*) AS had FROM f1 GROUP BY 1), cn AS (SELECT seed, count(*) AS hn FROM mk GROUP BY 1),
s1 AS (SELECT mk.seed, mk.nb AS via, mk.edge_1, lk.nb, lk.edge_id, lk.o, row_number() OVER (PARTITION BY mk.seed, mk.nb ORDER BY lk.o) AS n FROM mk JOIN lk ON lk.cur = mk.nb),
s2 AS (SELECT *, row_number() OVER (PARTITION BY seed, edge_id ORDER BY via, o) AS n2 FROM s1 WHERE n <= 20 AND (seed, edge_id) NOT IN (SELECT (seed, edge_id) FROM f1)),
s3 AS (SELECT s2.*, row_number() OVER (PARTITION BY s2.seed ORDER BY via, o) AS e, had, hn FROM s2 JOIN ct ON ct.seed = s2.seed JOIN cn ON cn.seed = s2.seed WHERE n2 = 1), s4 AS (SELECT * FROM s3 WHERE e + had <= 128),
kn AS (SELECT seed, nb FROM mk UNION SELECT seed, seed FROM sd), fr AS (SELECT seed, nb, hn, min(e) AS e FROM s4 WHERE (seed, nb) NOT IN (SELECT (seed, nb) FROM kn) GROUP BY 1, 2, 3),
al AS (SELECT seed, nb FROM kn UNION SELECT seed, nb FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY e) AS k FROM fr) WHERE k + hn < 64),
pt AS (SELECT f1.seed, 1 AS depth, f1.e, f1.edge_id AS edge_1, NULL::VARCHAR AS edge_2, f1.nb AS node FROM f1 JOIN mk USING (seed, nb)
  UNION ALL SELECT seed, 2, e, edge_1, edge_id, nb FROM s4 WHERE nb <> seed AND nb <> via AND (seed, nb) IN (SELECT (seed, nb) FROM al))
SELECT * FROM (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY depth, e) AS place, depth, edge_1, edge_2, node, 'resolved' AS status FROM pt) WHERE place <= 24
""",
    "chunk_ancestors": f"WITH RECURSIVE {ABOVE} SELECT * FROM ab",
    "hierarchy_cycles": f"WITH RECURSIVE {ABOVE} SELECT DISTINCT id FROM ab WHERE id = ancestor",
    "hierarchy_relations": f"""
WITH RECURSIVE {ABOVE}, sq AS (SELECT id, lag(id) OVER (PARTITION BY project_id, repository_revision, path ORDER BY start_line, end_line DESC, lower(qualified_name), id) AS b FROM code_chunks),
o AS (SELECT b AS l, id AS r FROM sq WHERE b IS NOT NULL),
pr AS (SELECT l, r FROM o UNION SELECT a.l, b.r FROM o a JOIN o b ON a.r = b.l UNION SELECT id, id FROM code_chunks UNION SELECT a.id, b.id FROM code_chunks a JOIN code_chunks b ON b.id = a.id + 1 UNION SELECT r, l FROM o),
cf AS (SELECT k.*, parent_id, ambiguous FROM code_chunks k LEFT JOIN pm USING (id)),
rl AS (SELECT pr.l AS "left", pr.r AS "right", d.depth AS dn, u.depth AS ud, CASE
  WHEN (a.project_id, a.repository_revision, a.path) IS DISTINCT FROM (b.project_id, b.repository_revision, b.path) THEN 'cross_scope' WHEN pr.l = pr.r THEN 'same_identity' WHEN a.ambiguous OR b.ambiguous THEN 'ambiguous'
  WHEN a.start_line = b.start_line AND a.end_line = b.end_line THEN CASE WHEN (a.content_hash, a.chunk_type, a.qualified_name) = (b.content_hash, b.chunk_type, b.qualified_name) THEN 'exact_span_duplicate' ELSE 'exact_span_conflict' END
  WHEN d.depth = 1 THEN 'parent' WHEN d.depth IS NOT NULL THEN 'ancestor' WHEN u.depth = 1 THEN 'child' WHEN u.depth IS NOT NULL THEN 'descendant' WHEN a.parent_id = b.parent_id THEN 'sibling'
  WHEN a.start_line <= b.start_line AND a.end_line >= b.end_line OR b.start_line <= a.start_line AND b.end_line >= a.end_line THEN 'strict_containment'
  WHEN greatest(a.start_line, b.start_line) <= least(a.end_line, b.end_line) THEN 'partial_overlap' ELSE 'disjoint' END AS relation
  FROM pr JOIN cf a ON a.id = pr.l JOIN cf b ON b.id = pr.r LEFT JOIN ab d ON d.id = pr.r AND d.ancestor = pr.l LEFT JOIN ab u ON u.id = pr.l AND u.ancestor = pr.r)
SELECT "left", "right", relation, CASE WHEN relation IN ('parent', 'ancestor') THEN dn WHEN relation IN ('child', 'descendant') THEN ud WHEN relation = 'sibling' THEN 1 ELSE 0 END AS depth FROM rl
""",
    "exact_spans": f"WITH {SPANS} SELECT * FROM es",
    "group_ids": f"""
WITH RECURSIVE {PARENTS}, {ROOTS}
SELECT k.id, CASE WHEN ambiguous THEN 'X' || sha256(concat_ws(chr(0), project_id, repository_revision, path, k.id::VARCHAR)) ELSE 'H' || sha256(concat_ws(chr(0), project_id, repository_revision, path, root::VARCHAR)) END AS group_id
FROM code_chunks k JOIN rt ON rt.id = k.id JOIN (SELECT id, ambiguous FROM pm) m ON m.id = k.id
""",
    "hierarchy_expand": f"WITH RECURSIVE {XRK}, {ABOVE}, {EXPAND} SELECT * FROM xp",
    "hierarchy_normalised": f"""
WITH RECURSIVE {XRK}, {ABOVE}, {ROOTS}, {SPANS}, {EXPAND},
j AS (SELECT item_id, xp.id, kind, place, root AS grp, coalesce(m.ambiguous, false) AND kind = 'direct' AS fre, row_number() OVER (PARTITION BY item_id, coalesce(representative, xp.id) ORDER BY place) AS n
  FROM xp LEFT JOIN rt ON rt.id = xp.id LEFT JOIN (SELECT id, ambiguous FROM pm) m ON m.id = xp.id LEFT JOIN es ON es.id = xp.id),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id, grp, fre ORDER BY place) AS seat FROM j WHERE n = 1)
SELECT item_id, id, grp AS "group", final AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS final FROM s WHERE fre OR seat <= 2) WHERE final <= 8
""",
    "hierarchy_scope": """
WITH s AS (SELECT DISTINCT project_id, repository_revision, path FROM code_chunks WHERE id % 50 = 0),
r AS (SELECT id, row_number() OVER w AS place, count(*) OVER (PARTITION BY project_id, repository_revision, path) > 6 AS truncated FROM code_chunks JOIN s USING (project_id, repository_revision, path)
  WINDOW w AS (PARTITION BY project_id, repository_revision, path ORDER BY start_line, end_line DESC, qualified_name, chunk_type, id))
SELECT * FROM r WHERE place <= 6
""",
}
SQL["chain_checks"] = SQL["graph_expand"].replace(_WALK_END, f", wk AS ({_WALK_END}").rstrip() + """),
cg AS (SELECT w.seed, w.depth, e1.source_id AS s1, CASE WHEN e1.source_id = w.seed THEN e1.target_id ELSE e1.source_id END AS mid, w.edge_1, w.edge_2, w.node FROM wk w JOIN eg e1 ON e1.edge_id = w.edge_1),
ci AS (SELECT *, 'c:' || sha256(to_json([seed, concat_ws(',', seed, CASE WHEN depth = 2 THEN mid END, node), concat_ws(',', edge_1, edge_2)])::VARCHAR) AS key FROM cg),
cl AS (SELECT node_id FROM nd JOIN code_chunks k ON k.id = chunk_id WHERE chunk_type = 'class')
SELECT key, CASE WHEN substr(key, 3, 1) IN ('0', '8') THEN 'chain identity is invalid' WHEN seed IN (SELECT * FROM cl) OR node IN (SELECT * FROM cl) OR depth = 2 AND mid IN (SELECT * FROM cl) THEN 'relation node content is stale' END AS reason FROM ci
"""
_WALKS = SQL["graph_expand"].replace(_WALK_END, f", wk AS ({_WALK_END}").rstrip() + ")"
SQL["reached_chunks"] = f"{_WALKS} SELECT DISTINCT seed, chunk_id FROM wk JOIN nd ON node_id = node WHERE chunk_id IS NOT NULL"
SQL["walk_diagnostics"] = f"""{_WALKS}, ws AS (SELECT wk.*, project_id, kind FROM wk JOIN nd ON node_id = seed)
SELECT CASE WHEN grouping(project_id) = 0 THEN 'project' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'all' END AS level, project_id, kind, count(DISTINCT seed) AS seeds, count(*) AS paths, count(*) FILTER (depth = 2) AS second, round(count(*) / count(DISTINCT seed), 6) AS mean_paths
FROM ws GROUP BY GROUPING SETS ((project_id), (kind), ())"""
SQL["fused_search"] = SQL["hierarchy_normalised"].replace(XRK, f"xrk AS (SELECT hint_id AS q, id AS k, place FROM ({RETRIEVAL_SQL['rrf_two_lists']}))").replace('SELECT item_id, id, grp AS "group", final AS place', "SELECT item_id AS hint_id, id, final AS place")
