"""Relation graph, hierarchy, citations, targets and sinks on cases the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from seamwright.operators import citations, evaluation, graph, hierarchy, learning, lookups
from seamwright.sources import writers

EDGE = "edge_id string, source_id string, target_id string, relation string, status string, project_id string, repository_revision string, path string, line int, raw_target string"


def edges(spark, rows):
    return spark.createDataFrame([(f"e{i}", s, t, rel, st, "p", "r", "f", i, str(t)) for i, (s, t, rel, st) in enumerate(rows)], EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_walks_end_in_cycles_and_open_edges(spark):
    e = edges(spark, [("a", "b", "calls", "resolved"), ("b", "c", "calls", "ambiguous"), ("c", "a", "calls", "resolved"), ("a", None, "imports", "external"), ("b", "a", "calls", "resolved")])
    got = {(r["depth"], r["edge_1"], r["edge_2"], r["node"], r["status"]) for r in graph.expand(e, seeds(spark, "a"), "outgoing").collect()}
    assert got == {(1, "e0", None, "b", "resolved"), (1, "e3", None, None, "external"), (2, "e0", "e1", "c", "ambiguous")}
    back = {(r["depth"], r["node"]) for r in graph.expand(e, seeds(spark, "a"), "incoming").collect()}
    assert back == {(1, "c"), (1, "b"), (2, "b")}
    with pytest.raises(ValueError):
        graph.expand(e, seeds(spark, "a"), "up")


def test_walks_keep_their_budgets(spark):
    e = edges(spark, [("a", f"b{i:02d}", "calls", "resolved") for i in range(30)] + [(f"b{i:02d}", f"c{i:02d}{j}", "calls", "resolved") for i in range(30) for j in range(9)])
    rows = graph.expand(e, seeds(spark, "a"), "outgoing").collect()
    assert len(rows) == 24 and sum(r["depth"] == 1 for r in rows) == 20 and {r["node"] for r in rows if r["depth"] == 2} == {f"c00{j}" for j in range(4)}
    wide = graph.expand(e, seeds(spark, "a"), "outgoing", most_paths=1000).collect()
    assert len({r["node"] for r in wide}) == 63 and sum(r["depth"] == 2 for r in wide) == 43
    few = graph.expand(e, seeds(spark, "a"), "outgoing", most_edges=25, most_paths=1000).collect()
    assert len(few) == 25
    near = graph.neighbour_edges(e, seeds(spark, "a"), "outgoing", 12).collect()
    assert [r["edge_id"] for r in sorted(near, key=lambda r: r["place"])] == [f"e{i}" for i in range(12)] and all(r["truncated"] for r in near)


def test_edge_rejections(spark):
    ids = graph.json_id("e:", F.col("source_id"), F.col("relation"), F.col("target_id"), F.col("line"))
    e = edges(spark, [("a", "b", "calls", "resolved"), ("a", "b", "owns", "resolved"), ("a", "b", "calls", "ambiguous"), ("a", None, "calls", "resolved"), ("x", "y", "calls", "resolved"), ("a", "b", "calls", "resolved")])
    e = e.withColumn("name", F.col("edge_id")).withColumn("edge_id", F.when(F.col("name") != "e5", ids).otherwise(F.col("edge_id")))
    other = e.limit(1).withColumn("project_id", F.lit("q")).withColumn("edge_id", F.lit("other"))
    got = {r["edge_id"]: r["reason"] for r in graph.edge_rejections(e.unionByName(other), seeds(spark, "a"), spark.createDataFrame([("p", "r")], "project_id string, repository_revision string")).collect()}
    names = {r["name"]: got[r["edge_id"]] for r in e.collect()}
    assert names == {"e0": None, "e1": "relation_not_asked", "e2": "status_ambiguous", "e3": "no_target", "e4": "touches_no_seed", "e5": "edge_id_mismatch"} and got["other"] == "scope_conflict"


def test_node_resolutions(spark):
    nodes = spark.createDataFrame([("n1", "p", "r", "f", "q", 1), ("n2", "p", "r", "f", "", None), ("n3", "p", "r", "f", "q", 9), ("n4", "p", "r", "g", "q", 1), ("n5", "o", "r", "f", "q", 1), ("n6", "p", "r", "f", "z", 2)], "node_id string, project_id string, repository_revision string, path string, qualified_name string, chunk_id long")
    chunks = spark.createDataFrame([(1, "p", "r", "f", "q"), (2, "p", "r", "f", "z"), (2, "p", "r", "f", "z")], "id long, project_id string, repository_revision string, path string, qualified_name string")
    got = {r["node_id"]: r["resolution"] for r in graph.node_resolutions(nodes, chunks, spark.createDataFrame([("p", "r")], "project_id string, repository_revision string")).collect()}
    assert got == {"n1": "unique", "n2": "unsupported", "n3": "not_found", "n4": "stale", "n5": "scope_conflict", "n6": "ambiguous"}


def test_relation_aware_places(spark):
    ranked = spark.createDataFrame([(1, i, i + 1) for i in range(8)], "q long, id long, place long")
    related = spark.createDataFrame([(1, 100, 0, "f", 0.9), (1, 101, 0, "g", 0.8), (1, 102, 3, "f", 0.7), (1, 103, 4, "f", 0.6), (1, 2, 1, "g", 0.95), (1, 104, 77, "g", 0.99)], "q long, id long, seed long, family string, priority double")
    ids = lambda k, rel=related: [r["id"] for r in sorted(graph.relation_aware(ranked, rel, "q", k).collect(), key=lambda r: r["place"])]
    assert ids(8) == [0, 100, 1, 2, 3, 102, 4, 5] and ids(2) == [0, 1] and ids(4, related.limit(0)) == [0, 1, 2, 3]


def test_chain_checks(spark):
    e = edges(spark, [("a", "b", "calls", "resolved"), ("b", "c", "calls", "unresolved")])
    e = e.withColumn("edge_id", graph.json_id("e:", F.col("source_id"), F.col("relation"), F.col("target_id"), F.col("line")))
    one, two = (r["edge_id"] for r in e.orderBy("line").collect())
    rows = [("ok", "a", ["a", "b"], [one], ["outgoing"]), ("way", "a", ["a", "b"], [one], ["incoming"]), ("shape", "a", ["a"], [one], ["outgoing"]), ("open", "b", ["b", "c"], [two], ["outgoing"]),
            ("node", "a", ["a", "z"], [one], ["outgoing"]), ("edge", "a", ["a", "b"], ["e:x"], ["outgoing"]), ("stale", "d", ["d"], [], []), ("id", "a", ["a", "b"], [one], ["outgoing"])]
    paths = spark.createDataFrame(rows, "key string, seed string, nodes array<string>, edges array<string>, directions array<string>")
    stored = graph.chains(paths).join(paths, ["seed", "nodes", "edges", "directions"]).where("key != 'id'").unionByName(paths.where("key = 'id'").withColumn("chain_id", F.lit("c:0")))
    stored = stored.dropDuplicates(["key"])
    nodes = spark.createDataFrame([("a", "chunk"), ("b", "file"), ("c", "file"), ("d", "chunk")], "node_id string, kind string")
    got = {r["key"]: r["reason"] for r in graph.chain_checks(stored, nodes, e, seeds(spark, "a")).collect()}
    assert got["ok"] is None and got["way"] == "relation direction is invalid" and got["shape"] == "invalid chain shape" and got["open"] == "chain contains a non-traversable edge"
    assert got["node"] == "relation node no longer exists" and got["edge"] == "relation edge no longer exists" and got["stale"] == "relation node content is stale" and got["id"] == "chain identity is invalid"


CHUNK = "id long, project_id string, repository_revision string, path string, chunk_type string, symbol_name string, qualified_name string, parent_symbol string, start_line int, end_line int, content_hash string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, "p", "r", path, "function", n, n, up, s, e, h) for i, path, n, up, s, e, h in rows], CHUNK)


def test_hierarchy_outcomes(spark):
    from seamwright.operators.structure import span_parents

    c = chunks(spark, [(1, "f", "A", "", 1, 50, "h"), (2, "f", "A.b", "A", 2, 20, "h2"), (3, "f", "A.b.c", "A.b", 3, 9, "h3"), (4, "f", "A.d", "A", 21, 30, "h4"), (5, "f", "x", "", 60, 70, "h5"), (6, "f", "x", "", 60, 70, "h5"), (7, "f", "y", "", 60, 70, "h7"),
                       (8, "f", "z", "nobody", 80, 90, "h8"), (9, "f", "u", "", 95, 105, "h9"), (10, "f", "v", "", 100, 110, "h10"), (11, "g", "w", "", 1, 2, "h11")])
    parents = span_parents(c)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 1), (2, 4), (5, 6), (5, 7), (8, 9), (9, 10), (5, 9), (1, 11), (1, 1)], "left long, right long")
    got = {(r["left"], r["right"]): (r["relation"], r["depth"]) for r in hierarchy.relations(pairs, c, parents, hierarchy.ancestors(parents)).collect()}
    assert got == {
        (1, 2): ("parent", 1), (1, 3): ("ancestor", 2), (2, 1): ("child", 1), (3, 1): ("descendant", 2), (2, 4): ("sibling", 1), (5, 6): ("exact_span_duplicate", 0), (5, 7): ("exact_span_conflict", 0), (8, 9): ("ambiguous", 0),
        (9, 10): ("partial_overlap", 0), (5, 9): ("disjoint", 0), (1, 11): ("cross_scope", 0), (1, 1): ("same_identity", 0),
    }
    spans = {r["id"]: (r["representative"], r["compatible"]) for r in hierarchy.exact_spans(c).collect()}
    assert spans == {5: (5, False), 6: (6, False), 7: (7, False)}
    same = {r["id"]: r["representative"] for r in hierarchy.exact_spans(c.where("id IN (5, 6)")).collect()}
    assert same == {5: 5, 6: 5}
    loop = spark.createDataFrame([(1, 2, False), (2, 3, False), (3, 1, False), (4, 1, False)], "id long, parent_id long, ambiguous boolean")
    assert sorted(r["id"] for r in hierarchy.cycles(loop).collect()) == [1, 2, 3]


def test_normalised_candidates(spark):
    rows = [(1, 10, "direct", 1), (1, 11, "direct", 2), (1, 12, "parent", 3), (1, 13, "direct", 4), (1, 14, "direct", 5), (1, 15, "child", 6)]
    cand = spark.createDataFrame(rows, "q long, id long, kind string, place long")
    roots = spark.createDataFrame([(i, 10) for i in (10, 11, 12, 13)] + [(14, 14), (15, 14)], "id long, root long")
    parents = spark.createDataFrame([(13, None, True)], "id long, parent_id long, ambiguous boolean")
    spans = spark.createDataFrame([(14, 14, True), (15, 14, True)], "id long, representative long, compatible boolean")
    got = sorted((r["place"], r["id"]) for r in hierarchy.normalised(cand, roots, parents, spans, "q").collect())
    assert got == [(1, 10), (2, 11), (3, 13), (4, 14)]


def test_spans_of_a_crowded_file(spark):
    """Sweeps hold the open spans only; equal smallest ones are ambiguous, partial overlaps are no parents."""
    from seamwright.operators.structure import innermost_spans, span_parents

    c = chunks(spark, [(1, "f", "a", "", 1, 100, "h"), (2, "f", "b", "", 5, 30, "h"), (3, "f", "c", "", 10, 40, "h"), (4, "f", "d", "", 12, 20, "h"), (5, "f", "e", "", 50, 60, "h"), (6, "f", "e", "", 50, 60, "h"), (7, "f", "g", "e", 52, 53, "h"), (8, "f", "k", "", 100, 100, "h")])
    got = {r["id"]: (r["parent_id"], r["ambiguous"]) for r in span_parents(c).collect()}
    assert got == {1: (None, False), 2: (1, False), 3: (1, False), 4: (2, False), 5: (1, False), 6: (1, False), 7: (None, True), 8: (1, False)}
    points = spark.createDataFrame([(1, "p", "f", 15), (2, "p", "f", 35), (3, "p", "f", 52), (4, "p", "f", 300), (5, "p", "x", 1)], "point_id long, project_id string, path string, line int")
    assert {r["point_id"]: r["id"] for r in innermost_spans(points, c).collect()} == {1: 4, 2: 3, 3: 7}


def test_citation_rules_of_stored_rows(spark):
    """Rules that a cited row cannot break by itself: a file that changed, a chunk whose own digest is old."""
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = spark.createDataFrame([(1, "p", "a.py", "x\ny\n"), (2, "p", "b.py", "1\n2")], "id long, project_id string, path string, content string")
    projects = spark.createDataFrame([("p", "o", "r", "u", "v")], "id string, owner string, repo string, repo_url string, repository_revision string")
    c = "id long, project_id string, repository_revision string, path string, language string, chunk_type string, symbol_name string, qualified_name string, start_line int, end_line int, content string, content_hash string"
    stored = spark.createDataFrame([(1, "p", "v", "a.py", "python", "function", "f", "f", 1, 1, "x\n", sha("x\n")), (2, "p", "v", "a.py", "python", "function", "f", "f", 2, 2, "z\n", sha("z\n")), (3, "p", "v", "b.py", "python", "function", "f", "f", 2, 2, "2", "old")], c)
    cited = citations.evidence(stored, projects).withColumn("key", F.col("chunk_id"))
    cited = cited.withColumn("content_hash", F.when(F.col("key") == 3, sha("2")).otherwise(F.col("content_hash")))
    got = {r["key"]: r["reason"] for r in citations.citation_checks(cited, stored, files, projects).collect()}
    assert got == {1: None, 2: "stored source no longer matches code chunk", 3: "code chunk hash mismatch"}
    gone = cited.withColumn("chunk_id", F.lit(99).cast("long")).limit(1)
    assert citations.citation_checks(gone, stored, files, projects).first()["reason"] == "source file or code chunk no longer exists"


def test_rendering_fails_in_order(spark):
    aliases = spark.createDataFrame([(1, "A1", "[E1]"), (2, "A1", "[E1]")], "q long, alias string, token string")
    parts = spark.createDataFrame([(1, 2, "b", ["A1", "A1"]), (1, 1, "a", ["A1"]), (2, 1, "see [E4]", ["A1"]), (2, 2, "x", []), (3, 1, "x", ["A1"]), (4, 1, "x", ["A1"] * 9)], "q long, part_no int, text string, aliases array<string>")
    got = {r["q"]: (r["answer"], r["failure"]) for r in citations.rendered_answers(parts, aliases, "q").collect()}
    assert got == {1: ("a [E1]\n\nb [E1] [E1]", None), 2: (None, "model_supplied_location_forbidden"), 3: (None, "citation_alias_unknown"), 4: (None, "citation_alias_limit_exceeded")}


def test_seven_statuses_of_targets(spark):
    t = "name string, path string, digest string"
    old = spark.createDataFrame([("a", "p1", "1"), ("b", "p2", "2"), ("c", "p3", "3"), ("d", "p4", "4"), ("e", "p5", "5"), ("g", "p7", "7"), ("h", "p8", "8"), ("i", "p9", "8")], t)
    new = spark.createDataFrame([("a", "p1", "1"), ("b", "q2", "2"), ("c", "p3", "3x"), ("d", "q4", "4x"), ("e", "q5", "5x"), ("e", "q6", "5y"), ("h", "q8", "8")], t)
    known = old.unionByName(spark.createDataFrame([("f", "p6", "6")], t))
    got = {r["name"]: r["status"] for r in learning.target_checks(known, old, new).collect()}
    assert got == {"a": "unchanged_exact", "b": "renamed_exact", "c": "modified", "d": "moved", "e": "ambiguous", "f": "invalid_source", "g": "unmapped", "h": "ambiguous", "i": "ambiguous"}


def test_labels_of_runs_and_warnings(spark):
    hits = spark.createDataFrame([(1, True, True, True, True, True), (2, False, False, False, False, False), (3, False, True, False, True, False)], "q long, A boolean, B boolean, C boolean, D boolean, E boolean")
    said = spark.createDataFrame([(2, "target is Ambiguous and stale"), (3, None)], "q long, warning string")
    got = {}
    for r in evaluation.path_labels(hits, "q", said).collect():
        got.setdefault(r["q"], set()).add(r["label"])
    assert got == {1: {"all paths hit"}, 2: {"all paths miss", "ambiguous relation target", "stale relation graph"}, 3: {"v2 fixes v1", "hierarchy noise", "hierarchy + relation conflict"}}


def test_run_differences(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "q long, id long, place long")
    b = spark.createDataFrame([(1, 5, 1), (1, 9, 2)], "q long, id long, place long")
    assert sorted(map(tuple, lookups.run_differences(a, b, "q").collect())) == [(1, 2, 6, 9), (2, 1, 7, None)] and lookups.run_differences(a, a, "q").count() == 0


def test_index_is_replaced_by_snapshot(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "p", "r"), ("n2", "q", "r")], "node_id string, project_id string, repository_revision string")
    e = spark.createDataFrame([("e1", "p", "r")], "edge_id string, project_id string, repository_revision string")
    writers.replace_relation_index(nodes, e, str(tmp_path))
    writers.replace_relation_index(spark.createDataFrame([("n9", "p", "s")], nodes.schema), e, str(tmp_path))
    assert {r["node_id"] for r in spark.read.parquet(f"{tmp_path}/relation_nodes.parquet").collect()} == {"n2", "n9"}
    for bad in (nodes.unionByName(nodes), nodes.unionByName(spark.createDataFrame([("n3", "p", "z")], nodes.schema))):
        with pytest.raises(ValueError):
            writers.replace_relation_index(bad, e, str(tmp_path))


def test_runs_activation_and_deletion(spark):
    r = "project_id string, revision string, config string, status string"
    runs = spark.createDataFrame([("p", "1", "c", "done")], r)
    asked = spark.createDataFrame([("p", "1", "c", "0"), ("p", "2", "c", "1"), ("p", "2", "c", "1"), ("q", "5", "c", "5")], "project_id string, revision string, config string, current string")
    assert sorted(map(tuple, writers.with_runs(runs, asked).collect())) == [("p", "1", "c", "done"), ("p", "2", "c", "queued"), ("q", "5", "c", "unchanged")]
    v = spark.createDataFrame([("w", 1, "s1", "superseded"), ("w", 2, "s2", "active")], "workspace_id string, version int, snapshot string, state string")
    ask = spark.createDataFrame([("w", 2, "s3"), ("w", 2, "s4"), ("w", 1, "s0"), ("x", 0, "t1"), ("y", 1, "u")], "workspace_id string, expected int, snapshot string")
    assert sorted(map(tuple, writers.activated(v, ask).collect())) == [("w", 1, "s1", "superseded"), ("w", 2, "s2", "superseded"), ("w", 3, "s3", "active"), ("x", 1, "t1", "active")]
    left = writers.without_project({"projects": spark.createDataFrame([("p",), ("q",)], "id string"), "runs": runs, "names": spark.createDataFrame([("a",)], "token string")}, "p")
    assert left["projects"].count() == 1 and left["runs"].count() == 0 and left["names"].count() == 1


def test_artifacts_have_an_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    one = writers.write_artifacts({"m": df}, str(tmp_path / "1")).collect()
    two = writers.write_artifacts({"m": df.repartition(3)}, str(tmp_path / "2")).collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two] and {r["kind"] for r in one} == {"json", "csv"} and one[0]["rows"] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_artifacts({"m": df}, str(tmp_path / "1"))
