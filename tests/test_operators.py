"""Operators that SQL does not express, and cases the test tables do not hold."""

import itertools

from pyspark.sql import functions as F

from seamwright.functions.text import code_tokens, code_tokens_of
from seamwright.operators import evaluation, learning, retrieval, structure

EVENT = "event_id string, idempotency_key string, learner_id string, project_id string, target_id string, event_order long, event_type string, provenance string, task_id string, validated_outcome_json string, created_at timestamp"


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(code_tokens(F.col("t"))).first()[0]


def test_code_tokens(spark):
    assert tokens(spark, "parseHTTPResponse_v2") == ["parsehttpresponse_v2", "parsehttpresponse", "parse", "http", "response", "v2"]
    assert tokens(spark, "foo foo") == ["foo", "foo"]
    assert tokens(spark, "读取文件") == ["读取文件", "读", "取", "文", "件", "读取", "取文", "文件"]
    assert tokens(spark, "") == [] and tokens(spark, "?!") == []
    for t in ("parseHTTPResponse_v2 foo foo", "读取文件 readFile_读取ABc", "__init__ _x A1bC", "", "naïveÉtat 12ab"):
        assert sorted(code_tokens_of(t)) == sorted(tokens(spark, t))


def event(n, kind, prov, outcome, task="t1", target="x", key=None):
    return (f"e{n}", key or f"k{n}", "l", "p", target, n, kind, prov, task, outcome, None)


A, S, R = ("attempt_evaluated", "verified_assessment"), ("self_reported", "explicit_self_report"), ("revision_revalidated", "revision_revalidation")


def states(spark, rows):
    got = learning.learning_states(spark.createDataFrame(rows, EVENT)).collect()
    return {r["target_id"]: r for r in got}


def test_fold_transitions(spark):
    rows = [
        event(1, *S, '{"level": 1}', target="intro"),
        event(2, *A, '{"verdict": "pass", "task_type": "explain_symbol"}', "t1", "master"), event(3, *A, '{"verdict": "pass"}', "t2", "master"),
        event(4, *A, '{"verdict": "pass"}', "t1", "shown"), event(5, *A, '{"verdict": "pass"}', "t1", "shown"),
        event(6, *A, '{"verdict": "pass"}', "t1", "fell"), event(7, *A, '{"verdict": "fail"}', "t2", "fell"),
        event(8, *A, '{"verdict": "partial"}', "t1", "part"), event(9, *A, "not json", "t1", "odd"),
        event(10, *A, '{"verdict": "pass"}', "t1", "moved"), event(11, *R, '{"availability": "changed"}', None, "moved"),
        event(12, "continuity_state_derived", "revision_continuity", '{"mapping_status": "unchanged_exact", "availability": "current", "source_mastery_status": "mastered", "source_verified_pass_count": 2, "source_qualifying_pass_count": 1}', None, "kept"),
    ]
    s = states(spark, rows)
    assert {k: v["mastery"] for k, v in s.items()} == {
        "intro": "introduced", "master": "mastered", "shown": "demonstrated", "fell": "needs_review", "part": "practicing", "odd": "unseen", "moved": "needs_review", "kept": "mastered",
    }
    assert s["shown"]["passes"] == 1 and s["fell"]["review_reason"] == "validated_failure" and s["moved"]["review_reason"] == "revision_changed"
    assert (s["kept"]["passes"], s["kept"]["qualifying_passes"]) == (2, 1)


def test_fold_takes_corrections_ahead_and_ignores_redelivery(spark):
    rows = [
        event(1, *A, '{"verdict": "pass"}'),
        event(2, "evaluation_corrected", "verified_assessment", '{"reverses_event_id": "e1", "corrected_verdict": "fail"}'),
        ("e9", "k1", "l", "p", "x", 1, *A, "t1", '{"verdict": "pass"}', None),
    ]
    s = states(spark, rows)["x"]
    assert (s["mastery"], s["passes"], s["events"]) == ("practicing", 0, 2)


def test_fold_does_not_depend_on_row_order(spark):
    rows = [event(1, *S, "{}"), event(2, *A, '{"verdict": "fail"}'), event(3, *A, '{"verdict": "pass"}')]
    assert len({str(states(spark, list(p))["x"]) for p in itertools.permutations(rows)}) == 1


def streamed(spark, parts, path):
    """The last states a stream of the given batches puts out."""
    from seamwright.streaming.fold import stream_states

    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("overwrite").parquet(str(path / "in" / f"part={i}"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path / "in"))
    seen = {}

    def take(df, n):
        for r in df.collect():
            seen.setdefault((r["learner_id"], r["project_id"], r["target_id"]), []).append(r)

    q = stream_states(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {k: max(v, key=lambda r: r["events"]) for k, v in seen.items()}


def test_stream_equals_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/learning_events.parquet")
    # the later half first: every other event comes late
    parts = [events.where("event_order % 2 = 1"), events.where("event_order % 2 = 0")]
    last = streamed(spark, parts, tmp_path)
    batch = {(r["learner_id"], r["project_id"], r["target_id"]): r for r in learning.learning_states(events).collect()}
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in batch.items()}


#: events of one key that bring every rule to bear: mastered, exact and lost mappings, corrections, lifts
RULES = [
    [event(1, *S, "{}"), event(2, *A, '{"verdict": "partial"}'), event(3, *A, '{"verdict": "pass", "task_type": "explain_symbol"}', "t1"), event(4, *A, '{"verdict": "pass"}', "t2")],
    [event(1, *A, '{"verdict": "pass", "task_type": "explain_symbol"}', "t1"), event(2, *R, '{"availability": "current"}', None), event(3, *A, '{"verdict": "fail"}', "t9"), event(4, *S, "{}")],
    [event(1, *A, '{"verdict": "pass"}'), event(2, "continuity_state_derived", "revision_continuity", '{"mapping_status": "renamed_exact", "availability": "current", "source_mastery_status": "introduced", "source_verified_pass_count": 1, "source_qualifying_pass_count": 1}', None), event(3, *A, '{"verdict": "partial"}'), event(4, *A, '{"verdict": "pass"}', "t1")],
    [event(1, *A, '{"verdict": "pass"}'), event(2, "continuity_state_derived", "revision_continuity", '{"mapping_status": "ambiguous"}', None), event(3, *A, '{"verdict": "partial"}')],
    [event(1, *A, '{"verdict": "fail"}'), event(2, *A, '{"verdict": "pass"}', "t2"), event(3, "evaluation_corrected", "verified_assessment", '{"reverses_event_id": "e1", "corrected_verdict": "pass", "task_type": "explain_symbol"}')],
    [event(1, *A, '{"verdict": "pass"}', ""), event(2, "continuity_state_derived", "revision_continuity", '{"mapping_status": "unchanged_exact", "source_mastery_status": "wise"}', None), event(3, *S, "{}")],
    [event(1, *A, '{"verdict": "fail"}'), event(2, *S, "{}"), event(3, *A, '{"verdict": "odd"}'), event(4, *R, "{}", None), event(5, *R, '{"availability": "current"}', None)],
]
EXPECTED = [
    ("mastered", "current", 2, 1, ""), ("needs_review", "current", 1, 1, "validated_failure"), ("mastered", "current", 2, 1, ""), ("needs_review", "current", 1, 0, "revision_ambiguous"),
    ("mastered", "current", 2, 1, ""), ("needs_review", "stale", 0, 0, ""), ("needs_review", "current", 0, 0, "revision_stale"),
]


def test_states_of_every_rule_in_any_order_batch_and_stream(spark, tmp_path):
    rows = [(*e[:2], e[2] + str(k), *e[3:]) for k, events in enumerate(RULES) for e in events]
    # ids and idempotency keys are unique over the table
    rows = [(f"{e[0]}-{e[2]}", f"{e[1]}-{e[2]}", *e[2:9], e[9].replace('"e1"', f'"e1-{e[2]}"'), e[10]) for e in rows]
    frame = spark.createDataFrame(rows, EVENT)
    pick = lambda r: (r["mastery"], r["availability"], r["passes"], r["qualifying_passes"], r["review_reason"])
    batch = {r["learner_id"]: pick(r) for r in learning.learning_states(frame).collect()}
    assert [batch[f"l{k}"] for k in range(len(RULES))] == EXPECTED
    # the SQL the tables are compared with gives the same
    import duckdb

    from seamwright.plans.learning_queries import SQL

    con = duckdb.connect()
    con.register("learning_events", frame.toPandas())
    got = con.execute(SQL["learning_state"]).df()
    assert {r.learner_id: (r.mastery, r.availability, r.passes, r.qualifying_passes, r.review_reason) for r in got.itertuples()} == batch
    last = streamed(spark, [frame.where("event_order > 2"), frame.where("event_order <= 2")], tmp_path)
    assert [pick(last[f"l{k}", "p", "x"]) for k in range(len(RULES))] == EXPECTED


def test_plan_order():
    assert learning.plan_is_acyclic(3, [(0, 1), (1, 2)])
    assert not learning.plan_is_acyclic(3, [(0, 1), (1, 2), (2, 0)])


def test_one_hop_follows_every_relation(spark):
    from seamwright.operators import indexing

    code = {"a.py": "from b import g, K\n\n\ndef f():\n    return g()\n\n\ndef h():\n    from b import g\n\n\nclass L(K):\n    def m(self):\n        pass\n", "b.py": "def g():\n    pass\n\n\nclass K:\n    pass\n"}
    files = spark.createDataFrame([(i, "p", p, t) for i, (p, t) in enumerate(code.items())], "id long, project_id string, path string, content string")
    projects = spark.createDataFrame([("p", "o", "r", "ready", "v", 1)], "id string, owner string, repo string, status string, repository_revision string, created_at long")
    named = [(1, "a.py", "f", 4), (2, "a.py", "h", 8), (3, "a.py", "L", 12), (4, "a.py", "L.m", 13), (5, "b.py", "g", 1), (6, "b.py", "K", 5)]
    chunks = spark.createDataFrame([(i, "p", p, q, "L" if q == "L.m" else None, n) for i, p, q, n in named], "id long, project_id string, path string, qualified_name string, parent_symbol string, start_line int")
    links = structure.relation_links(chunks, structure.relation_edges(files, projects))
    ranked = spark.createDataFrame([(7, 5, 1), (7, 3, 2)], "q long, id long, place long")
    got = {r["target"]: (r["priority"], r["paths"]) for r in indexing.one_hop_relations(ranked, links, "q").collect()}
    assert got == {"chunk:1": (0.5, 1), "chunk:2": (0.45, 1), "chunk:6": (round(0.8 / 3, 9), 1), "chunk:4": (round(0.7 / 3, 9), 1)}


def test_relation_edges(spark):
    sources = {
        "pkg/a.py": "from pkg.b import work\nimport os\n\ndef run():\n    os.getcwd()\n    print(1)\n    return work()\n",
        "pkg/b.py": "from . import c\n\nclass Base:\n    def go(self):\n        return self.stop()\n    def stop(self):\n        pass\n\nclass Kid(Base):\n    pass\n\ndef work():\n    return c.end(nobody())\n",
        "pkg/c.py": "import pkg.a\n\ndef end(x):\n    return pkg.a.run()\n",
        "bad.py": "def (",
    }
    files = spark.createDataFrame([(i, "p", k, v) for i, (k, v) in enumerate(sources.items())], "id long, project_id string, path string, content string")
    projects = spark.createDataFrame([("p", "o", "r", "v1", "ready", "2025-01-01")], "id string, owner string, repo string, repository_revision string, status string, created_at string")
    got = {(r["path"], r["relation"], r["raw_name"], r["status"], r["target_path"], r["target_symbol"]) for r in structure.relation_edges(files, projects).collect()}
    for want in {
        ("pkg/a.py", "imports", "pkg.b.work", "resolved", "pkg/b.py", "work"),
        ("pkg/a.py", "imports", "os", "external", None, None),
        ("pkg/a.py", "calls", "work", "resolved", "pkg/b.py", "work"),
        ("pkg/a.py", "calls", "os.getcwd", "external", None, None),
        ("pkg/a.py", "calls", "print", "external", None, None),
        ("pkg/b.py", "imports", "c", "resolved", "pkg/c.py", ""),
        ("pkg/b.py", "calls", "self.stop", "resolved", "pkg/b.py", "Base.stop"),
        ("pkg/b.py", "references", "Base", "resolved", "pkg/b.py", "Base"),
        ("pkg/b.py", "calls", "c.end", "resolved", "pkg/c.py", "end"),
        ("pkg/b.py", "calls", "nobody", "unresolved", None, None),
        ("pkg/c.py", "calls", "pkg.a.run", "resolved", "pkg/a.py", "run"),
    }:
        assert want in got, want


def test_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert sorted((r["node"], r["depth"]) for r in structure.bounded_walk(edges, seeds, 3).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]



def test_bm25_statistics_follow_the_filter_and_order_does_not_matter(spark):
    rows = [(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "beta"), (4, "")]
    asked = spark.createDataFrame([(1, "alpha")], "q long, t string")

    def run(data):
        df = spark.createDataFrame(data, "id long, text string")
        return [tuple(r) for r in retrieval.bm25(df, "id", F.col("text"), asked, "q", F.col("t"), ["id"], 5).orderBy("place").collect()]

    assert run(rows) == run(rows[::-1]) and [r[1] for r in run(rows)] == [2, 1]
    assert run(rows) != run(rows[:2])


def test_dense_leaves_out_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.5])], "q long, v array<double>")
    assert [(r["id"], r["score"]) for r in retrieval.dense(v, "id", "v", q, "q", "v", 5).orderBy("place").collect()] == [(1, 1.0), (2, 0.5)]


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(50)], "g string, k long, v double")
    a, b = (evaluation.bootstrap(df.orderBy(F.rand(s)), "g", "k", "v", 200).first() for s in (1, 2))
    assert a == b and a["low"] <= a["mean"] <= a["high"]
