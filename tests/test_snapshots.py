from pyspark.sql import Row

from seamwright.operators.snapshots import consecutive_pairs, repository_changes, snapshot_changes

FILES = "id long, project_id string, path string, content string, lane int, snapshot string"
PROJECTS = "id string, owner string, repo string, status string, created_at string"


def changes(spark, files, projects):
    f = spark.createDataFrame([(*x, 0, "x") for x in files], FILES)
    p = spark.createDataFrame(projects, PROJECTS)
    return sorted(tuple(r) for r in repository_changes(f, p).collect())


PAIR = [("a", "Own", "r", "ready", "2025-01-01"), ("b", "own", "R", "ready", "2025-01-02")]


def test_kinds_paths_and_redeliveries(spark):
    files = [
        (1, "a", "./x.py", "1"), (2, "a", "y.py", "1"), (3, "a", "z\\w.py", "1"), (4, "a", "gone.py", "1"), (9, "a", "x.py", "1"),
        (5, "b", "/x.py", "1"), (6, "b", "y.py", "2"), (7, "b", "z/w.py", "1"), (8, "b", "new.py", ""),
    ]
    assert changes(spark, files, PAIR) == [("b", "gone.py", "removed"), ("b", "new.py", "added"), ("b", "y.py", "changed")]


def test_null_contents_and_keys(spark):
    files = [
        (1, "a", "x", None), (2, "a", "y", "1"), (3, "a", "z", None), (4, "b", "x", "1"), (5, "b", "y", None), (6, "b", "n", None),
        (7, None, "q", "1"), (8, "b", None, "1"), (9, "a", "k", "1"), (10, "a", "k", None), (11, "b", "k", "1"),
        (12, "a", "m", None), (13, "b", "u", None), (14, "a", "u", None),
    ]
    # an unknown content can come and go, but is never changed: x, y, z to nothing, n and m
    assert changes(spark, files, PAIR) == [("b", "m", "removed"), ("b", "n", "added"), ("b", "z", "removed")]


def test_failed_and_late_snapshots(spark):
    projects = [("c", "o", "r", "ready", "2025-03-01"), ("a", "o", "r", "ready", "2025-01-01"), ("b", "o", "r", "failed", "2025-02-01"), ("n", None, None, None, None)]
    files = [(1, "a", "x", "1"), (2, "b", "x", "9"), (3, "c", "x", "1"), (4, "c", "y", "1")]
    assert changes(spark, files, projects) == [("c", "y", "added")]


def test_redelivered_revision_and_ties(spark):
    projects = [(i, "o", "r", "ready", "2025-01-01") for i in "abc"]
    files = [(1, "a", "x", "1"), (2, "b", "x", "1"), (3, "c", "x", "2")]
    assert changes(spark, files, projects) == [("c", "x", "changed")]


def test_empty(spark):
    assert changes(spark, [], PAIR) == []
    assert changes(spark, [(1, "a", "x", "1")], []) == []


def test_many_keys_against_plain_difference(spark):
    old = {f"d{i % 13}/f{i}": i % 7 for i in range(3000)}
    new = {k: (v + 1 if i % 50 == 0 else v) for i, (k, v) in enumerate(old.items()) if i % 90}
    new |= {f"new/{i}": 1 for i in range(40)}
    rows = [("a", k, str(v), 1) for k, v in old.items()] + [("b", k, str(v), 1) for k, v in new.items()]
    df = spark.createDataFrame(rows, "snapshot string, key string, digest string, version int")
    pairs = spark.createDataFrame([("a", "b")], "old_id string, new_id string")
    got = {tuple(r)[1:] for r in snapshot_changes(df, pairs, "snapshot", "key", "digest", "version").collect()}
    want = {(k, "removed") for k in old.keys() - new.keys()} | {(k, "added") for k in new.keys() - old.keys()} | {(k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}
    assert got == want


def test_pairs(spark):
    df = spark.createDataFrame([Row(e="r", s="b", t=2), Row(e="r", s="a", t=1), Row(e="r", s="b", t=3), Row(e=None, s="z", t=1)])
    assert [tuple(r) for r in consecutive_pairs(df, "e", "s", "t").collect()] == [("a", "b")]
