import hashlib

import pytest

from seamwright.operators import indexing, maintenance, structure
from seamwright.sources import readers, schemas, writers


def test_tables_conform(spark, tiny):
    for name in schemas.TABLES:
        df = readers.read_table(spark, tiny, name)
        assert df.schema.fieldNames() == schemas.schema(name).fieldNames()
    odd = schemas.conformed(spark.createDataFrame([("1", 5)], "id string, other int"), "repo_files")
    assert odd.first()["id"] == 1 and odd.first()["content"] is None


def test_checkout(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    for name, data in {"src/a.py": b"x = 1\n", "b.md": b"#", "README.md": b"hi", "src/z.py": b"a\0b", "src/c.py": "é".encode("latin1"), "node_modules/x/i.js": b"1", ".hidden.py": b"1", "big.txt": b"y" * 200_001}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r["content"] for r in readers.read_checkout(spark, str(tmp_path), "p", "r").collect()}
    assert set(got) == {"src/a.py", "README.md", "src/c.py"} and got["src/a.py"] == "x = 1\n"


def test_json_needs_its_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "path": "x"}\n')
    assert readers.read_json(spark, str(tmp_path / "a.json"), "repo_files").first()["path"] == "x"


def test_byte_cap_passes_large_files_over(spark):
    df = spark.createDataFrame([(1, "p", "a", "x" * 60), (2, "p", "b", "x" * 50), (3, "p", "c", "x" * 40), (4, "q", "a", "é" * 50), (5, None, "a", "x"), (6, "p", "d", None)], "id long, project_id string, path string, content string")
    assert sorted(r["id"] for r in readers.tracked_files(df, 100).collect()) == [1, 3, 4]
    assert readers.tracked_files(df.limit(0), 100).count() == 0


def test_import_limits_of_files_and_bytes(spark, tmp_path):
    from seamwright.plans.indexing_queries import tracked_files

    rows = [(i, "p", f"f{i:04d}", "x" * 100) for i in range(2_001)] + [(5_000 + i, "q", f"{i:03d}", "x" * (1_000_000 - (i == 9))) for i in range(51)] + [(9_000, "r", "a", "x" * 1_000_001), (9_001, "r", "b", "x" * 250_000), (9_002, "q", "z", "x")]
    schema = "id long, project_id string, path string, content string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "repo_files.parquet"))
    got = {r["id"] for r in tracked_files(spark, str(tmp_path)).collect()}
    assert got == {*range(2_000), *range(5_000, 5_050), 9_001, 9_002}


def test_source_lines_cut_bytes_and_lines(spark):
    files = spark.createDataFrame([(1, "p", "a", "1\n2\n3\n4")], "id long, project_id string, path string, content string")
    spans = spark.createDataFrame([(1, "p", "a", 2, 3), (2, "p", "a", 1, 9), (3, "p", "b", 1, 1)], "span_id long, project_id string, path string, start_line int, end_line int")
    got = {r["span_id"]: (r["lines"], r["text_hash"], r["truncated"]) for r in readers.source_lines(files, spans, 2).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, sha("2\n3"), False), 2: (2, sha("1\n2"), True)}


def test_source_lines_have_the_limits_of_a_reading(spark, tmp_path):
    from seamwright.plans.indexing_queries import source_lines

    text = "\n".join(f"line {i}" for i in range(1, 301))
    files = [(1, "p", "a", text), (2, "p", "b", "é" * 20_000)]
    spans = [(1, "p", "a", 1, 21), (2, "p", "a", 11, 210), (3, "p", "a", 1, 201), (4, "p", "b", 1, 1)]
    spark.createDataFrame(files, "id long, project_id string, path string, content string").write.parquet(str(tmp_path / "repo_files.parquet"))
    spark.createDataFrame(spans, "id long, project_id string, path string, start_line int, end_line int").write.parquet(str(tmp_path / "code_chunks.parquet"))
    got = {r["span_id"]: (r["lines"], r["text_hash"], r["truncated"]) for r in source_lines(spark, str(tmp_path)).collect()}
    part = lambda a, b: hashlib.sha256("\n".join(text.split("\n")[a - 1 : b]).encode()).hexdigest()
    assert got == {1: (21, part(1, 21), False), 2: (200, part(11, 210), False), 3: (200, part(1, 200), True), 4: (1, hashlib.sha256(("é" * 16_384).encode()).hexdigest(), True)}


EVENT = "event_id string, idempotency_key string, learner_id string, project_id string, target_id string, event_order long"


def test_append_and_upsert(spark):
    log = spark.createDataFrame([("a", "k1", "l", "p", "t", 4)], EVENT)
    new = spark.createDataFrame([("b", "k1", "l", "p", "t", 9), ("c", "k2", "l", "p", "t", 1), ("d", "k3", "l", "p", "t", 2), ("e", "k3", "l", "p", "t", 3), ("f", "k4", "l", None, "t", 1)], EVENT)
    assert sorted((r["event_id"], r["event_order"]) for r in writers.appended_events(log, new).collect()) == [("c", 5), ("d", 6), ("f", 1)]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert sorted(map(tuple, writers.upserted(old, spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string"), ["id"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_write_once_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "p"), (2, "q")], "id long, project_id string")
    writers.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception):  # noqa: B017
        writers.write_once(df, str(tmp_path / "once"))
    writers.replace_partitions(df, str(tmp_path / "t"))
    writers.replace_partitions(spark.createDataFrame([(3, "p")], "id long, project_id string"), str(tmp_path / "t"))
    assert sorted((r["id"], r["project_id"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2, "q"), (3, "p")]


def test_incremental_equals_full(spark):
    schema = "id long, project_id string, path string, content string"
    old = [(1, "a", "same.py", "def f():\n    pass\n"), (2, "a", "moved.py", "class A:\n    def g(self): pass\n"), (3, "a", "edit.py", "def h(): pass\n"), (4, "a", "gone.py", "def i(): pass\n"), (5, "a", "bad.py", "def (")]
    new = [(6, "b", "same.py", old[0][3]), (7, "b", "to/moved.py", old[1][3]), (8, "b", "edit.py", "def h2(): pass\n"), (9, "b", "new.py", "async def j(): pass\n"), (10, "b", "bad.py", "def k(): pass\n")]
    f = spark.createDataFrame(old + new, schema)
    diff = maintenance.manifest_diff(maintenance.snapshot_entries(f), spark.createDataFrame([("a", "b")], "old_id string, new_id string"))
    assert {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()} == {"unchanged": 1, "renamed": 1, "modified": 2, "deleted": 1, "added": 1}
    columns = ["path", "chunk_type", "qualified_name", "start_line", "end_line", "content_hash"]
    full = structure.python_chunks(f.where("project_id = 'b'")).select(*columns)
    made = indexing.incremental_chunks(structure.python_chunks(f.where("project_id = 'a'")), diff, f.where("project_id = 'b'"))
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(map(tuple, full.collect()))
    assert {r["origin"]: r["count"] for r in made.groupBy("origin").count().collect()} == {"reused": 3, "made": 3}


def test_structure_hash(spark):
    f = spark.createDataFrame([(1, "p", "a.py", "def a(x):\n    return x\n"), (2, "p", "b.py", "# c\ndef b(x):  return x\n"), (3, "p", "c.py", "def b(x): return 1\n")], "id long, project_id string, path string, content string")
    got = {r["file_id"]: r["structure_hash"] for r in indexing.structure_hashes(f).collect()}
    assert got[1] == got[2] != got[3]


def test_search_finds_what_is_asked(spark):
    chunks = spark.createDataFrame(
        [(1, "p", "v", "a/load.py", "function", "load_rows", "load_rows", 1, 3, "def load_rows(path):\n    return read(path)\n", "h1"), (2, "p", "v", "b.py", "function", "other", "other", 1, 2, "def other():\n    pass\n", "h2")],
        "id long, project_id string, repository_revision string, path string, chunk_type string, symbol_name string, qualified_name string, start_line int, end_line int, content string, content_hash string",
    )
    asked = spark.createDataFrame([(1, "where is `load_rows` defined"), (2, None)], "item_id long, question string")
    first = indexing.search(chunks, asked, "item_id", "question").where("place = 1").collect()
    assert [(r["item_id"], r["id"], r["symbol_place"]) for r in first] == [(1, 1, 1)]
    assert indexing.hashed_vector("a", 40).shape == (40,) and abs((indexing.bag_vector(["load", "rows", "read"], 64) ** 2).sum() - 1) < 1e-6
