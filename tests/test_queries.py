"""Every query of the core library that SQL can express, against SQL."""

import pytest

from seamwright.plans import catalog_queries, corpus_queries, evidence_queries, graph_queries, indexing_queries, learning_queries, lookup_queries, maintenance_queries, retrieval_queries, structure_queries

MODULES = (corpus_queries, catalog_queries, retrieval_queries, structure_queries, maintenance_queries, learning_queries, indexing_queries, lookup_queries, graph_queries, evidence_queries)
CASES = [(m, name) for m in MODULES for name in m.QUERIES]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(module, name, spark, tiny, same_as_sql):
    df = module.QUERIES[name](spark, tiny)
    if name in module.SQL:
        same_as_sql(df, module.SQL[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["project_id", "path", "change_type"]


def test_stands_without_llm():
    """Nothing outside the subpackage imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "seamwright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*llm", p.read_text(), re.M), p
