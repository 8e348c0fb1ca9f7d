import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from seamwright.session import local_session

    return local_session(4, "4g", 4)


@pytest.fixture(scope="session")
def tiny():
    return TINY


def norm(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, float):
        return None if v != v else float(repr(round(v, 9)))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(tiny):
    """Compares a DataFrame with SQL on the smallest data: columns, kinds of types, rows."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tiny}/{f}'")

    def kind(t: str) -> str:
        t = str(t).lower()
        if t.startswith(("bigint", "int", "smallint", "tinyint", "long")):
            return "int"
        if t.startswith(("double", "float", "real")):
            return "double"
        if t.startswith(("varchar", "string")):
            return "string"
        return t.split("(")[0].split(" ")[0].removesuffix("_ntz")

    def compare(df, sql):
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        kinds = {x[0]: kind(x[1]) for x in cur.description}
        assert sorted(df.columns) == sorted(names)
        assert {c: kind(t) for c, t in df.dtypes} == kinds
        cols = sorted(names)
        a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        b = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert a == b

    return compare
