"""Running a Python function over whole texts, Arrow batch by Arrow batch.

No shuffle: rows stay where they were read, but for tables of fewer parts than there are
cores.  Repeated texts (deliveries repeat files) are
worked on once per worker, by digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: what a worker remembers of texts seen before, in characters of the results
MEMO_CHARS = 32_000_000


class _Memo:
    """Results by key; emptied when their strings and rows take more than MEMO_CHARS."""

    def __init__(self) -> None:
        self.rows: dict[tuple, list] = {}
        self.size = 0

    def put(self, key: tuple, rows: list) -> None:
        size = 200 + sum(100 + sum(len(v) for v in row if isinstance(v, str)) for row in rows)
        if size > MEMO_CHARS // 16:
            return
        if self.size + size > MEMO_CHARS:
            self.rows.clear()
            self.size = 0
        self.rows[key] = rows
        self.size += size


_MEMO = _Memo()


def map_texts(
    df: DataFrame, keep: list[str], text: str, arg: str, fn: Callable[[str, str], list[tuple]], schema: str, name: str,
    finish: Callable[[tuple, tuple], tuple] | None = None,
) -> DataFrame:
    """For each row with a text, the rows of ``fn(text, arg)`` with the columns ``keep`` in front.

    ``schema`` is the DDL of the result including ``keep``.  Null texts give no rows.
    ``name`` tells the memos of different functions apart.  ``finish(keep values, row)`` may
    complete a row by what is not the text's own, such as its path.
    """
    spark = df.sparkSession
    types = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            args = batch.column(1).to_pylist()
            keys = list(zip(*(batch.column(2 + i).to_pylist() for i in range(kept)))) if kept else [()] * len(args)
            columns: list[list] = [[] for _ in arrow]
            for i, key in enumerate(keys):
                t = texts[i].as_py()
                at = (name, args[i], blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                rows = _MEMO.rows.get(at)
                if rows is None:
                    rows = fn(t, args[i])
                    _MEMO.put(at, rows)
                for row in rows:
                    for c, v in zip(columns, key + (finish(key, row) if finish else row)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = df.where(F.col(text).isNotNull() & F.col(arg).isNotNull()).select(F.col(text), F.col(arg), *keep)
    return spread(rows).mapInArrow(run, types)
