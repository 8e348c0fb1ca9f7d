"""Ranked retrieval: BM25, dense, symbol and file ranking, fusion, query analysis.

Queries are a stated set that is small against what is searched.  Their terms, vectors and
words are taken in blocks of ``BLOCK`` to the tasks; what is searched stays where it was read
and is cut to the best k per query and partition before it is moved.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.paths import compared_path
from ..functions.text import _RAW, normal_identifier, searchable_text, word_tokens
from ..session import spread

K1, B = 1.5, 0.75
RRF_K = 60
#: queries of one pass
BLOCK = 1024
#: terms of the queries of one pass, which are sent to every task
SENT_ROWS = 200_000


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group in a total order, numbered from 1 (cut before the shuffle)."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return rows.withColumn(name, at).where(F.col(name) <= k)


def term_counts(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, length): the code tokens of each text with their counts and the text's number of tokens.

    A text is counted whole where it was read; nothing is shuffled.  Each text also gives a row of the empty term with tf 0, so that
    texts without tokens are seen.  Keys are unique; null texts count as empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = _counted(t)
                length = sum(counts.values())
                rows = [("", 0), *counts.items()]
                out[0].extend([k] * len(rows))
                out[1].extend(x for x, _ in rows)
                out[2].extend(n for _, n in rows)
                out[3].extend([length] * len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[key, "term", "tf", "length"])

    return spread(texts.select(F.col(key).cast("long"), text.alias("_text"))).mapInArrow(count, f"{key} long, term string, tf long, length long")


def _counted(text: str | None) -> dict[str, int]:
    """The code tokens of a text and how often it holds them."""
    counts: dict[str, int] = {}
    for w, n in Counter(_RAW.findall(text or "")).items():
        for x in word_tokens(w):
            counts[x] = counts.get(x, 0) + n
    return counts


class _Asked:
    """The terms of a block of queries: rows of (query, weight) per term."""

    def __init__(self, queries: list[tuple[int, dict[str, int]]]):
        self.keys = np.asarray([q for q, _ in queries], np.int64)
        by: dict[str, list[tuple[int, int]]] = {}
        for j, (_, terms) in enumerate(queries):
            for t, n in terms.items():
                by.setdefault(t, []).append((j, n))
        self.term = {t: i for i, t in enumerate(by)}
        self.first = np.cumsum([0, *(len(p) for p in by.values())])
        self.query = np.asarray([j for p in by.values() for j, _ in p], np.int64)
        self.count = np.asarray([n for p in by.values() for _, n in p], np.float64)


def _blocks(queries: DataFrame, key: str, text: Column) -> Iterator[_Asked]:
    """The queries in blocks of at most BLOCK queries and, but for a single one, SENT_ROWS terms."""
    block: list[tuple[int, dict[str, int]]] = []
    terms = 0
    rows = queries.select(F.col(key).cast("long").alias("k"), text.alias("t")).where("k IS NOT NULL").orderBy("k")
    for r in rows.toLocalIterator():
        counts = _counted(r["t"])
        if not counts:
            continue
        if block and (len(block) == BLOCK or terms + len(counts) > SENT_ROWS):
            yield _Asked(block)
            block, terms = [], 0
        block.append((r["k"], counts))
        terms += len(counts)
    if block:
        yield _Asked(block)


def _document_frequencies(texts: DataFrame, asked: _Asked) -> tuple[int, float, np.ndarray]:
    """(texts, mean number of tokens, texts that hold each term of the block)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(asked.term), np.int64), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts = _counted(t)
                n, length = n + 1, length + sum(counts.values())
                for x in counts.keys() & asked.term.keys():
                    df[asked.term[x]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.r_[[-2, -1], at], "n": np.r_[[n, length], df[at]]}, schema=pa.schema([("term", pa.int64()), ("n", pa.int64())]))

    got = {r["term"]: r["n"] for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, length = got.pop(-2, 0), got.pop(-1, 0)
    df = np.zeros(len(asked.term), np.int64)
    df[list(got)] = list(got.values())
    return n, length / n if n else 1.0, df


def bm25(texts: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query_text: Column, ties: list[str], k: int = 20) -> DataFrame:
    """(query_key, key, score, place): BM25 of every query against all texts, the best k each.

    Statistics are those of the texts given, so filters belong before.  The idf is
    ln(1 + (N - df + .5) / (df + .5)); a term counts as often as the query holds it.  Two
    passes over the texts for a block of queries: one counts in how many texts their terms
    are, one scores each text whole where it was read and keeps the best k per query and
    partition, so that nothing else is moved, however common a term is.  Scores of 0 and
    empty texts do not appear; ties go by the columns ``ties`` of the texts, which travel along.
    """
    more = [t for t in ties if t != key]
    types = {f.name: f.dataType for f in texts.schema.fields}
    source = spread(texts.select(text.alias("_text"), F.col(key).cast("long").alias(key), *more))
    schema = T.StructType([T.StructField(query_key, T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType()), *[T.StructField(t, types[t]) for t in more]])
    arrow = to_arrow_schema(schema)
    order = [1 + ([key, *more].index(t)) for t in ties]
    out = texts.sparkSession.createDataFrame([], schema)
    for asked in _blocks(queries, query_key, query_text):
        total, mean, df = _document_frequencies(source.select("_text"), asked)
        idf = np.log(1.0 + (total - df + 0.5) / (df + 0.5))

        def score(batches: Iterator[pa.RecordBatch], asked=asked, idf=idf, mean=mean or 1.0) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in asked.keys]
            least = np.zeros(len(best))

            def cut(j: int) -> None:
                best[j].sort(key=lambda r: (-r[0], *((r[c] is not None, r[c]) for c in order)))
                del best[j][k:]
                if len(best[j]) == k:
                    least[j] = best[j][-1][0]

            def take(rows: list[tuple], entry: list[int], term: list[int], weight: list[float]) -> None:
                at = np.asarray(term, np.int64)
                n = asked.first[at + 1] - asked.first[at]
                post = np.arange(n.sum()) + np.repeat(asked.first[at] - np.cumsum(n) + n, n)
                cell = np.repeat(np.asarray(entry, np.int64), n) * len(best) + asked.query[post]
                sums = np.bincount(cell, np.repeat(np.asarray(weight), n) * asked.count[post], len(rows) * len(best)).reshape(len(rows), -1)
                sums = np.round(sums, 6)
                for i, j in zip(*np.nonzero((sums > 0) & (sums >= least))):
                    best[j].append((float(sums[i, j]), *rows[i]))
                    if len(best[j]) > 4 * k + 64:
                        cut(j)

            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                rows: list[tuple] = []
                entry: list[int] = []
                term: list[int] = []
                weight: list[float] = []
                work = 0
                for t, *row in zip(*columns):
                    counts = _counted(t)
                    length = sum(counts.values())
                    for x in counts.keys() & asked.term.keys():
                        e, tf = asked.term[x], counts[x]
                        entry.append(len(rows))
                        term.append(e)
                        weight.append(idf[e] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))
                        work += int(asked.first[e + 1] - asked.first[e])
                    rows.append(tuple(row))
                    if work + len(rows) * len(best) > 2_000_000:
                        take(rows, entry, term, weight)
                        rows, entry, term, weight, work = [], [], [], [], 0
                if rows:
                    take(rows, entry, term, weight)
            for j in range(len(best)):
                cut(j)
            held = [(int(asked.keys[j]), r[1], r[0], *r[2:]) for j, rows in enumerate(best) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held) if held else [[]] * len(arrow), arrow)], schema=arrow)

        out = out.unionByName(source.mapInArrow(score, schema))
    return top_k(out, [query_key], [F.desc("score"), *[F.col(t) for t in ties]], k).select(query_key, key, "score", "place")


def dense(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 5) -> DataFrame:
    """(query_key, key, score, place): exact inner products, the best k each, ties by key.

    Queries go to the tasks in blocks; vectors of another length than a query's, null ones
    and scores that are not finite are left out.  A partition keeps k rows per query.
    """
    wanted = [(r[0], np.asarray(r[1], float)) for r in queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull()).orderBy(query_key).toLocalIterator()]
    schema = f"{query_key} long, {key} long, score double"
    out = vectors.sparkSession.createDataFrame([], schema)
    rows = vectors.select(F.col(key).cast("long"), F.col(vector)).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    for a in range(0, len(wanted), BLOCK):
        block = wanted[a : a + BLOCK]

        def score(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            best: dict = {q: (np.zeros(0), np.zeros(0, np.int64)) for q, _ in block}
            for batch in batches:
                ids = batch.column(0).to_numpy()
                lists = batch.column(1)
                n = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                first = np.r_[0, np.cumsum(n)][:-1]
                for size in {len(v) for _, v in block}:
                    at = np.flatnonzero(n == size)
                    if not len(at):
                        continue
                    x = flat[first[at][:, None] + np.arange(size)]
                    for q, v in block:
                        if len(v) != size:
                            continue
                        s = np.round(x @ v, 6)
                        ok = np.isfinite(s)
                        s, i = np.r_[best[q][0], s[ok]], np.r_[best[q][1], ids[at][ok]]
                        keep = np.lexsort((i, -s))[:k]
                        best[q] = s[keep], i[keep]
            q = np.concatenate([np.full(len(s), q, np.int64) for q, (s, _) in best.items()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(np.concatenate([i for _, i in best.values()])), pa.array(np.concatenate([s for s, _ in best.values()]))],
                names=[query_key, key, "score"],
            )

        if block:
            out = out.unionByName(rows.mapInArrow(score, schema))
    return top_k(out, [query_key], [F.desc("score"), F.col(key)], k)


# How names can match a hint, with scores.
TIERS = (
    (0, 1.0, "exact_qualified"), (1, 0.95, "exact_symbol_context"), (2, 0.85, "exact_leaf"), (3, 0.75, "normalized_identifier"), (4, 0.55, "lexical_prefix"), (5, 0.35, "lexical_contains"),
)


def _loose_matches(sides: DataFrame, hints: DataFrame, last: int, k: int) -> DataFrame:
    """Chunks whose names begin with a hint (tier 4) or, if ``last`` is 5, hold it, but match by no better tier.

    The hints go to the tasks in blocks as one automaton, which every name is run through once;
    a partition keeps the best k of each hint.
    """
    schema = "hint_id long, id long, qualified string, c_path string, start_line int, end_line int, tier long"
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = pa.schema([(c, pa.string() if c in ("qualified", "c_path") else pa.int32() if c.endswith("line") else pa.int64()) for c in names])
    wanted = hints.select(F.col("hint_id").cast("long"), F.lower("value").alias("needle"), "path").where("needle != '' AND hint_id IS NOT NULL").orderBy("hint_id")
    todo = ((r["hint_id"], r["needle"], r["path"]) for r in wanted.toLocalIterator())
    rows = sides.select("id", "qualified", "symbol", "c_path", F.col("start_line").cast("int"), F.col("end_line").cast("int"))
    out = sides.sparkSession.createDataFrame([], schema)
    place = lambda p: (p or "").replace("\\", "/").lstrip("/").lower()
    bare = lambda x: re.sub("[^a-z0-9]", "", x)
    while block := list(islice(todo, BLOCK)):
        by: dict[str, list] = {}
        for i, needle, path in block:
            by.setdefault(needle, []).append((i, None if path is None else place(path)))

        def run(batches: Iterator[pa.RecordBatch], by=by) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for needle in by:
                automaton.add_word(needle, needle)
            automaton.make_automaton()
            best: dict[int, list[tuple]] = {}
            for batch in batches:
                for i, qualified, symbol, path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                    for needle in {n for name in (qualified, symbol) for _, n in automaton.iter(name)}:
                        if needle in (qualified, symbol) or needle.rsplit(".", 1)[-1] == symbol or bare(needle) and bare(needle) in (bare(qualified), bare(symbol)):
                            continue
                        tier = 4 if qualified.startswith(needle) or symbol.startswith(needle) else 5
                        for hint, where in by[needle] if tier <= last else ():
                            if where is None or place(path) == where:
                                rows = best.setdefault(hint, [])
                                rows.append((tier, qualified, path or "", -1 if start is None else start, -1 if end is None else end, i, path, start, end))
                                if len(rows) > 4 * k + 64:
                                    rows.sort(key=lambda r: r[:6])
                                    del rows[k:]
            found = [(hint, r[5], r[1], r[6], r[7], r[8], r[0]) for hint, rows in best.items() for r in sorted(rows, key=lambda r: r[:6])[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(arrow), arrow)], schema=arrow)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def symbol_matches(chunks: DataFrame, hints: DataFrame, k: int = 20, mode: str = "auto") -> DataFrame:
    """(hint_id, id, tier, score, match_type, place): chunks whose names match a hint, best tier first.

    ``mode``: auto takes the exact tiers, prefix also names that begin with the hint, fuzzy
    also names that hold it.

    ``hints``: hint_id, value, path (null for none).  Tiers: the qualified name; the symbol
    with the hint's path; the symbol or the hint's last part; names that agree without signs
    and case.  Every tier is an equality, so hints and chunks meet on shared keys instead of
    in pairs.  Order: tier, score, qualified name, path, start, end, id.
    """
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tag = lambda t, c: F.concat(F.lit(t), c)
    sides = chunks.select(
        "id", F.col("path").alias("c_path"), lower(F.col("symbol_name")).alias("symbol"), lower(F.col("qualified_name")).alias("qualified"), "start_line", "end_line"
    )
    keyed = sides.withColumn(
        "key",
        F.explode(
            F.array_distinct(
                F.array(tag("q:", F.col("qualified")), tag("s:", F.col("symbol")), tag("n:", normal_identifier(F.col("qualified"))), tag("n:", normal_identifier(F.col("symbol"))))
            )
        ),
    )
    needle = lower(F.col("value"))
    leaf = F.element_at(F.split(needle, r"\."), -1)
    asked = hints.select(
        "hint_id", needle.alias("needle"), leaf.alias("leaf"), F.col("path").alias("h_path"),
        F.explode(F.array_distinct(F.array(tag("q:", needle), tag("s:", needle), tag("s:", leaf), tag("n:", normal_identifier(needle))))).alias("key"),
    ).where("key NOT IN ('n:', 'q:', 's:')")
    spelled = lambda c: F.lower(F.ltrim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/")))
    hit = keyed.join(asked, "key").where(F.col("h_path").isNull() | (spelled(F.col("c_path")) == spelled(F.col("h_path"))))
    tier = (
        F.when(F.col("needle") == F.col("qualified"), 0)
        .when((F.col("needle") == F.col("symbol")) & F.col("h_path").isNotNull(), 1)
        .when((F.col("needle") == F.col("symbol")) | (F.col("leaf") == F.col("symbol")), 2)
        .otherwise(3)
    )
    best = hit.withColumn("tier", tier.cast("long")).groupBy("hint_id", "id", "qualified", "c_path", "start_line", "end_line").agg(F.min("tier").alias("tier"))
    if mode not in ("auto", "prefix", "fuzzy"):
        raise ValueError("a mode is auto, prefix or fuzzy")
    if mode != "auto":
        best = best.unionByName(_loose_matches(sides, hints, 4 if mode == "prefix" else 5, k))
    score, kind = F.lit(None).cast("double"), F.lit(None).cast("string")
    for t, s, m in TIERS:
        score, kind = F.when(F.col("tier") == t, F.lit(s)).otherwise(score), F.when(F.col("tier") == t, F.lit(m)).otherwise(kind)
    ranked = best.withColumn("score", score).withColumn("match_type", kind)
    order = [F.col("tier"), F.desc("score"), F.col("qualified"), F.col("c_path"), F.col("start_line"), F.col("end_line"), F.col("id")]
    return top_k(ranked, ["hint_id"], order, k).select("hint_id", "id", "tier", "score", "match_type", "place")


def symbol_candidates(chunks: DataFrame, hints: DataFrame, key: str, pool: int = 24, most_hints: int = 8) -> DataFrame:
    """(key, id, hints, tier, score, match_types, place): one list of candidates for queries of several hints.

    ``hints``: key, hint_id, value, path.  Of a query the first ``most_hints`` hints count, each
    with its share of the pool (rounded up).  A chunk that several hints find has the best
    place and score among them, and the union of their match types.
    """
    ranked = hints.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("hint_id"))).where(F.col("at") <= most_hints)
    share = ranked.groupBy(key).agg(F.ceil(F.lit(pool) / F.count("*")).alias("share"))
    found = symbol_matches(chunks, ranked.select("hint_id", "value", "path"), pool).join(ranked.select(key, "hint_id"), "hint_id").join(share, key).where(F.col("place") <= F.col("share"))
    one = found.groupBy(key, "id").agg(
        F.countDistinct("hint_id").alias("hints"), F.min(F.struct("place", (-F.col("score")).alias("low"), "tier")).alias("b"), F.array_join(F.array_sort(F.collect_set("match_type")), ",").alias("match_types")
    )
    rows = one.select(key, "id", "hints", F.col("b.tier").alias("tier"), (-F.col("b.low")).alias("score"), "match_types", F.col("b.place").alias("best"))
    return top_k(rows, [key], [F.col("best"), F.desc("score"), F.col("id")], pool).select(key, "id", "hints", "tier", "score", "match_types", "place")


def fuse(lists: dict[str, tuple[DataFrame, float]], by: str, key: str, k: int = 8) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (by, key, place): sum of weight / (60 + place).

    Columns: by, key, a place per source, score, best_place, sources, place.  The sum is
    taken in the order of the names, so it does not depend on the input's.  Order: score,
    best place of a source, number of sources, key.
    """
    tagged = None
    for name, (df, _) in sorted(lists.items()):
        part = df.select(F.col(by), F.col(key), F.lit(name).alias("source"), F.col("place"))
        tagged = part if tagged is None else tagged.unionByName(part)
    one = tagged.groupBy(by, key).agg(*[F.min(F.when(F.col("source") == n, F.col("place"))).alias(f"{n}_place") for n in sorted(lists)])
    total = F.lit(0.0)
    for n in sorted(lists):
        total = total + F.coalesce(F.lit(float(lists[n][1])) / (F.lit(float(RRF_K)) + F.col(f"{n}_place")), F.lit(0.0))
    places = [F.col(f"{n}_place") for n in sorted(lists)]
    scored = one.withColumn("score", F.round(total, 9)).withColumn("best_place", F.least(*places) if len(places) > 1 else places[0])
    scored = scored.withColumn("sources", sum((p.isNotNull().cast("long") for p in places), F.lit(0).cast("long")))
    return top_k(scored, [by], [F.desc("score"), F.col("best_place"), F.desc("sources"), F.col(key)], k)


# What a question asks for, by phrases in English and Chinese.
INTENTS = {
    "locate": (
        r"在哪里定义|定义在哪|哪个文件|哪一个文件|定位|查找.{0,12}定义",
        r"(?i)\bwhere\s+(?:is|are)\b.{0,80}\bdefined\b|\bwhich\s+file\b|\blocate\b|\bfind\s+(?:the\s+)?definition\b|\bdefinition\s+of\b",
    ),
    "explain": (
        r"如何工作|怎么工作|为什么|解释|实现机制|如何实现",
        r"(?i)\bhow\s+(?:does|do|is|are)\b|\bhow\b.{0,60}\bwork\b|\bwhy\b|\bexplain\b|\bimplementation\b",
    ),
    "impact": (
        r"影响什么|谁会受影响|影响范围|(?:修改|变更|改动).{0,30}影响",
        r"(?i)\bwhat\b.{0,60}\b(?:impact|affect)\b|\bwho\b.{0,40}\baffected\b|\bimpact\s+of\b|\bwhat\s+changes?\s+if\b|\b(?:change|modified|modify)\b.{0,60}\baffect\b",
    ),
    "relation": (
        r"谁调用|被谁调用|调用了谁|调用它|和谁有关|装饰器.{0,20}包装",
        r"(?i)\bwho\s+calls?\b|\bwhat\s+does\b.{0,50}\bcall\b|\bcalled\s+by\b|\brelated\s+to\b|\bcallers?\b|\bcallees?\b|\bdecorator\b.{0,30}\bwrap",
    ),
}
#: weights of dense, lexical and symbol lists by intent; mixed and unknown are neutral
ROUTES = {"locate": (1.1, 1.05, 1.2), "explain": (1.1, 1.15, 1.15), "impact": (1.0, 1.05, 1.05), "relation": (1.0, 1.05, 1.1)}


def query_intents(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, intent, intents, confidence, dense_weight, lexical_weight, symbol_weight) of each question.

    One matching intent is taken at .9, several make it ``mixed`` at .65, none ``unknown`` at
    .2; a null text is unknown.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    names = F.array_compact(F.array(*(F.when(t.rlike(zh) | t.rlike(en), n) for n, (zh, en) in INTENTS.items())))
    rows = queries.select(F.col(key), names.alias("names"))
    intent = F.when(F.size("names") > 1, "mixed").when(F.size("names") == 1, F.element_at("names", 1)).otherwise("unknown")
    confidence = F.when(F.size("names") > 1, 0.65).when(F.size("names") == 1, 0.9).otherwise(0.2)
    rows = rows.select(key, intent.alias("intent"), F.array_join("names", ",").alias("intents"), confidence.alias("confidence"))
    for j, source in enumerate(("dense", "lexical", "symbol")):
        w = F.lit(1.0)
        for n, route in ROUTES.items():
            w = F.when(F.col("intent") == n, F.lit(route[j])).otherwise(w)
        rows = rows.withColumn(f"{source}_weight", w)
    return rows


def symbol_hints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hint): identifiers in texts: in back quotes, dotted, in snake or camel case; lower case, distinct."""
    t = F.coalesce(F.col(text), F.lit(""))
    quoted = F.regexp_extract_all(t, F.lit(r"`([^`\r\n]{1,500})`"), F.lit(1))
    plain = F.regexp_replace(t, r"`[^`\r\n]{1,500}`", " ")
    runs = F.regexp_extract_all(plain, F.lit(r"([A-Za-z0-9_.]+)"), F.lit(1))
    words = F.regexp_extract_all(plain, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    ident = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
    hints = F.concat(
        F.filter(F.transform(quoted, lambda q: F.regexp_replace(F.trim(q), r"\(\)$", "")), lambda q: q.rlike(f"^{ident}$")),
        F.filter(runs, lambda r: r.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$")),
        F.filter(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+$")),
        F.filter(words, lambda w: w.rlike(r"^[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$") & w.rlike("[a-z]")),
    )
    return texts.select(F.col(key), F.explode(F.array_distinct(F.transform(hints, F.lower))).alias("hint"))


def chunk_text() -> Column:
    return searchable_text(F.col("path"), F.col("symbol_name"), F.col("qualified_name"), F.col("content"))


# What a question about files is after, by words in it, and the file names that answer it.
FILE_INTENTS = {
    "start": (("启动", "运行", "run", "start", "dev", "serve", "命令"), ("README.md", "package.json", "pyproject.toml", "requirements.txt", "main.py")),
    "entry": (("入口", "entry", "main", "首先", "开始"), ("main.py", "app.py", "server.py", "index.js", "main.tsx", "app.tsx")),
    "core": (("核心", "模块", "架构", "结构", "重要"), ()),
}


def file_intents(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, intent): what each question is after; one row per intent, none for a question without."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return questions.select(key, F.explode(F.array_compact(F.array(*(F.when(has(words), name) for name, (words, _) in FILE_INTENTS.items())))).alias("intent"))


def rank_files(profiles: DataFrame, contents: DataFrame, questions: Iterable[tuple[int, list[str], list[str]]], k: int = 6) -> DataFrame:
    """(query_id, id, score, place): files by the words of a question in path and content.

    8 a word in the path, up to 8 occurrences of it in the content, 30 for a name that answers
    an intent, 5 for core files, the importance up to 100 over 25; a file without a word or
    such a name is no result.  ``questions``: (id, words, intents); they are taken in blocks
    of BLOCK, a pass over the contents each.
    """
    schema = "query_id long, id long, words_score long"
    texts = spread(contents.select("id", compared_path(F.col("path")).alias("path"), "content").where("path IS NOT NULL AND content IS NOT NULL"))
    hits = contents.sparkSession.createDataFrame([], schema)
    names = lambda intents: Counter(n for x in intents for n in FILE_INTENTS[x][1])
    todo = ((i, ws, names(intents)) for i, ws, intents in questions if ws or intents)
    while block := list(islice(todo, BLOCK)):

        def count(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                for i, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                    name = path.rsplit("/", 1)[-1]
                    path, text = path.lower(), text.lower()
                    seen: dict[str, int] = {}
                    for q, ws, wanted in block:
                        n = 30 * wanted[name]
                        for w in ws:
                            if w not in seen:
                                seen[w] = (8 if w in path else 0) + min(8, text.count(w))
                            n += seen[w]
                        if n:
                            out[0].append(q)
                            out[1].append(i)
                            out[2].append(n)
                yield pa.RecordBatch.from_pydict({"query_id": out[0], "id": out[1], "words_score": out[2]}, schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("words_score", pa.int64())]))

        hits = hits.unionByName(texts.mapInArrow(count, schema))
    scored = hits.join(profiles.select("id", "path", "importance", "is_core"), "id")
    score = F.round(F.col("words_score") + F.when(F.col("is_core"), 5).otherwise(0) + F.least(F.col("importance"), F.lit(100.0)) / 25, 6)
    scored = scored.select("query_id", "id", "path", score.alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("path"), F.col("id")], k).select("query_id", "id", "score", "place")
