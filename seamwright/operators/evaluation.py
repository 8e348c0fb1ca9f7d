"""Retrieval quality: metrics of ranked lists against gold, roll-ups, paired comparisons, intervals."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 8)


def query_metrics(ranked: DataFrame, gold: DataFrame, query: str, key: str) -> DataFrame:
    """Hit, recall and nDCG at 1, 3, 5 and 8 and the reciprocal rank of each query with gold.

    ``ranked``: query, key, place; ``gold``: query, key (distinct).  nDCG has binary gains and
    an ideal of min(gold, k) hits.  Queries without gold are skipped, those without results
    score 0.
    """
    hits = ranked.join(gold.select(query, key).distinct().withColumn("hit", F.lit(1)), [query, key], "left_semi").select(query, "place")
    size = gold.select(query, key).distinct().groupBy(query).agg(F.count("*").alias("gold"))
    aggs = []
    for k in CUTS:
        inside = F.col("place") <= k
        aggs += [F.count_if(inside).alias(f"n{k}"), F.sum(F.when(inside, F.lit(1.0) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias(f"g{k}")]
    rows = size.join(hits.groupBy(query).agg(F.min("place").alias("first"), *aggs), query, "left")
    ideal = [sum(1.0 / __import__("math").log2(r + 1) for r in range(1, n + 1)) for n in range(0, 9)]
    out = [F.col(query), F.col("gold")]
    for k in CUTS:
        n = F.coalesce(f"n{k}", F.lit(0))
        top = F.element_at(F.array(*map(F.lit, ideal)), F.least(F.col("gold"), F.lit(k)).cast("int") + 1)
        out += [
            F.when(n > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}"),
            F.round(n / F.col("gold"), 6).alias(f"recall_at_{k}"),
            F.round(F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / top, 6).alias(f"ndcg_at_{k}"),
        ]
    first = F.when(F.col("first") <= 8, F.lit(1.0) / F.col("first")).otherwise(0.0)
    return rows.select(*out, F.round(first, 6).alias("mrr_at_8"))


def roll_up(metrics: DataFrame, repository: str, stratum: str, names: list[str]) -> DataFrame:
    """(level, repository, stratum, queries, metrics...): per repository, per stratum, micro and macro.

    Micro pools all queries; macro is the mean of the repositories' means.
    """
    means = [F.round(F.avg(n), 6).alias(n) for n in names]
    sets = metrics.groupingSets([[F.col(repository)], [F.col(stratum)], []], F.col(repository), F.col(stratum)).agg(F.count("*").alias("queries"), *means, F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "repository").when(F.col("g") == 2, "stratum").otherwise("micro")
    base = sets.select(level.alias("level"), F.col(repository).alias("repository"), F.col(stratum).alias("stratum"), "queries", *names)
    per = metrics.groupBy(repository).agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names])
    none = F.lit(None).cast("string")
    macro = per.agg(F.sum("queries").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names]).select(F.lit("macro").alias("level"), none.alias("repository"), none.alias("stratum"), "queries", *names)
    return base.unionByName(macro)


def paired_effects(a: DataFrame, b: DataFrame, query: str, metric: str) -> DataFrame:
    """How b differs from a on the queries of both: improved, unchanged, regressed, mean difference."""
    both = a.select(query, F.col(metric).alias("x")).join(b.select(query, F.col(metric).alias("y")), query)
    d = F.col("y") - F.col("x")
    return both.agg(
        F.count("*").alias("queries"), F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("regressed"), F.round(F.avg(d), 6).alias("mean_difference")
    )


def bootstrap(values: DataFrame, group: str, key: str, value: str, samples: int = 2000, seed: int = 20260726) -> DataFrame:
    """(group, n, mean, low, high): 95 % percentile interval of the mean by a seeded bootstrap.

    The draws are those of one generator over the values in the order of ``key``, so they are
    sequential within a group; groups of more than 100 000 values are refused.
    """
    n = min(20_000, max(100, samples))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > 100_000:
            raise ValueError("a bootstrap group has at most 100 000 values")
        pdf = pdf.sort_values(key)
        v = [float(x) for x in pdf[value]]
        rng = random.Random(seed)
        means = sorted(sum(v[rng.randrange(len(v))] for _ in v) / len(v) for _ in range(n))
        at = lambda q: means[min(n - 1, int(q * n))]
        return pd.DataFrame([(pdf[group].iloc[0], len(v), sum(v) / len(v), at(0.025), at(0.975))], columns=["group", "n", "mean", "low", "high"])

    return values.where(F.col(value).isNotNull()).select(group, key, value).groupBy(group).applyInPandas(draw, "group string, n long, mean double, low double, high double")


def percentiles(rows: DataFrame, group: str, value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Count, mean and exact percentiles of each group, interpolated between the two nearest ranks.

    Values are range-partitioned by (group, value); ranks are made per partition and shifted
    by the counts before it, so a group of any size is spread.  Null values are left out.
    """
    from ..session import checkpointed

    given = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    parts = checkpointed(given.repartitionByRange("g", "v").select("g", "v", F.spark_partition_id().alias("p")))
    counts = parts.groupBy("g", "p").agg(F.count("*").alias("c"))
    before = counts.select("g", "p", (F.sum("c").over(Window.partitionBy("g").orderBy("p")) - F.col("c")).alias("before"))
    stats = parts.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    inside = parts.withColumn("at", F.row_number().over(Window.partitionBy("g", "p").orderBy("v")) - 1)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ranked = inside.join(before.select(F.col("g").alias("g2"), F.col("p").alias("p2"), "before"), same("g", "g2") & (F.col("p") == F.col("p2")))
    ranked = ranked.join(stats.withColumnRenamed("g", "g3"), same("g", "g3")).select("g", "v", "n", "mean", (F.col("before") + F.col("at")).alias("rank"))
    low = [F.floor((F.col("n") - 1) * q) for q in at]
    wanted = F.lit(False)
    for x in low:
        wanted = wanted | (F.col("rank") == x) | (F.col("rank") == x + 1)
    cuts = []
    for q, x in zip(at, low):
        a = F.max(F.when(F.col("rank") == x, F.col("v")))
        b = F.max(F.when(F.col("rank") == x + 1, F.col("v")))
        part = F.first((F.col("n") - 1) * q - x)
        cuts.append(F.round(a + F.coalesce(b - a, F.lit(0.0)) * part, 6).alias(f"p{round(q * 100)}"))
    return ranked.where(wanted).groupBy("g").agg(F.first("n").alias("n"), F.round(F.first("mean"), 6).alias("mean"), *cuts).withColumnRenamed("g", group)


def poisoned_sum(rows: DataFrame, group: str, value: Column, known: Column) -> DataFrame:
    """(group, total, status): the sum of a group, unknown as soon as one value is."""
    got = rows.groupBy(group).agg(F.count_if(~known).alias("unknown"), F.sum(F.when(known, value)).alias("total"))
    return got.select(group, F.when(F.col("unknown") == 0, F.round("total", 4)).alias("total"), F.when(F.col("unknown") > 0, "unknown").otherwise("calculated").alias("status"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """(key, number): rows numbered from 0 in the order of their keys.

    Numbers are made per range partition and shifted by the counts before it, so that no task
    sees all rows.
    """
    from ..session import checkpointed

    parts = checkpointed(rows.select(key).repartitionByRange(key).select(key, F.spark_partition_id().alias("p")))
    counts = parts.groupBy("p").count()  # a row per partition
    before = counts.select("p", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = parts.withColumn("at", F.row_number().over(Window.partitionBy("p").orderBy(key)) - 1)
    return inside.join(before, "p").select(key, (F.col("before") + F.col("at")).alias("number"))


def round_robin(rows: DataFrame, key: str, batches: int) -> DataFrame:
    """(key, batch): rows dealt to batches in the order of their keys."""
    return numbered(rows, key).select(key, F.pmod("number", F.lit(batches)).alias("batch"))


def half_cover(rows: DataFrame, key: str) -> DataFrame:
    """(key, part): the first half of the rows by key (one more if odd) is A, the rest B."""
    total = rows.count()
    return numbered(rows, key).select(key, F.when(F.col("number") < (total + 1) // 2, "A").otherwise("B").alias("part"))


def stratified_bootstrap(values: DataFrame, repository: str, key: str, value: str, samples: int = 2000, seed: int = 20260726) -> DataFrame:
    """(level, mean, low, high): intervals of the pooled mean and of the mean of repository means.

    Each sample draws within every repository as many values as it has, from one generator
    over repositories and values in order; at most 100 000 values in all.
    """
    n = min(20_000, max(100, samples))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > 100_000:
            raise ValueError("a bootstrap has at most 100 000 values")
        groups = [[float(x) for x in g.sort_values(key)[value]] for _, g in pdf.groupby(repository, sort=True)]
        rng = random.Random(seed)
        size = sum(map(len, groups))
        micro, macro = [], []
        for _ in range(n):
            means = [sum(g[rng.randrange(len(g))] for _ in g) / len(g) for g in groups]
            micro.append(sum(m * len(g) for m, g in zip(means, groups)) / size)
            macro.append(sum(means) / len(means))
        rows = []
        for name, got, mean in (("micro", micro, sum(map(sum, groups)) / size), ("macro", macro, sum(sum(g) / len(g) for g in groups) / len(groups))):
            got.sort()
            rows.append((name, mean, got[int(0.025 * n)], got[min(n - 1, int(0.975 * n))]))
        return pd.DataFrame(rows, columns=["level", "mean", "low", "high"])

    rows = values.where(F.col(value).isNotNull() & F.col(repository).isNotNull()).select(F.lit(1).alias("one"), repository, key, value)
    return rows.groupBy("one").applyInPandas(draw, "level string, mean double, low double, high double")


def dataset_faults(questions: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, fault): what is wrong with evaluation items: duplicate question, unknown path, unknown symbol, no expectation."""
    from ..functions.paths import compared_path

    twice = questions.groupBy("question").agg(F.count("*").alias("n"), F.min("item_id").alias("first")).where("n > 1")
    dup = questions.join(twice, "question").where("item_id != first").select("item_id", F.lit("duplicate_question").alias("fault"))
    paths = files.select(compared_path(F.col("path")).alias("expected_file_path")).distinct()
    no_path = questions.where("expected_file_path IS NOT NULL").join(paths, "expected_file_path", "left_anti").select("item_id", F.lit("unknown_path").alias("fault"))
    names = chunks.select(F.col("symbol_name").alias("expected_symbol")).distinct()
    no_symbol = questions.where("expected_symbol IS NOT NULL").join(names, "expected_symbol", "left_anti").select("item_id", F.lit("unknown_symbol").alias("fault"))
    empty = questions.where("answerable AND expected_file_path IS NULL AND expected_symbol IS NULL").select("item_id", F.lit("no_expectation").alias("fault"))
    return dup.unionByName(no_path).unionByName(no_symbol).unionByName(empty)


# What five runs of a query say about each other, by the runs that hit (A lexical, B fused, C with hierarchy, D with relations, E with both).
PATH_LABELS = {
    "all paths hit": "A AND B AND C AND D AND E", "all paths miss": "NOT (A OR B OR C OR D OR E)", "v2 fixes v1": "B AND NOT A", "v2 regresses v1": "A AND NOT B", "hierarchy gain": "C AND NOT B",
    "hierarchy noise": "B AND NOT C", "relation gain": "D AND NOT B", "relation noise": "B AND NOT D", "hierarchy + relation complementary": "E AND NOT C AND NOT D", "hierarchy + relation conflict": "(C OR D) AND NOT E",
}
#: what the warnings of a run say
WARNING_LABELS = {"ambiguous": "ambiguous relation target", "external": "external relation", "stale": "stale relation graph", "scope": "scope conflict", "unavailable": "relation unavailable", "truncated": "budget truncation"}


def path_labels(hits: DataFrame, by: str, warnings: DataFrame | None = None) -> DataFrame:
    """(by, label): how the five runs of a query compare (``hits``: by, A to E as booleans), and what their warnings (by, warning) say."""
    labels = F.array_compact(F.array(*(F.when(F.expr(rule), name) for name, rule in PATH_LABELS.items())))
    out = hits.select(by, F.explode(labels).alias("label"))
    if warnings is None:
        return out
    said = F.array_compact(F.array(*(F.when(F.lower("warning").contains(word), name) for word, name in WARNING_LABELS.items())))
    return out.unionByName(warnings.select(by, F.explode(said).alias("label"))).distinct()


def paired_by_repository(one: DataFrame, two: DataFrame, by: str, repository: str, metric: str) -> DataFrame:
    """(repository, queries, improved, unchanged, regressed, gained, lost, mean_first, mean_second, mean_difference) of two runs of the same queries.

    ``gained`` and ``lost`` count queries that hit in one run only (the metric above 0).
    """
    x, y = F.col("x"), F.col("y")
    both = one.select(by, repository, F.col(metric).alias("x")).join(two.select(by, repository, F.col(metric).alias("y")), [by, repository])
    mean = lambda c: F.round(F.avg(c), 6)
    return both.groupBy(repository).agg(
        F.count("*").alias("queries"), F.count_if(y > x).alias("improved"), F.count_if(y == x).alias("unchanged"), F.count_if(y < x).alias("regressed"), F.count_if((y > 0) & (x == 0)).alias("gained"),
        F.count_if((x > 0) & (y == 0)).alias("lost"), mean(x).alias("mean_first"), mean(y).alias("mean_second"), mean(y - x).alias("mean_difference"),
    )


def scenario_metrics(ranked: DataFrame, gold: DataFrame, chunks: DataFrame, by: str, k: int = 10) -> DataFrame:
    """(by, files, gold_files, precision, recall, f1, hit_at_1, hit_at_5, mrr_at_10, relevant): the files of a ranking against the gold files.

    Every query with gold has a row.  ``relevant`` is the share of the results that lie in a gold
    file or bear a gold symbol.
    """
    facts = chunks.select("id", "path", "symbol_name", "project_id", "start_line", "end_line")
    want = gold.select(by, F.col("id").alias("gold_id")).distinct().join(facts.select(F.col("id").alias("gold_id"), *[F.col(c).alias(f"g_{c}") for c in facts.columns if c != "id"]), "gold_id")
    got = ranked.where(F.col("place") <= k).select(by, "id", "place").join(facts, "id")
    files = got.groupBy(by, "path").agg(F.min("place").alias("place"))
    right = files.join(want.select(by, F.col("g_path").alias("path")).distinct(), [by, "path"], "left_semi")
    near = (F.col("path") == F.col("g_path")) | (F.col("symbol_name") == F.col("g_symbol_name"))
    relevant = got.join(want, by).where(near).select(by, "id").distinct().groupBy(by).agg(F.count("*").alias("relevant_n"))
    n = files.groupBy(by).agg(F.count("*").alias("files")).join(got.groupBy(by).agg(F.count("*").alias("results")), by)
    hits = right.groupBy(by).agg(F.count("*").alias("right"), F.min("place").alias("first"))
    rows = want.groupBy(by).agg(F.countDistinct("g_path").alias("gold_files")).join(n, by, "left").join(hits, by, "left").join(relevant, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    precision, recall = zero("right") / F.greatest(zero("files"), F.lit(1)), zero("right") / F.col("gold_files")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    r = lambda c: F.round(c, 6)
    hit = lambda at: F.coalesce(F.col("first") <= at, F.lit(False))
    return rows.select(
        by, zero("files").alias("files"), "gold_files", r(precision).alias("precision"), r(recall).alias("recall"), r(f1).alias("f1"), hit(1).alias("hit_at_1"), hit(5).alias("hit_at_5"),
        r(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_at_10"), r(zero("relevant_n") / F.greatest(zero("results"), F.lit(1))).alias("relevant"),
    )
