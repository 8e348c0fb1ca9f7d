"""The hierarchy of chunks in a file: ancestors, relations of pairs, cycles, groups, bounded expansion and normalisation.

``parents`` is a parent map as of ``structure.span_parents``: id, parent_id, ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .structure import SCOPE


def ancestors(parents: DataFrame, depth: int = 16) -> DataFrame:
    """(id, ancestor, depth): the chunks above each chunk, up to ``depth`` levels; a join per level until none is left."""
    up = parents.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor"))
    level = up.withColumn("depth", F.lit(1).cast("long"))
    out = level
    step = up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
    for d in range(2, depth + 1):
        level = level.join(step, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(d).cast("long").alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def cycles(parents: DataFrame, depth: int = 16) -> DataFrame:
    """Ids of the chunks that are among their own ancestors."""
    return ancestors(parents, depth).where("id = ancestor").select("id").distinct()


def relations(pairs: DataFrame, chunks: DataFrame, parents: DataFrame, above: DataFrame) -> DataFrame:
    """(left, right, relation, depth): how two chunks lie to each other; ``pairs``: left, right ids.

    The first of: cross_scope, same_identity, ambiguous, exact_span_duplicate or
    exact_span_conflict (equal spans of equal or other content, type and name), parent or
    ancestor, child or descendant, sibling, strict_containment, partial_overlap, disjoint.
    """
    facts = chunks.select("id", *SCOPE, "start_line", "end_line", F.struct("content_hash", "chunk_type", "qualified_name").alias("same")).join(parents.select("id", "parent_id", "ambiguous"), "id", "left")
    side = lambda name, p: facts.select(F.col("id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in facts.columns if c != "id"])
    rows = pairs.join(side("left", "l"), "left").join(side("right", "r"), "right")
    rows = rows.join(above.select(F.col("id").alias("right"), F.col("ancestor").alias("left"), F.col("depth").alias("down")), ["left", "right"], "left")
    rows = rows.join(above.select(F.col("id").alias("left"), F.col("ancestor").alias("right"), F.col("depth").alias("upward")), ["left", "right"], "left")
    c = F.col
    other_scope = ~(c("l_project_id").eqNullSafe(c("r_project_id")) & c("l_repository_revision").eqNullSafe(c("r_repository_revision")) & c("l_path").eqNullSafe(c("r_path")))
    equal = (c("l_start_line") == c("r_start_line")) & (c("l_end_line") == c("r_end_line"))
    holds = lambda a, b: (c(f"{a}_start_line") <= c(f"{b}_start_line")) & (c(f"{a}_end_line") >= c(f"{b}_end_line"))
    meet = F.greatest("l_start_line", "r_start_line") <= F.least("l_end_line", "r_end_line")
    unsure = F.coalesce("l_ambiguous", F.lit(False)) | F.coalesce("r_ambiguous", F.lit(False))
    relation = (
        F.when(other_scope, "cross_scope").when(c("left") == c("right"), "same_identity").when(unsure, "ambiguous")
        .when(equal, F.when(c("l_same") == c("r_same"), "exact_span_duplicate").otherwise("exact_span_conflict"))
        .when(c("down") == 1, "parent").when(c("down").isNotNull(), "ancestor").when(c("upward") == 1, "child").when(c("upward").isNotNull(), "descendant")
        .when(c("l_parent_id") == c("r_parent_id"), "sibling").when(holds("l", "r") | holds("r", "l"), "strict_containment").when(meet, "partial_overlap").otherwise("disjoint")
    )
    depth = F.when(relation.isin("parent", "ancestor"), c("down")).when(relation.isin("child", "descendant"), c("upward")).when(relation == "sibling", 1).otherwise(0)
    return rows.select("left", "right", relation.alias("relation"), depth.cast("long").alias("depth"))


def exact_spans(chunks: DataFrame) -> DataFrame:
    """(id, representative, compatible): chunks that share their span with others of the file.

    If all of them agree in content, type and name, the smallest id stands for them; else
    every chunk stands for itself.
    """
    span = Window.partitionBy(*SCOPE, "start_line", "end_line")
    same = F.sha2(F.concat_ws("\x00", "content_hash", "chunk_type", "qualified_name"), 256)
    rows = chunks.select("id", F.count("*").over(span).alias("n"), (F.min(same).over(span) == F.max(same).over(span)).alias("compatible"), F.min("id").over(span).alias("first"))
    return rows.where("n > 1").select("id", F.when(F.col("compatible"), F.col("first")).otherwise(F.col("id")).alias("representative"), "compatible")


def group_ids(chunks: DataFrame, roots: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, group_id): ``H`` and a digest of the scope and the family root; ``X`` and one of the chunk itself if it is ambiguous."""
    rows = chunks.select("id", *SCOPE).join(roots, "id", "left").join(parents.select("id", "ambiguous"), "id", "left")
    digest = lambda last: F.sha2(F.concat_ws("\x00", *(F.coalesce(F.col(c), F.lit("")) for c in SCOPE), last.cast("string")), 256)
    unsure = F.coalesce("ambiguous", F.lit(False))
    return rows.select("id", F.when(unsure, F.concat(F.lit("X"), digest(F.col("id")))).otherwise(F.concat(F.lit("H"), digest(F.coalesce("root", "id")))).alias("group_id"))


def expand(ranked: DataFrame, above: DataFrame, by: str, direct: int = 24, depth: int = 2, neighbours: int = 8, derived: int = 24) -> DataFrame:
    """(by, id, kind, depth, anchor, place): the first results and what is near them in the hierarchy.

    ``kind``: direct, parent, child, ancestor, descendant.  Of a result the ``neighbours``
    nearest are looked at; a chunk that is reached several times counts by its best anchor,
    then depth, then kind, and not at all if it is a result itself.
    """
    start = ranked.where(F.col("place") <= direct).select(by, F.col("id").alias("anchor"), "place")
    near = above.where(F.col("depth") <= depth)
    both = near.select(F.col("id").alias("anchor"), F.col("ancestor").alias("id"), "depth", F.when(F.col("depth") == 1, 0).otherwise(2).alias("rank")).unionByName(
        near.select(F.col("ancestor").alias("anchor"), "id", "depth", F.when(F.col("depth") == 1, 1).otherwise(3).alias("rank"))
    )
    hit = start.join(both, "anchor").withColumn("n", F.row_number().over(Window.partitionBy(by, "anchor").orderBy("depth", "rank", "id"))).where(F.col("n") <= neighbours)
    hit = hit.join(start.select(by, F.col("anchor").alias("id")), [by, "id"], "left_anti")
    best = hit.groupBy(by, "id").agg(F.min(F.struct("place", "depth", "rank", "anchor")).alias("b"))
    order = Window.partitionBy(by).orderBy("b.place", "b.depth", "b.rank", "id")
    best = best.withColumn("k", F.row_number().over(order).cast("long")).where(F.col("k") <= derived)
    kind = F.element_at(F.array(*map(F.lit, ("parent", "child", "ancestor", "descendant"))), F.col("b.rank") + 1)
    shown = start.select(by, F.col("anchor").alias("id"), F.lit("direct").alias("kind"), F.lit(0).cast("long").alias("depth"), "anchor", F.struct(F.lit(0).alias("a"), F.col("place").alias("b")).alias("o"))
    extra = best.select(by, "id", kind.alias("kind"), F.col("b.depth").alias("depth"), F.col("b.anchor").alias("anchor"), F.struct(F.lit(1).alias("a"), F.col("k").alias("b")).alias("o"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("o")).cast("long")
    return shown.unionByName(extra).select(by, "id", "kind", "depth", "anchor", place.alias("place"))


def normalised(candidates: DataFrame, roots: DataFrame, parents: DataFrame, spans: DataFrame, by: str, cap: int = 2, k: int = 8) -> DataFrame:
    """(by, id, group, place): candidates (by, id, kind, place) without repeated spans and with few of a family.

    A chunk whose span another candidate stands for (``spans`` as of ``exact_spans``) is left
    out if that one is a candidate before it; at most ``cap`` of a family are kept, but direct
    ambiguous results always; the first ``k`` remain.
    """
    rows = candidates.join(roots, "id", "left").join(parents.select("id", "ambiguous"), "id", "left").join(spans.select("id", "representative"), "id", "left")
    stands = F.coalesce("representative", "id")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(by, stands).orderBy("place"))).where("n = 1")
    free = F.coalesce("ambiguous", F.lit(False)) & (F.col("kind") == "direct")
    rows = rows.withColumn("group", F.coalesce("root", "id")).withColumn("free", free)
    seat = F.row_number().over(Window.partitionBy(by, "group", "free").orderBy("place"))
    kept = rows.withColumn("seat", seat).where(F.col("free") | (F.col("seat") <= cap))
    final = F.row_number().over(Window.partitionBy(by).orderBy("place")).cast("long")
    return kept.withColumn("final", final).where(F.col("final") <= k).select(by, "id", F.col("group"), F.col("final").alias("place"))


def in_scope(chunks: DataFrame, scopes: DataFrame, most: int = 2048) -> DataFrame:
    """(id, place, truncated): the chunks of the asked files in hierarchy order, and whether a file has more than ``most``."""
    from .graph import bounded

    rows = chunks.join(scopes.select(*SCOPE).distinct(), list(SCOPE), "left_semi")
    order: list[Column] = [F.col("start_line"), F.desc("end_line"), F.col("qualified_name"), F.col("chunk_type"), F.col("id")]
    return bounded(rows, list(SCOPE), order, most).select("id", "place", "truncated")
