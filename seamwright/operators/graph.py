"""The stored relation graph: nodes and edges with stable ids, bounded scans, walks under budgets, checks.

Edges are rows (edge_id, source_id, target_id, relation, status, project_id, repository_revision,
path, line, raw_target); a target may be null.  All budgets are windows over a total order, so
what is kept does not depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("project_id", "repository_revision", "path")
RELATIONS = ("calls", "defines", "imports", "references")


def json_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the SHA-256 of the parts as a compact JSON array of strings; null parts are empty."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256))


def short_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the first 32 digits of the SHA-256 of the NUL-joined parts; null parts are empty."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32))


def _file_id() -> Column:
    return json_id("n:", F.lit("file"), *(F.col(c) for c in SCOPE))


def _chunk_id() -> Column:
    return json_id("n:", F.lit("chunk"), *(F.col(c) for c in SCOPE), F.col("qualified_name"), F.col("start_line"), F.col("end_line"), F.col("id"))


def relation_nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, kind, project_id, repository_revision, path, qualified_name, chunk_id): a node per file and per chunk."""
    files = chunks.select(*SCOPE).distinct().select(_file_id().alias("node_id"), F.lit("file").alias("kind"), *SCOPE, F.lit("").alias("qualified_name"), F.lit(None).cast("long").alias("chunk_id"))
    return files.unionByName(chunks.select(_chunk_id().alias("node_id"), F.lit("chunk").alias("kind"), *SCOPE, "qualified_name", F.col("id").alias("chunk_id")))


def stored_edges(chunks: DataFrame) -> DataFrame:
    """The definition edges as stored rows: from the one chunk of the parent's name in the file, else from the file."""
    rows = chunks.select(*SCOPE, F.coalesce("parent_symbol", F.lit("")).alias("up"), _chunk_id().alias("target_id"), _file_id().alias("file_id"), F.col("start_line").alias("line"), F.col("qualified_name").alias("raw_target"))
    named = chunks.groupBy(*SCOPE, F.col("qualified_name").alias("up")).agg(F.min(_chunk_id()).alias("one"), F.count("*").alias("n")).where("n = 1")
    source = F.when(F.col("one") != F.col("target_id"), F.col("one")).otherwise(F.col("file_id"))
    edges = rows.join(named, [*SCOPE, "up"], "left").withColumn("source_id", F.coalesce(source, "file_id"))
    return edges.select(
        json_id("e:", F.col("source_id"), F.lit("defines"), F.col("target_id"), F.col("line")).alias("edge_id"), "source_id", "target_id", F.lit("defines").alias("relation"), F.lit("resolved").alias("status"),
        *SCOPE, "line", "raw_target",
    )


def edge_order() -> list[Column]:
    """The total order of edges: where they stand, what they are, what they point at."""
    return [F.col("path"), F.col("line"), F.col("relation"), F.col("raw_target"), F.coalesce("target_id", F.lit("")), F.col("edge_id")]


def bounded(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their ``place``, and ``truncated``: whether there was one more."""
    window = Window.partitionBy(*by).orderBy(*order)
    few = rows.withColumn("place", F.row_number().over(window).cast("long")).where(F.col("place") <= most + 1)
    more = F.max("place").over(Window.partitionBy(*by)) > most
    return few.withColumn("truncated", more).where(F.col("place") <= most)


def touching(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Edges with ``current`` and ``neighbour``: from each end that the direction (outgoing, incoming, both) lets be left."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("a direction is outgoing, incoming or both")
    out = edges.withColumn("current", F.col("source_id")).withColumn("neighbour", F.col("target_id"))
    back = edges.where("target_id IS NOT NULL").withColumn("current", F.col("target_id")).withColumn("neighbour", F.col("source_id"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def neighbour_edges(edges: DataFrame, seeds: DataFrame, direction: str = "both", most: int = 96) -> DataFrame:
    """(seed, edge_id, neighbour, place, truncated): the first edges that touch each seed (``node_id``), in edge order."""
    near = touching(edges, direction).join(seeds.select(F.col("node_id").alias("current")).distinct(), "current")
    return bounded(near, ["current"], edge_order(), most).select(F.col("current").alias("seed"), "edge_id", "neighbour", "place", "truncated")


def edge_rejections(edges: DataFrame, seeds: DataFrame, snapshots: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(edge_id, reason): the first rule an edge breaks as a step of an expansion; null if it may be taken.

    Rules in order: its snapshot (``snapshots``: project_id, repository_revision), relation,
    status, target, an end among the seeds (``node_id``), and its id, derived anew.
    """
    scope = snapshots.select("project_id", "repository_revision").distinct().withColumn("ours", F.lit(True))
    ends = seeds.select("node_id").distinct()
    rows = edges.join(scope, ["project_id", "repository_revision"], "left")
    rows = rows.join(ends.select(F.col("node_id").alias("source_id"), F.lit(True).alias("from_seed")), "source_id", "left")
    rows = rows.join(ends.select(F.col("node_id").alias("target_id"), F.lit(True).alias("to_seed")), "target_id", "left")
    reason = (
        F.when(F.col("ours").isNull(), "scope_conflict")
        .when(~F.col("relation").isin(*relations), "relation_not_asked")
        .when(F.col("status") != "resolved", F.concat(F.lit("status_"), "status"))
        .when(F.col("target_id").isNull(), "no_target")
        .when(F.col("from_seed").isNull() & F.col("to_seed").isNull(), "touches_no_seed")
        .when(F.col("edge_id") != json_id("e:", F.col("source_id"), F.col("relation"), F.col("target_id"), F.col("line")), "edge_id_mismatch")
    )
    return rows.select("edge_id", reason.alias("reason"))


def node_resolutions(nodes: DataFrame, chunks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(node_id, resolution): what a node is in the stored chunks of the snapshots asked.

    scope_conflict, unsupported (no chunk behind it), not_found, ambiguous, stale (path or
    name differ), or unique.
    """
    scope = snapshots.select("project_id", "repository_revision").distinct().withColumn("ours", F.lit(True))
    found = chunks.groupBy("project_id", "repository_revision", F.col("id").alias("chunk_id")).agg(
        F.count("*").alias("n"), F.min("path").alias("c_path"), F.min("qualified_name").alias("c_name")
    )
    rows = nodes.join(scope, ["project_id", "repository_revision"], "left").join(found, ["project_id", "repository_revision", "chunk_id"], "left")
    resolution = (
        F.when(F.col("ours").isNull(), "scope_conflict").when(F.col("chunk_id").isNull(), "unsupported").when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous")
        .when((F.col("c_path") != F.col("path")) | (F.col("c_name") != F.col("qualified_name")), "stale").otherwise("unique")
    )
    return rows.select("node_id", resolution.alias("resolution"))


def graph_identities(edges: DataFrame) -> DataFrame:
    """(project_id, edges, identity): digest over the edges of a snapshot, by 256 lanes of their ids."""
    lanes = edges.groupBy("project_id", F.substring("edge_id", 3, 2).alias("lane")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "edge_id", "relation", "status"))), "\n"), 256).alias("h")
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lane", "h"))), lambda x: x["h"]), "")
    return lanes.groupBy("project_id").agg(F.sum("n").alias("edges"), F.sha2(whole, 256).alias("identity"))


def expand(edges: DataFrame, seeds: DataFrame, direction: str = "both", per_node: int = 20, most_nodes: int = 64, most_edges: int = 128, most_paths: int = 24) -> DataFrame:
    """The paths of one and two edges from each seed, under budgets.

    Columns: seed, place, depth, edge_1, edge_2, node, status.  Nodes are left in order of
    their id, edges in edge order; an edge is taken once a seed, one that leads back into its
    path makes none, one without a target ends its path.  Of a seed at most ``most_edges`` edges
    and ``most_nodes`` nodes (itself included) are taken and ``most_paths`` paths returned.
    An ambiguous edge makes the path ambiguous.
    """
    links = touching(edges, direction).select("current", "neighbour", "edge_id", "status", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(edge_order())]).alias("order"))
    start = seeds.select(F.col("node_id").alias("seed")).distinct()
    inside = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("order", "edge_id"))).where(F.col("n") <= per_node).drop("n")
    first = inside(start.join(links, F.col("current") == F.col("seed")), "seed", "current")
    taken = Window.partitionBy("seed", "edge_id").orderBy("order")
    first = first.withColumn("n", F.row_number().over(taken)).where("n = 1").withColumn("e", F.row_number().over(Window.partitionBy("seed").orderBy("order", "edge_id"))).where(F.col("e") <= most_edges)
    # nodes of the first level in the order they are met
    met = first.where("neighbour IS NOT NULL AND neighbour != seed").groupBy("seed", "neighbour").agg(F.min(F.struct("e", "edge_id", "status")).alias("by"))
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("by"))).where(F.col("k") < most_nodes)
    one = first.join(met.select("seed", "neighbour"), ["seed", "neighbour"], "left_semi").unionByName(first.where("neighbour IS NULL"))
    paths1 = one.select("seed", F.lit(1).alias("depth"), F.col("e").cast("long").alias("at"), F.col("edge_id").alias("edge_1"), F.lit(None).cast("string").alias("edge_2"), F.col("neighbour").alias("node"), "status")
    counts = first.groupBy("seed").agg(F.count("*").alias("had_edges")).join(met.groupBy("seed").agg(F.count("*").alias("had_nodes")), "seed", "left").fillna(0, ["had_nodes"])
    # second level: every first-level node is left in order of its id
    via = met.select("seed", F.col("neighbour").alias("via"), F.col("by.edge_id").alias("edge_1"), F.col("by.status").alias("status_1"))
    second = inside(via.join(links, F.col("current") == F.col("via")), "seed", "via")
    second = second.join(first.select("seed", "edge_id"), ["seed", "edge_id"], "left_anti")
    second = second.withColumn("n", F.row_number().over(Window.partitionBy("seed", "edge_id").orderBy("via", "order"))).where("n = 1").drop("n")
    second = second.withColumn("e", F.row_number().over(Window.partitionBy("seed").orderBy("via", "order", "edge_id"))).join(counts, "seed").where(F.col("e") + F.col("had_edges") <= most_edges)
    known = met.select("seed", "neighbour").unionByName(start.select("seed", F.col("seed").alias("neighbour")))
    fresh = second.where("neighbour IS NOT NULL").join(known, ["seed", "neighbour"], "left_anti").groupBy("seed", "neighbour", "had_nodes").agg(F.min("e").alias("by"))
    fresh = fresh.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("by"))).where(F.col("k") + F.col("had_nodes") < most_nodes)
    allowed = known.unionByName(fresh.select("seed", "neighbour"))
    two = second.where("neighbour != seed AND neighbour != via").join(allowed, ["seed", "neighbour"], "left_semi").unionByName(second.where("neighbour IS NULL"))
    status = F.when((F.col("status_1") == "ambiguous") | (F.col("status") == "ambiguous"), "ambiguous").otherwise(F.col("status"))
    paths2 = two.select("seed", F.lit(2).alias("depth"), F.col("e").cast("long").alias("at"), "edge_1", F.col("edge_id").alias("edge_2"), F.col("neighbour").alias("node"), status.alias("status"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "at")).cast("long")
    return paths1.unionByName(paths2).withColumn("place", place).where(F.col("place") <= most_paths).select("seed", "place", "depth", "edge_1", "edge_2", "node", "status")


CHAIN_NODES, CHAIN_EDGES = 64, 128


def chains(paths: DataFrame) -> DataFrame:
    """Paths as evidence chains: (chain_id, seed, nodes, edges, directions) of ``expand``'s paths with their edges' ends.

    ``paths``: seed, edges (array of edge_id), nodes (array, the seed first), directions (array).
    The id is a digest of seed, nodes and edges.
    """
    flat = lambda c: F.array_join(c, ",")
    return paths.select(json_id("c:", F.col("seed"), flat("nodes"), flat("edges")).alias("chain_id"), "seed", "nodes", "edges", "directions")


def path_chains(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The chains of ``expand``'s paths that end in a node."""
    ends = edges.select(F.col("edge_id"), "source_id", "target_id")
    rows = paths.where("node IS NOT NULL")
    first = ends.select(F.col("edge_id").alias("edge_1"), F.col("source_id").alias("s1"), F.col("target_id").alias("t1"))
    second = ends.select(F.col("edge_id").alias("edge_2"), F.col("source_id").alias("s2"))
    rows = rows.join(first, "edge_1").join(second, "edge_2", "left")
    mid = F.when(F.col("s1") == F.col("seed"), F.col("t1")).otherwise(F.col("s1"))
    way = lambda source, at: F.when(source == at, "outgoing").otherwise("incoming")
    two = F.col("depth") == 2
    return chains(
        rows.select(
            "seed", F.when(two, F.array("seed", mid, "node")).otherwise(F.array("seed", "node")).alias("nodes"), F.when(two, F.array("edge_1", "edge_2")).otherwise(F.array("edge_1")).alias("edges"),
            F.when(two, F.array(way(F.col("s1"), F.col("seed")), way(F.col("s2"), mid))).otherwise(F.array(way(F.col("s1"), F.col("seed")))).alias("directions"),
        )
    )


def chain_checks(stored: DataFrame, nodes: DataFrame, edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key, reason): the first rule a stored chain (``key`` and the columns of ``chains``) breaks; null if it holds.

    Rules in order: its id; limits; nodes there; edges there; edge ids; shape; every edge
    resolved or ambiguous; directions and ends; its chunk nodes in ``fresh`` (node_id) not stale.
    Steps are checked row by row and brought together; no chain is longer than the limits.
    """
    flat = lambda c: F.array_join(c, ",")
    rows = stored.withColumn("bad_id", ~F.col("chain_id").eqNullSafe(json_id("c:", F.col("seed"), flat("nodes"), flat("edges")))).withColumn("long", (F.size("nodes") > CHAIN_NODES) | (F.size("edges") > CHAIN_EDGES))
    each = rows.select("key", F.posexplode("nodes").alias("at", "node_id")).join(nodes.select("node_id", "kind").distinct(), "node_id", "left").join(fresh.select("node_id", F.lit(True).alias("fresh")).distinct(), "node_id", "left")
    on_nodes = each.groupBy("key").agg(F.bool_or(F.col("kind").isNull()).alias("lost_node"), F.bool_or((F.col("kind") == "chunk") & F.col("fresh").isNull()).alias("stale"))
    steps = rows.select("key", "nodes", "directions", F.posexplode("edges").alias("at", "edge_id")).join(edges.select("edge_id", "source_id", "target_id", "relation", "status", "line", F.lit(True).alias("there")), "edge_id", "left")
    a, b, way = F.try_element_at("nodes", F.col("at") + 1), F.try_element_at("nodes", F.col("at") + 2), F.try_element_at("directions", F.col("at") + 1)
    wrong = F.when(way == "outgoing", (F.col("source_id") != a) | (F.col("target_id") != b)).when(way == "incoming", (F.col("target_id") != a) | (F.col("source_id") != b)).otherwise(True)
    on_edges = steps.groupBy("key").agg(
        F.bool_or(F.col("there").isNull()).alias("lost_edge"), F.bool_or(F.col("edge_id") != json_id("e:", F.col("source_id"), F.col("relation"), F.col("target_id"), F.col("line"))).alias("bad_edge"),
        F.bool_or(~F.col("status").isin("resolved", "ambiguous")).alias("closed"), F.bool_or(F.coalesce(wrong, F.lit(True))).alias("wrong"),
    )
    got = rows.join(on_nodes, "key", "left").join(on_edges, "key", "left")
    shape = F.size("nodes") != F.size("edges") + 1
    names = [
        ("bad_id", "chain identity is invalid"), ("long", "chain exceeds validator limits"), ("lost_node", "relation node no longer exists"), ("lost_edge", "relation edge no longer exists"), ("bad_edge", "relation edge identity is invalid"),
        ("shape", "invalid chain shape"), ("closed", "chain contains a non-traversable edge"), ("wrong", "relation direction is invalid"), ("stale", "relation node content is stale"),
    ]
    got = got.withColumn("shape", shape)
    return got.select("key", F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit(False)), t) for c, t in names)).alias("reason"))


def relation_aware(ranked: DataFrame, related: DataFrame, by: str, k: int = 8) -> DataFrame:
    """(by, id, place): a ranked list with related candidates in some of its places.

    ``ranked``: by, id, place; ``related``: by, id, seed, family, priority.  Related rows get no
    place if k < 3, else min(3, max(1, floor(.3 k))): the best by priority, of those that
    are no result and whose seed is shown, one a seed and two a family; each follows its
    seed, and places left over go to further results.
    """
    slots = 0 if k < 3 else min(3, max(1, int(0.3 * k)))
    w = lambda *p: Window.partitionBy(by, *p)
    direct = ranked.where(F.col("place") <= k).select(by, "id", "place")
    base = direct.where(F.col("place") <= k - slots)
    seeds = base.select(by, F.col("id").alias("seed"), F.col("place").alias("anchor"))
    rows = related.join(seeds, [by, "seed"]).join(base.select(by, "id"), [by, "id"], "left_anti")
    # greedy by priority; as a place needs a seed and a family of its own, a few rounds decide
    best = [F.desc("priority"), F.col("anchor"), F.col("id")]
    chosen, left = None, rows
    for _ in range(slots):
        top = left.withColumn("n", F.row_number().over(w().orderBy(*best))).where("n = 1").drop("n")
        chosen = top if chosen is None else chosen.unionByName(top)
        full = chosen.groupBy(by, "family").count().where("count >= 2").drop("count")
        left = rows.join(chosen.select(by, "seed"), [by, "seed"], "left_anti").join(chosen.select(by, "id"), [by, "id"], "left_anti").join(full, [by, "family"], "left_anti")
    shown = base.select(by, "id", F.col("place").alias("a"), F.lit(0).alias("b"))
    if chosen is not None:
        shown = shown.unionByName(chosen.select(by, "id", F.col("anchor").alias("a"), F.lit(1).alias("b")))
        rest = direct.where(F.col("place") > k - slots).join(chosen.select(by, "id"), [by, "id"], "left_anti")
        shown = shown.unionByName(rest.select(by, "id", (F.col("place") + k).alias("a"), F.lit(0).alias("b")))
    return shown.withColumn("n", F.row_number().over(w().orderBy("a", "b")).cast("long")).where(F.col("n") <= k).select(by, "id", F.col("n").alias("place"))


def reached_chunks(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, chunk_id): the chunks that the paths of a seed lead to, each once."""
    return paths.join(nodes.where("chunk_id IS NOT NULL").select(F.col("node_id").alias("node"), "chunk_id"), "node").select("seed", "chunk_id").distinct()


def walk_diagnostics(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, project_id, kind, seeds, paths, second, mean_paths): what walks gave, by project, by kind of seed, and in all."""
    rows = paths.join(nodes.select(F.col("node_id").alias("seed"), "project_id", "kind"), "seed")
    sets = rows.groupingSets([[F.col("project_id")], [F.col("kind")], []], F.col("project_id"), F.col("kind")).agg(
        F.countDistinct("seed").alias("seeds"), F.count("*").alias("paths"), F.count_if(F.col("depth") == 2).alias("second"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 1, "project").when(F.col("g") == 2, "kind").otherwise("all")
    return sets.select(level.alias("level"), "project_id", "kind", "seeds", "paths", "second", F.round(F.col("paths") / F.col("seeds"), 6).alias("mean_paths"))
