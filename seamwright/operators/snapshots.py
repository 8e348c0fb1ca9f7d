"""What changed between consecutive full snapshots of a table.

Snapshots are key-sorted and cut into content-defined chunks: a key whose hash is a multiple
of ``chunk_rows`` begins a chunk, so that an insertion or removal moves no other boundary.
Chunks of two consecutive snapshots with equal digests hold equal rows and are discarded;
only the rows of unmatched chunks are joined by key and classified.

Every snapshot is cut once, whatever the number of pairs it is in: its rows of key and digest
are shuffled by (snapshot, lane), a lane being a fixed share of the keys by hash, so that one
huge snapshot is spread over ``lanes`` tasks.  The chunks are written as a table; of it only
the chunk digests are compared between snapshots, and rows are read again of unmatched chunks
alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import compared_path
from ..session import written


def consecutive_pairs(deliveries: DataFrame, entity: str, snapshot: str, at: str) -> DataFrame:
    """(old_id, new_id) of consecutive snapshots of each entity by time, ties by id.

    Rows of a null id or entity are left out, a repeated id counts once, at its earliest time.
    """
    rows = (
        deliveries.select(F.col(entity).alias("entity"), F.col(snapshot).alias("new_id"), F.col(at).alias("at"))
        .where(F.col("entity").isNotNull() & F.col("new_id").isNotNull())
        .groupBy("entity", "new_id")
        .agg(F.min("at").alias("at"))
    )
    order = Window.partitionBy("entity").orderBy(F.col("at").asc_nulls_first(), "new_id")
    return rows.withColumn("old_id", F.lag("new_id").over(order)).where("old_id IS NOT NULL").select("old_id", "new_id")


def snapshot_changes(
    rows: DataFrame, pairs: DataFrame, snapshot: str, key: str, digest: str, version: str, chunk_rows: int = 16, lanes: int = 128
) -> DataFrame:
    """(new_id, key, change_type) of the keys added, removed or changed in each pair.

    ``rows`` holds one digest per snapshot and key.  Of a key delivered several times in a
    snapshot the row of the largest ``version`` counts, one with a digest before one
    without.  A null digest means that the content is unknown: such a key is there, so that
    it can be added or removed, but it is never changed.  Null keys and snapshots are left out.
    """
    base = rows.select(
        F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.col(digest).alias("digest"), F.col(version).alias("version")
    ).where(F.col("snapshot").isNotNull() & F.col("key").isNotNull())
    roles = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("old_id").alias("snapshot"), F.lit(False).alias("newer")),
                F.struct(F.col("new_id").alias("snapshot"), F.lit(True).alias("newer")),
            )
        ).alias("r"),
        F.col("new_id").alias("pair"),
    ).select("r.*", "pair")
    lane = F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int")
    known = F.when(F.col("digest").isNotNull(), F.col("version"))
    laned = base.join(roles.select("snapshot").distinct(), "snapshot", "left_semi").withColumn("lane", lane).repartition("snapshot", "lane")
    single = laned.groupBy("snapshot", "lane", "key").agg(F.max_by("digest", known).alias("digest"))

    # content-defined chunks: a running count of boundary keys over the key-sorted lane
    by_key = Window.partitionBy("snapshot", "lane").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boundary = F.pmod(F.xxhash64(F.lit("chunk"), F.col("key")), F.lit(chunk_rows)) == 0
    chunked = single.withColumn("chunk", F.sum(boundary.cast("int")).over(by_key))
    chunks = chunked.groupBy("snapshot", "lane", "chunk").agg(F.array_sort(F.collect_list(F.struct("key", "digest"))).alias("members"))
    table = written(chunks.withColumn("sign", F.sha2(F.to_json("members", {"ignoreNullFields": "false"}), 256)))

    # equal digests of the two sides of a pair are discarded; only they are moved here
    same = Window.partitionBy("pair", "lane", "sign")
    signs = table.select("snapshot", "lane", "chunk", "sign").join(roles, "snapshot")
    unmatched = signs.withColumn("sides", F.count("*").over(same)).where("sides = 1").select("snapshot", "lane", "chunk", "pair", "newer")
    left = table.join(unmatched, ["snapshot", "lane", "chunk"]).select("pair", "lane", "newer", F.explode("members").alias("m")).select("pair", "lane", "newer", "m.*")
    sides = left.groupBy("pair", "lane", "key").agg(
        F.bool_or(~F.col("newer")).alias("was"),
        F.bool_or("newer").alias("now"),
        F.max(F.when(~F.col("newer"), F.col("digest"))).alias("before"),
        F.max(F.when(F.col("newer"), F.col("digest"))).alias("after"),
    )
    change = (
        F.when(~F.col("was"), "added")
        .when(~F.col("now"), "removed")
        .when(F.col("before") != F.col("after"), "changed")
    )
    return sides.select(F.col("pair").alias("new_id"), "key", change.alias("change_type")).where("change_type IS NOT NULL")


def repository_changes(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, path, change_type) between consecutive deliveries of each repository.

    Deliveries are the rows of projects that are not failed (a null status counts as
    delivered); a repository is owner/repo regardless of case.
    """
    delivered = projects.where(F.coalesce(F.col("status"), F.lit("")) != "failed").select(
        F.lower(F.concat_ws("/", "owner", "repo")).alias("repository"), "id", "created_at"
    )
    pairs = consecutive_pairs(delivered, "repository", "id", "created_at")
    rows = files.select("project_id", compared_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("digest"), "id")
    return snapshot_changes(rows, pairs, "project_id", "path", "digest", "id").select(
        F.col("new_id").alias("project_id"), F.col("key").alias("path"), "change_type"
    )
