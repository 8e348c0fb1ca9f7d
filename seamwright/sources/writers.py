"""Writing: partition overwrite, upsert, append of events, write-once reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.learning import KEY, unique_events


def replace_partitions(df: DataFrame, path: str, by: str = "project_id") -> None:
    """Writes a table partitioned by snapshot; only the snapshots in ``df`` are replaced."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_once(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a result that must not be written over."""
    df.write.mode("errorifexists").format(kind).save(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key, columns by name."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_stale(embeddings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Embeddings without those of the same chunk and identity that were made of other input."""
    identity = ["code_chunk_id", "model_name", "embedding_config_hash"]
    now = fresh.select(*identity, F.col("embedding_input_hash").alias("now")).distinct()
    old = embeddings.join(now, identity).where(F.col("embedding_input_hash") != F.col("now")).select("id")
    return embeddings.join(old, "id", "left_anti")


def appended_events(log: DataFrame, events: DataFrame) -> DataFrame:
    """New events for the log: none whose idempotency key it holds, orders after each target's last.

    Redeliveries within ``events`` count once; the order among them is event_order, event_id.
    """
    fresh = unique_events(events).join(log.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    last = log.groupBy(*KEY).agg(F.max("event_order").alias("last"))
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("event_order", "event_id"))
    numbered = fresh.withColumn("at", at)
    joined = numbered.alias("e").join(last.alias("l"), [F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}")) for k in KEY], "left")
    return joined.select(*[(F.coalesce("l.last", F.lit(0)) + F.col("e.at")).alias("event_order") if c == "event_order" else F.col(f"e.{c}") for c in fresh.columns])


def project_report(summaries: DataFrame, modules: DataFrame) -> DataFrame:
    """(project_id, report): a Markdown page per snapshot with its figures and modules by name."""
    head = F.concat_ws("\n", F.concat(F.lit("# "), "project_id"), F.concat(F.lit("files: "), F.col("files")), F.concat(F.lit("language: "), "primary_language"))
    row = F.concat(F.lit("- "), "module", F.lit(" ("), F.col("files"), F.lit(")"))
    listed = modules.select("project_id", F.struct("module", row.alias("line")).alias("m")).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n").alias("body"))
    return summaries.join(listed, "project_id", "left").select("project_id", F.concat_ws("\n\n", head, "body").alias("report"))


def replace_relation_index(nodes: DataFrame, edges: DataFrame, directory: str) -> None:
    """Writes nodes and edges of whole snapshots; refuses repeated ids and several revisions of one project.

    Only the snapshots in the tables are replaced.
    """
    for table, key in ((nodes, "node_id"), (edges, "edge_id")):
        if not table.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} is not unique")
        if not table.groupBy("project_id").agg(F.countDistinct("repository_revision").alias("n")).where("n > 1").isEmpty():
            raise ValueError("an index holds one revision of a project")
    replace_partitions(nodes, f"{directory}/relation_nodes.parquet")
    replace_partitions(edges, f"{directory}/relation_edges.parquet")


def without_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """The tables without a project: ``id`` of projects, ``project_id`` of all others that have one."""
    own = {n: "id" if n == "projects" else "project_id" for n in tables}
    return {n: df.where(~F.col(own[n]).eqNullSafe(project)) if own[n] in df.columns else df for n, df in tables.items()}


def with_runs(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Update runs with those asked for: one per (project_id, revision, config), which may be there already.

    A new run is ``queued``, or ``unchanged`` if the revision is the one the project has
    (``current``); repeated requests and those known change nothing.
    """
    key = ["project_id", "revision", "config"]
    new = asked.groupBy(*key).agg(F.min("current").alias("current")).join(runs.select(*key), key, "left_anti")
    return runs.unionByName(new.select(*key, F.when(F.col("current") == F.col("revision"), "unchanged").otherwise("queued").alias("status")))


def activated(revisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Workspace revisions (workspace_id, version, snapshot, state) after requests (workspace_id, expected, snapshot).

    A request counts only if the active version is the one it expects; of several the
    smallest snapshot wins.  The active row becomes superseded and a row of the next version
    is added; the first version of a workspace is asked for with 0.
    """
    now = revisions.where("state = 'active'").groupBy("workspace_id").agg(F.max("version").alias("at"))
    ok = requests.join(now, "workspace_id", "left").where(F.col("expected") == F.coalesce("at", F.lit(0))).groupBy("workspace_id").agg(F.min("snapshot").alias("snapshot"), F.max("expected").alias("expected"))
    moved = revisions.join(ok.select("workspace_id", F.lit(True).alias("moves")), "workspace_id", "left")
    kept = moved.select("workspace_id", "version", moved["snapshot"], F.when(F.col("moves") & (F.col("state") == "active"), "superseded").otherwise(F.col("state")).alias("state"))
    return kept.unionByName(ok.select("workspace_id", (F.col("expected") + 1).alias("version"), "snapshot", F.lit("active").alias("state")))


def write_artifacts(results: dict[str, DataFrame], directory: str) -> DataFrame:
    """Writes results as JSON lines and CSV, each once, and gives their inventory: (name, kind, rows, digest).

    The digest is taken over the digests of the rows, in their order by value, so that it
    tells equal results whatever files they are in.
    """
    rows = None
    for name, df in sorted(results.items()):
        write_once(df, f"{directory}/{name}.json")
        df.write.mode("errorifexists").option("header", "true").csv(f"{directory}/{name}.csv")
        one = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
        lanes = one.groupBy(F.substring("h", 1, 2).alias("lane")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
        whole = lanes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lane", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
        part = whole.select(F.lit(name).alias("name"), F.explode(F.array(F.lit("json"), F.lit("csv"))).alias("kind"), "rows", "digest")
        rows = part if rows is None else rows.unionByName(part)
    return rows
