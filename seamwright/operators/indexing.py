"""Index maintenance and the combined search: encoders, incremental chunks, evidence, expansion."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens_of
from . import retrieval
from .maintenance import embedding_inputs
from .structure import _per_file, _tree, definition_edges, python_chunks


def hashed_vector(text: str, dimension: int) -> np.ndarray:
    """A unit vector that depends on nothing but the text: signed bytes of a chain of digests."""
    out, block, n = bytearray(), text.encode("utf-8", "surrogatepass"), 0
    while len(out) < dimension:
        out += sha256(block + n.to_bytes(4, "big")).digest()
        n += 1
    v = np.frombuffer(bytes(out[:dimension]), np.uint8).astype(np.float64) - 127.5
    return (v / np.linalg.norm(v)).astype(np.float32)


def bag_vector(tokens: list[str], dimension: int) -> np.ndarray:
    """A unit vector of token counts, each token on a signed place by its hash; zero for no tokens."""
    v = np.zeros(dimension)
    for t in tokens:
        h = int.from_bytes(sha256(t.encode("utf-8", "surrogatepass")).digest()[:8], "big")
        v[h % dimension] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def encoded(rows: DataFrame, key: str, text: Column, dimension: int = 128, encode: Callable[[list[str], int], np.ndarray] = bag_vector) -> DataFrame:
    """(key, vector): the tokens of texts encoded batch by batch; a row the encoder fails on is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    vectors.append(encode(code_tokens_of(t or ""), dimension).tolist())
                    keys.append(k)
                except (ValueError, TypeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "vector"])

    return rows.select(F.col(key).cast("long"), text.alias("_text")).mapInArrow(run, f"{key} long, vector array<float>")


def embed_missing(chunks: DataFrame, embeddings: DataFrame, model: str, dimension: int = 128) -> DataFrame:
    """(code_chunk_id, content_hash, embedding_input_hash, model_name, vector) for chunks without a fresh one."""
    have = embeddings.where(F.col("model_name") == model).select(F.col("code_chunk_id").alias("id"), "content_hash")
    todo = chunks.join(have, ["id", "content_hash"], "left_anti")
    vectors = encoded(todo, "id", retrieval.chunk_text(), dimension)
    return todo.join(embedding_inputs(todo), "id").join(vectors, "id").select(
        F.col("id").alias("code_chunk_id"), "content_hash", F.col("input_hash").alias("embedding_input_hash"), F.lit(model).alias("model_name"), "vector"
    )


def search(chunks: DataFrame, questions: DataFrame, key: str, text: str, k: int = 8, pool: int = 24) -> DataFrame:
    """(key, id, places per source, score, place): the combined search.

    The intent of each question gives the weights of three lists of ``pool`` chunks: dense
    (encoded texts), lexical (BM25) and symbols named in the question; the lists are fused by
    weighted reciprocal ranks.
    """
    asked = questions.select(F.col(key).cast("long").alias(key), F.col(text).alias("q")).where("q IS NOT NULL")
    weights = retrieval.query_intents(asked, key, "q").select(key, "dense_weight", "lexical_weight", "symbol_weight")
    lexical = retrieval.bm25(chunks, "id", retrieval.chunk_text(), asked, key, F.col("q"), ["path", "start_line", "end_line", "id"], pool)
    vectors = encoded(chunks, "id", retrieval.chunk_text())
    asked_vectors = encoded(asked, key, F.col("q"))
    dense = retrieval.dense(vectors, "id", "vector", asked_vectors, key, "vector", pool)
    named = retrieval.symbol_hints(asked, key, "q")
    hints = named.select(F.xxhash64(key, "hint").alias("hint_id"), F.col("hint").alias("value"), F.lit(None).cast("string").alias("path"))
    owner = named.select(F.xxhash64(key, "hint").alias("hint_id"), key)
    symbol = retrieval.symbol_matches(chunks, hints, pool).join(owner, "hint_id").groupBy(key, "id").agg(F.min(F.struct("tier", "place")).alias("b"))
    symbol = retrieval.top_k(symbol, [key], [F.col("b"), F.col("id")], pool)
    fused = retrieval.fuse({"dense": (dense, 1.0), "lexical": (lexical, 1.0), "symbol": (symbol, 1.0)}, key, "id", 3 * pool).drop("score", "place").join(weights, key)
    total = F.lit(0.0)
    for s in ("dense", "lexical", "symbol"):
        total = total + F.coalesce(F.col(f"{s}_weight") / (F.lit(float(retrieval.RRF_K)) + F.col(f"{s}_place")), F.lit(0.0))
    scored = fused.withColumn("score", F.round(total, 9))
    order = [F.desc("score"), F.col("best_place"), F.desc("sources"), F.col("id")]
    return retrieval.top_k(scored, [key], order, k).select(key, "id", "dense_place", "lexical_place", "symbol_place", "score", "place")


# ---------------------------------------------------------------------------- chunks over revisions
def incremental_chunks(old_chunks: DataFrame, diff: DataFrame, new_files: DataFrame) -> DataFrame:
    """Chunks of the newer snapshot: those of unchanged and renamed paths are taken over, the rest made anew.

    ``old_chunks``: path, chunk_type, symbol_name, qualified_name, parent_symbol, start_line,
    end_line, content, content_hash of the older snapshot; ``diff`` as of ``manifest_diff``.
    Equal to chunking the newer snapshot from scratch.
    """
    columns = ["path", "chunk_type", "symbol_name", "qualified_name", "parent_symbol", "start_line", "end_line", "content", "content_hash"]
    kept = diff.where("change IN ('unchanged', 'renamed')").select(F.coalesce("old_path", "path").alias("path"), F.col("path").alias("now"))
    reused = old_chunks.select(*columns).join(kept, "path").drop("path").withColumnRenamed("now", "path").select(*columns)
    todo = diff.where("change IN ('added', 'modified')").select("path")
    from ..functions.paths import compared_path

    fresh = new_files.withColumn("path", compared_path(F.col("path"))).join(todo, "path", "left_semi")
    return reused.withColumn("origin", F.lit("reused")).unionByName(python_chunks(fresh).select(*columns).withColumn("origin", F.lit("made")))


def _blanked(tree: ast.AST) -> str:
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            n.name = "_"
    return ast.dump(tree, include_attributes=False)


def structure_rows(text: str) -> list[tuple]:
    tree = _tree(text)
    return [] if tree is None else [(sha256(_blanked(tree).encode("utf-8", "surrogatepass")).hexdigest(),)]


def structure_hashes(files: DataFrame) -> DataFrame:
    """(file_id, path, structure_hash): equal for files that differ in layout, comments and definition names only."""
    return _per_file(files, structure_rows, "file_id long, path string, structure_hash string")


# ---------------------------------------------------------------------------- results
def evidence_rows(ranked: DataFrame, chunks: DataFrame, by: str, excerpt: int = 2000) -> DataFrame:
    """(by, evidence_id, id, token, excerpt_hash): results as numbered evidence with a citation token."""
    rows = ranked.join(chunks.select("id", "path", "start_line", "end_line", "content"), "id")
    token = F.concat(F.lit("[E"), F.col("place"), F.lit("] "), "path", F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"))
    return rows.select(by, F.concat(F.lit("E"), F.col("place")).alias("evidence_id"), "id", token.alias("token"), F.sha2(F.substring("content", 1, excerpt), 256).alias("excerpt_hash"))


def best_snippets(ranked: DataFrame, documents: DataFrame, questions: DataFrame, by: str, key: str, text: str, most: int = 1200) -> DataFrame:
    """(by, key, line, hits, snippet): the lines around the line with most of a question's words.

    Two lines before to five after, at most ``most`` characters; ties by line.  ``questions``:
    (by, words); texts meet only the questions they rank for.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, k, t, words in pdf.itertuples(index=False):
                lines = t.replace("\r\n", "\n").split("\n")
                hits = [sum(w in x for w in words) for x in (y.lower() for y in lines)]
                at = max(range(len(lines)), key=lambda i: (hits[i], -i))
                out.append((q, k, at + 1, hits[at], "\n".join(lines[max(0, at - 2) : at + 6])[:most]))
            yield pd.DataFrame(out, columns=[by, key, "line", "hits", "snippet"])

    texts = documents.select(key, F.col(text).alias("_t")).where("_t IS NOT NULL")
    words = questions.select(by, F.coalesce("words", F.array().cast("array<string>")).alias("_words"))
    rows = ranked.select(by, key).join(words, by).join(texts, key).select(by, key, "_t", "_words")
    return rows.mapInPandas(run, f"{by} long, {key} long, line long, hits long, snippet string")


# How much a relation counts.
RELATION_WEIGHTS = {"calls": 1.0, "imports": 0.9, "references": 0.8, "defines": 0.7}


def one_hop(ranked: DataFrame, chunks: DataFrame, by: str, seeds: int = 12, per_seed: int = 8, targets: int = 24) -> DataFrame:
    """(by, target, priority, paths, place): chunks one definition edge away from the first results.

    The first ``seeds`` results, ``per_seed`` edges each in either direction by target;
    priority is the weight over 1 + place, of a target the largest; those ranked already are
    left out.  All caps are windows.
    """
    edges = definition_edges(chunks)
    both = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("target LIKE 'chunk:%'")
    start = ranked.where(F.col("place") <= seeds).select(by, "place", F.concat(F.lit("chunk:"), F.col("id")).alias("source"))
    near = start.join(both, "source")
    inside = F.row_number().over(Window.partitionBy(by, "source").orderBy("target"))
    near = near.withColumn("at", inside).where(F.col("at") <= per_seed)
    near = near.join(start.select(by, F.col("source").alias("target")), [by, "target"], "left_anti")
    best = near.groupBy(by, "target").agg(F.round(F.max(F.lit(RELATION_WEIGHTS["defines"]) / (1 + F.col("place"))), 9).alias("priority"), F.count("*").alias("paths"))
    return retrieval.top_k(best, [by], [F.desc("priority"), F.col("target")], targets)


def one_hop_relations(ranked: DataFrame, links: DataFrame, by: str, seeds: int = 12, per_seed: int = 8, targets: int = 24) -> DataFrame:
    """(by, target, priority, paths, place): as ``one_hop``, over calls, imports, references and definitions by their weights.

    ``links`` as of ``structure.relation_links``; the ``per_seed`` edges of a result, in
    either direction, are the first by their place.
    """
    weight = F.lit(0.0)
    for relation, w in RELATION_WEIGHTS.items():
        weight = F.when(F.col("relation") == relation, w).otherwise(weight)
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", F.col("place").alias("edge"))
    both = links.withColumnRenamed("place", "edge").unionByName(back).where("target LIKE 'chunk:%'").withColumn("weight", weight)
    start = ranked.where(F.col("place") <= seeds).select(by, "place", F.concat(F.lit("chunk:"), F.col("id")).alias("source"))
    inside = F.row_number().over(Window.partitionBy(by, "source").orderBy("edge", "target"))
    near = start.join(both, "source").withColumn("at", inside).where(F.col("at") <= per_seed)
    near = near.join(start.select(by, F.col("source").alias("target")), [by, "target"], "left_anti")
    best = near.groupBy(by, "target").agg(F.round(F.max(F.col("weight") / (1 + F.col("place"))), 9).alias("priority"), F.count("*").alias("paths"))
    return retrieval.top_k(best, [by], [F.desc("priority"), F.col("target")], targets)


def failure_labels(ranked: DataFrame, gold: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """(by, label) of each query with gold: found_first, found_later, path_only, missed or no_results."""
    want = gold.join(chunks.select("id", "path"), "id").select(by, F.col("id").alias("gold_id"), F.col("path").alias("gold_path"))
    got = ranked.join(chunks.select("id", "path"), "id")
    hits = got.join(want, by).groupBy(by).agg(
        F.min(F.when(F.col("id") == F.col("gold_id"), F.col("place"))).alias("first"), F.bool_or(F.col("path") == F.col("gold_path")).alias("near")
    )
    label = F.when(F.col("first") == 1, "found_first").when(F.col("first").isNotNull(), "found_later").when(F.col("near"), "path_only").when(F.col("near").isNotNull(), "missed").otherwise("no_results")
    return want.select(by).distinct().join(hits, by, "left").select(by, label.alias("label"))
