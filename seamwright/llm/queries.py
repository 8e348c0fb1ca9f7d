"""Queries of the training-data problems: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, docpairs, handwritten, leakage, mixing, parsecheck, pii, splitting, vectors

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = docpairs.code_doc_pairs(table(spark, d, "repo_files"), with_code=False)
    return pairs.where("doc_source = 'own'").select("file_id", "qualified_name", "name_line")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.code_doc_pairs(table(spark, d, "repo_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.whole_definitions(table(spark, d, "repo_files"), table(spark, d, "split_limits"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "repo_files"), table(spark, d, "split_limits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "repo_files")).select("file_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "repo_files")).groupBy("reason", "sign").agg(F.count("*").alias("files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.unparsable(table(spark, d, "repo_files")).select(F.col("id").alias("file_id"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.parse_rates(table(spark, d, "repo_files"), table(spark, d, "projects"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(table(spark, d, "repo_files")).select("file_id", "line_no")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_files(table(spark, d, "repo_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "code_chunk_embeddings"), k=5, min_similarity=0.8)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_questions")).select("item_id", "doc_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_questions"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(table(spark, d, "documents"), targets, keep_unused=True), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.personal_data(table(spark, d, "documents"), table(spark, d, "contributor_names"))
    return found.select("doc_id", "kind", "start_char")


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(table(spark, d, "documents"), table(spark, d, "contributor_names"), with_text=True)


QUERIES = {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}

#: none of these can be said in SQL at whole tables: they parse, merge, decode or walk graphs
SQL: dict[str, str] = {}
