"""Ranked retrieval queries.  Of a searched table every row takes part; the queries are the
rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens_sql
from ..operators import catalog, retrieval as r
from .catalog_queries import P, PROFILES


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def token_stats(spark, d):
    counts = r.term_counts(_t(spark, d, "code_chunks"), "id", r.chunk_text())
    return counts.where("term != ''").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _questions(spark, d):
    return _t(spark, d, "eval_questions").where("item_id % 50 = 0")


def bm25_topk(spark, d):
    return r.bm25(_t(spark, d, "code_chunks"), "id", r.chunk_text(), _questions(spark, d), "item_id", F.col("question"), ["path", "start_line", "end_line", "id"], 20)


def bm25_documents(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    return r.bm25(docs, "doc_id", F.col("text"), _questions(spark, d), "item_id", F.col("question"), ["doc_id"], 20)


def dense_topk(spark, d):
    v = _t(spark, d, "embeddings")
    return r.dense(v, "vec_id", "embedding", v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "embedding", 5)


def _hints(spark, d):
    chunks = _t(spark, d, "code_chunks").where("id % 50 = 0")
    return chunks.select(F.col("id").alias("hint_id"), F.col("qualified_name").alias("value"), F.when(F.col("id") % 100 == 0, F.col("path")).alias("path"))


def symbol_match_tiers(spark, d):
    return r.symbol_matches(_t(spark, d, "code_chunks"), _hints(spark, d), 20)


def symbol_match_fuzzy(spark, d):
    """Parts of names as hints: the first two words of some symbols, the last word of the others."""
    chunks = _t(spark, d, "code_chunks").where("id % 50 = 0")
    words = F.split("symbol_name", "_")
    part = F.when((F.col("id") % 100 == 0) & (F.size(words) > 1), F.concat_ws("_", F.element_at(words, 1), F.try_element_at(words, F.lit(2)))).otherwise(F.element_at(words, -1))
    return r.symbol_matches(_t(spark, d, "code_chunks"), chunks.select(F.col("id").alias("hint_id"), part.alias("value"), F.when(F.col("id") % 150 == 0, F.col("path")).alias("path")), 20, "fuzzy")


def symbol_candidates(spark, d):
    """Ten chunk hints a query, of which eight count."""
    hints = _hints(spark, d).withColumn("query_id", F.floor(F.col("hint_id") / 500))
    return r.symbol_candidates(_t(spark, d, "code_chunks"), hints, "query_id")


def _two_lists(spark, d):
    chunks = _t(spark, d, "code_chunks")
    asked = chunks.where("id % 50 = 0").select(F.col("id").alias("hint_id"), F.col("qualified_name").alias("value"))
    lexical = r.bm25(chunks, "id", r.chunk_text(), asked, "hint_id", F.col("value"), ["path", "start_line", "end_line", "id"], 20)
    symbol = r.symbol_matches(chunks, _hints(spark, d), 20)
    return lexical, symbol


def rrf_two_lists(spark, d):
    lexical, symbol = _two_lists(spark, d)
    return r.fuse({"lexical": (lexical, 1.0), "symbol": (symbol, 1.0)}, "hint_id", "id", 8).select("hint_id", "id", "lexical_place", "symbol_place", "score", "place")


def rrf_three_lists(spark, d):
    """The third list ranks the chunks of the hint's own file by their distance to it."""
    chunks = _t(spark, d, "code_chunks")
    lexical, symbol = _two_lists(spark, d)
    own = chunks.where("id % 50 = 0").select(F.col("id").alias("hint_id"), "project_id", "path", F.col("start_line").alias("at"))
    near = chunks.select("id", "project_id", "path", "start_line").join(own, ["project_id", "path"]).select("hint_id", "id", F.abs(F.col("start_line") - F.col("at")).alias("far"))
    dense = r.top_k(near, ["hint_id"], [F.col("far"), F.col("id")], 20)
    route = r.ROUTES["locate"]
    fused = r.fuse({"dense": (dense, route[0]), "lexical": (lexical, route[1]), "symbol": (symbol, route[2])}, "hint_id", "id", 8)
    return fused.select("hint_id", "id", "dense_place", "lexical_place", "symbol_place", "score", "best_place", "sources", "place")


def query_intents(spark, d):
    return r.query_intents(_t(spark, d, "eval_questions"), "item_id", "question")


def symbol_hints(spark, d):
    return r.symbol_hints(_t(spark, d, "documents"), "doc_id", "text")


def asked_words(question):
    """The distinct words of a question, of two characters or more, in lower case."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"([A-Za-z0-9_\-/.]+)"), F.lit(1)), F.lower), lambda w: F.char_length(w) > 1))


def file_intents(spark, d):
    return r.file_intents(_t(spark, d, "eval_questions"), "item_id", "question")


def file_ranking(spark, d):
    files = _t(spark, d, "repo_files")
    asked = _questions(spark, d).select("item_id", asked_words("question").alias("ws"))
    intents = file_intents(spark, d).groupBy("item_id").agg(F.collect_list("intent").alias("intents"))
    rows = asked.join(intents, "item_id", "left").orderBy("item_id")
    return r.rank_files(catalog.file_profiles(files), files, ((x["item_id"], list(x["ws"]), list(x["intents"] or ())) for x in rows.toLocalIterator()), 6)


QUERIES = {
    f.__name__: f
    for f in (token_stats, bm25_topk, bm25_documents, dense_topk, symbol_match_tiers, symbol_match_fuzzy, symbol_candidates, rrf_two_lists, rrf_three_lists, query_intents, symbol_hints, file_intents, file_ranking)
}

_LINES = r"string_split(regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g'), chr(10))"
SIGNATURE = f"array_to_string(list_slice({_LINES}, 1, least(20, coalesce(list_position(list_transform(list_slice({_LINES}, 1, 20), lambda x: rtrim(x, ' ') LIKE '%:'), true), 20))), chr(10))"
CHUNK_TEXT = f"concat_ws(chr(10), coalesce(path, ''), coalesce(list_extract(string_split(path, '/'), -1), ''), coalesce(symbol_name, ''), coalesce(qualified_name, ''), {SIGNATURE}, coalesce(content, ''))"


def _bm25_sql(prefix: str, source: str, key: str, text: str, queries: str, ties: str, k: int) -> str:
    return f"""
{prefix}tok AS (SELECT {key} AS k, {tokens_sql(text)} AS t FROM {source}),
{prefix}st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS m FROM {prefix}tok),
{prefix}tf AS (SELECT k, l, term, count(*) AS tf FROM (SELECT k, len(t) AS l, unnest(t) AS term FROM {prefix}tok) GROUP BY ALL),
{prefix}df AS (SELECT term, count(*) AS df FROM {prefix}tf GROUP BY 1),
{prefix}qt AS (SELECT q, term, count(*) AS qf FROM (SELECT q, unnest({tokens_sql("qtext")}) AS term FROM ({queries})) GROUP BY ALL),
{prefix}sc AS (SELECT q, k, round(sum(qf * (ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m)))), 6) AS score
  FROM {prefix}tf JOIN {prefix}df USING (term) JOIN {prefix}qt USING (term), {prefix}st GROUP BY 1, 2),
{prefix}rk AS (SELECT * FROM (SELECT q, k, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, {ties}) AS place
  FROM {prefix}sc JOIN {source} c ON c.{key} = k WHERE score > 0) WHERE place <= {k})"""


HINTS_SQL = "SELECT id AS hint_id, lower(qualified_name) AS needle, list_extract(string_split(lower(qualified_name), '.'), -1) AS leaf, CASE WHEN id % 100 = 0 THEN path END AS h_path FROM code_chunks WHERE id % 50 = 0"
SYMBOL_SQL = f"""
h AS ({HINTS_SQL}),
c AS (SELECT id, path, lower(coalesce(symbol_name, '')) AS symbol, lower(coalesce(qualified_name, '')) AS qualified, start_line, end_line FROM code_chunks),
mt AS (SELECT hint_id, id, path, qualified, start_line, end_line, CASE WHEN needle = qualified THEN 0 WHEN needle = symbol AND h_path IS NOT NULL THEN 1
    WHEN needle = symbol OR leaf = symbol THEN 2
    WHEN regexp_replace(needle, '[^a-z0-9]', '', 'g') <> '' AND regexp_replace(needle, '[^a-z0-9]', '', 'g') IN (regexp_replace(qualified, '[^a-z0-9]', '', 'g'), regexp_replace(symbol, '[^a-z0-9]', '', 'g')) THEN 3 END AS tier
  FROM h, c WHERE h_path IS NULL OR lower(ltrim(replace(c.path, '\\', '/'), '/')) = lower(ltrim(replace(h_path, '\\', '/'), '/'))),
sy AS (SELECT * FROM (SELECT hint_id, id, tier, CASE tier WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.75 END AS score,
    CASE tier WHEN 0 THEN 'exact_qualified' WHEN 1 THEN 'exact_symbol_context' WHEN 2 THEN 'exact_leaf' ELSE 'normalized_identifier' END AS match_type,
    row_number() OVER (PARTITION BY hint_id ORDER BY tier, qualified, path, start_line, end_line, id) AS place FROM mt WHERE tier IS NOT NULL) WHERE place <= 20)""".replace("'\\\\'", "'\\'")
TWO_SQL = _bm25_sql("x", "code_chunks", "id", CHUNK_TEXT, "SELECT id AS q, qualified_name AS qtext FROM code_chunks WHERE id % 50 = 0", "c.path, c.start_line, c.end_line, c.id", 20) + "," + SYMBOL_SQL
WORDS = r"list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Za-z0-9_\-/.]+'), lambda w: lower(w)), lambda w: length(w) > 1))"

_FUZZY = """
h AS (SELECT id AS hint_id, lower(CASE WHEN id % 100 = 0 AND len(string_split(symbol_name, '_')) > 1 THEN string_split(symbol_name, '_')[1] || '_' || string_split(symbol_name, '_')[2] ELSE string_split(symbol_name, '_')[-1] END) AS needle,
  CASE WHEN id % 150 = 0 THEN path END AS h_path FROM code_chunks WHERE id % 50 = 0), hn AS (SELECT *, string_split(needle, '.')[-1] AS leaf, regexp_replace(needle, '[^a-z0-9]', '', 'g') AS plain FROM h WHERE needle <> ''),
c AS (SELECT id, path, lower(coalesce(symbol_name, '')) AS symbol, lower(coalesce(qualified_name, '')) AS qualified, start_line, end_line FROM code_chunks),
mt AS (SELECT hint_id, id, path, qualified, start_line, end_line, CASE WHEN needle = qualified THEN 0 WHEN needle = symbol AND h_path IS NOT NULL THEN 1 WHEN needle = symbol OR leaf = symbol THEN 2
    WHEN plain <> '' AND plain IN (regexp_replace(qualified, '[^a-z0-9]', '', 'g'), regexp_replace(symbol, '[^a-z0-9]', '', 'g')) THEN 3 WHEN starts_with(qualified, needle) OR starts_with(symbol, needle) THEN 4 WHEN contains(qualified, needle) OR contains(symbol, needle) THEN 5 END AS tier
  FROM hn, c WHERE h_path IS NULL OR c.path = h_path)"""

SQL = {
    "symbol_match_fuzzy": f"""
WITH {_FUZZY} SELECT * FROM (SELECT hint_id, id, tier::BIGINT AS tier, ([1.0::DOUBLE, 0.95, 0.85, 0.75, 0.55, 0.35])[tier + 1] AS score, (['exact_qualified', 'exact_symbol_context', 'exact_leaf', 'normalized_identifier', 'lexical_prefix', 'lexical_contains'])[tier + 1] AS match_type,
  row_number() OVER (PARTITION BY hint_id ORDER BY tier, qualified, path, start_line, end_line, id) AS place FROM mt WHERE tier IS NOT NULL) WHERE place <= 20
""",
    "token_stats": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens_sql(CHUNK_TEXT)}) AS term FROM code_chunks) GROUP BY ALL) GROUP BY 1",
    "bm25_topk": "WITH " + _bm25_sql("x", "code_chunks", "id", CHUNK_TEXT, "SELECT item_id AS q, question AS qtext FROM eval_questions WHERE item_id % 50 = 0", "c.path, c.start_line, c.end_line, c.id", 20) + " SELECT q AS item_id, k AS id, score, place FROM xrk",
    "bm25_documents": "WITH docs AS (SELECT * FROM documents WHERE text IS NOT NULL), " + _bm25_sql("x", "docs", "doc_id", "text", "SELECT item_id AS q, question AS qtext FROM eval_questions WHERE item_id % 50 = 0", "k", 20) + " SELECT q AS item_id, k AS doc_id, score, place FROM xrk",
    "dense_topk": """
SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS place
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE place <= 5
""",
    "symbol_match_tiers": f"WITH {SYMBOL_SQL} SELECT * FROM sy",
    "rrf_two_lists": f"""
WITH {TWO_SQL}, f AS (SELECT coalesce(xrk.q, sy.hint_id) AS hint_id, coalesce(xrk.k, sy.id) AS id, xrk.place AS lexical_place, sy.place AS symbol_place,
  round(coalesce(1.0::DOUBLE / (60 + xrk.place), 0) + coalesce(1.0::DOUBLE / (60 + sy.place), 0), 9) AS score FROM xrk FULL JOIN sy ON q = hint_id AND k = id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, least(lexical_place, symbol_place), (lexical_place IS NOT NULL)::INT + (symbol_place IS NOT NULL)::INT DESC, id) AS place FROM f) WHERE place <= 8
""",
    "rrf_three_lists": f"""
WITH {TWO_SQL}, o AS (SELECT id AS hint_id, project_id, path, start_line AS at_line FROM code_chunks WHERE id % 50 = 0),
dn AS (SELECT * FROM (SELECT hint_id, c.id, row_number() OVER (PARTITION BY hint_id ORDER BY abs(c.start_line - at_line), c.id) AS place FROM code_chunks c JOIN o USING (project_id, path)) WHERE place <= 20),
u AS (SELECT hint_id, id, 'd' AS s, place FROM dn UNION ALL SELECT q, k, 'l', place FROM xrk UNION ALL SELECT hint_id, id, 's', place FROM sy),
g AS (SELECT hint_id, id, min(place) FILTER (s = 'd') AS dense_place, min(place) FILTER (s = 'l') AS lexical_place, min(place) FILTER (s = 's') AS symbol_place, min(place) AS best_place, count(*) AS sources FROM u GROUP BY 1, 2),
f AS (SELECT *, round(0.0::DOUBLE + coalesce(1.1::DOUBLE / (60 + dense_place), 0) + coalesce(1.05::DOUBLE / (60 + lexical_place), 0) + coalesce(1.2::DOUBLE / (60 + symbol_place), 0), 9) AS score FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, best_place, sources DESC, id) AS place FROM f) WHERE place <= 8
""",
    "query_intents": "WITH m AS (SELECT item_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(trim(question), '{zh}') OR regexp_matches(trim(question), '{en}') THEN '{n}' END" for n, (zh, en) in r.INTENTS.items())
    + "], lambda x: x IS NOT NULL) AS names FROM eval_questions), i AS (SELECT item_id, CASE WHEN len(names) > 1 THEN 'mixed' WHEN len(names) = 1 THEN names[1] ELSE 'unknown' END AS intent, array_to_string(names, ',') AS intents, CASE WHEN len(names) > 1 THEN 0.65::DOUBLE WHEN len(names) = 1 THEN 0.9 ELSE 0.2 END AS confidence FROM m) SELECT *, "
    + ", ".join(
        "CASE intent " + " ".join(f"WHEN '{n}' THEN {w[j]}::DOUBLE" for n, w in r.ROUTES.items()) + f" ELSE 1.0 END AS {s}_weight"
        for j, s in enumerate(("dense", "lexical", "symbol"))
    )
    + " FROM i",
    "symbol_hints": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '`[^`\r\n]{1,500}`', ' ', 'g') AS v FROM documents),
a AS (SELECT doc_id, list_concat(
  list_filter(list_transform(regexp_extract_all(t, '`([^`\r\n]{1,500})`', 1), lambda q: regexp_replace(trim(q), '\(\)$', '')), lambda q: regexp_full_match(q, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*')),
  list_filter(regexp_extract_all(v, '[A-Za-z0-9_.]+'), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+')),
  list_filter(regexp_extract_all(v, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+')),
  list_filter(regexp_extract_all(v, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*') AND regexp_matches(x, '[a-z]'))) AS h FROM t)
SELECT doc_id, unnest(list_distinct(list_transform(h, lambda x: lower(x)))) AS hint FROM a
""",
    "file_intents": " UNION ALL ".join(f"SELECT item_id, '{n}' AS intent FROM eval_questions WHERE " + " OR ".join(f"contains(lower(question), '{w}')" for w in words) for n, (words, _) in r.FILE_INTENTS.items()),
    "file_ranking": f"""
WITH {PROFILES}, q AS (SELECT item_id AS query_id, {WORDS} AS ws FROM eval_questions WHERE item_id % 50 = 0),
it AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT item_id AS query_id, '{name}' AS name FROM eval_questions WHERE item_id % 50 = 0 AND (" + " OR ".join(f"contains(lower(question), '{w}')" for w in words) + ")" for _, (words, names) in r.FILE_INTENTS.items() for name in names)})),
bn AS (SELECT query_id, name, count(*) * 30 AS bonus FROM it GROUP BY 1, 2),
f AS (SELECT p.id, p.path, string_split(p.path, '/')[-1] AS name, lower(p.path) AS low, lower(r.content) AS text, p.importance, p.is_core FROM profiles p JOIN repo_files r USING (id) WHERE r.content IS NOT NULL),
s AS (SELECT q.query_id, id, path, importance, is_core, list_sum(list_transform(ws, lambda w: CASE WHEN contains(low, w) THEN 8 ELSE 0 END + least(8, (length(text) - length(replace(text, w, ''))) // length(w)))) + coalesce(bonus, 0) AS ws FROM f CROSS JOIN q LEFT JOIN bn ON bn.query_id = q.query_id AND bn.name = f.name),
z AS (SELECT query_id, id, path, round(ws + CASE WHEN is_core THEN 5 ELSE 0 END + least(importance, 100) / 25, 6) AS score FROM s WHERE ws > 0)
SELECT query_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, id) AS place FROM z) WHERE place <= 6
""",
}
SQL["symbol_candidates"] = f"""
WITH {SYMBOL_SQL}, g AS (SELECT id // 500 AS query_id, id AS hint_id, row_number() OVER (PARTITION BY id // 500 ORDER BY id) AS hn FROM code_chunks WHERE id % 50 = 0), gn AS (SELECT query_id, ceil(24 / count(*)) AS share FROM g WHERE hn <= 8 GROUP BY 1),
a AS (SELECT query_id, id, count(DISTINCT hint_id) AS hints, min((place, -score, tier)) AS b, string_agg(DISTINCT match_type, ',' ORDER BY match_type) AS match_types FROM sy JOIN g USING (hint_id) JOIN gn USING (query_id) WHERE hn <= 8 AND place <= share GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, id, hints, b[3]::BIGINT AS tier, -b[2] AS score, match_types, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], id) AS place FROM a) WHERE place <= 24
"""
