"""Mixing sources to target weights by the cube method.

Texts are counted in tokens of a public tokenizer and taken once, whatever the number of
their copies.  The total is the largest at which no source needs a text more often than it
may be repeated; sources without documents are left out and the other shares scaled up.
Every text of a source is used ``floor(r)`` times, ``r`` being the repeats the source needs,
and once more for a balanced sample of inclusion probability ``r - floor(r)``.

The sample is drawn by the cube method: the vector of probabilities walks, three texts at
a time, in the null space of the two constraints (tokens and number of texts of a source)
until texts are decided.  Partitions walk by themselves; each leaves at most two undecided
texts per source.  Only those go on to a second walk per source, and at most two are landed
by giving up first the tokens, then the count.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level BPE vocabularies cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file that was sent along with the job; read once a process."""
    path = SparkFiles.get(path.rsplit("/", 1)[-1])
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("seamwright", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def source_name(c):
    """One spelling per source: trimmed, lower case, runs of other signs as one underscore."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(c)), r"[^\p{L}\p{N}]+", "_"), F.lit(""))


def counted_texts(documents: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(key, doc_id, source, tokens): one row per distinct text that is not empty.

    Of the copies of a text the smallest doc_id among those with a source counts; texts
    whose copies have no source keep a null source.
    """

    documents.sparkSession.sparkContext.addFile(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["key", "doc_id", "source", "tokens"])

    rows = documents.select(
        F.sha2("text", 256).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text"
    ).where("text IS NOT NULL AND text != '' AND doc_id IS NOT NULL")
    counted = spread(rows).mapInArrow(count, "key string, doc_id long, source string, tokens long")
    best = F.min(F.struct(F.col("source").isNull(), "doc_id", "source", "tokens"))
    return counted.groupBy("key").agg(best.alias("b")).select("key", "b.doc_id", "b.source", "b.tokens")


def plan_repeats(available: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, repeats, planned): how often each source is used, and the tokens planned for it.

    ``available`` (source, available) holds the tokens of the distinct texts.  The total is the
    largest at which no source is needed more often than it may be repeated, or
    ``total_tokens`` if that is less.  Sources without documents, share or repeats are left
    out and the other shares scaled up.  Of several rows of a source the largest share counts.
    """
    goals = (
        targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))
        .where("source IS NOT NULL AND share > 0 AND most > 0")
        .groupBy("source")
        .agg(F.max(F.struct("share", "most")).alias("goal"))
        .select("source", "goal.share", "goal.most")
    )
    usable = goals.join(available.where("available > 0"), "source")
    top = usable.agg(F.sum("share").alias("scale"), F.min(F.col("available") * F.col("most") / F.col("share")).alias("reach")).first()
    scale = top["scale"] or 1.0
    total = (top["reach"] or 0.0) * scale
    total = total if total_tokens is None else min(total, float(total_tokens))
    planned = F.lit(total) * F.col("share") / F.lit(scale)
    return usable.select("source", F.least(F.col("most").cast("double"), planned / F.col("available")).alias("repeats"), planned.alias("planned"))


def _uniform(*parts) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    h = blake2b("\x00".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(h, "big") / 2**64


def walk(units: list[tuple[str, float, float]], seed: int, into) -> list[tuple[str, float, float]]:
    """The flight of the cube method over (key, probability, tokens); at most two units are left.

    ``into(key, value)`` gets each decided unit.  Every step keeps the sum of probabilities
    and the expected tokens, and each unit's probability in expectation.
    """
    held: list[list] = []
    for key, p, size in units:
        if p <= 1e-9 or p >= 1 - 1e-9:
            into(key, int(p > 0.5))
            continue
        held.append([key, p, size])
        if len(held) < 3:
            continue
        (ka, pa_, sa), (kb, pb, sb), (kc, pc, sc) = held
        # orthogonal to (1, 1, 1) and to the sizes
        u = (sb - sc, sc - sa, sa - sb)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p) / v if v > 0 else -p / v) for p, v in zip((pa_, pb, pc), u) if v)
        down = min((p / v if v > 0 else (p - 1) / v) for p, v in zip((pa_, pb, pc), u) if v)
        step = up if _uniform(seed, ka, kb, kc) * (up + down) < down else -down
        rest = []
        for (k, p, s), v in zip(held, u):
            p += step * v
            if p <= 1e-9 or p >= 1 - 1e-9:
                into(k, int(p > 0.5))
            else:
                rest.append([k, p, s])
        held = rest
    return [tuple(h) for h in held]


def land(units: list[tuple[str, float, float]], seed: int, into) -> None:
    """Decides the last units: first keeping their number, then one by one."""
    held = [list(u) for u in units]
    while len(held) > 1:
        (ka, pa_, sa), (kb, pb, sb) = held[:2]
        up, down = min(1 - pa_, pb), min(pa_, 1 - pb)
        step = up if _uniform(seed, "land", ka, kb) * (up + down) < down else -down
        rest = []
        for k, p, s in ((ka, pa_ + step, sa), (kb, pb - step, sb)):
            if p <= 1e-9 or p >= 1 - 1e-9:
                into(k, int(p > 0.5))
            else:
                rest.append([k, p, s])
        held[:2] = rest
    for k, p, _ in held:
        into(k, int(_uniform(seed, "last", k) < p))


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}",
    keep_unused: bool = False,
) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each text is used.

    Texts of no use, and those of sources that take no part, are left out, unless
    ``keep_unused``; then they have 0 uses.  ``targets`` (source, target_share, max_repeats) may
    list a source once; of several rows the one of the largest share counts; null and
    non-positive shares and repeats exclude a source.  Empty documents or targets give an
    empty result (with ``keep_unused`` one without uses).
    """
    texts = checkpointed(counted_texts(documents, vocabulary).where("source IS NOT NULL"))
    plan = checkpointed(plan_repeats(texts.groupBy("source").agg(F.sum("tokens").alias("available")), targets, total_tokens))
    out_schema = "key string, doc_id long, source string, tokens long, base long, p double"
    names = ["key", "doc_id", "source", "tokens", "base", "p"]

    def fly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        rows: dict[str, tuple] = {}
        for pdf in batches:
            done: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key, source, p = row[0], row[2], row[5]
                rows[key] = row[:5]
                decide = lambda k, v: done.append((*rows.pop(k), float(v)))  # noqa: E731, B023
                held[source] = walk([*held.get(source, ()), (key, p, float(row[3]))], seed, decide)
            yield pd.DataFrame(done, columns=names)
        left = [(*rows[k], p) for units in held.values() for k, p, _ in units]
        yield pd.DataFrame(left, columns=names)

    listed = texts.join(plan, "source").select("key", "doc_id", "source", "tokens", F.floor("repeats").alias("base"), (F.col("repeats") - F.floor("repeats")).alias("p"))
    flown = checkpointed(listed.sortWithinPartitions("source", "key").mapInPandas(fly, out_schema))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        value: dict[str, int] = {}
        units = list(zip(pdf["key"], pdf["p"], pdf["tokens"].astype(float)))
        land(walk(units, seed + 1, value.__setitem__), seed + 1, value.__setitem__)
        return pdf.assign(p=[float(value[k]) for k in pdf["key"]])

    settled = flown.where("p = 0 OR p = 1")
    landed = flown.where("p > 0 AND p < 1").groupBy("source").applyInPandas(finish, out_schema)
    out = settled.unionByName(landed).select("doc_id", "source", "tokens", (F.col("base") + F.col("p")).cast("long").alias("uses"))
    if not keep_unused:
        return out.where("uses > 0")
    absent = texts.join(plan, "source", "left_anti").select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("uses"))
    return out.unionByName(absent)


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, most_uses, used_tokens, share, available_tokens, unused_tokens) per listed source.

    ``share`` is what was reached.  ``available_tokens`` are those of the texts in ``mixed`` and
    ``unused_tokens`` those of texts of no use among them; with ``mix(..., keep_unused=True)``
    these are all texts, so that they tell what the scarcest source costs.
    """
    used = F.col("uses") > 0
    got = mixed.groupBy("source").agg(
        F.count_if(used).alias("texts"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("used_tokens"),
        F.sum("tokens").alias("available_tokens"), F.sum(F.when(~used, F.col("tokens")).otherwise(0)).alias("unused_tokens"),
    )
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    listed = named.join(got, "source", "left")
    whole = listed.agg(F.sum("used_tokens").alias("whole"))  # one row
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", none("texts"), none("most_uses"), none("used_tokens"),
        F.round(F.coalesce(F.col("used_tokens") / F.greatest("whole", F.lit(1)), F.lit(0.0)), 6).alias("share"),
        none("available_tokens"), none("unused_tokens"),
    )
