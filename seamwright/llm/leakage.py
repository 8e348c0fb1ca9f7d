"""Evaluation texts leaking into training text.

Both sides are cut into words (Latin words and numbers; single Chinese characters),
regardless of case, punctuation, markup and line breaks.  From every item windows of its own
size and of a quarter of it (of short items: of the fewest words that can be a leak) are
fingerprinted (SimHash of 64 bits over words weighted by their rarity in the corpus), and so
is every window of those sizes of every document; sizes are taken from a ladder, so that
they are few.  Of two fingerprints within ``RADIUS`` at least one of four blocks differs in
at most ``RADIUS // 4`` bits, so looking up each block with its neighbours finds all of them.
Candidates are verified exactly by the weight of the shingles that item and passage share:
shared shingles are chained in order, and the chain must span half of the item and hold most
of the weight of what it spans.

Rarity is counted over all words of all documents, by hash in ``BUCKETS`` counters, once.  It
does not depend on the items, so an item is found or not whatever items stand next to it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

RADIUS = 7
#: items of one lookup table, and bytes of the tables of one pass over the documents; more take more passes
ITEMS_PER_TABLE = 1_000
PASS_BYTES = 192 << 20
#: counters of document frequencies, in lanes; what is sent to the tasks of them has this size
BUCKETS, LANES = 1 << 20, 1 << 10
MIN_WORDS = 6
#: window sizes
LADDER = (2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
#: the least share of an item's words that the passage spans and holds; of what it spans, of words and of weight, held
SPAN_SHARE, WORD_SHARE, SPAN_WORDS, SPAN_WEIGHT = 0.48, 0.45, 0.85, 0.8

_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_PIECE = re.compile(r"[㐀-鿿豈-﫿]|[^㐀-鿿豈-﫿]+")
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,8};|[*`~]+|(?m:^[ \t]*[>#|-]+[ \t]?)|(?<![^\W_])_+|_+(?![^\W_])")


def words(text: str) -> list[str]:
    """The words of a text in the compared form."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _MARKUP.sub(" ", text.casefold())
    if not text.isascii() and _HAN.search(text):
        return [p for w in _WORD.findall(text) for p in _PIECE.findall(w)]
    return _WORD.findall(text)


def _bits(word: str) -> np.ndarray:
    """+1 or -1 for each of 64 hash bits."""
    h = np.frombuffer(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint8)
    return np.unpackbits(h).astype(np.int32) * 2 - 1


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


class Weights:
    """A small whole number per word: the rarer in the corpus, the larger.

    ``counts``: documents by word bucket; words of one bucket count together.
    """

    def __init__(self, documents: int, counts: np.ndarray):
        by_count = 1 + np.log(max(1, documents) / (1 + counts.astype(np.float64)))
        self.table = np.clip(np.round(by_count), 1, 8).astype(np.int8)

    def of(self, word: str) -> int:
        return int(self.table[_bucket(word)])


def _rung(n: int) -> int:
    """The largest window size of the ladder that is at most ``n``."""
    return max((r for r in LADDER if r <= n), default=n)


class Index:
    """Fingerprints of item windows by window length, with a lookup table per block."""

    def __init__(self, items: list[tuple[int, list[str]]], weights: Weights):
        self.items = items
        self.weights = weights
        self.item_weights = [[weights.of(w) for w in ws] for _, ws in items]
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 64), np.int16)
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, ws) in enumerate(items):
            n = len(ws)
            c = self._sums([ws])
            for size in {_rung(n), _rung(max(8, n // 4)) if n >= 16 else min(n, MIN_WORDS)}:
                by.setdefault(size, []).append((k, self._prints(c, size)))
        self.lengths = {}
        for size, parts in by.items():
            prints = np.concatenate([p for _, p in parts])
            owner = np.concatenate([np.full(len(p), k) for k, p in parts])
            prints = np.unique(np.stack([prints, owner.astype(np.uint64)]), axis=1)
            self.lengths[size] = (prints[0], prints[1].astype(np.int32), [self._block(prints[0], b) for b in range(4)])
        self.rows, self.table = {}, self.table[:0]

    @property
    def bytes(self) -> int:
        """Size of the tables."""
        return sum(p.nbytes + o.nbytes + sum(f.nbytes + e.nbytes for f, e in blocks) for p, o, blocks in self.lengths.values())

    def _row(self, word: str) -> int:
        got = self.rows.get(word)
        if got is None:
            got = self.rows[word] = len(self.rows)
            if got >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(1024, len(self.table)), 64), np.int16)])
            self.table[got] = _bits(word) * self.weights.of(word)
        return got

    def _sums(self, texts: list[list[str]]) -> np.ndarray:
        """Running sums of the weighted bits over all words, one row longer.

        They wrap around; differences of them over a window (at most 512 words of weight 8) are right.
        """
        if len(self.rows) > 400_000:
            self.rows, self.table = {}, np.zeros((0, 64), np.int16)
        flat = [w for ws in texts for w in ws]
        at = list(map(self.rows.get, flat))
        if None in at:
            for w in set(flat):
                self._row(w)
            at = list(map(self.rows.get, flat))
        at = np.asarray(at, np.int64)
        out = np.zeros((len(at) + 1, 64), np.int16)
        if len(at):
            np.cumsum(self.table[at], axis=0, dtype=np.int16, out=out[1:])
        return out

    @staticmethod
    def _prints(sums: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the windows of ``size`` words at every position."""
        if len(sums) <= size:
            return np.zeros(0, np.uint64)
        return np.packbits(sums[size:] - sums[:-size] > 0, axis=1).view(np.uint64)[:, 0]

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(first entry of each block value, entries): all prints within RADIUS // 4 bits of it."""
        value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        assert RADIUS // 4 == 1
        near = np.concatenate([value[:, None], value[:, None] ^ (1 << np.arange(16))[None, :]], axis=1)
        entry = np.repeat(np.arange(len(prints), dtype=np.int32), 17)
        flat = near.ravel()
        at = np.argsort(flat, kind="stable")
        return np.searchsorted(flat[at], np.arange(65537)).astype(np.int32), entry[at]

    def candidates(self, texts: list[list[str]], sums: np.ndarray | None = None) -> dict[tuple[int, int], list[int]]:
        """(text, item) to the word positions of windows within RADIUS of one of the item's."""
        sums = self._sums(texts) if sums is None else sums
        starts = np.cumsum([0, *map(len, texts)])
        text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
        out: dict[tuple[int, int], list[int]] = {}
        for size, (prints, owner, blocks) in self.lengths.items():
            here = self._prints(sums, size)
            if not len(here):
                continue
            inside = text_of[: len(here)] == text_of[size - 1 : size - 1 + len(here)]
            pos = np.flatnonzero(inside)
            here = here[pos]
            for b, (first, entries) in enumerate(blocks):
                key = ((here >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                n = first[key + 1] - first[key]
                w = np.repeat(np.arange(len(here)), n)
                if not len(w):
                    continue
                offset = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                e = entries[np.repeat(first[key], n) + offset]
                hit = np.bitwise_count(here[w] ^ prints[e]) <= RADIUS
                if hit.any():
                    p = pos[w[hit]]
                    pairs = np.unique(np.stack([text_of[p], owner[e[hit]], p - starts[text_of[p]], np.full(len(p), size)], 1), axis=0)
                    for t, k, at, s in pairs.tolist():
                        out.setdefault((t, k), []).extend((at, at + s))
        return out

    def verify(self, text: list[str], k: int, near: list[int]) -> float:
        """Weighted share of the item held by one passage near the given positions; 0 if it is no leak."""
        item = self.items[k][1]
        n = len(item)
        best = 0.0
        near = sorted(near)
        # passages: runs of candidate windows not further apart than the item is long
        groups: list[list[int]] = []
        for p in near:
            if groups and p - groups[-1][1] <= n:
                groups[-1][1] = p
            else:
                groups.append([p, p])
        for a, b in groups:
            lo, hi = max(0, a - n), min(len(text), b + n)
            best = max(best, self._chain(item, self.item_weights[k], text[lo:hi]))
        return best

    @staticmethod
    def _chain(item: list[str], weight: list[int], region: list[str]) -> float:
        size = 2 if len(item) >= 4 else 1
        there = set(region)
        if sum(w in there for w in item) < max(WORD_SHARE * len(item), min(MIN_WORDS, len(item))):
            return 0.0  # no chain can hold enough
        where: dict[tuple, list[int]] = {}
        for j in range(len(region) - size + 1):
            where.setdefault(tuple(region[j : j + size]), []).append(j)
        # longest chain of shared shingles, increasing on both sides
        tails: list[int] = []
        nodes: list[tuple[int, int, int]] = []  # (item position, region position, previous node)
        tail_node: list[int] = []
        for i in range(len(item) - size + 1):
            for j in reversed(where.get(tuple(item[i : i + size]), ())):
                at = bisect_left(tails, j)
                nodes.append((i, j, tail_node[at - 1] if at else -1))
                if at == len(tails):
                    tails.append(j)
                    tail_node.append(len(nodes) - 1)
                else:
                    tails[at] = j
                    tail_node[at] = len(nodes) - 1
        if not tails:
            return 0.0
        chain, at = [], tail_node[-1]
        while at >= 0:
            chain.append(nodes[at][:2])
            at = nodes[at][2]
        chain.reverse()
        total = sum(weight)
        n = len(item)
        # the stretch of the chain that is one passage: few words between neighbours
        best = 0.0
        run: list[tuple[int, int]] = []
        for step in [*chain, None]:
            if step is not None and (not run or (step[1] - run[-1][1] <= 8 and step[0] - run[-1][0] <= 8)):
                run.append(step)
                continue
            if run:
                first, last = run[0][0], run[-1][0] + size - 1
                held = {p + d for p, _ in run for d in range(size)}
                # single words between two shingles at equal distance stay in place
                for (i, j), (i2, j2) in zip(run, run[1:]):
                    if i2 - i == j2 - j:
                        held.update(i + d for d in range(i2 - i) if item[i + d] == region[j + d])
                span = sum(weight[first : last + 1])
                kept = sum(weight[p] for p in held)
                width = last - first + 1
                whole = width >= SPAN_SHARE * n and len(held) >= max(WORD_SHARE * n, SPAN_WORDS * width, min(MIN_WORDS, n))
                if whole and kept >= SPAN_WEIGHT * span:
                    best = max(best, kept / total)
            run = [step] if step is not None else []
        return best


def leaks(documents: DataFrame, items: DataFrame, item_id: str = "item_id", question: str = "question") -> DataFrame:
    """(item_id, doc_id, share): the documents that contain an item in whole or in part.

    ``share`` is the weighted share of the item's words held.  Items of fewer than two words,
    null texts and null ids give no rows; repeated documents each give their own.  Items are
    taken in tables of ITEMS_PER_TABLE; the tables of a pass over the documents have at most
    PASS_BYTES (at least one table), so that what is sent to the tasks has a fixed bound.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_id).alias("i"), F.col(question).alias("q")).where("i IS NOT NULL AND q IS NOT NULL").orderBy("i", "q")
    schema = "item_id long, doc_id long, share double"
    docs = spread(documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"))
    todo = ((r["i"], w) for r in rows.toLocalIterator() if len(w := words(r["q"])) >= 2)
    weights = None
    passes: list[list[Index]] = []
    room = 0
    while block := list(islice(todo, ITEMS_PER_TABLE)):
        weights = weights or corpus_weights(docs)
        index = Index(block, weights)
        if not passes or index.bytes > room:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append(index)
        room -= index.bytes
    out = spark.createDataFrame([], schema)
    for tables in passes:
        sent = spark.sparkContext.broadcast(tables)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tables = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [words(t) for t in batch.column(1).to_pylist()]
                found: tuple[list, list, list] = ([], [], [])
                for a, part in _parts(texts):
                    sums = tables[0]._sums(part)  # the same for all tables
                    for index in tables:
                        for (t, k), near in index.candidates(part, sums).items():
                            share = index.verify(part[t], k, near)
                            if share > 0:
                                found[0].append(index.items[k][0])
                                found[1].append(ids[a + t])
                                found[2].append(share)
                yield pa.RecordBatch.from_pydict(
                    {"item_id": found[0], "doc_id": found[1], "share": found[2]},
                    schema=pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("share", pa.float64())]),
                )

        out = out.unionByName(docs.mapInArrow(search, schema))
    return out


def _parts(texts: list[list[str]]) -> Iterator[tuple[int, list[list[str]]]]:
    """(first, texts) of consecutive texts of about 100 000 words: what is fingerprinted at once."""
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= 100_000:
            yield a, texts[a : k + 1]
            a, size = k + 1, 0
    if a < len(texts):
        yield a, texts[a:]


def corpus_weights(docs: DataFrame) -> Weights:
    """Weights by document frequencies over all documents (doc_id, text).

    Every partition counts into BUCKETS counters; they are added up by lane, and as many
    numbers as there are buckets are collected.
    """
    width = BUCKETS // LANES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, bucket = 0, np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            if len(bucket) > 1_000_000:
                bucket.clear()
            hit: list[int] = []
            for t in batch.column(1).to_pylist():
                n += 1
                distinct = set(words(t))
                bucket.update({w: _bucket(w) for w in distinct if w not in bucket})
                hit.extend(set(map(bucket.get, distinct)))
            df += np.bincount(np.asarray(hit, np.int64), minlength=BUCKETS)
        lanes = np.flatnonzero(df.reshape(LANES, width).any(1))
        yield pa.RecordBatch.from_pydict(
            {"lane": [-1, *lanes.tolist()], "n": [np.int64(n).tobytes(), *(df[x * width : (x + 1) * width].astype("<i8").tobytes() for x in lanes)]},
            schema=pa.schema([("lane", pa.int32()), ("n", pa.binary())]),
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i8") for x in pdf["n"]], axis=0)
        return pd.DataFrame({"lane": [pdf["lane"].iloc[0]], "n": [total.astype("<i8").tobytes()]})

    got = {r["lane"]: np.frombuffer(r["n"], "<i8") for r in docs.mapInArrow(count, "lane int, n binary").groupBy("lane").applyInPandas(add, "lane int, n binary").collect()}
    counts = np.zeros(BUCKETS, np.int64)
    for lane, n in got.items():
        if lane >= 0:
            counts[lane * width : (lane + 1) * width] = n
    return Weights(int(got[-1][0]) if -1 in got else 0, counts)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents, share): how many documents hold each leaked item, and the most held."""
    return leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("share").alias("share"))
