"""Most similar vectors for every vector.

* Blobs are checked (length, finite, not all zero); equal vectors become one representative
  with its ``k + 1`` smallest ids, cut to that before the shuffle.
* Shards are the cells of centres fitted on a sample.  Their number grows with the vectors:
  up to ``TOP_CELLS`` cells by one fit on the driver; beyond, every such cell is fitted
  again on its own part of a larger sample, in parallel, so that a cell holds about
  ``shard_rows`` vectors at any size and dense regions have more cells.
* In each shard a small-world graph is built (``hnsw.Graph``).  A representative is placed
  in its nearest cell and searched for there, and in up to ``max_probes - 1`` other cells
  whose centre is within ``margin`` of the nearest one, however many cells there are.
* With ``exact`` what reaches ``min_similarity`` in a shard is complete: the graph gives a
  vector a bound, its k-th neighbour there, and the shard is compared in blocks for what
  is at least that near; vectors of other cells are compared with ``min_similarity``.
* The results of the shards are merged and the copies are put back; copies beyond the
  first ``k + 1`` of a vector have the first ``k`` as their neighbours.

``m`` and ``ef`` are the width of the graph and of its search.  Neighbours that are near
(similarity 0.8 or more, ``similar_pairs``) take a narrow search, larger shards and more
cells a vector, as a near pair that no cell holds together is lost; to find the nearest
ones among vectors without structure takes the wide search of ``nearest_vectors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .hnsw import Graph, _top

#: the router's sample on the driver, and the vectors of one shard; documented parameters
SAMPLE_ROWS = 8192
SHARD_ROWS = 8_000
MARGIN = 0.08
MAX_PROBES = 3
#: the same for near pairs; above ``NEAR_CELLS`` cells twice as many are searched, within ``NEAR_WIDER`` more.  Long vectors have shards of ``NEAR_FLOATS``, but not below ``SHARD_ROWS``
NEAR_SHARD_ROWS = 32_000
NEAR_FLOATS = 6_000_000
NEAR_MARGIN = 0.15
NEAR_PROBES = 12
NEAR_CELLS = 128
NEAR_WIDER = 0.05
#: cells of the first fit, sampled vectors for each cell, and cells in all (their centres are sent to every task)
TOP_CELLS = 256
ROWS_PER_CELL = 100
MOST_CELLS = 65_536
#: up to so many cells a vector is compared with every centre
FLAT_CELLS = 4096


def _valid(df: DataFrame, vid: str, group: str, blob: str, dimension: str) -> DataFrame:
    """(id, model, blob) of the rows whose blob is ``dimension`` finite floats, not all zero."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for b in batch.column(2):
                v = np.frombuffer(b.as_buffer(), "<f4")
                keep.append(bool(np.isfinite(v).all() and v.any() and np.isfinite(np.dot(v.astype(np.float64), v))))
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = df.select(F.col(vid).cast("long").alias("id"), F.col(group).cast("string").alias("model"), F.col(blob).alias("blob"), F.col(dimension).alias("dim"))
    rows = rows.where("id IS NOT NULL AND model IS NOT NULL AND dim > 0 AND octet_length(blob) = 4 * dim").select("id", "model", "blob")
    return rows.mapInArrow(check, rows.schema)


def _unit(blobs) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f4") for b in blobs]).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _means(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """``cells`` centres by spherical k-means, begun at rows in equal distances."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].astype(np.float32)
    for _ in range(rounds if cells > 1 else 0):
        home = (sample @ centres.T).argmax(1)
        count = np.bincount(home, minlength=cells)
        order = np.argsort(home, kind="stable")
        ends = np.cumsum(count)
        for c in np.flatnonzero(count):
            mean = sample[order[ends[c] - count[c] : ends[c]]].mean(0)
            centres[c] = mean / (np.linalg.norm(mean) or 1)
    return centres


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """About ``cells`` centres of a sample of unit vectors.

    Centres follow the density: a cell of more than 1.5 times its share is fitted again on
    its own rows, as often as it takes.
    """
    share = max(8.0, len(sample) / max(1, cells))
    todo = [_means(sample, max(1, min(cells, len(sample) // 8 or 1)), rounds)]
    home = (sample @ todo[0].T).argmax(1)
    parts = [(sample[home == c], todo[0][c : c + 1]) for c in range(len(todo[0]))]
    out: list[np.ndarray] = []
    while parts:
        rows, centre = parts.pop()
        if len(rows) <= 1.5 * share:
            out.append(centre)
            continue
        inner = _means(rows, int(np.ceil(len(rows) / share)), rounds)
        home = (rows @ inner.T).argmax(1)
        if np.bincount(home, minlength=len(inner)).max() == len(rows):
            out.append(centre)  # equal directions cannot be told apart
            continue
        parts.extend((rows[home == c], inner[c : c + 1]) for c in range(len(inner)))
    return np.concatenate(out)


class Router:
    """Centres in two levels; ``probes`` gives the cells of vectors, nearest first.

    ``top``: (c, d) centres; ``below``: for each, the (b, d) centres within it.  Cells are
    numbered through.
    """

    def __init__(self, top: np.ndarray, below: list[np.ndarray]):
        self.top, self.below = top, below
        self.first = np.cumsum([0, *map(len, below)])
        self.flat = np.concatenate(below) if self.first[-1] <= FLAT_CELLS else None

    @property
    def cells(self) -> int:
        return int(self.first[-1])

    def probes(self, x: np.ndarray, most: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(cells, wanted), both (n, most): the nearest cells and whether they are within the margin."""
        if self.flat is not None:
            parts = [_top(s := x[a : a + 1024] @ self.flat.T, np.broadcast_to(np.arange(self.cells), s.shape), most) for a in range(0, len(x), 1024)]
            sims, cells = (np.concatenate([p[j] for p in parts]) for j in range(2))
            return cells, sims >= sims[:, :1] - margin
        near = self.top @ x.T
        ways = min(most, len(self.top))
        upper = np.argsort(-near, axis=0, kind="stable")[:ways].T
        sims = np.full((len(x), ways * most), -2, np.float32)
        cells = np.zeros((len(x), ways * most), np.int64)
        for j in range(ways):
            for c in np.unique(upper[:, j]):
                rows = np.flatnonzero(upper[:, j] == c)
                s = x[rows] @ self.below[c].T
                at = np.argsort(-s, axis=1, kind="stable")[:, :most]
                w = at.shape[1]
                sims[rows, j * most : j * most + w] = np.take_along_axis(s, at, 1)
                cells[rows, j * most : j * most + w] = self.first[c] + at
        at = np.argsort(-sims, axis=1, kind="stable")[:, :most]
        sims, cells = np.take_along_axis(sims, at, 1), np.take_along_axis(cells, at, 1)
        wanted = sims >= sims[:, :1] - margin
        wanted[:, 0] = True
        return cells, wanted & (sims > -2)


def cells_for(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """How many cells ``n`` vectors get."""
    return max(1, min(MOST_CELLS, -(-n // shard_rows)))


def fit_router(draw: Callable[[int], DataFrame], n: int, shard_rows: int, sample_rows: int) -> Router | None:
    """The router of ``n`` vectors of one dimension; None if there is nothing to fit on.

    ``draw(rows)`` gives about so many of them as (id, blob).
    """
    cells = cells_for(n, shard_rows)
    rows = max(sample_rows, ROWS_PER_CELL * min(cells, TOP_CELLS))
    sample = [r["blob"] for r in draw(rows).select("blob").limit(2 * rows).collect()]
    if not sample:
        return None
    x = _unit(sample)
    if cells <= TOP_CELLS:
        centres = fit_cells(x, cells)
        return Router(centres, [centres[c : c + 1] for c in range(len(centres))])
    top = fit_cells(x, TOP_CELLS)
    share = cells * ROWS_PER_CELL

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(1).to_pylist()
            at = (_unit(b) @ top.T).argmax(1) if b else []
            yield pa.RecordBatch.from_pydict({"cell": at, "id": batch.column(0), "blob": b}, schema=pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("blob", pa.binary())]))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        part = _unit(pdf.sort_values("id")["blob"])
        centres = fit_cells(part, -(-len(part) // ROWS_PER_CELL))
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "centre": [c.astype("<f4").tobytes() for c in centres]})

    wide = draw(share).select("id", "blob").mapInArrow(home, "cell long, id long, blob binary")
    # a region that holds more of the sample than a task should is fitted in parts
    parts = Window.partitionBy("cell").orderBy(F.xxhash64("id"))
    cut = wide.withColumn("part", F.floor((F.row_number().over(parts) - 1) / (2 * sample_rows)))
    fitted = cut.groupBy("cell", "part").applyInPandas(lambda pdf: fit(pdf.drop(columns="part")), "cell long, centre binary").collect()
    inner: list[list] = [[] for _ in top]
    for r in sorted(fitted, key=lambda r: (r["cell"], r["centre"])):
        inner[r["cell"]].append(np.frombuffer(r["centre"], "<f4"))
    return Router(top, [np.stack(c) if c else top[k : k + 1] for k, c in enumerate(inner)])


class Blocks:
    """Exact comparison of vectors with those of one shard.

    A vector is turned into the axes in which the shard's vectors have most of their length;
    the first ones are multiplied out, the rest counts by its length at most (Cauchy-Schwarz).
    Pairs whose bound is too low are passed over, of the others the similarity is computed.
    ``x``: unit vectors (n, d) float64; ``low``: their ids, for equal similarities.
    """

    def __init__(self, x: np.ndarray, low: np.ndarray, least: float):
        self.x, self.low = x, low
        self.single = x.astype(np.float32)
        d = x.shape[1]
        self.axes = np.linalg.eigh(self.single.T @ self.single)[1][:, ::-1].astype(np.float32)
        some = self.single[np.linspace(0, len(x) - 1, min(len(x), 512)).astype(int)] @ self.axes
        best = None
        for head in sorted({max(1, d // 4), max(1, d // 3), max(1, 5 * d // 12), max(1, d // 2), d}):
            z = self._bounded(some, head)
            cost = head + 4500 * float((z @ z.T >= least).mean())  # a pair to look at costs as much as 4 500 factors
            if best is None or cost < best:
                best, self.head = cost, head
        self.bounds = self._bounded(self.single @ self.axes, self.head)

    @staticmethod
    def _bounded(y: np.ndarray, head: int) -> np.ndarray:
        return np.hstack([y[:, :head], np.linalg.norm(y[:, head:], axis=1, keepdims=True)]).astype(np.float32)

    def nearest(self, q: np.ndarray, k: int, least: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row of x, similarity): the k most similar of each row among those of at least its ``least``;
        ``own`` is where the rows of q begin in x, if they are of the shard."""
        n = len(self.x)
        step = max(16, min(512, 8_000_000 // n))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(q), step):
            part = q[a : a + step]
            single = part.astype(np.float32)
            floor = (least[a : a + step] - 1e-5).astype(np.float32)
            hits = np.flatnonzero(self._bounded(single @ self.axes, self.head) @ self.bounds.T >= floor[:, None])
            if len(hits) > 0.05 * len(part) * n:
                s = single @ self.single.T
                kth = np.partition(s, max(0, n - k - 1), axis=1)[:, max(0, n - k - 1)]
                r, c = np.nonzero(s >= np.maximum(floor, kth - np.float32(1e-5))[:, None])
            else:
                r, c = np.divmod(hits, n)
                s = np.concatenate([np.einsum("ij,ij->i", single[r[b : b + 20_000]], self.single[c[b : b + 20_000]]) for b in range(0, len(r), 20_000)] or [np.zeros(0, np.float32)])
                r, c = r[s >= floor[r]], c[s >= floor[r]]
            if own is not None:
                r, c = r[own + a + r != c], c[own + a + r != c]
            s = np.concatenate([np.einsum("ij,ij->i", part[r[b : b + 20_000]], self.x[c[b : b + 20_000]]) for b in range(0, len(r), 20_000)] or [np.zeros(0)])
            at = np.lexsort((self.low[c], -s, r))
            r, c, s = r[at], c[at], s[at]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
            keep = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k
            out.append((a + r[keep], c[keep], s[keep]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def nearest_vectors(
    df: DataFrame, vid: str = "id", group: str = "model_name", blob: str = "vector_blob", dimension: str = "embedding_dimension",
    k: int = 5, min_similarity: float = -1.0, m: int = 16, ef: int = 128, shard_rows: int = SHARD_ROWS,
    sample_rows: int = SAMPLE_ROWS, margin: float = MARGIN, max_probes: int = MAX_PROBES, exact: bool = False,
) -> DataFrame:
    """(id, model, neighbour_id, similarity, rank): the k nearest by cosine within each model.

    Only pairs of at least ``min_similarity`` are returned; of equal similarities the smaller
    id comes first.  Null ids, models and blobs, and blobs that do not fit, are left out; a
    repeated id is as many vectors.  A vector alone in its model has no rows.  ``exact``: shards
    are compared in full for what reaches ``min_similarity``.
    """
    valid = _valid(df, vid, group, blob, dimension)
    by_value = Window.partitionBy("model", "blob").orderBy("id")
    firsts = valid.withColumn("at", F.row_number().over(by_value)).where(F.col("at") <= k + 1)
    reps = firsts.groupBy("model", "blob").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    spark = df.sparkSession
    lengths = (
        df.where(f"{dimension} > 0 AND octet_length({blob}) = 4 * {dimension}")
        .groupBy(F.col(group).cast("string").alias("model"), F.col(dimension).alias("dim"))
        .count()
        .where("model IS NOT NULL")
        .collect()
    )
    router: dict[tuple[str, int], Router] = {}
    for row in lengths:
        in_shard = min(shard_rows, max(SHARD_ROWS, NEAR_FLOATS // row["dim"]))
        if row["count"] <= in_shard:
            continue

        def draw(rows: int, row=row) -> DataFrame:
            # by the hash of the id, so that every part of the table and every run gives the same
            below = int(min(1.0, rows / row["count"]) * 2**62)
            some = df.where((F.col(group).cast("string") == row["model"]) & (F.col(dimension) == row["dim"]) & (F.shiftrightunsigned(F.xxhash64(F.col(vid).cast("string")), 2) < below))
            return _valid(some, vid, group, blob, dimension)

        fitted = fit_router(draw, row["count"], in_shard, sample_rows)
        if fitted is not None:
            router[row["model"], row["dim"]] = fitted
    sent = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 2048) for whole in batches for a in range(0, len(whole), 2048)):
            models, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[tuple[str, int], list[int]] = {}
            for i, (model, b) in enumerate(zip(models, blobs)):
                by.setdefault((model, len(b) // 4), []).append(i)
            for (model, dim), rows in by.items():
                fitted = sent.value.get((model, dim))
                if fitted is None:
                    cells, wanted = np.zeros((len(rows), 1), np.int64), np.ones((len(rows), 1), bool)
                else:
                    many = exact and fitted.cells > NEAR_CELLS
                    cells, wanted = fitted.probes(_unit([blobs[i] for i in rows]), max_probes * (1 + many), margin + NEAR_WIDER * many)
                r, j = np.nonzero(wanted)
                at = pa.array(np.asarray(rows)[r])
                shard = pa.array([f"{model}\x00{dim}\x00{cell}" for cell in cells[r, j].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([shard, pa.array(j == 0), batch.column(1).take(at), batch.column(2).take(at)], ["shard", "home", "blob", "ids"])

    routed = reps.select("model", "blob", "ids").mapInArrow(route, "shard string, home boolean, blob binary, ids array<long>")
    shards = sum(r.cells for r in router.values()) + len(lengths)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy()
        here = pdf[home].reset_index(drop=True)
        guests = pdf[~home].reset_index(drop=True)
        if not len(here):
            return pd.DataFrame({c: [] for c in ("model", "ids", "other", "similarity", "value")})
        model = pdf["shard"].iloc[0].split("\x00")[0]
        raw = np.stack([np.frombuffer(b, "<f4") for b in here["blob"]]).astype(np.float64)
        raw /= np.linalg.norm(raw, axis=1, keepdims=True)
        low = [i[0] for i in here["ids"]]
        graph = Graph(raw.astype(np.float32), np.asarray(low, np.int64), m=m, ef=ef)
        a, b, s = graph.neighbours(k + 3)
        if exact:
            # the graph's k-th neighbour is the bound of a vector
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            least = np.full(len(raw), min_similarity)
            least[a[rank == k - 1]] = np.maximum(s[rank == k - 1], min_similarity)
            blocks = Blocks(raw, np.asarray(low, np.int64), min_similarity)
            a, b, _ = blocks.nearest(raw, k + 3, least, own=0)
        else:
            near = s >= min_similarity - 1e-4
            a, b = a[near], b[near]
        mine = here["ids"].to_numpy()
        parts = [(mine[a], mine[b], np.einsum("ij,ij->i", raw[a], raw[b]), np.full(len(a), None))]
        for at in range(0, len(guests), 8192):
            some = guests["ids"].to_numpy()[at : at + 8192]
            q = np.stack([np.frombuffer(v, "<f4") for v in guests["blob"][at : at + 8192]]).astype(np.float64)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            if exact:
                r, i, s = blocks.nearest(q, k + 3, np.full(len(q), min_similarity))
            else:
                s, i = graph.search(q.astype(np.float32), k + 3)
                r, c = np.nonzero((i >= 0) & (s >= min_similarity - 1e-4))
                i = i[r, c]
                s = np.einsum("ij,ij->i", q[r], raw[i])
            parts.append((some[r], mine[i], s, np.full(len(r), None)))
        # the copies of a vector are its nearest; of crowded ones the value is kept for the rest
        several = np.flatnonzero([len(i) > 1 for i in mine])
        value = np.array([md5(here["blob"][j]).hexdigest() if len(mine[j]) > k else None for j in several], dtype=object)
        parts.append((mine[several], mine[several], np.ones(len(several)), value))
        out = pd.DataFrame({c: np.concatenate([p[j] for p in parts]) for j, c in enumerate(("ids", "other", "similarity", "value"))})
        out.insert(0, "model", model)
        return out[out["similarity"] >= min_similarity]

    found = checkpointed(
        routed.repartition(max(1, 8 * shards), "shard")  # few shards share a task
        .groupBy("shard")
        .applyInPandas(shard, "model string, ids array<long>, other array<long>, similarity double, value string")
    )
    rank = Window.partitionBy("model", F.col("ids")[0]).orderBy(F.desc("similarity"), F.col("other")[0])
    kept = found.withColumn("at", F.row_number().over(rank)).where(F.col("at") <= k + 1)
    pairs = (
        kept.select("model", F.explode("ids").alias("id"), "other", "similarity")
        .select("model", "id", F.explode("other").alias("neighbour_id"), "similarity")
        .where("id != neighbour_id")
    )
    best = Window.partitionBy("model", "id").orderBy(F.desc("similarity"), "neighbour_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # copies beyond the first k + 1 of a vector: the first k are their neighbours
    crowded = found.where("value IS NOT NULL").select("model", "value", "ids")
    later = (
        valid.select("id", "model", F.md5("blob").alias("value"))
        .join(crowded, ["model", "value"])
        .where(F.col("id") > F.col("ids")[k])
        .select("model", "id", F.posexplode(F.slice("ids", 1, k)).alias("at", "neighbour_id"))
        .select("model", "id", "neighbour_id", F.lit(1.0).alias("similarity"), (F.col("at") + 1).alias("rank"))
    )
    return ranked.unionByName(later).select("id", "model", "neighbour_id", F.col("similarity"), "rank")


def similar_pairs(
    df: DataFrame, k: int = 5, min_similarity: float = 0.8, m: int = 10, ef: int = 20, shard_rows: int = NEAR_SHARD_ROWS,
    margin: float = NEAR_MARGIN, max_probes: int = NEAR_PROBES, exact: bool = True, **options,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one of the two is among the k nearest of the other, and that near."""
    near = nearest_vectors(df, k=k, min_similarity=min_similarity, m=m, ef=ef, shard_rows=shard_rows, margin=margin, max_probes=max_probes, exact=exact, **options)
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()
