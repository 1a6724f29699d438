"""Nearest neighbours by shifted space-filling curves.

1. Equal vectors become one point that keeps its smallest ids (no search needs
   more than ``k + 1`` of them); the partial limit runs before the shuffle, so
   a vector that a third of the rows share does not meet in one task.
2. Several Hilbert orderings: each projects the points on a few random
   orthonormal directions, shifts the grid, and interleaves the cells to one
   key.  The points of all orderings are range-partitioned by (ordering, key).
3. Each query scans the ``window`` points on either side of it in every
   ordering; the windows' candidates merge and are ranked by exact distances.
4. Completion: the windows' k-th distance bounds each query's search.  The
   query set goes over the points in blocks of the first ordering, and a block
   whose bounding ball lies beyond the bound is passed over; what is left can
   only improve the result, which is then exact.  Without this pass
   (``complete=False``) the result is the windows' own.

Distances are Euclidean on the original vectors in double precision.

Defined cases: null, empty or zero vectors, vectors with null or non-finite
components, rows without an id, and vectors whose dimension is not the most
frequent one (the larger at a tie) take no part; repeated rows count once and
no row with the query's own id is a candidate; ties go to the smaller id; with
fewer than k candidates all are returned; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import map_rows, materialized

K = 10
CURVES = 8
DIRECTIONS = 6       # projected dimensions per ordering
CELL_BITS = 10       # grid bits per projected dimension
WINDOW = 256         # points scanned on either side
QUERY_BLOCK = 8192   # queries sent to the points at a time
SEED = 7


# ------------------------------------------------------------- Hilbert keys

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer cells (n x d, each below 2**bits) along the Hilbert
    curve of their grid: the axes are turned into the curve's transposed
    index, whose bits are interleaved."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the coarsest level on
        low = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Ordering:
    """One projected and shifted Hilbert ordering."""

    def __init__(self, dim: int, number: int, centre: np.ndarray, spread: float):
        rng = np.random.default_rng([SEED, number])
        basis, _ = np.linalg.qr(rng.normal(size=(dim, min(dim, DIRECTIONS))))
        self.basis, self.centre = basis, centre
        # about four deviations to either side of the centre fill the grid
        self.scale = (1 << CELL_BITS) / (8 * spread) if spread > 0 else 0.0
        self.shift = (1 << CELL_BITS) / 2 + rng.uniform(0, (1 << CELL_BITS) / 8, basis.shape[1])

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        cells = np.floor((vectors - self.centre) @ self.basis * self.scale + self.shift)
        return hilbert_keys(np.clip(cells, 0, (1 << CELL_BITS) - 1), CELL_BITS)


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors).astype(np.float64, copy=False)


# ------------------------------------------------------------------ points

def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, vec`` of the rows that take part.  Single-precision vectors
    are stored as such (half the bytes of every ordering) and become double
    where they are computed with."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(
        kind if kind == "array<float>" else "array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
                       & F.exists("vec", lambda v: v != 0))
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim"))
    top = dims.first()
    return rows.filter(F.size("vec") == (top["dim"] if top else 0))


def points_of(rows: DataFrame, k: int = K) -> DataFrame:
    """Distinct vectors: ``pid`` (smallest id), ``vec`` and ``ids`` (the
    smallest k + 1, ascending)."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = (rows.withColumn("rn", F.dense_rank().over(order)).filter(F.col("rn") <= k + 1))
    return few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("pid"), "vec", "ids")


def _spread(points: DataFrame) -> tuple[np.ndarray, float]:
    """Mean vector and mean deviation per dimension (one row per task comes
    to the driver)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, 0.0, 0.0
        for pdf in batches:
            x = _stacked(pdf["vec"])
            n, total = n + len(x), total + x.sum(axis=0)
            square += float((x * x).sum())
        if n:
            yield pd.DataFrame({"n": [n], "total": [total], "square": [square]})

    parts = map_rows(points.select("vec"), run, "n long, total array<double>, square double").collect()
    n = sum(p["n"] for p in parts)
    mean = np.sum([p["total"] for p in parts], axis=0) / n
    var = sum(p["square"] for p in parts) / n - float(mean @ mean)
    return mean, float(np.sqrt(max(var, 0.0) / len(mean)))


# ----------------------------------------------------------------- windows

def _distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((queries - vectors) ** 2).sum(axis=-1))


def curve_table(points: DataFrame, orderings: list[Ordering]) -> DataFrame:
    """Every point once per ordering, range-partitioned and sorted by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _stacked(pdf["vec"])
            for c, ordering in enumerate(orderings):
                out = pdf.copy()
                out["curve"], out["key"] = c, ordering.keys(x)
                yield out[["curve", "key", "pid", "query", "vec"]]

    kind = points.schema["vec"].dataType.simpleString()
    keyed = map_rows(points.select("pid", "query", "vec"), run,
                     f"curve int, key long, pid long, query boolean, vec {kind}")
    return (keyed.repartitionByRange("curve", "key", "pid")
            .sortWithinPartitions("curve", "key", "pid"))


def window_candidates(table: DataFrame, k: int, window: int) -> DataFrame:
    """``qid, pid, score``: the k nearest other points within each query's
    window, per ordering."""

    def nearest(rows: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
        """Queries among rows lo..hi-1, each against its window in ``rows``."""
        out = []
        x, pid, curve = _stacked(rows["vec"]), rows["pid"].to_numpy(), rows["curve"].to_numpy()
        for i in lo + np.flatnonzero(rows["query"].to_numpy()[lo:hi]):
            a, b = max(0, i - window), min(len(rows), i + window + 1)
            d = _distances(x[i], x[a:b])
            d[(curve[a:b] != curve[i]) | (np.arange(a, b) == i)] = np.inf
            best = np.lexsort((pid[a:b], d))[:k]
            best = best[np.isfinite(d[best])]
            out.append(pd.DataFrame({"qid": pid[i], "pid": pid[a:b][best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "pid": [], "score": []}).astype(
            {"qid": "int64", "pid": "int64", "score": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done = None, 0  # rows of which the first ``done`` had their turn
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            upto = max(done, len(held) - window)
            yield nearest(held, done, upto)
            cut = max(0, upto - window)
            held, done = held.iloc[cut:].reset_index(drop=True), upto - cut
        if held is not None:
            yield nearest(held, done, len(held))

    return map_rows(table, run, "qid long, pid long, score double")


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct points per query."""
    order = Window.partitionBy("qid").orderBy("score", "pid")
    return (candidates.dropDuplicates(["qid", "pid"])
            .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn"))


# -------------------------------------------------------------- completion

def _complete(blocks: DataFrame, found: DataFrame, queries: DataFrame, k: int,
              query_block: int) -> DataFrame:
    """Candidates within each query's bound from all points, for the queries
    in blocks of ``query_block`` (a fixed number of vectors on the driver and
    in each task).  Points come in curve order, a batch being a block."""
    order = Window.partitionBy("qid").orderBy("score", "pid")
    bound = (found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == k)
             .select(F.col("qid").alias("b"), F.col("score").alias("bound")))
    bounded = materialized(queries.join(bound, queries["pid"] == bound["b"], "left")
                           .select("pid", "vec", "bound").orderBy("pid"), "ann_queries")
    out, last = None, None
    while True:
        rest = bounded if last is None else bounded.filter(F.col("pid") > last)
        part = rest.orderBy("pid").limit(query_block).collect()
        if not part:
            return out
        last = part[-1]["pid"]
        one = _block_pass(blocks, part, k)
        out = one if out is None else out.union(one)


def _block_pass(blocks: DataFrame, part: list, k: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((
        np.array([r["pid"] for r in part]), np.array([r["vec"] for r in part]),
        np.array([np.inf if r["bound"] is None else r["bound"] for r in part])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q, bound = shared.value
        norm = (q * q).sum(axis=1)
        for pdf in batches:
            pids, vecs = pdf["pid"].to_numpy(), _stacked(pdf["vec"])
            for s in range(0, len(pids), 1024):
                pid, x = pids[s:s + 1024], vecs[s:s + 1024]
                centre = x.mean(axis=0)
                radius = _distances(centre, x).max()
                near = np.flatnonzero(_distances(q, centre) - radius <= bound + 1e-9)
                for t in range(0, len(near), 1024):
                    at = near[t:t + 1024]
                    square = norm[at][:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q[at] @ x.T)
                    limit = bound[at]
                    if len(x) > k + 1:  # this block's own k-th is a bound as well
                        kth = np.partition(square, k, axis=1)[:, k]
                        limit = np.minimum(limit, np.sqrt(np.maximum(kth, 0.0)) + 1e-6)
                    slack = limit ** 2 * (1 + 1e-9) + 1e-9 * (1 + norm[at])
                    i, j = np.nonzero(square <= slack[:, None])
                    i, j = i[qid[at][i] != pid[j]], j[qid[at][i] != pid[j]]
                    if len(i):
                        yield pd.DataFrame({"qid": qid[at][i], "pid": pid[j],
                                            "score": _distances(q[at][i], x[j])})

    return map_rows(blocks.select("pid", "vec"), run, "qid long, pid long, score double")


# ------------------------------------------------------------------ search

def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = K,
                       window: int = WINDOW, curves: int = CURVES, complete: bool = True,
                       query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of every row whose
    ``vec_id`` is divisible by ``every``."""
    rows = materialized(usable_vectors(vectors), "ann_rows")
    asked = rows.filter(F.col("vec_id") % every == 0)
    points = points_of(rows, k)
    asking = asked.select(F.col("vec").alias("q_vec")).distinct().withColumn("query", F.lit(True))
    points = materialized(points.join(asking, F.col("vec") == F.col("q_vec"), "left")
                          .select("pid", "vec", "ids", F.coalesce("query", F.lit(False)).alias("query")),
                          "ann_points")
    first = points.limit(1).collect()
    if not first:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score")).limit(0)
    centre, spread = _spread(points)
    orderings = [Ordering(len(centre), c, centre, spread) for c in range(curves)]
    table = materialized(curve_table(points, orderings), "ann_curves")
    found = materialized(_best(window_candidates(table, k, window), k), "ann_windows")
    queries = points.filter("query").select("pid", "vec")
    if complete:
        more = _complete(table.filter("curve = 0"), found, queries, k, query_block)
        if more is not None:
            found = materialized(_best(found.unionByName(more), k), "ann_best")
    # from points back to rows: a query's own point, then the found ones
    near = found.select("qid", F.col("pid").alias("near"), "score").union(
        queries.select(F.col("pid").alias("qid"), F.col("pid").alias("near"),
                       F.lit(0.0).alias("score")))
    ids = points.select(F.col("pid").alias("p"), "ids")
    lists = materialized(
        near.join(ids, F.col("near") == F.col("p")).select("qid", "score", F.explode("ids").alias("vec_id"))
        .withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id")))
        .filter(F.col("rn") <= k + 1).select("qid", "score", "vec_id"), "ann_lists")
    owners = asked.select(F.col("vec_id").alias("query_id"), "vec").distinct().join(
        queries.select(F.col("pid").alias("own"), F.col("vec").alias("own_vec")),
        F.col("vec") == F.col("own_vec")).select("query_id", "own")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (owners.join(lists, F.col("own") == F.col("qid"))
            .filter(F.col("vec_id") != F.col("query_id"))
            .select("query_id", rank.alias("rank"), "vec_id", "score")
            .filter(F.col("rank") <= k))
