"""Vector code compression: product codes whose entries are found by Orchard
search.

Vectors are scaled to integers and cut into equal consecutive parts; each part
position has a codebook of its own.  A round assigns every part to its nearest
entry and replaces each entry by the floored mean of its parts; the last
assignment gives the codes.

Orchard search: the round's codebook (a fixed number of entries, broadcast)
comes with the list of all other entries by distance for every entry.  A part
starts at an entry with a similar component sum and walks that entry's list.
A nearer entry (or an equally near one of lower index) makes the search jump
to the nearer entry's list, from its head; entries compared before are marked
and passed over; the walk stops at the first listed entry whose distance from
the current one exceeds twice the current distance, since neither it nor any
later one can be nearer.  The result is the exact nearest entry.  All parts of
a slice are walked in step, one list position at a time, on arrays.

All arithmetic is on integers, so results do not depend on how rows are
split.  Tasks add up sums and counts per entry; what reaches the driver in a
round is one row per entry that was used, whatever the size of the table.

Defined cases: a null vector, one with a null or non-finite component, and one
with a component so large that squared distances do not fit 64 bits (2**27
after scaling, for parts of 16) take no part, nor does an empty one or one
whose length differs from that of the first row's vector or is no multiple of
``parts``; repeated ids are rows of their own, ordered by their vectors where a
codebook starts; null ids come last; fewer rows than entries make smaller
codebooks; equal distances go to the lower index; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.llm.common import materialized
from wavelake.session import ship_package

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_SLICE = 8192  # parts walked in step


# ---------------------------------------------------------- Orchard search

class Codebook:
    """Entries of one part position with their distance-sorted lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = len(entries)
        gaps = np.empty((n, n), dtype=np.int64)
        for i in range(n):
            gaps[i] = ((entries - entries[i]) ** 2).sum(axis=1)
        np.fill_diagonal(gaps, -1)  # an entry heads its own list
        self.lists = np.argsort(gaps, axis=1, kind="stable")[:, 1:].astype(np.int32)
        self.gaps = np.take_along_axis(gaps, self.lists, axis=1)
        sums = entries.sum(axis=1)
        self._by_sum = np.argsort(sums, kind="stable")
        self._sums = sums[self._by_sum]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every point's nearest entry."""
        best = np.empty(len(points), dtype=np.int64)
        dist = np.empty(len(points), dtype=np.int64)
        for i in range(0, len(points), _SLICE):
            best[i:i + _SLICE], dist[i:i + _SLICE] = self._walk(points[i:i + _SLICE])
        return best, dist

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = len(points), len(self.entries) - 1
        at = np.searchsorted(self._sums, points.sum(axis=1)).clip(0, length)
        best = self._by_sum[at]
        dist = ((points - self.entries[best]) ** 2).sum(axis=1)
        marked = np.zeros((n, length + 1), dtype=bool)
        marked[np.arange(n), best] = True
        head = np.zeros(n, dtype=np.int64)     # position in the current list
        active = np.arange(n)
        while length:
            active = active[head[active] < length]
            here = best[active], head[active]
            active = active[self.gaps[here] <= 4 * dist[active]]  # squared: twice the distance
            if not len(active):
                break
            listed = self.lists[best[active], head[active]]
            head[active] += 1
            fresh = ~marked[active, listed]
            rows, listed = active[fresh], listed[fresh]
            marked[rows, listed] = True
            found = ((points[rows] - self.entries[listed]) ** 2).sum(axis=1)
            better = (found < dist[rows]) | ((found == dist[rows]) & (listed < best[rows]))
            rows, listed = rows[better], listed[better]
            best[rows], dist[rows], head[rows] = listed, found[better], 0
        return best, dist


# ----------------------------------------------------------------- vectors

def scaled_vectors(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part; ``x`` holds
    ``floor(scale * component)`` as longs."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
        .alias("x"),
        F.transform("embedding", lambda c: F.abs(c.cast("double") * F.lit(float(scale))))
        .alias("size"))
    # four times a squared distance stays below 2**62; NaN compares above every
    # number, so it does not fit
    largest = F.sqrt(F.lit(2.0 ** 58 * parts) / F.size("x"))
    fits = F.forall("size", lambda s: F.coalesce(s <= largest, F.lit(False)))
    return rows.filter(F.coalesce(fits, F.lit(False)) & (F.size("x") > 0)
                       & (F.size("x") % parts == 0)).drop("size")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _cut(m: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(m, parts, axis=1)


def _means(rows: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """One round: the entries after every part went to its nearest one."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in shared.value]
        sums = [np.zeros_like(b) for b in shared.value]
        counts = [np.zeros(len(b), dtype=np.int64) for b in shared.value]
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, points in enumerate(_cut(_matrix(batch), parts)):
                best, _ = tables[p].nearest(points)
                np.add.at(sums[p], best, points)
                counts[p] += np.bincount(best, minlength=len(counts[p]))
            held += batch.num_rows
            if held >= 1 << 34:  # before a sum of components could pass 64 bits
                yield _used(sums, counts)
                sums, counts, held = [0 * s for s in sums], [0 * c for c in counts], 0
        yield _used(sums, counts)

    ship_package(rows.sparkSession)
    found = rows.select("x").mapInArrow(run, "part int, entry int, n long, total array<long>")
    width = books[0].shape[1]
    # sums over the whole table may pass 64 bits
    merged = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.get("total", F.lit(j)).cast("decimal(38,0)")).alias(f"t{j}")
          for j in range(width)])
    out = [b.copy() for b in books]
    for r in merged.collect():  # at most one row per entry
        for j in range(width):
            out[r["part"]][r["entry"], j] = int(r[f"t{j}"]) // r["n"]
    return out


def _used(sums: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    used = [(p, e, int(n), sums[p][e].tolist()) for p, of in enumerate(counts)
            for e, n in enumerate(of) if n]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    columns = zip(*used) if used else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                      names=["part", "entry", "n", "total"])


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the ``entries`` smallest ids, by position."""
    first = (rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries)
             .select("x").collect())  # a codebook's worth
    if not first:
        return []
    return _cut(np.array([r["x"] for r in first], dtype=np.int64), parts)


def books_digest(books: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and position."""
    text = ",".join(str(v) for b in books for v in b.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def train_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (one array of entries per part position) of ``rows``
    (``vec_id, x``, a stored table)."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = _means(rows, books, parts)
    return books


def assign_codes(rows: DataFrame, books: list[np.ndarray], parts: int = PARTS) -> DataFrame:
    """``vec_id, label, code, error``: indexes in part order (two hexadecimal
    digits each) and the sum of the parts' squared distances."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"],
                           T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.empty((batch.num_rows, parts), dtype=np.uint8)
            error = np.zeros(batch.num_rows, dtype=np.int64)
            for p, points in enumerate(_cut(_matrix(batch), parts)):
                codes[:, p], dist = tables[p].nearest(points)
                error += dist
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([row.tobytes().hex() for row in codes]), pa.array(error)],
                names=["vec_id", "label", "code", "error"])

    ship_package(rows.sparkSession)
    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE
                     ) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of ``vectors`` (``vec_id, embedding, label``) and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    rows = materialized(scaled_vectors(vectors, scale, parts), "scaled_vectors")
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()
    if head is not None:
        rows = rows.filter(F.size("x") == head[0])
    books = train_codes(rows, parts, entries, rounds)
    return assign_codes(rows, books, parts), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all rows of equal label (nulls are
    one label)."""
    stored = materialized(codes, "codes")
    sums = stored.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return stored.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
