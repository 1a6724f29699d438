"""SimHash near-duplicates by multi-index hashing.

Fingerprints: a document's words (ASCII lower case, split at ASCII white
space) form k-word shingles, repeats included; a fingerprint bit is set when
it is set in over half of the shingles' 64-bit hashes.  Fewer words than k:
the whole sequence is the one shingle; no word: fingerprint zero.

Links: the distinct fingerprints (copies are one row by then) are cut into
segments.  Two fingerprints within ``max_bits`` must agree closely in one of
them: with segment radii r_1..r_m and sum(r_i + 1) > max_bits, some segment
differs by at most its radius.  Each fingerprint is stored once per segment
and looks up the small Hamming ball around each of its segments; matches are
verified on all 64 bits inside the join, so only true links leave it.  Hot
buckets are split by Spark's skew join (both sides are plain shuffles).

Groups are the connected components of the links over distinct fingerprints.

Defined cases: null text counts as empty, so null, empty and blank texts share
fingerprint zero and link like any other; a null doc_id takes part and a group
of null ids only has a null component id; repeated rows are copies; an empty
table gives an empty result; extra columns are ignored by the fingerprints and
kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import batches_of, map_rows, materialized
from wavelake.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
_SLICE = 65_536  # shingles whose bits are unpacked at a time


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text."""
    # bytes.lower/split touch A-Z and ASCII white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    firsts, lasts = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(firsts), _SLICE):
        h = np.array([digest(joined[s:e], SEED)
                      for s, e in zip(firsts[i:i + _SLICE], lasts[i:i + _SLICE])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(firsts), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, text_hash: bool = False) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row; with
    ``text_hash`` also ``h``, Spark's 64-bit hash of the text."""
    extra = [F.xxhash64("text").alias("h")] if text_hash else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in batches_of(pdf, "text", 8 << 20):
                fps = np.array([fingerprint(t, k) for t in part["text"]], dtype=np.uint64)
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(),
                                    "fp": fps.view(np.int64)})
                if text_hash:
                    out["h"] = part["h"].to_numpy()
                yield out

    return map_rows(rows, run, "doc_id long, fp long" + (", h long" if text_hash else ""))


def segment_plan(max_bits: int, segments: int = 3) -> list[tuple[int, int, int]]:
    """(shift, width, radius) per segment, with sum(radius + 1) = max_bits + 1
    (a segment that gets nothing of that sum is not looked up: radius -1)."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    share, more = divmod(max_bits + 1, segments)
    return [(lo, hi - lo, share + (i < more) - 1)
            for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]


def _ball(width: int, radius: int) -> list[int]:
    masks, level = {0}, {0}
    for _ in range(radius):
        level = {m ^ (1 << i) for m in level for i in range(width)}
        masks |= level
    return sorted(masks)


def _segment_key(fp: Column, index: int, shift: int, width: int) -> Column:
    """Segment value with the segment's number above it, in one long."""
    value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
    return value.bitwiseOR(F.lit(index << 40))


def fingerprint_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (a < b): all pairs of the distinct ``fp`` of ``classes`` that
    differ in 1..max_bits bits."""
    plan = [(i, *seg) for i, seg in enumerate(segment_plan(max_bits)) if seg[2] >= 0]
    fp = F.col("fp")
    table = classes.select(fp.alias("b"), F.explode(F.array(*[
        _segment_key(fp, i, s, w) for i, s, w, _ in plan])).alias("key"))
    probes = classes.select(fp.alias("a"), F.explode(F.array(*[
        _segment_key(fp, i, s, w).bitwiseXOR(F.lit(mask))
        for i, s, w, r in plan for mask in _ball(w, r)])).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return (probes.join(table, (probes["key"] == table["key"])
                        & (F.col("a") < F.col("b")) & near)
            .select("a", "b").distinct())


def near_duplicate_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, component_id, root`` per distinct fingerprint of ``prints``
    (``doc_id, fp``): the smallest doc_id of its group, and the group's
    smallest fingerprint."""
    classes = materialized(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")),
                           "classes")
    roots = connected_components(fingerprint_links(classes, max_bits))
    rooted = materialized(
        classes.join(roots, classes["fp"] == roots["node"], "left")
        .select("fp", "first_doc", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = materialized(rooted.groupBy(F.col("root").alias("r"))
                            .agg(F.min("first_doc").alias("component_id")), "smallest")
    return materialized(rooted.join(smallest, F.col("root") == F.col("r"))
                        .select("fp", "component_id", "root"), "groups")


def simhash_near_dedup(docs: DataFrame, k: int = SHINGLE_WORDS,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``."""
    prints = materialized(fingerprints(docs, k), "fingerprints")
    groups = near_duplicate_groups(prints, max_bits)
    return prints.join(groups.select(F.col("fp").alias("g_fp"), "component_id"),
                       F.col("fp") == F.col("g_fp")).drop("g_fp")


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: its smallest doc_id
    (nulls last), among equal ids the smallest text hash, and one of rows that
    repeat both."""
    prints = materialized(fingerprints(docs, k, text_hash=True), "fingerprints")
    groups = near_duplicate_groups(prints, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"),
                     F.col("h").alias("h"))
    # copies of one fingerprint shrink to one row before the join
    firsts = materialized(prints.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    best = (firsts.join(groups.select(F.col("fp").alias("g_fp"), "root"),
                        F.col("fp") == F.col("g_fp"))
            .groupBy("root").agg(F.min("first").alias("first")))
    def key(row_id: Column, h: Column, prefix: str) -> list[Column]:
        """Join and window keys without nulls: texts are shuffled once."""
        return [F.coalesce(row_id, F.lit(0)).alias(f"{prefix}id"),
                row_id.isNull().alias(f"{prefix}null"), h.alias(f"{prefix}h")]

    kept = materialized(best.select(*key(F.col("first.id"), F.col("first.h"), "keep_")), "kept")
    # the rows as structs: their own columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                       *key(F.col("doc_id").cast("long"), F.xxhash64("text"), ""))
    names = ["id", "null", "h"]
    same = [F.col(c) == F.col(f"keep_{c}") for c in names]
    one = Window.partitionBy(*names).orderBy(F.lit(0))
    # copies of a row shrink to one in the tasks that read them; the join then
    # finds the rows dealt by its keys
    firsts = rows.withColumn("n", F.row_number().over(one)).filter("n = 1")
    return (firsts.join(kept, same, "left_semi")
            .select(*[F.col(f"d.`{c}`") for c in docs.columns]))
