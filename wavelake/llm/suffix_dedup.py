"""Repeated passages by suffix arrays: every byte covered by a ``length``-byte
string that starts earlier in the corpus is removed.

1. Anchors.  Rolling hashes of ``ANCHOR``-byte strings are taken at every
   position, and every window of ``length`` bytes is owned by the leftmost of
   its smallest ones, an anchor.  Equal windows have equal anchors at the same
   place, so a repeated window can only stand around a repeated anchor.  An
   anchor's context is what the windows it owns cover.
2. The anchors are sorted by range on (hash, context's hash, place), which
   spreads even the most frequent one.  In the sorted tasks, anchors that occur
   once are dropped; of equal contexts the first occurrence stays for the next
   step and the others are repeats as a whole.  Contexts that share a window
   share half of what it takes beside the anchor on one side at least: those
   whose hashes of both sides stand alone are dropped too, so what goes on
   follows the repeated passages, not the ``ANCHOR``-byte strings that meet by
   chance more and more in a larger corpus.  The first and last anchor of a
   task may go on in its neighbours: one occurrence per context is settled by
   joins.
3. Contexts that share an anchor but differ are dealt to shards by anchor.  An
   anchor with more than ``HOT_CONTEXTS`` of them is split by the text next to
   it before that, again and again while a part has more, at last into single
   windows, of which equal ones just collapse; so no group in a shard is larger.
   In shards, contexts are clipped to what they share with another one, and
   equal ones collapse again.  Each shard then sorts the suffixes of the rest by
   induced sorting (suffixes are classified, leftmost-smaller substrings sorted
   recursively, the shard's array induced), and permuted common prefixes tell
   which windows are equal; all but the earliest of them are repeats.
4. The repeats of a document merge to spans, which are cut out.

Texts are shuffled twice, compressed: for the contexts of step 3 and for the
cut; nothing else carries text.  Intermediate tables and shuffles are deleted
as soon as the next step is written.

Order: smaller doc_id first, null ids last; among rows with the same id, by
the text's hash; equal rows of the same id in any order (the first stays).

Defined cases: null text is empty; texts shorter than ``length`` lose nothing;
a text may lose all bytes and then is empty; cutting may leave parts of a
character, which :func:`remove_repeats` drops when it decodes; an empty table
gives an empty result; extra columns are ignored by :func:`suffix_dedup` and
kept by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.common import map_rows, materialized, materialized_counted, parts_for
from wavelake.llm.suffix_array import join_texts, repeated_groups
from wavelake.session import scratch_scope, ship_package

LENGTH = 100
ANCHOR = 16
HOT_CONTEXTS = 256
SHARD_CONTEXTS = 16_384     # contexts (of at most 2 * LENGTH bytes) per shard
_CHUNK = 1 << 20            # bytes of a long text hashed at a time
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers
_MIX = np.uint64(0xFF51AFD7ED558CCD)


# ------------------------------------------------------------------ anchors

@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) \
        + np.uint64(1)


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Rolling:
    """Hashes of substrings of one byte array."""

    def __init__(self, data: np.ndarray, base: int):
        size = 1 << max(12, (len(data) + 1).bit_length())
        power, self.inverse = _powers(base, size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_letters()[data] * power[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def _sliding(pick, a: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    n, span = len(a) - width + 1, 1
    while 2 * span <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[:n], a[width - span:width - span + n])


def anchors(raw: bytes, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(places, anchor hashes, context hashes, left, right) of a text's
    anchors: the context of an anchor at p is ``[p - left, p + right)``."""
    return _anchors(raw, length, k)[:5]


def _sides(rolling: _Rolling, p: np.ndarray, left: np.ndarray, right: np.ndarray, length: int,
           k: int) -> np.ndarray:
    """Two hashes of 32 bits in one number: of the ``(length - k) // 2`` bytes
    before the anchor, and of the anchor with what a window takes after it if
    it takes fewer before it.  0 where the context does not reach so far; one
    of the two it does reach."""
    before = (length - k) // 2
    after = length - before + 1
    out = np.zeros(len(p), dtype=np.uint64)
    has = left >= before
    out[has] = rolling.of(p[has] - before, p[has]) | np.uint64(1 << 32)
    out &= np.uint64(0xFFFFFFFF << 32)
    has = right >= after
    out[has] |= (rolling.of(p[has], p[has] + after) >> np.uint64(32)) | np.uint64(1)
    return out


def _anchors(raw: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """:func:`anchors` and their sides."""
    n = len(raw)
    width = length - k + 1
    found = []
    for a in range(0, max(0, n - length + 1), _CHUNK):
        end = min(n, a + _CHUNK + length - 1)           # of the windows' bytes
        data = np.frombuffer(raw, np.uint8, end - a, a)
        at = np.arange(len(data) - k + 1)
        h = _Rolling(data, _BASES[0]).of(at, at + k)
        least = _sliding(np.minimum, h, width)          # per window
        edge = np.zeros(width - 1, dtype=np.uint64)
        highest = _sliding(np.maximum, np.concatenate((edge, least, edge)), width)
        chosen = np.flatnonzero(highest == h)           # smallest in some window
        windows = np.arange(len(least))
        owner = np.searchsorted(chosen, windows)
        wrong = np.flatnonzero(h[chosen[owner]] != least)
        while len(wrong):
            owner[wrong] += 1
            wrong = wrong[h[chosen[owner[wrong]]] != least[wrong]]
        own, first = np.unique(owner, return_index=True)
        last = np.append(first[1:], len(owner)) - 1     # owners follow each other
        p = chosen[own]
        rolling = _Rolling(data, _BASES[1])
        context = rolling.of(first, last + length)
        left, right = p - first, last + length - p
        context ^= (left * 1000 + right).astype(np.uint64)
        found.append((p + a, h[p], context, left, right, _sides(rolling, p, left, right, length, k)))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


_OCCURRENCE = "anchor long, ctx long, doc_id long, tie long, at long, ext int, side long"


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _start() -> Column:
    """First byte of an occurrence's context (``ext`` holds its extent left of
    the anchor, times 1024, and right of it)."""
    return F.col("at") - F.shiftright("ext", 10)


def _end() -> Column:
    return F.col("at") + F.col("ext").bitwiseAND(1023)


def occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Every anchor of ``docs`` (``doc_id, tie, text``), unsorted."""
    if length > 500:
        raise ValueError("length must not exceed 500")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, counts = [], []
            for text in pdf["text"]:
                parts.append(_anchors(_raw(text), length, k))
                counts.append(len(parts[-1][0]))
            if sum(counts):
                at, anchor, ctx, left, right, side = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({
                    "anchor": anchor.view(np.int64), "ctx": ctx.view(np.int64),
                    "doc_id": np.repeat(pdf["doc_id"].astype("Int64").to_numpy(), counts),
                    "tie": np.repeat(pdf["tie"].to_numpy(), counts), "at": at,
                    "ext": (left * 1024 + right).astype(np.int32), "side": side.view(np.int64)})

    return map_rows(docs, run, _OCCURRENCE)


_ALONE, _LATER, _FIRST, _EDGE = 0, 1, 2, 3


def _met(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which contexts have a side that another one of their anchor has."""
    out = np.zeros(len(anchor), dtype=bool)
    for half in (side.view(np.uint64) >> np.uint64(32), side.view(np.uint64) & np.uint64(0xFFFFFFFF)):
        order = np.lexsort((half, anchor))
        a, b = order[:-1], order[1:]
        same = (anchor[a] == anchor[b]) & (half[a] == half[b]) & (half[a] != 0)
        out[a[same]] = True
        out[b[same]] = True
    return out


def sorted_occurrences(found: DataFrame) -> DataFrame:
    """Occurrences with their ``kind``: ``_LATER`` ones of a context,
    ``_FIRST`` ones that may share a window with another context of their
    anchor (``n_ctx`` such contexts), and of the first and the last anchor of
    each sort task one per context (``_EDGE``)."""
    keys = ["anchor", "ctx", F.col("doc_id").asc_nulls_last(), "tie", "at"]
    ordered = found.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def whole_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of anchors whose occurrences are all here."""
        anchor, ctx = pdf["anchor"].to_numpy(), pdf["ctx"].to_numpy()
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        first = new | np.concatenate(([True], ctx[1:] != ctx[:-1]))
        open_ = first.copy()
        open_[first] = _met(anchor[first], pdf["side"].to_numpy()[first])
        n_ctx = np.add.reduceat(open_.astype(np.int32), np.flatnonzero(new))[np.cumsum(new) - 1]
        kind = np.where(first, np.where(open_, _FIRST, _ALONE), _LATER)
        out = pdf.assign(kind=kind.astype(np.int32), n_ctx=n_ctx)[kind != _ALONE]
        later = out["kind"] == _LATER
        return out.assign(anchor=out["anchor"].mask(later, 0), ctx=0, side=0,
                          n_ctx=out["n_ctx"].mask(later, 0))

    same = ["anchor", "ctx", "tie", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first, last = None, None, None

        def edge_rows(pdf: pd.DataFrame) -> pd.DataFrame:
            """Of an anchor that may go on elsewhere only the first row of a
            context is open: the others have an earlier one right here."""
            nonlocal last
            anchor, ctx = pdf["anchor"].to_numpy(), pdf["ctx"].to_numpy()
            new = np.concatenate(([last is None or (anchor[0], ctx[0]) != last[:2]],
                                  (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1])))
            last = tuple(pdf[same].iloc[-1])
            return pdf.assign(kind=np.where(new, _EDGE, _LATER).astype(np.int32), n_ctx=0,
                              anchor=np.where(new, anchor, 0), ctx=np.where(new, ctx, 0),
                              side=np.where(new, pdf["side"], 0))

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if pdf["tie"].any():  # rows of equal documents are one occurrence
                pdf = pdf.drop_duplicates(same, ignore_index=True)
                if last is not None and len(pdf) and tuple(pdf[same].iloc[0]) == last:
                    pdf = pdf.iloc[1:].reset_index(drop=True)
                if not len(pdf):
                    held = None
                    continue
            anchor = pdf["anchor"].to_numpy()
            first = anchor[0] if first is None else first
            begins = int(np.searchsorted(anchor, first, side="right")) if anchor[0] == first else 0
            ends = int(np.searchsorted(anchor, anchor[-1], side="left"))
            if begins:
                yield edge_rows(pdf.iloc[:begins])
            if ends > begins:
                yield whole_runs(pdf.iloc[begins:ends])
            # the last anchor may go on
            rest = pdf.iloc[max(begins, ends):]
            held = rest if len(rest) else None
        if held is not None:
            yield edge_rows(held)

    return materialized(map_rows(ordered, run, _OCCURRENCE + ", kind int, n_ctx int"), "anchors")


# ------------------------------------------------------------ equal contexts

def _place() -> Column:
    """Orders occurrences: by document, then place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "at")


def split_contexts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From sorted occurrences: the spans (``doc_id, tie, start, end``) of
    those that are not the first of their context, and the first ones of
    contexts that may share a window with another one of their anchor
    (``anchor, n_ctx, doc_id, tie, at, ext``)."""
    edge = rows.filter(F.col("kind") == _EDGE)
    firsts = materialized(edge.groupBy("anchor", "ctx").agg(
        F.min(_place()).alias("first"), F.first("ext").alias("ext"), F.first("side").alias("side")), "contexts")
    halves = F.array(F.shiftrightunsigned("side", 32), -F.col("side").bitwiseAND(0xFFFFFFFF))
    sides = firsts.select("anchor", "ctx", F.explode(halves).alias("half")).filter("half <> 0")
    met = sides.groupBy(F.col("anchor").alias("ma"), F.col("half").alias("mh")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = (sides.join(met, (F.col("anchor") == F.col("ma")) & (F.col("half") == F.col("mh")))
           .select(F.col("anchor").alias("oa"), F.col("ctx").alias("oc")).distinct())
    met = materialized(met, "contexts_met")
    several = materialized(met.groupBy(F.col("oa").alias("a")).agg(
        F.count(F.lit(1)).cast("int").alias("n_ctx")), "anchors_split")
    heads = firsts.select(F.col("anchor").alias("fa"), F.col("ctx").alias("fc"), "first")
    later = edge.join(heads, (F.col("anchor") == F.col("fa")) & (F.col("ctx") == F.col("fc")))
    later = later.filter(_place() != F.col("first"))
    spans = ["doc_id", "tie", _start().alias("start"), _end().alias("end")]
    later = rows.filter(F.col("kind") == _LATER).select(*spans).unionByName(later.select(*spans))
    asked = ["anchor", "n_ctx", "doc_id", "tie", "at", "ext"]
    open_ = (firsts.join(met, (F.col("anchor") == F.col("oa")) & (F.col("ctx") == F.col("oc")))
             .join(several, F.col("anchor") == F.col("a"))
             .select("anchor", "n_ctx", "first.doc_id", "first.tie", "first.at", "ext"))
    return later, rows.filter(F.col("kind") == _FIRST).select(*asked).unionByName(open_)


# ---------------------------------------------------------- shards of windows

_SPAN = "doc_id long, tie long, start long, end long"


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _longest_shared(sides: list[bytes]) -> list[int]:
    """Per string the longest prefix it shares with another one: that is a
    neighbour in sorted order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        n = _common(sides[i], sides[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _clipped(pdf: pd.DataFrame, length: int) -> tuple[list[tuple], list[tuple]]:
    """Contexts of a shard clipped to what they share with another one of
    their anchor on either side of it.  Returns the spans (row, start, end) of
    those that equal an earlier one, and what is left (row, start, body) of
    anchors where clipped contexts still differ.  Rows are in document order."""
    spans, rest = [], []
    anchor = pdf["anchor"].to_numpy()
    order = np.argsort(anchor, kind="stable")
    cuts = np.flatnonzero(np.diff(anchor[order])) + 1
    bodies, offs, starts = pdf["body"].tolist(), pdf["off"].tolist(), pdf["start"].tolist()
    for group in np.split(order, cuts):
        if len(group) < 2:
            continue
        group = group.tolist()
        lefts = _longest_shared([bodies[i][:offs[i]][::-1] for i in group])
        rights = _longest_shared([bodies[i][offs[i]:] for i in group])
        seen: dict[tuple[int, bytes], int] = {}
        for i, l, r in zip(group, lefts, rights):
            if l + r < length:
                continue
            s, e = offs[i] - l, offs[i] + r
            key = (l, bodies[i][s:e])
            if key in seen:
                spans.append((i, starts[i] + s, starts[i] + e))
            else:
                seen[key] = i
        if len(seen) > 1:
            rest += [(i, starts[i] + offs[i] - l, body) for (l, body), i in seen.items()]
    return spans, rest


def _shard_spans(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the windows in a shard's contexts (``anchor, doc_id, tie,
    start, off, body``) that an earlier window equals."""
    pdf = pdf.sort_values(["doc_id", "tie", "start"], kind="stable", na_position="last",
                          ignore_index=True)
    ids, ties = pdf["doc_id"].astype("Int64"), pdf["tie"].to_numpy()
    none = ids.isna().to_numpy()
    plain = ids.fillna(0).to_numpy(dtype=np.int64)
    # rows are sorted: documents are numbered in their order
    change = (none[1:] != none[:-1]) | (plain[1:] != plain[:-1]) | (ties[1:] != ties[:-1])
    number = np.concatenate(([0], np.cumsum(change)))
    spans, rest = _clipped(pdf, length)
    found = [np.array(spans, dtype=np.int64).reshape(-1, 3)]
    if rest:
        rows, begin = np.array([r[0] for r in rest]), np.array([r[1] for r in rest])
        data, starts = join_texts([r[2] for r in rest])
        sizes = np.array([len(r[2]) for r in rest])
        owner = np.repeat(np.arange(len(rest)), sizes + 1)
        inside = np.arange(len(data)) - starts[owner]
        at, group = repeated_groups(data, sizes[owner] - inside, length)
        doc, place = number[rows[owner[at]]], begin[owner[at]] + inside[at]
        order = np.lexsort((place, doc, group))
        at, group, doc, place = at[order], group[order], doc[order], place[order]
        head = np.concatenate(([True], np.diff(group) != 0))
        lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        at = np.sort(at[(doc != doc[lead]) | (place != place[lead])])
        if len(at):  # neighbouring windows of one context are one span
            first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            last = at[np.append(first[1:], len(at)) - 1]
            own = owner[at[first]]
            found.append(np.stack([rows[own], begin[own] + inside[at[first]],
                                   begin[own] + inside[last] + length], axis=1))
    row, start, end = np.concatenate(found).T
    return pd.DataFrame({"doc_id": ids.to_numpy()[row], "tie": ties[row], "start": start, "end": end})


def shard_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows among the ``contexts`` (``anchor, doc_id, tie, start,
    off, body``) of each anchor."""
    stored, rows = materialized_counted(contexts, "shards")
    dealt = stored.repartition(parts_for(rows, SHARD_CONTEXTS), "anchor")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)  # about SHARD_CONTEXTS contexts: an anchor has HOT_CONTEXTS at most
        if held:
            yield _shard_spans(pd.concat(held, ignore_index=True), length)

    return map_rows(dealt, run, _SPAN)


def _ranges(lo: int, hi: int) -> list[tuple[int, int]]:
    """Parts of a range: by powers of two from 0, else up to eight equal ones."""
    if lo == 0:
        steps = [0, *(2 ** i for i in range(hi.bit_length()))]
    else:
        steps = list(range(lo, hi + 1, -(-(hi - lo + 1) // 8)))
    return list(zip(steps, [*(x - 1 for x in steps[1:]), hi]))


def _narrowed(rows: DataFrame, length: int) -> DataFrame:
    """Contexts of hot anchors, once per part of their range ``lo`` to ``hi``
    of how many bytes a window takes left of the anchor, cut to that part.
    What every window of a part holds is the new anchor, so equal windows
    still meet.  Contexts of parts of one window are that window."""
    def digest(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"|".join(parts), digest_size=8).digest(), "big",
                              signed=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                body, p = r.body, r.off
                for a, b in _ranges(r.lo, r.hi):
                    if p < a or len(body) - p < length - b:
                        continue  # no window of this range
                    s, e = max(0, p - b), min(len(body), p + length - a)
                    out.append((digest(b"%d" % a, b"%d" % b, body[p - a:p + length - b]),
                                digest(b"%d" % (p - s), body[s:e]),
                                r.doc_id, r.tie, r.start + s, p - s, a, b, body[s:e]))
            if out:
                frame = pd.DataFrame(out, columns=["anchor", "ctx", "doc_id", "tie", "at", "off",
                                                   "lo", "hi", "body"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return map_rows(rows, run, "anchor long, ctx long, doc_id long, tie long, at long, off int, "
                               "lo int, hi int, body binary")


# ------------------------------------------------------------------ documents

_PAIRS = "array<struct<s:bigint,e:bigint>>"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with ``_id`` and ``_tie``, and which of the two names a row's
    document.  Distinct ids name it themselves (``_tie`` is 0); otherwise a
    hash of id and text does, so that only equal rows share a name."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    distinct = ids["n"] == ids["d"]
    tie = F.lit(0).cast("long") if distinct else F.xxhash64("doc_id", "text")
    return (docs.withColumns({"_id": F.col("doc_id").cast("long"), "_tie": tie}),
            "_id" if distinct else "_tie")


def _joined(docs: DataFrame, per_doc: DataFrame, key: str) -> DataFrame:
    """``docs`` with the columns of ``per_doc`` (named by ``key``)."""
    return docs.join(per_doc.withColumnRenamed("key", "_p_key"),
                     docs[key] == F.col("_p_key"), "left").drop("_p_key")


def _merged(spans: list, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((max(0, s), min(n, e)) for s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif e > s:
            out.append([s, e])
    return [tuple(x) for x in out]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in spans:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def _packed():
    """A text's bytes, compressed for the shuffle."""

    @F.pandas_udf("binary")
    def pack(text: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pd.Series([squeeze(_raw(t)) for t in text])

    return pack


def _slices():
    """Contexts at the asked places of a packed text."""

    @F.pandas_udf("array<binary>")
    def slices(packed: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        expand = zstandard.ZstdDecompressor().decompress
        out = []
        for raw, begin, end in zip(packed, starts, ends):
            raw = expand(raw)
            out.append([raw[s:e] for s, e in zip(begin, end)])
        return pd.Series(out)

    return slices


def _cutter(length: int):
    """What is left of a packed text, and the spans taken out of it."""

    @F.pandas_udf(f"n long, kept binary, removed {_PAIRS}")
    def cut(packed: pd.Series, copy: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor().decompress
        kept, removed, sizes = [], [], []
        for t, c, s, e in zip(packed, copy, starts, ends):
            raw = expand(t)
            sizes.append(len(raw))
            if c > 1 and len(raw) >= length:
                spans = [(0, len(raw))]
            else:
                spans = _merged(list(zip(s.tolist(), e.tolist())), len(raw)) if s is not None else []
            kept.append(_without(raw, spans))
            removed.append([{"s": a, "e": b} for a, b in spans])
        return pd.DataFrame({"n": sizes, "kept": kept, "removed": removed})

    return cut


def _decoder():
    """Text of the kept bytes, without parts of characters."""

    @F.pandas_udf("string")
    def decoded(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return decoded


def _contexts(docs: DataFrame, key: str, open_: DataFrame) -> DataFrame:
    """The asked contexts with their bytes: ``anchor, n_ctx, doc_id, tie,
    start, off, body``.  ``docs`` has ``_id``, ``_tie`` and ``_text``."""
    name = F.col("doc_id" if key == "_id" else "tie").alias("key")
    ask = F.struct(_start().alias("start"), _end().alias("end"), "at", "anchor", "n_ctx")
    asks = open_.select(name, ask.alias("ask")).groupBy("key").agg(F.collect_list("ask").alias("asks"))
    rows = docs.join(asks, docs[key] == F.col("key")).select("_id", "_tie", "asks", "_text")
    bodies = _slices()("_text", F.col("asks.start"), F.col("asks.end"))
    rows = rows.select("_id", "_tie", F.explode(F.arrays_zip("asks", bodies.alias("body"))).alias("c"))
    got = F.col("c.asks")
    return rows.select(
        got["anchor"].alias("anchor"), got["n_ctx"].alias("n_ctx"), F.col("_id").alias("doc_id"),
        F.col("_tie").alias("tie"), got["start"].alias("start"),
        (got["at"] - got["start"]).cast("int").alias("off"), F.col("c.body").alias("body"))


def _repeat_spans(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """``doc_id, tie, start, end`` of the repeats found in shards."""
    dealt = ["anchor", "doc_id", "tie", "start", "off", "body"]
    shared = contexts.filter(F.col("n_ctx") <= HOT_CONTEXTS).select(*dealt)
    hot = contexts.filter(F.col("n_ctx") > HOT_CONTEXTS).withColumns(
        {"lo": F.lit(0), "hi": F.lit(length - k)})
    found = []
    while True:
        fine, rows = materialized_counted(_narrowed(hot, length), "narrowed")
        if not rows:
            break
        heads = materialized(fine.groupBy("anchor", "ctx").agg(
            F.min(_place()).alias("first"),
            *[F.max(c).alias(c) for c in ("off", "lo", "hi", "body")]), "narrow_heads")
        h = heads.select(F.col("anchor").alias("ha"), F.col("ctx").alias("hc"), "first")
        later = (fine.join(h, (F.col("anchor") == F.col("ha")) & (F.col("ctx") == F.col("hc")))
                 .filter(_place() != F.col("first")))
        found.append(later.select("doc_id", "tie", F.col("at").alias("start"),
                                  (F.col("at") + F.length("body")).alias("end")))
        several = materialized(heads.groupBy(F.col("anchor").alias("a")).agg(F.count(F.lit(1)).alias("n"))
                               .filter("n > 1"), "narrow_split")
        split = (heads.join(several, F.col("anchor") == F.col("a"))
                 .select("anchor", "first.doc_id", "first.tie", F.col("first.at").alias("start"),
                         "off", "body", "lo", "hi", "n"))
        shared = shared.unionByName(split.filter(F.col("n") <= HOT_CONTEXTS).select(*dealt))
        hot = split.filter((F.col("n") > HOT_CONTEXTS) & (F.col("lo") < F.col("hi")))
    return reduce(DataFrame.unionByName, found, shard_spans(shared, length))


def _span_lists(keyed: DataFrame, packed: DataFrame, key: str, length: int, k: int) -> DataFrame:
    """``key, starts, ends`` of each document with repeats.  The tables that
    it takes to find them are deleted, each step's when the next is written."""
    spark = keyed.sparkSession
    found = occurrences(keyed.select(F.col("_id").alias("doc_id"), F.col("_tie").alias("tie"), "text"),
                        length, k)
    with scratch_scope(spark) as tables:
        later, open_ = split_contexts(sorted_occurrences(found))
        with scratch_scope(spark) as shards:
            contexts = materialized(_contexts(packed.select("_id", "_tie", "_text"), key, open_), "contexts")
            repeats = materialized(_repeat_spans(contexts, length, k), "repeats")
            shards.pop()  # the last one made stays
        name = F.col("doc_id" if key == "_id" else "tie").alias("key")
        small = [F.col(c).cast("int").alias(c) for c in ("start", "end")]
        lists = later.unionByName(repeats).select(name, *small).groupBy("key").agg(
            F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
        lists = materialized(lists, "span_lists")
        tables.pop()
    return lists


def _cut(docs: DataFrame, length: int, k: int) -> DataFrame:
    """``docs`` with ``_cut``: size, bytes kept and spans removed."""
    keyed, key = _keyed(docs)
    packed = keyed.withColumn("_text", _packed()("text"))
    rows = _joined(packed.drop("text"), _span_lists(keyed, packed, key, length, k), key)
    if key == "_id":
        rows = rows.withColumn("copy", F.lit(1))
    else:
        same = Window.partitionBy("_tie").orderBy(F.lit(0))
        rows = rows.withColumn("copy", F.row_number().over(same))
    return rows.withColumn("_cut", _cutter(length)("_text", "copy", "starts", "ends"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` and ``removed``, the spans themselves."""
    ship_package(docs.sparkSession)
    rows = _cut(docs.select("doc_id", "text"), length, k)
    n_bytes = F.col("_cut.n")
    return rows.select(
        F.col("_id").alias("doc_id"), n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("_cut.kept")).cast("long").alias("n_removed"),
        F.size("_cut.removed").cast("long").alias("n_spans"),
        F.sha2("_cut.kept", 256).alias("kept_sha256"), F.col("_cut.removed").alias("removed"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` (null stays null) and
    ``n_chars``, where there is one, counted anew."""
    ship_package(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("d")
    known = F.col("text").isNotNull().alias("known")
    rows = _cut(docs.select(row, "doc_id", "text", known), length, k)
    left = F.when(F.col("known"), _decoder()("_cut.kept"))
    rows = rows.select("d", left.alias("text"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col(f"d.`{c}`")

    return rows.select(*[column(c) for c in docs.columns])
