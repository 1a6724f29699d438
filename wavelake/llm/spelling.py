"""Spelling variant grouping by finite-state composition.

Words at a distance of exactly one inserted, deleted or replaced code point are
the pairs that the composition *vocabulary acceptor . one-edit transducer .
vocabulary acceptor* accepts.  The composition is partitioned by its initial
states, so that no task holds the vocabulary:

* For each length of the longer word, a pair shares that length's first half,
  or else (the edit is in front) its second half.  Words are dealt by either
  half, once for the lengths that they can have in a pair: a group per half.
* A group with more than ``GROUP_WORDS`` words or ``GROUP_CHARS`` characters is
  dealt again by the halves of what is left between the group's common prefix
  and suffix.  What is left halves each time, down to one code point, where a
  group cannot exceed the alphabet.

Within a group the minimal acceptor of the remaining parts is built (states
with equal futures are one state), and composed along its paths: at every state
reached by copying, the transducer replaces one symbol by another or drops one
symbol, and then copies to the end, which walks the common futures of two
states.  A dropped symbol must not equal the next one copied, so every pair is
accepted by one path only; group rules see to it that it is in one group only.

A word's form is its near word of the largest count; forms are followed by
pointer doubling.

Defined cases: null text has no words; a null id counts as an empty one in the
hash; repeated rows count like any others; very long runs are words like any
other; equal counts go to the smaller word in code-point order; a word without
a form is its own root; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wavelake.llm.common import map_rows, materialized, materialized_counted
from wavelake.session import ship_package

MIN_LENGTH = 5
MIN_COUNT = 3
FORM_RATIO = 2
TYPO_MODULUS = 97
GROUP_WORDS = 128
GROUP_CHARS = 1 << 16
_BLOCK = 8 << 20     # characters whose words are counted at a time
_SHORT = 128         # bytes of a run up to which checksums are combined by table
_EMIT_ROWS = 20_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32
                 for c in range(256))


def _crc_steps() -> np.ndarray:
    """The checksum's step for every low byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> np.uint32(1) ^ np.uint32(0xEDB88320), steps >> np.uint32(1))
    return steps


_CRC = _crc_steps()
_GROUP = ["a", "b", "below", "longest"]


# -------------------------------------------------------------- vocabulary

class _Words:
    """Words of the texts that one task reads, a block of characters at a time,
    on arrays.

    Runs are made of Latin-1 letters: a text becomes Latin-1 bytes in which all
    but lower-cased letters are spaces.  The hash of ``<doc_id>:<run>`` is put
    together from those of both parts, since a checksum of a string after a
    prefix differs from the string's own by a value that depends on the prefix
    and the string's length only."""

    def __init__(self, min_length: int, modulus: int):
        self.min_length, self.modulus = min_length, modulus
        self.parts: list[bytes] = []
        self.seeds: list[int] = []
        self.held = 0

    def add(self, doc_id: str, text: str) -> Iterator[tuple[list[str], list[int]]]:
        raw, seed = text.encode("latin-1", "replace").translate(_LETTERS), zlib.crc32(f"{doc_id}:".encode())
        start = 0
        while start < len(raw):
            end = raw.find(b" ", start + _BLOCK - self.held)  # no run is cut
            end = len(raw) if end < 0 else end
            self.parts.append(raw[start:end])
            self.seeds.append(seed)
            self.held += end - start
            start = end
            if self.held >= _BLOCK:
                yield self.counted()

    def counted(self) -> tuple[list[str], list[int]]:
        """Words of the block and their numbers (a word that lost a letter each
        time has number 0); the next block begins."""
        text = b" ".join([b"", *self.parts, b""])
        sizes = np.array([len(p) + 1 for p in self.parts])
        seeds = np.array(self.seeds, dtype=np.uint32)
        self.parts, self.seeds, self.held = [], [], 0
        raw = np.frombuffer(text, dtype=np.uint8)
        letter = raw != 32
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        begin, end = edges[0::2], edges[1::2]
        kept = end - begin >= self.min_length
        begin, end = begin[kept], end[kept]
        if not len(begin):
            return [], []
        part = np.searchsorted(np.cumsum(sizes) + 1, begin, side="right")
        inside = np.zeros(len(raw), dtype=np.int8)
        inside[begin], inside[end] = 1, -1
        letters = raw[np.cumsum(inside, dtype=np.int8).view(bool)]
        offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(begin), [
            None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        which = runs.indices.to_numpy()
        _, bounds, letters = runs.dictionary.buffers()
        letters = letters.to_pybytes().decode("latin-1")
        bounds = np.frombuffer(bounds, dtype=np.int32)[:len(runs.dictionary) + 1].tolist()
        words = [letters[i:j] for i, j in zip(bounds, bounds[1:])]
        coded = [w.encode() for w in words]
        sums = np.array([zlib.crc32(c) for c in coded], dtype=np.uint32)
        sizes = np.array([len(c) for c in coded])
        h = sums[which] ^ _after_prefix(seeds, part, sizes[which])
        typo = h % np.uint32(self.modulus) == 0
        counts = np.bincount(which[~typo], minlength=len(words)).tolist()
        shorter: Counter = Counter()
        for k, at in zip(which[typo].tolist(), h[typo].tolist()):
            word = words[k]
            at %= len(word)
            if len(word) > self.min_length:
                shorter[word[:at] + word[at + 1:]] += 1
        return words + list(shorter), counts + list(shorter.values())


def _after_prefix(seeds: np.ndarray, part: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the checksum of ``sizes`` bytes changes by when they follow the
    prefix whose checksum is ``seeds[part]``: the same as for zero bytes."""
    short = sizes <= _SHORT
    out = np.empty(len(sizes), dtype=np.uint32)
    state, plain = ~seeds, 0
    table = np.empty((int(sizes[short].max(initial=0)) + 1, len(seeds)), dtype=np.uint32)
    for n in range(len(table)):
        table[n] = ~state ^ np.uint32(plain)
        state = _CRC[state & 255] ^ (state >> np.uint32(8))
        plain = zlib.crc32(b"\0", plain)
    out[short] = table[sizes[short], part[short]]
    for i in np.flatnonzero(~short).tolist():
        zeros = bytes(int(sizes[i]))
        out[i] = zlib.crc32(zeros, int(seeds[part[i]])) ^ zlib.crc32(zeros)
    return out


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
               modulus: int = TYPO_MODULUS) -> DataFrame:
    """``word, n``: words of at least ``min_length`` code points that occur at
    least ``min_count`` times in ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(min_length, modulus)

        def emitted(found: tuple[list[str], list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()),
                                               pa.array(found[1], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if text.is_valid:
                    yield from map(emitted, words.add(doc_id.as_py() or "", text.as_py()))
        if words.parts:
            yield emitted(words.counted())

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (rows.mapInArrow(run, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# ------------------------------------------------------- composition

class Acceptor:
    """Minimal acyclic acceptor of sorted distinct strings."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # (state, symbol, next) of the last word
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._settle(path, same, register)
            state = path[-1][2] if path else 0
            for symbol in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[state][symbol] = len(self.arcs) - 1
                path.append((state, symbol, len(self.arcs) - 1))
                state = len(self.arcs) - 1
            self.final[state] = True
            last = word
        self._settle(path, 0, register)

    def _settle(self, path, keep: int, register: dict) -> None:
        """States behind the first ``keep`` symbols will not change: each is
        replaced by the known state of equal future, if there is one."""
        while len(path) > keep:
            state, symbol, then = path.pop()
            future = (self.final[then], tuple(self.arcs[then].items()))
            self.arcs[state][symbol] = register.setdefault(future, then)

    def common(self, r: int, s: int, without: str | None = None) -> Iterator[str]:
        """Strings that lead from both states to a final one; ``without`` is
        not their first symbol."""
        stack = [(r, s, "")]
        while stack:
            r, s, done = stack.pop()
            if self.final[r] and self.final[s]:
                yield done
            right = self.arcs[s]
            for symbol, then in self.arcs[r].items():
                if symbol in right and symbol != without:
                    stack.append((then, right[symbol], done + symbol))
            without = None

    def near_pairs(self, depth: int, tail: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition with one edit between, which
        follows fewer than ``depth`` copied symbols; each pair once, the
        longer string first.  ``tail`` follows all strings."""
        stack = [(0, "")]
        while stack:
            p, done = stack.pop()
            arcs = list(self.arcs[p].items())
            for i, (c, after_c) in enumerate(arcs):
                for d, after_d in arcs[:i]:
                    for rest in self.common(after_c, after_d):
                        yield f"{done}{c}{rest}", f"{done}{d}{rest}"
                for rest in self.common(after_c, p, without=c):
                    if rest or not tail.startswith(c):
                        yield f"{done}{c}{rest}", f"{done}{rest}"
                if len(done) + 1 < depth:
                    stack.append((after_c, done + c))


def _rest() -> Column:
    """Code points of a word between its group's prefix and suffix."""
    return F.length("word") - F.length("a") - F.length("b")


def _halved(members: DataFrame) -> DataFrame:
    """The groups' words, dealt again by either half of what is left."""
    length, a, b = F.length("word"), F.length("a"), F.length("b")
    longest = F.explode(F.when(F.col("longest") > 0, F.array("longest"))
                        .otherwise(F.array(length, length + 1)))
    rows = members.select("word", "n", "a", "b", "below", longest.alias("longest"))
    rows = rows.withColumn("left", F.col("longest") - a - b)
    rows = rows.withColumn("half", F.floor(F.col("left") / 2).cast("int")).filter("half > 0")
    cut = a + F.col("half")                    # code points before the edit, or more
    tail = b + F.col("left") - F.col("half")   # or else these at the end
    below = F.col("below")
    groups = F.array(
        F.when(cut < below, F.struct(
            F.substring(F.col("word"), F.lit(1), cut).alias("a"), F.col("b"), below.alias("below"))),
        F.struct(F.col("a"), F.substring(F.col("word"), length - tail + 1, tail).alias("b"),
                 F.least(below, cut).alias("below")))
    return (rows.select("word", "n", "longest", F.explode(groups).alias("g")).filter("g is not null")
            .select("word", "n", "g.*", "longest"))


def _group_pairs(key: tuple, members: list[tuple[str, int]]) -> Iterator[tuple[str, str, int]]:
    """Near pairs of one group, both ways."""
    a, b, below, longest = key
    counts = dict(members)
    rests = sorted({w[len(a):len(w) - len(b)] for w in counts})
    for left, right in Acceptor(rests).near_pairs(below - len(a), b):
        left, right = f"{a}{left}{b}", f"{a}{right}{b}"
        if not longest or max(len(left), len(right)) == longest:
            yield left, right, counts[right]
            yield right, left, counts[left]


def _compose(batches: Iterator[pd.DataFrame], best: bool) -> Iterator[pd.DataFrame]:
    """Near pairs of groups whose rows come one after the other; with ``best``
    each word's number of near words in its group, and the best of them."""
    rows = (row for pdf in batches
            for row in zip(*(pdf[c].tolist() for c in (*_GROUP, "word", "n"))))
    columns = ["word", "near", "near_n", *(["n_near"] if best else [])]
    found: list[tuple] = []
    for key, group in groupby(rows, key=itemgetter(0, 1, 2, 3)):
        pairs = _group_pairs(key, [row[4:] for row in group])
        found += _best_of(pairs) if best else pairs
        if len(found) > _EMIT_ROWS:
            yield pd.DataFrame(found, columns=columns)
            found = []
    if found:
        yield pd.DataFrame(found, columns=columns)


def _best_of(pairs: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, int, int]]:
    """Per word the near word of the largest count (ties: the smallest), its
    count and the number of near words."""
    held: dict[str, tuple[int, str, int]] = {}
    for word, near, n in pairs:
        less, name, number = held.get(word, (0, "", 0))
        if (-n, near) < (less, name):
            less, name = -n, near
        held[word] = (less, name, number + 1)
    for word, (less, name, number) in held.items():
        yield word, name, -less, number


def _composed_groups(words: DataFrame, min_length: int, group_words: int,
                     group_chars: int) -> DataFrame:
    """Members (``word, n`` and their group) of all groups, dealt by group."""
    if min_length < 2:
        raise ValueError("words need two code points at least")
    everything = words.select("word", "n", F.lit("").alias("a"), F.lit("").alias("b"),
                              F.lit(1 << 30).alias("below"), F.lit(0).alias("longest"))
    members, ready = _halved(everything), None
    while True:
        sizes = (members.groupBy(*_GROUP)
                 .agg(F.count(F.lit(1)).alias("words"), F.sum(_rest()).alias("chars"),
                      F.max(_rest()).alias("most")).filter("words > 1"))
        hot = (((F.col("words") > group_words) | (F.col("chars") > group_chars))
               & (F.col("most") > 1))
        sized = sizes.select(*[F.col(c).alias(f"s_{c}") for c in _GROUP], hot.alias("hot"))
        same = None
        for c in _GROUP:
            here = F.col(c) == F.col(f"s_{c}")
            same = here if same is None else same & here
        placed = materialized(members.join(sized, same).select("word", "n", *_GROUP, "hot"),
                              "spelling_groups")
        small = placed.filter("not hot").drop("hot")
        ready = small if ready is None else ready.unionByName(small)
        left, n = materialized_counted(_halved(placed.filter("hot")), "spelling_halves")
        if not n:
            break
        members = left
    return ready.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS,
               group_chars: int = GROUP_CHARS) -> DataFrame:
    """``word, near, near_n``: all pairs (both ways) of the distinct words of
    ``words`` (``word``, ``n``; at least ``min_length`` code points each) that
    differ by one edit."""
    members = _composed_groups(words, min_length, group_words, group_chars)
    return map_rows(members, lambda batches: _compose(batches, False),
                    "word string, near string, near_n long")


def best_near_words(words: DataFrame, min_length: int = MIN_LENGTH,
                    group_words: int = GROUP_WORDS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``word, near, near_n, n_near`` of every word with near words: the one of
    the largest count (ties: the smallest), and their number.  Groups pass on
    one row a word."""
    members = _composed_groups(words, min_length, group_words, group_chars)
    found = map_rows(members, lambda batches: _compose(batches, True),
                     "word string, near string, near_n long, n_near long")
    return (found.groupBy("word").agg(
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
        F.sum("n_near").alias("n_near"))
        .select("word", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"), "n_near"))


# ------------------------------------------------------------------- forms

def variant_forms(words: DataFrame, best: DataFrame, ratio: float = FORM_RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word: the near word of
    the largest count, if that is at least ``ratio`` times the word's own."""
    if ratio <= 1:
        raise ValueError("counts must grow along forms: ratio above 1")
    joined = words.join(best.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    big = F.col("near_n") >= F.col("n") * F.lit(ratio)
    formed = materialized(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(big, F.col("near")).alias("form"), F.when(big, F.col("near_n")).alias("form_n")), "forms")
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken
        roots = materialized(roots, "roots")
        ahead = roots.select(F.col("word").alias("mid"), F.col("root").alias("far"))
        moved = Observation("wl_spelling_roots")
        nearer = (roots.join(ahead, F.col("root") == F.col("mid"), "left")
                  .observe(moved, F.count("far").alias("moved"))
                  .select("word", F.coalesce("far", "root").alias("root")))
        roots = materialized(nearer, "roots")
        if not moved.get["moved"]:
            break
    ends = roots.select(F.col("word").alias("of"), "root")
    return (formed.join(ends, F.col("word") == F.col("of"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: float = FORM_RATIO, modulus: int = TYPO_MODULUS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = materialized(vocabulary(docs, min_length, min_count, modulus), "vocabulary")
    return variant_forms(words, best_near_words(words, min_length), ratio)
