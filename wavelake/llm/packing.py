"""Best-fit packing: token sequences filled by best-fit decreasing.

1. Every document is tokenized in Arrow batches (byte-level BPE, one end id
   after each document) and cut into pieces of at most ``capacity`` ids; only
   documents longer than that are cut, the remainder in front.
2. The pieces (a few numbers each) are written once and dealt round-robin into
   shards of a fixed size, so that a run of equal documents cannot fill one.
3. Each shard is packed by best-fit decreasing.  A segment tree over the
   remaining capacities 0..capacity holds the open bins; the tightest bin that
   takes a piece is found in ``log2(capacity)`` steps.

Every shard leaves at most a few bins partly filled, out of the thousands it
fills, so the loss against one global packing is below ``bins / shard_rows``.

Ids travel with their piece as compressed bytes (two bytes an id where the
vocabulary allows), through one store and one shuffle, and become an array in
the rows that a shard returns.

Defined cases: null or empty text packs as the end id alone; repeated rows and
repeated ids are packed as separate documents; an added token of the file (like
an end-of-text mark) that stands in a text gets its own id, as the file says;
texts without white space are tokenized like any other and not remembered; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import batches_of, map_rows, materialized_counted, parts_for

CAPACITY = 2048
END_ID = 0
SHARD_ROWS = 16_384
_CACHE_BYTES = 64 << 20   # of chunks and their ids that a worker remembers
_ENTRY_BYTES = 200        # of a remembered chunk besides its characters and ids
_LONGEST_CHUNK = 64       # longer chunks are not remembered

PIECE_SCHEMA = ("doc_id long, piece int, start long, length long, "
                "ids_crc32 long")


# ------------------------------------------------------------- tokenizing

class BpeTokenizer:
    """Ids of a byte-level BPE given as a ``tokenizers`` JSON file.

    The merge work is done by ``tiktoken`` on the same vocabulary (the ids are
    equal, see the tests) and remembered per space-delimited chunk.  A chunk
    is tokenized on its own only where its neighbours cannot matter: it has
    no white space at either end, so the single spaces around it belong to it
    and to its successor.  Any other document is tokenized whole.  Added tokens
    are cut out first; what stands between two of them is a text of its own."""

    def __init__(self, spec: dict, pattern: str):
        import tiktoken

        byte_of = {c: b for b, c in _byte_alphabet().items()}
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t for t in spec.get("added_tokens", ())}
        if any(t.get(k) for t in added.values()
               for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self._added = {c: np.array([t["id"]], dtype="<u4").tobytes() for c, t in added.items()}
        self._cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))
                               or "(?!)")
        ranks = {bytes(byte_of[c] for c in tok): i for tok, i in vocab.items()
                 if tok not in added}
        self._enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})
        self._chunks: dict[str, bytes] = {}
        self._held = 0

    def _whole(self, text: str) -> bytes:
        ids = self._enc.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self._cut.search(text):
            return self._between(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += [self._between(text[at:m.start()]), self._added[m[0]]]
            at = m.end()
        return b"".join([*out, self._between(text[at:])])

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = text.split(" ")
        if len(chunks) < 4:
            return self._whole(text)
        known = self._chunks
        head = chunks[0]
        if not head or head[-1].isspace():
            return self._whole(text)
        out = [self._whole(head)]
        rest = chunks[1:]
        try:
            out.extend(map(known.__getitem__, rest))
            return b"".join(out)
        except KeyError:
            pass
        del out[1:]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    return self._whole(text)
                ids = self._whole(" " + chunk)
                if len(chunk) <= _LONGEST_CHUNK:
                    self._remember(chunk, ids)
            out.append(ids)
        return b"".join(out)

    def _remember(self, chunk: str, ids: bytes) -> None:
        size = _ENTRY_BYTES + 4 * len(chunk) + len(ids)
        if self._held + size > _CACHE_BYTES:
            self._chunks.clear()
            self._held = 0
        self._chunks[chunk] = ids
        self._held += size


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins that byte-level vocabularies use for raw bytes:
    visible Latin-1 characters stand for themselves, the others are numbered
    from code point 256 on."""
    shown = [b for b in range(256)
             if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


# Fixed value: the split pattern of this vocabulary.
BYTE_BPE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                    r"|\s+(?!\S)|\s+")

_LOADED: dict[int, BpeTokenizer] = {}


def _tokenizer(spec_json: str) -> BpeTokenizer:
    key = zlib.crc32(spec_json.encode())
    if key not in _LOADED:
        _LOADED[key] = BpeTokenizer(json.loads(spec_json), BYTE_BPE_PATTERN)
    return _LOADED[key]


def piece_bounds(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at the end, the
    remainder first."""
    first = n_ids % capacity or capacity
    bounds = [(0, min(first, n_ids))]
    bounds += [(s, capacity) for s in range(first, n_ids, capacity)]
    return bounds


def packed_ids(raw: bytes) -> bytes:
    """Ids (little-endian unsigned 32-bit) compressed: a byte that tells the
    width, and the ids in two bytes each if all fit."""
    ids = np.frombuffer(raw, "<u4")
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    body = ids.astype("<u2").tobytes() if narrow else raw
    return (b"\x02" if narrow else b"\x04") + zlib.compress(body, 1)


def unpacked_ids(packed: bytes) -> np.ndarray:
    body = zlib.decompress(packed[1:])
    return np.frombuffer(body, f"<u{packed[0]}").astype(np.int32)


_SLICE = 4 << 20  # characters tokenized before their pieces are passed on


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``
    and, on request, ``packed``: the ids as :func:`packed_ids`.
    ``tokenizer_json`` is the content of the tokenizer's file (2 MB, sent to
    the executors once)."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(spec.value).encode
        for pdf in (part for whole in batches for part in batches_of(whole, "text", _SLICE)):
            rows, ids = [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                raw = encode(text or "") + end
                for k, (start, n) in enumerate(piece_bounds(len(raw) // 4, capacity)):
                    part = raw[4 * start:4 * (start + n)]
                    rows.append((doc_id, k, start, n, zlib.crc32(part)))
                    if with_ids:
                        ids.append(packed_ids(part))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            if with_ids:
                out["packed"] = ids
            yield out

    schema = PIECE_SCHEMA + (", packed binary" if with_ids else "")
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                    run, schema)


# --------------------------------------------------------------- packing

class OpenBins:
    """Open bins by remaining capacity, in a segment tree: ``tightest(n)`` is
    the smallest remaining capacity >= n of any open bin, in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, change: int) -> None:
        node = remaining + self.leaves
        while node:
            self.count[node] += change
            node //= 2

    def push(self, remaining: int, bin_id: int) -> None:
        self.bins[remaining].append(bin_id)
        self._add(remaining, 1)

    def pop(self, remaining: int) -> int:
        self._add(remaining, -1)
        return self.bins[remaining].pop()

    def tightest(self, need: int) -> int | None:
        count, node = self.count, need + self.leaves
        if count[node]:
            return need
        while node > 1:  # climb until a right neighbour holds an open bin
            if node % 2 == 0 and count[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:  # then down to its leftmost one
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; longest first, ties in the given order,
    each into the tightest open bin that takes it, else into a new one."""
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    tree, n_bins = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room = tree.tightest(n)
        if room is None:
            room, target, n_bins = capacity, n_bins, n_bins + 1
        else:
            target = tree.pop(room)
        bins[i], offsets[i] = target, capacity - room
        if room > n:
            tree.push(room - n, target)
    return bins, offsets


_EMIT_ROWS = 512  # rows whose ids are unpacked at a time


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``doc_id``, ``piece``
    and ``length`` (at most ``capacity``); other columns are carried along, and
    ``packed`` ids become ``ids``."""
    stored, rows = materialized_counted(pieces, "pieces")
    shards = stored.repartition(parts_for(rows, shard_rows))
    shards = shards.withColumn("_shard", F.spark_partition_id().cast("long"))
    columns = [c for c in pieces.columns if c != "packed"]
    with_ids = "packed" in pieces.columns
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)
    schema += (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)  # shard_rows rows by construction, of at most 4 * capacity bytes
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        out = pdf[columns].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        if with_ids:
            out["ids"] = pdf["packed"]
        out["sequence_id"] = pdf["_shard"].to_numpy() * (1 << 32) + bins
        out["offset"] = offsets
        if not with_ids:
            yield out
            return
        for i in range(0, len(out), _EMIT_ROWS):
            part = out.iloc[i:i + _EMIT_ROWS].copy()
            part["ids"] = [unpacked_ids(p) for p in part["ids"]]
            yield part

    return map_rows(shards, run, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY,
                   end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (``doc_id``, ``text``): one row per
    piece with its place, and its ids unless ``with_ids`` is off."""
    return pack_pieces(token_pieces(docs, tokenizer_json, capacity, end_id, with_ids), capacity)
