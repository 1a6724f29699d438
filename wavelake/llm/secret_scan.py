"""Secret scans by a recursive decoding worklist.

Every text is scanned for assignments, access keys and long hex runs.  Then the
text is unwrapped: a worklist holds layers, and each layer taken from it is
scanned and gives new ones by four rules:

* URL escapes (``%41``) and Unicode escapes (``\\u0041``, ``\\x41``, ``&#65;``):
  the lines from the first to the last escape, decoded once (after
  ``ONE_BY_ONE`` such layers: decoded until none is left);
* base64 runs, also URL-safe and wrapped over lines, at each of the four
  alignments (a run may begin with letters of its surroundings): the printable
  stretches of the decoded bytes;
* gzip, zlib, bzip2, xz and zstd streams inside decoded bytes, and directly
  inside each other: the decompressed bytes.

It ends when no layer gives a new one.  Layers seen before at the same place
are not taken again, and a chain of streams stops at a stream that it has
passed (a stream can decompress to itself).  A layer knows how its characters
map to its parent, so a match is carried back to code points of the text;
matches in a decompressed layer take the whole encoded run.  A decoded layer
adds only spans that hold decoded characters.

Decoded bytes are read one character a byte: everything searched for is ASCII.
Decompressed bytes are read in windows of ``WINDOW`` characters that overlap by
``OVERLAP``, so that memory does not depend on how far a stream expands; a
secret or run longer than the overlap may be cut at a window's edge.

Defined cases: null and empty texts have no spans; repeated rows give a row
each; a null id stays null; malformed escapes, runs and streams are left as
they are (a broken stream is read as far as it goes); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import batches_of, map_rows

WINDOW = 4 << 20
OVERLAP = 64 << 10
KINDS = ("assign", "access", "hex")
MIN_VALUE = 6      # characters of an assigned value
MIN_RUN = 16       # characters of a base64 run that is decoded
MIN_STRETCH = 8    # printable bytes in a row that make a layer
ONE_BY_ONE = 16    # escapes nested deeper are removed to the end in one step

# What counts as a secret.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                     r"([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})"
                      r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_RUN = re.compile(r"(?:[A-Za-z0-9+/_-]{40,}\r?\n)*[A-Za-z0-9+/_-]{%d,}" % MIN_RUN)
_STRETCH = re.compile(rb"[\x09\x0a\x0d\x20-\x7e]{%d,}" % MIN_STRETCH)
_STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_ZLIB = re.compile(rb"\x78[\x01\x5e\x9c\xda]")


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """``kind, start, end`` of the secrets that stand openly in ``text``."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_VALUE:  # a short value still uses up its text
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


# ----------------------------------------------------------------- layers

class Layer:
    """A text and its place in the layer it was decoded from (``parent``;
    None: the document itself)."""

    text: str
    parent: Layer | None = None
    escapes = 0   # layers of escapes removed one by one on the way here

    def local(self, start: int, end: int) -> tuple[int, int] | None:
        """The span's place in the parent; None if it holds nothing decoded."""
        raise NotImplementedError

    def origin(self, start: int, end: int, decoded: bool = False) -> tuple[int, int] | None:
        """The span's place in the document, None if no layer on the way
        decoded any of it."""
        layer = self
        while layer.parent is not None:
            (start, end), here = layer.local(start, end)
            layer, decoded = layer.parent, decoded or here
        return (start, end) if decoded else None


class Document(Layer):
    def __init__(self, text: str):
        self.text = text


class Unescaped(Layer):
    """Lines of the parent with their escapes decoded."""

    def __init__(self, parent: Layer, found: list[tuple[int, int, str]]):
        text = parent.text
        first = text.rfind("\n", 0, found[0][0]) + 1
        last = text.find("\n", found[-1][1])
        last = len(text) if last < 0 else last
        self.parent, self.escapes, parts, at = parent, parent.escapes + 1, [], first
        self.starts, self.lows, self.highs = [], [], []  # of each decoded character
        shift = first
        for low, high, char in found:
            parts += [text[at:low], char]
            self.starts.append(low - shift)
            self.lows.append(low)
            self.highs.append(high)
            shift += high - low - 1
            at = high
        self.first = first
        self.text = "".join([*parts, text[at:last]])

    def _place(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return self.first + i, self.first + i + 1
        if self.starts[k] == i:
            return self.lows[k], self.highs[k]
        low = self.highs[k] + i - self.starts[k] - 1
        return low, low + 1

    def local(self, start, end):
        lo, hi = self._place(start)[0], self._place(end - 1)[1]
        return (lo, hi), hi - lo != end - start


def _character(m: re.Match) -> str:
    if m.re is _URL:
        return chr(int(m[1], 16))
    *codes, decimal = m.groups()
    code = int(decimal) if decimal else int(next(c for c in codes if c), 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd"


class Unpacked(Layer):
    """Printable bytes ``first`` and on of a base64 run; ``places`` are the
    parent's positions of the run's characters."""

    def __init__(self, parent: Layer, text: str, places, first: int):
        self.parent, self.text, self.places, self.first = parent, text, places, first

    def local(self, start, end):
        start, end = start + self.first, end + self.first
        return (self.places[start * 4 // 3], self.places[(end * 4 + 2) // 3 - 1] + 1), True


class Inflated(Layer):
    """A window of a decompressed stream; all of it stands for the run."""

    def __init__(self, parent: Layer, text: str, start: int, end: int):
        self.parent, self.text, self.run = parent, text, (start, end)

    def local(self, start, end):
        return self.run, True


# ------------------------------------------------------------------ rules

def _unescaped(layer: Layer) -> list[Layer]:
    out = []
    for pattern, marks in ((_URL, ("%",)), (_UNICODE, ("\\u", "\\x", "&#"))):
        if any(m in layer.text for m in marks):
            if layer.escapes < ONE_BY_ONE:
                found = [(m.start(), m.end(), _character(m)) for m in pattern.finditer(layer.text)]
            else:
                found = _all_escapes(layer.text, pattern)
            if found:
                out.append(Unescaped(layer, found))
    return out


def _all_escapes(text: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """Escapes of all depths at once, from the right: a decoded character may
    begin an escape or be a digit of one."""
    chars, lows, highs = [], [], []   # of what stands to the right, nearest last
    for i in range(len(text) - 1, -1, -1):
        char, high = text[i], i + 1
        while char in "%\\&" and (m := pattern.match(char + "".join(chars[:-13:-1]))):
            char, used = _character(m), m.end() - 1
            high = highs[-used]
            del chars[-used:], lows[-used:], highs[-used:]
        chars.append(char)
        lows.append(i)
        highs.append(high)
    return [(lo, hi, c) for c, lo, hi in zip(reversed(chars), reversed(lows), reversed(highs))
            if hi > lo + 1]


def _unpacked(layer: Layer) -> Iterator[Layer]:
    for m in _RUN.finditer(layer.text):
        run, places = m[0], range(m.start(), m.end())
        if "\n" in run:
            kept = [i for i, c in enumerate(run) if c not in "\r\n"]
            run, places = "".join(run[i] for i in kept), [m.start() + i for i in kept]
        run = run.replace("-", "+").replace("_", "/")
        for shift in range(4):
            body = run[shift:]
            body = body[:len(body) - (len(body) % 4 == 1)]
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            for s in _STRETCH.finditer(data):
                yield Unpacked(layer, s[0].decode("latin-1"), places[shift:], s.start())
            heads = [s.start() for s in _STREAM.finditer(data)]
            for head in heads + [0] * bool(_ZLIB.match(data)):
                for text in _windows(_stream(iter([data[head:]]))):
                    yield Inflated(layer, text, m.start(), m.end())
    layer.text = ""  # its places are still needed


def _stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Decompressed bytes, through as many compressions as are nested."""
    passed = set()
    while True:
        head = next(chunks, b"")
        key = hashlib.sha1(head[:OVERLAP]).digest()
        if not (_STREAM.match(head) or _ZLIB.match(head)):
            yield head
            yield from chunks
            return
        if key in passed:
            return
        passed.add(key)
        chunks = _inflated(chain([head], chunks), head)


def _inflated(chunks: Iterator[bytes], head: bytes) -> Iterator[bytes]:
    """One compression removed, in chunks of at most ``OVERLAP`` bytes."""
    if head.startswith(b"BZh"):
        codec, errors = bz2.BZ2Decompressor(), OSError
    elif head.startswith(b"\xfd7z"):
        codec, errors = lzma.LZMADecompressor(), lzma.LZMAError
    elif head.startswith(b"\x28\xb5"):
        import zstandard

        yield from _unzstd(chunks, zstandard)
        return
    else:
        codec, errors = zlib.decompressobj(47), zlib.error
    try:
        for chunk in chunks:
            if errors is zlib.error:
                while chunk:
                    yield codec.decompress(chunk, OVERLAP)
                    chunk = codec.unconsumed_tail
                    if codec.eof:
                        return
            else:
                yield codec.decompress(chunk, OVERLAP)
                while not codec.needs_input and not codec.eof:
                    yield codec.decompress(b"", OVERLAP)
                if codec.eof:
                    return
    except (errors, EOFError):
        return


class _Readable:
    """Chunks as a file that a decompressor reads from."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def read(self, n: int) -> bytes:
        if not self.held:
            self.held = next(self.chunks, b"")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _unzstd(chunks: Iterator[bytes], zstandard) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(_Readable(chunks))
    try:
        while part := reader.read(OVERLAP):
            yield part
    except zstandard.ZstdError:
        return


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    held, fresh = b"", 0
    for chunk in chunks:
        held, fresh = held + chunk if held else chunk, fresh + len(chunk)
        if len(held) >= WINDOW:
            yield held.decode("latin-1")
            held, fresh = held[-OVERLAP:], 0
    if fresh:
        yield held.decode("latin-1")


# --------------------------------------------------------------- worklist

def secret_spans(text: str | None) -> tuple[list, list]:
    """``base, added``: the spans found in the text itself, and those that
    only its decoded layers show, as sorted ``(start, kind's number, end)``."""
    document = Document(text or "")
    number = {kind: i for i, kind in enumerate(KINDS)}
    base = sorted((s, number[kind], e) for kind, s, e in scan(document.text))
    known, seen, added = set(base), set(), []
    work: list[Iterator[Layer]] = [iter(_unescaped(document)), _unpacked(document)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = (hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest(),
               layer.origin(0, len(layer.text), True))
        if key in seen:
            continue
        seen.add(key)
        for kind, s, e in scan(layer.text):
            place = layer.origin(s, e)
            if place is not None:
                span = (place[0], number[kind], place[1])
                if span not in known:
                    known.add(span)
                    added.append(span)
        work += [iter(_unescaped(layer)), _unpacked(layer)]
    return base, sorted(added)


SPAN_SCHEMA = "array<struct<start: long, kind: int, end: long>>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` per row of ``docs`` (``doc_id``, ``text``):
    spans ``start, kind, end`` in code points, end exclusive; ``kind`` numbers
    :data:`KINDS`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def structs(spans):
            return [{"start": s, "kind": k, "end": e} for s, k, e in spans]

        for pdf in (part for whole in batches for part in batches_of(whole, "text", 8 << 20)):
            found = [secret_spans(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy(),
                                "base": [structs(b) for b, _ in found],
                                "added": [structs(a) for _, a in found]})

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    f"doc_id long, base {SPAN_SCHEMA}, added {SPAN_SCHEMA}")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(i):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    everything = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(everything).alias("spans"))
