"""Main text of web pages by structure and nearest-URL page differencing.

1. Each page is cut into text lines (one per block element), with the lines of
   its article region (``article`` or ``main``) apart from the open ones.
   Scripts, styles, menus, page headers and footers, sidebars, notices,
   adverts, forms and reader comments are left out by element and by the words
   of ``class``, ``id`` and ``role``.
2. Every page is compared with its nearest-URL page: of the line lists that
   stand before and after its own when a host's pages are sorted by path and
   URL, the one with the longer common path prefix.  Equal line lists (print
   versions, mirrors) are one list, at the place of the first, so a page is
   never compared with a copy of itself.  Only hashes of lines are sorted; a hot
   host spreads over many tasks, and neighbours are found by the rows' index, so
   results do not depend on how rows are dealt to tasks.
3. A longest common subsequence aligns the lines of the two.  What both hold is
   the site's, not the page's, and goes, as far as the markup allows: a page
   without an article region loses all of it; in a region, lines of text
   elements (paragraphs, headings, quotations, cells) stay, because articles
   that are copied or quote the same passage share lines too, and what stands
   in bare containers or lists goes unless most of the text elements are shared
   as well (then the neighbour holds a copy of the article).  A region without
   any text element is differenced whole.
4. A neighbour that would leave nothing of a page is a copy of it: the other one
   decides, or none.

Defined cases: null html is empty (empty text); null url is a host of its own;
a page whose host has no other line list keeps its lines; truncated and
unbalanced markup is read as far as it goes (an element left open ends with the
one around it); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import map_rows, materialized
from wavelake.operators.ordering import contiguous_index

# ------------------------------------------------------------------ parsing

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main "
    "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_LEFT_OUT = frozenset(
    "nav footer aside form menu dialog button select svg canvas audio video object iframe".split())
_REGION = frozenset(("article", "main"))
# elements of an article that hold its text
_PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th figcaption caption".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# containers whose class, id and role words count; in a region, these only
_CONTAINERS = frozenset("div section ul ol dl header details".split())
_HINTED = _CONTAINERS | frozenset("p span table td article main figure a".split())
_HINT = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe"
    r"|subscription|share|sharing|social|related|recommended|comments?|disqus|respond|replies"
    r"|widgets?|toolbar|pagination|pager|copyright|search|login|signup|form")
_COMMENT = re.compile(r"comments?|disqus|respond|replies")
# words that say where or how something stands, not what it is
_PLACE = re.compile(
    r"main|site|page|top|bottom|left|right|side|upper|lower|inner|outer|primary|secondary|global|mobile"
    r"|desktop|sticky|box|block|list|items?|links?|bar|bars|buttons?|icons?|wrapper|wrap|container|area"
    r"|section|group|panel|unit|slot|posts|articles|stories|header|body|content|text|meta|author|reply"
    r"|thread|tree|\d+")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

_RAW = "script|style|noscript|template|textarea|title|xmp"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)"
    rf"|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"""|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"|</?[a-z][^<>]*(?:>|$)", re.I | re.S)


def _hinted(attributes: str, hint: re.Pattern = _HINT) -> bool:
    """Whether a class, id or role says that the element is no article text:
    every part of one of its words is a hint or tells a place ("ad",
    "share-buttons", but not "related-work")."""
    if "=" not in attributes:
        return False
    for value in _ATTRIBUTE.findall(attributes):
        for word in "".join(value).lower().split():
            parts = [part for part in re.split(r"[-_]+", word) if part]
            if (any(map(hint.fullmatch, parts))
                    and all(hint.fullmatch(part) or _PLACE.fullmatch(part) for part in parts)):
                return True
    return False


# elements that a sibling of the same name ends
_SINGLE = frozenset("li dd dt td th tr option h1 h2 h3 h4 h5 h6".split())
OPEN, SITE, PROSE = 0, 1, 2  # outside a region; in one, in a container or in a text element


class _Open:
    """Names of the elements that are open, outermost first."""

    def __init__(self):
        self.names: list[str] = []
        self.regions: list[int] = []   # places of article regions

    def begin(self, name: str) -> None:
        inner = self.inner()
        if inner and inner[-1] == "p":  # any block ends a paragraph
            self.names.pop()
            inner = inner[:-1]
        if inner and inner[-1] == name and name in _SINGLE:
            self.names.pop()
        if name in _REGION:
            self.regions.append(len(self.names))
        self.names.append(name)

    def inner(self) -> list[str]:
        """Those within the innermost region."""
        return self.names[self.regions[-1] + 1:] if self.regions else self.names

    def holds(self, name: str) -> bool:
        """Whether an end tag of ``name`` ends anything: a stray one does not
        reach out of an article region."""
        return name in self.names[self.regions[-1]:] if self.regions else name in self.names

    def end(self, name: str) -> None:
        if self.holds(name):
            while self.names.pop() != name:
                pass
            while self.regions and self.regions[-1] >= len(self.names):
                self.regions.pop()


def _left_out(name: str, attributes: str, opened: _Open) -> bool:
    """Whether an element's text is not the article's."""
    if name in _REGION:   # classes of an article name its topic; comments are articles, too
        return _hinted(attributes, _HINT if opened.regions else _COMMENT)
    if name in _LEFT_OUT or name == "header" and not opened.regions:
        return True
    return name in (_CONTAINERS if opened.regions else _HINTED) and _hinted(attributes)


def page_blocks(html: str | None) -> list[tuple[str, int]]:
    """(line, kind) of a page in page order: decoded text per block, white
    space made single, empty blocks dropped.

    An element that is left out ends with its own end tag.  If an element
    around it ends first, it was left open: of what stood in it, text elements
    of an article are kept after all."""
    blocks: list[tuple[str, int]] = []
    if not html:
        return blocks
    buffer: list[str] = []
    opened = _Open()
    skip: list[str] = []          # the element being left out, and those open in it
    out = 0                       # place of the first one in it that is left out itself
    doubtful: list[tuple[str, int]] = []
    at = 0

    def flush() -> None:
        line = " ".join(html_lib.unescape("".join(buffer)).split())
        buffer.clear()
        if not line:
            return
        if skip:   # text elements directly in it may be the article's
            if opened.regions and not _PROSE.isdisjoint(skip[1:]) and not out:
                doubtful.append((line, PROSE))
            return
        kind = OPEN if not opened.regions else SITE if _PROSE.isdisjoint(opened.inner()) else PROSE
        blocks.append((line, kind))

    for m in _MARKUP.finditer(html):
        start, end = m.span()
        if start > at:
            buffer.append(html[at:start])
        at = end
        name = m[3]
        if name is None:
            continue
        name, closing, attributes = m[3].lower(), bool(m[2]), m[4]
        block = name in _BLOCKS or name in _LEFT_OUT
        if name == "br":
            buffer.append(" ")
            continue
        if skip:
            if not closing and name in _REGION and not opened.regions and not _hinted(attributes, _COMMENT):
                buffer.clear()   # an article begins: the element before was left open
                skip.clear()
                doubtful.clear()
                out = 0
            elif closing and name in skip:
                flush()
                while skip.pop() != name:
                    pass
                out = out if out < len(skip) else 0
                if not skip:
                    doubtful.clear()
                continue
            elif closing and block and opened.holds(name):
                flush()
                skip.clear()
                blocks += doubtful
                doubtful.clear()
                out = 0
            else:
                if block and name not in _VOID or name == skip[0]:
                    flush()
                    if not closing:
                        if skip[-1] == "p" and block:
                            skip.pop()
                        if len(skip) > 1 and skip[-1] == name and name in _SINGLE:
                            skip.pop()
                        if not out and _left_out(name, attributes, opened):
                            out = len(skip)
                        skip.append(name)
                continue
        if not block and name not in _HINTED:
            continue
        if not closing and not attributes.endswith("/") and name not in _VOID and _left_out(
                name, attributes, opened):
            flush()
            skip.append(name)
            out = 0
        elif block:
            flush()
            if closing:
                opened.end(name)
            elif name not in _VOID:
                opened.begin(name)
    if not skip and at < len(html):
        buffer.append(html[at:])
    flush()
    return blocks


def page_lines(html: str | None) -> tuple[list[str], list[str]]:
    """(region lines, open lines) of a page in page order."""
    blocks = page_blocks(html)
    return [line for line, kind in blocks if kind], [line for line, kind in blocks if not kind]


# -------------------------------------------------------------- differencing

def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of ``a`` in a longest common subsequence of two line lists."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(range(head)) | set(range(len(a) - tail, len(a)))
    places: dict[str, list[int]] = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    # increasing matches of greatest length: per length, the smallest end in b
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def kept_lines(kinds: list[int]) -> list[int]:
    """Places of the region's lines, or of all lines of a page without one."""
    return [i for i, kind in enumerate(kinds) if kind] or list(range(len(kinds)))


def site_lines(lines: list, kinds: list[int], neighbour: list) -> set[int] | None:
    """Of a page's kept lines those that go: the neighbour holds them too and
    the markup lets them go.  ``None``: the neighbour holds all that is kept."""
    kept = kept_lines(kinds)
    shared = {kept[i] for i in shared_lines([lines[i] for i in kept], neighbour)}
    if len(shared) == len(kept):
        return None
    prose = [i for i in kept if kinds[i] == PROSE]
    if not prose:
        return shared
    if 2 * sum(i in shared for i in prose) > len(prose):
        return set()
    return {i for i in shared if kinds[i] == SITE}


def gone_lines(path: str, lines: list, kinds: list[int], others: list[tuple[str, list]]) -> set[int]:
    """Of a page's lines those that go; ``others`` are the (path, lines) of the
    neighbours on its host.  The one with the longest common path prefix decides
    (the earlier at a tie) unless it holds the whole page."""
    for _, theirs in sorted(others, key=lambda o: -_common_prefix(path, o[0])):
        gone = site_lines(lines, kinds, theirs)
        if gone is not None:
            return gone
    return set()


def _hashes(blocks: list[tuple[str, int]]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8)
                                    .digest(), "big", signed=True) for line, _ in blocks], dtype=np.int64)


def _digest(hashes: np.ndarray, kinds: list[int]) -> bytes:
    """Names a page's list of lines and their kinds."""
    return hashlib.blake2b(hashes.tobytes() + bytes(kinds), digest_size=16).digest()


_LISTS = "host string, path string, url string, digest binary, lines array<long>, kinds array<int>"


def _line_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        blocks = [page_blocks(h) for h in pdf["html"]]
        lines = [_hashes(b) for b in blocks]
        kinds = [[kind for _, kind in b] for b in blocks]
        rows = pdf[["host", "path", "url"]].assign(
            digest=[_digest(h, k) for h, k in zip(lines, kinds)], lines=lines, kinds=kinds)
        yield rows[[len(k) > 0 for k in kinds]]


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            others = [(path, list(lines)) for path, lines in
                      ((r.before_path, r.before_lines), (r.after_path, r.after_lines))
                      if path is not None]
            gone = gone_lines(r.path, list(r.lines), list(r.kinds), others)
            if gone:
                out.append((r.host, r.digest, sorted(gone)))
        yield pd.DataFrame(out, columns=["gone_host", "gone_digest", "gone"])


def site_text(pages: DataFrame) -> DataFrame:
    """``gone_host, gone_digest, gone``: the lines that go, for every line list
    of a host of ``pages`` (``host, path, url, html``) that loses any."""
    found = materialized(map_rows(pages.select("host", "path", "url", "html"), _line_lists, _LISTS),
                         "page_lines")
    place = F.struct("path", "url").alias("place")
    once = found.groupBy("host", "digest").agg(
        F.min(place).alias("place"), F.first("lines").alias("lines"), F.first("kinds").alias("kinds"))
    once = once.select("host", "digest", "place.path", "place.url", "lines", "kinds")
    lists = materialized(contiguous_index(once, ["path", "url", "digest"], ["host"], "n",
                                          keep=["digest", "path", "lines", "kinds"]), "page_lists")

    def neighbour(side: str, step: int) -> DataFrame:
        return lists.select(F.col("host").alias(f"{side}_host"), (F.col("n") + step).alias(f"{side}_n"),
                            F.col("path").alias(f"{side}_path"), F.col("lines").alias(f"{side}_lines"))

    rows = lists
    for side, step in (("before", 1), ("after", -1)):
        rows = rows.join(neighbour(side, step), (F.col("host") == F.col(f"{side}_host"))
                         & (F.col("n") == F.col(f"{side}_n")), "left")
    rows = rows.select("host", "digest", "path", "lines", "kinds", "before_path", "before_lines",
                       "after_path", "after_lines")
    return materialized(map_rows(rows, _difference,
                                 "gone_host string, gone_digest binary, gone array<int>"), "site_lines")


_PARSED = "page_id long, url string, host string, digest binary, texts array<string>, kinds array<int>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        blocks = [page_blocks(h) for h in pdf["html"]]
        kinds = [[kind for _, kind in b] for b in blocks]
        yield pd.DataFrame({
            "page_id": pdf["page_id"].astype("Int64").to_numpy(), "url": pdf["url"], "host": pdf["host"],
            "digest": [_digest(_hashes(b), k) for b, k in zip(blocks, kinds)],
            "texts": [[line for line, _ in b] for b in blocks], "kinds": kinds})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    url = F.coalesce("url", F.lit(""))
    place = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.lower(place).alias("host"), path.alias("path"), "html")
    gone = site_text(rows)
    parsed = map_rows(rows, _parse, _PARSED)
    both = parsed.join(gone, (F.col("host") == F.col("gone_host"))
                       & (F.col("digest") == F.col("gone_digest")), "left")
    region = F.exists("kinds", lambda kind: kind > 0)
    left = F.filter("texts", lambda _, i: (F.get("kinds", i) > 0) == F.col("region"))
    lost = F.filter("texts", lambda _, i: ((F.get("kinds", i) > 0) == F.col("region"))
                    & ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.array_join(left, "\n")).otherwise(F.array_join(lost, "\n"))
    both = both.withColumn("region", region).withColumn("text", text)
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
