"""Packing, source mixing, nearest neighbours and page text."""

from __future__ import annotations

import collections
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavelake.llm import ann_curves, html_extract, mixing, packing
from wavelake.llm.queries import read_table, tokenizer_file

SF = "/root/testdata/sf0.01"
SPEC = "byte_bpe_50k.json"


# ------------------------------------------------------------------- packing

def _reference_ids():
    tok = Tokenizer.from_file(public_tokenizers.path(SPEC))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(spark):
    ids, own = _reference_ids(), packing.BpeTokenizer(json.loads(tokenizer_file(SPEC)), packing.BYTE_BPE_PATTERN)
    rng = random.Random(4)
    texts = [r["text"] for r in read_table(spark, SF, "documents").limit(150).collect()]
    bits = ["a", "word", "'s", "'ll", " ", "  ", "\n", "\t", "é", "世界", "²", "½", "12", "!?", "\x1c", "\xa0",
            "<|endoftext|>", "　", "🙂", "_", "٣", ""]
    texts += [" ".join(rng.choice(bits) + rng.choice(bits) for _ in range(12)) for _ in range(400)]
    texts += ["a <|endoftext|> b c d", "<|endoftext|>", "x<|endoftext|><|endoftext|> y z and more", "<|endoftext",
              "one two  <|endoftext|>  three four five six "]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(text)
    assert 50256 in ids("a <|endoftext|> b c d")


def test_remembered_chunks_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_BYTES", 50_000)
    ids, own = _reference_ids(), packing.BpeTokenizer(json.loads(tokenizer_file(SPEC)), packing.BYTE_BPE_PATTERN)
    rng = random.Random(9)
    for _ in range(60):
        text = " ".join("".join(rng.choice("世界abc") for _ in range(rng.choice((3, 30, 400)))) for _ in range(20))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(text)
        held = sum(200 + 4 * len(c) + len(i) for c, i in own._chunks.items())
        assert held == own._held <= 50_000


def test_packed_ids_come_back():
    for ids in ([], [0], [1, 2, 50256], [65535], [65536, 1], list(range(3000))):
        raw = np.array(ids, "<u4").tobytes()
        assert packing.unpacked_ids(packing.packed_ids(raw)).tolist() == ids


def _check_packing(rows, pieces, ids):
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for doc_id, group in collections.Counter(i for i, _ in rows).items():
        texts = [t for i, t in rows if i == doc_id]
        want = collections.Counter()
        for text in texts:
            full = ids(text) + [0]
            for k, (s, n) in enumerate(packing.piece_bounds(len(full), 2048)):
                want[(k, s, n, zlib.crc32(np.array(full[s:s + n], "<u4").tobytes()))] += 1
            assert len(full) <= 2048 or sum(n for _, n in packing.piece_bounds(len(full), 2048)) == len(full)
        assert want == collections.Counter(
            (p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in by_doc[doc_id])
    bins = collections.defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins)


def test_packing_keeps_every_id(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randrange(1, 900))))
            for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 9000), (500, None), (None, "null id"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows],
                                 "doc_id long, text string, piece int, length int, offset int")
    pieces = packing.pack_documents(docs, tokenizer_file(SPEC), with_ids=True).collect()
    n_bins = _check_packing(rows, pieces, _reference_ids())
    total = sum(p["length"] for p in pieces)
    assert n_bins <= math.ceil(total / 2048) + 1
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert packing.pack_documents(docs.limit(0), tokenizer_file(SPEC)).count() == 0


def _slow_best_fit(lengths, capacity):
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            out.append(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_segment_tree_packs_like_a_scan(seed):
    rng = random.Random(seed)
    capacity = rng.choice((1, 7, 64, 100))
    lengths = np.array([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(200))], dtype=np.int64)
    bins, offsets = packing.best_fit_decreasing(lengths, capacity)
    used = collections.defaultdict(int)
    for b, n in zip(bins, lengths):
        used[b] += int(n)
    assert sorted(capacity - u for u in used.values()) == _slow_best_fit(lengths.tolist(), capacity)


# -------------------------------------------------------------------- mixing

def _slow_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: per * weight[s] for s in free}
        target |= {s: epochs * sizes[s] for s in over}
        free -= over
    return target


def _mix_rows(seed):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", "hot", None]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))) + rng.choice(("", "\x0b \n")),
             "hot" if rng.random() < 0.5 else rng.choice(sources)) for i in range(400)]
    return rows + [(900, None, "a"), (901, "", None), (902, " \t", "empty"), (7, "x y", "a"), (7, "x y", "a"),
                   (None, "p q r", "b"), (903, "w " * 3000, "long")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rows = _mix_rows(seed)
    docs = spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows],
                                 "doc_id long, text string, source string, size int, key string")
    out = mixing.mix_sources(docs).collect()
    sizes = collections.defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = _slow_targets(sizes)
    plan = {r["source"]: r["target"] for r in mixing.source_targets(
        mixing._sized(docs)).collect()}
    assert plan.keys() == want.keys()
    assert all(math.isclose(plan[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    kept = mixing.apply_mix(docs)
    assert kept.columns == docs.columns
    taken, longest = collections.Counter(), collections.defaultdict(int)
    for r in kept.collect():
        taken[r["source"]] += len((r["text"] or "").split())
    for _, t, s in rows:
        longest[s] = max(longest[s], len((t or "").split()))
    for s in want:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    assert sum(taken.values()) == sum(r["taken"] for r in out)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, again))


def test_mix_takes_as_many_copies_as_bring_the_sum_nearest(spark):
    # 500 copies of one row of 20 words, of which a part is needed
    rows = [(1, "w " * 20, "a")] * 500 + [(2, "v " * 200, "b")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, source string, n_chars long").repartition(7)
    out = mixing.mix_sources(docs, weights=(1.0, 0.05), total_share=1.35).collect()
    target = next(r["target"] for r in out if r["doc_id"] == 1)
    taken = [r["taken"] for r in out if r["doc_id"] == 1]
    assert 10_000 < target < 20_000 and abs(sum(taken) - target) <= 10 and set(taken) == {20, 40}
    kept = mixing.apply_mix(docs, weights=(1.0, 0.05), total_share=1.35)
    times = collections.Counter(r["n_chars"] for r in kept.filter("source = 'a'").collect())
    assert len(times) == 500 and sorted(times.values()) == sorted(t // 20 for t in taken)


def test_mix_without_words(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)
    assert {r["taken"] for r in mixing.mix_sources(blank).collect()} == {0}
    assert mixing.apply_mix(blank).count() == 0


# ---------------------------------------------------------------- neighbours

def _slow_neighbours(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(v)
    dims = collections.Counter(len(v) for vs in ok.values() for v in vs)
    dim = max(dims, key=lambda d: (dims[d], d))
    points = [(i, np.array(v, dtype=np.float32).astype(float)) for i, vs in ok.items()
              for v in {tuple(v) for v in vs} if len(v) == dim]
    out = {}
    for q, x in points:
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in points if i != q)
            out[q] = [(i, d) for d, i in near[:k]]
    return out


@pytest.mark.parametrize("complete", [True, False])
def test_neighbours_match_brute_force(spark, complete):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(900)]
    rows += [(1000 + i, [1.0, 2.0] * 4) for i in range(300)]          # one vector in a quarter of the rows
    rows += [(2000, None), (2010, []), (2020, [0.0] * 8), (2030, [float("nan")] + [1.0] * 7),
             (2040, [float("inf")] * 8), (2050, [None] + [1.0] * 7), (2060, [1.0, 2.0]),
             (None, [1.0] * 8), (10, rows[10][1])]
    table = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows],
                                  "vec_id long, embedding array<float>, rank int, score double")
    got = collections.defaultdict(dict)
    for r in ann_curves.nearest_neighbours(table, every=10, k=5, window=200, complete=complete).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    want = _slow_neighbours(rows, 10, 5)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, near in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        found = [got[q][r] for r in range(1, 6)]
        if complete:
            assert [i for i, _ in found] == [i for i, _ in near]
            assert np.allclose([d for _, d in found], [d for _, d in near], rtol=1e-12)
        hits += len({i for i, _ in found} & {i for i, _ in near})
        total += 5
    assert hits / total >= 0.9


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann_curves.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], schema)
    got = [tuple(r) for r in ann_curves.nearest_neighbours(two).orderBy("query_id", "rank").collect()]
    assert [(q, n, i) for q, n, i, _ in got] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert got[0][3] == 0.0 and math.isclose(got[1][3], math.sqrt(2))


def test_hilbert_keys_are_a_walk():
    for d, bits in ((2, 3), (3, 2), (1, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = ann_curves.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


# ------------------------------------------------------------------ page text

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First
 block&nbsp;one.<br><p>Second &lt;b&gt; &#233;</p><aside>Side</aside><form><p>Form</p></form>
<div class="share-bar sharing">Share</div><div>plain</div><section id="comments"><p>Reader</p></section></article>
<!-- note <p>hidden</p> --><div class="cookie-notice">Cookies</div><footer><p>Foot</p></footer></body></html>"""


def test_article_blocks():
    region, _ = html_extract.page_lines(ARTICLE)
    assert region == ["Head & line", "First block one.", "Second <b> é", "plain"]


@pytest.mark.parametrize("html, lines", [
    (None, []), ("", []), ("plain text", ["plain text"]), ("<p>cut &am", ["cut &am"]), ("<p>a<p", ["a"]),
    ("a < b <p>c", ["a < b", "c"]), ("<nav><p>x</nav><p>y", ["y"]), ("<p>a</p><script>b", ["a"]),
    ("<div>one<p>two</p>three</div>", ["one", "two", "three"]), ("<!-- open <p>x", []),
])
def test_odd_markup(html, lines):
    region, opened = html_extract.page_lines(html)
    assert region + opened == lines


@pytest.mark.parametrize("inner, lines", [
    ('<section class="related-work"><p>a</p></section><p>b</p>', ["a", "b"]),
    ('<div class="social-history">a</div><p id="notice-period">b</p><p class="alert-success">c</p>', ["a", "b", "c"]),
    ('<p class="related">a</p><table class="form"><tr><td class="search">b</td></tr></table>', ["a", "b"]),
    ('<p>a</p><aside>note<p>b</p><p>c</p>', ["a", "b", "c"]),
    ('<p>a</p><div class="ad">Buy<p>b</p><h2>c</h2>', ["a", "b", "c"]),
    ('<section><p>a</p><aside>note</section><p>b</p>', ["a", "b"]),
    ('<p>a</p><div class="ad">Buy<nav><p>x</p></nav><p>b</p>', ["a", "b"]),
    ('<p>a</p><div class="ad"><div>Buy</div><p>x</p></div><p>b</p>', ["a", "b"]),
    ('<p>a</p><aside><aside><p>x</p></aside><p>y</p></aside><p>b</p>', ["a", "b"]),
    ('<p>a</p><div class="share-buttons">x</div><ul class="related posts"><li>x</ul><div id="comments">y</div>', ["a"]),
    ('<p>a</p><article class="comment"><p>x</p></article><p>b</p>', ["a", "b"]),
    ('<p>a</p></div></section><p>b</p>', ["a", "b"]),
])
def test_article_text_is_not_lost(inner, lines):
    for page in ("<article>{}</article><footer>f</footer>", '<article class="form-factor social">{}</article>',
                 "<div><main><article>{}</article></main></div><p>out</p>"):
        assert html_extract.page_lines(page.format(inner))[0] == lines


def _tree_lines(html):
    """Lines of an article by a second route: the standard library's tag
    events build a tree, which is walked."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.here = ["root", {}, [], None]

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.here[2].append(" ")
                return
            node = [tag, dict(attrs), [], self.here]
            self.here[2].append(node)
            self.here = node

        def handle_endtag(self, tag):
            self.here = self.here[3]

        def handle_data(self, data):
            self.here[2].append(data)

    tree = Tree()
    tree.feed(html)
    lines, buffer = [], []

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            lines.append(text)

    def walk(node, inside):
        tag, attrs, children, _ = node
        if tag in ("nav", "aside", "footer", "form") or tag in ("div", "section", "ul") and attrs.get("class") in (
                "ad", "share-bar", "comments"):
            flush()
            return
        block = tag not in ("b", "i", "a", "span")
        if block:
            flush()
        for child in children:
            if isinstance(child, str):
                if inside or tag == "article":
                    buffer.append(child)
            else:
                walk(child, inside or tag == "article")
        if block:
            flush()

    walk(tree.root, False)
    return lines


def test_random_balanced_pages_equal_a_tree_walk():
    rng = random.Random(12)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["word ", "a &amp; b ", " x\n y", "<br>", "&#233;t "])
        tag = rng.choice(["div", "section", "ul", "b", "i", "a", "span", "nav", "aside", "footer", "blockquote"])
        cls = rng.choice(["", "", ' class="ad"', ' class="related-work"', ' class="share-bar"', ' class="comments"'])
        body = "".join(element(depth - 1) for _ in range(rng.randrange(4)))
        return f"<{tag}{cls if tag in ('div', 'section', 'ul') else ''}>{body}</{tag}>"

    for _ in range(400):
        page = "<html><body><article>" + "".join(element(4) for _ in range(5)) + "</article></body></html>"
        assert html_extract.page_lines(page)[0] == _tree_lines(page), page


def test_unclosed_menu_before_an_article():
    assert html_extract.page_lines("<nav><a>m</a><article><p>t</p></article>")[0] == ["t"]


@pytest.mark.parametrize("seed", range(6))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcd") for _ in range(rng.randrange(14))]
    b = [rng.choice("abcd") for _ in range(rng.randrange(14))]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    shared = html_extract.shared_lines(a, b)
    assert len(shared) == table[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in sorted(shared))


def test_pages_without_an_article_lose_shared_lines(spark):
    page = "<div>Site name</div><p>{}</p><div>All our pages</div>"
    rows = [(1, "http://h.example/a/1", page.format("one")), (2, "http://h.example/a/2", page.format("two")),
            (3, "http://other.example/a/1", page.format("alone")), (4, None, None), (5, "x", ""),
            (None, "http://h.example/b", ARTICLE), (1, "http://h.example/a/1?q", page.format("one"))]
    pages = spark.createDataFrame([(i, u, h, "t", 0) for i, u, h in rows],
                                  "page_id long, url string, html string, text string, host int")
    out = html_extract.extract_main_text(pages.coalesce(1)).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert got[(3, "http://other.example/a/1")] == "Site name\nalone\nAll our pages"
    assert got[(2, "http://h.example/a/2")] == "two"
    assert got[(None, "http://h.example/b")].startswith("Head & line\nFirst")
    assert got[(4, None)] == got[(5, "x")] == ""
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def _main_texts(spark, rows, parts):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}


def test_site_text_inside_an_article_is_differenced(spark):
    page = ("<article><h1>{0}</h1><div>Our newsroom</div><p>{0} says</p><p>A shared quotation</p><p>{0} ends</p>"
            "<ul><li>More of our site<li>{0} list</ul></article>")
    rows = [(i, f"http://h.example/a/{i}", page.format(w)) for i, w in enumerate(("one", "two", "three"))]
    rows.append((9, "http://alone.example/", page.format("alone")))
    got = _main_texts(spark, rows, 3)
    assert got[0] == "one\none says\nA shared quotation\none ends\none list"
    assert got[2] == "three\nthree says\nA shared quotation\nthree ends\nthree list"
    assert got[9] == "alone\nOur newsroom\nalone says\nA shared quotation\nalone ends\nMore of our site\nalone list"


def test_a_copied_article_keeps_its_lines(spark):
    page = "<article><h1>Head</h1><div>Own words</div><p>First</p><p>Second</p>{}</article>"
    got = _main_texts(spark, [(1, "http://h.example/1", page.format("<p>Printed</p>")),
                              (2, "http://h.example/2", page.format(""))], 1)
    assert got == {1: "Head\nOwn words\nFirst\nSecond\nPrinted", 2: "Head\nOwn words\nFirst\nSecond"}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_copies_are_not_compared_with_each_other(spark, partitions):
    page = "<div>Site name</div><p>{}</p><div>All our pages</div>"
    rows = [(i, f"http://h.example/a/1?copy={i}", page.format("one")) for i in range(40)]
    rows += [(100 + i, f"http://h.example/b/{i:02}", page.format(f"text {i}")) for i in range(20)]
    rows += [(200 + i, f"http://copies.example/{i}", page.format("same")) for i in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = _main_texts(spark, rows, int(partitions))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {i: "one" for i in range(40)} | {100 + i: f"text {i}" for i in range(20)}
    assert got == want | {200 + i: "Site name\nsame\nAll our pages" for i in range(2)}
