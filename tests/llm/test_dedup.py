"""SimHash and suffix-array dedup against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavelake.llm import simhash, suffix_dedup
from wavelake.llm.components import connected_components
from wavelake.llm.suffix_array import suffix_array
from wavelake.session import recorded_scratch

DOCS = "doc_id long, text string, fp string, key long, root string, d int"


def _docs(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], DOCS)


def _words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"))
                    + str(rng.randrange(9)) for _ in range(n))


# ---------------------------------------------------------------- SimHash

def _slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _slow_components(prints):
    ids = range(len(prints))
    parent = list(ids)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in ids]


def _simhash_rows():
    rng = random.Random(5)
    base = [_words(rng, 120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30):  # near and exact copies
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    return rows + [(7_000, None), (7_001, ""), (7_002, " \t\n"), (7_003, "One two"),
                   (7_004, "ONE  TWO"), (7_005, "É one"), (7_006, "é one")]


def test_simhash_matches_brute_force(spark):
    rows = _simhash_rows()
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"])
           for r in simhash.simhash_near_dedup(_docs(spark, rows)).collect()}
    prints = [_slow_fingerprint(t) for _, t in rows]
    roots = _slow_components(prints)
    assert got == {i: (p, rows[r][0]) for (i, _), p, r in zip(rows, prints, roots)}
    assert got[7_000][1] == got[7_001][1] == got[7_002][1]


def test_segments_cover_every_link():
    rng = random.Random(1)
    plan = simhash.segment_plan(4)
    assert sum(r + 1 for _, _, r in plan) == 5 and sum(w for _, w, _ in plan) == 64
    for _ in range(500):
        flips = rng.sample(range(64), rng.randrange(5))
        assert any(sum(s <= f < s + w for f in flips) <= r for s, w, r in plan)


@pytest.mark.parametrize("max_bits", [0, 1, 3, 6])
def test_links_at_other_distances(spark, max_bits):
    rng = random.Random(max_bits)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                q ^= 1 << b
            prints.add(q)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(
        spark.createDataFrame(signed, "fp long"), max_bits).collect()}
    vals = sorted(x for x, in signed)
    want = {(a, b) for i, a in enumerate(vals) for b in vals[i + 1:]
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= max_bits}
    assert got == want


def test_near_duplicates_leave_one_row(spark):
    rows = _simhash_rows() + [(None, None), (8_003, "x y z"), (8_003, "x y z"), (8_002, "x y z")]
    docs = _docs(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = simhash.simhash_near_dedup(docs)
    n_groups = groups.join(
        simhash.near_duplicate_groups(groups.select("doc_id", "fp")).withColumnRenamed("fp", "f"),
        F.col("fp") == F.col("f")).select("root").distinct().count()
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == n_groups and len(set(ids)) == len(ids) and None not in ids


def test_near_duplicates_keep_columns_of_any_name(spark):
    names = ["_sh_id", "_sh_n", "_sh_h", "n", "id", "h", "d", "null", "keep_id", "g_fp", "root"]
    rows = [(i, t, *range(len(names))) for i, t in [(1, "a b c d e"), (2, "a b c d e"), (3, None), (3, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, "
                                 + ", ".join(f"`{c}` int" for c in names)).repartition(3)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(1000, x) for x in range(900, 940)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    rng.shuffle(links)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_empty_tables(spark):
    none = _docs(spark, [])
    assert simhash.simhash_near_dedup(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


# ------------------------------------------------------------- suffix arrays

@pytest.mark.parametrize("symbols", [1, 2, 3, 26, 400])
def test_suffix_array_matches_sorting(symbols):
    rng = random.Random(symbols)
    for n in (0, 1, 2, 5, 40, 300):
        for alphabet in (symbols + 1, 2000):  # bucket by bucket, and one by one
            s = np.array([rng.randrange(1, symbols + 1) for _ in range(n)] + [0])
            want = sorted(range(n + 1), key=lambda i: s[i:].tolist())
            assert suffix_array(s, alphabet).tolist() == want


def _slow_dedup(rows, length):
    """(n_bytes, n_removed, n_spans, sha) in the order of rows, which are in
    document order."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                gone[p:p + length] = [True] * length
            seen.add(raw[p:p + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _passage_rows(rng):
    shared = [_words(rng, 60) for _ in range(3)] + ["ñandú über " * 40, "a" * 400]
    rows = []
    for i in range(60):
        parts = [_words(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(shared)
            a = rng.randrange(len(text) // 2)
            parts += [text[a:a + rng.randrange(80, 500)], _words(rng, rng.randrange(10))]
        rows.append((i, rng.choice(("", " ", "é")).join(parts)))
    rows += [(100 + i, rows[i * 3][1]) for i in range(8)]
    return rows + [(200, None), (201, ""), (202, "short"), (203, "long " * 4000)]


@pytest.mark.parametrize("hot", [1, 256])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rows = _passage_rows(random.Random(8))
    order = rows[:]
    random.Random(1).shuffle(order)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffix_dedup.suffix_dedup(_docs(spark, order).repartition(5)).collect()}
    want = _slow_dedup(rows, 100)
    assert got == {i: w for (i, _), w in zip(rows, want)}
    assert sum(w[1] for w in want) > 20_000


def test_no_group_of_a_shard_exceeds_the_bound(spark, monkeypatch):
    """A passage in many documents with different text around it: at its edges
    all contexts of an anchor differ, but share the same bytes."""
    hot, largest, deal = 8, [], suffix_dedup.shard_spans

    def spans(contexts, length):
        largest.append(contexts.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0)
        return deal(contexts, length)

    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "shard_spans", spans)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(260))

    def own():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(60, 200)))

    rows = [(i, own() + passage + own()) for i in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffix_dedup.suffix_dedup(_docs(spark, rows).repartition(3)).collect()}
    assert got == {i: w for (i, _), w in zip(rows, _slow_dedup(rows, 100))}
    assert max(largest) <= hot


def _chance_rows():
    """Few words in any order: anchors meet everywhere, passages only where planted."""
    rng = random.Random(21)
    words = ["alphabet", "betatron", "gammaray", "deltawing"]

    def own():
        return " ".join(rng.choice(words) + (str(rng.randrange(10 ** 6)) if i % 5 == 4 else "") for i in range(150))

    shared = own()[:300]
    return [(i, own() + (shared[i % 90:] + own() if i % 10 == 0 else "")) for i in range(120)]


@pytest.mark.parametrize("partitions", ["2", "8", "150"])
def test_anchors_that_meet_by_chance_are_dropped(spark, partitions):
    """Contexts go on by the passages they share, not by their anchors' strings,
    whether an anchor lies within a sort task or at its edges."""
    rows = _chance_rows()
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc_id long, tie long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = suffix_dedup.occurrences(docs, 100, suffix_dedup.ANCHOR)
        several = found.groupBy("anchor").agg(F.count_distinct("ctx").alias("n")).filter("n > 1")
        by_anchor = several.agg(F.sum("n")).first()[0]
        _, open_ = suffix_dedup.split_contexts(suffix_dedup.sorted_occurrences(found))
        counts = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("n_ctx").alias("n_ctx"))
        asked = counts.agg(F.sum("n"), F.min(F.col("n") == F.col("n_ctx")), F.min("n")).first()
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
               for r in suffix_dedup.suffix_dedup(_docs(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = _slow_dedup(rows, 100)
    assert got == {i: w for (i, _), w in zip(rows, want)} and sum(w[1] for w in want) > 1000
    assert by_anchor > 1500 and 0 < asked[0] < by_anchor / 5
    assert asked[1] and asked[2] > 1


@pytest.mark.parametrize("length, k", [(100, 16), (40, 16), (17, 16), (31, 8)])
def test_contexts_with_a_common_window_share_a_side(length, k):
    rng = random.Random(length)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(length, 4 * length))) for _ in range(30)]
    core = bytes(rng.choice(b"ab") for _ in range(2 * length))
    texts = [t[:len(t) // 2] + core[rng.randrange(length):][:rng.randrange(length, 2 * length)] + t[len(t) // 2:]
             for t in texts]
    owner = {}
    for t in texts:
        for p, h, _, left, right, side in zip(*suffix_dedup._anchors(t, length, k)):
            halves = {(0, int(side) >> 32), (1, int(side) & 0xFFFFFFFF)} - {(0, 0), (1, 0)}
            assert halves
            for s in range(p - left, p + right - length + 1):
                owner.setdefault((t[s:s + length], h), []).append((t[p - left:p + right], p - s, halves))
    pairs = [(a, b) for same in owner.values() for a in same for b in same if a[0] != b[0]]
    assert len(pairs) > 50 and all(a[1] == b[1] and a[2] & b[2] for a, b in pairs)


def test_suffix_dedup_deletes_what_it_no_longer_reads(spark):
    """Only the spans' lists are left, and no shuffle of the steps before them."""
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())
                if files.apply(i).getName().startswith("shuffle_")}

    docs = _docs(spark, _passage_rows(random.Random(8))).repartition(5)
    before = shuffled()
    with recorded_scratch() as made:
        out = suffix_dedup.suffix_dedup(docs)
    assert len(made) > 8
    assert [os.path.basename(p).rpartition("-")[0] for p in made
            if os.path.exists(p.removeprefix("file:"))] == ["span_lists"]
    # the steps shuffled some 20 times; what is left is of counting the ids
    assert len({f.split("_")[1] for f in shuffled() - before}) <= 3
    assert out.agg(F.sum("n_removed")).first()[0] > 20_000


def test_suffix_dedup_with_repeated_and_null_ids(spark):
    rng = random.Random(4)
    a, b = _words(rng, 40), _words(rng, 40)
    rows = [(1, a), (1, a), (1, b + "x"), (None, a), (None, b), (None, None), (2, b)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"])
                 for r in suffix_dedup.suffix_dedup(_docs(spark, rows)).collect())
    n, m = len(a), len(b)
    assert got == sorted([(False, 1, n, 0), (False, 1, n, n), (False, 1, m + 1, 0),
                          (True, 0, n, n), (True, 0, m, m), (True, 0, 0, 0), (False, 2, m, m)])


@pytest.mark.parametrize("chunk", [1000, 1 << 20])
def test_every_window_is_owned_once(monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
    raw = (_words(random.Random(3), 1200) + " aaaa" * 300 + "b" * 500).encode()
    owned = np.zeros(len(raw) - 99, dtype=int)
    by_text = {}
    for p, h, _, left, right in zip(*suffix_dedup.anchors(raw)):
        assert left >= 0 and right >= suffix_dedup.ANCHOR
        for s in range(p - left, p + right - 99):
            owned[s] += 1
            assert by_text.setdefault(raw[s:s + 100], (h, p - s)) == (h, p - s)
    assert (owned == 1).all()


def test_remove_repeats_keeps_rows_and_columns(spark):
    rng = random.Random(6)
    a = _words(rng, 40)
    docs = spark.createDataFrame(
        [(1, a + " ü", "en", "s", 5), (2, "ü" + a, "en", "s", 5), (3, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long")
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == a + " ü" and rows[2]["text"] == "ü" and rows[2]["n_chars"] == 1
    assert rows[3]["text"] is None
