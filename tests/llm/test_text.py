"""Language mixtures, license scan, quality rules and token counts."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest

from wavelake.llm import langid, license_scan, quality, trie_counts
from wavelake.llm.queries import read_table

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- languages

def test_languages_on_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    labels = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify_languages(docs).collect()
    assert len(rows) == len(labels)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["langs"][0] == r["lang_pred"]
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == labels[r["doc_id"]] for r in held)
    assert len(held) > 100 and right / len(held) > 0.98


def test_mixed_documents_name_both_languages(spark):
    docs = read_table(spark, SF, "documents")
    langs, logp = langid.fit(docs)
    by = collections.defaultdict(list)
    for r in docs.select("lang", "text").limit(200).collect():
        by[r["lang"]].append(r["text"][:1500])
    shares, _ = langid.mixtures([by["en"][0] + " " + by["de"][0], by["fr"][0]], logp)
    assert {langs[i] for i in np.flatnonzero(shares[0])} == {"en", "de"}
    assert [langs[i] for i in np.flatnonzero(shares[1])] == ["fr"]


@pytest.mark.parametrize("size", [3, 50, 1 << 20])
def test_blocks_of_a_long_text_add_up(spark, size):
    rng = np.random.default_rng(size)
    logp = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 5).T + 1e-9).astype(np.float32)
    pick = random.Random(size)
    texts = ["", "12 ..", "x", " Straße 世界世界世界 abc", "wordwithoutend" * 40] + [
        " ".join("".join(pick.choice("abcdé") for _ in range(pick.randrange(1, 9))) for _ in range(200)) for _ in range(3)]
    want, words = langid.mixtures(texts, logp)
    for text, w, n in zip(texts, want, words):
        got, found = langid.long_mixture(text, logp, size=size)
        assert found == n and np.allclose(got, w, atol=1e-4)
    shares, found = langid.bounded_mixtures(texts, logp, cells=5 * size)
    assert (found == words).all() and np.allclose(shares, want, atol=1e-4)


def _peak_mb(code):
    """Peak resident memory of a fresh process that runs ``code``."""
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-c", "import resource, sys; sys.path.insert(0, '/root/repo')\n" + code
                          + "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"],
                         capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-500:]
    return int(run.stdout.split()[-1])


@pytest.mark.parametrize("text", ["'ab' * 2_000_000", "' '.join(map(str, range(10**6, 10**6 + 600_000)))"])
def test_any_one_text_takes_bounded_memory(text):
    assert _peak_mb(f"""
from wavelake.llm.trie_counts import ForwardTrie, rank_scores
words, tokens = ForwardTrie(rank_scores(["a", "b", "ab", "1", "12"])).count({text})
assert tokens >= 600_000""") < 600
    assert _peak_mb(f"""
import numpy as np
from wavelake.llm import langid
logp = np.log(np.random.default_rng(1).random((langid.BUCKETS, 30)) + .1).astype(np.float32)
assert len(langid.bounded_mixtures(["short text", {text}], logp, cells=4 << 20)[0]) == 2""") < 600


def test_mixture_shares_match_plain_em():
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3).T + 1e-9).astype(np.float32)
    text = "abc def ghij klm nop"
    got, words = langid.mixtures([text, ""], logp, penalty=0.0)
    like = []
    for w in text.split():
        data = f" {w} ".encode()
        like.append(sum(logp[int((data[i - 1] << 16 | data[i] << 8 | data[i + 1]) * 2654435761
                                 & 0xFFFFFFFF) >> 16].astype(float) for i in range(1, len(data) - 1)))
    like = np.exp(np.array(like) - np.max(like, axis=1, keepdims=True))
    shares = np.ones(3) / 3
    for _ in range(300):
        w = like * shares
        shares = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
    assert words.tolist() == [5, 0] and not got[1].any()
    assert got[0].argmax() == shares.argmax() and abs(got[0].sum() - 1) < 1e-5


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score double, langs int"
    rows = [(i, "the cat sat on the mat", "en", 0.0, 1) for i in range(20)]
    rows += [(i, "le chat est sur la table", "fr", 0.0, 1) for i in range(20, 40)]
    rows += [(50, None, "en", 0.0, 1), (51, "", None, 0.0, 1), (52, "123 !?", "fr", 0.0, 1),
             (53, "the cat", None, 0.0, 1), (None, "le chat", "fr", 0.0, 1), (54, "the " * 60_000, "en", 0.0, 1)]
    got = {r["doc_id"]: r for r in langid.identify_languages(
        spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows)
    assert {got[i]["lang_pred"] for i in (50, 51, 52)} == {"und"} and got[50]["score"] == 0
    assert got[53]["lang_pred"] == got[54]["lang_pred"] == "en"
    assert got[None]["lang_pred"] == "fr" and got[None]["held_out"]
    unlabelled = spark.createDataFrame([(1, "text", None, 0.0, 1)], schema)
    assert langid.identify_languages(unlabelled).first()["lang_pred"] == "und"
    assert langid.identify_languages(unlabelled.limit(0)).count() == 0


# ------------------------------------------------------------------ licenses

def _license_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def test_licenses_match_brute_force(spark):
    rng = random.Random(3)
    filler = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "the", "été", "x1"]
    rows = [(i, " ".join(rng.choice(filler) + rng.choice(("", ",", "\n-")) for _ in range(rng.randrange(120))))
            for i in range(80)]
    rows += [(200, None), (201, ""), (202, "CC-BY"), (203, "cc by cc by"), (204, "All  RIGHTS\nreserved."),
             (205, "ÀLL rights reserved"), (206, "K cc\x00by"), (207, "x " * 50_000 + "cc by"),
             (None, "cc by"), (202, "CC-BY"), (208, "--- cc by")]
    docs = spark.createDataFrame([(i, t, 1, 2, "l") for i, t in rows],
                                 "doc_id long, text string, tmpl int, diag int, label string")
    want = []
    for i, t in rows:
        words = _license_words(t)
        hits = [(at, label) for phrase, label in license_scan.BASE_PHRASES.items()
                for at in range(len(words)) if words[at:at + len(phrase.split())] == phrase.split()]
        want.append((i, len(words), len(hits), min(hits)[0] if hits else None,
                     max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))))
    out = license_scan.license_scan(docs).collect()
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
           for r in out]
    assert collections.Counter(got) == collections.Counter(want)
    for r in out:
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= bool(r["base_labels"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_sentences_survive_small_changes(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "software and associated documentation files")
    rows = [(1, "foo bar. " + mit + ". baz"), (2, mit.replace("free of", "free and free of")),
            (3, "Permission is hereby granted to read this."), (4, "Licensed under the Apache License, Version 2.0."),
            (5, "of this software and nothing else")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == got[2]["labels"] == "mit" and got[1]["score"] == 1.0
    assert got[1]["spans"][0]["start"] == 2 and got[1]["spans"][0]["end"] == 2 + len(_license_words(mit))
    assert got[3]["labels"] == got[5]["labels"] == "" and got[3]["score"] < 0.8
    assert got[4]["labels"] == "apache-2.0"


def test_every_license_sentence_allows_one_change_but_not_of_its_label(spark):
    rows, want = [], {}
    wrong = {"0": "1", "3": "2", "mit": "bsd", "nc": "nd", "attribution": "noncommercial"}

    def add(words, label):
        want[len(rows)] = label
        rows.append((len(rows), "zz " + " ".join(words) + " zz"))

    for sentence, label in license_scan.LICENSE_SENTENCES.items():
        words = sentence.split()
        add(words, label)
        for i in range(1, len(words)):  # an insertion at every place
            add([*words[:i], "foo", *words[i:]], label)
        for i, word in enumerate(words):  # a substitution of every word
            mark = word.isdigit() or word in license_scan.MARKS
            add([*words[:i], "foo", *words[i + 1:]], None if mark else label)
            if word in wrong:
                add([*words[:i], wrong[word], *words[i + 1:]], None)
            if word in ("general", "4"):
                add([*words[:i], {"general": "lesser", "4": "sa"}[word], *words[i:]], None)
    extra = {"licensed under the apache license 2 0": "apache-2.0", "licensed under cc by nc sa 4 0": None}
    for text, label in extra.items():
        add(text.split(), label)
    out = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: {s["label"] for s in r["spans"] if s["end"] - s["start"] > 3} for r in out}  # no phrases
    for i, text in rows:
        assert got[i] == ({want[i]} if want[i] else set()), text


def test_license_bodies_are_one_span_over_their_diagonals(spark):
    rng = random.Random(21)
    from wavelake.llm.license_texts import LICENSE_BODIES

    rows, want = [], {}

    def add(words, label, lead=7):
        want[len(rows)] = (label, lead, len(words))
        rows.append((len(rows), " ".join(f"w{i}" for i in range(lead)) + " " + " ".join(words) + " tail end"))

    for body, label in LICENSE_BODIES.items():
        words = license_scan.body_words(body)
        add(words, label)
        middle = len(words) // 2
        add([*words[:middle], "acme", "corporation", "and", "its", "friends", *words[middle:]], label, lead=0)
        add([*words[:middle], *words[middle + 4:]], label)
        changed = list(words)
        for _ in range(len(words) // 60):
            i = rng.randrange(10, len(changed) - 10)
            if rng.random() < 0.5:
                changed.insert(i, "foo")
            else:
                del changed[i]
        add(changed, label)
        add(words[:len(words) // 2], None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bodies = set(LICENSE_BODIES.values())
    for r in license_scan.license_scan(docs).collect():
        label, lead, n = want[r["doc_id"]]
        spans = [s for s in r["spans"] if s["label"] in bodies and s["end"] - s["start"] > 25]
        if label is None:
            assert not [s for s in spans if s["end"] - s["start"] > n] and not {"bsd-2-clause", "zlib", "isc"} & set(
                r["labels"].split(","))
            continue
        assert [s["label"] for s in spans] == [label] and label in r["labels"].split(",")
        assert lead <= spans[0]["start"] <= lead + 10 and lead + n - 10 <= spans[0]["end"] <= lead + n


def test_license_empty_table(spark):
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------- quality

def _slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_statistics_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        words = [rng.choice(("ab", "été", "x#y", "|", "Ünï", "𝒳z")) for _ in range(rng.randrange(60))]
        rows.append((i, "".join(w + rng.choice((" ", "\n", "  ", "\t", "\x0b")) for w in words)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "a b c d e f g h a b c d e f g h"),
             (504, "w " * 20_000), (None, "x " * 30), (503, "line\nline\n line"), (505, "a b c")]
    docs = spark.createDataFrame(
        [(i, t, rng.choice(("en", None)), rng.choice(("s1", None)), 1, 2) for i, t in rows],
        "doc_id long, text string, lang string, source string, _n_words int, d int")
    out = quality.quality_verdicts(docs.drop("_n_words")).collect()
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
            r["n_repeat_words"], r["base_failed"]) for r in out]
    assert collections.Counter(got) == collections.Counter((i, *_slow_statistics(t)) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_quality_rejects_outliers_only(spark):
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    rows = quality.quality_verdicts(read_table(spark, SF, "documents")).collect()
    clean = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert all(clean) and len(clean) > 200
    assert sum(junk) / len(junk) < 0.4


def test_quality_distance_matches_numpy(spark):
    from wavelake.llm.common import materialized

    docs = read_table(spark, SF, "documents")
    stats = materialized(quality.with_statistics(docs.select("doc_id", "lang", "source", "text")), "t")
    vec = [f"_x{i}" for i in range(6)]
    rows = stats.filter(~quality.base_failed()).select("lang", "source", *quality._vector())
    first = materialized(quality._factored(quality._start(rows)), "t")
    pdf, groups = rows.toPandas(), first.toPandas().set_index(["lang", "source"])
    # one concentration step, by hand
    sums = {}
    for key, g in pdf.groupby(["lang", "source"]):
        p, x = groups.loc[key], g[vec].to_numpy() / 1024
        m = np.array([[p[f"_m{i}_{j}"] if j <= i else 0.0 for j in range(6)] for i in range(6)])
        d = (((x - p[[f"_c{i}" for i in range(6)]].to_numpy(float)) @ m.T) ** 2).sum(axis=1)
        cell = np.floor(np.log1p(np.minimum(d, 1e6)) * 32)
        before = np.array([(cell < c).sum() for c in cell])
        sums[key] = x[before < 0.75 * len(x)]
    step = quality._concentrated(rows, first).toPandas().set_index(["lang", "source"])
    floors = np.array(list(quality.FLOOR.values()))
    for key, x in sums.items():
        tongue = np.concatenate([v for k, v in sums.items() if k[0] == key[0]])
        w = len(x) / (len(x) + 50)
        cov = w * np.cov(x.T, bias=True).reshape(6, 6) + (1 - w) * np.cov(tongue.T, bias=True)
        cov = cov * quality.CONSISTENCY + np.diag(floors ** 2)
        centre = w * x.mean(axis=0) + (1 - w) * tongue.mean(axis=0)
        got = step.loc[key]
        assert np.allclose(got[[f"_c{i}" for i in range(6)]].to_numpy(float), centre, atol=1e-9)
        assert all(np.isclose(got[f"_s{i}_{j}"], cov[i, j], atol=1e-9)
                   for i in range(6) for j in range(i + 1))
    factor = quality._factored(quality._concentrated(rows, first)).toPandas().set_index(["lang", "source"])
    for key in list(sums)[:5]:
        s = np.array([[step.loc[key][f"_s{max(i, j)}_{min(i, j)}"] for j in range(6)] for i in range(6)], float)
        m = np.array([[factor.loc[key][f"_m{i}_{j}"] if j <= i else 0.0 for j in range(6)] for i in range(6)], float)
        assert np.allclose(m.T @ m, np.linalg.inv(s), rtol=1e-6)


def test_quality_small_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    assert quality.quality_verdicts(none).count() == 0
    assert quality.keep_quality(none).columns == none.columns
    text = " ".join(f"word{i}" for i in range(40))
    few = spark.createDataFrame([(1, text, "en", None, 3), (2, None, None, None, None), (1, text, "en", None, 3)], schema)
    kept = quality.keep_quality(few)
    assert kept.columns == few.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]


# --------------------------------------------------------------- token counts

def _best_segmentation(word, scores):
    text = trie_counts.WORD_MARK + word
    best = [(0.0, 0)] + [None] * len(text)
    for e in range(1, len(text) + 1):
        n = len(text[e - 1].encode())
        best[e] = (best[e - 1][0] + trie_counts.BYTE_SCORE * n, best[e - 1][1] + n)
        for s in range(e):
            if text[s:e] in scores and best[s][0] + scores[text[s:e]] > best[e][0]:
                best[e] = (best[s][0] + scores[text[s:e]], best[s][1] + 1)
    return best[-1][1]


@pytest.mark.parametrize("max_nodes", [1, 50, 10_000])
def test_trie_counts_match_single_words(spark, max_nodes):
    rng = random.Random(9)
    pieces = ["▁", "a", "b", "ab", "▁ab", "ba", "aba", "▁b", "bb", "é", "abab"]
    scores = trie_counts.rank_scores(pieces)
    rows = [(i, " ".join("".join(rng.choice("abé世") for _ in range(rng.randrange(1, 9)))
                         for _ in range(rng.randrange(20)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "ab" * 300), (100, None), (None, "ab ba")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = [(r["doc_id"], r["n_pretokens"], r["n_tokens"])
           for r in trie_counts.token_counts(docs, scores, max_nodes).collect()]
    want = [(i, len((t or "").split()), sum(_best_segmentation(w, scores) for w in (t or "").split()))
            for i, t in rows]
    assert collections.Counter(got) == collections.Counter(want)
    assert trie_counts.token_counts(docs.limit(0), scores).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_long_texts_and_tokens_count_the_same(monkeypatch, limit):
    rng = random.Random(limit)
    scores = trie_counts.rank_scores(["▁", "a", "b", "ab", "▁ab", "ba", "aba", "abab"])
    text = " ".join("".join(rng.choice("ab世") for _ in range(rng.randrange(1, 12))) for _ in range(80))
    want = (80, sum(_best_segmentation(w, scores) for w in text.split()))
    monkeypatch.setattr(trie_counts, "_SLICE", limit)
    monkeypatch.setattr(trie_counts, "LONG_TOKEN", limit)
    for max_nodes in (1, 30, 10_000):
        trie = trie_counts.ForwardTrie(scores, max_nodes)
        assert trie.count(text) == trie.count(text) == want
        assert len(trie.best) <= max_nodes + 14


def test_prefixes_are_scored_once():
    trie = trie_counts.ForwardTrie(trie_counts.rank_scores(["▁", "a", "b"]))
    trie.count("abab abab ababb aba")
    assert len(trie.best) == 1 + len("▁ababb")
