"""License scan by diagonal voting.

All rolling word k-grams of the documents are hashed and joined by Spark to
the k-gram positions of a small set of templates.  A match votes for the
diagonal ``document position - template position``; votes add up per document,
template and diagonal, neighbouring diagonals (a word inserted or dropped)
merge into one span.  Every joined k-gram is first verified word by word.  A
span is verified by aligning the template's words with the document's around
each of its diagonals: at most ``max_drift`` words, and no more than a share
``1 - min_share`` of the template's, may be inserted, dropped or replaced, and
none of them may be one of ``MARKS``, which tell labels apart.

Base templates are short phrases that must stand consecutively (k is their
length); each of their matches is a place.  Others are license sentences; the
grams of a short one have fewer than k words, so that one of them survives
every change that is allowed.  An unverified span's share, which only the score
shows, is that of its k-grams.

The third kind are whole license bodies, in longer grams.  Between two of their
diagonals up to ``BODY_DRIFT`` words may be inserted or dropped (a name, say),
and a merged span is verified when ``BODY_SHARE`` of the body's grams stand on
its diagonals.

The template table has some thousand rows and is the only broadcast.  The
document is scanned once: a sentinel k-gram that every document carries and
that the template table holds brings documents without any match through the
join, and each document's rows meet by a row number given in that one scan.

Defined cases: null text counts as empty (no word, null first and last word,
empty labels, score 0); repeated rows and repeated ids are scanned each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelake.llm.license_texts import LICENSE_BODIES
from wavelake.session import ship_package

# Phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Common license sentences, as words, and their labels.
LICENSE_SENTENCES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "public-domain",
}

GRAM_WORDS = 3
MIN_SHARE = 0.8
MAX_DRIFT = 2  # words inserted or dropped between merged diagonals
BODY_GRAM = 5
BODY_DRIFT = 12
BODY_SHARE = 0.75
# Words that tell labels apart, besides numbers: they must stand as in the template.
MARKS = frozenset(
    "mit apache bsd isc mozilla mpl gnu gpl lgpl agpl lesser library affero cc by nc sa nd attribution "
    "noncommercial sharealike noderivatives noderivs non commercial share alike derivatives".split())
_SENTINEL = 0  # template number of the row that every document matches

# separators: all ASCII but digits and letters
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _grams(words: list[str], k: int) -> list[list[str]]:
    return [words[i:i + k] for i in range(len(words) - k + 1)]


def allowed_edits(n: int, min_share: float = MIN_SHARE, max_drift: int = MAX_DRIFT) -> int:
    """Words of an ``n``-word template that may be inserted, dropped or replaced."""
    return min(max_drift, int((1 - min_share) * n + 1e-9))


def _gram_size(n: int, k: int, min_share: float, max_drift: int) -> int:
    """Words per gram, at most ``k``: one gram survives all allowed edits."""
    edits = allowed_edits(n, min_share, max_drift)
    return max(1, min(k, (n - edits) // (edits + 1)))


def aligned(template: list[str], words: list[str], most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``words`` nearest to ``template``
    with at most ``most`` edits, none of them of a mark or number."""
    far = most + 1

    def cost(word: str) -> int:
        return far if word in MARKS or word.isdigit() else 1

    costs = [cost(w) for w in words]
    row = [(0, j) for j in range(len(words) + 1)]  # edits, start
    for t in template:
        drop = cost(t)
        new = [(row[0][0] + drop, row[0][1])]
        for j, w in enumerate(words):
            swap = 0 if w == t else max(drop, costs[j])
            new.append(min((row[j][0] + swap, row[j][1]), (row[j + 1][0] + drop, row[j + 1][1]),
                           (new[j][0] + costs[j], new[j][1]), key=lambda x: x[0]))
        row = new
    end = min(range(len(row)), key=lambda j: row[j][0])
    edits, start = row[end]
    return (edits, start, end) if edits <= most else None


def _verifier(templates: dict[int, tuple[list[str], int]]):
    """Alignment of each template with the words around a diagonal; null if
    there is none."""

    @F.pandas_udf("edits int, start int, end int")
    def verify(tmpl: pd.Series, near: pd.Series) -> pd.DataFrame:
        seen: dict[tuple, tuple] = {}
        out = []
        for t, words in zip(tmpl, near):
            if words is None:
                out.append((None, None, None))
                continue
            key = (t, *words)
            if key not in seen:
                seen[key] = aligned(templates[t][0], list(words), templates[t][1]) or (None, None, None)
            out.append(seen[key])
        return pd.DataFrame(out, columns=["edits", "start", "end"], dtype="Int32")

    return verify


def body_words(text: str) -> list[str]:
    """Words of a license body by the rule for documents."""
    return [w for w in re.split(_SEPARATORS, text.lower()) if w]


def template_positions(spark: SparkSession, base: dict[str, str], sentences: dict[str, str],
                       bodies: dict[str, str], k: int, min_share: float = MIN_SHARE,
                       max_drift: int = MAX_DRIFT) -> DataFrame:
    """``h, tmpl, label, is_base, is_body, k, tpos, n_grams, size, gram`` per
    template k-gram."""
    rows = []
    for kind, group in (("base", base), ("sentence", sentences), ("body", bodies)):
        for phrase, label in group.items():
            words = body_words(phrase) if kind == "body" else phrase.split()
            size = {"base": len(words), "body": min(BODY_GRAM, len(words))}.get(
                kind, _gram_size(len(words), k, min_share, max_drift))
            grams = _grams(words, size)
            number = len({r[0] for r in rows}) + 1
            rows += [(number, label, kind == "base", kind == "body", size, i, len(grams), len(words), g)
                     for i, g in enumerate(grams)]
    table = spark.createDataFrame(
        rows, "tmpl int, label string, is_base boolean, is_body boolean, k int, tpos int, n_grams int, "
              "size int, gram array<string>")
    table = table.withColumn("h", F.xxhash64("gram"))
    first = spark.range(1).select(
        F.lit(_SENTINEL).alias("tmpl"), F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("is_base"), F.lit(False).alias("is_body"), F.lit(0).alias("k"), F.lit(0).alias("tpos"),
        F.lit(1).alias("n_grams"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("gram"),
        F.lit(0).cast("long").alias("h"))
    return table.select(*first.columns).union(first)


def _ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def _rolling(k: int) -> Column:
    """Hash of every k consecutive words."""
    return F.when(F.col("n_words") >= k, F.transform(
        F.sequence(F.lit(0), F.col("n_words") - k),
        lambda i: F.xxhash64(*[F.col("words")[i + j] for j in range(k)]))
    ).otherwise(F.array().cast("array<bigint>"))


def diagonal_votes(docs: DataFrame, base: dict[str, str], sentences: dict[str, str],
                   bodies: dict[str, str], k: int, min_share: float = MIN_SHARE,
                   max_drift: int = MAX_DRIFT) -> DataFrame:
    """Votes per ``rid`` (row), template and diagonal, with the words ``near``
    a sentence's diagonal, from ``near_start`` on; the sentinel's row of each
    document carries its ``doc_id`` and ``n_words``."""
    table = template_positions(docs.sparkSession, base, sentences, bodies, k, min_share, max_drift)
    sizes = sorted({k, *(len(p.split()) for p in base), *(min(BODY_GRAM, len(body_words(p))) for p in bodies),
                    *(_gram_size(len(p.split()), k, min_share, max_drift) for p in sentences)})
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), _SEPARATORS),
                     lambda w: w != "")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
            .withColumn("rid", F.monotonically_increasing_id())
            .withColumn("n_words", F.size("words")))
    rows = rows.withColumn("hashes", F.concat(
        *[_rolling(n) for n in sizes], F.array(F.lit(0).cast("long"))))
    # the outer form: a filter on the array's size would be pushed below the
    # projection and evaluate every expression in it again
    grams = rows.select("rid", "doc_id", "n_words", "words",
                        F.posexplode_outer("hashes").alias("at", "gh"))
    # place of each size's k-grams within the concatenated array
    before, shift = F.lit(0), F.lit(0)
    for n in sizes:
        shift = F.when(F.col("k") == n, before).otherwise(shift)
        before = before + F.greatest(F.lit(0), F.col("n_words") - (n - 1))
    # No higher-order function here: the join must stay in the generated code
    # of the explosion, where the words of a row are passed on uncopied.
    def same(j: int) -> Column:
        word = F.get(F.col("words"), F.col("dpos") + j)
        return (F.col("k") <= j) | _ascii_lower(word).eqNullSafe(F.get(F.col("gram"), F.lit(j)))

    verified = reduce(lambda x, y: x & y, [same(j) for j in range(max(sizes))])
    hits = (grams.join(F.broadcast(table), F.col("gh") == F.col("h"))
            .withColumn("dpos", F.col("at") - shift)
            .filter((F.col("tmpl") == _SENTINEL) & (F.col("at") == before)
                    | (F.col("tmpl") != _SENTINEL) & (F.col("dpos") >= 0) & verified)
            .withColumn("diag", F.col("dpos") - F.col("tpos"))
            .withColumn("near_start", F.greatest(F.lit(0), F.col("diag") - max_drift))
            .withColumn("near", F.when(
                ~F.col("is_base") & ~F.col("is_body") & (F.col("tmpl") != _SENTINEL),
                F.slice("words", F.col("near_start") + 1, F.col("diag") + F.col("size") + max_drift
                        - F.col("near_start")))))
    return hits.groupBy("rid", "tmpl", "diag").agg(
        F.first("label").alias("label"), F.first("is_base").alias("is_base"),
        F.first("is_body").alias("is_body"), F.first("n_grams").alias("n_grams"), F.first("size").alias("size"),
        F.first("near").alias("near"), F.first("near_start").alias("near_start"), F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("votes"),
        F.min("dpos").alias("start"), F.max(F.col("dpos") + F.col("k")).alias("end"))


def license_scan(docs: DataFrame, base: dict[str, str] = BASE_PHRASES,
                 sentences: dict[str, str] = LICENSE_SENTENCES, bodies: dict[str, str] = LICENSE_BODIES,
                 k: int = GRAM_WORDS, min_share: float = MIN_SHARE, max_drift: int = MAX_DRIFT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score`` and ``spans`` (label, start, end, share)."""
    votes = diagonal_votes(docs, base, sentences, bodies, k, min_share, max_drift)
    templates = {len(base) + 1 + i: (p.split(), allowed_edits(len(p.split()), min_share, max_drift))
                 for i, p in enumerate(sentences)}
    ship_package(docs.sparkSession)
    votes = votes.withColumn("best", _verifier(templates)("tmpl", "near"))
    # bodies repeat words of their own, which leave diagonals far from the
    # body's: theirs are merged by distance, not in the order of their places
    along = Window.partitionBy("rid", "tmpl").orderBy(
        F.when(F.col("is_body"), F.col("diag")).otherwise(F.col("start")), "diag")
    apart = F.col("diag") - F.lag("diag").over(along)
    # a diagonal opens a new span unless it follows its predecessor closely
    follows = F.when(F.col("is_body"), apart <= BODY_DRIFT).otherwise(
        apart.between(-max_drift, max_drift)
        & (F.col("start") - F.lag("end").over(along) <= max_drift) & ~F.col("is_base"))
    spans = (votes.withColumn("opens", F.when(follows, 0).otherwise(1))
             .withColumn("span", F.sum("opens").over(along))
             .groupBy("rid", "tmpl", "span").agg(
                 F.first("label").alias("label"), F.first("is_base").alias("is_base"),
                 F.first("is_body").alias("is_body"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                 F.sum("votes").alias("votes"), F.min("start").alias("first"),
                 F.max("end").alias("last"), F.first("size").alias("size"),
                 F.least(F.lit(1.0), F.sum("votes") / F.first("n_grams")).alias("gram_share"),
                 F.min(F.when(F.col("best.edits").isNotNull(), F.struct(
                     "best.edits", (F.col("near_start") + F.col("best.start")).alias("start"),
                     (F.col("near_start") + F.col("best.end")).alias("end")))).alias("best"))
             .withColumns({"start": F.coalesce("best.start", "first"),
                           "end": F.coalesce("best.end", "last"),
                           "share": F.coalesce(1 - F.col("best.edits") / F.col("size"), "gram_share")}))
    base_hit = F.col("is_base") & (F.col("tmpl") != _SENTINEL)
    whole = F.col("is_body") & (F.col("gram_share") >= BODY_SHARE)
    found = (F.col("tmpl") != _SENTINEL) & (base_hit | whole | F.col("best").isNotNull())

    def names(which: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))

    return (spans.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(base_hit, F.col("votes"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base_hit, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base_hit, F.col("start"))).cast("long").alias("last_word"),
        names(base_hit).alias("base_labels"), names(found).alias("labels"),
        F.coalesce(F.max(F.when(F.col("tmpl") != _SENTINEL,
                                F.when(base_hit, 1.0).otherwise(F.col("share")))),
                   F.lit(0.0)).alias("score"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(found, F.struct(
            "start", "end", "label", "share"))))).alias("spans"))
        .drop("rid"))
