"""The pipeline's stages on a small corpus, each against its operator's rule."""

from __future__ import annotations

import collections
import zlib

import numpy as np

import corpus_pipeline
from wavelake.llm import quality, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_apply_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        rows[name], before = spark.read.parquet(f"{tmp_path}/{name}"), docs
        docs = rows[name]
        if name != "pack":
            assert docs.columns == COLUMNS

        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.quality_verdicts(before).filter("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept and 0 < len(kept) < before.count()
        elif name == "near_dedup":
            smallest = {r["component_id"] for r in simhash.simhash_near_dedup(before).collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(smallest)
        elif name == "passage_dedup":
            left = {r["doc_id"]: r["n_bytes"] - r["n_removed"]
                    for r in suffix_dedup.suffix_dedup(before).collect()}
            for r in docs.collect():
                assert left[r["doc_id"]] - 6 <= len(r["text"].encode()) <= left[r["doc_id"]]
                assert r["n_chars"] == len(r["text"])
        elif name == "source_mix":
            words = collections.Counter()
            for r in before.collect():
                words[r["source"]] += len(r["text"].split())
            taken = collections.Counter()
            for r in docs.collect():
                taken[r["source"]] += len(r["text"].split())
            assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.2 * sum(words.values())
            assert all(taken[s] <= 2 * words[s] for s in words)
        else:
            pieces = docs.collect()
            assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in before.collect()}
            used = collections.Counter()
            for p in pieces:
                used[p["sequence_id"]] += p["length"]
            assert max(used.values()) <= 2048


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_the_last_stage_gives_the_ids_of_every_sequence(spark):
    texts = ["one two three", "words of a long text " * 3000, "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, "another text"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.pack(spark, docs, SF).collect()
    assert len({(r["doc_id"], r["piece"], r["ids_crc32"]) for r in out}) == len(out) - 1  # one repeated row
    assert sum(r["piece"] == 0 for r in out) == len(rows) and len(out) > len(rows)
    held = collections.defaultdict(list)
    for r in out:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_stages_go_through_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, d int, _sh_id string, n int"
    long = "a sentence of many words that goes on and on " * 20_000
    prose = " ".join(f"word{i} goes with term{i * 7 % 31}" for i in range(60))
    odd = [(1, None, None, None, None), (None, prose, None, "a", 1), (2, "", "en", "a", 0), (3, long, "en", "b", 2),
           (4, prose + " more", "en", None, 3), (4, prose + " more", "en", None, 3), (5, prose, "en", "a", 4)]
    for k, rows in enumerate(([], odd, odd * 3)):
        docs = spark.createDataFrame([(*r, i, "x", 7) for i, r in enumerate(rows)], schema).repartition(3)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")
            assert name == "pack" or docs.columns == schema.replace(" long", "").replace(
                " string", "").replace(" int", "").split(", ")
        assert (docs.count() > 0) == bool(rows)


def test_a_table_that_the_next_stage_reads_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, SF)      # not written in between
    assert corpus_pipeline.near_dedup(spark, first, SF).count() > 0
