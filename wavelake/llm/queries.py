"""The registered ``opN_*`` queries: thin digests of this package's operators
over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.common import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle.strip()
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


@cache
def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


# ------------------------------------------------- op3: SimHash near-dedup
@query("op3_simhash_near_dedup")
def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    from wavelake.llm.simhash import simhash_near_dedup

    rows = simhash_near_dedup(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id")


# ------------------------------------------------- op7: best-fit packing
@query("op7_best_fit_packing")
def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document with its place."""
    from wavelake.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"),
                          tokenizer_file("byte_bpe_50k.json"), with_ids=False)


# ------------------------------------------------- op6: language mixtures
@query("op6_language_mixtures")
def q_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from wavelake.llm.langid import identify_languages

    return identify_languages(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score")


# ------------------------------------------------- op9: license scan
@query("op9_license_scan")
def q_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    from wavelake.llm.license_scan import license_scan

    return license_scan(read_table(spark, sf_dir, "documents")).drop("spans")


# ------------------------------------------- op8: sources to target weights
@query("op8_mix_sources", oracle=r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT source, source_size, source_size * CAST(2.0 AS DOUBLE) AS cap,
         CAST([3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]
              AS DOUBLE) AS weight
  FROM t),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
             - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r
  WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (
              ORDER BY source_size / weight, source IS NULL, source
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_level
  FROM l),
p AS (
  SELECT source, source_size, coalesce(least(cap, final_level * weight), cap) AS target,
         CASE WHEN source_size > 0
              THEN floor(coalesce(least(cap, final_level * weight), cap) / source_size)
              ELSE 0 END AS whole
  FROM f),
k AS (
  SELECT d.source, d.key, d.size, p.target - p.whole * p.source_size AS need, count(*) AS copies
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
  WHERE d.size > 0 AND p.target - p.whole * p.source_size > 0 GROUP BY ALL),
c AS (
  SELECT source, key, least(copies, floor((need - coalesce(sum(size * copies) OVER (
           PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / size + CAST(0.5 AS DOUBLE))) AS sampled
  FROM k),
n AS (
  SELECT *, row_number() OVER (PARTITION BY source, key) AS copy FROM d)
SELECT n.doc_id, n.size, p.source_size, p.target,
       CASE WHEN n.size = 0 THEN 0 ELSE
         n.size * CAST(p.whole + CASE WHEN n.copy <= c.sampled THEN 1 ELSE 0 END AS BIGINT) END AS taken
FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source
LEFT JOIN c ON n.source IS NOT DISTINCT FROM c.source AND n.key = c.key
""")
def q_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    from wavelake.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).drop("repeats")


# ------------------------------------------------- op10: quality rules
@query("op10_quality_rules")
def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    from wavelake.llm.quality import quality_verdicts

    return quality_verdicts(read_table(spark, sf_dir, "documents")).drop("distance")


# ------------------------------------------- op5: main text of web pages
@query("op5_page_text")
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from wavelake.llm.html_extract import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


# ------------------------------------------- op2: token counts
@query("op2_trie_token_counts")
def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    import public_tokenizers

    from wavelake.llm.trie_counts import load_pieces, rank_scores, token_counts

    scores = rank_scores(load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts(read_table(spark, sf_dir, "documents"), scores)


# ------------------------------------------- op1: nearest neighbours
@query("op1_curve_neighbours")
def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every vector whose id is divisible by 100."""
    from wavelake.llm.ann_curves import nearest_neighbours

    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


# ------------------------------------------- op4: suffix-array dedup
@query("op4_suffix_dedup")
def q_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, and the digest of what is left."""
    from wavelake.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(read_table(spark, sf_dir, "documents")).drop("removed")


# ------------------------------------------- op13: secret scans
@query("op13_secret_scan")
def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    from wavelake.llm.secret_scan import scan_secrets, span_digests

    return span_digests(scan_secrets(read_table(spark, sf_dir, "documents")))


# ------------------------------------------- op11: vector code compression
def _codes_oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and floored means over all pairs of part and
    entry; squared distances of these integers are exact in doubles."""
    nearest = """
  SELECT id, p, x, e, d FROM (
    SELECT v.id, v.p, v.x, b.e, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x)
             + list_inner_product(b.x, b.x) AS d,
           row_number() OVER (PARTITION BY v.id, v.p ORDER BY
             list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x)
             + list_inner_product(b.x, b.x), b.e) AS k
    FROM v JOIN b{i} b USING (p)) WHERE k = 1"""
    steps = "".join(f"""
a{i} AS ({nearest.format(i=i)}),
m{i} AS (
  SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY j) AS x FROM (
    SELECT p, e, j, CAST(sum(CAST(x[j] AS BIGINT)) AS HUGEINT) AS s, count(*) AS c
    FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY p, e, j)
  GROUP BY p, e),
b{i + 1} AS (
  SELECT b.p, b.e, CAST(coalesce(m.x, b.x) AS DOUBLE[]) AS x
  FROM b{i} b LEFT JOIN m{i} m USING (p, e)),""" for i in range(rounds))
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label,
         list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (SELECT id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x
      FROM k, range({parts}) t(p)),
b0 AS (SELECT p, id - 1 AS e, x FROM v WHERE id <= {entries}),{steps}
a AS ({nearest.format(i=rounds)}),
c AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
             CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT)
               AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (id), h
"""


@query("op11_vector_codes", oracle=_codes_oracle())
def q_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and label error of every vector, and the digest of the
    codebooks."""
    from wavelake.llm.vector_codes import books_digest, compress_vectors, with_label_errors

    codes, books = compress_vectors(read_table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


# ------------------------------------------- op12: spelling variants
@query("op12_spelling_variants", oracle=r"""
WITH RECURSIVE
t AS (SELECT list(x ORDER BY i) AS crcs FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
           CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x
  FROM range(256) r(i))),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
             count(*) AS c
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''),
                                  '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
      GROUP BY ALL),
b AS (SELECT run, c, flatten(list_transform(
               string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x:
               CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
                    ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes
      FROM r),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, x:
               xor(a >> 8, crcs[xor(a, x) % 256 + 1]))) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run))
                       || substring(run, h % length(run) + 2) ELSE run END AS word,
             CAST(sum(c) AS BIGINT) AS n
      FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
d AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
      FROM w, range(1, length(word) + 1) p(i)),
p AS (SELECT x.word, y.word AS near, y.n AS near_n
      FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
      UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
      UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
f AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n
      FROM p GROUP BY word),
g AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near,
             CASE WHEN near_n >= 2 * n THEN near END AS form,
             CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
      FROM w LEFT JOIN f ON w.word = f.word),
s AS (SELECT word, word AS root FROM g WHERE form IS NULL
      UNION ALL SELECT g.word, s.root FROM g JOIN s ON g.form = s.word)
SELECT g.word, g.form, s.root, g.n, g.n_near, g.form_n FROM g JOIN s ON g.word = s.word
""")
def q_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word."""
    from wavelake.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"))
