"""Language identification by multilingual mixtures.

Training counts byte trigrams (of lower-cased text, non-letters as blanks,
hashed into a fixed number of buckets) per language over every labelled
training document; tasks add up their own counts before the shuffle.

Prediction treats a document as a mixture of languages.  Its units are words,
each with a likelihood per language from the trigrams centred in it;
expectation-maximisation estimates the languages' shares of the words.  The
set of languages is the one, among the nested sets of the largest shares, with
the best likelihood less a penalty per language (``0.5 * ln(words)`` each, the
Bayesian information criterion, times ``penalty``).  The language with the
largest share is the prediction, that share its score.

The model holds ``BUCKETS`` floats per learned language and is the only thing
broadcast.  Arrays are bounded by ``_CELLS`` numbers: short texts are handled
together, as many as fit (fewer the more languages there are), and a text that
does not fit is read again, block by block, for every round, whose sums over the
words add up.

Defined cases: null text or text without a letter gives ``und`` with score 0;
so does every text when no labelled document exists.  A null doc_id counts as
the empty string in the fold rule (its crc32 is 0: held out).  Ties go to the
language that sorts first.  Repeated rows are predicted each; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import batches_of, map_rows

BUCKETS = 1 << 16
SMOOTHING = 0.05
PENALTY = 4.0
EM_ROUNDS = 8
REFIT_ROUNDS = 4
UNKNOWN = "und"
_SLICE_BYTES = 2 << 20
_CELLS = 32 << 20   # trigrams times languages of an array
_FLUSH_LANGUAGES = 64

_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Blanked bytes of the texts, a blank around each, and where each starts."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raws])
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", dtype=np.uint8)
    return _BLANKED[data], starts


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram centred at each letter byte, and those places."""
    at = np.flatnonzero(data[1:-1] != 32) + 1
    code = (data[at - 1].astype(np.uint32) << 16) | (data[at].astype(np.uint32) << 8) | data[at + 1]
    code *= np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int32), at


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that training leaves out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def count_trigrams(training: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``training`` (``text``, ``lang``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})
            counts.clear()

        for pdf in batches:
            for lang, group in pdf.groupby("lang", sort=False):
                for part in batches_of(group, "text", _SLICE_BYTES):
                    codes, _ = _trigrams(_stream(list(part["text"]))[0])
                    n = np.bincount(codes, minlength=BUCKETS)
                    counts[lang] = counts[lang] + n if lang in counts else n
            if len(counts) > _FLUSH_LANGUAGES:
                yield from flush()
        yield from flush()

    rows = training.filter("text is not null and lang is not null").select(
        "text", F.col("lang").cast("string").alias("lang"))
    return (map_rows(rows, run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def fit(training: DataFrame, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """Learned languages and their log-probabilities (bucket x language).  The
    counts have at most ``BUCKETS`` rows per language."""
    counts = count_trigrams(training).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)))
    which = {lang: i for i, lang in enumerate(langs)}
    table[counts["bucket"], counts["lang"].map(which)] = counts["n"]
    table += smoothing
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray,
        shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after ``rounds`` of expectation-maximisation, and each document's
    log-likelihood (of the scaled likelihoods) under the shares before the last."""
    total = None
    for _ in range(rounds):
        weight = like * shares[doc]
        total = weight.sum(axis=1)
        weight /= total[:, None]
        shares = np.add.reduceat(weight, starts, axis=0) / n[:, None]
    return shares, np.add.reduceat(np.log(total, dtype=np.float64), starts)


def mixtures(texts: list[str], logp: np.ndarray, penalty: float = PENALTY
             ) -> tuple[np.ndarray, np.ndarray]:
    """(shares, words): per text the languages' shares in the selected set
    (zero outside it, all zero without words)."""
    n_langs = logp.shape[1]
    out = np.zeros((len(texts), n_langs))
    words = np.zeros(len(texts), dtype=np.int64)
    data, text_at = _stream(texts)
    codes, at = _trigrams(data)
    if not len(at) or not n_langs:
        return out, words
    first = np.flatnonzero(data[at - 1] == 32)  # trigrams that begin a word
    like = np.add.reduceat(logp[codes], first, axis=0)
    like -= like.max(axis=1, keepdims=True)
    single = like.astype(np.float64)
    np.exp(like, out=like)
    like += np.float32(1e-30)
    owner = np.searchsorted(text_at, at[first] - 1, side="right") - 1
    has, starts = np.unique(owner, return_index=True)
    n = np.diff(np.append(starts, len(owner)))
    words[has] = n
    doc = np.repeat(np.arange(len(has)), n)
    even = np.full((len(has), n_langs), 1 / n_langs, dtype=np.float32)
    full, _ = _em(like, doc, starts, n, even, EM_ROUNDS)
    rank = np.argsort(-full, axis=1, kind="stable")
    alone = np.add.reduceat(single, starts, axis=0)
    # the best single language by its own likelihood leads the nested sets
    lead = alone.argmax(axis=1)
    for i in np.flatnonzero(rank[:, 0] != lead):
        rank[i] = [lead[i], *[x for x in rank[i] if x != lead[i]]]
    best = np.zeros_like(full)
    best[np.arange(len(has)), lead] = 1
    score = alone.max(axis=1)
    cost = 0.5 * penalty * np.log(np.maximum(n, 2))
    live = np.arange(len(has))
    for k in range(2, n_langs + 1):
        if not len(live):
            break
        keep = np.zeros((len(has), n_langs), dtype=np.float32)
        np.put_along_axis(keep, rank[:, :k], 1, axis=1)
        use = np.isin(doc, live) if len(live) < len(has) else slice(None)
        trial = np.maximum(full[live], 1e-4) * keep[live]
        trial /= trial.sum(axis=1, keepdims=True)
        n_live = n[live]
        at_live = np.concatenate(([0], np.cumsum(n_live)[:-1]))
        shares, fit_score = _em(like[use], np.repeat(np.arange(len(live)), n_live), at_live,
                                n_live, trial, REFIT_ROUNDS)
        fit_score -= cost[live] * (k - 1)
        won = fit_score > score[live]
        best[live[won]], score[live[won]] = shares[won], fit_score[won]
        live = live[won]
    out[has] = best
    return out, words


def long_mixture(text: str, logp: np.ndarray, penalty: float = PENALTY,
                 size: int = _SLICE_BYTES) -> tuple[np.ndarray, int]:
    """(shares, words) of one text as :func:`mixtures` gives them, from arrays
    for ``size`` of its bytes."""
    n_langs = logp.shape[1]
    data, _ = _stream([text])

    def likelihoods() -> Iterator[np.ndarray]:
        """Scaled log-likelihoods, word by language, block by block; a word
        that goes on in the next block is held back."""
        held = None
        for i in range(1, len(data) - 1, size):
            block = data[i - 1:min(i + size, len(data) - 1) + 1]
            codes, at = _trigrams(block)
            if not len(at):
                continue
            begins = np.flatnonzero(block[at - 1] == 32)
            anew = len(begins) > 0 and begins[0] == 0
            like = np.add.reduceat(logp[codes], begins if anew else [0, *begins], axis=0)
            if held is not None:
                if anew:
                    yield held - held.max(axis=1, keepdims=True)
                else:
                    like[0] += held[0]
            held, like = like[-1:], like[:-1]
            if len(like):
                yield like - like.max(axis=1, keepdims=True)
        if held is not None:
            yield held - held.max(axis=1, keepdims=True)

    def em(shares: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        fit_score = 0.0
        for _ in range(rounds):
            mass, fit_score = np.zeros(n_langs), 0.0
            for like in likelihoods():
                weight = (np.exp(like) + np.float32(1e-30)) * shares.astype(np.float32)
                total = weight.sum(axis=1)
                mass += (weight / total[:, None]).sum(axis=0, dtype=np.float64)
                fit_score += float(np.log(total, dtype=np.float64).sum())
            shares = mass / n
        return shares, fit_score

    n, alone = 0, np.zeros(n_langs)
    for like in likelihoods() if n_langs else ():
        n += len(like)
        alone += like.sum(axis=0, dtype=np.float64)
    if not n:
        return np.zeros(n_langs), 0
    full, _ = em(np.full(n_langs, 1 / n_langs), EM_ROUNDS)
    lead = int(alone.argmax())
    rank = [lead, *[x for x in np.argsort(-full, kind="stable").tolist() if x != lead]]
    best, score = np.eye(n_langs)[lead], float(alone.max())
    cost = 0.5 * penalty * np.log(max(n, 2))
    for k in range(2, n_langs + 1):
        trial = np.zeros(n_langs)
        trial[rank[:k]] = np.maximum(full[rank[:k]], 1e-4)
        shares, fit_score = em(trial / trial.sum(), REFIT_ROUNDS)
        if fit_score - cost * (k - 1) <= score:
            break
        best, score = shares, fit_score - cost * (k - 1)
    return best, n


def bounded_mixtures(texts: list[str], logp: np.ndarray, penalty: float = PENALTY,
                     cells: int = _CELLS) -> tuple[np.ndarray, np.ndarray]:
    """:func:`mixtures` of texts of any number and length."""
    size = max(1, cells // max(1, logp.shape[1]))   # bytes, at most a trigram each
    out, words = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), dtype=np.int64)
    some: list[int] = []
    held = 0

    def finish() -> None:
        if some:
            out[some], words[some] = mixtures([texts[i] for i in some], logp, penalty)
            some.clear()

    for i, text in enumerate(texts):
        if 4 * len(text) > size and len(text.lower().encode("utf-8", "surrogatepass")) > size:
            out[i], words[i] = long_mixture(text, logp, penalty, max(1, size // 4))
            continue
        if held + 4 * len(text) > size:
            finish()
            held = 0
        some.append(i)
        held += 4 * len(text)
    finish()
    return out, words


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray],
            penalty: float = PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, langs, shares`` of every row of ``docs``:
    the prediction, and the selected languages with their shares."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    names = np.array(langs, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in batches_of(pdf, "text", _SLICE_BYTES):
                texts = [t if t and _has_letter(t) else "" for t in part["text"]]
                shares, words = bounded_mixtures(texts, shared.value, penalty)
                known = words > 0
                top = shares.argmax(axis=1) if len(names) else np.zeros(len(texts), int)
                order = [[j for j in np.argsort(-s, kind="stable") if s[j] > 0] for s in shares]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                    "lang_pred": [names[t] if k else UNKNOWN for t, k in zip(top, known)],
                    "score": [float(min(1.0, s[t])) if k else 0.0
                              for s, t, k in zip(shares, top, known)],
                    "langs": [[names[j] for j in o] for o in order],
                    "shares": [[float(s[j]) for j in o] for s, o in zip(shares, order)],
                })

    schema = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def identify_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the labelled documents outside fold 0 and predict all:
    ``doc_id, held_out, lang_pred, score, langs, shares``."""
    model = fit(docs.filter(~held_out(F.col("doc_id"), folds)))
    out = predict(docs, model)
    return out.withColumn("held_out", held_out(F.col("doc_id"), folds))
