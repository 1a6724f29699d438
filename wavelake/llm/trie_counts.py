"""Token counts by trie-shared dynamic programming.

A unigram vocabulary (pieces with log-probabilities) segments each pre-token
(a white-space separated word with the word mark in front) into the pieces of
the best total score.  A task keeps its distinct pre-tokens in a trie; the
forward score of a node (the best segmentation of the prefix it spells) is
computed once and serves every pre-token with that prefix, and a terminal
stores its token count.  Documents then add up terminal counts.

The trie is a task's own and is dropped, also within a document, once it holds
``max_nodes`` nodes.  Long texts are read a slice at a time, and a pre-token of
over ``LONG_TOKEN`` characters is scored in a rolling window without nodes, so
memory is bounded whatever a text holds, and results do not depend on what
shares a task.  Nothing is shuffled.  The vocabulary (tens of thousands of
pieces) is the only broadcast.

Defined cases: null, empty and blank text count 0; characters outside the
vocabulary count one token per UTF-8 byte; repeated rows are counted each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import map_rows

WORD_MARK = "▁"
BYTE_SCORE = -20.0  # log-probability of one byte of an unknown character
MAX_NODES = 400_000
LONG_TOKEN = 4096    # characters
_SLICE = 1 << 20     # characters of a text that are split into words at a time
_BLANK = re.compile(r"\s")


def rank_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces listed from the most to the least frequent,
    by Zipf's law: proportional to 1 / rank."""
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class ForwardTrie:
    """Trie of pre-tokens whose nodes hold the best score and token count of
    the prefix they spell."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.max_nodes = max_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}      # node and character -> node
        self.best = [0.0]
        self.tokens = [0]
        self.terminal: dict[str, int] = {}   # pre-token -> token count

    def insert(self, word: str) -> int:
        """Token count of ``word`` (without its mark)."""
        spelled = WORD_MARK + word
        child, best, tokens, scores = self.child, self.best, self.tokens, self.scores
        longest = self.longest
        path, node = [0], 0
        for d, ch in enumerate(spelled, 1):
            key = node << 21 | ord(ch)
            known = child.get(key)
            if known is None:
                # the last character alone, as a piece or as bytes
                n_bytes = len(ch.encode("utf-8", "surrogatepass"))
                top, count = best[path[d - 1]] + BYTE_SCORE * n_bytes, tokens[path[d - 1]] + n_bytes
                for s in range(max(0, d - longest), d):
                    score = scores.get(spelled[s:d])
                    if score is not None and best[path[s]] + score > top:
                        top, count = best[path[s]] + score, tokens[path[s]] + 1
                known = child[key] = len(best)
                best.append(top)
                tokens.append(count)
            path.append(known)
            node = known
        self.terminal[word] = tokens[node]
        return tokens[node]

    def rolling(self, word: str) -> int:
        """As :meth:`insert`, keeping the scores of the last prefixes only."""
        spelled, scores, longest = WORD_MARK + word, self.scores, self.longest
        window = [(0.0, 0)]   # best score and tokens of the prefixes that a piece can follow
        for d, ch in enumerate(spelled, 1):
            n_bytes = len(ch.encode("utf-8", "surrogatepass"))
            top, count = window[-1][0] + BYTE_SCORE * n_bytes, window[-1][1] + n_bytes
            first = d - len(window)
            for s in range(first, d):
                score = scores.get(spelled[s:d])
                if score is not None and window[s - first][0] + score > top:
                    top, count = window[s - first][0] + score, window[s - first][1] + 1
            window.append((top, count))
            if len(window) > longest:
                del window[0]
        return window[-1][1]

    def _tokens(self, word: str) -> int:
        if len(word) > LONG_TOKEN:
            return self.rolling(word)
        if len(self.best) > self.max_nodes:
            self.clear()
        return self.insert(word)

    def count(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        n_words = n_tokens = 0
        for words in map(str.split, _slices(text or "")):
            new = set(words).difference(self.terminal)
            n_words += len(words)
            if len(self.best) + sum(map(len, new)) + len(new) <= self.max_nodes:
                for word in new:
                    self.insert(word)
                n_tokens += sum(map(self.terminal.__getitem__, words))
            else:   # the trie may be dropped between any two words
                for word, n in Counter(words).items():
                    known = self.terminal.get(word)
                    n_tokens += n * (self._tokens(word) if known is None else known)
        return n_words, n_tokens


def _slices(text: str) -> Iterator[str]:
    """The text in pieces that end at white space."""
    start = 0
    while len(text) - start > _SLICE:
        m = _BLANK.search(text, start + _SLICE)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.end()
    yield text[start:]


def token_counts(docs: DataFrame, scores: dict[str, float],
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = ForwardTrie(shared.value, max_nodes)
        for pdf in batches:
            counts = [trie.count(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy(),
                                "n_pretokens": [a for a, _ in counts],
                                "n_tokens": [b for _, b in counts]})

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, n_pretokens long, n_tokens long")


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model in vocabulary order, without control,
    unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
