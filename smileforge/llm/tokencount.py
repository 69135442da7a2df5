"""Token counts by dynamic programming over a trie of pre-tokens.

The best unigram segmentation of every prefix of a pre-token depends on that
prefix only.  Distinct pre-tokens are inserted in a trie; a node holds the best
score of its prefix and the tokens that it takes, computed once however many
pre-tokens share the prefix.  The count at a pre-token's last node is stored,
and a document's tokens are the sum over its pre-tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import vocabulary_path
from .common import hold, spread, table, trimmed

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Score of a character that no entry covers; it counts a token for each byte.
UNKNOWN = -30.0
#: Pre-tokens whose counts a Python worker keeps; emptied when full.
MAX_COUNTS = 400_000
#: Words whose distinct pre-tokens share one trie.
SLICE_WORDS = 500_000


def unigram_scores(path: str) -> dict[str, float]:
    """Log-probability of every ordinary entry of a sentencepiece file, by Zipf's law over its rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}


class TokenCounter:
    """Counts of pre-tokens, from tries of the distinct pre-tokens not seen before.

    The trie is walked depth first: pre-tokens come in sorted order, so the
    nodes from the root to the current one are the only ones in memory, and a
    shared prefix is scored once.  Matches of vocabulary entries come from an
    Aho-Corasick automaton, which starts at the first new node.
    """

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.longest = max(map(len, scores), default=1)
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.counts: dict[bytes, int] = {}

    def _insert(self, words: list[bytes]) -> None:
        matches, longest, counts = self.automaton.iter, self.longest, self.counts
        score, tokens, before = [0.0], [0], ""
        for text, word in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            k, most = 0, min(len(before), len(text))
            while k < most and before[k] == text[k]:
                k += 1
            del score[k + 1 :], tokens[k + 1 :]
            for end, (n, p) in matches(text, max(0, k + 1 - longest)):
                end += 1
                if end <= k:
                    continue
                while len(score) <= end:
                    self._unknown(score, tokens, text)
                s = score[end - n] + p
                if s > score[end] or s == score[end] and tokens[end - n] + 1 < tokens[end]:
                    score[end], tokens[end] = s, tokens[end - n] + 1
            while len(score) <= len(text):
                self._unknown(score, tokens, text)
            counts[word] = tokens[-1]
            before = text

    @staticmethod
    def _unknown(score: list[float], tokens: list[int], text: str) -> None:
        """The next node, as if no entry ended there: its character becomes bytes."""
        c = text[len(score) - 1]
        tokens.append(tokens[-1] + (1 if c < "\x80" else len(c.encode())))
        score.append(score[-1] + UNKNOWN)

    def count(self, docs: list[list[bytes]]) -> list[int]:
        """Tokens of each document, given as its pre-tokens."""
        distinct = set().union(*docs)
        missing = [w for w in distinct if w not in self.counts]
        if len(self.counts) + len(missing) > MAX_COUNTS and self.counts:
            self.counts.clear()
            missing = list(distinct)
        self._insert(missing)
        return [sum(map(self.counts.__getitem__, words)) for words in docs]


def _slices(texts: pa.Array) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows and their words, up to SLICE_WORDS together; a longer text comes in parts."""
    rows, words, n = [], [], 0
    for i, text in enumerate(texts):
        all_ = (text.as_py() or "").encode().split()
        for lo in range(0, len(all_) or 1, SLICE_WORDS):
            rows.append(i)
            words.append(all_[lo : lo + SLICE_WORDS])
            n += len(words[-1])
            if n >= SLICE_WORDS:
                yield rows, words
                rows, words, n = [], [], 0
    if rows:
        yield rows, words


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(unigram_scores(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of ``docs``.

    Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, each
    with a leading mark as the vocabulary has it; very long texts come in
    slices of words.  Null, empty and blank texts have no tokens.  Repeated rows give repeated rows, an empty table an empty
    result; other columns play no part.  There is no shuffle: the tries
    belong to the Python workers and are bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("tokencount", _counter.cache_clear)
        counter = _counter(vocabulary_path(vocabulary))
        for batch in batches:
            n_words, n_tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for rows, words in _slices(batch.column("text")):
                np.add.at(n_words, rows, [len(w) for w in words])
                np.add.at(n_tokens, rows, counter.count(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts(spread(table(spark, sf_dir, "documents")))
