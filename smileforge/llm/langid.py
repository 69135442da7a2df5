"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each entry of a fixed public vocabulary.
A word's probability in a language is the sum over all segmentations into
entries of the product of their probabilities, which a forward pass gives; a
text's is the product over its words.  The probabilities are fitted by
expectation-maximisation over the words of a bounded sample of labelled
documents; expected counts come from forward and backward passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import Workspace, hold, spread, table, trimmed
from .tokencount import MARK, unigram_scores

VOCABULARY = "piece_bpe_32k.model"
#: Characters of labelled documents that a language is fitted on, about; whole documents, chosen by a hash of the id.
SAMPLE_CHARS = 500_000
EM_ROUNDS = 3
#: Expected count added to every entry.
SMOOTHING = 0.02
#: Words of more letters are scored one by one with a rescaled forward pass; in fitting they are learned in parts.
LONG_WORD = 48
#: Factor per character that keeps the forward values of other words near 1.
SCALE = 16.0
#: Positions of a long word between two rescalings: the smallest product over them stays within double precision.
RESCALE = 16
#: Probability of a character as such, in any language.
ANY_CHAR = 1e-7
#: Words whose log probabilities a Python worker keeps; emptied when full.
CACHE_WORDS = 300_000
#: Words of documents that are scored together, and of a longer document that are added up together.
SLICE_WORDS = 150_000
UNKNOWN_LANGUAGE = "und"
_LETTERS = regex.compile(r"\p{L}+")
_NO_LETTERS = regex.compile(r"[^\p{L}\s]+")


def held_out(doc_id: Column) -> Column:
    """Every third document by checksum is kept from training (null id: never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def letters(word: str) -> str:
    """The letters of a word, lower-cased."""
    return _NO_LETTERS.sub("", word).lower()


def parts(word: str) -> list[str]:
    """The letters of a word, marked; of a long word in parts (for fitting only)."""
    x = letters(word)
    return [MARK + x[k : k + LONG_WORD] for k in range(0, len(x), LONG_WORD)]


class Lattice:
    """All occurrences of vocabulary entries in a list of words, in the order of their ends."""

    def __init__(self, automaton, words: list[str]):
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        text = "\n".join(words)
        found = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
        ends, value = found[:, 0] + 1, found[:, 1]
        length, piece = value & 0xFF, value >> 8
        word = np.searchsorted(begins, ends - 1, "right") - 1
        self.size = sizes - 1
        #: Occurrences as (word, start, end, entry); the character itself has the entry -1.
        chars = np.repeat(np.arange(len(words)), self.size)
        at = np.arange(len(chars)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        e = ends - begins[word]
        self.word, self.start, self.end, self.piece = (np.concatenate(x) for x in ((word, chars), (e - length, at), (e, at + 1), (piece, np.full(len(chars), -1))))
        order = np.lexsort((self.word, self.end))
        self.word, self.start, self.end, self.piece = self.word[order], self.start[order], self.end[order], self.piece[order]
        self.most = int(self.size.max(initial=0))

    def weights(self, p: np.ndarray) -> np.ndarray:
        """Scaled probability of each occurrence in each language; ``p`` has a last row for single characters."""
        return p[self.piece] * SCALE ** (self.end - self.start)[:, None]

    def forward(self, w: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: sum over the segmentations up to the position."""
        alpha = np.zeros((len(self.size), self.most + 1, w.shape[1]))
        alpha[:, 0] = 1
        cuts = np.searchsorted(self.end, np.arange(self.most + 2))
        for e in range(1, self.most + 1):
            s = slice(cuts[e], cuts[e + 1])
            if s.stop == s.start:
                continue
            words = self.word[s]
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            alpha[words[first], e] = np.add.reduceat(alpha[words, self.start[s]] * w[s], first)
        return alpha

    def backward(self, w: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.size), self.most + 1, w.shape[1]))
        beta[np.arange(len(self.size)), self.size] = 1
        order = np.lexsort((self.word, -self.start))
        starts = self.start[order]
        cuts = np.searchsorted(-starts, -np.arange(self.most + 1))
        for at in range(self.most - 1, -1, -1):
            o = order[cuts[at] : cuts[at - 1] if at else len(order)]
            if not len(o):
                continue
            words = self.word[o]
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            beta[words[first], at] += np.add.reduceat(beta[words, self.end[o]] * w[o], first)
        return beta


def automaton(path: str):
    """The vocabulary's entries that can occur in marked lower-case letters, numbered, as an automaton."""
    import ahocorasick

    a = ahocorasick.Automaton()
    entries = [p for p in unigram_scores(path) if p.removeprefix(MARK) == "".join(_LETTERS.findall(p)).lower() and len(p) < 256]
    for i, p in enumerate(entries):
        a.add_word(p, i << 8 | len(p))
    a.make_automaton()
    return a, len(entries), max(map(len, entries), default=1)


@lru_cache(maxsize=2)
def _automaton(path: str):
    return automaton(path)


class Model:
    """Piece probabilities by language."""

    def __init__(self, path: str, languages: list[str], p: np.ndarray):
        self.path, self.languages, self.p = path, languages, p
        self._known: dict[str, int] = {}
        self._table = np.zeros((0, len(languages)))

    def __getstate__(self):
        return {"path": self.path, "languages": self.languages, "p": self.p, "_known": {}, "_table": np.zeros((0, len(self.languages)))}

    def forget(self) -> None:
        """Release the tables of a Python worker."""
        _automaton.cache_clear()
        self._known, self._table = {}, np.zeros((0, len(self.languages)))

    def log_words(self, words: list[str]) -> np.ndarray:
        """log probability of each word in each language, over all segmentations; 0 for a word without letters."""
        return self._log([letters(w) for w in words])

    def _log(self, shown: list[str]) -> np.ndarray:
        out = np.zeros((len(shown), len(self.languages)))
        usual = sorted((k for k, x in enumerate(shown) if 0 < len(x) <= LONG_WORD), key=lambda k: len(shown[k]))
        for lo in range(0, len(usual), 8192):
            some = usual[lo : lo + 8192]
            lattice = Lattice(_automaton(self.path)[0], [MARK + shown[k] for k in some])
            alpha = lattice.forward(lattice.weights(self.p))
            out[some] = np.log(alpha[np.arange(len(some)), lattice.size]) - (lattice.size * np.log(SCALE))[:, None]
        for k, x in enumerate(shown):
            if len(x) > LONG_WORD:
                out[k] = self.log_long(MARK + x)
        return out

    def log_long(self, text: str) -> np.ndarray:
        """The same forward pass for one word of any length: the values of the last positions are kept and rescaled together."""
        a, _, longest = _automaton(self.path)
        log, recent, found = np.zeros(len(self.languages)), [np.ones(len(self.languages))], a.iter(text)
        end, value = next(found, (-1, 0))
        for e in range(len(text)):
            v = recent[-1] * self.p[-1]
            while end == e:
                v = v + recent[-(value & 0xFF)] * self.p[value >> 8]
                end, value = next(found, (-1, 0))
            recent.append(v)
            if e % RESCALE == RESCALE - 1:
                recent = [x / v for x in recent[-longest:]]
                log += np.log(v)
        return log + np.log(recent[-1])

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self._known]
        if len(self._known) + len(new) > CACHE_WORDS and self._known:
            self._known, self._table, new = {}, self._table[:0], list(words)
        n = len(self._known)
        self._known.update(zip(new, range(n, n + len(new)), strict=True))
        if n + len(new) > len(self._table):
            grown = np.zeros((max(2 * len(self._table), n + len(new), 4096), len(self.languages)))
            grown[:n] = self._table[:n]
            self._table = grown
        self._table[n : n + len(new)] = self._log(new)

    def _sum(self, words: list[str]) -> np.ndarray:
        """Sum over the words, in an order that only the text decides."""
        counts = Counter(words)
        rows = np.fromiter(map(self._known.__getitem__, counts), np.int64, len(counts))
        return (self._table[rows] * np.fromiter(counts.values(), float, len(counts))[:, None]).sum(axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; words of many texts are scored together."""
        out: list = [(UNKNOWN_LANGUAGE, 0.0)] * len(texts)
        if not self.languages:
            return out
        waiting: list[tuple[int, list[str]]] = []
        n = 0

        def settle() -> None:
            self._learn({w for _, words in waiting for w in words})
            for i, words in waiting:
                out[i] = self._best(self._sum(words))
            waiting.clear()

        for i, text in enumerate(texts):
            if not text or not _LETTERS.search(text):
                continue
            words = letters(text).split()  # a word's letters stay together
            if len(words) > SLICE_WORDS:
                total = np.zeros(len(self.languages))
                for lo in range(0, len(words), SLICE_WORDS):
                    part = words[lo : lo + SLICE_WORDS]
                    self._learn(set(part))
                    total += self._sum(part)
                out[i] = self._best(total)
                continue
            waiting.append((i, words))
            n += len(words)
            if n >= SLICE_WORDS:
                settle()
                n = 0
        settle()
        return out

    def _best(self, log: np.ndarray) -> tuple[str, float]:
        best = int(np.argmax(log))
        return self.languages[best], float(1 / np.exp(log - log[best]).sum())


def fit(counts: list[tuple[str, str, int]], languages: list[str], path: str, rounds: int = EM_ROUNDS) -> Model:
    """A model from (language, word, count)."""
    a, n, _ = _automaton(path)
    p = np.full((n + 1, len(languages)), 1.0 / (n + 1))
    p[-1] = ANY_CHAR
    index = {lang: i for i, lang in enumerate(languages)}
    merged: dict[str, np.ndarray] = {}
    for lang, word, k in counts:
        for x in parts(word):
            merged.setdefault(x, np.zeros(len(languages)))[index[lang]] += k
    words = sorted(merged, key=lambda x: (len(x), x))
    weight = np.array([merged[w] for w in words]).reshape(len(words), len(languages))
    blocks = [(Lattice(a, words[lo : lo + 8192]), weight[lo : lo + 8192]) for lo in range(0, len(words), 8192)]
    for _ in range(rounds):
        expected = np.full((n + 1, len(languages)), SMOOTHING)
        for lattice, k in blocks:
            w = lattice.weights(p)
            alpha, beta = lattice.forward(w), lattice.backward(w)
            z = alpha[np.arange(len(lattice.size)), lattice.size]
            share = alpha[lattice.word, lattice.start] * w * beta[lattice.word, lattice.end] * (k / z)[lattice.word]
            real = lattice.piece >= 0
            for j in range(len(languages)):
                expected[:, j] += np.bincount(lattice.piece[real], share[real, j], minlength=n + 1)
        p = expected / expected[:-1].sum(axis=0)
        p[-1] = ANY_CHAR
    return Model(path, languages, p)


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on documents that are not held out and whose language is not null.

    Of each language whole documents of about ``sample_chars`` characters in
    all are taken, chosen by a hash of their id; all their words count.
    """
    path = vocabulary_path(vocabulary)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # A row a language: so many values as the model has columns.
    sizes = labelled.groupBy("lang").agg(F.greatest(F.sum(F.length("text")), F.lit(1)).alias("chars")).select(F.col("lang").alias("of_lang"), (F.lit(float(sample_chars)) / F.col("chars")).alias("share"))
    sizes = Workspace(docs.sparkSession, "langid").write(sizes)
    languages = sorted(r["of_lang"] for r in sizes.collect())
    if not languages:
        return Model(path, [], np.zeros((1, 0)))
    sample = labelled.join(sizes, F.col("lang") == F.col("of_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    words = sample.select("lang", F.explode(F.split("text", r"\s+")).alias("word")).where(F.length("word") > 0)
    counts = words.groupBy("lang", "word").count().collect()
    return fit(sorted((r["lang"], r["word"], r["count"]) for r in counts), languages, path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``.

    The score is the posterior of the predicted language with equal priors.  A
    null text, or one without a letter, is ``und`` with score 0, as is every
    text if no language was learned.  Ties go to the first language by name.
    Only ``text`` is an input; it is taken whole, however long, and a word's
    segmentations are all summed, however many letters it has.  Repeated rows give repeated rows, an empty
    table an empty result.  The model, whose size the vocabulary and the number
    of languages bound, goes to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hold("langid", m.forget)
        for batch in batches:
            got = m.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = identify(spread(docs), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
