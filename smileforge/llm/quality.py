"""Quality rules: base counts, and tokeniser fertility under public vocabularies.

Words of a text are encoded with two public vocabularies.  A document's
characters per token (both), share of byte-fallback tokens and entropy of its
tokens must lie within the band of its script, and its characters per token and
entropy also within fences fitted on the texts of its language in the same table.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import Workspace, hold, spread, table, trimmed
from .wordhash import text_chunks, word_hashes, word_spans

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
#: Base rules: fewest words, and largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3
#: By script: lowest and highest characters per token (of either vocabulary),
#: highest share of byte-fallback tokens, lowest entropy of the tokens in bits.
#: The entropy counts from as many tokens as BAND_TOKENS.  Wide on purpose: a
#: band rejects text that is no prose in its script, such as encoded data,
#: mojibake or one token over and over.
BANDS = {
    "latin": (1.25, 9.0, 0.10, 3.0),
    "cyrillic": (0.9, 7.0, 0.10, 3.0),
    "greek": (0.6, 6.0, 0.10, 3.0),
    "cjk": (0.3, 4.0, 0.60, 3.0),
    "other": (0.25, 9.0, 0.80, 2.5),
}
BAND_TOKENS = 50
#: A measure's fences lie so many interquartile ranges outside the quartiles of its group,
FENCE = 2.5
#: a range counting as this share of the lower quartile at least; smaller groups than FENCE_ROWS texts have none.
LEAST_RANGE, FENCE_ROWS = 0.01, 100
#: Distinct words whose ids a Python worker keeps; emptied when full.
CACHE_WORDS = 250_000
#: Words encoded together.
SLICE_WORDS = 300_000
_SCRIPTS = {name: regex.compile(rf"[{classes}]") for name, classes in {"cyrillic": r"\p{Cyrillic}", "greek": r"\p{Greek}", "cjk": r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}", "latin": r"\p{Latin}"}.items()}
_LATIN = _SCRIPTS["latin"]
_OTHER_LETTER = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)


def script(text: str) -> str:
    """The script of most letters (``other``: of none of those named)."""
    if text.isascii() or not _OTHER_LETTER.search(text):
        return "latin" if _LATIN.search(text) else "other"
    counts = {name: len(p.findall(text)) for name, p in _SCRIPTS.items()}
    name = max(counts, key=counts.get)
    return name if counts[name] else "other"


class Fertility:
    """Token statistics of documents from the ids of their distinct words."""

    def __init__(self, pieces: str, ranks: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        self.fallback = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.ids: dict[bytes, bytes] = {}
        self.n_ranks: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        missing = [w for w in words if w not in self.ids]
        if len(self.ids) + len(missing) > CACHE_WORDS and self.ids:
            self.ids.clear()
            self.n_ranks.clear()
            missing = list(words)
        for lo in range(0, len(missing), 20_000):
            part = missing[lo : lo + 20_000]
            shown = [w.decode() for w in part]
            self.ids.update((w, array("I", ids).tobytes()) for w, ids in zip(part, self.sp.encode(shown, num_threads=1), strict=True))
            encode = self.bpe.encode_ordinary
            self.n_ranks.update((w, len(encode(" " + s))) for w, s in zip(part, shown, strict=True))

    def measure(self, words: list[bytes], known: bool = False) -> tuple[int, int, int, float]:
        """(piece tokens, byte-fallback tokens, rank tokens, entropy of the piece tokens in bits); ``known``: all words have just been learned."""
        n_ranks, counts = 0, np.zeros(len(self.fallback), np.int64)
        for lo in range(0, len(words), SLICE_WORDS):
            part = words[lo : lo + SLICE_WORDS]
            if not known:
                self.learn(set(part))
            counts += np.bincount(np.frombuffer(b"".join(map(self.ids.__getitem__, part)), "<u4"), minlength=len(counts))
            n_ranks += sum(map(self.n_ranks.__getitem__, part))
        seen = counts[counts > 0]
        n = int(seen.sum())
        entropy = float(np.log2(n) - (seen * np.log2(seen)).sum() / n) if n else 0.0
        return n, int(counts[self.fallback].sum()), n_ranks, entropy


@lru_cache(maxsize=2)
def _fertility(pieces: str, ranks: str) -> Fertility:
    return Fertility(pieces, ranks)


def within(band: tuple[float, float, float, float], per_piece: float, per_rank: float, fallback: float, entropy: float, n_tokens: int) -> bool:
    low, high, most_fallback, least_entropy = band
    if n_tokens == 0:
        return True
    return low <= per_piece <= high and low <= per_rank <= high and fallback <= most_fallback and (n_tokens < BAND_TOKENS or entropy >= least_entropy)


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first occurrence included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    grams = hashes[:n].copy()
    for k in range(1, width):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + n]
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


_FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "script": pa.string(), "chars_per_piece": pa.float64(), "chars_per_rank": pa.float64(), "fallback_share": pa.float64(), "token_entropy": pa.float64()}


def rules(docs: DataFrame, bands: dict[str, tuple[float, float, float, float]] = BANDS, lang: str | None = None) -> DataFrame:
    """Base counts, fertility measures and verdict of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text has none
    and fails the base rules; a very long one is measured in slices.  The
    measures of a text without words are 0.
    Repeated rows give repeated rows, an empty table an empty result; other
    columns play no part, but ``lang`` names one that is put out as lang_.
    There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality", _fertility.cache_clear)
        f = _fertility(vocabulary_path(PIECES), vocabulary_path(RANKS))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _FIELDS}
            column = batch.column("text")
            for lo, data, offsets in text_chunks(column):
                starts, ends, rows = word_spans(data, offsets)
                hashes = word_hashes(data, starts, ends, fold=False)
                texts = [column[lo + k].as_py() or "" for k in range(len(rows) - 1)]
                split = [text.encode().split() for text in texts]
                together = len(starts) <= SLICE_WORDS
                if together:
                    f.learn(set().union(*split))
                for k, (text, words) in enumerate(zip(texts, split, strict=True)):
                    n = len(words)
                    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
                    repeat = repeated_words(hashes[rows[k] : rows[k + 1]])
                    pieces, fallback, ranks, entropy = f.measure(words, together)
                    kind = script(text)
                    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * n
                    a, b, c = (chars / pieces, chars / ranks, fallback / pieces) if n else (0.0, 0.0, 0.0)
                    ok = within(bands.get(kind, bands["other"]), a, b, c, entropy, pieces)
                    for name, v in zip(_FIELDS, (n, chars, sum(map(text.count, "#*$%&|<>")), duplicate_lines(text), repeat, failed, not failed and ok, kind, a, b, c, entropy), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), *(pa.array(out[k], t) for k, t in _FIELDS.items())], [*first, *_FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    first = ["doc_id"] if lang is None else ["doc_id", "lang_"]
    more = [] if lang is None else [F.col(f"`{lang}`").cast("string").alias("lang_")]
    return docs.select("doc_id", *more, "text").mapInArrow(trimmed(run), f"doc_id {kind}, {'' if lang is None else 'lang_ string, '}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_piece double, chars_per_rank double, fallback_share double, token_entropy double")


def _length() -> Column:
    """Pieces of a text as a power of two: entropy grows with a text's length, so it is compared among texts of like length."""
    pieces = F.col("word_chars") / F.nullif(F.col("chars_per_piece"), F.lit(0.0))
    return F.floor(F.log2(F.greatest(pieces, F.lit(1.0)))).cast("int")


def fences(measured: DataFrame) -> DataFrame:
    """Fences by script, language and length, from the texts of ``measured`` that pass the base rules; copies count once.

    Characters per token have one pair of fences a language, entropy a lower
    fence a length.  A length of too few texts takes the fence of the next
    shorter length that has one, and a language of too few texts has none.
    Quantiles come from sketches of bounded size.
    """
    texts = measured.where("not base_failed").select("script", "lang_", _length().alias("length_"), "word_chars", "chars_per_piece", "chars_per_rank", "token_entropy").distinct()

    def quartiles(*by: str) -> DataFrame:
        q = {c: F.percentile_approx(c, [0.25, 0.75], 10_000) for c in ("chars_per_piece", "chars_per_rank", "token_entropy")}
        return texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), *[x.alias(c) for c, x in q.items()])

    def fence(c: str, upper: bool = False) -> Column:
        low, high = F.col(c)[0], F.col(c)[1]
        reach = FENCE * F.greatest(high - low, LEAST_RANGE * low)
        return F.when(F.col("n_") >= FENCE_ROWS, high + reach if upper else low - reach)

    tokens = quartiles("script", "lang_").where(F.col("n_") >= FENCE_ROWS).select(
        F.col("script").alias("of_script"), F.col("lang_").alias("of_lang"),
        *[fence(c, upper).alias(f"{c}_{end}") for c in ("chars_per_piece", "chars_per_rank") for end, upper in (("low", False), ("high", True))],
    )
    shorter = Window.partitionBy("script", "lang_").orderBy("length_")
    lengths = quartiles("script", "lang_", "length_").select("script", "lang_", "length_", F.last(fence("token_entropy"), ignorenulls=True).over(shorter).alias("entropy_low"))
    return lengths.join(tokens, F.col("script").eqNullSafe(F.col("of_script")) & F.col("lang_").eqNullSafe(F.col("of_lang")), "inner").select(
        "of_script", "of_lang", F.col("length_").alias("of_length"), "entropy_low", *[c for c in tokens.columns if c.startswith("chars_")]
    )


def fitted_rules(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """``rules`` with the fences of the table itself: a text outside those of its language is not kept.

    The measures of all rows are taken once and written to the shared folder;
    the fences are a few numbers a language.
    """
    space = Workspace(docs.sparkSession, "quality")
    measured = space.write(rules(docs, lang=lang))
    known = space.write(fences(measured))
    within_ = F.lit(True)
    for c in ("chars_per_piece", "chars_per_rank"):
        within_ &= F.coalesce(F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")), F.lit(True))
    within_ &= F.coalesce(F.col("token_entropy") >= F.col("entropy_low"), F.lit(True))
    same = F.col("script").eqNullSafe(F.col("of_script")) & F.col("lang_").eqNullSafe(F.col("of_lang")) & _length().eqNullSafe(F.col("of_length"))
    columns = [(F.col("kept") & within_).alias("kept") if c == "kept" else F.col(c) for c in ["doc_id", *_FIELDS]]
    return measured.join(known, same, "left").select(*columns)


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility and verdict of every document, with fences fitted on the table."""
    return fitted_rules(spread(table(spark, sf_dir, "documents")))
