"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text.  The toxic one is trained on the passages of toxic documents whose
character 5-grams ordinary text lacks, and is followed by the ordinary content,
so that the two compressors differ only by what is specific to toxic text.
(With both dictionaries trained on plain windows of either kind, no toxic
document reaches the fixed limit: a toxic document is ordinary text but for a
few words, and what the dictionaries save on the rest hides them.)
Every window of a text is compressed with both; the bytes that the toxic
dictionary saves are compared with thresholds, and a logistic curve over the
counts, calibrated on labelled documents that the dictionaries have not seen,
gives the score.
"""

from __future__ import annotations

import gc
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, spread, table, trimmed
from .langid import held_out

#: Labelled documents of either kind that the model is fitted on, about; chosen by a hash of the id.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2000, 4000
#: Share of them that trains the dictionaries; the others calibrate the thresholds.
DICTIONARY_SHARE = 0.6
#: Windows of ordinary text, out of all of theirs, that the ordinary dictionary is trained on.
SAMPLE_WINDOWS = 30_000
#: Bytes of a window; it ends before a space where there is one in its second half.
WINDOW_BYTES = 128
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
GRAM = 5
LEVEL = 19
#: Saved bytes from which a window counts, for each of the counted features.
THRESHOLDS = (2, 3, 4, 6)
PREDICT_FROM = 0.7


def windows(text: str, size: int = WINDOW_BYTES) -> list[bytes]:
    data, out, lo = text.encode(), [], 0
    while lo < len(data):
        hi = lo + size
        if hi < len(data):
            cut = data.rfind(b" ", lo + size // 2, hi)
            hi = cut if cut > 0 else hi
        out.append(data[lo:hi])
        lo = hi
    return out


def specific(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Passages of toxic texts that consist of character n-grams found in several of them and in no ordinary text."""
    seen: set[str] = set()
    for t in ordinary:
        seen.update(t[i : i + GRAM] for i in range(len(t) - GRAM + 1))
    often: Counter[str] = Counter()
    for t in toxic:
        often.update({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} - seen)
    grams = {g for g, n in often.items() if n >= max(2, min(3, len(toxic) // 20), len(toxic) // 100)}
    out = []
    for t in toxic:
        cover = bytearray(len(t))
        for i in range(len(t) - GRAM + 1):
            if t[i : i + GRAM] in grams:
                cover[i : i + GRAM] = b"\1" * GRAM
        out += [t[m.start() : m.end()] for m in re.finditer(b"\1+", bytes(cover))]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a zstandard dictionary; of few samples, these themselves."""
    if sum(map(len, samples)) > size and len(samples) >= 8:
        try:
            # The tail is the content; the head holds tables for the entropy coder.
            return zstandard.train_dictionary(size + size // 12, samples, k=32, d=6).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


class Model:
    """Both dictionaries, and the weights of the calibrated curve (None: nothing was learned)."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b"", weights: np.ndarray | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._pair = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights, "_pair": None}

    def forget(self) -> None:
        """Release the compressors of a Python worker."""
        self._pair = None
        gc.collect()

    def _compressors(self):
        if self._pair is None:
            size = len(self.ordinary) + len(self.toxic)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW_BYTES, dict_size=size, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

            def compressor(content: bytes):
                if not content:
                    return zstandard.ZstdCompressor(compression_params=p)
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                return zstandard.ZstdCompressor(compression_params=p, dict_data=d)

            self._pair = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        return self._pair

    def saved(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        a, b = (c.compress for c in self._compressors())
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)], np.int64)

    def features(self, text: str) -> np.ndarray:
        d = self.saved(text)
        n = len(d)
        counts = [(d >= k).sum() for k in THRESHOLDS]
        best = np.clip(d.max(initial=0), 0, 12)
        return np.array([1.0, best / 4, *np.log1p(counts), *(np.sqrt(c / max(n, 1)) for c in counts[:2]), np.log1p(n)])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(text or "") @ self.weights, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge penalty on all but the first weight."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label); the result depends on the order of the rows only through which of them calibrate."""
    kinds = [[t for t, y in rows if y == k] for k in (0, 1)]
    if not kinds[0] or not kinds[1]:
        return Model()
    cut = [max(1, int(len(k) * DICTIONARY_SHARE)) for k in kinds]
    (plain, toxic), rest = [k[:c] for k, c in zip(kinds, cut, strict=True)], [k[c:] or k for k, c in zip(kinds, cut, strict=True)]
    rng = random.Random(7)
    ordinary_windows = [w for t in plain for w in windows(t, 96)]
    ordinary = trained(rng.sample(ordinary_windows, min(SAMPLE_WINDOWS, len(ordinary_windows))), ORDINARY_BYTES)
    model = Model(ordinary, trained([p.encode() for p in specific(toxic, plain)], TOXIC_BYTES))
    x = np.array([model.features(t) for k in rest for t in k])
    y = np.repeat([0.0, 1.0], [len(k) for k in rest])
    return Model(model.ordinary, model.toxic, logistic(x, y))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents that are not held out: about SAMPLE_TOXIC and SAMPLE_ORDINARY of them, whole texts.

    A document that is labelled both ways counts as toxic.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model()
    place = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30))
    share = F.when(F.col("label") == 1, min(1.0, SAMPLE_TOXIC / sizes[1])).otherwise(min(1.0, SAMPLE_ORDINARY / sizes[0]))
    chosen = known.where(place < share * (1 << 30))
    # As many ids as the sample has: bounded by the parameters above.
    sample = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "label_id")
    rows = sorted(((r["h"], r["text"], r["label"]) for r in sample.select("text", "label", F.xxhash64("label_id", F.lit(3)).alias("h")).collect()), key=lambda r: (r[0], r[1]))
    return fit([(t, y) for _, t, y in rows])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``; only ``text`` is an input.

    Null and empty texts have no window and the score of the curve's origin.
    Very long texts are scored whole.  Without labelled documents of both kinds every score is 0.  Repeated rows
    give repeated rows, an empty table an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hold("toxicity", m.forget)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, limit: float = PREDICT_FROM) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hold("toxicity", m.forget)
        for batch in batches:
            text = batch.column(place)
            yield batch.filter(pa.array([m.score(t.as_py()) < limit for t in text], pa.bool_()))

    place = docs.columns.index("text")
    return docs.mapInArrow(trimmed(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = scores(spread(docs), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
