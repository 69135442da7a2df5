"""A corpus pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smileforge.llm import bpe, linededup, mixing, neardup, toxicity
from smileforge.llm.common import Workspace, disposable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  It learns from the labelled rows of ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source, or of a source's texts in one language, leave its texts; n_chars, where there is one, follows the text."""
    out = linededup.drop_boilerplate(docs, max_ratio=linededup.LANGUAGE_RATIO, part="lang", counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of every row."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_neardup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Toxicity has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage no longer needs is deleted."""
    space = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with disposable():
            docs = space.write(stage(spark, docs, sf_dir))
        space.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
