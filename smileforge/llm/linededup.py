"""Line dedup by site-relative frequency.

For every host, the pages that contain a line are divided by the pages of the
host; lines above a boilerplate ratio are dropped from all pages of the host.
Optionally the pages of a host are also taken part by part (by language), so that
boilerplate of a host's minority languages is found.  Lines are counted once a page.  A line travels as two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, join_side, table
from .urlfilter import host_and_path

#: A line is boilerplate if it is on more than this share of its host's pages,
MAX_RATIO = 0.01
#: and on at least so many of them (a host of few pages says nothing about its lines).
MIN_PAGES = 5
#: The share where a host's pages are also taken by language, and where near-dedup follows: a text with
#: many copies on a host must still reach it whole.
LANGUAGE_RATIO = 0.08
#: Boilerplate lines of all hosts up to which their hashes (16 bytes each) are broadcast; more are joined by host and salt.
BROADCAST_LINES = 500_000
_BLANK = r"^[\x20\x09-\x0D]*$"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, part: str | None = None) -> DataFrame:
    """One row per host with boilerplate: (host_, lines_), lines_ being the hashes of its boilerplate lines.

    With ``part`` (a column, such as the language) a line is boilerplate of the
    host also if it is so among the host's pages of one part.  A host has at
    most (its mean number of lines a page / ``max_ratio``) lines, or that sum
    over the host and its parts, however many pages it has.  Counts are
    combined before the shuffle.
    """
    keys = F.transform(F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: ~x.rlike(_BLANK)), _key)
    groups = ["host_"] if part is None else ["host_", "part_"]
    named = [F.col(f"`{c}`").alias(g) for c, g in zip((host, part), groups)]
    per_line = docs.select(*named, F.explode(keys).alias("k_")).groupBy(*groups, "k_").agg(F.count(F.lit(1)).alias("n_"))
    pages = docs.select(*named).groupBy(*groups).agg(F.count(F.lit(1)).alias("pages_"))

    def above(lines: DataFrame, of: DataFrame, by: list[str]) -> DataFrame:
        of = of.select("pages_", *[F.col(g).alias(f"of_{g}") for g in by])
        same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in by]
        return lines.where(F.col("n_") >= min_pages).join(of, same, "inner").where(F.col("n_") > max_ratio * F.col("pages_")).select("host_", "k_")

    if part is None:
        return above(per_line, pages, groups).groupBy("host_").agg(F.collect_list("k_").alias("lines_"))
    whole = above(per_line.groupBy("host_", "k_").agg(F.sum("n_").alias("n_")), pages.groupBy("host_").agg(F.sum("pages_").alias("pages_")), ["host_"])
    return whole.unionByName(above(per_line, pages, groups)).groupBy("host_").agg(F.collect_set("k_").alias("lines_"))


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, part: str | None = None, counts: bool = True) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``, and the columns n_lines and n_dropped.

    Lines are separated by a line feed and compared exactly.  Lines without a
    word are neither counted nor dropped.  A null text stays null (no lines);
    a text of boilerplate only becomes empty, its row stays.  Null hosts are
    one host, null values of ``part`` one part.  Repeated rows are pages of their own.  An empty table gives an
    empty result; very long texts are taken whole.  Columns of ``docs`` that are
    named n_lines or n_dropped are replaced; without ``counts`` nothing is added
    or replaced but the text.
    """
    boiler_host, boiler_lines = fresh(docs, "host_", "lines_")
    boiler = Workspace(docs.sparkSession, "lines").write(boilerplate(docs, host, max_ratio, min_pages, part).toDF(boiler_host, boiler_lines))
    known = boiler.agg(F.coalesce(F.sum(F.size(boiler_lines)), F.lit(0))).first()[0]
    # Within the bound texts stay where they are.
    joined = join_side(docs, boiler, host, boiler_host, known, "left", BROADCAST_LINES)
    kept = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col(boiler_lines), _key(x)))
    text = F.when(F.col(boiler_lines).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    if not counts:
        return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long")
    n_kept = F.when(F.col("text").isNull(), 0).when(F.col(boiler_lines).isNull(), F.size(_lines(F.col("text")))).otherwise(F.size(kept)).cast("long")
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source as the host: what is left of its text, and how many lines went."""
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op2_line_dedup_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above; boilerplate of a source's texts in one language goes as well."""
    out = drop_boilerplate(table(spark, sf_dir, "documents"), max_ratio=LANGUAGE_RATIO, part="lang")
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op2_line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the host of its url; what stands between two tags is a line (a null html has none)."""
    pages = table(spark, sf_dir, "pages")
    lines = F.regexp_replace("html", "<[^>]*>", "\n")
    out = drop_boilerplate(pages.select("page_id", host_and_path(F.col("url"))[0].alias("host"), lines.alias("text")), host="host")
    return out.select("page_id", "host", "n_lines", "n_dropped", "text")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, source, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM d),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT l.source, list(line) AS bad FROM
        (SELECT source, line, count(*) AS n FROM l GROUP BY source, line) l
        JOIN p ON l.source IS NOT DISTINCT FROM p.source
      WHERE n >= 5 AND n > 0.01::DOUBLE * pages GROUP BY l.source),
k AS (SELECT d.*, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines,
       (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text FROM k
"""

OP2_BY_LANGUAGE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, source, lang, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM d),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
q AS (SELECT source, lang, count(*) AS pages FROM d GROUP BY source, lang),
b AS (SELECT source, list(line) AS bad FROM (
        SELECT l.source, line FROM (SELECT source, line, count(*) AS n FROM l GROUP BY source, line) l
        JOIN p ON l.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > 0.08::DOUBLE * pages
        UNION
        SELECT l.source, line FROM (SELECT source, lang, line, count(*) AS n FROM l GROUP BY source, lang, line) l
        JOIN q ON l.source IS NOT DISTINCT FROM q.source AND l.lang IS NOT DISTINCT FROM q.lang WHERE n >= 5 AND n > 0.08::DOUBLE * pages)
      GROUP BY source),
k AS (SELECT d.*, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines,
       (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text FROM k
"""

OP2_PAGES_SQL = OP2_SQL.replace(
    "SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents",
    "SELECT *, string_split(text, chr(10)) AS lines FROM (SELECT row_number() OVER () AS r, page_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text, "
    "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS source FROM pages)",
).replace("SELECT doc_id, source, coalesce(len(lines)", "SELECT page_id, source AS host, coalesce(len(lines)")
