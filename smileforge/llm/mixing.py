"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a word budget.  A document's place within its source is a
60-bit hash of its id; a source takes all its documents ``floor(budget/total)``
times and, once more, those whose hash lies below a threshold chosen so that
their words come nearest to the rest of the budget.  The thresholds come from
histograms: words per (source, hash bucket), then only the bucket in which the
budget ends is split further.  No documents are sorted, and a larger budget
always takes a superset of what a smaller one takes.  Totals, targets and
thresholds are tables of a row a source; none comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh, join_side, sized, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Bits of the hash, and bits by which one histogram splits a bucket.
HASH_BITS, STEP_BITS = 60, 12


def place(doc_id: Column) -> Column:
    """60-bit hash of a document id: the first 15 hexadecimal digits of its MD5 (null: of the empty string)."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> list[tuple[str | None, int, float]]:
    """(source, total, target) of each source of a short list; ``target_table`` is the form for a table.

    Sources by code point, null last, take the weights in turn.  Targets share
    ``share`` times all words by weight; none exceeds ``max_copies`` times its
    total, and what exceeds it is shared again by weight among the others.
    """
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(ordered)]
    budget, wsum, level, capped = share * sum(n for _, n, _ in rows), sum(w for *_, w in rows), 0.0, set()
    for i in sorted(range(len(rows)), key=lambda i: (max_copies * rows[i][1] / rows[i][2], i)):
        _, n, w = rows[i]
        level = budget / wsum
        if max_copies * n / w > level:
            break
        capped.add(i)
        budget -= max_copies * n
        wsum -= w
    return [(s, n, float(max_copies * n) if i in capped else level * w) for i, (s, n, w) in enumerate(rows)]


def _before(space: Workspace, rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with the sum of a column over the rows before, in ``order`` (a total one), for each new name.

    Rows are dealt by ranges of the order; a part adds up its own rows and the
    totals of the parts before it, so no task sees all rows.
    """
    dealt = space.write(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    parts = dealt.groupBy("part_").agg(*[F.sum(c).alias(f"{new}_part_") for new, c in sums.items()])
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = parts.select(F.col("part_").alias("of_part_"), *[F.coalesce(F.sum(f"{new}_part_").over(earlier), F.lit(0)).alias(f"{new}_part_") for new in sums])
    inside = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(offsets), F.col("part_") == F.col("of_part_")).select(*rows.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{new}_part_")).alias(new) for new, c in sums.items()])


def target_table(space: Workspace, totals: DataFrame, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """(source, n, target) of ``totals`` (source, n), by the rule of ``targets``, as a table."""
    ranked = _before(space, totals.withColumns({"last_": F.col("source").isNull(), "one_": F.lit(1)}), ["last_", "source"], {"i_": "one_"})
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("i_") % len(weights) + 1).cast("int"))
    cap = (F.lit(max_copies) * F.col("n")).alias("cap_")
    weighed = space.write(ranked.select("source", "n", "i_", w.alias("w_"), cap)).withColumn("r_", F.col("cap_").cast("double") / F.col("w_"))
    n, w_sum = weighed.agg(F.sum("n"), F.sum("w_")).first()
    if n is None:
        return weighed.select("source", "n", F.lit(0.0).alias("target"))
    level = (F.lit(float(share * n)) - F.col("cap_before")) / (F.lit(w_sum) - F.col("w_before"))
    steps = _before(space, weighed, ["r_", "i_"], {"cap_before": "cap_", "w_before": "w_"}).withColumn("level_", level)
    found = steps.where("r_ > level_").agg(F.min_by("level_", F.struct("r_", "i_"))).first()[0]
    cap = F.col("cap_").cast("double")
    return weighed.select("source", "n", (cap if found is None else F.when(F.col("r_") > found, F.lit(found) * F.col("w_")).otherwise(cap)).alias("target"))


def _thresholds(space: Workspace, sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(s_, source_size, target, whole_, below_) of each source: hashes below ``below_`` get one copy more.

    A level reads only the rows of the boundary buckets of the level before.
    """
    whole = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("long")
    goals = space.write(goals.select(F.col("source").alias("s_"), "n", "target", whole.alias("whole_")).withColumn("rest_", F.col("target") - F.col("whole_") * F.col("n")))
    state, rows, done = goals.where("n > 0 AND rest_ > 0").select("s_", "rest_"), sizes.select("source", "size", "place"), None
    for level in range(HASH_BITS // STEP_BITS):
        if not state.head(1):
            break
        shift = HASH_BITS - STEP_BITS * (level + 1)
        hist = rows.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("place").alias("p0"), F.max("place").alias("p1"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("cum", F.sum("words").over(run)).join(state, F.col("source").eqNullSafe(F.col("s_"))).where("cum >= rest_")
        ends = hist.groupBy("s_").agg(F.min_by(F.struct("bucket", (F.col("cum") - F.col("words")).alias("before"), "cum", "p0", "p1", "rest_"), "bucket").alias("b")).select("s_", "b.*")
        ends = space.write(ends)
        # A bucket of one hash value is taken if that comes nearer.
        nearer = F.when(F.col("cum") - F.col("rest_") < F.col("rest_") - F.col("before"), F.col("p0") + 1).otherwise(F.col("p0"))
        settled = ends.where("p0 = p1").select("s_", nearer.alias("below_"))
        done = settled if done is None else done.unionByName(settled)
        state = ends.where("p0 <> p1").select("s_", (F.col("rest_") - F.col("before")).alias("rest_"), "bucket")
        inside = state.select(F.col("s_").alias("of_"), F.col("bucket").alias("of_bucket"))
        if level + 1 < HASH_BITS // STEP_BITS:  # source and bucket are the keys: a hot source is dealt by its buckets
            rows = space.write(rows.join(inside, F.col("source").eqNullSafe(F.col("of_")) & (F.shiftright("place", shift) == F.col("of_bucket")), "left_semi"))
        state = state.drop("bucket")
    plan = goals if done is None else goals.join(done.withColumnRenamed("s_", "of_"), F.col("s_").eqNullSafe(F.col("of_")), "left")
    below = F.lit(0) if done is None else F.coalesce("below_", F.lit(0))
    return plan.select("s_", F.col("n").alias("source_size"), "target", "whole_", below.cast("long").alias("below_"))


def _plan(docs: DataFrame, weights, share, max_copies) -> tuple[DataFrame, DataFrame, int]:
    """Sizes of all rows, one row per source (s_, source_size, target, whole_, below_), and how many sources there are."""
    space = Workspace(docs.sparkSession, "mix")
    sizes = space.write(docs.select("doc_id", F.col("source").cast("string").alias("source"), sized(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place")))
    totals = space.write(sizes.groupBy("source").agg(F.sum("size").alias("n")))
    goals = space.write(target_table(space, totals, weights, share, max_copies))
    return sizes, space.write(_thresholds(space, sizes, goals)), totals.count()


def _copies(hash60: Column) -> Column:
    return F.col("whole_") + (hash60 < F.col("below_")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Null texts have no words; null sources are one source, last in order; null
    ids hash as the empty string.  Rows that share an id are taken together;
    very long texts are counted whole.  A source without words has the target 0
    and is not taken; an empty table gives an empty result.  The sources are
    broadcast up to a checked number, and joined by source and salt beyond it.
    """
    sizes, plan, n = _plan(docs, weights, share, max_copies)
    joined = join_side(sizes, plan, "source", "s_", n)
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("place")).alias("copies"))


def apply_mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``; cases as in ``mix``."""
    _, plan, n = _plan(docs, weights, share, max_copies)
    names = fresh(docs, "s_", "source_size", "target", "whole_", "below_", "n_", "copy_", "of_source_")
    plan = plan.toDF(*names[:5])
    copies = F.col(names[3]) + (place(F.col("doc_id")) < F.col(names[4])).cast("long")
    joined = join_side(docs.withColumn(names[7], F.col("source").cast("string")), plan, names[7], names[0], n).withColumn(names[5], copies.cast("int"))
    return joined.where(F.col(names[5]) > 0).withColumn(names[6], F.explode(F.array_repeat(F.lit(0), F.col(names[5])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, i, [5, 2, 1][1 + i % 3] AS w
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM t)),
r AS (SELECT *, 2::DOUBLE * n / w AS r,
        coalesce(sum(2 * n) OVER o, 0) AS before_n, coalesce(sum(w) OVER o, 0) AS before_w
      FROM w WINDOW o AS (ORDER BY 2::DOUBLE * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(n) FROM t)::DOUBLE - before_n::DOUBLE) / ((SELECT sum(w) FROM w) - before_w)::DOUBLE AS level FROM r),
f AS (SELECT level FROM l WHERE r > level ORDER BY r, i LIMIT 1),
g AS (SELECT source, n, CASE WHEN l.r > f.level OR (l.r = f.level AND false) THEN f.level * w ELSE (2 * n)::DOUBLE END AS target
      FROM l LEFT JOIN f ON true),
c AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM g),
h AS (SELECT d.source, d.place, sum(d.size) AS words FROM d GROUP BY ALL),
k AS (SELECT h.*, sum(words) OVER (PARTITION BY h.source ORDER BY place) AS cum, target - whole * n AS rest, whole, n, target
      FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source),
x AS (SELECT source, place, n, target, whole + CASE WHEN n > 0 AND rest > 0 AND
        (cum < rest OR (cum - words < rest AND cum - rest < rest - (cum - words))) THEN 1 ELSE 0 END AS copies FROM k)
SELECT d.doc_id, d.size, x.n AS source_size, x.target, (d.size * x.copies)::BIGINT AS taken, d.source
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.place = x.place
"""
