"""Trade, book and term-structure analysis."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.black76 import NEWTON_ROUNDS
from ..functions.scalars import linspace


def volume_by(df: DataFrame, key: str, amount: str, price: str, top: int | None = 10) -> DataFrame:
    """Traded amount and value of each key, the busiest first; both sums come from one aggregation."""
    out = df.groupBy(key).agg(F.sum(amount).alias("volume"), F.sum(F.col(amount) * F.col(price)).alias("value"))
    return out.orderBy(F.desc("volume"), key).limit(top) if top is not None else out


def stats_by(df: DataFrame, key: str, columns: list[str], digits: int = 2, sort_by: str | None = None) -> DataFrame:
    """Rows, mean and sample deviation of columns by key; half-even rounding.

    ``sort_by`` names a result column, such as ``price_mean``: highest first.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.bround(F.avg(c), digits).alias(f"{c}_mean"), F.bround(F.stddev_samp(c), digits).alias(f"{c}_std")]
    out = df.groupBy(key).agg(*aggs)
    return out.orderBy(F.desc(sort_by), key) if sort_by else out


def full_outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two aggregates side by side on a key."""
    return a.join(b, key, "full")


#: Buckets of one histogram, and rows of a bucket up to which its values are sorted.
BUCKETS, SMALL_BUCKET = 4096, 50_000
LARGEST = sys.float_info.max


def ranked(df: DataFrame, column: str, ranks: list[int], n: int, low: float, high: float) -> dict[int, float]:
    """The values of ``column`` (numbers without null and NaN, ``n`` of them) at ranks from 0 in ascending order.

    A histogram between the ends finds the bucket of each rank, and only the
    rows of these buckets are read again, until a bucket is small or of one
    value.  No task sees more than a bucket, and only bucket counts and the
    wanted values reach the driver.
    """
    out: dict[int, float] = {}
    todo = [(low, high, 0, n, sorted(set(ranks)))]
    x = F.col(column)
    while todo:
        lo, hi, before, size, wanted = todo.pop()
        inside = df.where(x.between(lo, hi))
        if lo == hi:
            out |= dict.fromkeys(wanted, lo)
        elif size <= SMALL_BUCKET:
            counts = inside.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n")).withColumn("to", F.sum("n").over(Window.orderBy("x")) + before)
            ends = {r["x"]: r["to"] for r in counts.where(F.exists(F.array(*[F.lit(k) for k in wanted]), lambda k: (k < F.col("to")) & (k >= F.col("to") - F.col("n")))).collect()}
            for k in wanted:
                out[k] = min(v for v, to in ends.items() if k < to)
        else:
            # Quarters, as the difference of the largest values is no number; the ends fall in the first and the last bucket.
            place = F.least(F.floor((x / 4 - lo / 4) / (hi / 4 - lo / 4) * BUCKETS), F.lit(BUCKETS - 1))
            hist = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
            at = before
            for r in sorted(hist, key=lambda r: r["b"]):
                here = [k for k in wanted if at <= k < at + r["n"]]
                if here:
                    todo.append((r["lo"], r["hi"], at, r["n"], here))
                at += r["n"]
    return out


def exact_quantiles(df: DataFrame, at: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation; null and NaN are left out, nothing left gives None.

    Infinite values are ranked as the largest finite ones and come out infinite.
    """
    number = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.least(F.greatest(F.col(c).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST)))
    ends = df.agg(*[F.struct(F.count(number(c)).alias("n"), F.min(number(c)).alias("lo"), F.max(number(c)).alias("hi")).alias(c) for c in at]).first()
    out: dict[str, list[float | None]] = {}
    for c, shares in at.items():
        n, lo, hi = ends[c]["n"], ends[c]["lo"], ends[c]["hi"]
        if not n:
            out[c] = [None] * len(shares)
            continue
        places = [p * (n - 1) for p in shares]
        values = ranked(df.select(number(c).alias(c)), c, [k for p in places for k in (int(p), min(int(p) + 1, n - 1))], n, lo, hi)
        values = {k: math.copysign(math.inf, v) if abs(v) == LARGEST else v for k, v in values.items()}
        out[c] = [values[int(p)] if p == int(p) else (int(p) + 1 - p) * values[int(p)] + (p - int(p)) * values[int(p) + 1] for p in places]
    return out


def _lit(x: float | None) -> Column:
    return F.lit(x).cast("double")


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, exact quartiles and max; NaN does not count."""
    x = F.nanvl(F.col(column), F.lit(None).cast("double"))
    q = exact_quantiles(df, {column: [0.25, 0.5, 0.75]})[column]
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).select("count", "mean", "std", "min", *[_lit(v).alias(c) for c, v in zip(("p25", "p50", "p75"), q)], "max")


def quantiles(column: str, at: list[float]) -> Column:
    """Quantiles with linear interpolation as an aggregate, NaN left out; for small groups, as one task holds a group's distinct values."""
    return F.percentile(F.nanvl(F.col(column), F.lit(None).cast("double")), at)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, share) of every column from one pass; NaN counts as null."""
    def missing(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(missing(f)).alias(f"__{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"__{i}").alias("nulls")) for i, f in enumerate(fields)])
    return counts.select("__n", F.explode(rows).alias("r")).select("r.*", F.try_divide(F.col("r.nulls"), F.col("__n")).alias("share"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(c) for c in columns])


def band_shares(df: DataFrame, column: str, bands: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows and percentage of each half-open band [low, high); one pass."""
    x = F.col(column)
    inside = {name: (F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x < hi) for name, (lo, hi) in bands.items()}
    total = F.count(x)
    aggs = []
    for name, cond in inside.items():
        aggs += [F.count_if(cond).alias(f"n_{name}"), F.try_divide(F.count_if(cond) * 100, total).alias(f"share_{name}")]
    return df.agg(total.alias("n"), *aggs)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def largest_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n): rows of the largest group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))


def dropped_duplicates(df: DataFrame, key: str) -> DataFrame:
    """(rows, kept, dropped) of ``keep_first`` on a key; a null key is a value like any other."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def size_summary(df: DataFrame) -> DataFrame:
    """(rows, columns, bytes): bytes of the values, by the width of their types and the length of strings and binaries."""
    widths = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        width = F.octet_length(c) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(widths.get(type(f.dataType), 8))
        total = total + F.when(c.isNull(), F.lit(0)).otherwise(width).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.coalesce(F.sum(total), F.lit(0)).alias("bytes"))


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; an aggregation that sends one row a key and task through the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("__k")).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dense_cells(df: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """(row, column, value) for all rows and all columns that exist, 0 where nothing fell."""
    sums = df.groupBy(row, column).agg(F.sum(value).alias("v"))
    grid = df.select(row).distinct().crossJoin(df.select(column).distinct())  # the dense form itself is the result
    return grid.join(sums, [row, column], "left").select(row, column, F.coalesce("v", F.lit(0.0)).alias("value"))


def rolling_mean(cells: DataFrame, row: str, column: str, width: int = 3) -> DataFrame:
    """Mean over the last ``width`` existing columns of a row, fewer at its start."""
    w = Window.partitionBy(row).orderBy(column).rowsBetween(1 - width, 0)
    return cells.withColumn("rolling", F.avg("value").over(w))


def create_volume_pivot(df: DataFrame, width: int = 3) -> DataFrame:
    """Amount by strike and hour, with the rolling mean; long form.  ``df`` has strike, hour and amount."""
    return rolling_mean(dense_cells(df, "strike", "hour", F.col("amount")), "strike", "hour", width)


def create_value_pivot(df: DataFrame, width: int = 3) -> DataFrame:
    """Amount times price by strike and hour, with the rolling mean; long form."""
    return rolling_mean(dense_cells(df, "strike", "hour", F.col("amount") * F.col("price")), "strike", "hour", width)


#: Columns that a wide table may have, and strikes of a ladder.
MAX_COLUMNS, MAX_STRIKES = 10_000, 10_000


def wide(cells: DataFrame, row: str, column: str, value: str = "rolling") -> DataFrame:
    """One column per value of ``column`` (its labels are sorted first, so the schema is stable); more than MAX_COLUMNS are an error."""
    labels = [r[0] for r in cells.select(column).distinct().orderBy(column).limit(MAX_COLUMNS + 1).collect()]
    if len(labels) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns: use the long form")
    return cells.groupBy(row).pivot(column, labels).agg(F.sum(value)).na.fill(0)


def strike_rank(points: DataFrame, price: str, strikes: DataFrame, strike: str = "strike") -> DataFrame:
    """Number of strikes below a price, and its row in a heat map that has the highest strike on top.

    The distinct strikes, a few hundred, travel as one sorted array; more than
    MAX_STRIKES are an error.
    """
    distinct = strikes.select(strike).distinct()
    if distinct.limit(MAX_STRIKES + 1).count() > MAX_STRIKES:
        raise ValueError(f"more than {MAX_STRIKES} strikes")
    ladder = distinct.agg(F.array_sort(F.collect_list(strike)).alias("__ladder"))
    below = F.size(F.filter("__ladder", lambda k: k < F.col(price)))
    return points.crossJoin(F.broadcast(ladder)).withColumns({"n_below": below, "y": F.size("__ladder") - 1 - below}).drop("__ladder")


def loglinear_fit(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """ln(y) = intercept + slope * x per group, with R² in the space of y.

    Fit, join back, sums: two aggregations on the same key.
    """
    ok = df.where((F.col(y) > 0) & F.col(x).isNotNull())
    fit = ok.groupBy(group).agg(F.regr_slope(F.ln(y), F.col(x)).alias("slope"), F.regr_intercept(F.ln(y), F.col(x)).alias("intercept"), F.avg(y).alias("mean_y"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.count(F.lit(1)).alias("n")).where(F.col("slope").isNotNull())
    joined = ok.join(fit, group)
    error = F.col(y) - F.exp(F.col("intercept") + F.col("slope") * F.col(x))
    sums = joined.groupBy(group).agg(F.sum(error * error).alias("ss_res"), F.sum((F.col(y) - F.col("mean_y")) * (F.col(y) - F.col("mean_y"))).alias("ss_tot"))
    return fit.join(sums, group).withColumn("r2", 1 - F.try_divide("ss_res", "ss_tot")).drop("ss_res", "ss_tot", "mean_y")


def fitted_curve(fit: DataFrame, group: str, points: int = 100) -> DataFrame:
    """The fitted curve at evenly spaced tenors between the first and the last."""
    xs = fit.select(group, "slope", "intercept", F.posexplode(linspace(F.col("x_min"), F.col("x_max"), points)).alias("i", "x"))
    return xs.select(group, "i", "x", F.exp(F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))


def axis_bounds(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Plot bounds: 1 and 99 % quantiles of x and z widened by 5 % of their range (z not below 0), y by a tenth."""
    q = exact_quantiles(df, {x: [0.01, 0.99], z: [0.01, 0.99]})
    y_ = F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double"))
    (x0, x1), (z0, z1) = ([_lit(v) for v in q[c]] for c in (x, z))
    return df.agg(F.min(y_).alias("y0"), F.max(y_).alias("y1")).select(
        (x0 - (x1 - x0) * 0.05).alias("x_low"), (x1 + (x1 - x0) * 0.05).alias("x_high"),
        F.greatest(F.lit(0.1), F.col("y0") * 0.9).alias("y_low"), (F.col("y1") * 1.1).alias("y_high"),
        F.greatest(F.lit(0.0), z0 - (z1 - z0) * 0.05).alias("z_low"), (z1 + (z1 - z0) * 0.05).alias("z_high"),
    )


def viewer_bounds(df: DataFrame, x: str, tenor_years: str, iv: str) -> DataFrame:
    """Bounds of the trade viewer: 5 and 95 % quantiles of x and IV widened by 10 % (IV not below 0); log10 of tenors from a day."""
    q = exact_quantiles(df, {c: [0.05, 0.95] for c in (x, iv, tenor_years)})
    (x0, x1), (z0, z1), (t0, t1) = ([_lit(v) for v in q[c]] for c in (x, iv, tenor_years))
    return df.sparkSession.range(1).select(
        (x0 - (x1 - x0) * 0.1).alias("x_low"), (x1 + (x1 - x0) * 0.1).alias("x_high"),
        F.greatest(F.lit(0.0), z0 - (z1 - z0) * 0.1).alias("z_low"), (z1 + (z1 - z0) * 0.1).alias("z_high"),
        F.log10(F.greatest(F.lit(1 / 365), t0)).alias("log_t_low"), F.log10(F.greatest(F.lit(1 / 365), t1)).alias("log_t_high"),
    )


def padded_range(df: DataFrame, column: str, low: float = 0.95, high: float = 1.05) -> DataFrame:
    return df.agg((F.min(column) * low).alias("low"), (F.max(column) * high).alias("high"))


def enough(df: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    few = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(group)
    return df.join(few, group, "left_semi")


def middle_time(df: DataFrame, time: str) -> DataFrame:
    """Middle one of the sorted distinct times (the later of two), by histograms instead of one big array.  Times are integers."""
    times = df.select(F.col(time).cast("bigint").alias(time)).where(F.col(time).isNotNull()).distinct()
    n, low, high = times.agg(F.count(F.lit(1)), F.min(time), F.max(time)).first()
    if not n:
        return times.select(F.col(time).alias("middle"))
    return df.sparkSession.range(1).select(F.lit(ranked(times, time, [n // 2], n, low, high)[n // 2]).cast("bigint").alias("middle"))


def every_nth(df: DataFrame, order: str, n: int = 10, first: int = 100) -> DataFrame:
    """Every ``n``-th of the first rows by ``order`` (a report of a few rows)."""
    head = df.orderBy(order).limit(first)
    numbered = head.withColumn("__i", F.row_number().over(Window.orderBy(order)))
    return numbered.where((F.col("__i") - 1) % n == 0).drop("__i")


def solver_report(solved: DataFrame, rounds: int = NEWTON_ROUNDS) -> DataFrame:
    """Rows, share, iterations and errors by outcome, and what the rows met on the way.

    ``solved`` has the fields of ``implied_volatility_solution``.  A row counts
    in ``n_low_vega`` if vega was negligible in more than half of the rounds, in
    ``n_hit_lower`` and ``n_hit_upper`` if a step went beyond that bound, and in
    ``n_all_rounds`` if it took every round.
    """
    total = solved.agg(F.count(F.lit(1)).alias("__n"))
    error = F.nanvl("price_error", F.lit(None).cast("double"))
    by = solved.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.avg("iterations").alias("mean_iterations"), F.percentile("iterations", 0.5).alias("median_iterations"), F.max("iterations").alias("max_iterations"),
        F.count_if(F.col("low_vega_rounds") > rounds / 2).alias("n_low_vega"), F.count_if("hit_lower").alias("n_hit_lower"), F.count_if("hit_upper").alias("n_hit_upper"), F.count_if(F.col("iterations") >= rounds).alias("n_all_rounds"),
        F.avg(error).alias("mean_error"), quantiles("price_error", [0.5, 0.9]).alias("error_p50_p90"),
    )
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * 100 / F.col("__n")).drop("__n")


def failed_samples(solved: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows, by ``order``, that the solver failed on."""
    return solved.where("status = 'failed'").orderBy(*order).limit(n)
