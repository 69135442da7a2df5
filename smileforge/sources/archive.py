"""Archive files: index envelope, file pruning, book, trade, candle and funding scans.

Files lie in a folder that Spark reads; an index (JSON envelope) may list
them.  One task reads one gzip file, column pruning drops unused levels, and
unreadable files are skipped where asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.orderbook import standardize_orderbook_columns, trim_orderbook
from .planner import BOOK_MODULE, create_date_chunks

MODULES = {1: schemas.TRADES_ARCHIVE, 2: schemas.CANDLES, 3: schemas.FUNDING}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(filename, url, sizeMB) of every file that a good reply lists."""
    raw = spark.read.schema(schemas.ARCHIVE_INDEX).option("multiLine", True).json(path).where(F.col("code") == "0")
    files = raw.select(F.explode(F.try_element_at(F.try_element_at("data", F.lit(1))["details"], F.lit(1))["groupDetails"]).alias("f"))
    return files.select("f.*")


def index_summary(index: DataFrame) -> DataFrame:
    """(files, megabytes) of an index; a file of unknown size counts as 0 MB."""
    return index.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("sizeMB"), F.lit(0.0)).alias("megabytes"))


def index_lister(spark: SparkSession, template: str) -> Callable[[int, int], list[tuple[str, str]]]:
    """A ``lister`` for ``fetch_market_data`` that reads a saved index for each chunk.

    ``template`` is the path of an index with ``{begin}`` and ``{end}`` in ms.
    It gives (file name, url) of every file listed, as many as the reply names;
    a chunk without an index, or with a bad reply, gives none.
    """

    def listed(begin: int, end: int) -> list[tuple[str, str]]:
        path = spark._jvm.org.apache.hadoop.fs.Path(template.format(begin=begin, end=end))
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        return [(r["filename"], r["url"]) for r in read_index(spark, path.toString()).select("filename", "url").collect()]

    return listed


def family_filter(families: list[str] | str) -> Callable[[str], bool]:
    """File-name test for one or more instrument families."""
    names = [families] if isinstance(families, str) else list(families)
    return lambda filename: any(filename.startswith(f"{f}-") for f in names)


def _csv(spark: SparkSession, schema, paths, skip_bad: bool) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("ignoreCorruptFiles", skip_bad).option("ignoreMissingFiles", skip_bad).csv(paths)


def read_book(spark: SparkSession, paths: str | list[str], depth: int = 5, futures: bool = False, file_depth: int = 50, skip_bad: bool = False) -> DataFrame:
    """Standardised and trimmed order book from CSV or gzip CSV files."""
    schema = schemas.raw_futures_book(file_depth) if futures else schemas.book(file_depth)
    return trim_orderbook(standardize_orderbook_columns(_csv(spark, schema, paths, skip_bad)), depth)


def read_module(spark: SparkSession, module: int, paths: str | list[str], skip_bad: bool = False) -> DataFrame:
    """Trades (1), candles (2) or funding rates (3)."""
    return _csv(spark, MODULES[module], paths, skip_bad)


def fetch_market_data(
    spark: SparkSession,
    root: str,
    module: int,
    inst_type: str,
    inst_family_list: list[str] | str,
    start_date: date | datetime,
    end_date: date | datetime,
    date_aggr_type: str = "daily",
    depth: int = 5,
    file_depth: int = 50,
    include_criterion: Callable[[str], bool] | None = None,
    process_fn: Callable[[DataFrame], DataFrame] | None = None,
    lister: Callable[[int, int], list[str | tuple[str, str]]] | None = None,
    delay: float = 0.0,
) -> DataFrame:
    """One scan over all files of the planned chunks.

    ``root`` holds folders ``<yyyy-mm-dd>/`` of files; ``lister(begin_ms,
    end_ms)`` may name the files of a chunk instead, by path or as (file name,
    path), called with ``delay`` seconds between chunks; ``index_lister`` makes
    one from saved index replies.  Files are pruned by family (futures) and by
    ``include_criterion`` before the scan; nothing found gives an empty frame.
    Spark reads the files in parallel, a task each.  ``process_fn`` is applied
    to the lazy frame of all files.
    """
    futures = inst_type.upper() == "FUTURES"
    wanted = [include_criterion] if include_criterion else []
    if futures and not include_criterion:
        wanted.append(family_filter(inst_family_list))
    paths = []
    for n, (begin, end) in enumerate(create_date_chunks(start_date, end_date, module, date_aggr_type)):
        if n and delay:
            time.sleep(delay)
        for found in lister(begin, end) if lister else list_files(spark, root, begin, end, module):
            name, path = (found.rsplit("/", 1)[-1], found) if isinstance(found, str) else found
            if all(w(name) for w in wanted):
                paths.append(path)
    if module == BOOK_MODULE:
        schema = schemas.raw_futures_book(file_depth) if futures else schemas.book(file_depth)
        if paths:
            out = read_book(spark, paths, depth, futures, file_depth, skip_bad=True)
        else:
            out = trim_orderbook(standardize_orderbook_columns(spark.createDataFrame([], schema), ""), depth)
    else:
        out = read_module(spark, module, paths, skip_bad=True) if paths else spark.createDataFrame([], MODULES[module])
    return process_fn(out) if process_fn else out


def list_files(spark: SparkSession, root: str, begin: int, end: int, module: int) -> list[str]:
    """Files under ``root/<day>/`` for the days of a chunk, by any file system that Spark knows."""
    from datetime import timedelta

    from .planner import module_zone

    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    zone = module_zone(module)
    day, last = (datetime.fromtimestamp(x / 1000, zone).date() for x in (begin, end))
    out = []
    while day <= last:
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{day}")
        fs = folder.getFileSystem(conf)
        if fs.exists(folder):
            out += sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.isFile())
        day += timedelta(days=1)
    return out


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by a column, one writer per value and task."""
    df.repartition(by).write.mode(mode).partitionBy(by).parquet(path)
