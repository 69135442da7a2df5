"""Shared helpers: table reads, tables written to the shared folder, unique column names."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table read from files, dealt over all cores where it has fewer partitions than these.

    For kernels that cost far more than a shuffle of their input; a large table
    has more partitions than cores and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it; a temporary one only where it is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="smileforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_OPEN: list[list[Workspace]] = []


@contextmanager
def disposable() -> Iterator[None]:
    """Tables that are written inside by workspaces made inside are deleted at the end, unless they are kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        for space in _OPEN.pop():
            space.drop_all()


class Workspace:
    """Tables of one run, written as Parquet under the shared folder so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if _OPEN:
            _OPEN[-1].append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        for df in frames:
            self._delete(df._workspace_path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: list = [None, None]


def hold(owner: str, release: Callable[[], None]) -> None:
    """Called by an operator that keeps tables in its Python worker: those of another operator are released.

    Workers are reused from query to query, so without this their tables would add up.
    """
    if _HELD[0] != owner:
        if _HELD[1]:
            _HELD[1]()
            gc.collect()
            trim()
        _HELD[:] = [owner, release]


#: Rows of a side up to which it is broadcast by ``join_side``, and copies of its rows beyond.
BROADCAST_ROWS, SALTS = 100_000, 16


def join_side(rows: DataFrame, side: DataFrame, left: str, right: str, weight: int, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with ``side`` on ``left`` <=> ``right``, where ``left`` may have hot values.

    ``weight`` is the counted size of ``side``.  Up to ``bound`` the side is
    broadcast and the rows stay where they are; beyond it a row goes to one of
    SALTS copies of its partner, so that a hot value is dealt over as many tasks.
    """
    same = F.col(f"`{left}`").eqNullSafe(F.col(f"`{right}`"))
    if weight <= bound:
        return rows.join(F.broadcast(side), same, how)
    mine, theirs = fresh(rows.join(side.limit(0), F.lit(False)), "salt_", "of_salt_")
    salted = rows.withColumn(mine, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = side.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col(mine) == F.col(theirs)), how).drop(mine, theirs)


def trim() -> None:
    """Give freed memory of this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with ``trim`` at the end of a task: an idle worker then leaves the executor's memory to the JVM."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def sized(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` already has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
