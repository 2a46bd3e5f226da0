"""What several operators share: shared-folder tables, skew-free joins, tree-wise row picking."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this library installed: functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["ledgerlens"])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; a null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is far faster than translate() and equal to it where every character is one byte
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all runs on this machine (local master), as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Input bytes of one file of a scratch table at most, where there is more than a few files for each core.
FILE_BYTES = 32 << 20
_open: list["Scratch"] = []


class Scratch:
    """Tables in the shared folder that cut lineage: each is computed once and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/ledgerlens-{uuid.uuid4().hex}"
        self.count = 0
        _open.append(self)

    def table(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it again: small tables in a few files for each core, others in tasks of FILE_BYTES or more."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        df.coalesce(min(1 << 20, max(4 * self.spark.sparkContext.defaultParallelism, size // FILE_BYTES))).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.root)
        if self in _open:
            _open.remove(self)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing() -> Iterator[None]:
    """Scratch tables begun within go at its end: for work whose results are written elsewhere by then."""
    before = list(_open)
    try:
        yield
    finally:
        for scratch in [s for s in _open if s not in before]:
            scratch.close()


def release() -> None:
    """Delete the scratch tables of all results so far, which can't be read any more then."""
    for scratch in list(_open):
        scratch.close()


@atexit.register
def _release_at_exit() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        with suppress(Py4JError, OSError):
            release()


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """left inner-joined to right, which has one row for each key, where a key may hold most of left.

    right is first spread over the (key, salt) pairs that left really has, so that a key meets at most
    `salts` rows in one task and left's rows of a key are dealt over `salts` tasks. left is read twice.
    Keys must not be null.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    left = left.withColumn("__salt", salt)
    spread = left.select(*keys, "__salt").distinct().join(right, keys)
    return left.join(spread, [*keys, "__salt"]).drop("__salt")


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, most: int = 10_000) -> DataFrame:
    """left inner-joined to right, which has one row for each key and, in column `n`, no fewer than the key's rows of left.

    Keys that hold more than 1 / `most` of these rows are `most` at the most: they are broadcast, and left's rows of them stay where they are.
    All other rows are joined by a shuffle, in which no key is hot. left is read twice. Keys must not be null.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.where(F.col(n) * most > total)
    held = F.broadcast(hot.select(*keys))  # at most `most` rows
    cold = left.join(held, keys, "left_anti").join(right.where(F.col(n) * most <= total), keys)
    return left.join(F.broadcast(hot), keys).unionByName(cold).drop(n)
