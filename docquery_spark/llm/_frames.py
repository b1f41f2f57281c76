"""DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import file_system, shared_folder, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Number of salts that a hot key is dealt over; one bit each in a long.
SALTS = 32


def lower_az(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of an Arrow batch of whole texts.
TEXTS_A_BATCH = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Plans made within send whole texts to Python in small batches, which bounds what the JVM keeps for them off its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(TEXTS_A_BATCH, int(before)) if int(before) > 0 else TEXTS_A_BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Written tables that go when the block ends, or before, when their last reader is done.

    For rounds of joins, as sizes of written tables are true. checkpoint() carries its plan's size
    estimate along, which joins multiply, so that after some rounds the estimate itself takes the
    driver's memory to write down.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        """Deletes all tables, and has the driver's JVM collect its garbage.

        Spark drops broadcasts and shuffle files of frames that are gone only then; of each query the heap
        keeps some blocks of 4 MB until then, whatever the size of its tables.
        """
        self._delete(self.folder)
        self.held.clear()
        self.spark.sparkContext._jvm.System.gc()

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.held)}"
        out = written(df, path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this scratch that nothing will read again."""
        for df, path in self.held:
            if any(df is t for t in tables):
                self._delete(path)

    def _delete(self, path: str) -> None:
        at, files = file_system(self.spark, path)
        files.delete(at, True)


def salt_of(*cols: str | Column) -> Column:
    """Salt 0..SALTS-1 of a row, the same whenever it is computed."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salt_bits(salt: Column) -> Column:
    """Aggregate: which salts occur in a group, as bits of a long."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> str:
    """A column name as ``F.col`` takes it, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def explode_salts(bits: Column) -> Column:
    """One row for each salt set in ``bits``."""
    return F.explode(
        F.filter(
            F.sequence(F.lit(0), F.lit(SALTS - 1)),
            lambda s: F.call_function("shiftright", bits, s).bitwiseAND(F.lit(1).cast("long")) == 1,
        )
    )


def by_salted_key(rows: DataFrame, groups: DataFrame, key: list[str], bits: str) -> DataFrame:
    """Inner join of rows (with a ``salt`` column) to one row a key, without a hot partition.

    ``groups`` carries in ``bits`` the salts of its key, so that each of its rows is repeated at
    most SALTS times and never more often than the key has rows.
    """
    spread = groups.withColumn("salt", explode_salts(F.col(bits))).drop(bits)
    return rows.join(spread, [*key, "salt"])


def running_offsets(sums: DataFrame, keys: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of per-bucket ``value`` in bucket order within ``keys``.

    ``sums`` has one row a (keys, bucket); the number of buckets a key has is bounded by callers.
    """
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0))).drop(value)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def sized(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions so that one holds about ``each`` rows, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
