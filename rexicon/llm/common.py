"""What the operators share: shared storage, readers and column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that sort after every other; stands for a null id inside the operators.
NULL_ID = (1 << 63) - 1
#: The setting by which Spark deletes a query's shuffle files when the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes of an Arrow batch.  A task holds one as vectors, as the stream that it sends and in its
#: worker, each up to twice as large as its rows, all beside the heap: Spark's own 64 MB are too many.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is set once
    per session; on a cluster that would scatter files, so it is an error.
    """
    for key in ("spark.checkpoint.dir", "spark.rexicon.shared.dir"):
        found = spark.conf.get(key, None)
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rexicon-")
    spark.conf.set("spark.rexicon.shared.dir", own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rexicon/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    Lost executors cost no more than a re-read; a task that is run again replaces
    its own files through Spark's commit protocol.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")  # what the write has shuffled is not read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rx_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have ``BATCH_BYTES``, if the session was not begun with a size of its own."""
    if spark.sparkContext.getConf().get(BATCH) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def release(*saved: DataFrame) -> None:
    """Delete saved tables that nothing will read again: what was made of them is saved itself."""
    for df in saved:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._rx_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; one of the same name (in any case) in the input is replaced."""
    names = {c.lower() for c in columns}
    kept = [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the rank of each row, from 0, in a total order: a range sort and one count per range."""
    rows = df.orderBy(*order).withColumn("_rx_no", F.monotonically_increasing_id())
    rows = save(rows, "ranked")
    spot = F.shiftrightunsigned("_rx_no", 33)
    counts = rows.groupBy(spot.alias("_rx_range")).agg(F.count(F.lit(1)).alias("_rx_n"))  # one row per range
    upto = Window.orderBy("_rx_range").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("_rx_range", (F.sum("_rx_n").over(upto) - F.col("_rx_n")).alias("_rx_before"))
    rows = rows.join(before, spot == F.col("_rx_range"))
    return rows.withColumn(name, F.col("_rx_before") + F.col("_rx_no").bitwiseAND(F.lit((1 << 33) - 1))).drop("_rx_no", "_rx_range", "_rx_before")


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those of least key hash, whatever the size of the table.

    A filter on the same hash leaves about ``4 * n`` rows first, so what tasks send to
    be ordered does not grow with their number; should it leave fewer than ``n``, as
    it does where many rows share few keys, all are ordered.
    """
    order, total = F.xxhash64(key), df.count()
    least = df
    if total > 4 * n:
        least = df.where(order < F.lit(int(4 * n / total * (1 << 64)) - (1 << 63)))
        if least.limit(n).count() < n:
            least = df
    return least.orderBy(order, key).limit(n)


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of few rows, so that a worker never holds what it makes of a whole batch of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def cleanup(spark: SparkSession) -> None:
    """Delete what the operators have written to the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rexicon")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
