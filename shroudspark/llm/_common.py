"""Shared plumbing: tables, Arrow maps and intermediate tables that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session, whose executors are this very process, may fall back to a
    temporary folder; it is then set for the session so that it is made once.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after making sure that batches of texts for Python are measured in bytes.

    A batch of the default 10,000 rows holds tens of megabytes of text, several times
    over in the JVM, in Arrow and in Python.  The session keeps a smaller limit.
    """
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if bytes_now <= 0 or bytes_now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


_written: list[str] = []  # folders of intermediate tables, in the order in which they were made


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, written and read back; all other tables that were written for it are deleted."""
    before = len(_written)
    out = materialise(make(), name)
    _delete(spark, _written[before:-1])
    del _written[before:-1]
    return out


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()


def drop_table(*tables: DataFrame) -> None:
    """Delete the files of intermediate tables that nothing reads any more.

    The driver's garbage is collected too, for only then Spark deletes the shuffle
    files of the queries that wrote them.
    """
    folders = {file.rpartition("/")[0] for df in tables for file in df.inputFiles()}
    _delete(tables[0].sparkSession, folders)


#: A key is hot if it has more than one in so many rows; there are fewer hot keys than this, whatever the table.
HOT = 4096


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for a key; rows of ``hot`` keys aren't shuffled.

    What ``right`` has for them is broadcast, so ``hot`` must be bounded, as ``HOT`` keys are.
    """
    hot = F.broadcast(hot.select(*on))
    few = F.broadcast(right.join(hot, on, "left_semi"))
    return left.join(hot, on, "left_semi").join(few, on, how).unionByName(left.join(hot, on, "left_anti").join(right, on, how))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def with_text(docs: DataFrame, text_col: str, text: Column) -> DataFrame:
    """Replace the text, and ``n_chars`` with it where the table has that column."""
    out = docs.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out


def map_arrow(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield one(batch)

    return bounded_batches(df).mapInArrow(run, schema)
