"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship_code

#: ASCII white space, the separators of words in the word-based operators.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Arrow batches of at most so many bytes keep Python workers small, however long the texts are.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  The session's batches are bounded from here on, unless the application bounds them itself."""
    ship_code(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        # one size for the whole session: workers of another size would be kept beside them
        spark.conf.set(key, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (a test) may name none: a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="hopquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote into the shared one."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: its folder goes with it
            pass

    atexit.register(drop)
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, and the files outlive any executor.  The shuffle
    files of the run are of no more use then, so Spark may drop them.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(rows: int, per_part: int, least: int = 1) -> int:
    """How many partitions hold ``rows`` at ``per_part`` each."""
    return max(least, math.ceil(rows / per_part))


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to an iterable of batches."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    ship_code(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

