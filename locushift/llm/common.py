"""What several corpus operators share: words, word counts, shared-folder tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has (0 for null): the pieces between white space, less an empty first and last one."""
    whole = F.coalesce(text, F.lit(""))
    ends = F.when(whole == "", 1).otherwise(whole.rlike(r"\A[\x20\x09-\x0D]").cast("int") + whole.rlike(r"[\x20\x09-\x0D]\z").cast("int"))
    return (F.size(F.split(whole, SPACE)) - ends).cast("long")


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filters on columns that are dear to compute. A plain filter would be pushed below their projection, and the
    columns computed for it a second time; it stays above one that also numbers the rows (the test on that number
    always holds)."""
    name = fresh(df, "_number")
    return df.withColumn(name, F.monotonically_increasing_id()).where(condition & (F.col(name) >= 0)).drop(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The needed columns beside ``_row``, a struct of the whole row, so that no other name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *columns)


def small_batches(df: DataFrame, most: int = 1000) -> DataFrame:
    """The same frame, after setting the session's Arrow batches to ``most`` rows at most: texts are long, and a batch
    of the default 10,000 is held several times over by the JVM and the worker."""
    spark = df.sparkSession
    if int(spark.conf.get(BATCH)) > most:
        spark.conf.set(BATCH, str(most))
    return df


def hand_back() -> None:
    """Gives the memory that this worker has freed back to the system: Spark keeps workers for later tasks, and what
    allocators hold on to would count against the executor all the while."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidied(work):
    """A function over batches that hands memory back when its task ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            hand_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="locushift-checkpoints-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage there.

    The shuffle files behind it are then of no more use; Spark is asked to drop them as soon as the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
