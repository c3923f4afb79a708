"""Tables written to the shared folder, to cut lineage in loops and to compute once what is read often."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The keys with most rows, so many at most and of more than HOT_ROWS each, are hot; of a table of SMALL rows at most none is.
HOT_KEYS, HOT_ROWS, SMALL = 1024, 1000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master gets one of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _path(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_table(spark: SparkSession, name: str) -> str:
    """A place for a table in a folder of this application, which is removed when the application ends."""
    folder = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_graphloom_folder", None) != folder:
        path, files = _path(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        spark.sparkContext._graphloom_folder = folder  # type: ignore[attr-defined]
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again. It survives the loss of any executor."""
    place = new_table(df.sparkSession, name)
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out._graphloom_place = place  # type: ignore[attr-defined]
    return out


class Growing:
    """A table in the shared folder that loops append to; reading it is one scan, however often it grew."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.place, self.schema = spark, new_table(spark, name), None

    def append(self, df: DataFrame) -> DataFrame:
        """Writes the rows, and returns them read back."""
        place = f"{self.place}/{uuid.uuid4().hex}"
        df.write.parquet(place)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(place)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.place)


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        if place := getattr(df, "_graphloom_place", None):
            path, files = _path(df.sparkSession, place)
            files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of steps that are done. Spark drops them when the driver's JVM collects what referred to
    them, which a long step with little work in the driver may put off until files of several steps fill the disks."""
    spark.sparkContext._jvm.System.gc()


def with_totals(rows: DataFrame, key: str, totals: Iterable[tuple[str, Column]], size: int | None = None) -> DataFrame:
    """``rows`` with aggregates over all rows of their ``key``, like a window, but spread out.

    ``rows`` is read several times, so it should be a written table; keys aren't null. Hot keys (HOT_KEYS at most)
    are aggregated with map-side combination and looked up in a broadcast table of as many rows; only the rest,
    where no key has more than a HOT_KEYS-th of all rows, is dealt by key. Tables of SMALL rows at most are dealt as they are.
    ``size``: how many rows there are, where that is known; else they are counted.
    """
    totals, each = list(totals), Window.partitionBy(key)
    if (rows.count() if size is None else size) <= SMALL:
        return rows.select("*", *[c.over(each).alias(name) for name, c in totals])
    found = rows.groupBy(key).agg(F.count("*").alias("__n"), *[c.alias(name) for name, c in totals])
    hot = found.where(F.col("__n") > HOT_ROWS).orderBy(F.col("__n").desc(), key).limit(HOT_KEYS).drop("__n")
    some = hot.collect()  # HOT_KEYS rows at most
    if not some:
        return rows.select("*", *[c.over(each).alias(name) for name, c in totals])
    held = F.broadcast(rows.sparkSession.createDataFrame(some, hot.schema))
    cold = rows.join(held.select(key), key, "left_anti").select(*rows.columns, *[c.over(each).alias(name) for name, c in totals])
    return rows.join(held, key).select(*cold.columns).unionByName(cold)
