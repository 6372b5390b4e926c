"""Tables and folders that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay under this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of an operator; they go when its block ends, so its result must be written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, new_dir(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        drop_folder(self.spark, self.folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that this library wrote, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def texts_in_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Texts can be long: Arrow batches of this session hold `rows` rows at most, unless it asks for fewer, and about `size` bytes (one row at least)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast when the counted rows are few, else leaves a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever it holds (dots, backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name can clash with those an operator adds; select("row.*") gives them back."""
    return F.struct(*[quoted(c) for c in df.columns]).alias("row")
