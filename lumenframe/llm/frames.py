"""Tables that a job writes and rereads, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A null id sorts before every id, as this value.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of a file of a table of numbers, and of one that a task makes from whole texts, about.
NARROW_ROWS, TEXT_ROWS = 50_000, 5_000
#: Rows that go to a Python worker at once: a row is a whole text here, so batches of Spark's default would take tens of megabytes.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Set Arrow batches of BATCH_ROWS rows in the session, unless it has a number of its own below Spark's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) >= 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


_open: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved within it, by any operator, are deleted after it: what it is for must be written by then."""
    made: list[tuple[SparkSession, str]] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for owner, root in made:
            _delete(owner, root)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Parquet tables under the shared folder. A table cuts the lineage, and survives the loss of the executor that wrote it."""

    def __init__(self, spark: SparkSession, name: str):
        short_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if _open:
            _open[-1].append((spark, self.root))

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None, each: int = NARROW_ROWS) -> DataFrame:
        """The table, written and read again. rows: at most, or about, as many as the table has or is made of; it then has a file for
        `each` of them at most, however many partitions the session's shuffles have."""
        to = self.path(name)
        if rows is not None:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, -(-rows // each)))
        df.write.parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._scratch_path = to
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table from save() that nothing reads any more."""
        _delete(self.spark, df._scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(id_col: str, text_col: str) -> list:
    """Columns that tell rows apart as far as results may differ: the id (null: NO_ID) and the text's hash."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"),
        F.xxhash64(F.col(text_col)).alias("__hash"),
    ]


def extend(schema: StructType, ddl: str) -> StructType:
    """The schema with the columns of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
