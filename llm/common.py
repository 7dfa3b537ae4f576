"""What the operators of this package share: table reading, shared storage, batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch; with whole texts in memory this bounds a Python worker.
MAX_BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``MAX_BATCH_ROWS`` if it is larger.

    Spark reads the size when a plan runs, not when it is made, so it can't be put back
    before the caller has run what an operator returns; all operators use this one size.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > MAX_BATCH_ROWS:
        spark.conf.set(key, str(MAX_BATCH_ROWS))


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the system, where the C library can; results don't change."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a local session (tests) gets a folder of its own; on a cluster
    that is an error, as executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.serial = 0
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.serial += 1
        path = f"{self.root}/{self.serial}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: int = 0) -> None:
        """Remove all tables but the last ``but``."""
        gone = self.paths[: len(self.paths) - but]
        for path in gone:
            drop_path(self.spark, path)
        self.paths = self.paths[len(gone) :]


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """A new schema with one more field."""
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def crc_mod(column, modulus: int):
    """crc32 of the column's text form, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
