"""Tables that cut lineage: written once to the cluster's shared folder and read back.

A written table survives the loss of an executor (unlike cached blocks), is not computed again by
later reads, and is the point where a retried task sees the same rows as the first attempt.
"""

from __future__ import annotations

import io
import pathlib
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewise.session import scratch_path


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once per session, so that executors need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_framewise_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.writestr(str(file.relative_to(root.parent)), file.read_text())
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'framewise')}.zip")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(where.toString())
    context._framewise_shipped = True


class Scratch:
    """Intermediate tables of one operator call; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame, part: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{part}")
        df.write.parquet(path)
        self.paths.setdefault(part, []).append(path)
        return self.spark.read.schema(StructType(df.schema.fields)).parquet(path)

    def keep_bucketed(self, df: DataFrame, part: str, column: str) -> DataFrame:
        """As ``keep``, in as many buckets of ``column`` as a shuffle has partitions: what is grouped or joined by it
        later moves only its other side."""
        path, table = scratch_path(self.spark, f"{self.name}-{part}"), f"scratch_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(table)
        self.paths.setdefault(part, []).append(path)
        return self.spark.table(table)

    def drop(self, *parts: str) -> None:
        for part in parts:
            for path in self.paths.pop(part, []):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def columns(df: DataFrame, **wanted) -> DataFrame:
    """``df`` cut to the columns an operator reads, under their standard names and types."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in wanted.items()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
