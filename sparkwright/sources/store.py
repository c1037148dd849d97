"""Tables that are appended to in batches and changed by partitions, on plain Parquet.

A batch is a folder of rows and, written last, a mark that it is whole.  Only
marked batches are read, so a batch that broke off leaves nothing that counts
and is simply written again; one that is marked is not written twice, so a
replay adds nothing.  Writers of different batches touch different folders, so
none loses what another wrote; where two of them bring one key, the batch with
the lesser name has it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkwright.sources.shared import settle

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class Batches:
    """The batches below ``path``, of rows of ``schema`` that are told apart by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> None:
        if "batch" in schema.names:
            raise ValueError("the column batch is the table's own")
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def _parquet(self, folder: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def marks(self) -> DataFrame:
        """The names of whole batches."""
        return self._parquet("marks", StructType().add("batch", StringType()))

    def rows(self) -> DataFrame:
        """The rows of whole batches, with their batch; a key of several batches is there several times."""
        return self._parquet("rows", StructType([*self.schema.fields, StructField("batch", StringType())])).join(self.marks(), "batch", "left_semi").select(*self.schema.names, "batch")

    def read(self) -> DataFrame:
        """One row a key: that of the batch with the least name."""
        rows = self.rows()
        first = rows.groupBy(*self.keys).agg(F.min_by(F.struct(*self.schema.names), "batch").alias("r"))
        return first.select("r.*")

    def append(self, df: DataFrame, batch: str) -> int:
        """Write what of ``df`` has a new key as ``batch``, mark it, and return the number of rows; a marked batch is left as it is and adds 0.

        Rows whose key is null in a column are told apart by the others; of
        rows with one key in a batch one is written.
        """
        if not _NAME.fullmatch(batch):
            raise ValueError(f"{batch!r} can't name a folder")
        if not self.marks().where(F.col("batch") == batch).isEmpty():
            return 0
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys]
        known = self.rows().select(*self.keys).alias("o")
        new = df.select(*self.schema.names).dropDuplicates(self.keys).alias("n").join(known, same, "left_anti")
        folder = f"{self.path}/rows/batch={batch}"
        new.write.mode("overwrite").parquet(folder)
        self.spark.range(1).select(F.lit(batch).alias("made")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")
        return self.spark.read.schema(self.schema).parquet(folder).count()


def change_partitions(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Set the columns of ``changes`` in the rows of the table at ``path`` that have their ``keys``.

    The table is partitioned by ``partition``, which ``changes`` has too; only
    partitions that it names are read and written, by Spark's overwrite of
    partitions, and all other files stay as they are.  Rows without a change
    and columns that ``changes`` doesn't have stay; changes without a row are
    ignored; changes of one key must be equal, and null keys match nothing.
    What is read is written elsewhere first, as it is to be overwritten.
    """
    stored = spark.read.parquet(path)
    own = [k for k in keys if k != partition]
    new = [c for c in changes.columns if c not in (*own, partition)]
    touched = stored.join(changes.select(partition).distinct(), partition, "left_semi").alias("o")
    marked = changes.dropDuplicates([partition, *own]).withColumn("_new", F.lit(True)).alias("n")
    joined = touched.join(marked, [partition, *own], "left")
    values = [F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new else F.col(c) for c in stored.columns]
    merged = settle(joined.select(*values), "changed")
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
