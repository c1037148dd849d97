"""Where operators keep intermediate tables and binary files.

Everything goes to the folder named by ``spark.checkpoint.dir``, which every
executor and the driver can reach.  Only where that setting is absent (tests,
a laptop) a temporary folder is made and set.  Tables are written by Spark's
own committer; binary files are written under a name that is unique to the
task attempt, and only the manifest table, committed by Spark, says which
attempt counts.  A lost executor therefore leaves at worst an unread file.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN: dict[str, list[str]] = {}
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """The shared folder; set to a new temporary folder only if none is named and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; ``delete`` removes it."""
    path = f"{shared_root(spark)}/sparkwright/{tag}-{uuid.uuid4().hex}"
    _OPEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what is written inside, when the block ends, but for the frames of ``keep`` that the block puts into the list.

    Only paths of this block (and thread) go, so that frames of others, which
    may still be read, stay whole.
    """
    paths: list[str] = []
    token, stays = _SCOPE.set(paths), []
    try:
        yield stays
    finally:
        _SCOPE.reset(token)
        kept = {x._scratch_path for x in stays}
        for path in paths:
            if path not in kept:
                delete(spark, path)
        if (outer := _SCOPE.get()) is not None:
            outer += kept


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    opened = _OPEN.get(spark.sparkContext.applicationId, [])
    if path in opened:
        opened.remove(path)


def opened(spark: SparkSession) -> list[str]:
    """The scratch paths of this application that have not been deleted."""
    return list(_OPEN.get(spark.sparkContext.applicationId, []))


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a scratch table and return a frame that reads it back.

    This ends the lineage in a table that all executors share.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # lets the owner drop it early
    return out


def drop(df: DataFrame) -> None:
    """Delete the scratch table behind a frame that ``keep`` returned."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def local_path(path: str) -> str | None:
    """The plain path of a file on a mounted folder, or None for a remote store."""
    system, inner = open_fs(path)
    return inner if isinstance(system, pafs.LocalFileSystem) else None


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` (one that it doesn't have): a long of its own for each row, the same whenever the row is read.

    A row is known by its place in its file, so that nothing but a numbered
    list of files is written.  A frame that isn't a plain scan of files is
    written first.
    """
    spark = df.sparkSession
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = keep(df, "rows")
    file, place, number = fresh(df, "file", "place", "number")
    where = df.metadataColumn("_metadata")
    rows = df.select("*", where["file_path"].alias(file), where["row_index"].alias(place))
    files = keep(rows.select(file).distinct().repartition(1).select(file, F.monotonically_increasing_id().alias(number)), "files")
    few = files.count() <= BROADCAST_IDS // 16
    joined = rows.join(files.hint("broadcast") if few else files.hint("merge"), file)
    return joined.withColumn(name, F.shiftleft(F.col(number), 36).bitwiseOR(F.col(place))).select(*(F.col(f"`{c}`") for c in df.columns), name)


#: ids whose set may be sent to every executor: 16 MB of longs, twice that in a hash table
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``df`` joined (``left_semi`` or ``left_anti``) with the one-column table ``ids``.

    The ids are counted, and written first if they aren't a table of ``keep``.  Up to ``BROADCAST_IDS`` they are
    broadcast and the rows of ``df`` stay where they are; beyond that both
    sides are shuffled by the key.  The rows are the same either way.
    """
    kept = ids if getattr(ids, "_scratch_path", None) and ids.columns == [key] else keep(ids.select(key).where(f"`{key}` is not null").distinct(), "ids")
    small = kept.count() <= BROADCAST_IDS
    return df.join(kept.hint("broadcast") if small else kept.hint("merge"), key, how).select(*(F.col(f"`{c}`") for c in df.columns))
