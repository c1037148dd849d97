"""Current state from append-only logs: newest rows, status, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, which must be total, with their ``place``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run of each project; runs without a start come last, then the first id."""
    return newest(runs, ["project_id"], [F.desc_nulls_last("started_at"), F.asc("run_id")]).drop("place")


def deduplicate(evidence: DataFrame) -> DataFrame:
    """One row for each evidence key of a run, the first captured: replays append equal keys."""
    first = F.min(F.struct("captured_at", "evidence_id"))
    return evidence.groupBy("run_id", "evidence_key").agg(first.alias("f"), F.count("*").alias("copies")).select("run_id", "evidence_key", "f.evidence_id", "copies")


def progress_state(messages: DataFrame) -> DataFrame:
    """The fold of each run's ordered messages: nothing after the first terminal message counts."""
    at = F.struct("ts", "seq")
    end = messages.where(F.col("msg_type").isin("done", "failed")).groupBy("run_id").agg(F.min(at).alias("end_at"), F.min_by("msg_type", at).alias("terminal"))
    x = messages.join(end, "run_id", "left").where(F.col("end_at").isNull() | (at <= F.col("end_at")))
    return x.groupBy("run_id").agg(
        F.coalesce(F.first("terminal"), F.lit("running")).alias("state"), F.count("*").alias("messages"), F.count_if(F.col("msg_type") == "evidence_created").alias("evidence"),
        F.count_if(F.col("msg_type") == "phase").alias("phases"), F.max_by(F.when(F.col("msg_type") == "progress", F.col("amount")), F.when(F.col("msg_type") == "progress", at)).alias("last_progress"),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Incoming rows replace current ones by key; columns in ``keep`` stay as they are where the row exists."""
    is_new = F.col("_new").isNotNull()
    joined = current.alias("o").join(incoming.withColumn("_new", F.lit(1)).alias("n"), list(keys), "full_outer")
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def change_status(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """``runs (run_id, status)`` after ``changes (run_id, status)``, one a run: a cancelled run stays so, unless the change's ``bypass`` (where there is such a column) is true; changes of unknown runs are ignored."""
    old, new = F.col("status"), F.col("_new")
    bypass = F.coalesce("bypass", F.lit(False)) if "bypass" in changes.columns else F.lit(False)
    held = (old == "cancelled") & ~F.coalesce("_bypass", F.lit(False))
    joined = runs.join(changes.select("run_id", F.col("status").alias("_new"), bypass.alias("_bypass")), "run_id", "left")
    return joined.select("run_id", F.when(new.isNull() | held, old).otherwise(new).alias("status"))


def upsert_templates(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming templates by key, with their number of ``pages`` where there is such a column; where the stored representative wasn't chosen by the heuristic, it and its source stay."""
    joined = stored.withColumn("_old", F.lit(1)).alias("o").join(incoming.withColumn("_new", F.lit(1)).alias("n"), list(keys), "full_outer")
    kept = F.col("_new").isNull() | (F.col("_old").isNotNull() & (F.col("o.source") != "heuristic"))
    pages = [F.when(F.col("_new").isNull(), F.col("o.pages")).otherwise(F.col("n.pages")).alias("pages")] if "pages" in stored.columns else []
    return joined.select(*keys, *(F.when(kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("representative", "source")), *pages)


def without_deleted(log: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key of an append-only log, unless it is a tombstone (``deleted``)."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")
    return last.where("not deleted").drop("deleted")
