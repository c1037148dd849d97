"""Progress messages and evidence as streams.

``run_states`` keeps, for each run, the fold of its messages in managed state,
and ``late_run_states`` that of messages that come in any order up to a delay;
``evidence_windows`` counts evidence by type and day behind a watermark (an
extension: nothing in the batch operators needs event time).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

STATE = "state string, messages long, evidence long, phases long, last_progress long"
RESULT = f"run_id long, {STATE}"
Result = Row(*(x.split()[0] for x in RESULT.split(", ")))


def source(spark: SparkSession, folder: str, schema: StructType, name: str = "*.parquet", files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, oldest first, ``files`` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


START = ("running", 0, 0, 0, None)
TERMINAL = ("done", "failed")


def fold(state: tuple, messages: pd.DataFrame) -> tuple:
    """The state after messages in order; after a terminal message nothing counts."""
    kind, n, evidence, phases, last = state
    if kind != "running" or not len(messages):
        return state
    kinds = messages.sort_values(["ts", "seq"])
    ends = kinds["msg_type"].isin(TERMINAL).to_numpy()
    stop = int(ends.argmax()) + 1 if ends.any() else len(kinds)
    kinds = kinds.iloc[:stop]
    moved = kinds.loc[kinds["msg_type"] == "progress", "amount"]
    return (
        kinds["msg_type"].iloc[-1] if ends.any() else "running", int(n + stop), int(evidence + (kinds["msg_type"] == "evidence_created").sum()), int(phases + (kinds["msg_type"] == "phase").sum()),
        int(moved.iloc[-1]) if len(moved) else last,
    )


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get if state.exists else START
    # a run's messages of one trigger are few; they are ordered together
    after = fold(before, pd.concat(list(batches)))
    state.update(after)
    yield pd.DataFrame([(key[0], *after)], columns=[x.split()[0] for x in RESULT.split(", ")])


def run_states(messages: DataFrame) -> DataFrame:
    """Current state of each run that had messages in the trigger; messages must reach triggers in order (``late_run_states`` asks for less)."""
    return messages.groupBy("run_id").applyInPandasWithState(_update, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


WAITING = "at long, seq long, msg_type string, amount long"


def counting(messages: dict[tuple, tuple]) -> list[tuple]:
    """Of ``messages {(at, seq): (msg_type, amount)}`` in order those up to the first terminal one: what comes after it never counts, whatever is still to come."""
    ends = min((k for k, m in messages.items() if m[0] in TERMINAL), default=None)
    return [(*k, *messages[k]) for k in sorted(messages) if ends is None or k <= ends]


def fold_rows(state: tuple, rows: list[tuple]) -> tuple:
    """``fold`` of a few rows that ``counting`` gave."""
    kind, n, evidence, phases, last = state
    if kind != "running":
        return state
    for _, _, what, amount in rows:
        n += 1
        evidence += what == "evidence_created"
        phases += what == "phase"
        last = amount if what == "progress" else last
        kind = what if what in TERMINAL else kind
    return kind, n, evidence, phases, last


class LateProgress(StatefulProcessor):
    """What is older than the watermark is folded; what isn't waits by (at, seq), so that a late message finds its place.

    Each call to the state is a message to Spark and back, so a run's waiting
    messages are read and added in one call each, and only the earliest of
    them has a timer (``due``), which hands on to the next.  Messages after a
    run's first terminal one don't wait; a message that comes again counts
    once.  A run whose folded part has ended keeps nothing that waits, and
    takes nothing more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", f"{STATE}, due long")
        self.waiting = handle.getListState("waiting", WAITING)

    def _due(self, at: int) -> int:
        self.handle.registerTimer(at // 1000)
        return at

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.folded.get()
        *before, due = known or (*START, None)
        before = tuple(before)
        if before[0] != "running":
            return
        held = [tuple(x) for x in self.waiting.get()] if known else []
        all_ = {x[:2]: x[2:] for x in held}
        came = {(x["at"], x["seq"]): (x["msg_type"], x["amount"]) for x in rows}
        came = {k: v for k, v in came.items() if k not in all_}
        keep = counting(all_ | came)
        if len(keep) < len(all_) + len(came):
            if keep != held:
                self.waiting.put(keep)
        elif came:
            self.waiting.appendList([(*k, *v) for k, v in came.items()])
        if keep and (due is None or keep[0][0] < due):
            self.folded.update((*before, self._due(keep[0][0])))
        yield Result(key[0], *fold_rows(before, keep))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = sorted(tuple(x) for x in self.waiting.get())
        ripe = [x for x in held if x[0] // 1000 <= limit]
        if not ripe:
            return iter(())
        after, rest = fold_rows(tuple(self.folded.get())[:-1], ripe), held[len(ripe) :]
        if after[0] != "running" or not rest:
            self.waiting.clear()
            self.folded.update((*after, None))
        else:
            self.waiting.put(rest)
            self.folded.update((*after, self._due(rest[0][0])))
        return iter(())

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Within the block, streams keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def late_run_states(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """State of each run that had messages in the trigger, from all that have come in whatever order; what is later than ``late`` is dropped.

    Needs the RocksDB state store (``rocks_db``, or the session's own setting).
    """
    at = messages.withWatermark("ts", late).select("run_id", "ts", F.unix_micros("ts").alias("at"), "seq", "msg_type", "amount")
    return at.groupBy("run_id").transformWithState(LateProgress(), StructType.fromDDL(RESULT), "Update", "EventTime")


def evidence_windows(evidence: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Evidence of each type in each window of event time; what is later than ``late`` is dropped."""
    at = evidence.withWatermark("captured_at", late)
    counts = at.groupBy(F.window("captured_at", width).alias("w"), "type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "type", "n")


def once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, each batch written to ``folder``; returns the written rows with their batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(StructType(stream.schema.fields)).option("recursiveFileLookup", "false").parquet(folder)
