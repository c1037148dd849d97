"""The life of a run as an automaton whose steps compose.

An event is a function on the states; the functions of neighbouring events
compose to one, in whatever groups they are taken.  A run's log, however long,
is therefore folded in blocks of neighbouring events on many tasks, and the
blocks' functions are folded after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.sources.shared import settle

STATES = ("draft", "collecting", "collected", "diagnosing", "reviewing", "output", "failed", "cancelled")
ACTIVE = ("draft", "collecting", "collected", "diagnosing")
COMPLETED = ("reviewing", "output")
#: events that a block holds, at most (a power of two)
BLOCK = 1024


def _table() -> dict[str, list[int]]:
    same = {s: s for s in STATES}
    # a step of the work sets its status, except that a cancelled run stays so
    steps = {s: {x: s for x in STATES if x != "cancelled"} for s in STATES if s not in ("draft", "output", "cancelled")}
    asked = {
        "cancel": {"collecting": "cancelled", "diagnosing": "cancelled"},  # by a person, while work goes on
        "retry": {"failed": "collecting", "cancelled": "collecting"},
        "decided": {"reviewing": "output"},  # every recommendation is settled
        "undecided": {"output": "reviewing"},  # one is open again
    }
    return {event: [STATES.index((same | moves)[s]) for s in STATES] for event, moves in (steps | asked).items()}


TRANSITIONS = _table()
_SAME = list(range(len(STATES)))


def _array(x: list[int]) -> Column:
    return F.array(*map(F.lit, x))


def _then(first: Column, second: Column) -> Column:
    """The function that is ``second`` after ``first``."""
    return F.transform(first, lambda i: F.element_at(second, i + 1))


def folded(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """run_id, the function ``moves`` of all its ``events (run_id, ts, seq, event)`` and how many there are.

    Events go by ``(ts, seq)``, which must be total in a run; unknown ones
    change nothing.  No task gets more of a run than a block, and then a
    function for each block.
    """
    order = ["run_id", "ts", "seq"]
    step = _array(_SAME)
    for name, moves in TRANSITIONS.items():
        step = F.when(F.col("event") == name, _array(moves)).otherwise(step)
    placed = settle(events.select(*order, "event").repartitionByRange(*order).sortWithinPartitions(*order).select("run_id", "event", F.monotonically_increasing_id().alias("at")), "events")
    compose = lambda rows: F.aggregate(rows, _array(_SAME), lambda acc, x: _then(acc, x["f"]))
    part = placed.groupBy("run_id", F.floor(F.col("at") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", step.alias("f")))).alias("r"))
    part = part.select("run_id", "block", compose(F.col("r")).alias("f"), F.size("r").cast("long").alias("n"))
    return part.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("block", "f"))).alias("r"), F.sum("n").alias("events")).select("run_id", compose(F.col("r")).alias("moves"), "events")


def status_after(status: Column, moves: Column) -> Column:
    """The status where ``moves`` leads; an unknown one stays."""
    names = F.array(*map(F.lit, STATES))
    at = F.array_position(names, status)
    return F.when(moves.isNull() | (at == 0), status).otherwise(F.element_at(names, F.element_at(moves, at.cast("int")) + 1))


def replay(runs: DataFrame, events: DataFrame, block: int = BLOCK) -> DataFrame:
    """``runs (run_id, status)`` after their events: status, and whether it is active or completed; events of unknown runs are ignored."""
    found = runs.select("run_id", "status").join(folded(events, block), "run_id", "left")
    status = status_after(F.col("status"), F.col("moves"))
    return found.select("run_id", status.alias("status"), F.coalesce("events", F.lit(0)).alias("events")).withColumns({"active": F.col("status").isin(*ACTIVE), "completed": F.col("status").isin(*COMPLETED)})
