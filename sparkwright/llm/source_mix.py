"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the entropy sum(r log r - r + 1) under one token
constraint for each source, sum(size r) = target, and 0 <= r <= cap.  The
solution is r = min(cap, exp(lambda size)): an exponential tilt by size whose
dual variable is found by Newton's method, safeguarded by a bracket.  All
documents of one source and size have one rate, so every iteration is one
aggregation over the number of documents of each source and size; sources and
their state stay in tables, as many as there are.  Rates become whole copies
by error diffusion from large to small documents inside hashed groups of
bounded size, so that each source's tokens land on its target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm import storage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    weights: Sequence[float] = (5, 2, 1)
    cap: int = 3
    tolerance: float = 1e-6
    iterations: int = 60
    #: documents whose copies are rounded together
    group: int = 4096


def coded(sources: DataFrame) -> DataFrame:
    """``sources (source, ...)``, one row each, with ``code``: their places by code point, null last."""
    first = F.when(F.col("source").isNull(), 1).otherwise(0)
    ordered = sources.withColumn("_last", first).repartitionByRange("_last", "source").sortWithinPartitions("_last", "source")
    placed = storage.keep(ordered.drop("_last").withColumn("_at", F.monotonically_increasing_id()), "sources")
    part, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("code", row + F.col("_start")).drop("_part", "_at", "_start")


def targeted(sources: DataFrame, p: Params) -> DataFrame:
    """``sources (code, size, ...)`` with ``target``: shares of the whole by weight; what lies above ``cap`` times a size is shared again by weight.

    A source is at its cap where cap * size / weight is below what one unit of
    weight gets; that level only rises while caps give way, so it is found by
    a few aggregations.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in p.weights)), (F.col("code") % len(p.weights) + 1).cast("int"))
    rows = storage.keep(sources.withColumn("weight", weight), "weighted")
    whole = float(rows.agg(F.sum("size")).first()[0] or 0)
    most, capped, n = F.col("size") * float(p.cap), F.lit(False), -1
    while True:
        got = rows.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, most)).alias("full"), F.count_if(capped).alias("n")).first()
        left, total = whole - (got["full"] or 0.0), got["w"] or 0.0
        if not total or got["n"] == n:
            break
        n, capped = got["n"], F.lit(left / total) * F.col("weight") > most
    share = F.lit(left) * F.col("weight") / F.lit(total) if total else most
    return rows.withColumn("target", F.when(capped, most).otherwise(share))


def _solved(sources: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """``sources (code, size, n, target)`` with the dual variable ``lam`` of each, in units of one over its mean size.

    ``sizes (code, size, n)`` counts the documents of each size.  It is
    infinite where all is taken as often as can be, or nothing at all.
    """
    lam, lo, hi, none = F.col("lam"), F.col("lo"), F.col("hi"), F.lit(None).cast("double")
    full = F.col("target") >= p.cap * F.col("source_size")
    state = sources.withColumns({
        "mean": F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")), "lo": none, "hi": none,
        "done": (F.col("source_size") == 0) | full | (F.col("target") <= 0),
        "lam": F.when((F.col("source_size") > 0) & ~full & (F.col("target") > 0), 0.0).when(F.col("target") > 0, math.inf).otherwise(-math.inf),
    })
    state = storage.keep(state, "state")
    for _ in range(p.iterations):
        work = state.where("not done")
        if work.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(lam * x, F.lit(50.0)))
        mass = F.col("size") * F.col("n")
        sums = sizes.join(work.select("code", "lam", "mean"), "code").groupBy("code").agg(
            F.sum(mass * F.least(rate, F.lit(float(p.cap)))).alias("taken"), F.sum(F.when(rate < p.cap, mass * x * rate).otherwise(0.0)).alias("slope")
        )
        gap = F.col("taken") - F.col("target")
        near = F.abs(gap) <= p.tolerance * F.col("target")
        moved = state.join(sums, "code", "left").withColumns({"near": F.col("done") | near, "hi": F.when(~F.col("done") & (gap > 0), lam).otherwise(hi), "lo": F.when(~F.col("done") & (gap <= 0), lam).otherwise(lo), "step": F.when(F.col("slope") > 0, lam - gap / F.col("slope"))})
        inside = F.col("step").isNotNull() & (F.abs("step") < 1e9) & (lo.isNull() | (F.col("step") > lo)) & (hi.isNull() | (F.col("step") < hi))
        # outside the bracket: double away from the known side, or halve
        other = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(hi.isNull(), F.greatest(F.lit(1.0), 2 * lo)).otherwise(F.least(F.lit(-1.0), 2 * hi))
        new = moved.withColumn("lam", F.when(F.col("near"), lam).when(inside, F.col("step")).otherwise(other)).withColumn("done", F.col("near"))
        old, state = state, storage.keep(new.select(*state.columns), "state")
        storage.drop(old)
    return state


def _diffuse(size: np.ndarray, rate: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies of documents given from large to small; the error goes on to the next."""
    out = np.zeros(len(size), np.int64)
    carry = 0.0
    for i, (n, want) in enumerate(zip(size.tolist(), (size * rate).tolist(), strict=True)):
        if n:
            carry += want
            out[i] = min(cap, max(0, math.floor(carry / n + 0.5)))
            carry -= out[i] * n
    return out


def _sized(docs: DataFrame, text: str = "text", id_column: str = "doc_id", source: str = "source", *more: Column) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def mix(docs: DataFrame, params: Params | None = None, text: str = "text", id_column: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of each row of ``docs``.

    Sources go by code point with null last and take the weights in turn, which
    repeat.  Size is the number of words; a null text has none, is taken zero
    times a word and has one copy's rate of its source.  Repeated rows are
    rows of their own; a null id is allowed; other columns are ignored; an
    empty table gives an empty one.  Equal tables give equal mixes.
    """
    content = F.xxhash64(text).alias("content")
    return _mixed(_sized(docs, text, id_column, source, content), params or Params(), ("content",)).drop("content")


def _mixed(rows: DataFrame, p: Params, tie: Sequence[str] = ()) -> DataFrame:
    """The mix of ``rows (doc_id, source, size)``; the long columns ``tie`` order equal ids and sizes, deal them to groups, and are returned too."""
    spark = rows.sparkSession
    raw = storage.keep(rows, "sizes")
    counts = storage.keep(raw.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    per = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("docs"))
    sources = targeted(coded(per), p).select(F.col("source").alias("_s"), "code", F.col("size").alias("source_size"), "docs", "target")
    sources = storage.keep(sources, "sources")
    same = F.col("source").eqNullSafe(F.col("_s"))
    sizes = storage.keep(counts.join(sources.select("_s", "code"), same).where("size > 0").select("code", "size", "n"), "counts")
    solved = _solved(sources, sizes, p).select("_s", "code", "source_size", "target", "mean", "lam", F.ceil(F.col("docs") / p.group).alias("groups"))
    for x in (counts, sizes):
        storage.drop(x)
    tilt = F.when(F.col("lam") == math.inf, float(p.cap)).when(F.col("lam") == -math.inf, 0.0).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(p.cap))))
    rated = raw.join(solved, same).select(
        "doc_id", "size", "source_size", "target", tilt.alias("rate"), "code", F.pmod(F.xxhash64("doc_id", "size", *tie), F.col("groups")).cast("long").alias("part"), *tie
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by group, then from large to small; a group may go on in the next batch
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            code, part = held.column("code").to_numpy(), held.column("part").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from done(held.slice(a, b - a))
            held = held.slice(int(cuts[-1]))
        if held is not None and len(held):
            yield from done(held)

    def done(group: pa.Table) -> list[pa.RecordBatch]:
        size, rate = group.column("size").to_numpy(), group.column("rate").to_numpy()
        copies = _diffuse(size, rate, p.cap)
        out = group.select(["doc_id", "size", "source_size", "target"]).append_column("taken", pa.array(copies * size)).append_column("copies", pa.array(copies)).append_column("rate", group.column("rate"))
        for x in tie:
            out = out.append_column(x, group.column(x))
        return out.combine_chunks().to_batches()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = rated.repartition(parts, "code", "part").sortWithinPartitions("code", "part", F.desc("size"), "doc_id", *tie)
    return grouped.mapInArrow(run, ", ".join(["doc_id long, size long, source_size long, target double, taken long, copies long, rate double", *(f"{x} long" for x in tie)]))


def resample(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names and types, each as often as the mix takes it.

    A row is known by its place in its file, so that null and repeated ids get
    exactly their own copies.  Rows of one id, size and text are
    interchangeable.
    """
    row, times, copy = storage.fresh(docs, "row", "times", "copy")
    rows = storage.keyed(docs, row)
    with storage.temporary(docs.sparkSession) as stays:
        tie = [F.xxhash64("text", "source").alias("content"), F.col(row).alias("row")]
        mixed = _mixed(_sized(rows, "text", "doc_id", "source", *tie), params or Params(), ("content", "row"))
        copies = storage.keep(mixed.where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times)), "copies")
        stays.append(copies)
    small = copies.count() <= storage.BROADCAST_IDS
    joined = rows.join(copies.hint("broadcast") if small else copies.hint("merge"), row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
