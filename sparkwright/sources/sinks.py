"""Writing evidence, findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_evidence(evidence: DataFrame, path: str) -> None:
    """Append to the log, a folder for each type."""
    evidence.write.mode("append").partitionBy("type").parquet(path)


class GateError(ValueError):
    """A batch holds a claim that its evidence doesn't support."""


def gated_findings(findings: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings ``(finding_id, claim_type, refs)`` split into valid ones and violations.

    A finding needs a reference; a hard measurement needs one of L1, a sampled
    one of L1 or L2, among the references that exist.
    """
    levels = findings.select("finding_id", F.explode("refs").alias("evidence_id")).join(evidence.select("evidence_id", "level"), "evidence_id").groupBy("finding_id").agg(F.collect_set("level").alias("levels"))
    x = findings.join(levels, "finding_id", "left").withColumn("levels", F.coalesce("levels", F.array().cast("array<string>")))
    hard, sampled = F.col("claim_type") == "measured_hard", F.col("claim_type") == "measured_sample"
    ok = (F.size("refs") > 0) & (~hard | F.array_contains("levels", "L1")) & (~sampled | F.arrays_overlap("levels", F.array(F.lit("L1"), F.lit("L2"))))
    return x.where(ok).drop("levels"), x.where(~ok)


def insert_findings(findings: DataFrame, evidence: DataFrame, path: str) -> None:
    """Append a batch whole or not at all: one violation rejects it."""
    valid, bad = gated_findings(findings, evidence)
    if not bad.isEmpty():
        raise GateError("the batch has findings without the evidence that they claim")
    valid.write.mode("append").parquet(path)


def report_markdown(health: DataFrame, top: DataFrame, constraint: DataFrame, run_id: int) -> str:
    """A short report of one run.  What is collected is a few rows by definition: a score, three findings, a verdict."""
    h = health.where(F.col("run_id") == run_id).first()
    c = constraint.where(F.col("run_id") == run_id).first()
    lines = [f"# Run {run_id}", "", f"Health: {'not scored' if h is None or h.overall is None else h.overall}", ""]
    if h is not None:
        lines += ["| Pillar | Score |", "|---|---|", *(f"| {p} | {'not measured' if h[p] is None else h[p]} |" for p in ("P1", "P2", "P3", "P4", "P5")), ""]
    lines += [f"Main constraint: {c.kind if c else 'unknown'}", "", "## Findings that matter most", ""]
    lines += [f"{r.place}. {r.finding_id} ({r.severity}, {r.pillar})" for r in top.where(F.col("run_id") == run_id).orderBy("place").limit(3).collect()]
    return "\n".join(lines) + "\n"


SECTIONS = ("Summary", "Method and scope", "Pillars", "Keywords and gaps", "Competitors", "Priorities", "Roadmap", "Retest")


def _cell(value: object) -> str:
    return "not measured" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def full_report(frames: dict[str, DataFrame], run_id: int, rows: int = 20) -> str:
    """A report of one run in eight sections, each a table of the frame of its name.

    A frame has ``run_id``; its other columns are shown.  Rows go by ``place``
    where there is one, else by all columns, and a report shows the first
    ``rows`` of each with the number of the rest.  A section without a frame,
    or without a row of the run, says so; nulls are what was not measured.
    """
    lines = [f"# Run {run_id}", ""]
    for i, name in enumerate(SECTIONS, 1):
        lines += [f"## {i}. {name}", ""]
        own = frames[name].where(F.col("run_id") == run_id).drop("run_id") if name in frames else None
        order = [] if own is None else ["place"] if "place" in own.columns else own.columns
        shown = own.orderBy(*order).limit(rows + 1).collect() if own is not None else []
        if not shown:
            lines += ["Not measured.", ""]
            continue
        lines += [f"| {' | '.join(own.columns)} |", "|" + "---|" * len(own.columns), *(f"| {' | '.join(map(_cell, r))} |" for r in shown[:rows]), ""]
        if len(shown) > rows:
            lines += [f"{own.count() - rows} more.", ""]
    return "\n".join(lines).rstrip() + "\n"


def release(frames: dict[str, DataFrame], path: str) -> None:
    """Write several tables so that all appear at once or none: staged beside ``path``, then renamed.

    ``path`` must not exist.  A failed write leaves only the staging folder,
    which the next attempt replaces.
    """
    spark = next(iter(frames.values())).sparkSession
    staging = f"{path.rstrip('/')}.staging"
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{staging}/{name}")
    j = spark._jvm.org.apache.hadoop.fs.Path
    system = j(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(j(path)) or not system.rename(j(staging), j(path)):
        raise FileExistsError(path)


def affected_pages(why: str, pages: list[str], limit: int = 10) -> str:
    """A text with a section that lists pages; ``split_affected`` takes it apart again."""
    if not pages:
        return why
    more = [f"- and {len(pages) - limit} more"] if len(pages) > limit else []
    return "\n".join([why, "", "Affected pages:", *(f"- {p}" for p in pages[:limit]), *more])


def split_affected(text: str) -> tuple[str, list[str]]:
    why, mark, rest = text.partition("\n\nAffected pages:\n")
    return (why, [x.removeprefix("- ") for x in rest.split("\n") if not x.startswith("- and ")]) if mark else (text, [])


def actions_markdown(recs: DataFrame, run_id: int) -> str:
    """The gated recommendations of a run by quadrant and place.  A run's gated recommendations are a person's reading list; they are collected."""
    rows = recs.where(F.col("run_id") == run_id).orderBy("quadrant", "place").collect()
    lines = [f"# Actions for run {run_id}", ""]
    for quadrant in ("quick_win", "strategic", "fill_in", "low"):
        mine = [r for r in rows if r.quadrant == quadrant]
        if mine:
            lines += [f"## {quadrant}", "", *(f"{i}. {r.finding_id}/{r.rec_no}" for i, r in enumerate(mine, 1)), ""]
    return "\n".join(lines)
