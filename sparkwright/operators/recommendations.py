"""Recommendations: one for each finding, by rule and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.operators import assets as A
from sparkwright.operators import findings as O

# The effort and the kind of work that each rule's recommendation takes.
ACTIONS = {
    "T01": ("low", "technical"), "T02": ("mid", "technical"), "T03": ("low", "technical"), "T04": ("low", "technical"), "T05": ("mid", "technical"), "T06": ("mid", "technical"), "T07": ("low", "technical"),
    "T08": ("mid", "technical"), "T10": ("high", "technical"), "T11": ("mid", "technical"), "T12": ("mid", "technical"), "T13": ("low", "technical"), "T14": ("mid", "technical"), "T15": ("mid", "technical"),
    "T09a": ("mid", "technical"), "T09b": ("mid", "technical"), "T09c": ("high", "technical"),
    "C01": ("low", "content"), "C02": ("low", "content"), "C03": ("low", "content"), "C04": ("high", "content"), "C05a": ("mid", "content"), "C05b": ("low", "content"), "C05c": ("mid", "content"), "C05d": ("mid", "content"),
    "C06": ("mid", "content"), "C07": ("mid", "content"), "C08": ("low", "content"), "C09": ("low", "content"), "C10": ("mid", "content"), "C11": ("low", "content"), "TR04": ("low", "content"), "TR05": ("low", "content"),
    "E01": ("low", "content"), "G01": ("low", "technical"), "G03": ("high", "technical"), "G11": ("high", "content"), "G10": ("high", "content"),
    "K01": ("mid", "content"), "K02": ("low", "content"), "K06": ("mid", "technical"), "K03": ("high", "content"), "K04": ("mid", "content"), "K05": ("mid", "content"), "K07": ("mid", "content"),
    "Q01": ("mid", "content"), "Q03": ("mid", "content"), "A01": ("high", "content"), "A02": ("mid", "content"), "A03": ("mid", "technical"), "G04": ("low", "technical"), "E02": ("high", "content"), "E03": ("high", "content"),
    "SP01": ("high", "content"), "SP02": ("mid", "content"), "TA01": ("high", "content"), "TA02": ("mid", "content"),
}
#: what a rule without an entry of its own takes
GENERIC = ("mid", "content")
MANY = 5


def impact(severity: Column, affected: Column) -> Column:
    """high for errors and for warnings that reach many things, else low."""
    return F.when((severity == "high") | ((severity == "mid") & (affected >= MANY)), "high").otherwise("low")


def quadrant(impact_: Column, effort: Column) -> Column:
    return F.when((impact_ == "high") & (effort == "low"), "quick_win").when(impact_ == "high", "strategic").when(effort == "high", "low").otherwise("fill_in")


def recommend(findings: DataFrame) -> DataFrame:
    """A row for each of ``findings (finding_id, run_id, rule_id, pillar, scope, severity, claim, affected)``: what it takes, where it stands, what it touches.

    ``page`` is the finding's scope where that is a URL; the last columns say
    how the fix is to be measured.  Rules unknown to the
    table take the generic entry; equal findings give equal rows.
    """
    effort = E.lookup(F.col("rule_id"), {k: v[0] for k, v in ACTIONS.items()}, GENERIC[0])
    kind = E.lookup(F.col("rule_id"), {k: v[1] for k, v in ACTIONS.items()}, GENERIC[1])
    page = F.when(F.col("scope").rlike("(?i)^https?://"), F.col("scope"))
    x = findings.withColumns({"effort": effort, "kind": kind, "impact": impact(F.col("severity"), F.col("affected")), "page": page})
    return x.select("finding_id", "run_id", "rule_id", "pillar", "kind", "impact", "effort", quadrant(F.col("impact"), F.col("effort")).alias("priority"), O.horizon(F.col("effort")).alias("horizon"), O.confidence(F.col("claim")).alias("confidence"), "affected", "page", *A.validation(F.col("pillar"), F.col("rule_id"), F.col("scope")))
