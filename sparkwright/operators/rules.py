"""The rule registry: each rule is a query that yields hits.

A hit has run_id, scope, severity, claim, affected (how many things) and
measure (the number that triggered it); the registry adds rule_id, pillar and
the fingerprint that identifies the finding across runs.  Hits without
evidence do not arise: a rule aggregates the evidence it cites.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.sources.shared import settle

HIT = ("run_id", "scope", "severity", "claim", "affected", "measure")


@dataclass(frozen=True)
class Aggregate:
    """One hit a run where an aggregate condition holds.

    ``aggs`` name SQL aggregates over ``frame``; the other expressions use
    those names.
    """

    frame: str
    aggs: dict[str, str]
    where: str
    affected: str
    measure: str
    severity: str
    claim: str
    scope: str = "site"
    run: str = "run_id"

    def hits(self, df: DataFrame) -> DataFrame:
        per = df.groupBy(F.expr(self.run).cast("long").alias("run_id")).agg(*[F.expr(x).alias(a) for a, x in self.aggs.items()]).where(self.where)
        return hit(per, F.lit(self.scope), F.expr(self.severity), F.expr(self.claim), F.expr(self.affected), F.expr(self.measure))


@dataclass(frozen=True)
class Each:
    """A hit for every row that meets a condition."""

    frame: str
    where: str
    scope: str
    measure: str
    severity: str
    claim: str

    def hits(self, df: DataFrame) -> DataFrame:
        return hit(df.where(self.where), F.expr(self.scope), F.expr(self.severity), F.expr(self.claim), F.lit(1), F.expr(self.measure))


def hit(df: DataFrame, scope: Column, severity: Column, claim: Column, affected: Column, measure: Column) -> DataFrame:
    return df.select(F.col("run_id").cast("long").alias("run_id"), scope.alias("scope"), severity.alias("severity"), claim.alias("claim"), affected.cast("long").alias("affected"), F.round(measure.cast("double"), 6).alias("measure"))


Build = Callable[..., DataFrame]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pillar: str
    shape: Aggregate | Each | Build

    def finish(self, hits: DataFrame) -> DataFrame:
        named = hits.select(F.lit(self.rule_id).alias("rule_id"), F.lit(self.pillar).alias("pillar"), *HIT)
        return named.withColumn("fingerprint", E.fingerprint(F.col("rule_id"), F.col("scope")))

    def finish_sql(self, sql: str) -> str:
        return f"select '{self.rule_id}' as rule_id, '{self.pillar}' as pillar, run_id, scope, severity, claim, affected, round(measure, 6) as measure, sha256('{self.rule_id}::' || lower(trim(scope))) as fingerprint from ({sql})"


HIGH, MID, OK = "'high'", "'mid'", "'ok'"
MH, MS, INF, HYP = "'measured_hard'", "'measured_sample'", "'inferred'", "'hypothesis'"


def counting(frame: str, condition: str, severity: str, claim: str = MH, scope: str = "site", run: str = "run_id") -> Aggregate:
    return Aggregate(frame, {"n": f"count_if({condition})", "total": "count(*)"}, "n > 0", "n", "n * 1.0 / total", severity, claim, scope, run)


@dataclass(frozen=True)
class Limits:
    """The rule set's own thresholds."""

    unseen_pages: float = 0.7  # T15
    thin_chars: int = 300  # C04
    cluster_inbound: int = 5  # TA02
    unbranded_presence: float = 0.3  # G05
    engine_prompts: int = 0  # G06
    negative: float = 0.3  # G09
    speculative: float = 0.3  # G10
    user_content: float = 0.25  # G11
    owned_citations: float = 0.0  # G11
    impressions: int = 100  # K01, K02
    keyword_anchors: float = 0.4  # A02
    gained_links: int = 50  # A03
    gained_by_lost: float = 5  # A03
    review_sites: int = 3  # SP02


def plain(t: Limits) -> tuple[Rule, ...]:
    """Rules of one aggregation or one filter over what crawls and sources report; those of a page's own content are in ``page_rules``."""
    return (
        Rule("T01", "P1", counting("pages", "blocked", HIGH)),
        Rule("T02", "P1", Aggregate("pages", {"bad": "count_if(http_status >= 400 and not blocked)", "checked": "count_if(not blocked)"}, "bad > 0.05 * checked", "bad", "bad * 1.0 / checked", "case when bad > 0.15 * checked then 'high' else 'mid' end", MH)),
        Rule("T03", "P1", counting("pages", "noindex", HIGH)),
        Rule("T05", "P1", counting("pages", "in_sitemap and inbound = 0 and not blocked", MID)),
        Rule("T06", "P1", counting("pages", "redirected", MID)),
        Rule("T07", "P1", Aggregate("pages", {"n": "count(*)", "listed": "count_if(in_sitemap)"}, "n > 1 and listed = 0", "n", "listed", MID, MH, run="page_id % 15")),
        Rule("T09a", "P1", Each("vitals", "has_field and (lcp_ms > 2500 or inp_ms > 200 or cls > 0.1)", "'site'", "case when lcp_ms > 2500 then 1 else 0 end + case when inp_ms > 200 then 1 else 0 end + case when cls > 0.1 then 1 else 0 end", MID, MH)),
        Rule("T09c", "P1", Each("vitals", "ttfb_ms > 800", "'site'", "ttfb_ms", MID, "case when has_field then 'measured_hard' else 'inferred' end")),
        Rule("T10", "P1", Each("pages", "rendered_chars > 0 and initial_chars * 1.0 / rendered_chars < 0.3", "url", "initial_chars * 1.0 / rendered_chars", HIGH, MH)),
        Rule("T11", "P1", Each("pages", "key_page and inbound < 3", "url", "inbound", MID, MH)),
        Rule("T12", "P1", counting("pages", "depth > 3", MID)),
        Rule("G02", "P5", counting("crawlers", "kind = 'search' and status >= 400", HIGH)),
        Rule("G03", "P5", Each("pages", "rendered_chars > 0 and initial_chars * 1.0 / rendered_chars < 0.3", "url", "initial_chars * 1.0 / rendered_chars", HIGH, MH)),
        Rule("G04", "P5", Each("presence", "bing_indexed <= 5", "'site'", "bing_indexed", MID, MS)),
        Rule("G07", "P5", Each("presence", "not encyclopedia and forum_mentions < 3", "'brand'", "forum_mentions", MID, MS)),
        Rule("G08", "P5", Each("presence", "llms_txt", "'site'", "1", OK, MH)),
        Rule("E02", "P5", Each("presence", "not knowledge_panel", "'brand'", "0", OK, MS)),
        Rule("SP01", "P5", Each("presence", "video_results = 0", "'brand'", "0", MID, INF)),
        Rule("SP02", "P5", Each("presence", f"review_sites = {t.review_sites} and review_results = 0", "'brand'", "review_sites", OK, INF)),
        Rule("A03", "P5", Aggregate("backlinks", {"gained": "sum(new_links)", "lost": "sum(lost_links)"}, f"gained >= {t.gained_links} and gained >= {t.gained_by_lost} * lost", "gained", "gained * 1.0 / lost", OK, INF)),
    )


def isolated(parts: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Written hits of all ``parts (name, build)`` that can be evaluated, and the name and error of each that can't.

    All are written in one job.  Only where that fails are they halved, again
    and again, until what fails stands alone: a rule that raises, when it is
    planned or when it runs, costs some more jobs and takes no other with it.
    """
    if not parts:
        return [], []
    try:
        return [settle(reduce(DataFrame.unionByName, [build() for _, build in parts]), "hits")], []
    except PySparkException as e:
        if len(parts) == 1:
            return [], [(parts[0][0], e.getCondition() or type(e).__name__)]
    half = len(parts) // 2
    (a, bad), (b, worse) = isolated(parts[:half]), isolated(parts[half:])
    return [*a, *b], [*bad, *worse]


def by_frame(rules: Sequence[Rule]) -> list[tuple[str, list[Rule]]]:
    """Plain rules by the frame that they read."""
    out: dict[str, list[Rule]] = {}
    for rule in rules:
        out.setdefault(rule.shape.frame, []).append(rule)
    return list(out.items())


def _inside(text: str, struct: str, names: Iterable[str]) -> str:
    """An SQL expression whose ``names`` are fields of ``struct``."""
    return re.sub(rf"\b({'|'.join(map(re.escape, names))})\b", rf"{struct}.\1", text)


def together(rules: Sequence[Rule], df: DataFrame) -> DataFrame:
    """The hits of several plain rules over one frame: one aggregation for each run key, and one pass for rules on single rows."""
    parts = []
    aggregates: dict[str, list[Rule]] = {}
    for rule in rules:
        if isinstance(rule.shape, Aggregate):
            aggregates.setdefault(rule.shape.run, []).append(rule)
    row = lambda rule, scope, severity, claim, affected, measure: F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.pillar).alias("pillar"), scope.alias("scope"), F.expr(severity).alias("severity"), F.expr(claim).alias("claim"), affected.cast("long").alias("affected"), F.round(F.expr(measure).cast("double"), 6).alias("measure")
    )
    for run, group in aggregates.items():
        per = df.groupBy(F.expr(run).cast("long").alias("run_id")).agg(*(F.struct(*(F.expr(x).alias(a) for a, x in r.shape.aggs.items())).alias(f"a{i}") for i, r in enumerate(group)))
        found = []
        for i, r in enumerate(group):
            at = lambda x, i=i, r=r: _inside(x, f"a{i}", r.shape.aggs)
            found.append(F.when(F.expr(at(r.shape.where)), row(r, F.lit(r.shape.scope), at(r.shape.severity), at(r.shape.claim), F.expr(at(r.shape.affected)), at(r.shape.measure))))
        parts.append(per.select("run_id", F.explode(F.array_compact(F.array(*found))).alias("r")))
    single = [r for r in rules if isinstance(r.shape, Each)]
    if single:
        found = [F.when(F.expr(r.shape.where), row(r, F.expr(r.shape.scope), r.shape.severity, r.shape.claim, F.lit(1), r.shape.measure)) for r in single]
        parts.append(df.select(F.col("run_id").cast("long").alias("run_id"), F.explode(F.array_compact(F.array(*found))).alias("r")))
    out = reduce(DataFrame.unionByName, parts).select("r.rule_id", "r.pillar", "run_id", "r.scope", "r.severity", "r.claim", "r.affected", "r.measure")
    return out.withColumn("fingerprint", E.fingerprint(F.col("rule_id"), F.col("scope")))
