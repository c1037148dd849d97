"""Queries over findings, recommendations, reports and retests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.operators import findings as O
from sparkwright.operators import log as L
from sparkwright.operators import probes as P
from sparkwright.operators.log import newest
from sparkwright.operators.ranking import ranked
from sparkwright.plans import probes as probe_plans
from sparkwright.plans.serp import aio_rates
from sparkwright.sources.bindings import Bound, ctes

BASE, RETEST = 1995, 1996
TODAY = "2026-01-01"


def per_site(b: Bound) -> DataFrame:
    """Findings with one run for each customer, so that a run has about ten."""
    return b.findings.withColumn("run_id", F.col("fingerprint").cast("long"))


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.health(per_site(Bound(spark, sf_dir)), pillars_with_data(spark, sf_dir))


def active_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.active(Bound(spark, sf_dir).findings).select("run_id", "finding_id", "rule_id", "severity", "status")


def measured_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).findings.where(F.col("claim_type").isin("measured_hard", "measured_sample")).select("run_id", "finding_id", "claim_type")


def finding_stat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).findings.select("finding_id", "rule_id", "status")


def rec_stat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir)
    return b.recs.join(b.findings.select("finding_id", "rule_id"), "finding_id").select("finding_id", "rec_no", "rule_id", "outcome")


def rule_dismissal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rule_stats(Bound(spark, sf_dir).findings, F.col("status") == "dismissed", F.lit(True), threshold=0.45)


def rule_ineffective_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rec_stat_records(spark, sf_dir)
    return O.rule_stats(x, F.col("outcome").isin("ineffective", "regressed"), F.col("outcome") != "unknown", threshold=0.6)


def new_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rules and stale artifacts without a pending proposal of the same source and target."""
    b = Bound(spark, sf_dir)
    stats = rule_dismissal_stats(spark, sf_dir).where("flagged").select(F.lit("stats").alias("source"), F.col("rule_id").alias("target"))
    stale = O.freshness(b.artifacts, F.to_date(F.lit(TODAY))).where("stale").select(F.lit("freshness").alias("source"), F.col("artifact_key").alias("target"))
    pending = b.proposals.where("status = 'pending'").select("source", "target")
    return stats.union(stale).distinct().join(pending, ["source", "target"], "left_anti")


def finding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.delta(Bound(spark, sf_dir).findings, BASE, RETEST)


def finding_delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_delta(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def duplicate_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality query: fingerprints that several findings of a run share."""
    return Bound(spark, sf_dir).findings.groupBy("run_id", "fingerprint").agg(F.count("*").alias("n")).where("n > 1")


def rec_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each recommendation of the baseline run by its finding's state."""
    b = Bound(spark, sf_dir)
    base = b.findings.where(F.col("run_id") == BASE).select("finding_id", "fingerprint")
    x = b.recs.join(base, "finding_id").join(finding_delta(spark, sf_dir).select("fingerprint", "state"), "fingerprint", "left")
    return x.select("finding_id", "rec_no", "state", O.outcome(F.col("state")).alias("new_outcome"))


def new_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the retest whose fingerprint no finding of the baseline has."""
    f = Bound(spark, sf_dir).findings
    return f.where(F.col("run_id") == RETEST).join(f.where(F.col("run_id") == BASE).select("fingerprint"), "fingerprint", "left_anti").select("finding_id", "fingerprint", "rule_id")


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_findings(per_site(Bound(spark, sf_dir)))


def _recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir)
    return b.recs.join(b.findings.select("finding_id", "run_id"), "finding_id")


def gated_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).recs.where(F.col("status").isin(*O.GATED)).select("finding_id", "rec_no", "status")


def priority_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recs(spark, sf_dir).groupBy("run_id", O.quadrant(F.col("priority")).alias("quadrant")).agg(F.count("*").alias("n"))


def roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recs(spark, sf_dir).where(F.col("status").isin(*O.GATED)).groupBy("run_id", O.horizon(F.col("effort")).alias("horizon")).agg(F.count("*").alias("n"))


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = E.lookup(O.quadrant(F.col("priority")), {"quick_win": 0, "strategic": 1, "fill_in": 2, "low": 3})
    return L.newest(_recs(spark, sf_dir).where(F.col("status").isin(*O.GATED)), ["run_id"], [rank, F.col("finding_id"), F.col("rec_no")], 3).select("run_id", "place", "finding_id", "rec_no", "priority")


def action_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = E.lookup(F.col("priority"), {"quick_win": 0, "strategic": 1, "fill_in": 2, "low": 3}, 99)
    order = Window.partitionBy("finding_id").orderBy(rank, "rec_no")
    return Bound(spark, sf_dir).recs.select("finding_id", "rec_no", F.row_number().over(order).alias("place"))


def applied_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = F.col("status").isin(*O.GATED)
    x = _recs(spark, sf_dir).groupBy("run_id").agg(F.count_if(gated).alias("gated"), F.count_if(gated & F.col("applied")).alias("applied"))
    return x.withColumn("percent", F.when(F.col("gated") > 0, E.js_round(F.col("applied") / F.col("gated") * 100).cast("long")))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir)
    f = b.findings.groupBy("run_id").agg(F.count_if(F.col("status") != "dismissed").alias("findings"), F.count_if(F.col("status") == "dismissed").alias("dismissed"))
    r = _recs(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("recommendations"), F.count_if(F.col("status").isin(*O.GATED)).alias("gated"))
    return f.join(r, "run_id", "left").na.fill(0, ["recommendations", "gated"])


def constraint_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.constraint(per_site(Bound(spark, sf_dir)))


def pillars_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pillars that evidence or findings speak to; P4 only with confirmed competitors."""
    b = Bound(spark, sf_dir)
    by_type = {"view": "P1", "click": "P2", "signup": "P3", "purchase": "P4"}
    e = b.evidence.select("run_id", E.lookup(F.col("type"), by_type, "P5").alias("pillar"))
    f = per_site(b).select("run_id", "pillar")
    confirmed = F.col("run_id") % 2 == 0
    return e.union(f).distinct().where((F.col("pillar") != "P4") | confirmed)


def report_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.report_level(Bound(spark, sf_dir).sources, F.col("run_id") % 3, F.col("run_id") % 4)


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Bound(spark, sf_dir).sources.where(F.col("source_key").isin("gsc", "dataforseo", "ai_probe", "psi"))
    return s.groupBy("run_id").agg(F.count_if(F.col("status") == "collected").alias("up"), F.count("*").alias("total"))


def artifact_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.freshness(Bound(spark, sf_dir).artifacts, F.to_date(F.lit(TODAY)))


def stale_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = artifact_freshness(spark, sf_dir)
    return x.agg(F.count_if("stale").alias("stale"), F.count("*").alias("total"), F.max("age_days").alias("oldest_days"))


def claim_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured claims whose evidence is not of the level that they need (L1 hard, L1 or L2 sampled)."""
    b = Bound(spark, sf_dir)
    x = b.findings.join(b.evidence.select((F.col("evidence_id") - 1).alias("finding_id"), "level"), "finding_id")
    bad = ((F.col("claim_type") == "measured_hard") & (F.col("level") != "L1")) | ((F.col("claim_type") == "measured_sample") & ~F.col("level").isin("L1", "L2"))
    return x.where(bad).select("finding_id", "claim_type", "level")


def _refs(b: Bound) -> DataFrame:
    """Evidence references of findings: the finding's id and two multiples of it, some of which don't exist, some null."""
    ids = F.array(F.col("finding_id"), F.col("finding_id") * 2, F.when(F.col("finding_id") % 5 == 0, None).otherwise(F.col("finding_id") * 3))
    return b.findings.select("run_id", "finding_id", F.when(F.col("finding_id") % 13 == 0, F.array().cast("array<long>")).otherwise(F.array_compact(ids)).alias("refs"))


def hits_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(Bound(spark, sf_dir)).where(F.size("refs") > 0).select("run_id", "finding_id", F.size("refs").alias("n_refs"))


def finding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir)
    x = _refs(b).select("finding_id", F.explode("refs").alias("evidence_id")).join(b.evidence.select("evidence_id", "level"), "evidence_id")
    return x.groupBy("finding_id").agg(F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels"))


def evidence_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference in order with its evidence, or as not found."""
    b = Bound(spark, sf_dir)
    x = _refs(b).select("finding_id", F.posexplode("refs").alias("pos", "evidence_id")).join(b.evidence.select("evidence_id", "type", "level"), "evidence_id", "left")
    text = F.coalesce(F.concat("type", F.lit(" "), "level"), F.lit("not found"))
    return x.groupBy("finding_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda s: s["t"]), "; ").alias("summary"))


def valid_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).proposals.where(F.trim("evidence") != "").select("proposal_id", "source", "target")


def proposals_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).proposals.where("status = 'pending'").select("proposal_id", "target")


def released_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).proposals.where("version is not null").select("proposal_id", "version")


def released_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).proposals.where("version is not null").select("version").distinct()


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released proposals by version, newest version first by its number."""
    number = F.regexp_extract("version", r"(\d+)$", 1).cast("int")
    x = released_proposals(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n"), F.min("proposal_id").alias("first_proposal"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc(number))))  # one row a version


def rules_version_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.next_version(released_proposals(spark, sf_dir))


def share_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null never expires, what isn't a time counts as expired, and the moment itself is expired."""
    text = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("expires"))
    at = F.try_to_timestamp("expires", F.lit("yyyy-MM-dd HH:mm:ss"))
    return x.select("event_id", F.when(F.col("expires").isNull(), False).otherwise(at.isNull() | (at <= F.to_timestamp(F.lit("2024-01-15 00:00:00")))).alias("expired"))


def latest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest share of each run that hasn't expired."""
    shares = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("run_id"), F.col("ts").alias("created_at"))
    open_ = share_expired(spark, sf_dir).where("not expired").select("event_id")
    return newest(shares.join(open_, "event_id"), ["run_id"], [F.desc("created_at"), F.desc("event_id")]).select("run_id", F.col("event_id").alias("share_id"))


def retest_gsc_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions and mean position of each run over the target keywords."""
    b = Bound(spark, sf_dir)
    targets = b.labs.where("intent = 'commercial'").select(F.col("keyword_id").alias("query_id"))
    x = b.gsc.join(targets, "query_id", "left_semi").groupBy("run_id").agg(F.sum("impressions").alias("impressions"), F.round(F.avg("avg_pos"), 6).alias("position"))
    return x


def metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions of each query in a run and the run before it; both must have it."""
    g = Bound(spark, sf_dir).gsc.withColumn("run_id", F.col("page_id") % 3).groupBy("query_id", "run_id").agg(F.sum("impressions").alias("impressions"))
    w = Window.partitionBy("query_id").orderBy("run_id")
    x = g.withColumn("baseline", F.lag("impressions").over(w)).withColumn("prev", F.lag("run_id").over(w))
    return x.where(F.col("prev") == F.col("run_id") - 1).select("query_id", "run_id", "baseline", F.col("impressions").alias("retest"))


def retest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State counts of a retest, and, for neighbouring runs with one-sided rows kept, health, unbranded presence and two AI-overview rates."""
    b = Bound(spark, sf_dir)
    states = finding_delta_summary(spark, sf_dir).select(F.lit(RETEST).cast("long").alias("run_id"), F.concat(F.lit("findings."), "state").alias("metric"), F.lit(None).cast("long").alias("baseline"), F.col("n").alias("retest"), F.lit(None).cast("long").alias("delta"))
    health = O.health(b.findings, b.findings.select("run_id", "pillar"))
    a = probe_plans.Answers(spark, sf_dir)
    probe = P.unbranded_presence(P.prompt_presence(a.parsed, a.prompts)).select("run_id", (F.col("present") / F.col("total")).alias("ratio"))
    aio = aio_rates(spark, sf_dir)
    parts = ((health, "overall", "health.overall", 0.01), (probe, "ratio", "probe.unbranded_presence", 1.0), (aio, "present_rate", "aio.present_rate", 1.0), (aio, "owned_rate", "aio.owned_cited_rate", 1.0))
    for table, column, metric, unit in parts:
        now = table.select("run_id", (F.col(column) * unit).alias("p1"))
        x = table.select((F.col("run_id") + 1).alias("run_id"), (F.col(column) * unit).alias("p0")).join(now, "run_id", "full_outer")
        rows = x.select("run_id", *O.ratio_row(metric, F.col("p0"), F.col("p1"))).where("baseline is not null or retest is not null")
        if table is probe:  # the numbers of runs that can't be compared stand side by side, without a difference
            apart = probe_plans.comparability(spark, sf_dir).where("not comparable").select("run_id", F.lit(True).alias("apart"))
            rows = rows.join(apart, "run_id", "left").withColumn("delta", F.when(F.col("apart").isNull(), F.col("delta"))).drop("apart")
        states = states.unionByName(rows)
    return states


def findings_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each run as JSON arrays of 50, by id: what an API would send."""
    f = Bound(spark, sf_dir).findings.select("run_id", "finding_id", "rule_id", "severity", "status", "claim_type")
    placed = ranked(f, ["run_id"], [F.col("finding_id")]).withColumn("page", F.ceil(F.col("place") / 50).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("finding_id", "rule_id", "severity", "status", "claim_type")))
    return placed.groupBy("run_id", "page").agg(F.count("*").alias("rows"), F.to_json(rows, {"ignoreNullFields": "false"}).alias("body"))


QUERIES = (
    health_score, active_findings, measured_findings, finding_stat_records, rec_stat_records, rule_dismissal_stats, rule_ineffective_stats, new_proposals, finding_delta, finding_delta_summary, duplicate_fingerprints,
    rec_outcomes, new_hits, top_findings, gated_recs, priority_matrix, roadmap, next_steps, action_order, applied_progress, report_counts, constraint_locator, pillars_with_data, report_level, source_health,
    artifact_freshness, stale_artifacts, claim_gate_violations, hits_with_evidence, finding_levels, evidence_summaries, valid_proposals, proposals_by_status, released_proposals, released_versions, changelog,
    rules_version_delta, share_expired, latest_share, retest_gsc_metric, metric_pairs, retest_rows, findings_pages,
)

_F, _R = ctes("findings"), ctes("findings", "recs")
_SITE = _F + ", s as (select * replace (cast(fingerprint as bigint) as run_id) from b_findings), a as (select * from s where status <> 'dismissed')"
_W = "case severity when 'high' then 3::double when 'mid' then 1::double else 0.25::double end"
_LOW = "case when n > 0 then greatest(0::double, (hits::double / n + 3.8416::double / (2 * n) - 1.96::double * sqrt(hits::double / n * (1 - hits::double / n) / n + 3.8416::double / (4 * n::double * n))) / (1 + 3.8416::double / n)) else 0::double end"
_DELTA = f""", l as (select run_id, fingerprint, arg_max(severity, finding_id) as severity from b_findings group by all),
d as (select coalesce(b.fingerprint, r.fingerprint) as fingerprint, b.severity as baseline_severity, r.severity as retest_severity,
  case when r.severity is null then 'resolved' when b.severity is null then 'new' when (case r.severity when 'high' then 2 when 'mid' then 1 else 0 end) > (case b.severity when 'high' then 2 when 'mid' then 1 else 0 end) then 'regressed' else 'persistent' end as state
  from (select * from l where run_id = {BASE}) b full join (select * from l where run_id = {RETEST}) r on b.fingerprint = r.fingerprint)"""
_RR = ", rr as (select r.*, f.run_id from b_recs r join b_findings f using (finding_id))"
_G = "status in ('accepted', 'edited')"
_STATS = f", st as (select rule_id, n, hits, round({_LOW}, 6) as wilson_low, n >= 20 and {_LOW} > {{t}}::double as flagged from x)"
_DISMISS = ", x as (select rule_id, count(*) as n, count(*) filter (status = 'dismissed') as hits from b_findings group by all)" + _STATS.format(t=0.45)
_FRESH = f"select artifact_key, cast(date_diff('day', verified_on, date '{TODAY}') as integer) as age_days, verified_on is null or date_diff('day', verified_on, date '{TODAY}') > cadence_days as stale from b_artifacts"
_REFS = ", refs as (select run_id, finding_id, case when finding_id % 13 = 0 then [] when finding_id % 5 = 0 then [finding_id, finding_id * 2] else [finding_id, finding_id * 2, finding_id * 3] end as refs from b_findings)"
_Q = "case when priority in ('quick_win', 'strategic', 'fill_in', 'low') then priority else 'fill_in' end"
_QR = "case {p} when 'quick_win' then 0 when 'strategic' then 1 when 'fill_in' then 2 when 'low' then 3 else {e} end"
_DATA = "select * from (select run_id, case type when 'view' then 'P1' when 'click' then 'P2' when 'signup' then 'P3' when 'purchase' then 'P4' else 'P5' end as pillar from b_evidence union select cast(fingerprint as bigint), pillar from b_findings) where pillar <> 'P4' or run_id % 2 = 0"


def _health_sql(findings: str, data: str) -> str:
    """One row a run and pillar first, so that the penalty and what has data meet in a join; then pillars side by side."""
    sides = ", ".join(f"max(score) filter (pillar = '{p}') as {p}" for p in O.PILLARS)
    return f"""pd as ({data}), pw as (select run_id, pillar, sum({_W}) as w from {findings} group by all),
ps as (select k.run_id, q.pillar, case when pd.pillar is not null then floor(greatest(0::double, least(100::double, 100 * (1 - coalesce(pw.w, 0) / 12))) * 10 + 0.5) / 10 end as score
  from (select run_id from pd union select run_id from {findings}) k cross join (select unnest([{', '.join(f"'{p}'" for p in O.PILLARS)}]) as pillar) q left join pd on pd.run_id = k.run_id and pd.pillar = q.pillar left join pw on pw.run_id = k.run_id and pw.pillar = q.pillar),
ph as (select run_id, {sides} from ps group by run_id)"""


_TOT = " + ".join(f"coalesce({p} * {w}::double, 0)" for p, w in E.PILLAR_WEIGHT.items())
_WS = " + ".join(f"case when {p} is null then 0::double else {w}::double end" for p, w in E.PILLAR_WEIGHT.items())
ORACLES = {
    "health_score": _SITE.replace(ctes("findings"), ctes("findings", "evidence")) + ", " + _health_sql("a", _DATA) + f" select *, floor(({_TOT}) / nullif({_WS}, 0) * 10 + 0.5) / 10 as overall from ph",
    "active_findings": _F + "select run_id, finding_id, rule_id, severity, status from b_findings where status <> 'dismissed'",
    "measured_findings": _F + "select run_id, finding_id, claim_type from b_findings where claim_type like 'measured%'",
    "finding_stat_records": _F + "select finding_id, rule_id, status from b_findings",
    "rec_stat_records": _R + "select r.finding_id, rec_no, rule_id, outcome from b_recs r join b_findings using (finding_id)",
    "rule_dismissal_stats": _F + _DISMISS + " select * from st",
    "rule_ineffective_stats": _R + ", x as (select rule_id, count(*) filter (outcome <> 'unknown') as n, count(*) filter (outcome in ('ineffective', 'regressed')) as hits from b_recs join b_findings using (finding_id) group by all)" + _STATS.format(t=0.6) + " select * from st",
    "new_proposals": ctes("findings", "artifacts", "proposals") + _DISMISS + f", n as (select 'stats' as source, rule_id as target from st where flagged union select 'freshness', artifact_key from ({_FRESH}) where stale) select * from n where (source, target) not in (select source, target from b_proposals where status = 'pending')",
    "finding_delta": _F + _DELTA + " select * from d",
    "finding_delta_summary": _F + _DELTA + " select state, count(*) as n from d group by state",
    "duplicate_fingerprints": _F + "select run_id, fingerprint, count(*) as n from b_findings group by all having count(*) > 1",
    "rec_outcomes": _R + _DELTA + f" select r.finding_id, rec_no, state, case state when 'resolved' then 'effective' when 'regressed' then 'regressed' when 'persistent' then 'ineffective' else 'unknown' end as new_outcome from b_recs r join b_findings f using (finding_id) left join d on d.fingerprint = f.fingerprint where f.run_id = {BASE}",
    "new_hits": _F + f"select finding_id, fingerprint, rule_id from b_findings where run_id = {RETEST} and fingerprint not in (select fingerprint from b_findings where run_id = {BASE})",
    "top_findings": _SITE + f" select run_id, cast(row_number() over (partition by run_id order by {_W} desc, finding_id) as integer) as place, finding_id, severity, pillar from a qualify place <= 3",
    "gated_recs": _R + f"select finding_id, rec_no, status from b_recs where {_G}",
    "priority_matrix": _R + _RR + f" select run_id, {_Q} as quadrant, count(*) as n from rr group by all",
    "roadmap": _R + _RR + f" select run_id, case effort when 'low' then 'quick' when 'high' then 'long' else 'mid' end as horizon, count(*) as n from rr where {_G} group by all",
    "next_steps": _R + _RR + f" select run_id, cast(row_number() over (partition by run_id order by {_QR.format(p='(' + _Q + ')', e=9)}, finding_id, rec_no) as integer) as place, finding_id, rec_no, priority from rr where {_G} qualify place <= 3",
    "action_order": _R + f"select finding_id, rec_no, cast(row_number() over (partition by finding_id order by {_QR.format(p='priority', e=99)}, rec_no) as integer) as place from b_recs",
    "applied_progress": _R + _RR + f" select run_id, count(*) filter ({_G}) as gated, count(*) filter ({_G} and applied) as applied, cast(floor(count(*) filter ({_G} and applied)::double / count(*) filter ({_G}) * 100 + 0.5) as bigint) as percent from rr group by run_id",
    "report_counts": _R + _RR + f" select run_id, findings, dismissed, coalesce(recommendations, 0) as recommendations, coalesce(gated, 0) as gated from (select run_id, count(*) filter (status <> 'dismissed') as findings, count(*) filter (status = 'dismissed') as dismissed from b_findings group by run_id) left join (select run_id, count(*) as recommendations, count(*) filter ({_G}) as gated from rr group by run_id) using (run_id)",
    "constraint_locator": _SITE + " select run_id, case when count(*) filter (pillar = 'P1' and severity = 'high') > 0 then 'systemic_basics' when count(*) filter (pillar = 'P3') = 0 then 'visibility_data_missing' when count(*) filter (pillar = 'P3') >= 3 and count(*) filter (pillar in ('P4', 'P5')) >= 2 then 'authority_content' else 'fine_tuning' end as kind from a group by run_id",
    "pillars_with_data": ctes("findings", "evidence") + _DATA,
    "report_level": ctes("sources") + """, x as (select run_id, bool_or(source_key = 'crawl' and (status = 'collected' or (status = 'partial' and captured > 0))) as crawl, bool_or(source_key = 'gsc' and status = 'collected') as gsc,
 bool_or(source_key = 'dataforseo' and status = 'collected') as market, bool_or(source_key = 'ai_probe' and status = 'collected') as ai, coalesce(string_agg(source_key, ',' order by source_key) filter (status <> 'collected'), '') as gaps from b_sources group by run_id)
select run_id, case when crawl and gsc and market and run_id % 4 > 0 and ai and run_id % 3 > 0 then 'R4' when crawl and gsc and market and run_id % 4 > 0 then 'R3' when crawl and gsc then 'R2' when crawl then 'R1' else 'R0' end as level, gaps from x""",
    "source_health": ctes("sources") + "select run_id, count(*) filter (status = 'collected') as up, count(*) as total from b_sources where source_key <> 'crawl' group by run_id",
    "artifact_freshness": ctes("artifacts") + _FRESH,
    "stale_artifacts": ctes("artifacts") + f"select count(*) filter (stale) as stale, count(*) as total, max(age_days) as oldest_days from ({_FRESH})",
    "claim_gate_violations": ctes("findings", "evidence") + "select finding_id, claim_type, level from b_findings join b_evidence e on e.evidence_id = finding_id + 1 where (claim_type = 'measured_hard' and level <> 'L1') or (claim_type = 'measured_sample' and level not in ('L1', 'L2'))",
    "hits_with_evidence": _F + _REFS + " select run_id, finding_id, cast(len(refs) as integer) as n_refs from refs where len(refs) > 0",
    "finding_levels": ctes("findings", "evidence") + _REFS + " select finding_id, string_agg(distinct level, ',' order by level) as levels from (select finding_id, unnest(refs) as evidence_id from refs) join b_evidence using (evidence_id) group by finding_id",
    "evidence_summaries": ctes("findings", "evidence") + _REFS + " select finding_id, string_agg(coalesce(type || ' ' || level, 'not found'), '; ' order by pos) as summary from (select finding_id, unnest(refs) as evidence_id, unnest(range(len(refs))) as pos from refs) left join b_evidence using (evidence_id) group by finding_id",
    "valid_proposals": ctes("proposals") + "select proposal_id, source, target from b_proposals where trim(evidence) <> ''",
    "proposals_by_status": ctes("proposals") + "select proposal_id, target from b_proposals where status = 'pending'",
    "released_proposals": ctes("proposals") + "select proposal_id, version from b_proposals where version is not null",
    "released_versions": ctes("proposals") + "select distinct version from b_proposals where version is not null",
    "changelog": ctes("proposals") + "select version, n, first_proposal, cast(row_number() over (order by cast(regexp_extract(version, '(\\d+)$', 1) as integer) desc) as integer) as place from (select version, count(*) as n, min(proposal_id) as first_proposal from b_proposals where version is not null group by version)",
    "rules_version_delta": ctes("proposals") + "select 'rules_v' || (max(cast(regexp_extract(version, '(\\d+)$', 1) as integer)) + 1) as next_version from b_proposals where version is not null",
    "share_expired": "select event_id, case event_id % 5 when 0 then false when 1 then true else date_trunc('second', ts) <= timestamp '2024-01-15 00:00:00' end as expired from events",
    "retest_gsc_metric": ctes("gsc", "labs") + "select run_id, cast(sum(impressions) as bigint) as impressions, round(avg(avg_pos), 6) as position from b_gsc where query_id in (select keyword_id from b_labs where intent = 'commercial') group by run_id",
    "findings_pages": _F + "select run_id, cast((place + 49) // 50 as integer) as page, count(*) as rows, cast(to_json(list(struct_pack(finding_id := finding_id, rule_id := rule_id, severity := severity, status := status, claim_type := claim_type) order by finding_id)) as varchar) as body from (select *, row_number() over (partition by run_id order by finding_id) as place from b_findings) group by 1, 2",
    "latest_share": "select user_id as run_id, event_id as share_id from events where event_id % 5 = 0 or (event_id % 5 <> 1 and date_trunc('second', ts) > timestamp '2024-01-15 00:00:00') qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "metric_pairs": ctes("gsc") + ", g as (select query_id, page_id % 3 as run_id, cast(sum(impressions) as bigint) as impressions from b_gsc group by all) select n.query_id, n.run_id, o.impressions as baseline, n.impressions as retest from g n join g o on o.query_id = n.query_id and o.run_id = n.run_id - 1",
    "retest_rows": probe_plans._P + ", " + ctes("findings", "aio").removeprefix("with recursive ").rstrip() + _DELTA + probe_plans._PRES + ", " + _health_sql("(select * from b_findings where status <> 'dismissed')", "select distinct run_id, pillar from b_findings") + f""",
m as (select run_id, 'aio.present_rate' as metric, round(count(*) filter (measured and present)::double / nullif(count(*) filter (measured), 0), 6) as v from b_aio group by run_id
  union all select run_id, 'aio.owned_cited_rate', round(count(*) filter (measured and present and owned)::double / nullif(count(*) filter (measured and present), 0), 6) from b_aio group by run_id
  union all select run_id, 'health.overall', 0.01::double * (floor(({_TOT}) / nullif({_WS}, 0) * 10 + 0.5) / 10) from ph
  union all select run_id, 'probe.unbranded_presence', count_if(present)::double / count(*) from pres where not branded group by run_id),
z as (select coalesce(n.run_id, b.run_id + 1) as run_id, coalesce(n.metric, b.metric) as metric, cast(floor(b.v * 100 + 0.5) as bigint) as baseline, cast(floor(n.v * 100 + 0.5) as bigint) as retest from m n full join m b on n.run_id = b.run_id + 1 and n.metric = b.metric)
select z.run_id, metric, baseline, retest, case when metric like 'probe.%' and not coalesce(c.comparable, true) then null else retest - baseline end as delta from z left join ({probe_plans.ORACLES["comparability"]}) c on c.run_id = z.run_id where baseline is not null or retest is not null
union all select cast({RETEST} as bigint), 'findings.' || state, null, count(*), null from d group by state""",
}
