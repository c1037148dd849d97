"""Queries over projects, runs and the evidence log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.operators import lifecycle as Y
from sparkwright.operators import log as L
from sparkwright.sources.bindings import Bound, ctes

ACTIVE = ("collecting", "pending", "diagnosing")


def pk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by its key: the filter reaches the scan."""
    return Bound(spark, sf_dir).findings.where("finding_id = 17").select("finding_id", "run_id", "severity", "status")


def run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).evidence.where("run_id = 5").select("evidence_id", "type", "level")


def project_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).runs.where("project_id = 7").select("run_id", "type", "status")


def confirmed_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project and status together."""
    return Bound(spark, sf_dir).findings.where("project_id = 3 and status = 'converted'").select("finding_id", "project_id", "status")


def prompts_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prompts of each run by priority."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("prompt_id"))
    return Bound(spark, sf_dir).prompts.select("run_id", "prompt_id", place.alias("place"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_run(Bound(spark, sf_dir).runs)


def active_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_run(Bound(spark, sf_dir).runs.where(F.col("status").isin(*ACTIVE))).select("project_id", "run_id", "started_at")


def retest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest completed baseline of each project."""
    return L.latest_run(Bound(spark, sf_dir).runs.where("type = 'baseline' and status = 'completed'")).select("project_id", "run_id", "started_at")


def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project with its newest run and its number of runs, in one pass over the runs."""
    b = Bound(spark, sf_dir)
    order = F.struct(F.col("started_at").isNotNull().alias("has"), "started_at", (-F.col("run_id")).alias("early"))
    per = b.runs.groupBy("project_id").agg(F.count("*").alias("runs"), F.max_by("run_id", order).alias("latest_run"), F.max_by("status", order).alias("latest_status"))
    return b.projects.select("project_id", "domain").join(per, "project_id", "left").na.fill(0, ["runs"])


def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Bound(spark, sf_dir).projects
    return p.where(F.lower("name").contains("12") | F.lower("domain").contains("c77")).select("project_id", "name", "domain")


def latest_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest evidence of each type of a run."""
    return L.newest(Bound(spark, sf_dir).evidence, ["run_id", "type"], [F.desc("captured_at"), F.desc("evidence_id")]).select("run_id", "type", "evidence_id")


def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(Bound(spark, sf_dir).evidence, ["run_id", "type"], [F.asc("captured_at"), F.asc("evidence_id")]).select("run_id", "type", "evidence_id", "level")


def entry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view without a page of its own."""
    e = Bound(spark, sf_dir).evidence.where("type = 'view' and not has_page")
    return L.newest(e, ["run_id"], [F.asc("captured_at"), F.asc("evidence_id")]).select("run_id", "evidence_id")


def recent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(Bound(spark, sf_dir).evidence, ["run_id"], [F.desc("captured_at"), F.desc("evidence_id")], 6).select("run_id", "place", "evidence_id")


def dedup_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.deduplicate(Bound(spark, sf_dir).evidence)


def stageline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.progress_state(Bound(spark, sf_dir).progress)


def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).evidence.groupBy("run_id", "type").agg(F.count("*").alias("n"))


def run_status_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's status from its ordered messages: the first terminal one decides, later ones change nothing."""
    state = F.col("state")
    status = F.when(state == "failed", "failed").when(state == "done", "completed").otherwise("collecting")
    return L.progress_state(Bound(spark, sf_dir).progress).select("run_id", status.alias("status"), status.isin(*ACTIVE).alias("active"))


def guarded_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs after a batch of status changes: what was cancelled stays cancelled, unless it is retried."""
    runs = Bound(spark, sf_dir).runs.select("run_id", F.when(F.col("run_id") % 5 == 0, "cancelled").otherwise(F.col("status")).alias("status"))
    changes = Bound(spark, sf_dir).progress.select("run_id", E.lookup(F.col("msg_type"), {"done": "completed", "failed": "failed"}, "collecting").alias("status"), "ts", "seq")
    return L.change_status(runs, changes.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), (F.col("run_id") % 10 == 0).alias("bypass")))


def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's status after its whole log, from a draft on: steps, cancellations, retries and decisions."""
    b = Bound(spark, sf_dir)
    runs = b.progress.select("run_id").distinct().select("run_id", F.lit("draft").alias("status"))
    return Y.replay(runs, b.run_events).select("run_id", "status", "events", "active", "completed")


def template_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored templates take a new representative only where the stored one was chosen by the heuristic; new ones are added."""
    b = Bound(spark, sf_dir)
    pages = b.pages.select("page_id", (F.col("page_id") % 60).alias("template_id"))
    stored = pages.where("page_id % 3 = 0").groupBy("template_id").agg(F.min("page_id").alias("representative"), F.min(F.when(F.col("template_id") % 4 == 0, "manual").otherwise("heuristic")).alias("source"), F.count("*").alias("pages"))
    return L.upsert_templates(stored, pages.groupBy("template_id").agg(F.max("page_id").alias("representative"), F.lit("heuristic").alias("source"), F.count("*").alias("pages")), ["template_id"])


def live_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an append-only log of facts that no later tombstone removes."""
    e = Bound(spark, sf_dir).evidence.select("evidence_key", "run_id", "captured_at", "evidence_id", (F.col("type") == "refund").alias("deleted"))
    return L.without_deleted(e, ["run_id", "evidence_key"], F.struct("captured_at", "evidence_id"))


def probe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples split into valid ones and errors; errors leave evidence but no result."""
    e = Bound(spark, sf_dir).evidence
    bad = F.try_variant_get(F.try_parse_json("payload"), "$.k", "int") % 10 == 0
    return e.groupBy("run_id").agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("errors"), F.count_if(~F.coalesce(bad, F.lit(True))).alias("results"))


def dataforseo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads narrowed to typed columns; what isn't there or of another type is null."""
    v = F.try_parse_json("payload")
    e = Bound(spark, sf_dir).evidence
    return e.select("evidence_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


def stat_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of five cards of a run is measured or pending."""
    e = Bound(spark, sf_dir).evidence
    kinds = ("view", "click", "signup", "purchase", "refund")
    x = e.groupBy("run_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("card"), F.when(F.col(k) > 0, "measured").otherwise("pending").alias("state"), F.col(k).alias("n")) for k in kinds]))
    return x.select("run_id", rows.alias("r")).select("run_id", "r.*")


def alias_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, distinct, non-empty aliases in first order."""
    p = Bound(spark, sf_dir).projects
    names = F.filter(F.array_distinct(F.transform(F.split(F.concat_ws(",", "name", F.lit(" "), "market", "name"), ","), lambda x: F.trim(x))), lambda x: x != "")
    return p.select("project_id", F.array_join(names, "|").alias("aliases"))


def brand_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Bound(spark, sf_dir).projects
    short = F.when(F.col("project_id") % 3 == 0, F.concat(F.lit("shop"), F.col("project_id").cast("string"), F.lit(".co.uk"))).otherwise(F.col("domain"))
    return p.select("project_id", E.brand_of_domain(short).alias("brand"))


def input_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as users type them: with and without scheme, path, capitals, and some that aren't addresses."""
    host = F.upper("domain")
    k = F.col("project_id") % 6
    raw = F.when(k == 0, F.col("domain")).when(k == 1, F.concat(F.lit("HTTP://"), host)).when(k == 2, F.concat(F.col("domain"), F.lit("/a?b=1"))).when(k == 3, F.concat(F.lit("https://"), F.col("domain"), F.lit(":8080/x#y"))).when(k == 4, F.lit("localhost"))
    return Bound(spark, sf_dir).projects.select("project_id", E.input_url(raw).alias("entry"))


def market_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market to location by a small table: a default where it is unknown, and the strict answer beside it."""
    p = Bound(spark, sf_dir).projects
    codes = {"BUILDING": 2840, "MACHINERY": 2276, "FURNITURE": 2250}
    strict = E.lookup(F.col("market"), codes)
    return p.select("project_id", F.coalesce(strict, F.lit(2840)).alias("location"), strict.alias("strict_location"))


def page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of runs updated from a later batch, except that a cancelled (failed) run stays as it is."""
    r = Bound(spark, sf_dir).runs.select("run_id", "type", "status")
    batch = r.where("run_id % 2 = 0 and status <> 'failed'").select("run_id", F.lit("retest").alias("type"), F.lit("completed").alias("status"))
    return L.upsert(r, batch, ["run_id"], keep=("type",))


QUERIES = (
    pk_lookup, run_scan, project_scan, confirmed_competitors, prompts_ordered, latest_run, active_run, retest_anchor, project_summary, project_search, latest_prompts, first_evidence, entry_page, recent_evidence,
    dedup_evidence, stageline_state, progress_counts, run_status_derived, guarded_status, run_lifecycle, template_upsert, live_facts, probe_errors, dataforseo_context, stat_cards, alias_normalize, brand_of_domain, input_urls, market_location, page_upsert,
)

_RUNS, _EV = ctes("runs"), ctes("evidence")
_NEW = "row_number() over (partition by project_id order by started_at desc nulls last, run_id)"
ORACLES = {
    "pk_lookup": ctes("findings") + "select finding_id, run_id, severity, status from b_findings where finding_id = 17",
    "run_scan": _EV + "select evidence_id, type, level from b_evidence where run_id = 5",
    "project_scan": _RUNS + "select run_id, type, status from b_runs where project_id = 7",
    "confirmed_competitors": ctes("findings") + "select finding_id, project_id, status from b_findings where project_id = 3 and status = 'converted'",
    "prompts_ordered": ctes("prompts") + "select run_id, prompt_id, cast(row_number() over (partition by run_id order by prompt_id) as integer) as place from b_prompts",
    "latest_run": _RUNS + f"select * from b_runs qualify {_NEW} = 1",
    "active_run": _RUNS + f"select project_id, run_id, started_at from b_runs where status = 'collecting' qualify {_NEW} = 1",
    "retest_anchor": _RUNS + f"select project_id, run_id, started_at from b_runs where type = 'baseline' and status = 'completed' qualify {_NEW} = 1",
    "project_summary": ctes("projects", "runs") + f", l as (select project_id, run_id as latest_run, status as latest_status from b_runs qualify {_NEW} = 1), n as (select project_id, count(*) as runs from b_runs group by all) select project_id, domain, coalesce(runs, 0) as runs, latest_run, latest_status from b_projects left join n using (project_id) left join l using (project_id)",
    "project_search": ctes("projects") + "select project_id, name, domain from b_projects where lower(name) like '%12%' or lower(domain) like '%c77%'",
    "latest_prompts": _EV + "select run_id, type, evidence_id from b_evidence qualify row_number() over (partition by run_id, type order by captured_at desc, evidence_id desc) = 1",
    "first_evidence": _EV + "select run_id, type, evidence_id, level from b_evidence qualify row_number() over (partition by run_id, type order by captured_at, evidence_id) = 1",
    "entry_page": _EV + "select run_id, evidence_id from b_evidence where type = 'view' and not has_page qualify row_number() over (partition by run_id order by captured_at, evidence_id) = 1",
    "recent_evidence": _EV + "select run_id, cast(row_number() over (partition by run_id order by captured_at desc, evidence_id desc) as integer) as place, evidence_id from b_evidence qualify place <= 6",
    "dedup_evidence": _EV + "select run_id, evidence_key, arg_min(evidence_id, (captured_at, evidence_id)) as evidence_id, count(*) as copies from b_evidence group by all",
    "stageline_state": ctes("progress") + """, t as (select run_id, min((ts, seq)) as e, arg_min(msg_type, (ts, seq)) as terminal from b_progress where msg_type in ('done', 'failed') group by run_id),
x as (select p.*, terminal from b_progress p left join t using (run_id) where e is null or (ts, seq) <= e)
select run_id, coalesce(any_value(terminal), 'running') as state, count(*) as messages, count(*) filter (msg_type = 'evidence_created') as evidence, count(*) filter (msg_type = 'phase') as phases, arg_max(amount, (ts, seq)) filter (msg_type = 'progress') as last_progress from x group by run_id""",
    "progress_counts": _EV + "select run_id, type, count(*) as n from b_evidence group by all",
    "run_status_derived": ctes("progress") + ", m as (select run_id, arg_min(msg_type, (ts, seq)) filter (msg_type in ('failed', 'done')) as t from b_progress group by run_id) select run_id, case t when 'failed' then 'failed' when 'done' then 'completed' else 'collecting' end as status, t is null as active from m",
    "guarded_status": ctes("runs", "progress") + ", r as (select run_id, case when run_id % 5 = 0 then 'cancelled' else status end as status from b_runs), l as (select *, row_number() over (partition by run_id order by ts desc, seq desc) as i from b_progress) select r.run_id, case when l.msg_type is null or (r.status = 'cancelled' and r.run_id % 10 <> 0) then r.status when l.msg_type = 'done' then 'completed' when l.msg_type = 'failed' then 'failed' else 'collecting' end as status from r left join l on l.run_id = r.run_id and l.i = 1",
    "template_upsert": "select page_id % 60 as template_id, case when count(*) filter (page_id % 3 = 0) > 0 and (page_id % 60) % 4 = 0 then min(page_id) filter (page_id % 3 = 0) else max(page_id) end as representative, case when count(*) filter (page_id % 3 = 0) > 0 and (page_id % 60) % 4 = 0 then 'manual' else 'heuristic' end as source, count(*) as pages from pages group by 1",
    "run_lifecycle": ctes("run_events") + """, f as (select run_id, count(*) as events, list_reduce(list_prepend('draft', list(event order by ts, seq)), lambda s, e: case
  when e = 'cancel' then case when s in ('collecting', 'diagnosing') then 'cancelled' else s end when e = 'retry' then case when s in ('failed', 'cancelled') then 'collecting' else s end
  when e = 'decided' then case when s = 'reviewing' then 'output' else s end when e = 'undecided' then case when s = 'output' then 'reviewing' else s end when s = 'cancelled' then s else e end) as status from b_run_events group by run_id)
select run_id, status, events, status in ('draft', 'collecting', 'collected', 'diagnosing') as active, status in ('reviewing', 'output') as completed from f""",
    "live_facts": _EV + ", x as (select *, row_number() over (partition by run_id, evidence_key order by captured_at desc, evidence_id desc) as i from b_evidence) select evidence_key, run_id, captured_at, evidence_id from x where i = 1 and type <> 'refund'",
    "probe_errors": _EV + "select run_id, count(*) filter (coalesce(cast(json_extract(payload, '$.k') as integer) % 10 = 0, true)) as errors, count(*) filter (not coalesce(cast(json_extract(payload, '$.k') as integer) % 10 = 0, true)) as results from b_evidence group by run_id",
    "dataforseo_context": _EV + "select evidence_id, cast(json_extract(payload, '$.k') as bigint) as k, json_extract_string(payload, '$.missing') as missing from b_evidence",
    "stat_cards": _EV + ", k as (select unnest(['view', 'click', 'signup', 'purchase', 'refund']) as card) select r.run_id, k.card, case when count(e.type) > 0 then 'measured' else 'pending' end as state, count(e.type) as n from (select distinct run_id from b_evidence) r cross join k left join b_evidence e on e.run_id = r.run_id and e.type = k.card group by all",
    "alias_normalize": ctes("projects") + "select project_id, trim(name) || '|' || trim(market) as aliases from b_projects",
    "brand_of_domain": ctes("projects") + "select project_id, case when project_id % 3 = 0 then 'shop' || project_id else 'example' end as brand from b_projects",
    "input_urls": ctes("projects") + "select project_id, case project_id % 6 when 0 then 'https://' || domain || '/' when 1 then 'http://' || lower(domain) || '/' when 2 then 'https://' || domain || '/a?b=1' when 3 then 'https://' || domain || ':8080/x#y' end as entry from b_projects",
    "market_location": ctes("projects") + ", l as (select project_id, case market when 'BUILDING' then 2840 when 'MACHINERY' then 2276 when 'FURNITURE' then 2250 end as s from b_projects) select project_id, coalesce(s, 2840) as location, s as strict_location from l",
    "page_upsert": _RUNS + "select run_id, type, case when run_id % 2 = 0 and status <> 'failed' then 'completed' else status end as status from b_runs",
}
