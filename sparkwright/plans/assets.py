"""Queries over prompts, anchors, page classes, budgets and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions.html import page_features
from sparkwright.operators import assets as A
from sparkwright.operators import serp as S
from sparkwright.plans import findings as findings_plans
from sparkwright.sources.bindings import COMPETITORS, Bound, ctes

PLATFORMS = ("s3.example", "s7.example", "s11.example")


def prompt_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.render_prompts(_briefs(spark, sf_dir))


def prompt_set_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.render_prompts(_briefs(spark, sf_dir), A.PROMPTS_ZH, "zh")


def prompt_set_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier set of twenty, in both languages."""
    p = _briefs(spark, sf_dir)
    en, zh = (A.render_prompts(p, tuple((x[0], x[i]) for x in A.EARLIER), lang).withColumn("language", F.lit(lang)) for i, lang in ((1, "en"), (2, "zh")))
    return en.unionByName(zh)


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Bound(spark, sf_dir).projects
    rival = F.when(F.col("project_id") % 4 > 0, F.concat(F.lit("R"), (F.col("project_id") % 4).cast("string")))
    return p.select("project_id", F.concat(F.lit("B"), F.col("project_id").cast("string")).alias("brand"), F.lower("market").alias("category"), rival.alias("rival"), F.col("owner_id").cast("string").alias("market"))


def anchor_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    anchor = F.when(F.col("p_partkey") % 6 == 0, "Click here").when(F.col("p_partkey") % 6 == 1, "https://a.b/c").when(F.col("p_partkey") % 6 == 2, "shop.example.com").when(F.col("p_partkey") % 6 == 3, F.concat(F.lit("buy "), F.col("p_brand"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", A.anchor_class(anchor, F.col("p_brand")).alias("kind"))


def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.element_at(F.array(*map(F.lit, ("shop", "Blog", "category", "about"))), (F.col("page_id") % 4 + 1).cast("int")), F.lit("/x"))
    return Bound(spark, sf_dir).pages.select("page_id", A.page_class(path).alias("kind"))


def competitor_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page types of what ranks, by run."""
    p = Bound(spark, sf_dir).pages
    kind = A.page_type((F.col("page_id") % 10) / 10, F.col("list_count"), F.col("initial_chars"))
    return p.groupBy("run_id", kind.alias("page_type")).agg(F.count("*").alias("pages"), F.round(F.avg("initial_chars"), 4).alias("mean_chars"))


def competitor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed domains and those among the first three results, each once a run."""
    serp = Bound(spark, sf_dir).serp
    runs = serp.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, COMPETITORS))).alias("domain"))
    return runs.union(serp.where("item_rank <= 3").select("run_id", "domain")).distinct()


def platform_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of platforms taken out by an anti-join; the subdomains of a platform go too."""
    serp = Bound(spark, sf_dir).serp
    dim = S.domain_dim(serp, PLATFORMS).withColumnRenamed("domain", "platform")
    hosts = serp.select("domain").distinct().withColumn("platform", F.explode(E.suffixes(F.col("domain"))))
    return serp.join(hosts.join(F.broadcast(dim), "platform").select("domain"), "domain", "left_anti").groupBy("run_id").agg(F.count("*").alias("items"), F.countDistinct("domain").alias("domains"))


def ecommerce_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with product paths, and whether they have a policy page; a URL that can't be parsed belongs to no host."""
    x = Bound(spark, sf_dir).pages.select(E.host(F.col("url")).alias("host"), F.col("url").rlike("/en/[0-9]").alias("product"), F.col("url").rlike("/en/1").alias("policy")).where("host is not null")
    return x.groupBy("host").agg(F.count_if("product").alias("products"), F.count_if("policy").alias("policies")).where("products > 0")


def psi_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five audits of each run that save most."""
    per = Bound(spark, sf_dir).lab_audits.groupBy("run_id", "title").agg(F.max("savings_ms").alias("ms"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ms"), "title"))).where("place <= 5")


def vitals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).vitals.select("run_id", *A.vitals(F.col("lcp_ms"), F.col("inp_ms"), F.col("cls"), F.col("ttfb_ms")))


def run_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and time of probing each project's prompts with its number of engines."""
    p = Bound(spark, sf_dir).projects
    calls = (30 * (F.col("project_id") % 4 + 1) * 5).cast("double")
    return p.select("project_id", calls.alias("calls"), *A.estimate(calls))


def validation_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Bound(spark, sf_dir).findings
    return f.select("finding_id", *A.validation(F.col("pillar")), F.lit(A.WINDOW_DAYS).alias("window_days"))


def retest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied recommendations whose window of 28 days has passed on a date."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    due = F.date_add(F.to_date("l_shipdate"), A.WINDOW_DAYS)
    return li.where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", F.date_format(due, "yyyy-MM-dd").alias("due"), (due <= F.to_date(F.lit("1997-01-01"))).alias("is_due"))


def artifact_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Bound(spark, sf_dir).proposals
    version = F.when(F.col("proposal_id") % 5 == 0, None).when(F.col("proposal_id") % 5 == 1, F.lit("draft")).otherwise(F.concat(F.lit("v"), (F.col("proposal_id") % 40).cast("string")))
    return p.select("proposal_id", A.bump_version(version).alias("next_version"))


def cited_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that cite a recommendation they may not."""
    r = Bound(spark, sf_dir).recs
    text = F.concat(F.lit("see rec_"), F.col("finding_id").cast("string"), F.lit(" and rec_x"), F.col("rec_no").cast("string"))
    allowed = F.array(F.concat(F.lit("rec_"), F.col("finding_id").cast("string")), F.lit("rec_x2"))
    return r.select("finding_id", "rec_no", F.array_join(A.unknown_references(text, allowed), ",").alias("unknown")).where("unknown <> ''")


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the vocabulary of a type asks for and a page's markup lacks, with the number of pages."""
    x = page_features(Bound(spark, sf_dir).site_pages, carry=("run_id",)).select("run_id", "page_id", F.explode("ld_missing").alias("missing"))
    named = x.select("run_id", "page_id", F.substring_index("missing", ".", 1).alias("type"), F.substring_index("missing", ".", -1).alias("field"))
    return named.groupBy("run_id", "type", "field").agg(F.count_distinct("page_id").alias("pages"))


def reparse_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their project; answers of unknown projects are left out."""
    b = Bound(spark, sf_dir)
    return b.answers.select("evidence_id", F.col("evidence_id").alias("project_id")).join(b.projects.select("project_id", "market"), "project_id")


def retest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of a retest as text, with a sign and a dash where there is nothing to compare."""
    x = findings_plans.retest_rows(spark, sf_dir)
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    signed = F.when(F.col("delta") > 0, F.concat(F.lit("+"), F.col("delta").cast("string"))).otherwise(dash("delta"))
    return x.select("run_id", "metric", dash("baseline").alias("baseline"), dash("retest").alias("retest"), signed.alias("delta"))


QUERIES = (
    prompt_set, prompt_set_zh, prompt_set_earlier, anchor_classes, page_classes, competitor_form, competitor_pool, platform_filter, ecommerce_detect, psi_clues, vitals_check, run_estimate, validation_specs, retest_due, artifact_patch,
    cited_recommendations, required_fields, reparse_context, retest_snapshots,
)

def _prompt_sql(prompts, language: str, more: str = "") -> str:
    values = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(prompts))
    return ctes("projects") + f""", t(priority, kind, template) as (values {values}) select project_id, priority, kind,
 replace(replace(replace(replace(template, '{{brand}}', 'B' || project_id), '{{category}}', lower(market)), '{{rival}}', case when project_id % 4 > 0 then 'R' || (project_id % 4) else '{A.OTHERS[language]}' end), '{{market}}', owner_id::varchar) as text, contains(template, '{{brand}}') as branded{more} from b_projects cross join t"""


_SPEC = ", ".join("case pillar " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in A.VALIDATION.items()) + f" end as {name}" for i, name in enumerate(("metric_source", "metric", "direction")))
_ANCHOR = "case p_partkey % 6 when 0 then 'generic' when 1 then 'url' when 2 then 'domain' when 3 then 'brand' else 'keyword' end"
ORACLES = {
    "prompt_set": _prompt_sql(A.PROMPTS, "en"),
    "prompt_set_zh": _prompt_sql(A.PROMPTS_ZH, "zh"),
    "prompt_set_earlier": " union all ".join(f"select * from ({_prompt_sql([(x[0], x[i]) for x in A.EARLIER], lang, f", '{lang}' as language")})" for i, lang in ((1, "en"), (2, "zh"))),
    "anchor_classes": f"select p_partkey, {_ANCHOR} as kind from part",
    "page_classes": "select page_id, ['product', 'article', 'category', 'other'][page_id % 4 + 1] as kind from pages",
    "competitor_form": ctes("pages") + "select run_id, case when page_id % 10 >= 3 then 'faq' when list_count >= 5 then 'listicle' when initial_chars >= 2500 then 'article' else 'page' end as page_type, count(*) as pages, round(avg(initial_chars), 4) as mean_chars from b_pages group by all",
    "competitor_pool": ctes("serp") + f"select distinct run_id, domain from (select run_id, unnest({list(COMPETITORS)}) as domain from b_serp union all select run_id, domain from b_serp where item_rank <= 3)",
    "platform_filter": ctes("serp") + f"select run_id, count(*) as items, count(distinct domain) as domains from b_serp where domain not in {PLATFORMS} group by run_id",
    "ecommerce_detect": "select * from (select regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') as host, count_if(regexp_matches(url, '/en/[0-9]')) as products, count_if(regexp_matches(url, '/en/1')) as policies from pages group by 1) where products > 0",
    "psi_clues": ctes("lab_audits") + "select run_id, title, ms, cast(row_number() over (partition by run_id order by ms desc, title) as integer) as place from (select run_id, title, max(savings_ms) as ms from b_lab_audits group by all) qualify place <= 5",
    "vitals_check": ctes("vitals") + "select run_id, lcp_ms <= 2500 as lcp_ok, inp_ms <= 200 as inp_ok, cls <= 0.1::double as cls_ok, ttfb_ms > 800 as ttfb_slow from b_vitals",
    "run_estimate": ctes("projects") + ", c as (select project_id, (150 * (project_id % 4 + 1))::double as calls from b_projects) select *, floor(calls * 0.002::double * 100 + 0.5) / 100 as cost_low, floor(calls * 0.02::double * 100 + 0.5) / 100 as cost_high, cast(ceil(calls / 120 + 2) as bigint) as minutes_low, cast(ceil(calls / 40 + 2) as bigint) as minutes_high from c",
    "validation_specs": ctes("findings") + f"select finding_id, {_SPEC}, 28 as window_days from b_findings",
    "retest_due": "select l_orderkey, l_linenumber, strftime(l_shipdate::date + interval 28 day, '%Y-%m-%d') as due, l_shipdate::date + interval 28 day <= date '1997-01-01' as is_due from lineitem where l_linestatus = 'F'",
    "artifact_patch": ctes("proposals") + "select proposal_id, case when proposal_id % 5 < 2 then 'v2' else 'v' || (proposal_id % 40 + 1) end as next_version from b_proposals",
    "cited_recommendations": ctes("recs") + "select finding_id, rec_no, 'rec_x' || rec_no as unknown from b_recs where rec_no <> 2",
    "required_fields": """with x as (select page_id % 5 as run_id, unnest(case when page_id % 6 = 3 then ['Product.image'] else ['Article.headline', 'Article.datePublished'] end) as missing from pages where page_id % 14 <> 0 and page_id % 6 >= 3 and page_id % 4 = 0)
select run_id, split_part(missing, '.', 1) as type, split_part(missing, '.', 2) as field, count(*) as pages from x group by all""",
    "reparse_context": ctes("answers", "projects") + "select evidence_id, project_id, market from (select evidence_id, evidence_id as project_id from b_answers) join b_projects using (project_id)",
    "retest_snapshots": "select run_id, metric, coalesce(baseline::varchar, '-') as baseline, coalesce(retest::varchar, '-') as retest, case when delta > 0 then '+' || delta else coalesce(delta::varchar, '-') end as delta from (" + findings_plans.ORACLES["retest_rows"] + ")",
}
