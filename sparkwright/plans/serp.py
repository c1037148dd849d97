"""Queries over search results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.operators import serp as S
from sparkwright.operators.ranking import ranked
from sparkwright.sources.bindings import COMPETITORS, OWN, Bound, ctes

RIVALS = ", ".join(f"'{d}'" for d in COMPETITORS)
ROUND = "floor(({x}) * {k}::double + 0.5) / {k}::double"
SCORE = """cast(floor(case when search_volume > 0 then least(1.0::double, log10(search_volume::double + 1) / log10(100001::double)) else 0::double end
  * case lower(intent) when 'transactional' then 1.0::double when 'commercial' then 0.9::double when 'informational' then 0.5::double when 'navigational' then 0.3::double else 0.5::double end
  * case when difficulty is null then 0.5::double else (100 - least(100::double, greatest(0::double, difficulty::double))) / 100 end * 100 + 0.5) as bigint)"""
GAPS = f"""best as (select run_id, keyword_id, keyword, domain, min(item_rank) as r from b_serp where domain in ('{OWN}', {RIVALS}) and item_rank > 0 group by all),
per as (select run_id, keyword_id, keyword, min(case when domain = '{OWN}' then r end) as our_position, count(*) filter (domain <> '{OWN}' and r <= 10) as rivals,
  min(case when domain <> '{OWN}' and r <= 10 then r end) as best_rival from best group by all),
gaps as (select p.*, case when our_position <= 10 then 'winning' when our_position is null and rivals >= 2 then 'missing' when our_position > 10 and our_position <= 30 and rivals >= 1 then 'weak' end as gap_type,
  l.search_volume, l.intent, {SCORE} as score from per p left join b_labs l on l.run_id = p.run_id and l.keyword = p.keyword)"""


def gaps_of(b: Bound) -> DataFrame:
    return S.keyword_gaps(b.serp, b.labs, OWN, COMPETITORS)


def competitor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.competitor_candidates(Bound(spark, sf_dir).serp, OWN)


def best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_rank(Bound(spark, sf_dir).serp, [OWN, *COMPETITORS])


def keyword_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps_of(Bound(spark, sf_dir))


def gaps_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric score then volume, nulls last, as a rank column."""
    gaps = gaps_of(Bound(spark, sf_dir)).select("run_id", "keyword_id", "gap_type", F.col("score").cast("double").alias("score"), "search_volume", "keyword")
    return ranked(gaps, ["run_id"], [F.desc_nulls_last("score"), F.desc_nulls_last("search_volume"), F.col("keyword")]).select("run_id", "keyword_id", "gap_type", "place")


def share_of_serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.share_of_serp(Bound(spark, sf_dir).serp, OWN, COMPETITORS)


def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bound(spark, sf_dir).labs.select("keyword_id", S.opportunity(F.col("search_volume"), F.col("intent"), F.col("difficulty")).alias("score"))


def avg_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.avg_position(Bound(spark, sf_dir).gsc)


def gsc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Bound(spark, sf_dir).gsc
    return g.where("query_id is not null").select("run_id", "query_id", "page_id", *[E.finite_or_zero(F.col(c)).alias(c) for c in ("impressions", "clicks", "avg_pos")])


def gsc_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Bound(spark, sf_dir).gsc
    by_query = S.query_totals(g).select("run_id", F.lit("query").alias("dimension"), F.col("query_id").alias("key"), "impressions", "clicks")
    by_page = g.groupBy("run_id", F.col("page_id").alias("key")).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")).withColumn("dimension", F.lit("page"))
    return by_query.unionByName(by_page)


def cannibalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cannibalization(Bound(spark, sf_dir).gsc, 75)


def keyword_metrics_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = S.query_totals(Bound(spark, sf_dir).gsc).select("run_id", "query_id", "clicks", "impressions")
    return ranked(totals, ["run_id"], [F.desc_nulls_last("clicks"), F.desc_nulls_last("impressions"), F.col("query_id")])


def top_keyword_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 queries of each run with most impressions (a top-k report)."""
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy(F.desc("impressions"), "query_id")
    return S.query_totals(Bound(spark, sf_dir).gsc).withColumn("place", F.row_number().over(order)).where("place <= 200").select("run_id", "query_id", "impressions", "place")


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir)
    return S.keyword_table(b.gsc.withColumnRenamed("query_id", "keyword_id"), gaps_of(b))


def keyword_table_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each run in pages of 50; nulls last whichever way a column is sorted."""
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("clicks"), F.asc_nulls_last("avg_pos"), F.col("keyword_id")]
    return ranked(keyword_table(spark, sf_dir).select("run_id", "keyword_id", "score", "clicks", "avg_pos"), ["run_id"], order).select("run_id", "keyword_id", "score", "clicks", "avg_pos", "place", F.ceil(F.col("place") / 50).cast("int").alias("page"))


def seed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir)
    metrics = S.query_totals(b.gsc).select("run_id", F.concat(F.lit(" KW"), F.col("query_id").cast("string")).alias("text"), "impressions")
    prompts = b.labs.select("run_id", F.when(F.col("keyword_id") % 3 == 0, F.col("keyword")).otherwise(F.col("title")).alias("text"), F.col("keyword_id").alias("rank"))
    return S.seed_keywords(metrics, prompts, "red")


def aio_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.aio_exposure(Bound(spark, sf_dir).aio)


def aio_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.aio_exposure(Bound(spark, sf_dir).aio)
    return x.select("run_id", F.round(E.ratio(F.col("present"), F.col("measured")), 6).alias("present_rate"), F.round(E.ratio(F.col("owned"), F.col("present")), 6).alias("owned_rate"))


def competitor_form_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best competitor result of each keyword, each domain once a run by its best keyword, five a run."""
    from pyspark.sql import Window

    best = S.best_rank(Bound(spark, sf_dir).serp, COMPETITORS)
    one = Window.partitionBy("run_id", "keyword_id").orderBy("best_rank", "domain")
    again = Window.partitionBy("run_id", "domain").orderBy("keyword_id")
    cap = Window.partitionBy("run_id").orderBy("keyword_id", "domain")
    x = best.withColumn("a", F.row_number().over(one)).where("a = 1").withColumn("b", F.row_number().over(again)).where("b = 1")
    return x.withColumn("place", F.row_number().over(cap)).where("place <= 5").select("run_id", "place", "keyword_id", "domain", "best_rank")


QUERIES = (
    competitor_candidates, best_rank, keyword_gaps, gaps_ordered, share_of_serp, opportunity_scores, avg_position, gsc_metrics, gsc_by_dimension, cannibalization, keyword_metrics_ordered, top_keyword_metrics,
    keyword_table, keyword_table_sorted, seed_keywords, aio_exposure, aio_rates, competitor_form_targets,
)

_TOTALS = "qt as (select run_id, query_id, sum(impressions) as impressions, sum(clicks) as clicks, avg(avg_pos) as position from b_gsc group by all)"
_TABLE = """m as (select run_id, query_id as keyword_id, arg_min(impressions, page_id) as impressions, arg_min(clicks, page_id) as clicks, arg_min(avg_pos, page_id) as avg_pos from b_gsc group by all),
kt as (select coalesce(m.run_id, g.run_id) as run_id, coalesce(m.keyword_id, g.keyword_id) as keyword_id, impressions, clicks, avg_pos, gap_type, score
  from m full join (select * from gaps where gap_type is not null) g on m.run_id = g.run_id and m.keyword_id = g.keyword_id)"""
ORACLES = {
    "competitor_candidates": ctes("serp") + f""", t as (select run_id, count(distinct keyword_id) as n from b_serp group by all),
a as (select run_id, domain, count(distinct keyword_id) as shared_keywords, sum(1::double / item_rank) as weight from b_serp where domain <> '{OWN}' group by all),
r as (select a.*, shared_keywords::double / n as overlap, row_number() over (partition by run_id order by shared_keywords::double / n desc, round(weight, 6) desc, domain) as place from a join t using (run_id) qualify place <= 10),
k as (select distinct run_id, domain, keyword_id from b_serp semi join r using (run_id, domain)),
f as (select run_id, domain, string_agg(keyword_id::varchar, ',' order by keyword_id) as top_keywords from (select *, row_number() over (partition by run_id, domain order by keyword_id) as i from k) where i <= 5 group by all)
select run_id, cast(place as integer) as place, domain, shared_keywords, round(overlap, 6) as overlap, round(weight, 4) as weight, top_keywords from r join f using (run_id, domain)""",
    "best_rank": ctes("serp") + f"select run_id, keyword_id, domain, min(item_rank) as best_rank from b_serp where domain in ('{OWN}', {RIVALS}) group by all",
    "keyword_gaps": ctes("serp", "labs") + f", {GAPS} select run_id, keyword_id, keyword, gap_type, our_position, rivals, best_rival, search_volume, intent, score from gaps where gap_type is not null",
    "gaps_ordered": ctes("serp", "labs") + f", {GAPS} select run_id, keyword_id, gap_type, cast(row_number() over (partition by run_id order by score desc nulls last, search_volume desc nulls last, keyword) as integer) as place from gaps where gap_type is not null",
    "share_of_serp": ctes("serp") + f"select r.run_id, d.domain, count(s.domain) as items, d.domain = '{OWN}' as own from (select distinct run_id from b_serp) r cross join (select unnest(['{OWN}', {RIVALS}]) as domain) d left join b_serp s on s.run_id = r.run_id and s.domain = d.domain and s.item_rank between 1 and 10 group by all",
    "opportunity_scores": ctes("labs") + f"select keyword_id, {SCORE} as score from b_labs",
    "avg_position": ctes("gsc") + f"select run_id, case when sum(impressions) > 0 then {ROUND.format(x='sum(avg_pos * impressions) / sum(impressions)', k=10)} end as avg_position, cast(sum(impressions) as bigint) as impressions from b_gsc group by run_id",
    "gsc_metrics": ctes("gsc") + "select run_id, query_id, page_id, impressions::double as impressions, clicks::double as clicks, avg_pos from b_gsc",
    "gsc_by_dimension": ctes("gsc") + "select run_id, 'query' as dimension, query_id as key, cast(sum(impressions) as bigint) as impressions, cast(sum(clicks) as bigint) as clicks from b_gsc group by all union all select run_id, 'page', page_id, cast(sum(impressions) as bigint), cast(sum(clicks) as bigint) from b_gsc group by all",
    "cannibalization": ctes("gsc") + "select * from (select *, cast(row_number() over (partition by run_id order by impressions desc, query_id) as integer) as place from (select run_id, query_id, count(distinct page_id) as pages, cast(sum(impressions) as bigint) as impressions from b_gsc where impressions >= 75 group by all having count(distinct page_id) >= 2)) where place <= 20",
    "keyword_metrics_ordered": ctes("gsc") + f", {_TOTALS} select run_id, query_id, cast(clicks as bigint) as clicks, cast(impressions as bigint) as impressions, cast(row_number() over (partition by run_id order by clicks desc nulls last, impressions desc nulls last, query_id) as integer) as place from qt",
    "top_keyword_metrics": ctes("gsc") + f", {_TOTALS} select * from (select run_id, query_id, cast(impressions as bigint) as impressions, cast(row_number() over (partition by run_id order by impressions desc, query_id) as integer) as place from qt) where place <= 200",
    "keyword_table": ctes("serp", "labs", "gsc") + f", {GAPS}, {_TABLE} select * from kt",
    "keyword_table_sorted": ctes("serp", "labs", "gsc") + f", {GAPS}, {_TABLE} select *, cast((place + 49) // 50 as integer) as page from (select run_id, keyword_id, score, clicks, avg_pos, cast(row_number() over (partition by run_id order by score desc nulls last, clicks desc nulls last, avg_pos asc nulls last, keyword_id) as integer) as place from kt)",
    "seed_keywords": ctes("gsc", "labs") + f""", {_TOTALS}, u as (select run_id, ' KW' || query_id as text, 0 as source, -impressions as rank from qt union all select run_id, case when keyword_id % 3 = 0 then keyword else title end, 1, keyword_id from b_labs),
k as (select *, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) as key from u), w as (select *, row_number() over (partition by run_id, key order by source, rank, text) as i from k where key <> '' and not contains(key, 'red')),
p as (select *, row_number() over (partition by run_id order by source, rank, text) as place from w where i = 1) select run_id, cast(place as integer) as place, text, source from p where place <= 100""",
    "aio_exposure": ctes("aio") + "select run_id, count(*) as total, count(*) filter (measured) as measured, count(*) filter (measured and present) as present, count(*) filter (measured and present and owned) as owned, count(distinct cited_domain) filter (measured and present) as domains from b_aio group by run_id",
    "aio_rates": ctes("aio") + "select run_id, round(count(*) filter (measured and present)::double / nullif(count(*) filter (measured), 0), 6) as present_rate, round(count(*) filter (measured and present and owned)::double / nullif(count(*) filter (measured and present), 0), 6) as owned_rate from b_aio group by run_id",
    "competitor_form_targets": ctes("serp") + f""", b as (select run_id, keyword_id, domain, min(item_rank) as best_rank from b_serp where domain in ({RIVALS}) group by all),
o as (select * from b qualify row_number() over (partition by run_id, keyword_id order by best_rank, domain) = 1), d as (select * from o qualify row_number() over (partition by run_id, domain order by keyword_id) = 1)
select run_id, cast(row_number() over (partition by run_id order by keyword_id, domain) as integer) as place, keyword_id, domain, best_rank from d qualify place <= 5""",
}
