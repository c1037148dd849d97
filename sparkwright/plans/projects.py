"""Queries over many projects at once, each with its own names and domains, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import serp as S
from sparkwright.operators import terms as T
from sparkwright.plans.probes import LEX, _hit
from sparkwright.plans.serp import SCORE
from sparkwright.sources.bindings import Bound, ctes

FOUND = ("brand_present", "sentiment", "hedged", "unknown_admission")


def _parsed(b: Bound) -> DataFrame:
    return T.parse(b.project_answers, _terms(b), LEX)


def _terms(b: Bound) -> DataFrame:
    """Read from the texts once for all that ask."""
    return b.once("project_terms", lambda: b.project_terms)


def project_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer says of its own project."""
    return _parsed(Bound(spark, sf_dir)).select("project_id", "evidence_id", *FOUND, F.array_join("competitors", "|").alias("competitors"))


def project_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("positive", "negative", "comparison", "neutral")
    return _parsed(Bound(spark, sf_dir)).groupBy("project_id").agg(F.count("*").alias("samples"), F.count_if("brand_present").alias("present"), *(F.count_if(F.col("brand_present") & (F.col("sentiment") == k)).alias(k) for k in kinds))


def project_sov(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir, sharing=True)
    return T.share_of_voice(_parsed(b), _terms(b))


def project_sov_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir, sharing=True)
    return T.share_of_voice(_parsed(b), _terms(b), ("project_id", "provider"))


def project_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword gaps of each run against its own confirmed competitors."""
    b = Bound(spark, sf_dir)
    return S.keyword_gaps_of(b.serp, b.labs, b.sites.where("own or confirmed"))


def project_share_of_serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bound(spark, sf_dir)
    return S.share_of_serp_of(b.serp, b.sites.where("own or confirmed"))


QUERIES = (project_parse, project_sentiment, project_sov, project_sov_by_engine, project_gaps, project_share_of_serp)

_SENTENCES = "list_filter(list_transform(regexp_split_to_array(answer_text, '[.!?。！？；;\n]+'), lambda s: regexp_replace(s, '^[\\s\\x{A0}\\x{3000}]+|[\\s\\x{A0}\\x{3000}]+$', '', 'g')), lambda s: s <> '')"
_NAMES = "regexp_matches({s}, '(?i)\\b' || t.term || '\\b')"
_FEELS = "case when regexp_full_match(t.term, '[A-Za-z]+') then " + _NAMES + " else contains(lower({s}), lower(t.term)) end"
_P = (
    ctes("project_answers", "project_terms")
    + f""", a as (select *, {_SENTENCES} as sents from b_project_answers), t as (select * from b_project_terms where term <> ''),
h as (select a.evidence_id, t.kind, t.place, t.term from a join t using (project_id) where case when t.kind = 'domain' then contains(lower(answer_text), regexp_replace(lower(t.term), '^www\\.', '')) else {_NAMES.format(s='answer_text')} end),
n as (select evidence_id, bool_or(kind <> 'competitor') as here, coalesce(string_agg(term, '|' order by place) filter (kind = 'competitor'), '') as rivals from h group by evidence_id),
s as (select project_id, evidence_id, unnest(sents) as s from a),
m as (select evidence_id, s, bool_or({_NAMES.format(s='s')}) as named, bool_or({_FEELS.format(s='s')}) as felt from s join t using (project_id) where t.kind in ('brand', 'alias') group by all),
f as (select evidence_id, bool_or(named and {_hit('s', LEX.hedges)}) as hedged, bool_or(felt and {_hit('s', LEX.comparisons)}) as cmp, bool_or(felt and {_hit('s', LEX.negatives)}) as neg, bool_or(felt and {_hit('s', LEX.positives)} and not {_hit('s', LEX.negations)}) as pos from m group by evidence_id),
p as (select a.project_id, a.evidence_id, a.provider, coalesce(here, false) as brand_present, coalesce(rivals, '') as competitors, coalesce(hedged, false) as hedged, coalesce({_hit('answer_text', LEX.admissions)}, false) as unknown_admission,
  case when not coalesce(here, false) then 'neutral' when cmp then 'comparison' when neg then 'negative' when pos then 'positive' else 'neutral' end as sentiment from a left join n using (evidence_id) left join f using (evidence_id))"""
)


def _sov(by: str) -> str:
    pct = "cast(floor({c}::double / n * 100 + 0.5) as bigint) as pct"
    return f""", c as (select {by}, count(*) as n, count(*) filter (brand_present) as own from p group by all), y as (select {by}, unnest(string_split(competitors, '|')) as name from p), z as (select {by}, name, count(*) as k from y group by all),
r as (select project_id, term as name, min(place) as ordinal from t where kind = 'competitor' group by all)
select {by}, n as samples, t.term as name, true as you, 0 as ordinal, {pct.format(c='own')} from c join t using (project_id) where t.kind = 'brand'
union all select {by}, n, name, false, ordinal, {pct.format(c='coalesce(k, 0)')} from c join r using (project_id) left join z using ({by}, name)"""


_SITES = ctes("serp", "labs", "sites") + """, w as (select * from b_sites where own or confirmed), best as (select s.run_id, keyword_id, keyword, s.domain, w.own, min(item_rank) as r from b_serp s join w on w.run_id = s.run_id and w.domain = s.domain group by all),
per as (select run_id, keyword_id, keyword, min(r) filter (own) as our_position, count(*) filter (not own and r <= 10) as rivals, min(r) filter (not own and r <= 10) as best_rival from best group by all)"""
ORACLES = {
    "project_parse": _P + " select project_id, evidence_id, brand_present, sentiment, hedged, unknown_admission, competitors from p",
    "project_sentiment": _P + " select project_id, count(*) as samples, count(*) filter (brand_present) as present, " + ", ".join(f"count(*) filter (brand_present and sentiment = '{k}') as {k}" for k in ("positive", "negative", "comparison", "neutral")) + " from p group by project_id",
    "project_sov": _P + _sov("project_id"),
    "project_sov_by_engine": _P + _sov("project_id, provider"),
    "project_gaps": _SITES + f""" select p.run_id, p.keyword_id, p.keyword, case when our_position <= 10 then 'winning' when our_position is null and rivals >= 2 then 'missing' when our_position > 10 and our_position <= 30 and rivals >= 1 then 'weak' end as gap_type, our_position, rivals, best_rival, search_volume, intent, {SCORE} as score
 from per p left join b_labs l on l.run_id = p.run_id and l.keyword = p.keyword where our_position <= 10 or (our_position is null and rivals >= 2) or (our_position <= 30 and rivals >= 1)""",
    "project_share_of_serp": _SITES + " select w.run_id, w.domain, count(s.domain) as items, w.own from w left join b_serp s on s.run_id = w.run_id and s.domain = w.domain and s.item_rank <= 10 where w.run_id in (select run_id from b_serp) group by all",
}
