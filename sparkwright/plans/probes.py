"""Queries over AI answers, with their SQL.

The given texts are invented prose, so frequent words stand in for the brand,
its competitors and the lexicon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions.lexicons import Lexicon
from sparkwright.operators import probes as P
from sparkwright.sources.bindings import Bound, ctes

BRAND, ALIASES, RIVALS, DOMAIN = "this", ("from",), ("with", "that", "only"), "example.com"
LEX = Lexicon(hedges=("is of", "only", "thing"), admissions=("was the", "for the"), comparisons=("by the", "vs"), negatives=("are", "ein"), positives=("best", "for", "one", "das"), negations=("not", "or ", "and"))
PLATFORMS = {"example.org": "reddit", "example.net": "wikipedia"}


class Answers:
    """The bound frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, lex: Lexicon = LEX, aliases: tuple[str, ...] = ALIASES) -> None:
        b = Bound(spark, sf_dir)
        self.answers, self.prompts, self.citations = b.answers, b.prompts, b.citations
        self.parsed = P.parse(self.answers, BRAND, DOMAIN, aliases, RIVALS, lex)
        self.hosts = P.cited_hosts(self.citations, DOMAIN, PLATFORMS)


def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Answers(spark, sf_dir).parsed
    return x.select("run_id", "evidence_id", "brand_present", F.array_join("competitors", ",").alias("competitors"), "sentiment", "hedged", "unknown_admission")


def competitor_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Answers(spark, sf_dir).parsed.select("run_id", "provider", F.explode("competitors").alias("name"))
    return x.groupBy("run_id", "provider", "name").agg(F.count("*").alias("n"))


def prompt_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.prompt_presence(a.parsed, a.prompts)


def sov(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.share_of_voice(P.unbranded_samples(a.parsed, a.prompts), BRAND, RIVALS)


def sov_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.share_of_voice(P.unbranded_samples(a.parsed, a.prompts), BRAND, RIVALS, ("run_id", "provider"))


def engine_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.engine_visibility(a.parsed, a.prompts)


def unbranded_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unbranded_presence(prompt_presence(spark, sf_dir))


def sentiment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sentiment_breakdown(Answers(spark, sf_dir).parsed)


def branded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.branded_states(a.parsed, a.prompts, a.citations)


def citation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.citation_rate(a.parsed, a.citations)


def citation_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Answers(spark, sf_dir).hosts.select("run_id", "evidence_id", "host", "origin", "platform")


def cited_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cited_domains(Answers(spark, sf_dir).hosts)


def ugc_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.ugc_share(a.hosts, a.prompts)


def cited_owned_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.owned_share(Answers(spark, sf_dir).hosts)


def sample_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample_evidence(Answers(spark, sf_dir).parsed)


def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    return P.summary(a.parsed, a.prompts, a.citations, DOMAIN)


def probe_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with their answers; prompts without any are kept."""
    a = Answers(spark, sf_dir)
    return a.prompts.join(a.answers, ["run_id", "prompt_id"], "left").select("run_id", "prompt_id", "branded", "evidence_id", "provider", F.length("answer_text").alias("n_chars"))


def probe_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Answers(spark, sf_dir)
    explicit = F.when(F.col("evidence_id") % 7 == 0, False).when(F.col("evidence_id") % 7 == 1, True)
    return a.answers.select("run_id", "evidence_id", "provider", P.web_search(F.col("provider"), explicit).alias("web_search"))


def probe_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their evidence row, its run and project."""
    b = Bound(spark, sf_dir)
    e = b.evidence.select(F.col("evidence_id"), "level", F.col("run_id").alias("log_run"))
    p = b.projects.select(F.col("project_id").alias("log_run"), "owner_id")
    return b.answers.select("evidence_id", "provider").join(e, "evidence_id").join(p, "log_run")


def retrieved_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that a run's even citations name and its odd ones do not."""
    hosts = Answers(spark, sf_dir).hosts.select("run_id", "host", (F.col("evidence_id") % 2 == 1).alias("cited")).distinct()
    return hosts.where("not cited").select("run_id", "host").join(hosts.where("cited").select("run_id", "host"), ["run_id", "host"], "left_anti")


def reparse_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier parser knew no alias."""
    return P.reparse(Answers(spark, sf_dir).parsed, Answers(spark, sf_dir, aliases=()).parsed)


def reparse_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reparse_summary(reparse_diff(spark, sf_dir))


def citation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose domain counts as cited by all URLs, and by those of the first half of prompts only."""
    hosts = Answers(spark, sf_dir).hosts.where("origin = 'owned'")
    per = hosts.groupBy("run_id", "evidence_id").agg(F.bool_or(F.col("prompt_id") < 15).alias("strict"))
    return per.groupBy("run_id").agg(F.count("*").alias("old_cited"), F.count_if("strict").alias("new_cited"), F.count_if(~F.col("strict")).alias("downgraded"))


def presence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts absent and unmeasured, and engines with an unnamed one counted once."""
    a = Answers(spark, sf_dir)
    engines = a.parsed.groupBy("run_id").agg(F.countDistinct(F.coalesce("provider", F.lit(""))).alias("engines"))
    p = P.prompt_presence(a.parsed, a.prompts)
    return p.groupBy("run_id").agg(F.count_if("present").alias("present"), F.count_if(~F.col("present") & (F.col("samples") > 0)).alias("absent"), F.count_if(F.col("samples") == 0).alias("unmeasured")).join(engines, "run_id")


def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two runs' unbranded numbers may be compared: equal parser versions, and not one run without branded prompts."""
    b = Bound(spark, sf_dir)
    versions = b.answers.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("v"), (F.col("evidence_id") % (F.col("run_id") + 1)).cast("string")))), ",").alias("versions"))
    runs = b.prompts.groupBy("run_id").agg(F.count_if("branded").alias("branded")).join(versions, "run_id")
    old = runs.select(F.col("run_id").alias("base_run"), F.col("branded").alias("b0"), F.col("versions").alias("v0"))
    pair = runs.join(old, F.col("run_id") == F.col("base_run") + 1)
    bad = ((F.col("b0") == 0) & (F.col("branded") > 0)) | ((F.col("v0") != "") & (F.col("versions") != "") & (F.col("v0") != F.col("versions")))
    return pair.select("base_run", "run_id", (~bad).alias("comparable"))


QUERIES = (
    parse_answers, competitor_mentions, prompt_presence, sov, sov_by_engine, engine_visibility, unbranded_presence, sentiment_breakdown, branded_states, citation_rate, citation_origin, cited_domains, ugc_share,
    cited_owned_share, sample_evidence, probe_summary, probe_answers, probe_capability, probe_lineage, retrieved_only, reparse_diff, reparse_diff_summary, citation_replay, presence_map, comparability,
)


def _hit(s: str, terms: tuple[str, ...]) -> str:
    word = [f"regexp_matches({s}, '(?i)\\b{t}\\b')" if t.isalpha() else f"contains(lower({s}), '{t}')" for t in terms]
    return "(" + " or ".join(word) + ")"


def _parsed(name: str, aliases: tuple[str, ...] = ALIASES) -> str:
    brand = (BRAND, *aliases)
    sents = "list_filter(list_transform(regexp_split_to_array(answer_text, '[.!?。！？；;\n]+'), lambda s: regexp_replace(s, '^[\\s\\x{A0}\\x{3000}]+|[\\s\\x{A0}\\x{3000}]+$', '', 'g')), lambda s: s <> '')"
    some = lambda t: f"len(list_filter(mine, lambda s: {t})) > 0"
    feel = f"case when {some(_hit('s', LEX.comparisons))} then 'comparison' when {some(_hit('s', LEX.negatives))} then 'negative' when {some(_hit('s', LEX.positives) + ' and not ' + _hit('s', LEX.negations))} then 'positive' else 'neutral' end"
    rivals = ", ".join(f"case when {_hit('answer_text', (r,))} then '{r}' end" for r in RIVALS)
    return f""", {name}0 as (select *, list_filter({sents}, lambda s: {_hit('s', brand)}) as mine, {_hit('answer_text', brand)} or contains(lower(answer_text), '{DOMAIN}') as brand_present from b_answers),
{name} as (select run_id, evidence_id, prompt_id, provider, brand_present, list_filter([{rivals}], lambda x: x is not null) as competitors, case when brand_present then {feel} else 'neutral' end as sentiment,
  {some(_hit('s', LEX.hedges))} as hedged, {_hit('answer_text', LEX.admissions)} as unknown_admission from {name}0)"""


_P = ctes("answers", "prompts", "citations") + _parsed("p")
_PRES = ", pres as (select q.run_id, q.prompt_id, q.branded, coalesce(bool_or(p.brand_present), false) as present, count(p.evidence_id) as samples from b_prompts q left join p using (run_id, prompt_id) group by all)"
_OPEN = ", o as (select p.* from p join b_prompts q using (run_id, prompt_id) where not q.branded)"
_HOST = """, h as (select *, regexp_replace(lower(regexp_extract(cited_url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') as host from b_citations where cited_url is not null),
hh as (select *, case when host = 'example.com' or ends_with(host, '.example.com') then 'owned' else 'third_party' end as origin,
  case when host = 'example.org' or ends_with(host, '.example.org') then 'reddit' when host = 'example.net' or ends_with(host, '.example.net') then 'wikipedia' else 'other' end as platform from h)"""
_CITED = ", c as (select distinct evidence_id from b_citations where cited_url is not null), pc as (select p.*, c.evidence_id is not null as cited, provider <> 'deepseek' as online from p left join c using (evidence_id))"
_WILSON = "case when {n} > 0 then greatest(0::double, ({x}::double / {n} + 3.8416::double / (2 * {n}) - 1.96::double * sqrt({x}::double / {n} * (1 - {x}::double / {n}) / {n} + 3.8416::double / (4 * {n}::double * {n}))) / (1 + 3.8416::double / {n})) else 0::double end"


def _sov(by: str) -> str:
    pct = "cast(floor({c}::double / count(*) * 100 + 0.5) as bigint)"
    rows = [f"select {by}, count(*) as samples, '{BRAND}' as name, true as you, 0 as ordinal, {pct.format(c='count(*) filter (brand_present)')} as pct from o group by all"]
    rows += [f"select {by}, count(*), '{r}', false, {i}, {pct.format(c=f"count(*) filter (list_contains(competitors, '{r}'))")} from o group by all" for i, r in enumerate(RIVALS, 1)]
    return " union all ".join(rows)


_UNB = f"select run_id, count(*) filter (present) as present, count(*) as total, round({_WILSON.format(x='count(*) filter (present)', n='count(*)')}, 6) as wilson_low from pres where not branded group by run_id"
_RATE = "select run_id, round(coalesce(avg(cited::int) filter (online), 0), 6) as citation_rate from pc group by run_id"
_STATE = "case when online and cited then 'grounded' when hedged then 'speculative' when unknown_admission then 'unknown' when online then 'unverified' else 'undetermined' end"
_DIFF = _P + _parsed("z", ()) + """, diff as (select p.run_id, p.evidence_id, p.provider, p.brand_present, p.hedged, p.unknown_admission, p.sentiment, z.brand_present as old_brand_present, z.hedged as old_hedged, z.unknown_admission as old_unknown_admission, z.sentiment as old_sentiment
  from p join z using (evidence_id) where p.brand_present <> z.brand_present or p.hedged <> z.hedged or p.unknown_admission <> z.unknown_admission or p.sentiment <> z.sentiment)"""
_DSUM = "count(*) as changed, count(*) filter (brand_present <> old_brand_present) as brand_flips, count(*) filter (hedged and not old_hedged) as newly_hedged, count(*) filter (sentiment <> old_sentiment) as sentiment_changes from diff"
ORACLES = {
    "parse_answers": _P + " select run_id, evidence_id, brand_present, array_to_string(competitors, ',') as competitors, sentiment, hedged, unknown_admission from p",
    "competitor_mentions": _P + " select run_id, provider, name, count(*) as n from (select run_id, provider, unnest(competitors) as name from p) group by all",
    "prompt_presence": _P + _PRES + " select * from pres",
    "sov": _P + _OPEN + " " + _sov("run_id"),
    "sov_by_engine": _P + _OPEN + " " + _sov("run_id, provider"),
    "engine_visibility": _P + """ select p.run_id, provider as engine, count(distinct prompt_id) filter (brand_present) as prompts_present, count(distinct prompt_id) as prompts_total, count(*) as samples,
 count(distinct prompt_id) filter (brand_present and not branded) as unbranded_present, count(distinct prompt_id) filter (not branded) as unbranded_total from p join b_prompts using (run_id, prompt_id) group by all""",
    "unbranded_presence": _P + _PRES + " " + _UNB,
    "sentiment_breakdown": _P + " select run_id, count(*) filter (sentiment = 'positive') as positive, count(*) filter (sentiment = 'negative') as negative, count(*) filter (sentiment = 'comparison') as comparison, count(*) filter (sentiment = 'neutral') as neutral, count(*) as total from p where brand_present group by run_id",
    "branded_states": _P + _CITED + f", s as (select pc.*, {_STATE} as state from pc join b_prompts q using (run_id, prompt_id) where q.branded) select run_id, provider, any_value(online) as web_search, " + ", ".join(f"count(*) filter (state = '{k}') as \"{k}\"" for k in ("grounded", "speculative", "unknown", "unverified", "undetermined")) + " from s group by run_id, provider",
    "citation_rate": _P + _CITED + " " + _RATE,
    "citation_origin": ctes("citations") + _HOST + " select run_id, evidence_id, host, origin, platform from hh",
    "cited_domains": ctes("citations") + _HOST + " select run_id, host, count(*) as n, any_value(origin) as origin, any_value(platform) as platform from hh group by run_id, host",
    "ugc_share": ctes("citations", "prompts") + _HOST + " select q.run_id, round(count(*) filter (platform = 'reddit')::double / nullif(count(host), 0), 6) as ugc_share from (select * from b_prompts where not branded) q left join hh using (run_id, prompt_id) group by q.run_id",
    "cited_owned_share": ctes("citations") + _HOST + " select run_id, round(count(*) filter (origin = 'owned')::double / count(*), 6) as owned_share from hh group by run_id",
    "sample_evidence": _P + " select run_id, coalesce(min(evidence_id) filter (brand_present), min(evidence_id)) as evidence_id from p group by run_id",
    "probe_summary": _P + _PRES + _CITED + _HOST + f""", u as ({_UNB}), r as ({_RATE}), w as (select run_id, round(count(*) filter (origin = 'owned')::double / count(*), 6) as owned_share from hh group by run_id),
t as (select run_id, count(*) as prompts_total, count(*) filter (present) as prompts_present from pres group by run_id), s as (select run_id, count(*) as total_samples, coalesce(min(evidence_id) filter (brand_present), min(evidence_id)) as evidence_id from p group by run_id)
select t.run_id, prompts_total, prompts_present, total_samples, u.present as unbranded_present, u.total as unbranded_total, wilson_low, citation_rate, owned_share, evidence_id from t join s using (run_id) left join u using (run_id) left join r using (run_id) left join w using (run_id)""",
    "probe_answers": ctes("answers", "prompts") + "select q.run_id, q.prompt_id, q.branded, evidence_id, provider, cast(length(answer_text) as integer) as n_chars from b_prompts q left join b_answers using (run_id, prompt_id)",
    "probe_capability": ctes("answers") + "select run_id, evidence_id, provider, case evidence_id % 7 when 0 then false when 1 then true else provider <> 'deepseek' end as web_search from b_answers",
    "probe_lineage": ctes("answers", "evidence", "projects") + "select e.run_id as log_run, a.evidence_id, a.provider, e.level, p.owner_id from b_answers a join b_evidence e using (evidence_id) join b_projects p on p.project_id = e.run_id",
    "retrieved_only": ctes("citations") + _HOST + " select distinct run_id, host from hh where evidence_id % 2 = 0 and (run_id, host) not in (select run_id, host from hh where evidence_id % 2 = 1)",
    "reparse_diff": _DIFF + " select * from diff",
    "reparse_diff_summary": _DIFF + f" select provider, {_DSUM} group by provider union all select 'all', {_DSUM}",
    "citation_replay": ctes("citations") + _HOST + ", e as (select run_id, evidence_id, bool_or(prompt_id < 15) as strict from hh where origin = 'owned' group by all) select run_id, count(*) as old_cited, count(*) filter (strict) as new_cited, count(*) filter (not strict) as downgraded from e group by run_id",
    "presence_map": _P + _PRES + " select run_id, count(*) filter (present) as present, count(*) filter (not present and samples > 0) as absent, count(*) filter (samples = 0) as unmeasured, any_value(engines) as engines from pres join (select run_id, count(distinct provider) as engines from p group by run_id) using (run_id) group by run_id",
    "comparability": ctes("answers", "prompts") + """, v as (select run_id, string_agg(distinct 'v' || (evidence_id % (run_id + 1)), ',' order by 'v' || (evidence_id % (run_id + 1))) as versions from b_answers group by run_id),
r as (select run_id, count(*) filter (branded) as branded, any_value(versions) as versions from b_prompts join v using (run_id) group by run_id)
select o.run_id as base_run, n.run_id, not ((o.branded = 0 and n.branded > 0) or o.versions <> n.versions) as comparable from r n join r o on n.run_id = o.run_id + 1""",
}
