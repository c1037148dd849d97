"""What the bound rules' hits are about, and what follows from it, with SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.operators import crawl as C
from sparkwright.operators import details as D
from sparkwright.operators import page_rules as G
from sparkwright.operators import probes as P
from sparkwright.operators import serp as S
from sparkwright.plans import probes as probe_plans
from sparkwright.plans import projects as project_plans
from sparkwright.plans import rules as R
from sparkwright.plans.serp import GAPS
from sparkwright.sources.bindings import Bound, ctes

#: rules of the crawl's own columns: condition of a page, and whether each page is a hit of its own
CRAWLED = {
    "T01": ("blocked", False), "T02": ("http_status >= 400 and not blocked", False), "T03": ("noindex", False), "T05": ("in_sitemap and inbound = 0 and not blocked", False), "T06": ("redirected", False),
    "T12": ("depth > 3", False), "T10": ("rendered_chars > 0 and initial_chars * 1.0 / rendered_chars < 0.3", True), "G03": ("rendered_chars > 0 and initial_chars * 1.0 / rendered_chars < 0.3", True), "T11": ("key_page and inbound < 3", True),
}


def _row(rule: str, kind: str, ref: Column, example: Column, rank: Column, scope: Column | str) -> list[Column]:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return [F.lit(rule).alias("rule_id"), F.col("run_id").cast("long").alias("run_id"), scope.alias("scope"), F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), example.cast("string").alias("example"), rank.cast("double").alias("rank")]


def _things(df: DataFrame, rule: str, scope: Column | str, kind: str, example: str | Column, rank: str | Column, ref: str | Column | None = None) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(_row(rule, kind, col(example if ref is None else ref), col(example), col(rank), scope))


def _pages(b: Bound) -> list[DataFrame]:
    """Pages of the rules on what they hold and of those on the crawl, each in one pass."""
    one = lambda rule_id, scope: F.struct(F.lit(rule_id).alias("rule_id"), scope.alias("scope"))
    faults = [(r.rule_id, F.lit(r.scope), r.faulty(R.PAGE_LIMITS)) for r in G.RULES]
    held = F.array_compact(F.array(*(F.when(fault, one(k, scope)) for k, scope, fault in faults if fault is not None)))
    crawled = F.array_compact(F.array(*(F.when(F.expr(x), one(k, F.col("url") if each else F.lit("site"))) for k, (x, each) in CRAWLED.items())))
    row = [F.col("r.rule_id"), F.col("run_id").cast("long").alias("run_id"), F.col("r.scope"), F.lit("url").alias("kind"), F.col("page_id").cast("string").alias("ref"), F.col("url").alias("example"), F.col("page_id").cast("double").alias("rank")]
    return [R._features(b).withColumn("r", F.explode(held)).select(*row), b.pages.withColumn("r", F.explode(crawled)).select(*row)]


def _keyword(column: str = "query_id") -> Column:
    return F.concat(F.lit("kw"), F.col(column).cast("string"))


def _searches(b: Bound) -> list[DataFrame]:
    totals, x = R._totals(b), R.BOUND
    best = totals.where(F.col("position").between(4, 20) & (F.col("impressions") >= x.impressions))
    best = best.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("impressions"), "query_id"))).where("i <= 20")
    usual = E.lookup(E.js_round(F.col("position")).cast("int"), R.CTR)
    rarely = totals.withColumn("usual", usual).where(F.col("usual").isNotNull() & (F.col("impressions") >= x.impressions) & (F.col("clicks") / F.col("impressions") < 0.5 * F.col("usual")))
    many = -F.col("impressions")
    score = -F.col("score")
    return [
        _things(best, "K01", "keywords", "keyword", _keyword(), many, "query_id"), _things(rarely, "K02", "keywords", "keyword", _keyword(), many, "query_id"),
        _things(R._shared_queries(b), "K06", "keywords", "query", _keyword(), many, "query_id"), _things(R._misled(b), "K07", "intent", "keyword", "keyword", "keyword_id", "keyword_id"),
        _things(S.top_gaps(R._gaps(b), ("missing",)), "K03", "missing keywords", "keyword", "keyword", score, "keyword_id"), _things(S.top_gaps(R._gaps(b), ("weak",)), "K04", "weak keywords", "keyword", "keyword", score, "keyword_id"),
        _things(R._behind(b), "Q03", "content form", "keyword", "keyword", score, "keyword_id"),
    ]


def _answered(b: Bound) -> list[DataFrame]:
    a = R._answers(b)
    states = P.with_citations(a.parsed.join(a.prompts.where("branded").select("run_id", "prompt_id"), ["run_id", "prompt_id"], "left_semi"), a.citations)
    states = states.withColumn("state", P.answer_state(P.web_search(F.col("provider")), F.col("cited"), F.col("hedged"), F.col("unknown_admission")))
    open_ = a.hosts.join(a.prompts.where("not branded").select("run_id", "prompt_id"), ["run_id", "prompt_id"], "left_semi")
    absent = P.prompt_presence(a.parsed, a.prompts).where("not branded and not present")
    said = R.compared(b).withColumn("line", F.concat_ws(":", "name", "pct"))
    by_engine = R.compared(b, ("run_id", "provider")).withColumn("line", F.concat_ws(":", "provider", "name", "pct"))
    return [
        _things(a.parsed.where("brand_present and sentiment = 'negative'"), "G09", "sentiment", "item", "evidence_id", "evidence_id"), _things(states.where("state = 'speculative'"), "G10", "branded", "item", "evidence_id", "evidence_id"),
        _things(open_.where(F.col("platform").isin(*E.UGC)), "G11", "citations", "url", "cited_url", "evidence_id", "evidence_id"), _things(absent, "G05", "unbranded", "item", "prompt_id", "prompt_id"),
        _things(said, "Q02", "share of voice", "item", "line", -F.col("pct")), _things(by_engine, "Q02", "share of voice", "item", "line", 1000 - F.col("pct")),
    ]


def _others(b: Bound) -> list[DataFrame]:
    shares = S.share_of_serp_of(R._serp(b), R._sites(b)).withColumn("line", F.concat_ws(":", "domain", "items"))
    titles = b.lab_audits.groupBy("run_id", "title").agg(F.max("savings_ms").alias("ms"))
    titles = titles.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ms"), "title"))).where("i <= 8")
    lang = b.pages.where(F.col("url").rlike("/(de|en|es|fr)(/|$)")).join(R._gsc(b).select("page_id").distinct(), "page_id", "left_anti")
    groups = b.pages.join(C.duplicate_groups(b.pages).select("run_id", "content_hash"), ["run_id", "content_hash"], "left_semi")
    links = S.at_sites(b.backlinks, R._sites(b)).withColumn("line", F.concat_ws(":", "domain", "referring_domains"))
    return [
        _things(shares, "Q01", "share of results", "item", "line", -F.col("items"), "domain"), _things(titles, "T09b", "site", "item", "title", -F.col("ms")), _things(lang, "T15", "languages", "url", "url", "page_id", "page_id"),
        _things(groups, "C10", "site", "url", "url", "page_id", "page_id"), _things(links, "A01", "links", "item", "line", -F.col("referring_domains"), "domain"),
        _things(R._anchored(b).where("kind = 'keyword'"), "A02", "anchors", "item", "anchor", -F.col("n")), _things(b.crawlers.where("disallowed"), "G01", "crawlers", "item", "ua", F.lit(0)), _things(b.crawlers.where("kind = 'search' and status >= 400"), "G02", "site", "item", "ua", F.lit(0)),
    ]


def rows_of(b: Bound) -> DataFrame:
    return reduce(DataFrame.unionByName, [*_pages(b), *_searches(b), *_answered(b), *_others(b)])


def _listed(b: Bound) -> DataFrame:
    """What each hit is about, for hits alone: rules that don't fire count nothing."""
    return b.once("listed", lambda: D.listed(rows_of(b)))


def _detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits with kind, total, refs, examples and detail; null for those that list nothing."""
    b = Bound(spark, sf_dir, sharing=True)
    return _with_details(R.hits_of_all(b), _listed(b))


def _searched(b: Bound) -> DataFrame:
    """The hits of the rules on keywords, with their details."""
    rows = reduce(DataFrame.unionByName, _searches(b))
    return _with_details(reduce(DataFrame.unionByName, [R.hits_of(r, b) for r in R.BUILT if r.rule_id in ("K01", "K02", "K03", "K04", "K06", "K07", "Q03")]), D.listed(rows))


def _with_details(hits: DataFrame, found: DataFrame) -> DataFrame:
    x = hits.join(found, list(D.KEYS), "left")
    return x.withColumn("detail", F.when(F.col("kind").isNotNull(), D.detail(F.col("kind"), F.col("total"), F.col("examples"))))


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's hits, with how many things each is about, and the first ten of these and of their references."""
    joined = lambda c: F.array_join(F.col(c), "|").alias(c)
    return _detailed(spark, sf_dir).select("rule_id", "pillar", "run_id", "scope", "severity", "claim", "affected", "measure", "fingerprint", "total", joined("refs"), joined("examples"))


def hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hits touch, out of their details."""
    total, pages = D.affected_pages(F.col("detail"), F.col("scope"))
    x = _detailed(spark, sf_dir).select(*D.KEYS, "severity", total.alias("total"), F.array_join(pages, "|").alias("pages"))
    return x.where("total is not null")


def hit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that a retest measures, out of the hits' details."""
    return _targets(Bound(spark, sf_dir, sharing=True))


def _targets(b: Bound) -> DataFrame:
    return D.metric_targets(_searched(b).select(*D.KEYS, "detail"))


def hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keywords of each hit have in every run."""
    b = Bound(spark, sf_dir, sharing=True)
    metrics = R._totals(b).select("run_id", _keyword().alias("keyword"), "impressions", "position")
    return D.target_metrics(_targets(b), metrics)


QUERIES: tuple[Callable, ...] = (all_hits, hit_pages, hit_targets, hit_metrics)

_OUT = "select '{rule}' as rule_id, cast(run_id as bigint) as run_id, {scope} as scope, '{kind}' as kind, cast({ref} as varchar) as ref, cast({example} as varchar) as example, cast({rank} as double) as rank from ({sql})"


def _sql(rule: str, head: str, sql: str, scope: str, kind: str, example: str, rank: str, ref: str = "") -> str:
    scope = scope if scope == "url" else f"'{scope}'"
    return f"select * from ({head} " + _OUT.format(rule=rule, scope=scope, kind=kind, ref=ref or example, example=example, rank=rank, sql=sql) + ")"


_FAULTS = {
    "T04": "page_id % 13 = 0", "T08": "not starts_with(url, 'https:') or page_id % 31 = 0", "T13": "page_id % 41 = 0", "T14": "page_id % 7 = 0", "C01": "entry and (trim(title) = '' or length(title) > 55)", "C02": "entry and page_id % 6 = 5",
    "C03": "entry and (len(regexp_extract_all(shown, '<h1>')) <> 1 or trim(replace(replace(regexp_extract(shown, '<h1>([^<]*)</h1>', 1), '&quot;', '\"'), '&amp;', '&')) = title)", "C05b": "not valid or page_id % 9 = 0", "C05c": "valid and page_id % 6 >= 3 and page_id % 4 = 0",
    "C05d": "valid and page_id % 3 = 0", "C06": "entry and (page_id % 5 = 0 or page_id % 7 = 0 or (page_id % 8 = 0 and not regexp_matches(lower(shown), 'about|contact')))", "C07": "entry and (figures < 3 or page_id % 6 = 1 or (page_id % 10 = 0 and quote_chars < 2))",
    "C08": "entry and not answered", "C09": "page_id % 3 = 0", "C11": "page_id % 9 = 4 and mean_words > 25",
}
_QT, _PP = R._QT, probe_plans
_HEADS = R._SQL
_IN_OPEN = "join (select * from b_prompts where not branded) q using (run_id, prompt_id)"
_ROWS = " union all ".join([
    *(_sql(k, R._PAGE, f"select * from p where {x}", "site", "url", "url", "page_id", "page_id") for k, x in _FAULTS.items()),
    _sql("C05a", R._PAGE, "select * from p where valid and page_id % 6 in (1, 2)", "deprecated types", "url", "url", "page_id", "page_id"), _sql("E01", R._PAGE, "select * from p where valid and page_id % 12 = 6", "organisation", "url", "url", "page_id", "page_id"),
    *(_sql(k, ctes("pages"), f"select * from b_pages where {x}", "url" if each else "site", "url", "url", "page_id", "page_id") for k, (x, each) in CRAWLED.items()),
    _sql("K01", ctes("gsc"), f"select * from {_QT} where position between 4 and 20 and impressions >= 800 qualify row_number() over (partition by run_id order by impressions desc, query_id) <= 20", "keywords", "keyword", "'kw' || query_id", "-impressions", "query_id"),
    _sql("K02", ctes("gsc"), f"select * from (select *, {R._CTR} as usual from {_QT}) where usual is not null and impressions >= 800 and clicks / impressions < 0.5 * usual", "keywords", "keyword", "'kw' || query_id", "-impressions", "query_id"),
    _sql("K06", ctes("gsc"), "select run_id, query_id, sum(impressions) as impressions from b_gsc where impressions >= 75 group by run_id, query_id having count(distinct page_id) >= 2 qualify row_number() over (partition by run_id order by sum(impressions) desc, query_id) <= 20", "keywords", "query", "'kw' || query_id", "-impressions", "query_id"),
    _sql("K07", ctes("gsc", "labs", "landing") + R._MISLED, "select * from misled", "intent", "keyword", "keyword", "query_id", "query_id"),
    *(_sql(k, ctes("serp", "labs") + f", {GAPS} ", f"select * from gaps where gap_type = '{g}' qualify row_number() over (partition by run_id order by score desc nulls last, keyword) <= 20", f"{g} keywords", "keyword", "keyword", "-score", "keyword_id") for k, g in (("K03", "missing"), ("K04", "weak"))),
    _sql("Q03", R._BEHIND, "select * from behind", "content form", "keyword", "keyword", "-score", "keyword_id"),
    _sql("G09", _PP._P, "select * from p where brand_present and sentiment = 'negative'", "sentiment", "item", "evidence_id", "evidence_id"), _sql("G10", R._STATES, "select * from s where state = 'speculative'", "branded", "item", "evidence_id", "evidence_id"),
    _sql("G11", ctes("citations", "prompts") + _PP._HOST, f"select hh.* from hh {_IN_OPEN} where platform = 'reddit'", "citations", "url", "cited_url", "evidence_id", "evidence_id"), _sql("G05", _PP._P + _PP._PRES, "select * from pres where not branded and not present", "unbranded", "item", "prompt_id", "prompt_id"),
    _sql("Q02", _PP._P + _PP._OPEN + R._NAMED + f", v as ({_PP._sov('run_id')})", "select * from v where you or (run_id, lower(name)) in (select run_id, key from nm)", "share of voice", "item", "name || ':' || pct", "-pct"),
    _sql("Q02", _PP._P + _PP._OPEN + R._NAMED + f", v as ({_PP._sov('run_id, provider')})", "select * from v where you or (run_id, lower(name)) in (select run_id, key from nm)", "share of voice", "item", "provider || ':' || name || ':' || pct", "1000 - pct"),
    _sql("Q01", project_plans._SITES + R._SHARES, "select * from sh", "share of results", "item", "domain || ':' || i", "-i", "domain"),
    _sql("T09b", ctes("lab_audits"), "select run_id, title, max(savings_ms) as ms from b_lab_audits group by run_id, title qualify row_number() over (partition by run_id order by max(savings_ms) desc, title) <= 8", "site", "item", "title", "-ms"),
    _sql("T15", ctes("pages", "gsc"), "select * from b_pages where regexp_matches(url, '/(de|en|es|fr)(/|$)') and page_id not in (select page_id from b_gsc)", "languages", "url", "url", "page_id", "page_id"),
    _sql("C10", ctes("pages"), "select * from b_pages where content_hash <> '' qualify count(*) over (partition by run_id, content_hash) >= 2", "site", "url", "url", "page_id", "page_id"),
    _sql("A01", ctes("backlinks", "sites"), "select k.* from b_backlinks k join b_sites s on s.run_id = k.run_id and s.domain = k.domain where own or confirmed", "links", "item", "domain || ':' || referring_domains", "-referring_domains", "domain"),
    _sql("A02", R._ANCHORS, "select * from an where kind = 'keyword'", "anchors", "item", "anchor", "-n"), _sql("G01", ctes("crawlers"), "select * from b_crawlers where disallowed", "crawlers", "item", "ua", "0"), _sql("G02", ctes("crawlers"), "select * from b_crawlers where kind = 'search' and status >= 400", "site", "item", "ua", "0"),
])
_LISTED = f"""select rule_id, run_id, scope, count(*) as total, array_to_string(list(ref order by rank nulls last, example, ref)[1:10], '|') as refs, array_to_string(list(example order by rank nulls last, example, ref)[1:10], '|') as examples, any_value(kind) as kind
from ({_ROWS}) group by rule_id, run_id, scope"""
_HITS = f"select h.*, l.total, l.refs, l.examples, l.kind from ({R.ALL_SQL}) h left join ({_LISTED}) l using (rule_id, run_id, scope)"
_TARGETS = f"select distinct rule_id, run_id, scope, unnest(string_split(examples, '|')) as keyword from ({_HITS}) where kind in ('keyword', 'query')"
ORACLES = {
    "all_hits": f"select * exclude (kind) from ({_HITS})",
    "hit_pages": f"select rule_id, run_id, scope, severity, coalesce(total, 1) as total, case when kind = 'url' then array_to_string(list_distinct_in_order, '|') else scope end as pages from (select *, list_filter(string_split(examples, '|'), lambda x, i: list_position(string_split(examples, '|'), x) = i) as list_distinct_in_order from ({_HITS})) where kind = 'url' or scope like 'http%'",
    "hit_targets": _TARGETS,
    "hit_metrics": f"{ctes('gsc')}, m as (select run_id as measured_run, 'kw' || query_id as keyword, impressions, position from {_QT}) select rule_id, run_id, scope, measured_run, count(*) as keywords, cast(sum(impressions) as bigint) as impressions, round(avg(position), 6) as position from ({_TARGETS}) join m using (keyword) group by all",
}
