"""Domain frames derived from the given tables.

Each binding is SQL with ``{table}`` for the tables it reads; the text is valid
in Spark and in other engines, so that a query and its SQL start from the same
rows.  The operators themselves know nothing of these tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwright.sources.shared import settle

#: parameters of the bound data: the site, its confirmed competitors, and text terms
OWN = "s0.example"
COMPETITORS = ("s1.example", "s2.example", "s3.example", "s4.example")

BINDINGS = {
    "serp": """select cast(l_partkey % 4 as bigint) as run_id, l_partkey as keyword_id, concat('kw', cast(l_partkey as string)) as keyword,
  concat('s', cast(l_suppkey as string), '.example') as domain,
  cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as bigint) as item_rank from {lineitem}""",
    "labs": """select p_partkey as keyword_id, cast(p_partkey % 4 as bigint) as run_id, concat('kw', cast(p_partkey as string)) as keyword, p_name as title,
  case when p_partkey % 7 = 0 then null else (p_partkey * 37) % 100000 end as search_volume,
  case when p_partkey % 11 = 0 then null else (p_size * 2) % 101 end as difficulty,
  case p_partkey % 5 when 0 then 'transactional' when 1 then 'commercial' when 2 then 'informational' when 3 then 'navigational' else null end as intent from {part}""",
    "gsc": """select cast(l_partkey % 4 as bigint) as run_id, l_partkey as query_id, l_suppkey as page_id, sum(cast(l_quantity as bigint)) as impressions,
  sum(case when l_returnflag = 'R' then 1 else 0 end) as clicks, cast(l_partkey % 47 + 1 as double) as avg_pos
  from {lineitem} group by l_partkey, l_suppkey""",
    "findings": """select o_orderkey as finding_id, cast(o_custkey % 16 as bigint) as project_id, cast(year(o_orderdate) as bigint) as run_id,
  concat('R', cast(o_custkey % 64 as string)) as rule_id, cast(o_custkey as string) as fingerprint,
  case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'high' when '3-MEDIUM' then 'mid' else 'ok' end as severity,
  case o_orderstatus when 'O' then 'open' when 'F' then 'dismissed' else 'converted' end as status,
  concat('P', cast(o_orderkey % 5 + 1 as string)) as pillar,
  case o_orderkey % 4 when 0 then 'measured_hard' when 1 then 'measured_sample' when 2 then 'inferred' else 'hypothesis' end as claim_type from {orders}""",
    "recs": """select l_orderkey as finding_id, cast(l_linenumber as bigint) as rec_no,
  case when l_returnflag = 'A' then 'effective' when l_returnflag = 'R' then 'ineffective' when l_linestatus = 'F' then 'regressed' else 'unknown' end as outcome,
  case l_suppkey % 4 when 0 then 'accepted' when 1 then 'edited' when 2 then 'rejected' else 'proposed' end as status,
  case l_partkey % 5 when 0 then 'quick_win' when 1 then 'strategic' when 2 then 'fill_in' when 3 then 'low' else 'other' end as priority,
  case l_partkey % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as effort, l_linestatus = 'F' as applied from {lineitem}""",
    "answers": """select doc_id as evidence_id, cast(doc_id % 3 as bigint) as run_id, doc_id % 30 as prompt_id,
  case doc_id % 4 when 0 then 'openai' when 1 then 'perplexity' when 2 then 'gemini' else 'deepseek' end as provider, text as answer_text from {documents}""",
    # a thousand projects; each takes its names from the first words of other documents
    "project_answers": """select doc_id as evidence_id, doc_id % 1000 as project_id, case doc_id % 4 when 0 then 'openai' when 1 then 'perplexity' when 2 then 'gemini' else 'deepseek' end as provider, text as answer_text from {documents}""",
    "project_terms": """select k.p as project_id, k.kind, k.place, case k.kind when 'competitor' then regexp_extract(d.text, '([A-Za-z][a-z][a-z]+ [a-z]+)', 1) when 'domain' then concat('www.', regexp_extract(d.text, '([A-Za-z]+)', 1), '.') else regexp_extract(d.text, '([A-Za-z][a-z][a-z]+)', 1) end as term
  from (select doc_id as p, 'brand' as kind, 0 as place, doc_id as source from {documents} where doc_id < 1000 union all select doc_id, 'alias', 0, doc_id + 1 from {documents} where doc_id < 1000
    union all select doc_id, 'competitor', 1, doc_id + 2 from {documents} where doc_id < 1000 union all select doc_id, 'competitor', 2, doc_id + 3 from {documents} where doc_id < 1000 union all select doc_id, 'domain', 0, doc_id + 4 from {documents} where doc_id < 1000) k
  join {documents} d on d.doc_id = k.source where d.text is not null""",
    # the own domain of each run and its candidates; those of suppliers in credit are confirmed
    "sites": """select cast(s_suppkey % 4 as bigint) as run_id, concat('s', cast(s_suppkey as string), '.example') as domain, s_suppkey < 5 as own, s_acctbal > 0 as confirmed from {supplier} where s_suppkey < 100""",
    "prompts": """select distinct cast(doc_id % 3 as bigint) as run_id, doc_id % 30 as prompt_id, (doc_id % 30) < 6 as branded from {documents}""",
    # an answer that cites nothing is a row without a URL
    "citations": """select d.doc_id as evidence_id, cast(d.doc_id % 3 as bigint) as run_id, d.doc_id % 30 as prompt_id, case when d.doc_id % 12 in (1, 2, 3, 7) then null else p.url end as cited_url
  from {documents} d cross join (select count(*) as n_pages from {pages}) c join {pages} p on p.page_id = d.doc_id % c.n_pages""",
    "progress": """select user_id as run_id, event_id as seq, ts,
  case event_type when 'view' then 'progress' when 'click' then 'evidence_created' when 'signup' then 'phase' when 'purchase' then 'done' else 'failed' end as msg_type,
  cast(floor(value) as bigint) as amount from {events}""",
    "run_events": """select user_id as run_id, event_id as seq, ts, case event_type when 'view' then 'collecting' when 'click' then case event_id % 3 when 0 then 'collected' when 1 then 'diagnosing' else 'reviewing' end
  when 'signup' then case event_id % 4 when 0 then 'cancel' when 1 then 'retry' when 2 then 'decided' else 'undecided' end when 'purchase' then 'reviewing' else 'failed' end as event from {events}""",
    "evidence": """select event_id as evidence_id, user_id as run_id, ts as captured_at, event_type as type,
  concat('L', cast(event_id % 4 + 1 as string)) as level, props as payload, event_id % 3 = 0 as has_page, concat(event_type, '-', cast(event_id % 700 as string)) as evidence_key from {events}""",
    "projects": """select c_custkey as project_id, cast(c_nationkey as bigint) as owner_id, concat('www.c', cast(c_custkey as string), '.example.com') as domain, c_name as name, c_mktsegment as market from {customer}""",
    "runs": """select o_custkey as project_id, o_orderkey as run_id, case when o_orderkey % 9 = 0 then null else o_orderdate end as started_at,
  case when o_orderkey % 3 = 0 then 'retest' else 'baseline' end as type,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'collecting' else 'failed' end as status from {orders}""",
    "pages": """select page_id, cast(page_id % 5 as bigint) as run_id, url, html,
  case when page_id % 19 = 0 then 404 when page_id % 37 = 1 then 500 else 200 end as http_status,
  case when page_id % 11 = 0 then null else page_id % 7 end as depth, page_id % 9 as inbound, page_id % 3 = 0 as in_sitemap,
  page_id % 17 = 0 as noindex, page_id % 13 = 0 as canonical_off, page_id % 29 = 0 as blocked, page_id % 23 = 0 as redirected,
  url like 'https:%' as is_https, page_id % 31 = 0 as mixed_content, page_id % 41 = 0 as no_viewport, page_id % 6 = 0 as key_page,
  page_id % 12 as images, case when page_id % 4 = 0 then page_id % 12 else 0 end as missing_alt,
  length(html) as initial_chars, length(html) * (1 + page_id % 5) as rendered_chars, page_id % 8 as list_count, 40 * (page_id % 6) as paragraph_words,
  case when page_id % 10 = 0 then '' else concat('h', cast(page_id % 60 as string)) end as content_hash,
  case page_id % 7 when 0 then 'xx' when 1 then 'US' when 2 then 'x-default' else null end as hreflang from {pages}""",
    # the given pages with what they lack put into head and article: marks, links, images and structured data
    "site_pages": """select page_id, cast(page_id % 5 as bigint) as run_id, url, page_id between 20 and 24 as entry, replace(replace(case when page_id % 9 = 4 then replace(html, '<ul>', '<div>') else html end,
  '</head>', concat(case when page_id % 41 = 0 then '' else '<meta name="viewport" content="width=device-width">' end, case when page_id % 6 = 5 then '' else '<meta name="description" content="d">' end,
    case when page_id % 13 = 0 then '<link rel="canonical" href="https://elsewhere.example/x">' when page_id % 13 < 9 then concat('<link rel="canonical" href="', url, '">') else '' end,
    case page_id % 7 when 0 then '<link rel="alternate" hreflang="en-123" href="/">' when 1 then '<link rel="alternate" hreflang="en-US" href="/">' when 2 then '<link rel="alternate" hreflang="x-default" href="/">' else '' end,
    case when page_id % 31 = 0 then '<script src="http://plain.example/x.js"></script>' else '' end, '<script type="application/ld+json">',
    case when page_id % 14 = 0 then concat(chr(123), '"@type": broken') else concat(chr(123), '"@context": "', case when page_id % 9 = 0 then 'https://example.com' else 'https://schema.org' end, '", "@type": "',
      case page_id % 6 when 0 then 'Organization' when 1 then 'FAQPage' when 2 then 'HowTo' when 3 then 'Product' else 'Article' end, '", "name": "stated ', cast(page_id as string), ' here"',
      case when page_id % 4 = 0 then '' else ', "image": "/i.png", "headline": "stated", "datePublished": "2024"' end,
      case when page_id % 6 = 0 then concat(', "sameAs": ["https://', case when page_id % 12 = 0 then 'www.wikidata.org' else 'blog.example' end, '/q"]') else '' end, chr(125)) end, '</script></head>')),
  '</article>', concat('<p>', case when page_id % 3 = 0 then 'stated' else concat('stated ', cast(page_id as string), ' here') end, '</p>', case when page_id % 5 = 0 then '' else '<span class="byline">N</span>' end,
    case when page_id % 7 = 0 then '' else '<time>May</time>' end, case when page_id % 8 = 0 then '' else '<a href="/about">x</a>' end, case when page_id % 4 = 3 then '' else '<p>12% of 34,5 and 7</p>' end,
    case when page_id % 6 = 1 then '' else '<a href="https://other.example/x">o</a>' end, case when page_id % 10 = 0 then '' else '<blockquote>q</blockquote>' end,
    case when page_id % 2 = 0 then '<img src="/a.png" alt="a">' else '' end, case when page_id % 3 = 0 then '<img src="/b.png" alt="">' else '' end, '</article>')) as html from {pages}""",
    # seven sites: an index of four files, a circle and two dead ends; one file for all; nothing
    "sitemap_entries": """select distinct cast(page_id % 7 as bigint) as run_id, concat('https://r', cast(page_id % 7 as string), '.example/home?x=1') as entry_url,
  case when page_id % 7 % 2 = 0 then concat('User-agent: *', chr(10), 'Sitemap: https://r', cast(page_id % 7 as string), '.example/index.xml', chr(10), 'sitemap: https://r', cast(page_id % 7 as string), '.example/extra.xml') end as robots from {pages}""",
    "sitemap_files": """select run_id, concat('https://r', cast(run_id as string), '.example/map', cast(k as string), '.xml') as url, case when k = 3 then 503 else 200 end as status, concat('<urlset>', string_agg(loc, ''), '</urlset>') as body
    from (select cast(page_id % 7 as bigint) as run_id, cast(floor(page_id / 7) as bigint) % 4 as k, concat('<url><loc>', replace(url, '&', '&amp;'), '</loc></url>') as loc from {pages} where page_id % 7 % 2 = 0) x group by run_id, k
  union all select distinct cast(page_id % 7 as bigint), concat('https://r', cast(page_id % 7 as string), '.example/index.xml'), 200, concat('<sitemapindex>', concat('<loc>https://r', cast(page_id % 7 as string), '.example/map0.xml</loc><loc>https://r', cast(page_id % 7 as string), '.example/map1.xml</loc>'),
    concat('<loc>https://r', cast(page_id % 7 as string), '.example/index.xml</loc><loc>https://r', cast(page_id % 7 as string), '.example/map2.xml</loc><loc>https://r', cast(page_id % 7 as string), '.example/map3.xml</loc><loc>https://r', cast(page_id % 7 as string), '.example/gone.xml</loc>'), '</sitemapindex>') from {pages} where page_id % 7 % 2 = 0
  union all select cast(page_id % 7 as bigint), concat('https://r', cast(page_id % 7 as string), '.example/sitemap.xml'), 200, concat('<urlset>', string_agg(concat('<url><loc><![CDATA[', url, ']]></loc></url>'), ''), '</urlset>') from {pages} where page_id % 7 in (1, 5) group by page_id % 7""",
    "json_ld": """select page_id, cast(page_id % 5 as bigint) as run_id, html, page_id % 14 <> 0 as valid, page_id % 9 <> 0 as context_ok, page_id % 4 <> 0 as has_fields,
  case page_id % 6 when 0 then 'Organization' when 1 then 'FAQPage' when 2 then 'HowTo' when 3 then 'Product' else 'Article' end as type,
  case when page_id % 3 = 0 then concat('absent ', cast(page_id as string)) else regexp_extract(html, '<h1>([^<]*)</h1>', 1) end as stated from {pages}""",
    "links": """select cast(o_custkey % 4 as bigint) as run_id, o_custkey as source_id, (o_custkey * 7 + o_orderkey) % n_nodes as target_id from {orders} cross join (select count(*) as n_nodes from {customer}) c""",
    "aio": """select cast(p_partkey % 4 as bigint) as run_id, p_partkey as keyword_id, p_partkey % 3 <> 0 as measured, p_partkey % 5 < 2 as present,
  p_partkey % 10 = 0 as owned, concat('d', cast(p_partkey % 17 as string), '.example') as cited_domain from {part}""",
    "sources": """select s_suppkey as run_id, k.source_key,
  case (s_suppkey + k.code) % 6 when 0 then 'missing' when 1 then 'partial' when 2 then 'failed' else 'collected' end as status, (s_suppkey * k.code) % 4 as captured
  from {supplier} cross join (select 'crawl' as source_key, 1 as code union all select 'gsc', 2 union all select 'dataforseo', 3 union all select 'ai_probe', 5 union all select 'psi', 7) k""",
    "backlinks": """select l_suppkey as domain_id, concat('s', cast(l_suppkey as string), '.example') as domain, cast(l_suppkey % 4 as bigint) as run_id, count(distinct l_orderkey) as referring_domains, count(*) as backlinks,
  sum(case when l_returnflag = 'A' then 1 else 0 end) as new_links, sum(case when l_returnflag = 'R' then 1 else 0 end) as lost_links from {lineitem} group by l_suppkey""",
    "anchors": """select run_id, domain, anchor, count(*) as n from (select cast(l_suppkey % 4 as bigint) as run_id, concat('s', cast(l_suppkey as string), '.example') as domain,
    case l_linenumber when 1 then ' Click here' when 2 then concat('https://s', cast(l_suppkey as string), '.example/') when 3 then concat('www.s', cast(l_suppkey as string), '.example') when 4 then concat('The S', cast(l_suppkey as string), ' store') else p_name end as anchor
    from {lineitem} join {part} on p_partkey = l_partkey) x group by run_id, domain, anchor""",
    # where searches land: the given pages under the paths of a shop, by their language
    "landing": """select page_id, concat('https://s0.example/', case when url like '%/en/%' then 'Shop' when url like '%/de/%' then 'blog' when url like '%/es/%' then 'guides' else 'about' end, '/', cast(page_id as string)) as url from {pages}""",
    # the confirmed competitors' names of each run
    "rivals": """select run_id, name from (select cast(doc_id % 3 as bigint) as run_id, case doc_id % 4 when 0 then 'With' when 1 then 'that' when 2 then 'Only' else 'elsewhere' end as name from {documents} where doc_id % 3 <> doc_id % 4) x group by run_id, name""",
    "artifacts": """select p_brand as artifact_key, min(make_date(2020 + cast(p_partkey % 5 as int), 1 + cast(p_partkey % 12 as int), 1)) as verified_on, max(30 * (1 + p_size % 6)) as cadence_days from {part} group by p_brand""",
    "proposals": """select p_partkey as proposal_id, concat('R', cast(p_partkey % 64 as string)) as target, case p_partkey % 3 when 0 then 'stats' when 1 then 'freshness' else 'manual' end as source,
  case p_partkey % 4 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' else 'released' end as status,
  case when p_partkey % 4 = 3 then concat('rules_v', cast(p_partkey % 13 + 1 as string)) end as version, case when p_partkey % 9 = 0 then '' else p_name end as evidence from {part}""",
    "lab_audits": """select cast(l_suppkey % 5 as bigint) as run_id, concat('audit', cast(l_partkey % 23 as string)) as title, l_quantity * 100 as savings_ms, l_orderkey * 10 + l_linenumber as audit_id from {lineitem}""",
    "vitals": """select cast(s_suppkey as bigint) as run_id, s_suppkey * 61.0 as lcp_ms, s_suppkey * 5.0 as inp_ms, s_suppkey / 400.0 as cls, s_suppkey * 17.0 as ttfb_ms, s_suppkey % 3 <> 0 as has_field from {supplier}""",
    "presence": """select s_suppkey as run_id, s_suppkey % 4 = 0 as encyclopedia, s_suppkey % 7 as forum_mentions, s_suppkey % 5 as video_results, s_suppkey % 3 as review_sites, s_suppkey % 2 as review_results,
  s_suppkey % 6 = 0 as knowledge_panel, s_suppkey % 9 as bing_indexed, s_suppkey % 8 = 0 as llms_txt, s_suppkey % 5 = 0 as organisation, s_suppkey % 10 = 0 as same_as from {supplier}""",
    "crawlers": """select cast(s_suppkey as bigint) as run_id, k.ua, k.kind, case when (s_suppkey * k.code) % 11 < 2 then 403 else 200 end as status, (s_suppkey + k.code) % 6 = 0 as disallowed
  from {supplier} cross join (select 'searchbot' as ua, 'search' as kind, 3 as code union all select 'answerbot', 'search', 5 union all select 'trainbot', 'training', 7) k""",
}

#: the same rows said otherwise for Spark alone
IN_SPARK = {
    # what is asked of a page's URL becomes a join condition of documents and pages, and Spark would then pair all of them before it looks at their number
    "citations": """select d.doc_id as evidence_id, cast(d.doc_id % 3 as bigint) as run_id, d.doc_id % 30 as prompt_id, case when d.doc_id % 12 in (1, 2, 3, 7) then null else p.url end as cited_url
  from (select doc_id, doc_id % (select nullif(count(*), 0) from {pages}) as cited from {documents}) d join {pages} p on p.page_id = d.cited""",
    # names are made of numbers after the items are ranked, so that they aren't moved and sorted with them
    "serp": """select cast(l_partkey % 4 as bigint) as run_id, l_partkey as keyword_id, concat('kw', cast(l_partkey as string)) as keyword, concat('s', cast(l_suppkey as string), '.example') as domain, item_rank
  from (select l_partkey, l_suppkey, cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as bigint) as item_rank from {lineitem})""",
}

_NAME = re.compile(r"\{(\w+)\}")


def tables_of(name: str) -> list[str]:
    return sorted(set(_NAME.findall(BINDINGS[name])))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The bound frame; only the columns that a query uses are read."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)}
    return spark.sql(IN_SPARK.get(name, BINDINGS[name]), **tables)


def ctes(*names: str) -> str:
    """``with b_x as (...), ...`` for SQL over registered tables."""
    return "with recursive " + ",\n".join(f"b_{n} as ({_NAME.sub(lambda m: m[1], BINDINGS[n])})" for n in dict.fromkeys(names)) + "\n"


class Bound:
    """Frames of one data folder by name; with ``sharing``, what ``once`` is asked for is written once and read by all that ask again."""

    def __init__(self, spark: SparkSession, sf_dir: str, sharing: bool = False) -> None:
        self.spark, self.sf_dir, self.shared = spark, sf_dir, {} if sharing else None

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self.shared is None:
            return build()
        if name not in self.shared:
            self.shared[name] = settle(build(), name)
        return self.shared[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BINDINGS:
            raise AttributeError(name)
        return frame(self.spark, self.sf_dir, name)
