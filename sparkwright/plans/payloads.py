"""Queries over landed responses, with their SQL.

The responses are written as JSON from the given tables, a batch of at most a
hundred items each, and parsed back; the SQL says what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.sources import payloads as J

NOW, DAY = 1_700_000_000, 86_400


def _rows(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(f"select {sql} from {{{table}}}", **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def _response(*fields) -> Column:
    """A market-data response of one result."""
    return F.to_json(F.struct(F.array(F.struct(F.array(F.struct(*fields)).alias("result"))).alias("tasks")))


def landed_keyword_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as keywords; every 13th item has no keyword."""
    x = _rows(spark, sf_dir, "part", """cast(floor(p_partkey / 100) as bigint) as run_id, named_struct('keyword', case when p_partkey % 13 > 0 then concat('kw', p_partkey) end,
        'keyword_info', named_struct('search_volume', case when p_partkey % 7 > 0 then p_partkey * 10 end, 'cpc', p_size / 4.0D), 'keyword_properties', named_struct('keyword_difficulty', p_size), 'search_intent_info', named_struct('main_intent', p_brand)) as i""")
    landed = x.groupBy("run_id").agg(F.collect_list("i").alias("items")).select("run_id", _response(F.col("items")).alias("payload"))
    return J.keyword_overview(landed)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rows(spark, sf_dir, "supplier", """s_suppkey as run_id, s_name as target, case when s_suppkey % 3 > 0 then s_nationkey * 10 end as referring_domains, s_suppkey * 2 as backlinks, case when s_suppkey % 4 = 0 then s_nationkey end as rank,
        array(named_struct('anchor', s_name, 'backlinks', s_nationkey, 'count', 1, 'dofollow', s_suppkey % 2), named_struct('anchor', '', 'backlinks', 5, 'count', 1, 'dofollow', 1), named_struct('anchor', 'here', 'backlinks', null, 'count', case when s_suppkey % 5 > 0 then s_suppkey end, 'dofollow', null)) as anchors""")
    return x.select("run_id", "target", _response(*map(F.col, ("referring_domains", "backlinks", "rank", "anchors"))).alias("payload"))


def landed_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.link_summary(_links(spark, sf_dir))


def landed_link_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.link_anchors(_links(spark, sf_dir))


def landed_ai_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages with an organic item, and an overview on two of five."""
    x = _rows(spark, sf_dir, "part", """cast(p_partkey % 4 as bigint) as run_id, concat('kw', p_partkey) as keyword, filter(array(named_struct('type', 'organic', 'asynchronous_ai_overview', cast(null as boolean), 'markdown', cast(null as string), 'references', cast(null as array<struct<domain: string, url: string>>)),
        case when p_partkey % 5 < 2 then named_struct('type', 'ai_overview', 'asynchronous_ai_overview', p_partkey % 2 = 0, 'markdown', p_name, 'references', array(named_struct('domain', concat('d', p_size, '.example'), 'url', 'u'))) end), i -> i is not null) as items""")
    return J.ai_overview(x.select("run_id", "keyword", _response(F.col("items")).alias("payload"))).withColumn("domains", F.array_join("domains", ","))


def landed_engine_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rows(spark, sf_dir, "supplier", "s_suppkey as run_id, concat('WWW.S', s_suppkey, '.example') as domain, case when s_suppkey % 4 > 0 then s_suppkey * 3 end as se_results_count, transform(sequence(1, cast(s_suppkey % 3 + 1 as int)), i -> named_struct('type', 'organic')) as items")
    return J.engine_index(x.select("run_id", "domain", _response(F.col("se_results_count"), F.col("items")).alias("payload")))


def landed_brand_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rows(spark, sf_dir, "customer", """c_custkey as run_id, c_name as brand, concat('C', c_custkey, '.example') as domain, array(named_struct('type', case when c_custkey % 3 = 0 then 'knowledge_graph' else 'organic' end, 'domain', cast(null as string), 'url', 'u', 'rank_absolute', 1),
        named_struct('type', 'organic', 'domain', concat('www.c', c_custkey - c_custkey % 2, '.EXAMPLE'), 'url', case when c_custkey % 5 > 0 then 'u' end, 'rank_absolute', 2)) as items""")
    return J.brand_results(x.select("run_id", "brand", "domain", _response(F.col("items")).alias("payload")))


def landed_site_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host as the results of a search for it; the home page is added on every third."""
    x = _rows(spark, sf_dir, "pages", """page_id as run_id, regexp_extract(url, '://([^/?#]+)', 1) as domain, case page_id % 4 when 0 then 'many' when 1 then null else cast(page_id * 7 as string) end as total,
        case when page_id % 3 = 0 then array(named_struct('title', 't', 'link', url), named_struct('title', 'h', 'link', concat('https://', regexp_extract(url, '://([^/?#]+)', 1), '/'))) when page_id % 3 = 1 then array(named_struct('title', 't', 'link', url)) end as items""")
    return J.site_search(x.select("run_id", "domain", F.to_json(F.struct(F.struct(F.col("total").alias("totalResults")).alias("searchInformation"), "items")).alias("payload")))


def landed_social_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rows(spark, sf_dir, "customer", "c_custkey as run_id, c_mktsegment as platform, case when c_custkey % 6 > 0 then transform(sequence(1, cast(c_custkey % 6 as int)), i -> named_struct('title', 't', 'link', concat('l', i))) end as items, c_custkey % 17 = 0 as failed")
    landed = x.select("run_id", "platform", F.when(F.col("failed"), F.lit("<html>busy</html>")).otherwise(F.to_json(F.struct("items"))).alias("payload"))
    return J.social_presence(landed).withColumn("top", F.array_join("top", ","))


def landed_site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rows(spark, sf_dir, "customer", "c_custkey as account_id, array(named_struct('siteUrl', concat('https://c', c_custkey, '.example/')), named_struct('siteUrl', case when c_custkey % 2 = 0 then concat('sc-domain:c', c_custkey) else '' end)) as siteEntry")
    return J.site_list(x.select("account_id", F.to_json(F.struct("siteEntry")).alias("payload")))


def landed_crawler_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page asked for by two crawlers; one answer in eleven got lost."""
    x = _rows(spark, sf_dir, "pages", "page_id as run_id, url, explode(array(named_struct('ua', 'searchbot', 'kind', 'search', 'k', 3), named_struct('ua', 'trainbot', 'kind', 'training', 'k', 7))) as c")
    status = F.expr("case when page % 11 = 0 then null when page % 5 = 0 then 403 when page % 7 = 0 then 429 when page % 3 = 0 then 301 else 200 end")
    return J.crawler_access(x.withColumn("page", F.col("run_id") + F.col("c.k")).select("run_id", "c.ua", "c.kind", "url", status.alias("status")))


def landed_llms_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.llms_txt(_rows(spark, sf_dir, "pages", "page_id as run_id, case when page_id % 3 = 0 then 404 when page_id % 7 > 0 then 200 end as status, case when page_id % 5 = 0 then ' \\n ' else url end as body"))


def landed_encyclopedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rows(spark, sf_dir, "customer", "c_custkey as run_id, case when c_custkey % 3 > 0 then array(named_struct('title', concat('It''s (', c_mktsegment, ') & co ', c_custkey)), named_struct('title', 'z')) else array() end as search")
    return J.encyclopedia(x.select("run_id", F.to_json(F.struct(F.struct("search").alias("query"))).alias("payload")))


def landed_forum_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by age in days, some without a time."""
    x = _rows(spark, sf_dir, "customer", f"c_custkey as run_id, transform(sequence(1, cast(c_custkey % 9 + 1 as int)), i -> named_struct('data', named_struct('created_utc', case when (c_custkey + i) % 4 = 0 then null else {NOW} - ((c_custkey * i) % 700) * {DAY} end))) as children")
    landed = x.select("run_id", F.when(F.col("run_id") % 19 == 0, F.lit("")).otherwise(F.to_json(F.struct(F.struct("children").alias("data")))).alias("payload"))
    return J.forum_mentions(landed, F.lit(NOW))


def landed_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as audits of a report, one report an order; odd lines aren't opportunities."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("quantity"))
    x = lines.selectExpr("l_orderkey as run_id", "concat('audit-', l_linenumber) as id", "named_struct('title', case when l_linenumber % 3 > 0 then concat('title ', l_linenumber) end, 'details', named_struct('type', case when l_linenumber % 2 = 0 then 'opportunity' else 'table' end, 'overallSavingsMs', quantity)) as a")
    audits = F.map_from_entries(F.collect_list(F.struct("id", "a")))  # at most seven lines an order
    landed = x.groupBy("run_id").agg(audits.alias("audits")).select("run_id", F.to_json(F.struct(F.struct("audits").alias("lighthouseResult"))).alias("payload"))
    return J.opportunities(landed)


def _text(*parts) -> Column:
    """JSON written out, of literal pieces and columns."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed_page_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites; a third has no interaction value."""
    k = F.col("s_suppkey")
    inp = F.when(k % 3 > 0, _text(',"INTERACTION_TO_NEXT_PAINT":{"percentile":', k * 5, "}")).otherwise("")
    body = _text(
        '{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":', k * 61, '},"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":', k % 40, "}", inp,
        '}},"lighthouseResult":{"categories":{"performance":{"score":', (k % 101) / 100, '}},"audits":{"server-response-time":{"numericValue":', k * 17, "}}}}",
    )
    return J.page_speed(_table(spark, sf_dir, "supplier").select(k.alias("run_id"), body.alias("payload")))


def landed_search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as search rows of three dimensions and an unknown one; every 11th row has no key."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("query", "page", "queryPage", "device"))), (k % 4 + 1).cast("int"))
    keys = F.when(k % 11 == 0, "[]").when(k % 4 == 1, _text('["https://x.example/', k, '"]')).otherwise(_text('["kw ', k, '","https://x.example/', k, '"]'))
    row = _text('{"keys":', keys, ',"clicks":', k % 7, ',"impressions":', k * 3, F.when(k % 5 > 0, _text(',"position":', k % 50)).otherwise(""), "}")
    rows = _table(spark, sf_dir, "part").groupBy(F.floor(k / 100).alias("run_id"), kind.alias("dimension")).agg(F.array_join(F.collect_list(row), ",").alias("rows"))
    return J.search_metrics(rows.select("run_id", "dimension", _text('{"rows":[', F.col("rows"), "]}").alias("payload")))


def landed_result_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of three items for each part, the second without a domain in one of four, and lists without items."""
    k = F.col("p_partkey")
    second = F.when(k % 4 > 0, _text(',"domain":"d', k % 9, '.example"')).otherwise("")
    items = _text('{"type":"organic","domain":"www.s', k % 5, '.example","url":"https://s/', k, '","rank_absolute":1,"title":"T"},{"type":"video"', second, ',"rank_absolute":2},{"type":"organic","domain":"x.example","rank_absolute":"3"}')
    body = F.when(k % 10 == 0, '{"items":[]}').when(k % 10 == 1, "{}").otherwise(_text('{"items":[', items, "]}"))
    return J.serp_items(_table(spark, sf_dir, "part").select((k % 4).alias("run_id"), _text("kw", k).alias("keyword"), body.alias("payload")))


def landed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers of four engines in their own shapes; one of nine isn't JSON."""
    k = F.col("doc_id")
    quoted = F.to_json(F.array("text"), {"ignoreNullFields": "false"})
    t = F.expr("substring(j, 2, length(j) - 2)")
    provider = F.element_at(F.array(*map(F.lit, ("openai", "perplexity", "gemini", "deepseek"))), (k % 4 + 1).cast("int"))
    body = (
        F.when(k % 9 == 0, "502 Bad Gateway")
        .when(k % 4 == 0, _text('{"output":[{"content":[{"text":', t, ',"annotations":[{"url":"https://a/', k, '"},{"url":"https://b"},{"type":"note"}]}]}]}'))
        .when(k % 4 == 1, _text('{"choices":[{"message":{"content":', t, '}}],"citations":["https://c","https://c"],"search_results":[{"url":"https://c"},{"url":"https://r/', k, '"}]}'))
        .when(k % 4 == 2, _text('{"candidates":[{"content":{"parts":[{"text":', t, '}]},"groundingMetadata":{"groundingChunks":[{"web":{"uri":"https://g"}}]}}]}'))
        .otherwise(_text('{"choices":[{"message":{"content":', t, "}}]}"))
    )
    x = _table(spark, sf_dir, "documents").select("doc_id", quoted.alias("j")).select(k.alias("evidence_id"), provider.alias("provider"), body.alias("payload"))
    p, v = F.col("provider"), F.col("payload")
    return x.select("evidence_id", "provider", J.answer(p, v).alias("answer"), F.array_join(J.cited(p, v), " ").alias("cited"), F.array_join(J.retrieved_only(p, v), " ").alias("retrieved"))


def landed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' responses: whole ones, and errors of the transport, of the envelope, of a task, and texts that aren't JSON."""
    k = F.col("s_suppkey")
    body = F.when(k % 6 == 1, '{"status_code":40100,"tasks":[]}').when(k % 6 == 2, _text('{"status_code":20000,"tasks":[{"status_code":', k + 40000, "}]}")).when(k % 6 == 3, "<html>busy").otherwise('{"status_code":20000,"tasks":[{"status_code":20000}]}')
    x = _table(spark, sf_dir, "supplier").select(k.alias("run_id"), F.when(k % 6 == 5, 503).otherwise(200).alias("http_status"), body.alias("payload"))
    return J.envelope_errors(x).select("run_id", "http_status", "reason")


QUERIES = (
    landed_page_speed, landed_search_metrics, landed_result_lists, landed_answers, landed_errors,
    landed_keyword_overview, landed_link_summary, landed_link_anchors, landed_ai_overview, landed_engine_index, landed_brand_results, landed_site_search, landed_social_presence, landed_site_list, landed_crawler_access,
    landed_llms_txt, landed_encyclopedia, landed_forum_mentions, landed_opportunities,
)
_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"
ORACLES = {
    "landed_page_speed": "select s_suppkey as run_id, s_suppkey * 61.0::double as lcp_ms, case when s_suppkey % 3 > 0 then s_suppkey * 5.0::double end as inp_ms, (s_suppkey % 40) / 100.0::double as cls, cast(s_suppkey % 101 as integer) as score, s_suppkey * 17.0::double as ttfb_ms from supplier",
    "landed_search_metrics": "select p_partkey // 100 as run_id, ['query', 'page', 'queryPage'][p_partkey % 4 + 1] as dimension, case when p_partkey % 4 in (0, 2) then 'kw ' || p_partkey end as query, case when p_partkey % 4 in (1, 2) then 'https://x.example/' || p_partkey end as page, (p_partkey % 7)::double as clicks, (p_partkey * 3)::double as impressions, 0::double as ctr, case when p_partkey % 5 > 0 then (p_partkey % 50)::double else 0 end as position from part where p_partkey % 11 > 0 and p_partkey % 4 < 3",
    "landed_result_lists": """with p as (select *, p_partkey % 4 as run_id, 'kw' || p_partkey as keyword from part where p_partkey % 10 > 1) select run_id, keyword, 'organic' as type, 'www.s' || (p_partkey % 5) || '.example' as domain, 'https://s/' || p_partkey as url, 1 as item_rank, 'T' as title from p
union all select run_id, keyword, 'video', 'd' || (p_partkey % 9) || '.example', null, 2, null from p where p_partkey % 4 > 0 union all select run_id, keyword, 'organic', 'x.example', null, null, null from p""",
    "landed_answers": """select doc_id as evidence_id, ['openai', 'perplexity', 'gemini', 'deepseek'][doc_id % 4 + 1] as provider, case when doc_id % 9 > 0 then text end as answer,
 case when doc_id % 9 = 0 then '' else ['https://a/' || doc_id || ' https://b', 'https://c', 'https://g', ''][doc_id % 4 + 1] end as cited, case when doc_id % 9 > 0 and doc_id % 4 = 1 then 'https://r/' || doc_id else '' end as retrieved from documents""",
    "landed_errors": "select s_suppkey as run_id, cast(case when s_suppkey % 6 = 5 then 503 else 200 end as integer) as http_status, case s_suppkey % 6 when 5 then 'http' when 3 then 'not json' else 'envelope' end as reason from supplier where s_suppkey % 6 in (1, 2, 3, 5)",
    "landed_keyword_overview": "select cast(p_partkey // 100 as bigint) as run_id, 'kw' || p_partkey as keyword, case when p_partkey % 7 > 0 then p_partkey * 10::double end as search_volume, p_size::double as difficulty, p_size / 4.0::double as cpc, p_brand as intent from part where p_partkey % 13 > 0",
    "landed_link_summary": "select s_suppkey as run_id, s_name as target, case when s_suppkey % 3 > 0 then s_nationkey * 10 else 0 end::double as referring_domains, s_suppkey * 2::double as backlinks, case when s_suppkey % 4 = 0 then s_nationkey end::double as rank from supplier",
    "landed_link_anchors": "select s_suppkey as run_id, s_name as target, s_name as anchor, s_nationkey::double as n, s_suppkey % 2 = 1 as dofollow from supplier union all select s_suppkey, s_name, 'here', s_suppkey::double, false from supplier where s_suppkey % 5 > 0",
    "landed_ai_overview": "select cast(p_partkey % 4 as bigint) as run_id, 'kw' || p_partkey as keyword, p_partkey % 5 < 2 as present, p_partkey % 5 < 2 and p_partkey % 2 = 0 as asynchronous, case when p_partkey % 5 < 2 then p_name end as markdown, case when p_partkey % 5 < 2 then 'd' || p_size || '.example' else '' end as domains from part",
    "landed_engine_index": "select s_suppkey as run_id, 's' || s_suppkey || '.example' as domain, case when s_suppkey % 4 > 0 then s_suppkey * 3 end::double as total, cast(s_suppkey % 3 + 1 as integer) as items from supplier",
    "landed_brand_results": "select c_custkey as run_id, c_name as brand, c_custkey % 3 = 0 as knowledge_panel, c_custkey % 2 = 0 and c_custkey % 5 > 0 as own_present, case when c_custkey % 5 > 0 then 1 else 0 end as items from customer",
    "landed_site_search": f"select page_id as run_id, {_HOST} as domain, case when page_id % 4 >= 2 then page_id * 7 end::double as total, case page_id % 3 when 0 then 2 when 1 then 1 else 0 end as shown, page_id % 3 = 0 or (page_id % 3 = 1 and regexp_matches(url, '^[a-z]+://[^/?#]+/?([?#]|$)')) as home_page, case when page_id % 3 < 2 then url end as first_url from pages",
    "landed_social_presence": "select c_custkey as run_id, c_mktsegment as platform, case when c_custkey % 17 = 0 then 0 else c_custkey % 6 end::integer as results, case when c_custkey % 17 = 0 then '' else case c_custkey % 6 when 0 then '' when 1 then 'l1' when 2 then 'l1,l2' else 'l1,l2,l3' end end as top from customer",
    "landed_site_list": "select c_custkey as account_id, 'https://c' || c_custkey || '.example/' as site from customer union all select c_custkey, 'sc-domain:c' || c_custkey from customer where c_custkey % 2 = 0",
    "landed_crawler_access": "with x as (select page_id as run_id, c.ua, c.kind, url, page_id + c.k as p from pages cross join (values ('searchbot', 'search', 3), ('trainbot', 'training', 7)) c(ua, kind, k)) select run_id, ua, kind, url, case when p % 11 = 0 then null when p % 5 = 0 then 403 when p % 7 = 0 then 429 when p % 3 = 0 then 301 else 200 end as status, p % 11 > 0 and (p % 5 = 0 or p % 7 = 0) as blocked from x",
    "landed_llms_txt": "select page_id as run_id, page_id % 3 > 0 and page_id % 7 > 0 and page_id % 5 > 0 as exists from pages",
    "landed_encyclopedia": "select c_custkey as run_id, c_custkey % 3 > 0 as exists, case when c_custkey % 3 > 0 then 'It''s (' || c_mktsegment || ') & co ' || c_custkey end as title, case when c_custkey % 3 > 0 then 'https://en.wikipedia.org/wiki/It''s_(' || c_mktsegment || ')_%26_co_' || c_custkey end as url from customer",
    "landed_forum_mentions": f"select c_custkey as run_id, case when c_custkey % 19 = 0 then 0 else len(list_filter(range(1, c_custkey % 9 + 2), lambda i: (c_custkey + i) % 4 = 0 or (c_custkey * i) % 700 <= 365)) end::integer as mentions from customer",
    "landed_opportunities": "select l_orderkey as run_id, 'audit-' || l_linenumber as id, case when l_linenumber % 3 > 0 then 'title ' else 'audit-' end || l_linenumber as title, max(l_quantity)::double as savings_ms from lineitem where l_linenumber % 2 = 0 group by l_orderkey, l_linenumber",
}
