"""Landed JSON payloads narrowed to columns.

Connectors land raw JSON; here it becomes columns by path, with null where a
path is missing or of another type.  Invalid JSON gives nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    return F.try_parse_json(payload)


def at(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, path, kind)


def answer(provider: Column, payload: Column) -> Column:
    """Answer text of an engine's raw response; engines differ in shape, and unknown ones give null."""
    v = parsed(payload)
    message = at(v, "$.choices[0].message.content")
    return (
        F.when(provider == "openai", F.coalesce(at(v, "$.output_text"), at(v, "$.output[0].content[0].text"), message))
        .when(provider == "gemini", at(v, "$.candidates[0].content.parts[0].text"))
        .when(provider.isin("perplexity", "deepseek"), message)
    )


def cited(provider: Column, payload: Column) -> Column:
    """URLs that an answer cites in its text (not those merely retrieved)."""
    v = parsed(payload)
    urls = lambda path, field: F.transform(at(v, path, "array<variant>"), lambda x: F.try_variant_get(x, field, "string"))
    found = (
        F.when(provider == "perplexity", at(v, "$.citations", "array<string>"))
        .when(provider == "openai", urls("$.output[0].content[0].annotations", "$.url"))
        .when(provider == "gemini", urls("$.candidates[0].groundingMetadata.groundingChunks", "$.web.uri"))
    )
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def retrieved_only(provider: Column, payload: Column) -> Column:
    """URLs that an engine retrieved without citing them."""
    v = parsed(payload)
    found = F.when(provider == "perplexity", F.transform(at(v, "$.search_results", "array<variant>"), lambda x: F.try_variant_get(x, "$.url", "string")))
    return F.array_except(F.coalesce(found, F.array().cast("array<string>")), cited(provider, payload))


def search_rows(payload: Column) -> Column:
    """Rows of a search-analytics response: keys, clicks, impressions, ctr, position."""
    return F.from_json(payload, "rows array<struct<keys array<string>, clicks double, impressions double, ctr double, position double>>")["rows"]


def keyword_metrics(landed: DataFrame) -> DataFrame:
    """``(run_id, payload)`` to a row for each key; rows without a key are dropped."""
    r = landed.select("run_id", F.explode(search_rows(F.col("payload"))).alias("r"))
    key = F.try_element_at("r.keys", F.lit(1))
    return r.where(F.coalesce(key, F.lit("")) != "").select("run_id", key.alias("text"), *[F.coalesce(f"r.{c}", F.lit(0.0)).alias(c) for c in ("clicks", "impressions", "ctr", "position")])


#: what the keys of a search row are, in order, by the dimension that was asked for
DIMENSIONS = {"query": ("query",), "page": ("page",), "queryPage": ("query", "page")}


def search_metrics(landed: DataFrame) -> DataFrame:
    """``(run_id, dimension, payload)`` to query and page (null where the dimension has none) with their numbers; rows without their first key, and unknown dimensions, are dropped."""
    r = landed.select("run_id", "dimension", F.explode(search_rows(F.col("payload"))).alias("r"))

    def key(name: str) -> Column:
        out = F.lit(None).cast("string")
        for dimension, names in DIMENSIONS.items():
            if name in names:
                out = F.when(F.col("dimension") == dimension, F.try_element_at("r.keys", F.lit(names.index(name) + 1))).otherwise(out)
        return out

    first = F.coalesce(F.try_element_at("r.keys", F.lit(1)), F.lit(""))
    numbers = [F.coalesce(f"r.{c}", F.lit(0.0)).alias(c) for c in ("clicks", "impressions", "ctr", "position")]
    return r.where((first != "") & F.col("dimension").isin(*DIMENSIONS)).select("run_id", "dimension", key("query").alias("query"), key("page").alias("page"), *numbers)


def serp_items(landed: DataFrame) -> DataFrame:
    """``(run_id, keyword, payload)`` of result lists to ranked items; a list without items keeps no row."""
    items = F.from_json("payload", "items array<struct<type string, domain string, url string, rank_absolute int, title string>>")["items"]
    i = landed.select("run_id", "keyword", F.explode(items).alias("i"))
    return i.where("i.domain is not null").select("run_id", "keyword", "i.type", "i.domain", "i.url", F.col("i.rank_absolute").alias("item_rank"), "i.title")


def page_speed(landed: DataFrame) -> DataFrame:
    """Field and lab values of a speed report: layout shift is landed in hundredths, scores become percent."""
    v = parsed(F.col("payload"))
    field = lambda name: at(v, f"$.loadingExperience.metrics.{name}.percentile", "double")
    return landed.select(
        "run_id", field("LARGEST_CONTENTFUL_PAINT_MS").alias("lcp_ms"), field("INTERACTION_TO_NEXT_PAINT").alias("inp_ms"), (field("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100).alias("cls"),
        F.floor(at(v, "$.lighthouseResult.categories.performance.score", "double") * 100 + 0.5).cast("int").alias("score"), at(v, "$.lighthouseResult.audits.server-response-time.numericValue", "double").alias("ttfb_ms"),
    )


def json_ld_types(block: Column) -> Column:
    """Types of a JSON-LD block, through ``@graph``; null for invalid JSON."""
    v = parsed(block)
    own = F.coalesce(at(v, "$['@type']", "array<string>"), F.array_compact(F.array(at(v, "$['@type']"))))
    graph = F.transform(F.coalesce(at(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$['@type']", "string"))
    return F.when(v.isNotNull(), F.array_distinct(F.array_compact(F.concat(own, graph))))


def envelope_errors(landed: DataFrame) -> DataFrame:
    """Responses to set aside: HTTP errors, envelope or task codes from 40000 on, and what isn't JSON."""
    v = parsed(F.col("payload"))
    code = F.greatest(F.coalesce(at(v, "$.status_code", "int"), F.lit(0)), F.coalesce(at(v, "$.tasks[0].status_code", "int"), F.lit(0)))
    reason = F.when(F.col("http_status") >= 400, "http").when(v.isNull(), "not json").when(code >= 40000, "envelope")
    return landed.withColumn("reason", reason).where("reason is not null")


def _result(payload: Column, fields: str) -> Column:
    """The first result of the first task of a market-data response."""
    tasks = F.from_json(payload, f"tasks array<struct<result array<struct<{fields}>>>>")["tasks"]
    return F.get(F.get(tasks, F.lit(0))["result"], F.lit(0))


def _domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def keyword_overview(landed: DataFrame) -> DataFrame:
    """``(run_id, payload)`` to search volume, difficulty, price and main intent of each keyword; items without one are dropped."""
    fields = "items array<struct<keyword string, keyword_info struct<search_volume double, cpc double>, keyword_properties struct<keyword_difficulty double>, search_intent_info struct<main_intent string>>>"
    i = landed.select("run_id", F.explode(_result(F.col("payload"), fields)["items"]).alias("i")).where("coalesce(i.keyword, '') <> ''")
    return i.select("run_id", "i.keyword", "i.keyword_info.search_volume", F.col("i.keyword_properties.keyword_difficulty").alias("difficulty"), "i.keyword_info.cpc", F.col("i.search_intent_info.main_intent").alias("intent"))


_LINKS = "referring_domains double, backlinks double, rank double, anchors array<struct<anchor string, backlinks double, count double, dofollow double>>"


def link_summary(landed: DataFrame) -> DataFrame:
    """Referring domains and links of each target (0 where missing) and its rank."""
    r = landed.withColumn("r", _result(F.col("payload"), _LINKS))
    return r.select("run_id", "target", F.coalesce("r.referring_domains", F.lit(0.0)).alias("referring_domains"), F.coalesce("r.backlinks", F.lit(0.0)).alias("backlinks"), F.col("r.rank").alias("rank"))


def link_anchors(landed: DataFrame) -> DataFrame:
    """Anchor texts of each target with their number; those without text or number are dropped."""
    a = landed.select("run_id", "target", F.explode(_result(F.col("payload"), _LINKS)["anchors"]).alias("a"))
    a = a.select("run_id", "target", "a.anchor", F.coalesce("a.backlinks", "a.count").alias("n"), (F.coalesce("a.dofollow", F.lit(0.0)) > 0).alias("dofollow"))
    return a.where("coalesce(anchor, '') <> '' and n is not null")


def ai_overview(landed: DataFrame) -> DataFrame:
    """Whether a result page has an AI overview (its first one counts), its text, and the domains that it refers to."""
    fields = "items array<struct<type string, asynchronous_ai_overview boolean, markdown string, references array<struct<domain string, url string>>>>"
    found = F.get(F.filter(_result(F.col("payload"), fields)["items"], lambda i: i["type"] == "ai_overview"), F.lit(0))
    x = landed.withColumn("i", found)
    domains = F.coalesce(F.transform("i.references", lambda r: r["domain"]), F.array().cast("array<string>"))
    return x.select("run_id", "keyword", F.col("i").isNotNull().alias("present"), F.coalesce("i.asynchronous_ai_overview", F.lit(False)).alias("asynchronous"), F.col("i.markdown").alias("markdown"), domains.alias("domains"))


def engine_index(landed: DataFrame) -> DataFrame:
    """What a ``site:`` result page says of the number of pages that an engine has of a domain."""
    x = landed.withColumn("r", _result(F.col("payload"), "se_results_count double, items array<struct<type string>>"))
    return x.select("run_id", _domain(F.col("domain")).alias("domain"), F.col("r.se_results_count").alias("total"), F.coalesce(F.size("r.items"), F.lit(0)).alias("items"))


def brand_results(landed: DataFrame) -> DataFrame:
    """Of the result page for a brand: whether it has a knowledge panel, and whether the own domain is among items with domain, URL and rank."""
    fields = "items array<struct<type string, domain string, url string, rank_absolute double>>"
    items = F.coalesce(_result(F.col("payload"), fields)["items"], F.array().cast("array<struct<type string, domain string, url string, rank_absolute double>>"))
    panel = F.exists(items, lambda i: F.coalesce(i["type"] == "knowledge_graph", F.lit(False)))
    whole = lambda i: (F.coalesce(i["domain"], F.lit("")) != "") & (F.coalesce(i["url"], F.lit("")) != "") & i["rank_absolute"].isNotNull()
    own = F.exists(items, lambda i: whole(i) & F.coalesce(_domain(i["domain"]) == _domain(F.col("domain")), F.lit(False)))
    return landed.select("run_id", "brand", panel.alias("knowledge_panel"), own.alias("own_present"), F.size(F.filter(items, whole)).alias("items"))


_SEARCH = "searchInformation struct<totalResults string>, items array<struct<title string, link string, snippet string>>"


def site_search(landed: DataFrame) -> DataFrame:
    """Of a ``site:`` search: results in all (null unless a number), those shown, whether the home page is one, and the first link."""
    x = landed.withColumn("p", F.from_json("payload", _SEARCH)).withColumn("links", F.coalesce(F.transform("p.items", lambda i: F.coalesce(i["link"], F.lit(""))), F.array().cast("array<string>")))
    home = lambda u: (F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", "") == _domain(F.col("domain"))) & F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")).isin("", "/")
    return x.select(
        "run_id", "domain", F.try_to_number(F.col("p.searchInformation.totalResults"), F.lit("999999999999999")).cast("double").alias("total"), F.size("links").alias("shown"),
        F.exists("links", lambda u: F.coalesce(home(u), F.lit(False))).alias("home_page"), F.get("links", F.lit(0)).alias("first_url"),
    )


def social_presence(landed: DataFrame) -> DataFrame:
    """Of a search on one platform for a brand: how many results, and the first three links; a failed search counts none."""
    links = F.coalesce(F.transform(F.from_json("payload", _SEARCH)["items"], lambda i: i["link"]), F.array().cast("array<string>"))
    return landed.select("run_id", "platform", F.size(links).alias("results"), F.slice(links, 1, 3).alias("top"))


def site_list(landed: DataFrame) -> DataFrame:
    """The sites of an account; entries without a URL are dropped."""
    sites = F.from_json("payload", "siteEntry array<struct<siteUrl string>>")["siteEntry"]
    return landed.select("account_id", F.explode(sites).alias("s")).where("coalesce(s.siteUrl, '') <> ''").select("account_id", F.col("s.siteUrl").alias("site"))


def crawler_access(probes: DataFrame) -> DataFrame:
    """``(run_id, ua, kind, url, status)``: a status from 400 on blocks; an unknown one (network error) doesn't."""
    return probes.withColumn("blocked", F.coalesce(F.col("status") >= 400, F.lit(False)))


def llms_txt(fetched: DataFrame) -> DataFrame:
    """``(run_id, status, body)``: the file exists if it came with 200 and isn't blank."""
    return fetched.select("run_id", F.coalesce((F.col("status") == 200) & (F.regexp_replace("body", r"\s", "") != ""), F.lit(False)).alias("exists"))


def encyclopedia(landed: DataFrame) -> DataFrame:
    """The first entry that an encyclopedia's search finds for a brand, and its address."""
    title = F.get(F.from_json("payload", "query struct<search array<struct<title string>>>")["query"]["search"], F.lit(0))["title"]
    name = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        name = F.replace(name, F.lit(code), F.lit(char))
    has = F.coalesce(title, F.lit("")) != ""
    return landed.select("run_id", has.alias("exists"), F.when(has, title).alias("title"), F.when(has, F.concat(F.lit("https://en.wikipedia.org/wiki/"), name)).alias("url"))


def forum_mentions(landed: DataFrame, now: Column, window_days: int = 365) -> DataFrame:
    """Posts of a forum search inside the window before ``now`` (seconds); posts without a time count."""
    posts = F.from_json("payload", "data struct<children array<struct<data struct<created_utc double>>>>")["data"]["children"]
    inside = lambda p: F.coalesce(p["data"]["created_utc"] >= now - window_days * 86400, F.lit(True))
    return landed.select("run_id", F.coalesce(F.size(F.filter(posts, inside)), F.lit(0)).alias("mentions"))


def opportunities(landed: DataFrame) -> DataFrame:
    """What a speed report says could be saved: a row for each audit of that kind, titled by its key where it has no title."""
    audits = F.from_json("payload", "lighthouseResult struct<audits map<string, struct<title string, details struct<type string, overallSavingsMs double>>>>")["lighthouseResult"]["audits"]
    a = landed.select("run_id", F.explode(audits).alias("id", "a")).where("a.details.type = 'opportunity'")
    return a.select("run_id", "id", F.coalesce("a.title", "id").alias("title"), F.col("a.details.overallSavingsMs").alias("savings_ms"))
