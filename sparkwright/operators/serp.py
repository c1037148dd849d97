"""Search results, competitors and keyword gaps.  All keys start with ``run_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E


def domain_dim(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    """A one-column table of a parameter's domains (bounded by the parameter)."""
    return df.sparkSession.createDataFrame([(d,) for d in domains], "domain string")


def competitor_candidates(serp: DataFrame, own: str, top: int = 10, excluded: Sequence[str] = (), shared: int = 5) -> DataFrame:
    """Organic competitors of each run: share of keywords, summed 1 / rank, and their first keywords.

    The share's denominator is all keywords of the run.  Ranks below 1 and
    excluded (platform) domains are ignored.
    """
    named = serp.withColumn("domain", E.norm_domain(F.col("domain")))
    total = named.groupBy("run_id").agg(F.countDistinct("keyword_id").alias("n_keywords"))
    kept = named.where((F.col("domain") != own) & (F.col("item_rank") > 0) & ~F.col("domain").isin(*excluded) & ~F.col("domain").rlike(r"^amazon\.[a-z.]+$"))
    per_keyword = kept.groupBy("run_id", "domain", "keyword_id").agg(F.sum(1 / F.col("item_rank")).alias("w"))
    agg = per_keyword.groupBy("run_id", "domain").agg(F.count("*").alias("shared_keywords"), F.sum("w").alias("weight"))
    order = Window.partitionBy("run_id").orderBy(F.desc("overlap"), F.desc("weight_key"), "domain")
    scored = (
        agg.join(total, "run_id").withColumn("overlap", F.col("shared_keywords") / F.col("n_keywords"))
        .withColumn("weight_key", F.round("weight", 6)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    )
    # first keywords only for the few candidates that remain
    first = Window.partitionBy("run_id", "domain").orderBy("keyword_id")
    keywords = (
        per_keyword.join(scored.select("run_id", "domain"), ["run_id", "domain"]).withColumn("k", F.row_number().over(first))
        .where(F.col("k") <= shared).groupBy("run_id", "domain").agg(F.sort_array(F.collect_list("keyword_id")).alias("top_keywords"))
    )
    joined = scored.join(keywords, ["run_id", "domain"])
    return joined.select("run_id", "place", "domain", "shared_keywords", F.round("overlap", 6).alias("overlap"), F.round("weight", 4).alias("weight"), F.array_join(F.col("top_keywords").cast("array<string>"), ",").alias("top_keywords"))


def best_rank(serp: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Least rank of each wanted domain for each keyword."""
    dim = F.broadcast(domain_dim(serp, domains))
    found = serp.where("item_rank > 0").withColumn("domain", E.norm_domain(F.col("domain"))).join(dim, "domain")
    return found.groupBy("run_id", "keyword_id", "domain").agg(F.min("item_rank").alias("best_rank"))


def opportunity(volume: Column, intent: Column, difficulty: Column) -> Column:
    """0 to 100: log volume (0 if missing) x intent weight x reachability (0.5 if missing)."""
    v = F.when(volume > 0, F.least(F.lit(1.0), F.log10(volume.cast("double") + 1) / F.log10(F.lit(100001.0)))).otherwise(0.0)
    i = E.lookup(F.lower(intent), {"transactional": 1.0, "commercial": 0.9, "informational": 0.5, "navigational": 0.3}, 0.5)
    d = F.when(difficulty.isNull(), 0.5).otherwise((100 - F.least(F.lit(100.0), F.greatest(F.lit(0.0), difficulty.cast("double")))) / 100)
    return E.js_round(v * i * d * 100).cast("long")


def gap_type(own: Column, rivals: Column, top: int = 10, weak: int = 30) -> Column:
    return (
        F.when(own <= top, "winning").when(own.isNull() & (rivals >= 2), "missing")
        .when((own > top) & (own <= weak) & (rivals >= 1), "weak")
    )


#: domains of sites that may be sent to every executor: some 20 MB
BROADCAST_SITES = 200_000


def of_sites(sites: DataFrame) -> DataFrame:
    """``sites (run_id, domain, own)`` with normal domains, once a run (its own where a domain is both), to be joined: broadcast up to a counted limit."""
    named = sites.groupBy("run_id", E.norm_domain(F.col("domain")).alias("domain")).agg(F.bool_or("own").alias("own")).where("domain is not null")
    return named.hint("broadcast") if named.count() <= BROADCAST_SITES else named.hint("merge")


def at_sites(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of ``df (run_id, domain)`` at ``sites (run_id, domain, own)``, with ``own``.

    Rows elsewhere go by a semi-join, which Spark moves below the aggregation or
    join that ``df`` comes from; it moves no join that adds a column.
    """
    wanted = of_sites(sites)
    return df.join(wanted, ["run_id", "domain"], "left_semi").join(wanted, ["run_id", "domain"])


def keyword_gaps(serp: DataFrame, labs: DataFrame, own: str, competitors: Sequence[str], top: int = 10) -> DataFrame:
    """missing / weak / winning keywords with their opportunity; other keywords are dropped.

    One aggregation over the result items; of repeated market data the last
    keyword row counts.
    """
    wanted = F.broadcast(domain_dim(serp, [own, *competitors])).withColumn("own", F.col("domain") == own)
    return _gaps(serp.where("item_rank > 0").withColumn("domain", E.norm_domain(F.col("domain"))).join(wanted, "domain"), labs, top)


def keyword_gaps_of(serp: DataFrame, labs: DataFrame, sites: DataFrame, top: int = 10) -> DataFrame:
    """``keyword_gaps`` of each run against its own ``sites (run_id, domain, own)``; runs without sites have none."""
    return _gaps(serp.where("item_rank > 0").withColumn("domain", E.norm_domain(F.col("domain"))).join(of_sites(sites), ["run_id", "domain"]), labs, top)


def _gaps(named: DataFrame, labs: DataFrame, top: int) -> DataFrame:
    best = named.groupBy("run_id", "keyword_id", "keyword", "domain", "own").agg(F.min("item_rank").alias("r"))
    rival = ~F.col("own") & (F.col("r") <= top)
    per = best.groupBy("run_id", "keyword_id", "keyword").agg(
        F.min(F.when(F.col("own"), F.col("r"))).alias("our_position"),
        F.count(F.when(rival, 1)).alias("rivals"),
        F.min(F.when(rival, F.col("r"))).alias("best_rival"),
    )
    datum = labs.withColumn("key", E.norm_keyword(F.col("keyword"))).groupBy("run_id", "key").agg(F.max_by(F.struct("search_volume", "difficulty", "intent"), "keyword_id").alias("d"))
    typed = per.withColumn("gap_type", gap_type(F.col("our_position"), F.col("rivals"), top)).where("gap_type is not null").withColumn("key", E.norm_keyword(F.col("keyword")))
    out = typed.join(datum, ["run_id", "key"], "left")
    return out.select(
        "run_id", "keyword_id", "keyword", "gap_type", "our_position", "rivals", "best_rival", F.col("d.search_volume").alias("search_volume"), F.col("d.intent").alias("intent"), opportunity(F.col("d.search_volume"), F.col("d.intent"), F.col("d.difficulty")).alias("score")
    )


def top_gaps(gaps: DataFrame, kind: Sequence[str], top: int = 20) -> DataFrame:
    """The ``top`` gaps of each run by score (null last), then keyword."""
    order = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("score"), "keyword")
    return gaps.where(F.col("gap_type").isin(*kind)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def share_of_serp(serp: DataFrame, own: str, competitors: Sequence[str], top: int = 10) -> DataFrame:
    """Items among the first ``top`` by wanted domain: counts of items, not of keywords; absent domains count 0."""
    named = serp.withColumn("domain", E.norm_domain(F.col("domain")))
    dim = domain_dim(serp, [own, *competitors])
    every = named.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, [own, *competitors]))).alias("domain"))
    counts = named.where((F.col("item_rank") > 0) & (F.col("item_rank") <= top)).join(F.broadcast(dim), "domain").groupBy("run_id", "domain").agg(F.count("*").alias("items"))
    return every.join(counts, ["run_id", "domain"], "left").select("run_id", "domain", F.coalesce("items", F.lit(0)).alias("items"), (F.col("domain") == own).alias("own"))


def share_of_serp_of(serp: DataFrame, sites: DataFrame, top: int = 10) -> DataFrame:
    """``share_of_serp`` of each run for its own ``sites (run_id, domain, own)``; domains without an item count 0, runs without results are left out."""
    wanted = of_sites(sites)
    named = serp.where((F.col("item_rank") > 0) & (F.col("item_rank") <= top)).select("run_id", E.norm_domain(F.col("domain")).alias("domain"))
    counts = named.join(wanted, ["run_id", "domain"], "left_semi").groupBy("run_id", "domain").agg(F.count("*").alias("items"))
    runs = serp.select("run_id").distinct()
    return wanted.join(runs, "run_id").join(counts, ["run_id", "domain"], "left").select("run_id", "domain", F.coalesce("items", F.lit(0)).alias("items"), "own")


def seed_keywords(metrics: DataFrame, prompts: DataFrame, brand: str, limit: int = 100) -> DataFrame:
    """Search queries by impressions, then prompts, de-duplicated by normal form, up to ``limit`` a run; texts that contain the brand are left out."""
    wanted = " ".join(brand.lower().split())
    both = metrics.select("run_id", "text", F.lit(0).alias("source"), (-F.col("impressions")).alias("rank")).unionByName(prompts.select("run_id", "text", F.lit(1).alias("source"), F.col("rank").cast("long").alias("rank")))
    keyed = both.withColumn("key", E.norm_keyword(F.col("text"))).where((F.col("key") != "") & ~(F.contains(F.col("key"), F.lit(wanted)) if wanted else F.lit(False)))
    first = keyed.groupBy("run_id", "key").agg(F.min(F.struct("source", "rank", "text")).alias("f")).select("run_id", "key", "f.*")
    order = Window.partitionBy("run_id").orderBy("source", "rank", "text")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("run_id", "place", "text", "source")


def keyword_table(metrics: DataFrame, gaps: DataFrame) -> DataFrame:
    """Full outer join of metrics and gaps by keyword: of several metrics the first counts, of several gaps the last."""
    m = metrics.groupBy("run_id", "keyword_id").agg(F.min_by(F.struct("impressions", "clicks", "avg_pos"), "page_id").alias("m"))
    g = gaps.groupBy("run_id", "keyword_id").agg(F.max_by(F.struct("gap_type", "score"), "keyword").alias("g"))
    return m.join(g, ["run_id", "keyword_id"], "full_outer").select("run_id", "keyword_id", "m.impressions", "m.clicks", "m.avg_pos", "g.gap_type", "g.score")


def avg_position(gsc: DataFrame) -> DataFrame:
    """Impression-weighted position of each run, one decimal, null without impressions."""
    total = F.sum("impressions")
    weighted = F.sum(F.col("avg_pos") * F.col("impressions"))
    return gsc.groupBy("run_id").agg(F.when(total > 0, E.js_round(weighted / total, 1)).alias("avg_position"), total.alias("impressions"))


def query_totals(gsc: DataFrame) -> DataFrame:
    return gsc.groupBy("run_id", "query_id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.avg("avg_pos").alias("position"))


def cannibalization(gsc: DataFrame, min_impressions: int, top: int = 20) -> DataFrame:
    """Queries for which several pages show, by total impressions."""
    per = gsc.where(F.col("impressions") >= min_impressions).groupBy("run_id", "query_id").agg(F.countDistinct("page_id").alias("pages"), F.sum("impressions").alias("impressions"))
    order = Window.partitionBy("run_id").orderBy(F.desc("impressions"), "query_id")
    return per.where("pages >= 2").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def aio_exposure(aio: DataFrame) -> DataFrame:
    """Queries with an AI overview: totals, measured, present, owned, and distinct cited domains."""
    shown = F.col("measured") & F.col("present")
    return aio.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if("measured").alias("measured"), F.count_if(shown).alias("present"), F.count_if(shown & F.col("owned")).alias("owned"), F.countDistinct(F.when(shown, F.col("cited_domain"))).alias("domains")
    )
