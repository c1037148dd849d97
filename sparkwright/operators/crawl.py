"""Link graphs, URL templates and site audits.  Keys start with ``run_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.sources.shared import settle


def templates(pages: DataFrame, siblings: int = 3) -> DataFrame:
    """``pattern`` of each page: ids and dates replaced, and the last segment too where its parent has several literal ones."""
    path = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    base = pages.withColumn("base", E.url_template(path))
    tail, parent = F.element_at(F.split("base", "/"), -1), F.regexp_replace("base", "/[^/]*$", "")
    split_ = base.withColumns({"tail": tail, "parent": parent}).withColumn("literal", (F.col("tail") != "") & ~F.startswith("tail", F.lit("{")))
    wide = split_.where("literal").groupBy("run_id", "parent").agg(F.countDistinct("tail").alias("tails")).where(F.col("tails") >= siblings).select("run_id", "parent", F.lit(True).alias("many"))
    slug = F.col("literal") & F.coalesce("many", F.lit(False))
    return split_.join(wide, ["run_id", "parent"], "left").withColumn("pattern", F.when(slug, F.concat("parent", F.lit("/{slug}"))).otherwise(F.col("base"))).select(*pages.columns, "pattern")


def representatives(templated: DataFrame) -> DataFrame:
    """Page of each template with the lower median text length among healthy pages, else its first page."""
    order = Window.partitionBy("run_id", "pattern").orderBy("text_chars", "page_id")
    n = Window.partitionBy("run_id", "pattern")
    healthy = templated.where("http_status = 200").withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(n))
    median = healthy.where(F.col("i") == F.floor((F.col("n") - 1) / 2) + 1).select("run_id", "pattern", F.col("page_id").alias("median_page"))
    every = templated.groupBy("run_id", "pattern").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))
    return every.join(median, ["run_id", "pattern"], "left").select("run_id", "pattern", "pages", F.coalesce("median_page", "first_page").alias("representative"))


def inbound(links: DataFrame) -> DataFrame:
    """Pages that link to each target; repeated links of a page count once."""
    return links.groupBy("run_id", "target_id").agg(F.countDistinct("source_id").alias("inbound"))


def audit_stats(pages: DataFrame) -> DataFrame:
    """Counters of a site audit in one pass."""
    checked, s = ~F.col("blocked"), F.col("http_status")
    return pages.groupBy("run_id").agg(
        F.count("*").alias("discovered"), F.count_if(checked).alias("checked"), F.count_if(checked & s.between(400, 499)).alias("http_4xx"), F.count_if(checked & (s >= 500)).alias("http_5xx"),
        F.count_if("blocked").alias("blocked"), F.count_if(checked & F.col("noindex")).alias("noindex"), F.count_if(checked & F.col("canonical_off")).alias("canonical_off"),
        F.count_if(checked & F.col("in_sitemap") & (F.col("inbound") == 0)).alias("orphans"),
    )


METRICS = ("discovered", "checked", "http_4xx", "http_5xx", "noindex", "canonical_off", "orphans")


def audit_diff(stats: DataFrame) -> DataFrame:
    """Each metric of a run beside that of the run before, as rows."""
    long = lambda df: df.select("run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("r")).select("run_id", "r.*")
    now, old = long(stats), long(stats).select((F.col("run_id") + 1).alias("run_id"), "metric", F.col("value").alias("baseline"))
    return old.join(now, ["run_id", "metric"]).select("run_id", "metric", "baseline", F.col("value").alias("retest"), (F.col("value") - F.col("baseline")).alias("delta"))


def template_diff(templated: DataFrame) -> DataFrame:
    """Patterns that a run has and the run before had not, and the reverse."""
    p = templated.select("run_id", "pattern").distinct()
    before = p.select((F.col("run_id") + 1).alias("run_id"), "pattern")
    runs = p.select("run_id").distinct().join(before.select("run_id").distinct(), "run_id", "left_semi")
    new = p.join(runs, "run_id", "left_semi").join(before, ["run_id", "pattern"], "left_anti").withColumn("change", F.lit("new"))
    gone = before.join(runs, "run_id", "left_semi").join(p, ["run_id", "pattern"], "left_anti").withColumn("change", F.lit("removed"))
    return new.union(gone)


def breadth_first(links: DataFrame, entries: DataFrame, max_depth: int = 3, max_pages: int = 200) -> DataFrame:
    """Depth of each page reached from ``entries (run_id, page)``, up to ``max_depth`` and the first ``max_pages`` of a run by depth and page.

    The crawl's limits are its definition.  One join and anti-join for each
    level, as many as ``max_depth``; every level is cut to what is left of the
    run's pages, as later levels come after it, and written once, so that the
    next one neither expands more than ``max_pages`` nor computes it again.
    """
    edges = links.select("run_id", F.col("source_id").alias("page"), F.col("target_id").alias("next")).distinct()
    order = Window.partitionBy("run_id").orderBy("page")

    def cut(level: DataFrame, taken: DataFrame) -> DataFrame:
        """The first pages of the level, with their places after those ``taken (run_id, n)``."""
        first = level.withColumn("i", F.row_number().over(order)).where(F.col("i") <= max_pages).join(taken, "run_id", "left")
        return settle(first.select("run_id", "page", (F.col("i") + F.coalesce("n", F.lit(0))).cast("int").alias("place")).where(F.col("place") <= max_pages), "level")

    level = cut(entries.select("run_id", "page").distinct(), links.sparkSession.createDataFrame([], "run_id long, n long"))
    seen = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        taken = seen.groupBy("run_id").agg(F.count("*").alias("n"))
        level = cut(level.join(edges, ["run_id", "page"]).select("run_id", F.col("next").alias("page")).distinct().join(seen, ["run_id", "page"], "left_anti"), taken)
        seen = seen.union(level.withColumn("depth", F.lit(depth)))
    return seen.select("run_id", "page", "depth", "place")


def frontier(links: DataFrame, entries: DataFrame, seeds: DataFrame, blocked: DataFrame, max_depth: int = 3, max_pages: int = 200) -> DataFrame:
    """A crawl from ``entries`` and the sitemap's ``seeds``, past pages that robots.txt ``blocks``; all (run_id, page).

    Pages come in the order entry, seeds, then by depth and page.  A blocked
    page is recorded, but neither followed nor counted against ``max_pages``;
    pages after that many fetched ones don't appear, and no level goes on from them.  Links of seeds have
    depth 1, seeds themselves a null depth.  ``via`` is entry, sitemap, crawl,
    or both for a seed that a fetched page links to.
    """
    edges = links.select("run_id", F.col("source_id").alias("page"), F.col("target_id").alias("next")).distinct()
    closed = blocked.select("run_id", "page").distinct()
    first = entries.select("run_id", "page").distinct()
    listed = seeds.select("run_id", "page").distinct().join(first, ["run_id", "page"], "left_anti")
    before = Window.partitionBy("run_id").orderBy("step", "page").rowsBetween(Window.unboundedPreceding, -1)

    def cut(level: DataFrame, taken: DataFrame) -> DataFrame:
        """The level's pages that come before the run's last fetched one, and whether each is fetched."""
        known = level.join(closed.withColumn("closed", F.lit(True)), ["run_id", "page"], "left").withColumn("fetched", F.col("closed").isNull()).drop("closed").join(taken, "run_id", "left")
        n = F.coalesce(F.sum(F.col("fetched").cast("int")).over(before), F.lit(0)) + F.coalesce("taken", F.lit(0))
        return settle(known.withColumn("n", n).where(F.col("n") < max_pages).drop("n", "taken"), "level")

    nothing = links.sparkSession.createDataFrame([], "run_id long, taken long")
    level = reached = cut(first.selectExpr("*", "0 as step", "0 as depth").union(listed.selectExpr("*", "1 as step", "cast(null as int) as depth")), nothing)
    for depth in range(1, max_depth + 1):
        linked = level.where("fetched").join(edges, ["run_id", "page"]).select("run_id", F.col("next").alias("page")).distinct().join(reached, ["run_id", "page"], "left_anti")
        level = cut(linked.selectExpr("*", f"{depth + 1} as step", f"{depth} as depth"), reached.groupBy("run_id").agg(F.count_if("fetched").alias("taken")))
        reached = reached.union(level)
    targets = reached.where("fetched").join(edges, ["run_id", "page"]).select("run_id", F.col("next").alias("page")).distinct().withColumn("linked", F.lit(True))
    via = F.when(F.col("step") == 0, "entry").when(F.col("step") > 1, "crawl").when(F.col("linked"), "both").otherwise("sitemap")
    return reached.join(targets, ["run_id", "page"], "left").select("run_id", "page", "depth", via.alias("via"), F.when(F.col("fetched"), "fetched").otherwise("blocked").alias("status"))


def duplicate_groups(pages: DataFrame) -> DataFrame:
    """Non-empty content hashes that several pages of a run share."""
    return pages.where("content_hash <> ''").groupBy("run_id", "content_hash").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages >= 2")
