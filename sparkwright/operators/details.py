"""What a hit is about: references, first examples with their true number, pages and keywords.

``rows`` is (rule_id, run_id, scope, kind, ref, example, rank), a row for each
thing that a hit counts; ``kind`` says how the details name it: url, keyword,
query or item.  ``detail`` is a VARIANT of any shape; what is looked for in it
is described at each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.sources.shared import settle

KEYS = ("rule_id", "run_id", "scope")
KINDS = ("url", "keyword", "query", "item")
SHOWN = 10
PAGES = 20


def listed(rows: DataFrame, k: int = SHOWN) -> DataFrame:
    """One row for each hit: kind, total, and the first ``k`` refs and examples by rank (nulls last), example and ref.

    The rows are written once.  Every task keeps the first ``k`` of what it has
    of a hit before any row moves, so a hit with most of the rows is no more
    work for one task than any other.
    """
    rows = settle(rows.select(*KEYS, "kind", "ref", "example", F.col("rank").cast("double").alias("rank")), "listed")
    totals = rows.groupBy(*KEYS, "kind").agg(F.count("*").alias("total"))
    order = [F.asc_nulls_last("rank"), F.asc_nulls_last("example"), F.asc_nulls_last("ref")]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).where(F.col("place") <= k)
    held = first.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("place", "ref", "example"))).alias("r"))
    return totals.join(held, list(KEYS)).select(*KEYS, "kind", "total", F.col("r.ref").alias("refs"), F.col("r.example").alias("examples"))


def detail(kind: Column, total: Column, examples: Column) -> Column:
    """The VARIANT that says it: ``examples[].url``, ``keywords[].text``, ``queries[].query`` or ``items[]``, beside ``total``."""
    each = lambda name: F.transform(examples, lambda x: F.struct(x.alias(name)))
    shape = lambda name, items: F.to_variant_object(F.struct(total.alias("total"), items.alias(name)))
    return (
        F.when(kind == "url", shape("examples", each("url"))).when(kind == "keyword", shape("keywords", each("text")))
        .when(kind == "query", shape("queries", each("query"))).otherwise(shape("items", examples))
    )


def _strings(items: Column, field: str | None) -> Column:
    """The strings among ``items (array<variant>)``, or among their ``field``; other values are null."""
    value = lambda x: x if field is None else F.try_variant_get(x, f"$.{field}", "variant")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.transform(items, lambda x: text(value(x)))


def _is_url(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)^https?://"), F.lit(False))


def _array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


# Where a detail may list pages, and where it may count them.
LISTS = ("blockedUrls", "sampleUrls", "examples")
COUNTS = ("blockedCount", "count", "affectedCount", "pageCount", "affectedPages", "total")


def affected_pages(v: Column, scope: Column) -> tuple[Column, Column]:
    """Number and first 20 of the pages that a hit touches; both null without any.

    The first of the lists that has a URL (a string, or an object's ``url``)
    counts, else the URLs below ``queries[].pages[]``, else the scope itself.
    The number is the first count that is a number, else that of the pages.
    """
    some = lambda a: F.when(F.size(a) > 0, a)

    def in_order(items: Column) -> Column:
        both = F.arrays_zip(_strings(items, None).alias("a"), _strings(items, "url").alias("b"))
        return F.filter(F.transform(both, lambda x: F.when(_is_url(x["a"]), x["a"]).when(_is_url(x["b"]), x["b"])), lambda x: x.isNotNull())

    lists = [some(in_order(_array(v, f"$.{name}"))) for name in LISTS]
    pages = F.flatten(F.filter(F.transform(_array(v, "$.queries"), lambda q: in_order(_array(q, "$.pages"))), lambda x: x.isNotNull()))
    found = F.coalesce(*lists, some(pages), F.when(_is_url(scope), F.array(scope)))
    unique = F.array_distinct(found)
    number = lambda name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{name}", "double"))
    total = F.coalesce(*(number(name) for name in COUNTS), F.size(unique).cast("double"))
    return F.when(unique.isNotNull(), total.cast("long")), F.slice(unique, 1, PAGES)


def metric_targets(hits: DataFrame) -> DataFrame:
    """The keywords that a hit's ``detail`` names, in normal form, once each: ``keywords[].text`` and ``queries[].query``.

    A row for each of ``hits (rule_id, run_id, scope, detail)`` and keyword; hits without keywords have none.
    """
    spark = hits.sparkSession
    parts = []
    for path, field in (("$.keywords", "text"), ("$.queries", "query")):
        items = spark.tvf.variant_explode(F.try_variant_get(F.col("h.detail").outer(), path, "variant"))
        text = F.when(F.schema_of_variant(F.try_variant_get("value", f"$.{field}", "variant")) == "STRING", F.try_variant_get("value", f"$.{field}", "string"))
        parts.append(hits.alias("h").lateralJoin(items).select(*KEYS, F.lower(F.trim(text)).alias("keyword")))
    return parts[0].union(parts[1]).where("keyword is not null").distinct()


def target_metrics(targets: DataFrame, metrics: DataFrame) -> DataFrame:
    """Impressions (their sum) and position (their mean) of each hit's keywords in each run of ``metrics (run_id, keyword, impressions, position)``.

    ``measured_run`` is the run of the numbers; a run without any of the keywords has no row.
    """
    found = metrics.select(F.col("run_id").alias("measured_run"), F.lower(F.trim("keyword")).alias("keyword"), "impressions", "position")
    return targets.join(found, "keyword").groupBy(*KEYS, "measured_run").agg(F.count("*").alias("keywords"), F.sum("impressions").alias("impressions"), F.round(F.avg("position"), 6).alias("position"))
