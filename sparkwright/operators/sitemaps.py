"""Pages that sitemaps list, through indexes of indexes, out of landed files.

The files are looked up level by level, each level in the order of its lists,
as one queue of files would go: what robots.txt names, else ``/sitemap.xml``;
then what the indexes among these name, and so on.  A file is read once,
however often it is named, so cycles end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions.robots import sitemap_urls
from sparkwright.sources.shared import settle


@dataclass(frozen=True)
class Limits:
    """Files and URLs of a run, at most; what lies beyond is counted in a warning."""

    files: int = 10
    urls: int = 5000


def locations(xml: Column) -> Column:
    """Contents of ``<loc>`` elements, also in CDATA; entities, with numbers, are decoded, the ampersand last, and numbers beyond Unicode stay."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))

    def decode(x: Column) -> Column:
        # numbers: the text is cut at each reference, which is decoded by itself
        refs = F.regexp_extract_all(x, F.lit("&#(?:x[0-9a-fA-F]+|[0-9]+);"), F.lit(0))
        rest = F.split(x, "&#(?:x[0-9a-fA-F]+|[0-9]+);")

        def one(ref: Column) -> Column:
            hexa = ref.substr(3, 1) == "x"
            digits = F.when(hexa, F.regexp_extract(ref, "x([0-9a-fA-F]+)", 1)).otherwise(F.regexp_extract(ref, "([0-9]+)", 1))
            bare = F.regexp_replace(digits, "^0+(?=.)", "")
            code = F.when(F.length(bare) <= 7, F.when(hexa, F.conv(bare, 16, 10)).otherwise(bare).cast("long"))
            wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
            return F.when(code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), ref).otherwise(wide)

        plain = F.array_join(F.flatten(F.zip_with(rest, F.concat(F.transform(refs, one), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
        x = F.when(F.size(refs) > 0, plain).otherwise(x)
        for k, v in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}.items():
            x = F.replace(x, F.lit(k), F.lit(v))
        return x

    return F.transform(found, lambda x: decode(F.trim(x)))


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<\s*sitemapindex[\s>]")


def discover(entries: DataFrame, files: DataFrame, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages (run_id, url) and warnings (run_id, warning) of ``entries (run_id, entry_url, robots)`` by landed ``files (run_id, url, status, body)``.

    A file without a row couldn't be fetched.  Other statuses than 200 are
    warned of, but for the address that was only guessed.  Page addresses are
    kept in normal form; those that have none are left out.  There are as many
    levels as files may be read, at most, and each is written once.
    """
    t = limits or Limits()
    named = entries.select("run_id", F.concat(F.regexp_extract("entry_url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/sitemap.xml")).alias("guess"), F.coalesce(sitemap_urls(F.coalesce("robots", F.lit(""))), F.array().cast("array<string>")).alias("told"))
    first = F.when(F.size("told") > 0, F.col("told")).otherwise(F.array("guess"))
    queue = settle(named.select("run_id", F.posexplode(first).alias("place", "url"), F.when(F.size("told") == 0, F.col("guess")).alias("guess")).select("run_id", F.col("place").cast("long").alias("place"), "url", "guess"), "queue")
    landed = files.select("run_id", "url", "status", "body").dropDuplicates(["run_id", "url"])
    read = settle(queue.select("run_id", "url").limit(0), "read")
    pages = settle(queue.select("run_id", "url").limit(0), "pages")
    state = settle(queue.groupBy("run_id").agg(F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("n_urls")), "state")
    warned, before = [], Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    for _ in range(t.files + 1):
        again = Window.partitionBy("run_id", "url").orderBy("place")
        level = queue.withColumn("fresh", F.row_number().over(again) == 1).join(read.withColumn("seen", F.lit(True)), ["run_id", "url"], "left").withColumn("fresh", F.col("fresh") & F.col("seen").isNull()).drop("seen")
        level = level.join(landed.select("run_id", "url", "status", is_index(F.coalesce("body", F.lit(""))).alias("index")), ["run_id", "url"], "left").join(state, "run_id")
        level = level.withColumn("ok", F.col("fresh") & F.coalesce(F.col("status") == 200, F.lit(False)))
        level = settle(level.withColumn("open", F.col("n_files") + F.coalesce(F.sum(F.col("ok").cast("long")).over(before), zero) < t.files), "level")
        texts = level.where("ok and open").join(landed.select("run_id", "url", "body"), ["run_id", "url"]).select("run_id", "place", "index", F.posexplode(locations(F.col("body"))).alias("i", "loc"))
        own = texts.where("not index").select("run_id", "place", "i", E.normalize_url(F.col("loc")).alias("url")).where("url is not null")
        new = settle(own.groupBy("run_id", "url").agg(F.min(F.struct("place", "i")).alias("at")).join(pages, ["run_id", "url"], "left_anti"), "new")
        gained = new.groupBy("run_id", F.col("at.place").alias("place")).agg(F.count("*").alias("gained"))
        full = F.col("n_urls") + F.coalesce(F.sum(F.coalesce("gained", zero)).over(before), zero) >= t.urls
        level = settle(level.join(gained, ["run_id", "place"], "left").withColumn("open", F.col("open") & ~full), "level")
        opened = level.where("open")
        told = F.when(F.col("status").isNull(), F.concat(F.lit("sitemap_fetch_failed:"), F.col("url"))).when((F.col("status") != 200) & ~F.col("url").eqNullSafe(F.col("guess")), F.concat(F.lit("sitemap_http_"), F.col("status").cast("string"), F.lit(":"), F.col("url")))
        warned.append(opened.where("fresh").select("run_id", told.alias("warning")).where("warning is not null"))
        kept = new.join(opened.select("run_id", F.col("place").alias("p")), (F.col("at.place") == F.col("p")) & (new["run_id"] == opened["run_id"])).select(new["run_id"], "url", "at").join(state.select("run_id", "n_urls"), "run_id")
        kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("at"))).where(F.col("n_urls") + F.col("k") <= t.urls)
        pages = settle(pages.union(kept.select("run_id", "url")), "pages")
        read = settle(read.union(opened.where("fresh").select("run_id", "url")), "read")
        state = settle(pages_state(state, opened, pages), "state")
        children = texts.where("index").join(opened.select("run_id", "place", "guess"), ["run_id", "place"]).select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("place", "i")).cast("long").alias("place"), F.col("loc").alias("url"), "guess")
        children = settle(children, "queue")
        done = (F.col("n_files") >= t.files) | (F.col("n_urls") >= t.urls)
        left = level.where("not open").select("run_id").union(children.join(state.where(done), "run_id", "left_semi").select("run_id")).groupBy("run_id").agg(F.count("*").alias("n"))
        warned.append(left.select("run_id", F.concat(F.lit("sitemap_truncated:"), F.col("n").cast("string"), F.lit("_files_unread")).alias("warning")))
        queue = settle(children.join(state.where(~done), "run_id", "left_semi"), "queue")
        if queue.isEmpty():
            break
    out = warned[0]
    for x in warned[1:]:
        out = out.union(x)
    return pages, out


def pages_state(state: DataFrame, opened: DataFrame, pages: DataFrame) -> DataFrame:
    files = opened.where("ok").groupBy("run_id").agg(F.count("*").alias("more"))
    urls = pages.groupBy("run_id").agg(F.count("*").alias("n"))
    return state.join(files, "run_id", "left").join(urls, "run_id", "left").select("run_id", (F.col("n_files") + F.coalesce("more", F.lit(0))).alias("n_files"), F.coalesce("n", F.lit(0)).cast("long").alias("n_urls"))
