"""URL filtering by host and path rules and by mined association rules.

DataFrame functions and Spark's FP-growth only.  URLs that a given rule
decides are labelled examples; FP-growth mines combinations of URL tokens with
a label, confidence and support prune the association rules, and the rest of
the URLs are matched against them through an inverted index that files each
rule under its rarest token.

Tokens that stand in exactly the same labelled URLs are mined as one, as every
combination of them would be frequent; a URL with any of them has that one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import storage

#: sets of tokens whose verdicts may be sent to every executor (some 100 bytes each), and the tasks that a set is dealt over beyond that
MAX_BROADCAST, SALTS = 100_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Params:
    rules: Sequence[Rule]
    min_support: float = 0.01
    min_confidence: float = 0.8
    default: str = "allow"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host_: Column, path_: Column) -> Column:
    return ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)


def pick(rules: Sequence[Rule], host_: Column, path_: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; equally long rules go by name."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(fits(rule, host_, path_), F.lit(value(rule))).otherwise(out)
    return out


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments and their order, whether there is a query or fragment."""
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    extra = F.filter(F.array(F.when(F.instr(url, "?") > 0, F.lit("q:")), F.when(F.instr(url, "#") > 0, F.lit("f:"))), lambda x: x.isNotNull())
    scheme = mark("u:", F.array(F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)))
    return F.array_distinct(F.concat(scheme, mark("h:", F.split(host_, "[.]")), mark("p:", F.split(path_, "/")), extra))


def bundles(labelled: DataFrame, p: Params) -> dict[str, str]:
    """For frequent tokens that stand in exactly the same rows of ``labelled (tokens)``, the least of them.

    At most the mean number of tokens in a row over the least support.  Rows
    are compared by their number and two sums of hashes.
    """
    least = p.min_support * labelled.count()
    row = [F.shiftright(F.xxhash64("tokens", F.lit(i)), 24) for i in (1, 2)]
    held = labelled.select(F.explode("tokens").alias("token"), row[0].alias("a"), row[1].alias("b"))
    tokens = held.groupBy("token").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("n") >= least)
    groups = tokens.groupBy("n", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("same")).where(F.size("same") > 1)
    return {t: r["same"][0] for r in groups.select("same").collect() for t in r["same"]}


def bundled(tokens: Column, same: dict[str, str]) -> Column:
    if not same:
        return tokens
    least = F.create_map(*(F.lit(x) for pair in sorted(same.items()) for x in pair))
    return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(least, t), t)))


def mine(labelled: DataFrame, p: Params) -> DataFrame:
    """Pruned association rules (antecedent, label, confidence, support, rarest) from ``labelled (tokens, label)``.

    A rule goes if a rule with fewer of its tokens gives the same label with at
    least its confidence.  Their number is bounded by the support, not by the
    input.
    """
    schema = "antecedent array<string>, label string, confidence double, support double, rarest string"
    spark = labelled.sparkSession
    if labelled.isEmpty():
        return spark.createDataFrame([], schema)
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("y:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=p.min_support, minConfidence=p.min_confidence).fit(items)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    found = model.associationRules.where(F.col("consequent")[0].startswith("y:"))
    found = found.where(~F.exists("antecedent", lambda x: x.startswith("y:")))
    rules = storage.keep(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 3, 100).alias("label"), "confidence", "support"), "rules")
    # a rule inside another one has its first token among the other's: an equi-join, not all pairs
    less = rules.select(F.col("antecedent").alias("a"), F.col("label").alias("l"), F.col("confidence").alias("c"), F.col("antecedent")[0].alias("first"))
    longer = rules.select("antecedent", "label", "confidence", F.explode("antecedent").alias("token"))
    worse = (F.col("label") == F.col("l")) & (F.col("token") == F.col("first")) & (F.size("a") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("a", "antecedent")) == 0)
    pruned = rules.join(longer.join(less, worse, "left_semi").select("antecedent", "label").distinct(), ["antecedent", "label"], "left_anti")
    rare = pruned.select("*", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent", "label", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    return storage.keep(rare.select("antecedent", "label", "confidence", "support", "rarest"), "pruned")


def judge(pages: DataFrame, params: Params) -> DataFrame:
    """page_id, host, path, rule, verdict and how it came about (``by``: rule, mined, default) of each ``pages`` row.

    A null url, or one without ``://``, has an empty host and path, fits no
    rule and gets the default.  Ties between mined rules go to the greater
    confidence, then support, then label and tokens.  Null and repeated ids
    are rows of their own; other columns are ignored; an empty table gives an
    empty one.
    """
    p = params
    rows = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    given = pick(p.rules, F.col("host"), F.col("path"), lambda r: r.name)
    label = pick(p.rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    has = F.instr(F.coalesce("url", F.lit("")), "://") > 0
    listed = F.when(has, tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("page_id", "host", "path", given.alias("rule"), label.alias("label"), listed.alias("tokens"))
    rows = rows.withColumn("tokens", bundled(F.col("tokens"), bundles(rows.where("label is not null"), p)))
    rules = mine(rows.where("label is not null").select("tokens", "label"), p)

    # the few tokens that rules speak of: bounded by the support, as the rules are
    vocabulary = sorted(r[0] for r in rules.select(F.explode("antecedent")).distinct().collect())
    known = F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, vocabulary)).cast("array<string>")))
    # rows that no mined rule can decide get keys of their own that match nothing, so that they do not meet in one task
    apart = F.array(F.concat(F.lit("\u0000"), F.xxhash64("page_id", "host", "path").cast("string")))
    open_ = F.col("label").isNull() & (F.size(known) > 0)
    keyed = rows.withColumns({"key": F.when(open_, known).otherwise(apart), "open": open_})
    combos = keyed.where("open").select("key").distinct()
    index = rules.withColumnRenamed("label", "mined")
    posted = combos.select("key", F.explode("key").alias("rarest")).join(index, "rarest").where(F.size(F.array_except("antecedent", "key")) == 0)
    order = F.struct("confidence", "support", "mined", F.concat_ws(" ", "antecedent"))
    decided = storage.keep(posted.groupBy("key").agg(F.max_by("mined", order).alias("mined")).withColumnRenamed("key", "_key"), "decided")
    if decided.count() <= MAX_BROADCAST:
        out = keyed.join(F.broadcast(decided), F.col("key") == F.col("_key"), "left")
    else:  # many URLs may share one set of tokens: each set meets them in several tasks
        salted = decided.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")
        out = keyed.withColumn("salt", salt).join(salted, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")), "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", "mined", F.lit(p.default)).alias("verdict"), by.alias("by"))
