"""AI answers: parsing, visibility, share of voice, citations.

``answers`` is (run_id, evidence_id, prompt_id, provider, answer_text), ``parsed``
adds what ``parse`` finds, ``prompts`` is (run_id, prompt_id, branded) and
``citations`` (run_id, evidence_id, prompt_id, cited_url).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions.lexicons import WEB_SEARCH, Lexicon


PLAIN = "[a-z]+"


def sentiment(mine: Column, lex: Lexicon) -> Column:
    """comparison, else negative, else positive without a negation, over ``mine``, the sentences with the brand; else neutral."""
    return (
        F.when(F.exists(mine, lambda s: E.hits_any(s, lex.comparisons, PLAIN)), "comparison")
        .when(F.exists(mine, lambda s: E.hits_any(s, lex.negatives, PLAIN)), "negative")
        .when(F.exists(mine, lambda s: E.hits_any(s, lex.positives, PLAIN) & ~E.hits_any(s, lex.negations, PLAIN)), "positive")
        .otherwise("neutral")
    )


def parse(answers: DataFrame, brand: str, domain: str, aliases: Sequence[str] = (), competitors: Sequence[str] = (), lex: Lexicon | None = None) -> DataFrame:
    """brand_present, competitors, sentiment, hedged and unknown_admission of each answer.

    Hedging counts in the brand's sentences, admissions anywhere.  A null text
    counts as empty.  Only answers with the brand are cut into sentences, once,
    and only its sentences are looked at again.
    """
    lex = lex or Lexicon()
    terms = [brand, *aliases]
    text = F.coalesce("answer_text", F.lit(""))
    present = E.mentions_any(text, terms) | F.contains(F.lower(text), F.lit(domain.lower().removeprefix("www.")))
    named = F.array_compact(F.array(*[F.when(E.mentions(text, c), F.lit(c)) for c in competitors])) if competitors else F.array().cast("array<string>")
    # a sentence holds a term only if the text does; terms of other characters than letters are looked for differently by the two
    alike = all(re.fullmatch(PLAIN, t, re.IGNORECASE) for t in terms)
    some = E.mentions_any(text, terms) if alike else E.hits_any(text, terms, PLAIN) | E.mentions_any(text, terms)
    cut = F.when(some, F.split(text, E.SENTENCE_END)).otherwise(F.array().cast("array<string>"))
    with_brand = lambda has: F.transform(F.filter("_sentences", has), E.trim)
    found = answers.withColumns({"brand_present": present, "competitors": named, "unknown_admission": E.hits_any(text, lex.admissions), "_sentences": cut})
    found = found.withColumns({"_named": with_brand(lambda s: E.mentions_any(s, terms)), **({} if alike else {"_felt": with_brand(lambda s: E.hits_any(s, terms, PLAIN))})})
    feeling = F.when(F.col("brand_present"), sentiment(F.col("_named" if alike else "_felt"), lex)).otherwise("neutral")
    hedged = F.exists("_named", lambda s: E.hits_any(s, lex.hedges))
    return found.withColumns({"sentiment": feeling, "hedged": hedged}).select(*answers.columns, "brand_present", "competitors", "sentiment", "hedged", "unknown_admission")


def web_search(provider: Column, explicit: Column | None = None) -> Column:
    known = E.lookup(provider, WEB_SEARCH, True)
    return known if explicit is None else F.coalesce(explicit, known)


def answer_state(online: Column, cited: Column, hedged: Column, admits: Column) -> Column:
    """What a branded answer rests on: grounded, speculative, unknown, unverified, or undetermined without web search."""
    rest = F.when(hedged, "speculative").when(admits, "unknown")
    return F.when(online & cited, "grounded").otherwise(rest.otherwise(F.when(online, "unverified").otherwise("undetermined")))


def prompt_presence(parsed: DataFrame, prompts: DataFrame) -> DataFrame:
    """A prompt is present if any of its samples has the brand; prompts without samples are not."""
    seen = parsed.groupBy("run_id", "prompt_id").agg(F.bool_or("brand_present").alias("p"), F.count("*").alias("samples"))
    return prompts.join(seen, ["run_id", "prompt_id"], "left").select("run_id", "prompt_id", "branded", F.coalesce("p", F.lit(False)).alias("present"), F.coalesce("samples", F.lit(0)).alias("samples"))


def unbranded_samples(parsed: DataFrame, prompts: DataFrame) -> DataFrame:
    return parsed.join(prompts.where("not branded").select("run_id", "prompt_id"), ["run_id", "prompt_id"], "left_semi")


def share_of_voice(samples: DataFrame, brand: str, competitors: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Percent of samples that name the brand and each competitor, zeros included; equal shares keep the input order.

    One aggregation with a counter for each name, then a row for each.
    """
    names = [brand, *competitors]
    counts = samples.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("brand_present").alias("c0"), *[F.count_if(F.array_contains("competitors", c)).alias(f"c{i}") for i, c in enumerate(competitors, 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.col(f"c{i}").alias("c")) for i, n in enumerate(names)]))
    return counts.select(*by, "n", rows.alias("r")).select(*by, F.col("n").alias("samples"), "r.name", (F.col("r.ordinal") == 0).alias("you"), "r.ordinal", E.js_round(F.col("r.c") / F.col("n") * 100).cast("long").alias("pct"))


def engine_visibility(parsed: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompts seen and with the brand for each engine, all and unbranded only."""
    x = parsed.join(prompts, ["run_id", "prompt_id"], "left").withColumn("open", ~F.coalesce("branded", F.lit(False)))
    p, here = F.col("prompt_id"), F.col("brand_present")
    return x.groupBy("run_id", F.coalesce("provider", F.lit("unknown")).alias("engine")).agg(
        F.countDistinct(F.when(here, p)).alias("prompts_present"), F.countDistinct(p).alias("prompts_total"), F.count("*").alias("samples"),
        F.countDistinct(F.when(here & F.col("open"), p)).alias("unbranded_present"), F.countDistinct(F.when(F.col("open"), p)).alias("unbranded_total"),
    )


def unbranded_presence(presence: DataFrame) -> DataFrame:
    per = presence.where("not branded").groupBy("run_id").agg(F.count_if("present").alias("present"), F.count("*").alias("total"))
    return per.withColumn("wilson_low", F.round(E.wilson_low(F.col("present"), F.col("total")), 6))


def sentiment_breakdown(parsed: DataFrame) -> DataFrame:
    kind = F.coalesce("sentiment", F.lit("neutral"))
    named = ("positive", "negative", "comparison")
    return parsed.where("brand_present").groupBy("run_id").agg(*[F.count_if(kind == k).alias(k) for k in named], F.count_if(~kind.isin(*named)).alias("neutral"), F.count("*").alias("total"))


def with_citations(parsed: DataFrame, citations: DataFrame) -> DataFrame:
    n = citations.groupBy("evidence_id").agg(F.count("cited_url").alias("n_cited"))
    return parsed.join(n, "evidence_id", "left").withColumn("cited", F.coalesce("n_cited", F.lit(0)) > 0)


def branded_states(parsed: DataFrame, prompts: DataFrame, citations: DataFrame) -> DataFrame:
    branded = with_citations(parsed.join(prompts.where("branded").select("run_id", "prompt_id"), ["run_id", "prompt_id"], "left_semi"), citations)
    online = web_search(F.col("provider"))
    state = answer_state(online, F.col("cited"), F.col("hedged"), F.col("unknown_admission"))
    kinds = ("grounded", "speculative", "unknown", "unverified", "undetermined")
    return branded.groupBy("run_id", "provider").agg(F.first(online).alias("web_search"), *[F.count_if(state == k).alias(k) for k in kinds])


def citation_rate(parsed: DataFrame, citations: DataFrame) -> DataFrame:
    """Share of answers by engines with web search that cite something; 0 without such answers."""
    x = with_citations(parsed, citations).groupBy("run_id").agg(F.avg(F.when(web_search(F.col("provider")), F.col("cited").cast("double"))).alias("r"))
    return x.select("run_id", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("citation_rate"))


def cited_hosts(citations: DataFrame, own: str, platforms: dict[str, str] | None = None) -> DataFrame:
    """Host, origin and platform of each citation; what can't be parsed is dropped."""
    x = citations.withColumn("host", E.host(F.col("cited_url"))).where("host is not null")
    return x.withColumns({"origin": E.origin(F.col("host"), F.lit(own)), "platform": E.platform(F.col("host"), platforms)})


def cited_domains(hosts: DataFrame) -> DataFrame:
    return hosts.groupBy("run_id", "host").agg(F.count("*").alias("n"), F.first("origin").alias("origin"), F.first("platform").alias("platform"))


def ugc_share(hosts: DataFrame, prompts: DataFrame) -> DataFrame:
    """Share of unbranded citations on platforms of user contributions; null without citations."""
    open_ = hosts.join(prompts.where("not branded").select("run_id", "prompt_id"), ["run_id", "prompt_id"], "left_semi")
    per = open_.groupBy("run_id").agg(F.count_if(F.col("platform").isin(*E.UGC)).alias("ugc"), F.count("*").alias("n"))
    return prompts.select("run_id").distinct().join(per, "run_id", "left").select("run_id", F.round(E.ratio(F.col("ugc"), F.col("n")), 6).alias("ugc_share"))


def owned_share(hosts: DataFrame) -> DataFrame:
    return hosts.groupBy("run_id").agg(F.round(F.count_if(F.col("origin") == "owned") / F.count("*"), 6).alias("owned_share"))


def sample_evidence(parsed: DataFrame) -> DataFrame:
    """First answer with the brand, else the first answer, by evidence id."""
    return parsed.groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("brand_present"), F.col("evidence_id"))), F.min("evidence_id")).alias("evidence_id"))


def summary(parsed: DataFrame, prompts: DataFrame, citations: DataFrame, own: str) -> DataFrame:
    """One row a run: the headline numbers side by side."""
    presence = prompt_presence(parsed, prompts)
    totals = presence.groupBy("run_id").agg(F.count("*").alias("prompts_total"), F.count_if("present").alias("prompts_present"))
    samples = parsed.groupBy("run_id").agg(F.count("*").alias("total_samples"))
    out = totals.join(samples, "run_id").join(unbranded_presence(presence).withColumnsRenamed({"present": "unbranded_present", "total": "unbranded_total"}), "run_id", "left")
    for part in (citation_rate(parsed, citations), owned_share(cited_hosts(citations, own)), sample_evidence(parsed)):
        out = out.join(part, "run_id", "left")
    return out


def reparse(parsed: DataFrame, before: DataFrame) -> DataFrame:
    """Old and new values of the four columns that a parser change may rewrite, for rows where any differs."""
    fields = ("brand_present", "hedged", "unknown_admission", "sentiment")
    old = before.select("evidence_id", *[F.col(f).alias(f"old_{f}") for f in fields])
    changed = E.any_of([~F.col(f).eqNullSafe(F.col(f"old_{f}")) for f in fields])
    return parsed.join(old, "evidence_id").where(changed).select("run_id", "evidence_id", "provider", *fields, *[f"old_{f}" for f in fields])


def reparse_summary(diff: DataFrame) -> DataFrame:
    """Counts by provider, and over all in the row ``all``."""
    agg = diff.rollup("provider").agg(
        F.count("*").alias("changed"), F.count_if(F.col("brand_present") != F.col("old_brand_present")).alias("brand_flips"), F.count_if(F.col("hedged") & ~F.col("old_hedged")).alias("newly_hedged"), F.count_if(F.col("sentiment") != F.col("old_sentiment")).alias("sentiment_changes")
    )
    return agg.select(F.coalesce("provider", F.lit("all")).alias("provider"), "changed", "brand_flips", "newly_hedged", "sentiment_changes")
