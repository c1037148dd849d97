"""Rules on what parsed pages hold: titles, headings, structured data, signals of trust, images, links.

``features`` is (run_id, url, entry) and the columns of ``html.page_features``;
``entry`` marks a run's entry page, which rules on titles, descriptions,
headings, signals of trust and early answers judge alone.  All rules of one
call are counted in one aggregation over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions import json_ld

# Hosts that identify an organisation.
AUTHORITY_HOSTS = ("wikidata.org", "linkedin.com", "crunchbase.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com")
ORGANISATIONS = ("Organization", "Brand")


@dataclass(frozen=True)
class Limits:
    """The rule set's own thresholds."""

    title_chars: int = 60
    figures: int = 3
    quote_chars: int = 2
    answer_part: float = 0.3
    missing_alt: float = 0.3
    paragraph_words: float = 150


@dataclass(frozen=True)
class PageRule:
    """A hit for each run where ``fires`` holds over the named aggregates; by default the pages that have ``fault``."""

    rule_id: str
    pillar: str
    severity: str
    claim: str
    fault: Callable[[Limits], Column] | None = None
    aggs: Callable[[Limits], dict[str, Column]] | None = None
    fires: Callable[[dict[str, Column], Limits], Column] = lambda a, _: a["n"] > 0
    measure: Callable[[dict[str, Column]], Column] = lambda a: a["n"] / a["total"]
    scope: str = "site"
    #: judges the entry page alone
    entry: bool = False
    #: the pages to show, where that isn't ``fault``
    shown: Callable[[Limits], Column] | None = None

    def aggregates(self, limits: Limits) -> dict[str, Column]:
        if self.aggs:
            return self.aggs(limits)
        return {"n": F.count_if(self.faulty(limits)), "total": F.count_if("entry") if self.entry else F.count("*")}

    def faulty(self, limits: Limits) -> Column | None:
        """Whether a page has what the rule is about; None where no page is to be shown."""
        found = self.shown or self.fault
        return found and (F.col("entry") & found(limits) if self.entry else found(limits))


def _host(url: Column) -> Column:
    return E.host(url)


def _is_authority(url: Column) -> Column:
    host = _host(url)
    return F.coalesce(host.isin(*AUTHORITY_HOSTS) | E.any_of([host.endswith("." + h) for h in AUTHORITY_HOSTS]), F.lit(False))


def _leads_out(limits: Limits) -> Column:
    return F.exists("links", lambda x: F.coalesce(_host(x) != _host(F.col("url")), F.lit(False)))


def _answers_early(limits: Limits) -> Column:
    early = F.greatest(F.lit(1), F.ceil(F.col("n_paragraphs") * limits.answer_part))
    return F.coalesce(F.col("first_answer") < early, F.lit(False))


def _bad_region(tag: Column) -> Column:
    """A language tag whose region isn't two capital letters when written in the usual way."""
    region = F.regexp_extract(tag, r"^[A-Za-z]{2,3}[-_]([A-Za-z0-9]+)$", 1)
    return (tag != "x-default") & ~tag.rlike(r"^[A-Za-z]{2,3}$") & ~region.rlike(r"^[A-Za-z]{2}$")


_GIVEN = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
RULES: tuple[PageRule, ...] = (
    PageRule("T04", "P1", "mid", "measured_hard", lambda _: F.coalesce(_host(F.col("canonical")) != _host(F.col("url")), F.lit(False))),
    PageRule("T08", "P1", "high", "measured_hard", lambda _: ~F.col("url").startswith("https:") | F.col("mixed_content")),
    PageRule("T13", "P1", "high", "measured_hard", lambda _: ~F.col("viewport")),
    PageRule(
        "T14", "P1", "mid", "measured_hard",
        aggs=lambda _: {"total": F.count_if(F.size("hreflangs") > 0), "n": F.count_if(F.exists("hreflangs", _bad_region)), "fallback": F.count_if(F.array_contains("hreflangs", "x-default"))},
        fires=lambda a, _: (a["total"] > 0) & ((a["n"] > 0) | (a["fallback"] == 0)), measure=lambda a: a["fallback"], shown=lambda _: F.exists("hreflangs", _bad_region),
    ),
    PageRule("C01", "P2", "mid", "measured_hard", lambda t: ~_GIVEN("title") | (F.length("title") > t.title_chars), entry=True),
    PageRule("C02", "P2", "mid", "measured_hard", lambda _: ~_GIVEN("description"), entry=True),
    PageRule("C03", "P2", "mid", "measured_hard", lambda _: (F.col("n_h1") != 1) | F.coalesce(F.col("h1") == F.col("title"), F.lit(False)), entry=True),
    PageRule("C05a", "P2", "ok", "measured_hard", lambda _: F.arrays_overlap("ld_types", F.lit(list(json_ld.DEPRECATED))), measure=lambda a: a["n"], scope="deprecated types"),
    PageRule(
        "C05a", "P2", "ok", "measured_hard", aggs=lambda _: {"n": F.count_if(F.array_contains("ld_types", "Organization"))},
        fires=lambda a, _: a["n"] == 0, measure=lambda a: a["n"], scope="recommended types",
    ),
    PageRule("C05b", "P2", "high", "measured_hard", lambda _: (F.col("ld_invalid") > 0) | (F.col("ld_context") > 0)),
    PageRule("C05c", "P2", "mid", "measured_hard", lambda _: F.size("ld_missing") > 0),
    PageRule("C05d", "P2", "high", "measured_hard", lambda _: F.size("ld_absent") > 0),
    PageRule("C06", "P2", "ok", "inferred", lambda _: ~(F.col("author") & F.col("dated") & F.col("about")), entry=True),
    PageRule("C07", "P2", "mid", "inferred", lambda t: (F.col("figures") < t.figures) | ~_leads_out(t) | (~F.col("quoted") & (F.col("quote_chars") < t.quote_chars)), entry=True),
    PageRule("C08", "P2", "ok", "hypothesis", lambda t: ~_answers_early(t), entry=True),
    PageRule("C09", "P2", "mid", "measured_hard", aggs=lambda _: {"n": F.sum("missing_alt"), "total": F.sum("images")}, fires=lambda a, t: (a["total"] > 0) & (a["n"] > t.missing_alt * a["total"]), shown=lambda _: F.col("missing_alt") > 0),
    PageRule("C11", "P2", "ok", "inferred", lambda t: (F.col("lists") == 0) & (F.col("tables") == 0) & F.coalesce(F.col("mean_paragraph_words") > t.paragraph_words, F.lit(False))),
    PageRule("E01", "P5", "ok", "measured_hard", lambda _: F.arrays_overlap("ld_types", F.lit(list(ORGANISATIONS))) & ~F.exists("ld_same_as", _is_authority), measure=lambda a: F.lit(1), scope="organisation"),
)


def hits(features: DataFrame, rules: Sequence[PageRule] = RULES, limits: Limits | None = None) -> DataFrame:
    """Hits of all ``rules``, counted together: one row for each run and rule that fires."""
    t = limits or Limits()
    named = [(f"a{i}", rule, rule.aggregates(t)) for i, rule in enumerate(rules)]
    per = features.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(*(F.struct(*(c.alias(k) for k, c in aggs.items())).alias(name) for name, _, aggs in named))
    found = []
    for name, rule, aggs in named:
        a = {k: F.col(f"{name}.{k}") for k in aggs}
        row = F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.pillar).alias("pillar"), F.lit(rule.scope).alias("scope"), F.lit(rule.severity).alias("severity"), F.lit(rule.claim).alias("claim"),
            a["n"].cast("long").alias("affected"), F.round(rule.measure(a).cast("double"), 6).alias("measure"),
        )
        found.append(F.when(rule.fires(a, t), row))
    rows = per.select("run_id", F.explode(F.array_compact(F.array(*found))).alias("r"))
    out = rows.select("r.rule_id", "r.pillar", "run_id", "r.scope", "r.severity", "r.claim", "r.affected", "r.measure")
    return out.withColumn("fingerprint", E.fingerprint(F.col("rule_id"), F.col("scope")))
