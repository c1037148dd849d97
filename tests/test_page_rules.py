"""Rules on parsed pages: at, above and below each threshold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import html as H
from sparkwright.functions import json_ld
from sparkwright.operators import page_rules as G
from sparkwright.operators import recommendations
from sparkwright.operators import rules as R
from sparkwright.plans import rules as plans

GOOD = (
    '<html><head><title>{title}</title><meta name="viewport" content="w"><meta name="description" content="d"><link rel="canonical" href="https://www.a.example/x">'
    '<link rel="alternate" hreflang="en-US" href="/"><link rel="alternate" hreflang="x-default" href="/">{head}</head>'
    '<body><h1>Head</h1><p>{answer}</p>{body}<ul><li>l</li></ul><span class="post-author">A</span><time>May</time><a href="/about-us">us</a><a href="https://b.example/">b</a><q>said</q> 1 2 3</body></html>'
)


def page(title="T", head="", body="", answer="x" * 40, base=GOOD):
    return base.format(title=title, head=head, body=body, answer=answer)


def ld(text):
    return f'<script type="application/ld+json">{text}</script>'


ORG = '{"@context": "https://schema.org", "@type": "Organization", "name": "Head", "sameAs": "https://uk.linkedin.com/in"}'
CASES = [
    ("T04", page(), page(base=GOOD.replace("www.a.example", "other.example"))),
    ("T08", page(), page(body='<img src="http://a.example/i.png" alt="a">')),
    ("T13", page(), page(base=GOOD.replace("viewport", "other"))),
    ("T14", page(), page(head='<link rel="alternate" hreflang="en-123" href="/">')),
    ("T14", page(base=GOOD.replace("hreflang", "lang")), page(base=GOOD.replace("x-default", "de"))),
    ("C01", page("t" * 60), page("t" * 61)),
    ("C01", page("t"), page(" ")),
    ("C02", page(), page(base=GOOD.replace('content="d"', 'content=" "'))),
    ("C03", page("Other"), page("Head")),
    ("C03", page(), page(body="<h1>Second</h1>")),
    ("C05b", page(head=ld(ORG)), page(head=ld("{broken"))),
    ("C05b", page(head=ld('[{"@context": {"@vocab": "http://schema.org/"}, "@type": "X"}]')), page(head=ld('{"@type": "X"}'))),
    ("C05c", page(head=ld('{"@context": "https://schema.org", "@type": "Product", "name": "Head", "image": "i"}')), page(head=ld('{"@context": "https://schema.org", "@type": ["Product"], "name": " ", "image": []}'))),
    ("C05c", page(head=ld('{"@context": "https://schema.org", "@type": "Unknown"}')), page(head=ld('{"@context": "https://schema.org", "@graph": [{"@type": "Course", "name": "Head"}]}'))),
    ("C05d", page(head=ld(ORG)), page(head=ld(ORG.replace("Head", "Nowhere")))),
    ("C05d", page(body="<p>It costs 12.5 here</p>", head=ld('{"@type": "P", "offers": {"@type": "Offer", "price": 12.5}}')), page(head=ld('{"mainEntity": [{"@type": "Question", "acceptedAnswer": {"@type": "Answer", "text": "never"}}]}'))),
    ("C06", page(), page(base=GOOD.replace("post-author", "post"))),
    ("C06", page(), page(base=GOOD.replace("time>", "i>"))),
    ("C06", page(base=GOOD.replace("/about-us", "/联系")), page(base=GOOD.replace("/about-us", "/us"))),
    ("C07", page(), page(base=GOOD.replace("1 2 3", "1 2"))),
    ("C07", page(base=GOOD.replace("1 2 3", "1,5% 2.5 3")), page(base=GOOD.replace("https://b.example/", "https://a.example/"))),
    ("C07", page(base=GOOD.replace("<q>said</q>", "“said”")), page(base=GOOD.replace("<q>said</q>", "“said"))),
    ("C08", page(answer="y" * 40), page(answer="y" * 39)),
    ("C08", page(answer="y" * 45), page(answer="y" * 45 + "?")),
    ("C08", page(answer="short", body=f"<p>{'z' * 50}</p>" * 6), page(answer="short", body="<p>short</p>" * 3 + f"<p>{'z' * 50}</p>" * 3)),
    ("C11", page(base=GOOD.replace("<ul><li>l</li></ul>", ""), answer="w " * 150), page(base=GOOD.replace("<ul><li>l</li></ul>", ""), answer="w " * 151)),
    ("C11", page(answer="w " * 151), page(base=GOOD.replace("<ul><li>l</li></ul>", ""), answer="w " * 400)),
    ("C09", page(body='<img src="/i" alt="a">' * 7 + '<img src="/i">' * 3), page(body='<img src="/i" alt="a">' * 6 + '<img src="/i">' * 3)),
    ("E01", page(head=ld(ORG)), page(head=ld(ORG.replace("uk.linkedin.com", "linkedin.com.example")))),
    ("E01", page(), page(head=ld(ORG.replace("sameAs", "other")))),
]


def features(spark, pages):
    df = spark.createDataFrame([(i, i, "https://a.example/x", True, x) for i, x in enumerate(pages)], "page_id long, run_id long, url string, entry boolean, html string")
    return H.page_features(df, carry=("run_id", "url", "entry"))


def test_entry_rules_judge_the_entry_page(spark):
    bad = page(" ", base=GOOD.replace('content="d"', 'content=""').replace("post-author", "post").replace("1 2 3", "1"), answer="y")
    rows = [(0, 1, True, page()), (1, 1, False, bad), (2, 2, True, bad), (3, 2, False, page()), (4, 3, False, bad)]
    df = spark.createDataFrame([(i, run, "https://a.example/x", entry, html) for i, run, entry, html in rows], "page_id long, run_id long, url string, entry boolean, html string")
    found = G.hits(H.page_features(df, carry=("run_id", "url", "entry")), G.RULES).collect()
    of = lambda run: {r.rule_id for r in found if r.run_id == run}
    entry = {r.rule_id for r in G.RULES if r.entry}
    assert entry == {"C01", "C02", "C03", "C06", "C07", "C08"}
    assert not of(1) & entry and not of(3) & entry and of(2) & entry == entry - {"C03"}


def test_thresholds(spark):
    """Each case is a page that passes and one that doesn't, each in a run of its own."""
    found = {(r.rule_id, r.run_id) for r in G.hits(features(spark, [x for _, good, bad in CASES for x in (good, bad)])).collect()}
    for i, (rule, _, _) in enumerate(CASES):
        assert (rule, 2 * i) not in found, (i, rule, "passes")
        assert (rule, 2 * i + 1) in found, (i, rule, "fails")


def test_together_and_alone(spark):
    df = features(spark, [None, "", "<p>", *(x for _, a, b in CASES for x in (a, b))]).cache()
    every = {tuple(r) for r in G.hits(df).collect()}
    alone = {tuple(r) for rule in G.RULES for r in G.hits(df, [rule]).collect()}
    assert every == alone and every
    assert G.hits(df.limit(0)).count() == 0


def test_counts_of_a_run(spark):
    df = features(spark, [page(), page("t" * 61), page(" ")]).withColumn("run_id", F.lit(7).cast("long"))
    (r,) = G.hits(df, [x for x in G.RULES if x.rule_id == "C01"]).collect()
    assert (r.run_id, r.affected, r.measure, r.severity, r.pillar) == (7, 2, 0.666667, "mid", "P2")


def test_json_ld_summary():
    got = json_ld.summary(['[{"@type": "Recipe", "name": "A b"}, 3, null]', "nonsense", '{"@graph": [{"@type": "Event", "sameAs": ["x", 1]}, "y"]}'], "here  is a  B")
    assert got == {"ld_invalid": 1, "ld_context": 2, "ld_types": ["Recipe", "Event"], "ld_same_as": ["x"], "ld_missing": ["Recipe.image", "Event.name", "Event.startDate", "Event.location"], "ld_absent": []}


def test_plain_rules_together(spark):
    rows = [(1, "a", True, 404, 5, 0, True), (1, "b", False, 200, 1, 4, False), (2, "c", False, 200, 9, 0, False)]
    df = spark.createDataFrame(rows, "run_id long, url string, blocked boolean, http_status int, depth int, inbound int, in_sitemap boolean")
    rules = [
        R.Rule("A", "P1", R.counting("x", "blocked", R.HIGH)),
        R.Rule("B", "P1", R.Aggregate("x", {"n": "count(*)", "listed": "count_if(in_sitemap)"}, "n > 1 and listed > 0", "n", "listed", "case when n > 1 then 'high' else 'mid' end", R.MH)),
        R.Rule("C", "P2", R.Each("x", "depth > 3", "url", "depth", R.MID, R.INF)),
    ]
    want = {tuple(r) for rule in rules for r in rule.finish(rule.shape.hits(df)).collect()}
    assert {tuple(r) for r in R.together(rules, df).collect()} == want and len(want) == 4


@pytest.mark.parametrize(("present", "total", "hit"), [(2, 10, True), (3, 10, False), (0, 0, True)])
def test_low_presence(spark, present, total, hit):
    rows = [(1, i, i >= total, i < present or i >= total) for i in range(total + 2)]
    got = plans.low_presence(spark.createDataFrame(rows, "run_id long, prompt_id long, branded boolean, present boolean")).collect()
    assert bool(got) == hit
    if hit:
        assert (got[0].claim, got[0].measure) == (("measured_sample", present / total) if total else ("inferred", None))


def test_recommendations(spark):
    rows = [("f1", 1, "T02", "P1", "site", "mid", "measured_hard", 5), ("f2", 1, "T02", "P1", "site", "mid", "measured_sample", 4), ("f3", 1, "C01", "P2", "site", "high", "inferred", 1), ("f4", 1, "K03", "P3", "x", "ok", "hypothesis", 99), ("f5", 1, "ZZ", "P1", "https://a/b", "high", "measured_hard", 1)]
    df = spark.createDataFrame(rows, "finding_id string, run_id long, rule_id string, pillar string, scope string, severity string, claim string, affected long")
    got = {r.finding_id: (r.impact, r.effort, r.priority, r.horizon, r.confidence, r.kind, r.page) for r in recommendations.recommend(df).collect()}
    assert got == {
        "f1": ("high", "mid", "strategic", "mid", "high", "technical", None), "f2": ("low", "mid", "fill_in", "mid", "medium", "technical", None), "f3": ("high", "low", "quick_win", "quick", "low", "content", None),
        "f4": ("low", "high", "low", "long", "low", "content", None), "f5": ("high", "mid", "strategic", "mid", "high", "content", "https://a/b"),
    }
    assert recommendations.recommend(df.limit(0)).count() == 0
