"""Semantics that differ between engines, one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions import html as H
from sparkwright.functions.robots import allowed, decode_entities
from sparkwright.operators import crawl as C
from sparkwright.operators import findings as O
from sparkwright.operators import log as L
from sparkwright.operators import probes as P
from sparkwright.operators import serp as S
from sparkwright.operators.ranking import ranked


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2.0), (2.5, 3.0), (0.285 * 100, 28.0), (-0.5, 0.0), (1.49, 1.0)])
def test_rounding_is_half_up(spark, x, want):
    assert value(spark, E.js_round(F.lit(x))) == want


@pytest.mark.parametrize(
    ("text", "term", "want"),
    [
        ("中crm文", "crm", True),  # boundaries are ASCII
        ("café bar", "caf", True),
        ("metadocumentation", "metadocu", False),
        ("use C++ now", "C++", False),  # an end that is no word character needs one beside it
        ("useC++now", "C++", False),
        ("Best CRM.", "crm", True),
        ("小Docu很好", "小docu", True),
        ("anything", "", False),
    ],
)
def test_mentions(spark, text, term, want):
    assert value(spark, E.mentions(F.lit(text), term)) is want


def test_sentences(spark):
    assert value(spark, E.sentences(F.lit(" One. Two!? 三。\n\n four; "))) == ["One", "Two", "三", "four"]


@pytest.mark.parametrize(("hits", "n", "low"), [(0, 0, 0.0), (0, 10, 0.0), (10, 20, 0.299298), (20, 20, 0.838875)])
def test_wilson(spark, hits, n, low):
    assert value(spark, F.round(E.wilson_low(F.lit(hits), F.lit(n)), 6)) == pytest.approx(low, abs=1e-5)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://www.Example.com/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com/?ref=1", "http://example.com/"),
        ("ftp://example.com/a", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert value(spark, E.normalize_url(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize(
    ("link", "want"),
    [("/x", "https://a.b/x"), ("y", "https://a.b/c/y"), ("//z.q/w", "https://z.q/w"), ("http://o.p/", "http://o.p/"), ("#t", "https://a.b/c/d?e=1"), ("?q", "https://a.b/c/?q")],
)
def test_resolve(spark, link, want):
    assert value(spark, E.resolve(F.lit("https://a.b/c/d?e=1"), F.lit(link))) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("/blog/2026/07/x", "/blog/{date}/{date}/x"), ("/products/123", "/products/{id}"), ("/p/7", "/p/{id}"), ("/", "/"), ("/2024-01-05/a", "/{date}/a"), ("/u/123e4567-e89b-12d3-a456-426614174000", "/u/{uuid}")],
)
def test_url_template(spark, path, want):
    assert value(spark, E.url_template(F.lit(path))) == want


@pytest.mark.parametrize(("domain", "want"), [("www.acme.com", "acme"), ("acme.co.uk", "acme"), ("shop.acme.com", "acme"), ("acme", "acme")])
def test_brand(spark, domain, want):
    assert value(spark, E.brand_of_domain(F.lit(domain))) == want


def test_suffixes(spark):
    assert value(spark, E.suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]


@pytest.mark.parametrize(
    ("online", "cited", "hedged", "admits", "want"),
    [
        (True, True, True, True, "grounded"), (True, False, True, True, "speculative"), (True, False, False, True, "unknown"), (True, False, False, False, "unverified"),
        (False, True, False, False, "undetermined"), (False, False, True, False, "speculative"),
    ],
)
def test_answer_state(spark, online, cited, hedged, admits, want):
    assert value(spark, P.answer_state(*map(F.lit, (online, cited, hedged, admits)))) == want


def test_answers_with_the_real_word_lists(spark):
    rows = [
        (1, "Acme is the best tool.", True, "positive", False, False), (2, "Acme is not recommended.", True, "neutral", False, False), (3, "Acme vs Other: slow.", True, "comparison", False, False),
        (4, "It is slow. Acme exists.", True, "neutral", False, False), (5, "Acme is likely a tool.", True, "neutral", True, False), (6, "没有找到 it", False, "neutral", False, True), (7, None, False, "neutral", False, False),
        (8, "see acme.example for more", True, "neutral", False, False), (9, "小艾 不靠谱", True, "negative", False, False),
    ]
    df = spark.createDataFrame([(a, b) for a, b, *_ in rows], "evidence_id long, answer_text string")
    got = {r.evidence_id: r for r in P.parse(df, "Acme", "acme.example", ["小艾"]).collect()}
    for i, _, present, feel, hedged, admits in rows:
        assert (got[i].brand_present, got[i].sentiment, got[i].hedged, got[i].unknown_admission) == (present, feel, hedged, admits), i


def test_robots():
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: bot\nDisallow: /c\n"
    assert not allowed(text, "/a/x")
    assert allowed(text, "/a/b/x")
    assert allowed(text, "/c")
    assert not allowed(text, "/c", "Bot")
    assert not allowed(text, "/a", "bot")  # groups are merged
    assert allowed("Disallow: /", "/x")  # no group
    assert allowed("User-agent: *\nDisallow: /a\nAllow: /a", "/a")  # a tie
    assert decode_entities("a &amp;lt; &#65;&#x110000;") == "a &lt; A&#x110000;"


def test_html():
    page = """<html><head><title> T  x</title><meta name="viewport" content="w"><meta name="robots" content="noindex"><link rel="canonical" href="https://e/x"><link rel="alternate" hreflang="de" href="/de">
      <script type="application/ld+json">{"@type": "Organization"}</script><script>var t = "<p>no</p>";</script></head><body><h1>A</h1><h1>B</h1><h2>What is it?</h2><h2>End</h2><p>one two<p>three<img src="http://e/i.png" alt=""><img alt="x"><ul><li>1</ul><a href="/q">q</a></body>"""
    f = H.parse(page)
    assert (f["title"], f["n_h1"], f["h1"], f["robots"], f["canonical"], f["hreflangs"]) == ("T x", 2, "A", "noindex", "https://e/x", ["de"])
    assert (f["viewport"], f["images"], f["missing_alt"], f["lists"], f["mixed_content"], f["links"]) == (True, 2, 1, 1, True, ["/q"])
    assert f["h2_questions"] == 0.5 and f["mean_paragraph_words"] == 1.5 and f["json_ld"] == ['{"@type": "Organization"}']
    empty = H.parse(None)
    assert empty["title"] is None and empty["n_h1"] == 0 and empty["mean_paragraph_words"] is None


def test_health(spark):
    rows = [(1, "P1", "high", "open"), (1, "P2", "ok", "open"), (1, "P3", "high", "dismissed"), (2, "P1", "ok", "dismissed"), (3, "P5", "high", "open"), *[(4, "P1", "high", "open")] * 5]
    data = [(1, "P1"), (1, "P2"), (1, "P4"), (2, "P1"), (4, "P1"), (4, "P2"), (5, "P3")]
    df, pillars = spark.createDataFrame(rows, "run_id long, pillar string, severity string, status string"), spark.createDataFrame(data, "run_id long, pillar string")
    got = {r.run_id: r for r in O.health(df, pillars).collect()}
    assert (got[1].P1, got[1].P2, got[1].P3, got[1].P4) == (75.0, 97.9, None, 100.0)
    assert got[2].P1 == got[2].overall == 100.0  # data, nothing found
    assert got[3].overall is None and got[3].P5 is None  # found, but without data
    assert got[4].P1 == 0.0 and got[4].P2 == 100.0  # never below zero
    assert got[5].P3 == 100.0
    half = O.health(df, pillars, F.lit(0.5)).where("run_id = 1").first()
    assert half.P1 == 87.5 and O.health(df, pillars, F.lit(7.0)).where("run_id = 1").first().P1 == 75.0


def test_guarded_writes(spark):
    runs = spark.createDataFrame([(1, "cancelled"), (2, "collecting"), (3, "completed"), (4, "collecting"), (5, "completed")], "run_id long, status string")
    changes = spark.createDataFrame([(1, "completed"), (2, "failed"), (3, "collecting"), (5, "failed"), (9, "completed")], "run_id long, status string")
    assert {r.run_id: r.status for r in L.change_status(runs, changes).collect()} == {1: "cancelled", 2: "failed", 3: "collecting", 4: "collecting", 5: "failed"}
    stored = spark.createDataFrame([("a", 1, "manual"), ("b", 2, "heuristic"), ("c", 3, "heuristic")], "pattern string, representative long, source string")
    new = spark.createDataFrame([("a", 7, "heuristic"), ("b", 8, "heuristic"), ("d", 9, "heuristic")], "pattern string, representative long, source string")
    assert {tuple(r) for r in L.upsert_templates(stored, new, ["pattern"]).collect()} == {("a", 1, "manual"), ("b", 8, "heuristic"), ("c", 3, "heuristic"), ("d", 9, "heuristic")}
    log = spark.createDataFrame([("k", 1, "x", False), ("k", 2, "y", True), ("m", 1, "z", True), ("m", 2, "w", False)], "key string, at long, value string, deleted boolean")
    assert [tuple(r) for r in L.without_deleted(log, ["key"], F.col("at")).collect()] == [("m", 2, "w")]


def test_delta_takes_the_last_of_equal_fingerprints(spark):
    rows = [(1, 1, "f", "high"), (1, 2, "f", "ok"), (2, 3, "f", "mid"), (2, 4, "g", "ok"), (1, 5, "h", "mid")]
    df = spark.createDataFrame(rows, "run_id long, finding_id long, fingerprint string, severity string")
    assert {(r.fingerprint, r.state) for r in O.delta(df, 1, 2).collect()} == {("f", "regressed"), ("g", "new"), ("h", "resolved")}


@pytest.mark.parametrize(
    ("state", "before", "after", "comparable", "want"),
    [("resolved", None, None, True, "effective"), (None, None, None, True, "unknown"), ("resolved", 1.0, 0.5, True, "regressed"), ("persistent", 1.0, 2.0, True, "effective"), ("new", 1.0, 1.0, True, "ineffective"), ("resolved", 1.0, 2.0, False, "unknown")],
)
def test_outcome(spark, state, before, after, comparable, want):
    assert value(spark, O.outcome(F.lit(state).cast("string"), F.lit(before).cast("double"), F.lit(after).cast("double"), True, F.lit(comparable))) == want


def test_gap_type(spark):
    cases = [(5, 0, "winning"), (None, 2, "missing"), (None, 1, None), (11, 1, "weak"), (30, 1, "weak"), (31, 3, None), (15, 0, None)]
    for own, rivals, want in cases:
        assert value(spark, S.gap_type(F.lit(own).cast("int"), F.lit(rivals))) == want


def test_opportunity(spark):
    score = lambda v, i, d: value(spark, S.opportunity(F.lit(v).cast("int"), F.lit(i).cast("string"), F.lit(d).cast("int")))
    assert score(100_000, "Transactional", 0) == 100
    assert score(None, "transactional", 0) == 0
    assert score(100_000, None, None) == 25
    assert score(1_000_000, "commercial", 150) == 0


def test_progress_ends_at_the_first_terminal_message(spark):
    rows = [(1, 1, "progress", 5), (1, 2, "done", 0), (1, 3, "evidence_created", 1), (2, 1, "phase", 0)]
    df = spark.createDataFrame(rows, "run_id long, seq long, msg_type string, amount long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r.run_id: r for r in L.progress_state(df).collect()}
    assert (got[1].state, got[1].messages, got[1].evidence, got[1].last_progress) == ("done", 2, 0, 5)
    assert got[2].state == "running"


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, kept string, v string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k long, kept string, v string")
    assert {tuple(r) for r in L.upsert(old, new, ["k"], ["kept"]).collect()} == {(1, "a", "x"), (2, "b", None), (3, "d", "z")}


def test_presence_is_additive_over_runs(spark):
    """Runs do not leak into each other: a union of two runs gives both runs' rows."""
    prompts = spark.createDataFrame([(1, 1, False), (2, 1, False)], "run_id long, prompt_id long, branded boolean")
    parsed = spark.createDataFrame([(1, 1, True), (1, 1, False)], "run_id long, prompt_id long, brand_present boolean")
    got = {(r.run_id, r.present, r.samples) for r in P.prompt_presence(parsed, prompts).collect()}
    assert got == {(1, True, 2), (2, False, 0)}


@pytest.mark.parametrize(("raw", "want"), [("a.b", "https://a.b/"), (" A.b/c ", "https://a.b/c"), ("HTTP://X.y?q=1", "http://x.y/?q=1"), ("https://u@x.y:80/p#f", "https://x.y:80/p#f"), ("localhost", None), ("", None), (None, None), ("ftp://a.b", None), ("not a url.x y", None)])
def test_input_url(spark, raw, want):
    assert value(spark, E.input_url(F.lit(raw).cast("string"))) == want


def test_crawl_frontier(spark):
    links = spark.createDataFrame([(1, a, b) for a, b in [(1, 2), (1, 3), (3, 4), (2, 5), (5, 6), (6, 7), (9, 1), (9, 8), (2, 9), (10, 2)]], "run_id long, source_id long, target_id long")
    one = lambda *pages: spark.createDataFrame([(1, p) for p in pages], "run_id long, page long")
    got = lambda **k: {r.page: (r.depth, r.via, r.status) for r in C.frontier(links, one(1), one(1, 9, 20), one(3), **k).collect()}
    every = got()
    # 4 is behind a blocked page, 7 too deep, 10 never linked; 9 is in the sitemap and linked
    assert every == {1: (0, "entry", "fetched"), 9: (None, "both", "fetched"), 20: (None, "sitemap", "fetched"), 2: (1, "crawl", "fetched"), 3: (1, "crawl", "blocked"), 8: (1, "crawl", "fetched"), 5: (2, "crawl", "fetched"), 6: (3, "crawl", "fetched")}
    # blocked pages cost nothing: with four fetched pages 3 is still recorded; 2 wasn't fetched with three, so 9 isn't linked
    assert set(got(max_pages=4)) == {1, 9, 20, 2} and got(max_pages=3)[9] == (None, "sitemap", "fetched")
    assert set(got(max_pages=5)) == {1, 9, 20, 2, 3, 8}


def test_ranked_is_the_row_number(spark):
    rows = [(None if i % 13 == 0 else 1 if i % 7 else i % 3, None if i % 5 == 0 else i % 4, i) for i in range(500)]
    df = spark.createDataFrame(rows, "run_id long, score int, id long").repartition(6)
    order = [F.desc_nulls_last("score"), F.col("id")]
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    key = lambda r: tuple((x is None, x) for x in r)
    got = ranked(df, ["run_id"], order)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert ranked(df.limit(0), ["run_id"], order).count() == 0
