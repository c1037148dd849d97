"""One query for each rule, and their union, with SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions import html as H
from sparkwright.operators import assets as A
from sparkwright.operators import crawl as C
from sparkwright.operators import findings as O
from sparkwright.operators import page_rules as G
from sparkwright.operators import probes as P
from sparkwright.operators import recommendations as N
from sparkwright.operators import rules as R
from sparkwright.operators import serp as S
from sparkwright.plans import crawl as crawl_plans
from sparkwright.plans import probes as probe_plans
from sparkwright.plans import projects as project_plans
from sparkwright.plans import serp as serp_plans
from sparkwright.plans.serp import GAPS
from sparkwright.sources.bindings import COMPETITORS, OWN, Bound, ctes

lit = F.lit
#: what stands for the brand in the bound keywords' titles
BRAND_TERM = "red"
# The usual click rate of a place.
CTR = {1: 0.28, 2: 0.15, 3: 0.10, 4: 0.07, 5: 0.05}
#: where the rule set's own limits would take all or none of the bound data
BOUND = R.Limits(
    unseen_pages=0.5, thin_chars=3000, cluster_inbound=9, unbranded_presence=0.95, engine_prompts=7, negative=0.2, speculative=0.05, user_content=0.15, owned_citations=0.5, impressions=800, keyword_anchors=0.33,
    gained_by_lost=0.9, review_sites=2,
)
MAX_PRESENT, MIN_IMPRESSIONS = 7, 800
PRODUCT, SHIPPING, RETURNS = "/en/[0-9]+$", "/en/1[0-9]*$", "/en/2[0-9]*$"  # paths that stand for shops and their policies


def _one(df: DataFrame, scope: str, severity, claim: str, affected: str, measure) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return R.hit(df, lit(scope), sev, lit(claim), F.col(affected), F.col(measure) if isinstance(measure, str) else measure)


def t09b(b: Bound) -> DataFrame:
    """Greatest saving of each audit title, the eight best."""
    per = b.lab_audits.groupBy("run_id", "title").agg(F.max("savings_ms").alias("ms"))
    top = per.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ms"), "title"))).where("i <= 8")
    return _one(top.groupBy("run_id").agg(F.count("*").alias("n"), F.max("ms").alias("ms")), "site", "ok", "inferred", "n", "ms")


def t15(b: Bound) -> DataFrame:
    """Language pages that never show in search."""
    lang = F.regexp_extract("url", "/(de|en|es|fr)(/|$)", 1)
    pages = b.pages.select("run_id", "page_id", lang.alias("lang")).where("lang <> ''")
    shown = b.gsc.select("page_id").distinct().withColumn("shown", lit(1))
    x = pages.join(shown, "page_id", "left").groupBy("run_id").agg(F.countDistinct("lang").alias("langs"), F.count("*").alias("n"), F.count_if(F.col("shown").isNull()).alias("zero"))
    return _one(x.where(f"langs >= 2 and n >= 10 and zero >= {BOUND.unseen_pages} * n"), "languages", "mid", "inferred", "zero", F.col("zero") / F.col("n"))


def _templated(b: Bound) -> DataFrame:
    return b.once("templates", lambda: C.templates(b.pages.drop("html").withColumn("text_chars", F.col("initial_chars"))))


def c04(b: Bound) -> DataFrame:
    """Template representatives with little text."""
    rep = C.representatives(_templated(b))
    pages = b.pages.select(F.col("page_id").alias("representative"), "initial_chars")
    return R.hit(rep.join(pages, "representative").where(F.col("initial_chars") < BOUND.thin_chars), F.col("pattern"), lit("mid"), lit("inferred"), F.col("pages"), F.col("initial_chars"))


def c10(b: Bound) -> DataFrame:
    g = C.duplicate_groups(b.pages).groupBy("run_id").agg(F.sum("pages").alias("n"), F.count("*").alias("groups"))
    return _one(g, "site", "mid", "measured_hard", "n", "groups")


def ta01(b: Bound) -> DataFrame:
    x = _templated(b).groupBy("run_id", "pattern").agg(F.count("*").alias("n"), F.avg("inbound").alias("m"))
    return R.hit(x.where("n <= 2 or m < 1"), F.col("pattern"), lit("ok"), lit("inferred"), F.col("n"), F.col("m"))


def ta02(b: Bound) -> DataFrame:
    x = _templated(b).groupBy("run_id", "pattern").agg(F.count("*").alias("n"), F.max("inbound").alias("m"))
    return R.hit(x.where((F.col("n") >= 4) & (F.col("m") < BOUND.cluster_inbound)), F.col("pattern"), lit("ok"), lit("inferred"), F.col("n"), F.col("m"))


def g01(b: Bound) -> DataFrame:
    """Search and training crawlers that robots.txt turns away: two hits of one scope."""
    x = b.crawlers.where("disallowed").groupBy("run_id", "kind").agg(F.count("*").alias("n"))
    return _one(x, "crawlers", F.when(F.col("kind") == "search", "high").otherwise("ok"), "measured_hard", "n", "n")


def _answers(b: Bound) -> probe_plans.Answers:
    a = probe_plans.Answers(b.spark, b.sf_dir)
    parsed = a.parsed.drop("answer_text")
    a.parsed = b.once("answers", lambda: parsed)
    return a


def low_presence(presence: DataFrame, least: float = 0.3) -> DataFrame:
    """Runs whose unbranded prompts have the brand in less than ``least``; a run whose prompts are all branded gives an inferred hit without a number."""
    x = presence.groupBy("run_id").agg(F.count_if(~F.col("branded") & F.col("present")).alias("present"), F.count_if(~F.col("branded")).alias("total"), F.count("*").alias("prompts"))
    blind = F.col("total") == 0
    claim = F.when(blind, "inferred").otherwise("measured_sample")
    return R.hit(x.where(blind | (F.col("present") < least * F.col("total"))), lit("unbranded"), lit("mid"), claim, F.when(blind, F.col("prompts")).otherwise(F.col("present")), F.when(~blind, F.col("present") / F.col("total")))


def g05(b: Bound) -> DataFrame:
    """Unbranded presence below a threshold."""
    a = _answers(b)
    return low_presence(P.prompt_presence(a.parsed, a.prompts), BOUND.unbranded_presence)


def g06(b: Bound) -> DataFrame:
    """Engines with web search that show the brand for few unbranded prompts."""
    a = _answers(b)
    x = P.engine_visibility(a.parsed, a.prompts).where(P.web_search(F.col("engine")) & (F.col("unbranded_total") > 0) & (F.col("unbranded_present") <= BOUND.engine_prompts))
    g = x.groupBy("run_id").agg(F.count("*").alias("n"), F.min("unbranded_present").alias("m"))
    return _one(g, "engines", "mid", "measured_sample", "n", "m")


def g09(b: Bound) -> DataFrame:
    """Negative share of the answers with the brand."""
    x = P.sentiment_breakdown(_answers(b).parsed).where((F.col("total") > 0) & (F.col("negative") >= BOUND.negative * F.col("total")))
    return _one(x, "sentiment", "mid", "inferred", "negative", F.col("negative") / F.col("total"))


def g10(b: Bound) -> DataFrame:
    a = _answers(b)
    kinds = ("grounded", "speculative", "unknown", "unverified", "undetermined")
    s = P.branded_states(a.parsed, a.prompts, a.citations).groupBy("run_id").agg(*[F.sum(k).alias(k) for k in kinds])
    x = s.withColumn("n", sum((F.col(k) for k in kinds), lit(0))).where((F.col("n") >= 3) & (F.col("speculative") >= BOUND.speculative * F.col("n")))
    return _one(x, "branded", "mid", "inferred", "speculative", F.col("speculative") / F.col("n"))


def g11(b: Bound) -> DataFrame:
    """Much of what unbranded answers cite is user content, little or nothing is own."""
    a = _answers(b)
    open_ = a.hosts.join(a.prompts.where("not branded").select("run_id", "prompt_id"), ["run_id", "prompt_id"], "left_semi")
    x = open_.groupBy("run_id").agg(F.count_if(F.col("platform").isin(*E.UGC)).alias("ugc"), F.count_if(F.col("origin") == "owned").alias("own"), F.count("*").alias("n"))
    return _one(x.where((F.col("ugc") >= BOUND.user_content * F.col("n")) & (F.col("own") <= BOUND.owned_citations * F.col("n"))), "citations", "mid", "measured_sample", "ugc", F.col("ugc") / F.col("n"))


def _gsc(b: Bound) -> DataFrame:
    return b.once("gsc", lambda: b.gsc)


def _serp(b: Bound) -> DataFrame:
    return b.once("serp", lambda: b.serp)


def _totals(b: Bound) -> DataFrame:
    return b.once("totals", lambda: S.query_totals(_gsc(b)))


def _gaps(b: Bound) -> DataFrame:
    return b.once("gaps", lambda: S.keyword_gaps(_serp(b), b.labs, OWN, COMPETITORS))


def _sites(b: Bound) -> DataFrame:
    """The own domain of each run and its confirmed competitors'."""
    return b.sites.where("own or confirmed")


def k01(b: Bound) -> DataFrame:
    x = _totals(b).where(F.col("position").between(4, 20) & (F.col("impressions") >= BOUND.impressions))
    top = x.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("impressions"), "query_id"))).where("i <= 20")
    return _one(top.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("impressions").alias("s")), "keywords", "ok", "measured_hard", "n", "s")


def k02(b: Bound) -> DataFrame:
    """Click rate under half of what its position usually gets (at twice the usual rate here)."""
    place = E.js_round(F.col("position")).cast("int")
    x = _totals(b).withColumn("usual", E.lookup(place, CTR)).where(F.col("usual").isNotNull() & (F.col("impressions") >= BOUND.impressions) & (F.col("clicks") / F.col("impressions") < 0.5 * F.col("usual")))
    return _one(x.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("impressions").alias("s")), "keywords", "mid", "hypothesis", "n", "s")


def _gap_rule(b: Bound, *kinds: str) -> DataFrame:
    return S.top_gaps(_gaps(b), kinds).groupBy("run_id").agg(F.count("*").alias("n"), F.max("score").alias("s"))


def k03(b: Bound) -> DataFrame:
    return _one(_gap_rule(b, "missing"), "missing keywords", "ok", "measured_sample", "n", "s")


def k04(b: Bound) -> DataFrame:
    return _one(_gap_rule(b, "weak"), "weak keywords", "ok", "measured_sample", "n", "s")


def k05(b: Bound) -> DataFrame:
    """Result lists for brand queries where the own site is absent or not first."""
    asked = b.labs.where(F.contains(F.lower("title"), lit(BRAND_TERM))).select("run_id", "keyword_id")
    brand = _serp(b).join(asked, ["run_id", "keyword_id"], "left_semi").groupBy("run_id", "keyword_id").agg(F.min_by("domain", "item_rank").alias("top"), F.bool_or(F.col("domain") == OWN).alias("own"))
    x = brand.where(~F.col("own") | (F.col("top") != OWN)).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
    return _one(x, "brand results", "mid", "measured_sample", "n", "own")


def _shared_queries(b: Bound) -> DataFrame:
    return b.once("shared_queries", lambda: S.cannibalization(_gsc(b), 75))


def k06(b: Bound) -> DataFrame:
    x = _shared_queries(b).groupBy("run_id").agg(F.count("*").alias("n"), F.max("pages").alias("p"))
    return _one(x, "keywords", "mid", "inferred", "n", "p")


def _misled(b: Bound) -> DataFrame:
    return b.once("misled", lambda: _elsewhere(b))


def _elsewhere(b: Bound) -> DataFrame:
    best = _gsc(b).groupBy("run_id", F.col("query_id").alias("keyword_id")).agg(F.max_by("page_id", F.struct("impressions", "page_id")).alias("page_id"))
    landing = b.landing.select("page_id", "url", A.landing_class(F.col("url")).alias("lands"))
    wanted = b.labs.select("run_id", "keyword_id", "keyword", A.intent_class(F.col("intent")).alias("wants")).where("wants is not null")
    return best.join(wanted, ["run_id", "keyword_id"]).join(landing, "page_id").where("lands <> 'other' and lands <> wants")


def k07(b: Bound) -> DataFrame:
    """Queries whose intent is another than what the page that they land on is for."""
    x = _misled(b)
    return _one(x.groupBy("run_id").agg(F.count("*").alias("n"), F.min("keyword_id").alias("k")), "intent", "mid", "inferred", "n", "k")


def q01(b: Bound) -> DataFrame:
    """Places in the first ten results, own and of the strongest confirmed competitor, where any of them has one; runs without a confirmed competitor aren't compared."""
    x = S.share_of_serp_of(_serp(b), _sites(b)).groupBy("run_id").agg(F.max(F.when(~F.col("own"), F.col("items"))).alias("rival"), F.coalesce(F.max(F.when(F.col("own"), F.col("items"))), lit(0)).alias("own"))
    return _one(x.where("rival + own > 0"), "share of results", "ok", "measured_sample", "rival", "own")


def compared(b: Bound, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Shares of voice of the brand and of those competitors that are confirmed by name."""
    a = _answers(b)
    shares = P.share_of_voice(P.unbranded_samples(a.parsed, a.prompts), probe_plans.BRAND, probe_plans.RIVALS, by)
    names = b.rivals.select("run_id", F.lower("name").alias("key")).distinct()
    rivals = shares.where("not you").withColumn("key", F.lower("name")).join(names, ["run_id", "key"], "left_semi").drop("key")
    return shares.where("you").unionByName(rivals.select(*shares.columns))


def q02(b: Bound) -> DataFrame:
    """Share of voice against the strongest confirmed competitor."""
    y = compared(b).groupBy("run_id").agg(F.max(F.when(~F.col("you"), F.col("pct"))).alias("rival"), F.max(F.when(F.col("you"), F.col("pct"))).alias("you"))
    return _one(y.where("rival is not null and you is not null"), "share of voice", "ok", "measured_sample", "rival", "you")


def _behind(b: Bound) -> DataFrame:
    return S.top_gaps(b.once("confirmed_gaps", lambda: S.keyword_gaps_of(_serp(b), b.labs, _sites(b))), ("missing", "weak"), 10)


def q03(b: Bound) -> DataFrame:
    """Keywords where confirmed competitors are ahead, whose pages show what content the results want."""
    x = _behind(b).groupBy("run_id").agg(F.count("*").alias("n"), F.max("score").alias("s"))
    return _one(x, "content form", "ok", "inferred", "n", "s")


def a01(b: Bound) -> DataFrame:
    """Referring domains of the own site against the median of confirmed competitors; without any, the own number alone."""
    x = S.at_sites(b.backlinks, _sites(b)).groupBy("run_id").agg(F.max(F.when(F.col("own"), F.col("referring_domains"))).alias("own_domains"), F.expr("percentile(case when not own then referring_domains end, 0.5)").alias("median"))
    x = x.where("own_domains is not null").select("run_id", F.col("own_domains").alias("own"), "median")
    return _one(x, "links", F.when(F.col("own") < F.col("median"), "mid").otherwise("ok"), "measured_sample", "own", "median")


def _anchored(b: Bound) -> DataFrame:
    own = b.once("own_anchors", lambda: S.at_sites(b.anchors, b.sites.where("own")))
    domain = F.col("domain")
    return own.withColumn("kind", A.anchor_class(F.col("anchor"), F.split(domain, r"\.")[0], domain))


def a02(b: Bound) -> DataFrame:
    """Share of keywords among the own site's anchors, and of the most frequent one."""
    x = _anchored(b).groupBy("run_id").agg(F.sum(F.when(F.col("kind") == "keyword", F.col("n")).otherwise(0)).alias("k"), F.max(F.when(F.col("kind") == "keyword", F.col("n"))).alias("top"), F.sum("n").alias("n"))
    return _one(x.where((F.col("k") >= BOUND.keyword_anchors * F.col("n")) | (F.col("top") >= 0.2 * F.col("n"))), "anchors", "mid", "measured_sample", "k", F.col("k") / F.col("n"))


def e03(b: Bound) -> DataFrame:
    """Search volume of queries that name the brand (its first match) against the rivals' (largest)."""
    terms = {"own": "red", "r1": "blue", "r2": "hot"}
    x = b.labs.groupBy("run_id").agg(*[F.min_by(F.when(F.contains(F.lower("title"), lit(t)), F.col("search_volume")), F.when(F.contains(F.lower("title"), lit(t)) & F.col("search_volume").isNotNull(), F.col("keyword_id"))).alias(k) for k, t in terms.items()])
    return _one(x.withColumn("rival", F.greatest("r1", "r2")).where("own is not null and rival is not null"), "brand demand", "ok", "measured_sample", "own", "rival")


def _shop(b: Bound, policy: str) -> DataFrame:
    host = E.host(F.col("url"))
    x = b.pages.select((F.col("page_id") % 40).alias("run_id"), host.alias("host"), F.col("url").rlike(PRODUCT).alias("product"), F.col("url").rlike(policy).alias("policy"))
    return x.groupBy("run_id").agg(F.count_if("product").alias("n"), F.count_if("policy").alias("p")).where("n > 0 and p = 0")


def tr04(b: Bound) -> DataFrame:
    return _one(_shop(b, SHIPPING), "shipping", "mid", "inferred", "n", "p")


def tr05(b: Bound) -> DataFrame:
    return _one(_shop(b, RETURNS), "returns", "mid", "inferred", "n", "p")


BUILT = tuple(
    R.Rule(rule_id, pillar, f)
    for rule_id, pillar, f in (
        ("T09b", "P1", t09b), ("T15", "P1", t15), ("C04", "P2", c04), ("C10", "P2", c10), ("TA01", "P2", ta01), ("TA02", "P2", ta02), ("G01", "P5", g01), ("G05", "P5", g05), ("G06", "P5", g06),
        ("G09", "P5", g09), ("G10", "P5", g10), ("G11", "P5", g11), ("K01", "P3", k01), ("K02", "P3", k02), ("K03", "P3", k03), ("K04", "P3", k04), ("K05", "P3", k05), ("K06", "P3", k06), ("K07", "P3", k07),
        ("Q01", "P4", q01), ("Q02", "P4", q02), ("Q03", "P4", q03), ("A01", "P5", a01), ("A02", "P5", a02), ("E03", "P5", e03), ("TR04", "P2", tr04), ("TR05", "P2", tr05),
    )
)
PLAIN = R.plain(BOUND)
RULES = PLAIN + BUILT


#: bound titles end at 60 characters, bound paragraphs have some 25 words, every third image lacks its text
PAGE_LIMITS = G.Limits(title_chars=55, paragraph_words=25, missing_alt=0.35)
PAGE_RULES = {k: tuple(r for r in G.RULES if r.rule_id == k) for k in dict.fromkeys(r.rule_id for r in G.RULES)}


def _features(b: Bound) -> DataFrame:
    return b.once("features", lambda: H.page_features(b.site_pages, carry=("run_id", "url", "entry")))


def _page_query(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return G.hits(_features(Bound(spark, sf_dir)), PAGE_RULES[rule_id], PAGE_LIMITS)

    run.__name__ = f"rule_{rule_id.lower()}"
    return run


def hits_of(rule: R.Rule, b: Bound) -> DataFrame:
    found = rule.shape(b) if callable(rule.shape) else rule.shape.hits(getattr(b, rule.shape.frame))
    return rule.finish(found)


def _query(rule: R.Rule) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hits_of(rule, Bound(spark, sf_dir))

    run.__name__ = f"rule_{rule.rule_id.lower()}"
    return run


def hits_of_all(b: Bound) -> DataFrame:
    """Every rule's hits; rules on the content of pages are counted together, and so are plain rules that read one frame; frames that several rules ask for are written once where ``b`` shares."""
    parts = [G.hits(_features(b), G.RULES, PAGE_LIMITS), *(R.together(rules, getattr(b, frame)) for frame, rules in R.by_frame(PLAIN)), *(hits_of(r, b) for r in BUILT)]
    return reduce(DataFrame.unionByName, parts)


#: a rule that no run survives: its condition divides by zero
BROKEN = R.Rule("X00", "P1", R.Aggregate("pages", {"n": "count(*)", "none": "count_if(page_id < 0)"}, "n div none > 0", "n", "n", R.MID, R.MH))


def isolated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the plain rules and of one that raises, which gives a row with its error and leaves the others whole."""
    b = Bound(spark, sf_dir)
    found, failed = R.isolated([(r.rule_id, lambda r=r: hits_of(r, b)) for r in (*PLAIN[:8], BROKEN, *PLAIN[8:])])
    rows = reduce(DataFrame.unionByName, found).select("rule_id", "run_id", "scope", "severity", "affected", lit(None).cast("string").alias("error"))
    errors = [spark.range(1).select(lit(name).alias("rule_id"), lit(None).cast("long").alias("run_id"), lit(None).cast("string").alias("scope"), lit(None).cast("string").alias("severity"), lit(None).cast("long").alias("affected"), lit(error).alias("error")) for name, error in failed]
    return reduce(DataFrame.unionByName, [rows, *errors])


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat_ws("|", F.col("run_id").cast("string"), "rule_id", "scope", "severity"), 256)
    return hits_of_all(Bound(spark, sf_dir, sharing=True)).withColumn("finding_id", F.concat(lit("fnd_"), F.substring(key, 1, 16)))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as finding rows: identity, confidence and impact."""
    impact = N.impact(F.col("severity"), F.col("affected"))
    return _findings(spark, sf_dir).select("finding_id", "run_id", "rule_id", "pillar", "severity", "claim", O.confidence(F.col("claim")).alias("confidence"), impact.alias("impact"), "fingerprint")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recommendation for each finding."""
    return N.recommend(_findings(spark, sf_dir))


QUERIES = (*[_query(r) for r in RULES], *map(_page_query, PAGE_RULES), isolated_hits, findings, recommendations)

_T = crawl_plans._T
_ROW = "select run_id, '{scope}' as scope, {severity} as severity, '{claim}' as claim, cast({affected} as bigint) as affected, cast({measure} as double) as measure from ({sql})"


def _row(sql: str, scope: str, severity: str, claim: str, affected: str, measure: str) -> str:
    severity = severity if " " in severity else f"'{severity}'"
    return _ROW.format(sql=sql, scope=scope, severity=severity, claim=claim, affected=affected, measure=measure)


_PR = probe_plans
_QT = "(select run_id, query_id, sum(impressions) as impressions, sum(clicks) as clicks, avg(avg_pos) as position from b_gsc group by all)"
_CTR = "case cast(floor(position + 0.5) as integer) " + " ".join(f"when {k} then {v}::double" for k, v in CTR.items()) + " end"
_TOP = "(select run_id, score from (select *, row_number() over (partition by run_id order by score desc nulls last, keyword) as i from gaps where gap_type in ({kinds})) where i <= {n})"
_STATES = _PR._P + _PR._CITED + f", s as (select pc.*, {_PR._STATE} as state from pc join b_prompts q using (run_id, prompt_id) where q.branded)"


_MISLED = """, ld as (select page_id, url, case when url like '%/Shop/%' then 'transactional' when url like '%/blog/%' or url like '%/guides/%' then 'informational' end as lands from b_landing),
misled as (select g.*, l.keyword, ld.url from (select run_id, query_id, arg_max(page_id, (impressions, page_id)) as page_id from b_gsc group by all) g join b_labs l on l.keyword_id = g.query_id and l.run_id = g.run_id join ld using (page_id)
  where lands <> case intent when 'informational' then 'informational' when 'transactional' then 'transactional' when 'commercial' then 'transactional' end) """
_SHARES = ", sh as (select w.run_id, w.domain, w.own, count(s.domain) as i from w left join b_serp s on s.run_id = w.run_id and s.domain = w.domain and s.item_rank <= 10 where w.run_id in (select run_id from b_serp) group by all) "
_NAMED = f", b_rivals as ({ctes('rivals').split('b_rivals as (', 1)[1].rstrip()[:-1]}), nm as (select run_id, lower(name) as key from b_rivals)"
_BEHIND = project_plans._SITES + f""", gp as (select p.*, case when our_position is null and rivals >= 2 then 'missing' when our_position > 10 and our_position <= 30 and rivals >= 1 then 'weak' end as gap_type, l.intent, {serp_plans.SCORE} as score from per p left join b_labs l on l.run_id = p.run_id and l.keyword = p.keyword),
behind as (select * from gp where gap_type is not null qualify row_number() over (partition by run_id order by score desc nulls last, keyword) <= 10) """
_ANCHORS = ctes("anchors", "sites") + """, an as (select a.*, case when trim(anchor) = 'Click here' then 'generic' when anchor like 'https://%' then 'url' when anchor like 'www.%' then 'domain' when contains(lower(anchor), split_part(a.domain, '.', 1)) then 'brand' else 'keyword' end as kind
  from b_anchors a join b_sites s on s.run_id = a.run_id and s.domain = a.domain where s.own) """


def _vol(term: str) -> str:
    return f"arg_min(search_volume, keyword_id) filter (contains(lower(title), '{term}') and search_volume is not null)"


def _shop_sql(policy: str) -> str:
    return f"select * from (select page_id % 40 as run_id, count_if(regexp_matches(url, '{PRODUCT}')) as n, count_if(regexp_matches(url, '{policy}')) as p from b_pages group by 1) where n > 0 and p = 0"


_SQL: dict[str, tuple[str, str]] = {
    "T09b": (ctes("lab_audits"), _row("select run_id, count(*) as n, max(ms) as ms from (select run_id, title, max(savings_ms) as ms from b_lab_audits group by run_id, title qualify row_number() over (partition by run_id order by max(savings_ms) desc, title) <= 8) group by run_id", "site", "ok", "inferred", "n", "ms")),
    "T15": (ctes("pages", "gsc"), _row("select * from (select run_id, count(distinct lang) as langs, count(*) as n, count_if(page_id not in (select page_id from b_gsc)) as zero from (select *, regexp_extract(url, '/(de|en|es|fr)(/|$)', 1) as lang from b_pages) where lang <> '' group by run_id) where langs >= 2 and n >= 10 and zero >= 0.5 * n", "languages", "mid", "inferred", "zero", "zero / n")),
    "C04": (ctes("pages") + _T + """, m as (select *, row_number() over (partition by run_id, pattern order by initial_chars, page_id) as i, count(*) over (partition by run_id, pattern) as n from t where http_status = 200),
a as (select run_id, pattern, count(*) as pages, min(page_id) as first_page from t group by all), r as (select a.*, coalesce(m.page_id, first_page) as rep from a left join m on m.run_id = a.run_id and m.pattern = a.pattern and m.i = (m.n - 1) // 2 + 1) """,
        "select r.run_id, r.pattern as scope, 'mid' as severity, 'inferred' as claim, r.pages as affected, p.initial_chars::double as measure from r join b_pages p on p.page_id = r.rep where p.initial_chars < 3000"),
    "C10": (ctes("pages"), _row("select run_id, sum(n) as n, count(*) as g from (select run_id, content_hash, count(*) as n from b_pages where content_hash <> '' group by all having count(*) >= 2) group by run_id", "site", "mid", "measured_hard", "n", "g")),
    "TA01": (ctes("pages") + _T + " ", "select run_id, pattern as scope, 'ok' as severity, 'inferred' as claim, count(*) as affected, avg(inbound) as measure from t group by run_id, pattern having count(*) <= 2 or avg(inbound) < 1"),
    "TA02": (ctes("pages") + _T + " ", "select run_id, pattern as scope, 'ok' as severity, 'inferred' as claim, count(*) as affected, max(inbound)::double as measure from t group by run_id, pattern having count(*) >= 4 and max(inbound) < 9"),
    "G01": (ctes("crawlers"), _row("select run_id, kind, count(*) as n from b_crawlers where disallowed group by all", "crawlers", "case kind when 'search' then 'high' else 'ok' end", "measured_hard", "n", "n")),
    "G05": (_PR._P + _PR._PRES + " ", "select run_id, 'unbranded' as scope, 'mid' as severity, case when n = 0 then 'inferred' else 'measured_sample' end as claim, case when n = 0 then k else p end as affected, case when n > 0 then p / n end as measure from (select run_id, count_if(present and not branded) as p, count_if(not branded) as n, count(*) as k from pres group by run_id) where n = 0 or p < 0.95 * n"),
    "G06": (_PR._P + ", e as (select p.run_id, provider, count(distinct prompt_id) filter (brand_present and not branded) as p, count(distinct prompt_id) filter (not branded) as n from p join b_prompts using (run_id, prompt_id) group by all) ", _row(f"select run_id, count(*) as n, min(p) as m from e where provider <> 'deepseek' and n > 0 and p <= {MAX_PRESENT} group by run_id", "engines", "mid", "measured_sample", "n", "m")),
    "G09": (_PR._P + " ", _row("select run_id, count_if(sentiment = 'negative') as x, count(*) as n from p where brand_present group by run_id having count_if(sentiment = 'negative') >= 0.2 * count(*)", "sentiment", "mid", "inferred", "x", "x / n")),
    "G10": (_STATES + " ", _row("select run_id, count_if(state = 'speculative') as x, count(*) as n from s group by run_id having count(*) >= 3 and count_if(state = 'speculative') >= 0.05 * count(*)", "branded", "mid", "inferred", "x", "x / n")),
    "G11": (ctes("citations", "prompts") + _PR._HOST + " ", _row("select run_id, count_if(platform = 'reddit') as x, count(*) as n from hh join (select * from b_prompts where not branded) using (run_id, prompt_id) group by run_id having count_if(platform = 'reddit') >= 0.15 * count(*) and count_if(origin = 'owned') <= 0.5 * count(*)", "citations", "mid", "measured_sample", "x", "x / n")),
    "K01": (ctes("gsc"), _row(f"select run_id, count(*) as n, sum(impressions) as s from (select * from {_QT} where position between 4 and 20 and impressions >= {MIN_IMPRESSIONS} qualify row_number() over (partition by run_id order by impressions desc, query_id) <= 20) group by run_id", "keywords", "ok", "measured_hard", "n", "s")),
    "K02": (ctes("gsc"), _row(f"select run_id, count(*) as n, sum(impressions) as s from (select *, {_CTR} as usual from {_QT}) where usual is not null and impressions >= {MIN_IMPRESSIONS} and clicks / impressions < 0.5 * usual group by run_id", "keywords", "mid", "hypothesis", "n", "s")),
    "K03": (ctes("serp", "labs") + f", {GAPS} ", _row(f"select run_id, count(*) as n, max(score) as s from {_TOP.format(kinds=chr(39) + 'missing' + chr(39), n=20)} group by run_id", "missing keywords", "ok", "measured_sample", "n", "s")),
    "K04": (ctes("serp", "labs") + f", {GAPS} ", _row(f"select run_id, count(*) as n, max(score) as s from {_TOP.format(kinds=chr(39) + 'weak' + chr(39), n=20)} group by run_id", "weak keywords", "ok", "measured_sample", "n", "s")),
    "K05": (ctes("serp", "labs"), _row(f"select run_id, count(*) as n, count_if(own) as o from (select run_id, keyword_id, arg_min(domain, item_rank) as top, bool_or(domain = '{OWN}') as own from b_serp semi join (select * from b_labs where contains(lower(title), '{BRAND_TERM}')) l using (run_id, keyword_id) group by all) where not own or top <> '{OWN}' group by run_id", "brand results", "mid", "measured_sample", "n", "o")),
    "K06": (ctes("gsc"), _row("select run_id, count(*) as n, max(pages) as p from (select run_id, query_id, count(distinct page_id) as pages, sum(impressions) as s from b_gsc where impressions >= 75 group by run_id, query_id having count(distinct page_id) >= 2 qualify row_number() over (partition by run_id order by sum(impressions) desc, query_id) <= 20) group by run_id", "keywords", "mid", "inferred", "n", "p")),
    "K07": (ctes("gsc", "labs", "landing") + _MISLED, _row("select run_id, count(*) as n, min(query_id) as k from misled group by run_id", "intent", "mid", "inferred", "n", "k")),
    "Q01": (project_plans._SITES + _SHARES, _row("select run_id, max(i) filter (not own) as rival, coalesce(max(i) filter (own), 0) as mine from sh group by run_id having max(i) filter (not own) + coalesce(max(i) filter (own), 0) > 0", "share of results", "ok", "measured_sample", "rival", "mine")),
    "Q02": (_PR._P + _PR._OPEN + _NAMED + f", v as ({_PR._sov('run_id')}) ", _row("select run_id, max(pct) filter (not you) as rival, max(pct) filter (you) as me from v where you or (run_id, lower(name)) in (select run_id, key from nm) group by run_id having max(pct) filter (not you) is not null", "share of voice", "ok", "measured_sample", "rival", "me")),
    "Q03": (_BEHIND, _row("select run_id, count(*) as n, max(score) as s from behind group by run_id", "content form", "ok", "inferred", "n", "s")),
    "A01": (ctes("backlinks", "sites"), _row("select k.run_id, max(referring_domains) filter (own) as mine, median(referring_domains) filter (not own) as m from b_backlinks k join b_sites s on s.run_id = k.run_id and s.domain = k.domain where own or confirmed group by k.run_id having max(referring_domains) filter (own) is not null", "links", "case when mine < m then 'mid' else 'ok' end", "measured_sample", "mine", "m")),
    "A02": (_ANCHORS, _row("select * from (select run_id, coalesce(sum(n) filter (kind = 'keyword'), 0) as k, max(n) filter (kind = 'keyword') as top, sum(n) as n from an group by run_id) where k >= 0.33 * n or top >= 0.2 * n", "anchors", "mid", "measured_sample", "k", "k / n")),
    "E03": (ctes("labs"), _row(f"select *, greatest(r1, r2) as rival from (select run_id, {_vol('red')} as own, {_vol('blue')} as r1, {_vol('hot')} as r2 from b_labs group by run_id) where own is not null and greatest(r1, r2) is not null", "brand demand", "ok", "measured_sample", "own", "rival")),
    "TR04": (ctes("pages"), _row(_shop_sql(SHIPPING), "shipping", "mid", "inferred", "n", "p")),
    "TR05": (ctes("pages"), _row(_shop_sql(RETURNS), "returns", "mid", "inferred", "n", "p")),
}


#: what the bound pages were given, said again by page_id; texts by cutting tags off
_PAGE = ctes("site_pages") + """,
c as (select *, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') as shown, replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&') as title0, trim(title0) as title from b_site_pages),
q as (select *, replace(regexp_replace(regexp_replace(shown, '(?s)<title>.*?</title>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"') as body,
  list_filter(list_transform(string_split(shown, '<p>')[2:], lambda x: trim(regexp_replace(regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') as ps from c),
p as (select *, page_id % 14 <> 0 as valid, len(regexp_extract_all(body, '[0-9]+(?:[.,][0-9]+)?%?')) as figures, len(regexp_extract_all(body, '["“”„‟''‘’]')) as quote_chars,
  len(list_filter(ps[1:greatest(1, cast(ceil(len(ps) * 0.3) as integer))], lambda x: length(replace(replace(x, '&quot;', '"'), '&amp;', '&')) >= 40 and not regexp_matches(x, '[?？]$'))) > 0 as answered,
  list_avg(list_transform(ps, lambda x: len(string_split(x, ' ')))) as mean_words from q) """


def _pages_with(rule_id: str, pillar: str, severity: str, claim: str, fault: str, scope: str = "site", measure: str = "n / total", fires: str = "n > 0", n: str = "") -> str:
    entry = any(r.entry for r in PAGE_RULES[rule_id])
    n = n or f"count_if({f'entry and ({fault})' if entry else fault})"
    return f"select '{rule_id}' as rule_id, '{pillar}' as pillar, run_id, '{scope}' as scope, '{severity}' as severity, '{claim}' as claim, cast(n as bigint) as affected, round(cast({measure} as double), 6) as measure, sha256('{rule_id}::' || lower('{scope}')) as fingerprint from (select run_id, {n} as n, {'count_if(entry)' if entry else 'count(*)'} as total from p group by run_id) where {fires}"


_PAGE_SQL = {
    "T04": _pages_with("T04", "P1", "mid", "measured_hard", "page_id % 13 = 0"),
    "T08": _pages_with("T08", "P1", "high", "measured_hard", "not starts_with(url, 'https:') or page_id % 31 = 0"),
    "T13": _pages_with("T13", "P1", "high", "measured_hard", "page_id % 41 = 0"),
    "T14": _pages_with("T14", "P1", "mid", "measured_hard", "page_id % 7 = 0", measure="fallback", fires="tagged > 0 and (n > 0 or fallback = 0)", n="count_if(page_id % 7 < 3) as tagged, count_if(page_id % 7 = 2) as fallback, count_if(page_id % 7 = 0)"),
    "C01": _pages_with("C01", "P2", "mid", "measured_hard", "trim(title) = '' or length(title) > 55"),
    "C02": _pages_with("C02", "P2", "mid", "measured_hard", "page_id % 6 = 5"),
    "C03": _pages_with("C03", "P2", "mid", "measured_hard", "len(regexp_extract_all(shown, '<h1>')) <> 1 or trim(replace(replace(regexp_extract(shown, '<h1>([^<]*)</h1>', 1), '&quot;', '\"'), '&amp;', '&')) = title"),
    "C05a": _pages_with("C05a", "P2", "ok", "measured_hard", "valid and page_id % 6 in (1, 2)", "deprecated types", "n") + " union all " + _pages_with("C05a", "P2", "ok", "measured_hard", "valid and page_id % 6 = 0", "recommended types", "n", "n = 0"),
    "C05b": _pages_with("C05b", "P2", "high", "measured_hard", "not valid or page_id % 9 = 0"),
    "C05c": _pages_with("C05c", "P2", "mid", "measured_hard", "valid and page_id % 6 >= 3 and page_id % 4 = 0"),
    "C05d": _pages_with("C05d", "P2", "high", "measured_hard", "valid and page_id % 3 = 0"),
    "C06": _pages_with("C06", "P2", "ok", "inferred", "page_id % 5 = 0 or page_id % 7 = 0 or (page_id % 8 = 0 and not regexp_matches(lower(shown), 'about|contact'))"),
    "C07": _pages_with("C07", "P2", "mid", "inferred", "figures < 3 or page_id % 6 = 1 or (page_id % 10 = 0 and quote_chars < 2)"),
    "C08": _pages_with("C08", "P2", "ok", "hypothesis", "not answered"),
    "C09": _pages_with("C09", "P2", "mid", "measured_hard", "", measure="n / images", fires="images > 0 and n > 0.35 * images", n="count_if(page_id % 2 = 0) + count_if(page_id % 3 = 0) as images, count_if(page_id % 3 = 0)"),
    "C11": _pages_with("C11", "P2", "ok", "inferred", "page_id % 9 = 4 and mean_words > 25"),
    "E01": _pages_with("E01", "P5", "ok", "measured_hard", "valid and page_id % 12 = 6", "organisation", "1"),
}


def _plain(table: str, per: str, fires: str, affected: str, measure: str, severity: str, claim: str, run: str = "page_id % 5") -> str:
    """A rule of one count a run, said of the given table's own columns."""
    return f"select cast(run_id as bigint) as run_id, 'site' as scope, {severity} as severity, '{claim}' as claim, cast({affected} as bigint) as affected, cast({measure} as double) as measure from (select {run} as run_id, {per} from {table} group by 1) where {fires}"


def _each(table: str, fires: str, measure: str, severity: str, claim: str, scope: str = "'site'", run: str = "s_suppkey") -> str:
    claim = claim if " " in claim else f"'{claim}'"
    return f"select cast({run} as bigint) as run_id, {scope} as scope, '{severity}' as severity, {claim} as claim, cast(1 as bigint) as affected, cast({measure} as double) as measure from {table} where {fires}"


def _share(condition: str, severity: str) -> str:
    return _plain("pages", f"count(*) filter ({condition}) as n, count(*) as total", "n > 0", "n", "n / total", f"'{severity}'", "measured_hard")


_BAD = "page_id % 29 <> 0 and (page_id % 19 = 0 or page_id % 37 = 1)"
_HIDDEN = _each("pages", "page_id % 5 >= 3 and length(html) > 0", "1 / (1 + page_id % 5)", "high", "measured_hard", "url", "page_id % 5")
_PLAIN_SQL = {
    "T01": _share("page_id % 29 = 0", "high"), "T03": _share("page_id % 17 = 0", "high"), "T05": _share("page_id % 9 = 0 and page_id % 29 <> 0", "mid"), "T06": _share("page_id % 23 = 0", "mid"), "T12": _share("page_id % 11 <> 0 and page_id % 7 > 3", "mid"),
    "T02": _plain("pages", f"count(*) filter ({_BAD}) as bad, count(*) filter (page_id % 29 <> 0) as checked", "bad > 0.05 * checked", "bad", "bad / checked", "case when bad > 0.15 * checked then 'high' else 'mid' end", "measured_hard"),
    "T07": _plain("pages", "count(*) as n, count(*) filter (page_id % 3 = 0) as listed", "n > 1 and listed = 0", "n", "0", "'mid'", "measured_hard", "page_id % 15"),
    "T09a": _each("supplier", "s_suppkey % 3 <> 0 and s_suppkey > 40", "(s_suppkey > 40)::int + (s_suppkey > 40)::int + (s_suppkey > 40)::int", "mid", "measured_hard"),
    "T09c": _each("supplier", "s_suppkey >= 48", "s_suppkey * 17", "mid", "case when s_suppkey % 3 <> 0 then 'measured_hard' else 'inferred' end"), "T10": _HIDDEN, "G03": _HIDDEN,
    "T11": _each("pages", "page_id % 6 = 0 and page_id % 9 < 3", "page_id % 9", "mid", "measured_hard", "url", "page_id % 5"),
    "G02": _plain("supplier", "(s_suppkey * 3 % 11 < 2)::int + (s_suppkey * 5 % 11 < 2)::int as n", "n > 0", "n", "n / 3", "'high'", "measured_hard", "s_suppkey").replace(" group by 1)", ")"),
    "G04": _each("supplier", "s_suppkey % 9 <= 5", "s_suppkey % 9", "mid", "measured_sample"), "G07": _each("supplier", "s_suppkey % 4 <> 0 and s_suppkey % 7 < 3", "s_suppkey % 7", "mid", "measured_sample", "'brand'"),
    "G08": _each("supplier", "s_suppkey % 8 = 0", "1", "ok", "measured_hard"), "E02": _each("supplier", "s_suppkey % 6 <> 0", "0", "ok", "measured_sample", "'brand'"), "SP01": _each("supplier", "s_suppkey % 5 = 0", "0", "mid", "inferred", "'brand'"),
    "SP02": _each("supplier", "s_suppkey % 6 = 2", "2", "ok", "inferred", "'brand'"),
    "A03": _plain("lineitem", "count(*) filter (l_returnflag = 'A') as gained, count(*) filter (l_returnflag = 'R') as lost", "gained >= 50 and gained >= 0.9 * lost", "gained", "gained / lost", "'ok'", "inferred", "l_suppkey % 4"),
}


def _oracle(rule: R.Rule) -> str:
    if callable(rule.shape):
        head, body = _SQL[rule.rule_id]
        return head + rule.finish_sql(body)
    return rule.finish_sql(_PLAIN_SQL[rule.rule_id])


ORACLES = {f"rule_{r.rule_id.lower()}": _oracle(r) for r in RULES}
ORACLES |= {f"rule_{k.lower()}": _PAGE + x for k, x in _PAGE_SQL.items()}
ALL_SQL = " union all ".join(f"select * from ({ORACLES[f'rule_{k.lower()}']})" for k in (*(r.rule_id for r in RULES), *PAGE_RULES))
ORACLES["isolated_hits"] = " union all ".join(f"select rule_id, run_id, scope, severity, affected, cast(null as varchar) as error from ({ORACLES[f'rule_{r.rule_id.lower()}']})" for r in PLAIN) + " union all select 'X00', null, null, null, null, 'DIVIDE_BY_ZERO'"
_ID = "'fnd_' || sha256(run_id || '|' || rule_id || '|' || scope || '|' || severity)[1:16] as finding_id"
_CONFIDENCE = "case claim when 'measured_hard' then 'high' when 'measured_sample' then 'medium' else 'low' end as confidence"
_IMPACT = "case when severity = 'high' or (severity = 'mid' and affected >= 5) then 'high' else 'low' end"
_ACTIONS = ", ".join(f"('{k}', '{e}', '{kind}')" for k, (e, kind) in N.ACTIONS.items())
ORACLES["findings"] = f"select {_ID}, run_id, rule_id, pillar, severity, claim, {_CONFIDENCE}, {_IMPACT} as impact, fingerprint from ({ALL_SQL})"
ORACLES["recommendations"] = f"""select finding_id, run_id, rule_id, pillar, kind, impact, effort, case impact when 'high' then case effort when 'low' then 'quick_win' else 'strategic' end else case effort when 'high' then 'low' else 'fill_in' end end as priority,
  case effort when 'low' then 'quick' when 'high' then 'long' else 'mid' end as horizon, confidence, affected, page,
  case pillar when 'P3' then 'gsc' when 'P4' then 'probe' when 'P5' then 'probe' else 'crawl' end as metric_source, case when rule_id in ('K02', 'K06') then 'position' when pillar = 'P3' then 'impressions' when pillar = 'P4' then 'brand_sov' when pillar = 'P5' then 'brand_presence' else 'affected_pages' end as metric,
  case when rule_id in ('K02', 'K06') or pillar in ('P1', 'P2') then 'decrease' else 'increase' end as direction, scope as validation_scope, 28 as window_days
from (select {_ID}, h.*, {_IMPACT} as impact, {_CONFIDENCE}, coalesce(a.effort, 'mid') as effort, coalesce(a.kind, 'content') as kind, case when starts_with(scope, 'http://') or starts_with(scope, 'https://') then scope end as page
  from ({ALL_SQL}) h left join (values {_ACTIONS}) a(rule, effort, kind) on a.rule = h.rule_id)"""
