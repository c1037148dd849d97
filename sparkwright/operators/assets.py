"""Prompts, anchors, page classes, budgets and validation: small per-row derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import expr as E

#: (kind, text): 5 brand, 8 recommendation, 6 comparison, 8 how-to and 3 trust questions
PROMPTS = (
    ("brand", "What does {brand} offer?"), ("brand", "Who is {brand} made for?"), ("brand", "How much does {brand} cost?"), ("brand", "What do customers say about {brand}?"), ("brand", "Is {brand} worth it?"),
    ("recommendation", "Which {category} tools would you suggest?"), ("recommendation", "Best {category} for a small team?"), ("recommendation", "Best {category} for a large company?"), ("recommendation", "Most affordable {category}?"),
    ("recommendation", "Which {category} is easiest to start with?"), ("recommendation", "Top rated {category} this year?"), ("recommendation", "Which {category} do experts use?"), ("recommendation", "What {category} works well in {market}?"),
    ("comparison", "How do {brand} and {rival} differ?"), ("comparison", "Which is better, {brand} or {rival}?"), ("comparison", "What could replace {rival}?"), ("comparison", "Compare leading {category} products."), ("comparison", "Who competes with {rival}?"), ("comparison", "Cheaper options than {rival}?"),
    ("how_to", "How do I choose a {category}?"), ("how_to", "How do I set up a {category}?"), ("how_to", "How do I move to another {category}?"), ("how_to", "How do I measure a {category}?"), ("how_to", "What mistakes are common with {category}?"),
    ("how_to", "How long does a {category} project take?"), ("how_to", "What does a {category} need to work?"), ("how_to", "How do I train people on a {category}?"), ("trust", "Is {brand} safe to use?"), ("trust", "Which {category} vendors are trustworthy?"), ("trust", "Where is {brand} based?"),
)


#: the same questions in Chinese
PROMPTS_ZH = (
    ("brand", "{brand}提供哪些产品或服务？"), ("brand", "{brand}适合哪些人使用？"), ("brand", "{brand}要多少钱？"), ("brand", "客户对{brand}怎么看？"), ("brand", "{brand}值得用吗？"),
    ("recommendation", "你会推荐哪些{category}工具？"), ("recommendation", "小团队用哪款{category}最合适？"), ("recommendation", "大公司用哪款{category}最合适？"), ("recommendation", "最实惠的{category}是哪款？"),
    ("recommendation", "哪款{category}最容易上手？"), ("recommendation", "今年评分最高的{category}有哪些？"), ("recommendation", "专家们用哪款{category}？"), ("recommendation", "在{market}，哪款{category}效果好？"),
    ("comparison", "{brand}和{rival}有什么不同？"), ("comparison", "{brand}和{rival}哪个更好？"), ("comparison", "有什么可以代替{rival}？"), ("comparison", "比较一下主要的{category}产品。"), ("comparison", "{rival}的竞争对手有谁？"), ("comparison", "有比{rival}更便宜的选择吗？"),
    ("how_to", "怎样挑选{category}？"), ("how_to", "怎样搭建{category}？"), ("how_to", "怎样换到另一款{category}？"), ("how_to", "怎样衡量{category}的效果？"), ("how_to", "使用{category}常犯哪些错误？"),
    ("how_to", "一个{category}项目要多长时间？"), ("how_to", "{category}需要什么条件才能运行？"), ("how_to", "怎样培训员工使用{category}？"), ("trust", "使用{brand}安全吗？"), ("trust", "哪些{category}厂商值得信赖？"), ("trust", "{brand}的总部在哪里？"),
)
#: the set of twenty that earlier runs were asked, for comparisons with them: (kind, English, Chinese)
EARLIER = (
    ("recommendation", "Name some good {category} products.", "请列举一些好的{category}产品。"), ("recommendation", "Suggest {category} tools for a team of ten.", "请为十人团队推荐{category}工具。"), ("recommendation", "What is the strongest {category} right now?", "现在最强的{category}是哪款？"), ("recommendation", "Which {category} fits a small budget?", "预算不多时选哪款{category}？"),
    ("comparison", "How does {brand} stand against {rival}?", "{brand}与{rival}相比如何？"), ("comparison", "Is {rival} the better choice, or is something else?", "{rival}是更好的选择，还是另有其他？"), ("alternatives", "What can be used in place of {brand}?", "可以用什么来代替{brand}？"), ("alternatives", "Is there a free {category}?", "有免费的{category}吗？"),
    ("evaluation", "Can {brand} be relied upon?", "{brand}可靠吗？"), ("evaluation", "Should one pay for {brand}?", "应该为{brand}付费吗？"), ("how_to", "What matters when choosing a {category}?", "选择{category}时什么最重要？"), ("how_to", "What are the steps to introduce a {category}?", "引入{category}有哪些步骤？"),
    ("pricing", "What do {category} products cost?", "{category}产品要多少钱？"), ("pricing", "Does {brand} have a free plan?", "{brand}有免费方案吗？"), ("scenario", "Which {category} suits people who work from home?", "哪款{category}适合居家办公的人？"), ("scenario", "Which {category} should a new company start with?", "新公司应该从哪款{category}开始？"),
    ("brand", "What can {brand} do?", "{brand}能做什么？"), ("brand", "What is special about {brand}?", "{brand}有什么特别之处？"), ("trust", "Which {category} is held in high regard?", "哪款{category}口碑最好？"), ("trust", "Which {category} do experts name?", "专家们提到哪款{category}？"),
)
OTHERS = {"en": "other vendors", "zh": "其他厂商"}


def render_prompts(projects: DataFrame, prompts: tuple[tuple[str, str], ...] = PROMPTS, language: str = "en") -> DataFrame:
    """All prompts of each ``projects (project_id, brand, category, rival, market)`` row, with whether they name the brand.

    A missing rival becomes "other vendors", in the prompts' language.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(k).alias("kind"), F.lit(t).alias("template")) for i, (k, t) in enumerate(prompts)])
    x = projects.withColumn("_p", F.explode(rows)).select("*", "_p.*")
    text = F.col("template")
    for name, value in (("brand", F.col("brand")), ("category", F.col("category")), ("rival", F.coalesce("rival", F.lit(OTHERS[language]))), ("market", F.col("market"))):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return x.select("project_id", "priority", "kind", text.alias("text"), F.contains("template", F.lit("{brand}")).alias("branded"))


# Anchor texts that say nothing.
GENERIC = ("", "click here", "here", "link", "this", "this link", "website", "web site", "site", "visit", "visit website", "read more", "more", "learn more", "home", "homepage", "www")


def anchor_class(anchor: Column, brand: Column, own: Column | None = None) -> Column:
    """generic, url, domain, brand (it holds a brand of two letters or more, or the own domain) or else keyword; a null anchor is generic."""
    a = F.coalesce(F.lower(E.trim(anchor)), F.lit(""))
    names = (F.length(brand) >= 2) & F.contains(a, F.lower(brand))
    if own is not None:
        names = names | F.contains(a, F.lower(own))
    return F.when(a.isin(*GENERIC), "generic").when(a.rlike("^https?://"), "url").when(a.rlike(r"^[\w.-]+\.[a-z]{2,}$"), "domain").when(names, "brand").otherwise("keyword")


# Words in a path that tell what a page is for.
INFORMS = ("blog", "article", "articles", "news", "guide", "guides", "tutorial", "tutorials", "post", "posts", "resource", "resources", "faq")
SELLS = ("product", "products", "shop", "store", "buy", "pricing", "price", "checkout", "cart", "deal", "deals", "order")


def landing_class(url: Column) -> Column:
    """What a page that a search leads to is for, by its path: informational, transactional or other."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), url))
    word = lambda words: path.rlike(rf"\b({'|'.join(words)})\b")
    return F.when(word(INFORMS) | path.rlike(r"/20\d\d/"), "informational").when(word(SELLS), "transactional").otherwise("other")


def intent_class(intent: Column) -> Column:
    """What a query is for; null where that can't be said of its intent."""
    i = F.lower(intent)
    return F.when(F.contains(i, F.lit("info")), "informational").when(F.contains(i, F.lit("transac")) | F.contains(i, F.lit("commerc")), "transactional")


def page_class(path: Column) -> Column:
    return F.when(path.rlike("(?i)/(product|shop|item|buy)"), "product").when(path.rlike("(?i)/(blog|news|guide|article)"), "article").when(path.rlike("(?i)/(category|collection)"), "category").otherwise("other")


def page_type(questions: Column, lists: Column, chars: Column) -> Column:
    """faq by its share of question headings, listicle by its lists, article by its length, else page."""
    return F.when(questions >= 0.3, "faq").when(lists >= 5, "listicle").when(chars >= 2500, "article").otherwise("page")


def estimate(calls: Column) -> list[Column]:
    """Least and greatest cost in dollars and minutes of so many probe calls."""
    return [E.js_round(calls * 0.002, 2).alias("cost_low"), E.js_round(calls * 0.02, 2).alias("cost_high"), F.ceil(calls / 120 + 2).alias("minutes_low"), F.ceil(calls / 40 + 2).alias("minutes_high")]


def vitals(lcp: Column, inp: Column, cls: Column, ttfb: Column) -> list[Column]:
    return [(lcp <= 2500).alias("lcp_ok"), (inp <= 200).alias("inp_ok"), (cls <= 0.1).alias("cls_ok"), (ttfb > 800).alias("ttfb_slow")]


#: metric, its source and direction by pillar, for when nothing else is said
VALIDATION = {"P1": ("crawl", "affected_pages", "decrease"), "P2": ("crawl", "affected_pages", "decrease"), "P3": ("gsc", "impressions", "increase"), "P4": ("probe", "brand_sov", "increase"), "P5": ("probe", "brand_presence", "increase")}
WINDOW_DAYS = 28
# Rules whose fix shows in another metric than their pillar's.
OVERRIDES = {"K02": ("position", "decrease"), "K06": ("position", "decrease")}


def validation(pillar: Column, rule_id: Column | None = None, scope: Column | None = None) -> list[Column]:
    """How a fix is to be measured: source, metric and direction by pillar, or the rule's own, and, if a scope is given, where and for how many days."""
    source, metric, direction = (E.lookup(pillar, {k: v[i] for k, v in VALIDATION.items()}) for i in range(3))
    if rule_id is not None:
        own = lambda i, other: F.coalesce(E.lookup(rule_id, {k: v[i] for k, v in OVERRIDES.items()}), other)
        metric, direction = own(0, metric), own(1, direction)
    out = [source.alias("metric_source"), metric.alias("metric"), direction.alias("direction")]
    if scope is not None:
        out += [F.when(F.coalesce(scope, F.lit("")) == "", "site").otherwise(scope).alias("validation_scope"), F.lit(WINDOW_DAYS).alias("window_days")]
    return out


def bump_version(version: Column) -> Column:
    """``vN`` to ``vN+1``, anything else to ``v2``."""
    n = F.regexp_extract(F.coalesce(version, F.lit("")), r"^v(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("v"), (n.cast("int") + 1).cast("string"))).otherwise("v2")


def unknown_references(text: Column, allowed: Column) -> Column:
    """Recommendation ids that a text cites and that are not allowed."""
    return F.array_except(F.regexp_extract_all(text, F.lit(r"\b(rec_[a-z0-9]+)\b"), F.lit(1)), allowed)
