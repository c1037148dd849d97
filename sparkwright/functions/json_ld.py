"""Structured data of a page: types, validity, required fields, and whether the page says what the data say."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

# The fields without which a type gets no rich result.
REQUIRED = {
    "Product": ("name", "image"),
    "Article": ("headline", "datePublished"),
    "NewsArticle": ("headline", "datePublished"),
    "BlogPosting": ("headline", "datePublished"),
    "BreadcrumbList": ("itemListElement",),
    "Organization": ("name",),
    "Recipe": ("name", "image"),
    "Event": ("name", "startDate", "location"),
    "Review": ("itemReviewed", "author", "reviewRating"),
    "AggregateRating": ("ratingValue",),
    "VideoObject": ("name", "description", "thumbnailUrl", "uploadDate"),
    "Course": ("name", "description"),
    "JobPosting": ("title", "description", "datePosted", "hiringOrganization", "jobLocation"),
}
DEPRECATED = ("FAQPage", "HowTo")
#: texts of a root that the page should show
STATED = ("name", "headline")
_SPACE = re.compile(r"\s+")


def roots(block: object) -> Iterator[dict]:
    """The entities of a parsed block: items of a list, members of ``@graph``."""
    for item in block if isinstance(block, list) else [block]:
        if isinstance(item, dict):
            graph = item.get("@graph")
            yield from (x for x in graph if isinstance(x, dict)) if isinstance(graph, list) else (item,)


def types_of(node: dict) -> list[str]:
    kind = node.get("@type")
    return [kind] if isinstance(kind, str) else [x for x in kind if isinstance(x, str)] if isinstance(kind, list) else []


def stated(node: object) -> Iterator[str]:
    """Texts of questions and answers and prices of offers, at any depth."""
    if isinstance(node, list):
        for x in node:
            yield from stated(x)
    elif isinstance(node, dict):
        kinds = types_of(node)
        if ("Question" in kinds or "Answer" in kinds) and isinstance(node.get("text"), str):
            yield node["text"]
        if "Offer" in kinds and isinstance(node.get("price"), (str, int, float)) and not isinstance(node["price"], bool):
            yield str(node["price"])
        for k, v in node.items():
            if k != "@type":
                yield from stated(v)


def _blank(value: object) -> bool:
    return value is None or value == [] or (isinstance(value, str) and not value.strip())


def summary(blocks: list[str], text: str) -> dict:
    """What the rules ask of a page's blocks, given the page's visible text.

    Blocks that don't parse count as invalid; every entity whose own context
    isn't schema.org counts against the context, members of a graph too.
    Missing fields are ``Type.field``, once for each entity.
    """
    out: dict = {"ld_invalid": 0, "ld_context": 0, "ld_types": [], "ld_same_as": [], "ld_missing": [], "ld_absent": []}
    clean = lambda x: _SPACE.sub(" ", x).strip().lower()
    shown = clean(text)
    for raw in blocks:
        try:
            block = json.loads(raw)
        except ValueError:
            out["ld_invalid"] += 1
            continue
        for root in roots(block):
            kinds, same = types_of(root), root.get("sameAs")
            out["ld_context"] += "schema.org" not in json.dumps(root.get("@context")).lower()
            out["ld_types"] += kinds
            out["ld_same_as"] += [same] if isinstance(same, str) else [x for x in same if isinstance(x, str)] if isinstance(same, list) else []
            out["ld_missing"] += [f"{k}.{f}" for k in kinds for f in REQUIRED.get(k, ()) if _blank(root.get(f))]
            says = [root[f] for f in STATED if isinstance(root.get(f), str)] + list(stated(root))
            out["ld_absent"] += [x for x in says if clean(x) and clean(x) not in shown]
    return out
