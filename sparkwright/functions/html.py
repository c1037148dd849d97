"""Page features by Python's HTML parser, in Arrow batches.

One parse of each page yields all signals; queries then use plain columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import json_ld

SCHEMA = (
    "title string, n_h1 int, h1 string, description string, canonical string, robots string, viewport boolean, hreflangs array<string>, images int, missing_alt int, lists int, tables int, "
    "mean_paragraph_words double, h2_questions double, mixed_content boolean, links array<string>, text_chars int, json_ld array<string>, "
    "n_paragraphs int, first_answer int, figures int, quote_chars int, quoted boolean, author boolean, dated boolean, about boolean, "
    "ld_invalid int, ld_context int, ld_types array<string>, ld_same_as array<string>, ld_missing array<string>, ld_absent array<string>"
)
# What marks figures, quotation marks and pages about the site, and how long an answer is.
_FIGURE, _QUOTES, _ABOUT = re.compile(r"[0-9]+(?:[.,][0-9]+)?%?"), "\"“”„‟'‘’", re.compile(r"about|contact|关于|联系|关於|聯系|聯絡")
ANSWER_CHARS = 40
_SPACE = re.compile(r"\s+")
_QUESTION = re.compile(r"(\?|？|^(what|how|why|when|where|who|which)\b)", re.IGNORECASE)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out = {"title": None, "description": None, "canonical": None, "robots": None, "viewport": False, "hreflangs": [], "images": 0, "missing_alt": 0, "lists": 0, "tables": 0, "mixed_content": False, "links": [], "json_ld": []}
        self.text: list[str] = []
        self.blocks: dict[str, list[list[str]]] = {"title": [], "h1": [], "h2": [], "p": []}
        self.open: list[str] = []
        self.hidden = 0
        self.script: list[str] | None = None
        self.anchor: list[str] | None = None
        self.anchors: list[str] = []
        self.out |= {"quoted": False, "author": False, "dated": False}

    def _signals(self, tag: str, a: dict[str, str]) -> None:
        """Marks of an author, of a date and of quotations, by tag, attribute and class."""
        out, names = self.out, a.get("class", "")
        prop = a.get("itemprop", "")
        out["author"] |= a.get("rel") == "author" or prop == "author" or "author" in names or "byline" in names
        out["dated"] |= tag == "time" or "datetime" in a or prop in ("datePublished", "dateModified") or "date" in names or "publish" in names or (tag == "meta" and a.get("property") == "article:published_time")
        out["quoted"] |= tag in ("blockquote", "q")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, out = {k: v or "" for k, v in attrs}, self.out
        self._signals(tag, a)
        if tag in ("script", "style"):
            self.hidden += 1
            if tag == "script" and a.get("type", "").lower() == "application/ld+json":
                self.script = []
        elif tag in self.blocks:
            if tag == "p" and "p" in self.open:
                self.open.remove("p")  # a paragraph ends where the next begins
            self.open.append(tag)
            self.blocks[tag].append([])
        elif tag == "meta":
            name = a.get("name", "").lower()
            if name in ("description", "robots") and out[name] is None:
                out[name] = a.get("content", "").strip()
            out["viewport"] |= name == "viewport"
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and out["canonical"] is None:
                out["canonical"] = a.get("href")
            if "alternate" in rel and a.get("hreflang"):
                out["hreflangs"].append(a["hreflang"])
        elif tag == "img":
            out["images"] += 1
            out["missing_alt"] += not a.get("alt", "").strip()
        elif tag in ("ul", "ol"):
            out["lists"] += 1
        elif tag == "table":
            out["tables"] += 1
        elif tag == "a" and "href" in a:
            self.anchor = [a["href"], " "]
            if a["href"]:
                out["links"].append(a["href"])
        if tag in ("img", "script", "iframe", "link") and (a.get("src") or a.get("href", "") if tag != "a" else "").startswith("http://"):
            out["mixed_content"] = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
            if self.script is not None:
                self.out["json_ld"].append("".join(self.script))
                self.script = None
        elif tag == "a" and self.anchor is not None:
            self.anchors.append("".join(self.anchor).lower())
            self.anchor = None
        elif tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
        if not self.hidden:
            if "title" not in self.open:
                self.text.append(data)
            for tag in self.open:
                self.blocks[tag][-1].append(data)
            if self.anchor is not None:
                self.anchor.append(data)


def parse(html: str | None) -> dict:
    """All features of one page; a null or broken page gives what could be read."""
    page = _Page()
    page.feed(html or "")
    page.close()
    clean = lambda parts: _SPACE.sub(" ", "".join(parts)).strip()
    out = page.out
    blocks = {k: [clean(x) for x in v] for k, v in page.blocks.items()}
    words = [len(p.split()) for p in blocks["p"] if p]
    out["title"] = next((t for t in blocks["title"] if t), None)
    out["n_h1"] = len(blocks["h1"])
    out["h1"] = next((t for t in blocks["h1"] if t), None)
    out["mean_paragraph_words"] = sum(words) / len(words) if words else None
    out["h2_questions"] = sum(bool(_QUESTION.search(t)) for t in blocks["h2"]) / len(blocks["h2"]) if blocks["h2"] else None
    text = clean(page.text)
    out["text_chars"] = len(text)
    paragraphs = [p for p in blocks["p"] if p]
    out["n_paragraphs"] = len(paragraphs)
    out["first_answer"] = next((i for i, p in enumerate(paragraphs) if len(p) >= ANSWER_CHARS and p[-1] not in "?？"), None)
    out["figures"] = len(_FIGURE.findall(text))
    out["quote_chars"] = sum(c in _QUOTES for c in text)
    last = ["".join(page.anchor).lower()] if page.anchor is not None else []
    out["about"] = any(_ABOUT.search(x) for x in (*page.anchors, *last, text.lower()))
    return out | json_ld.summary(out["json_ld"], text)


NAMES, KINDS = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
#: pages whose texts and features a worker holds as Python objects at a time
SLICE = 64


def parsed(batches: Iterator[pa.RecordBatch], held: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of the columns ``held`` and html with the features in html's place, a slice of pages at a time: a whole Arrow batch has up to 10,000 pages."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            found = [parse(x.as_py()) for x in part.column(len(held))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(held))), *(pa.array([f[n] for f in found], _ARROW[t]) for n, t in zip(NAMES, KINDS, strict=True))], [*held, *NAMES])


def page_features(pages: DataFrame, key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``carry`` and the features of each row of ``pages (key, html)``, dealt by ``key``."""
    held = (key, *carry)
    first = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in held)
    # a file of large row groups would be parsed by as few tasks as it has of them
    return pages.select(*held, "html").repartition(F.col(key)).mapInArrow(lambda batches: parsed(batches, held), f"{first}, {SCHEMA}")
