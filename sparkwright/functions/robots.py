"""robots.txt and sitemap texts."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def allowed(text: str, path: str, agent: str = "*") -> bool:
    """Whether ``path`` may be fetched.

    Groups for ``*`` and for the agent count together, the last ``User-agent``
    line before a rule decides its group, the longest prefix wins and an allow
    wins a tie; there are no wildcards.
    """
    mine = found = False
    longest = {"allow": -1, "disallow": -1}
    for line in text.split("\n"):
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon or not key:
            continue
        if key == "user-agent":
            mine = value == "*" or value.lower() == agent.lower()
            found |= mine
        elif mine and key in longest and value and path.startswith(value):
            longest[key] = max(longest[key], len(value))
    return not found or longest["disallow"] < 0 or longest["allow"] >= longest["disallow"]


@F.pandas_udf(BooleanType())
def robots_allowed(text: pd.Series, path: pd.Series, agent: pd.Series) -> pd.Series:
    """Null texts (no robots.txt) allow everything."""
    return pd.Series([True if t is None else allowed(t, p or "/", a or "*") for t, p, a in zip(text, path, agent, strict=True)])


def sitemap_urls(text: Column) -> Column:
    """URLs that ``Sitemap:`` lines of a robots.txt name."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), lambda x: F.trim(x))


def locations(xml: Column) -> Column:
    """Contents of ``<loc>`` elements with XML's named entities decoded, the ampersand last."""
    out = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    plain = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

    def decode(x: Column) -> Column:
        for k, v in plain.items():
            x = F.replace(x, F.lit(k), F.lit(v))
        return x

    return F.transform(out, decode)


def decode_entities(text: str) -> str:
    """Named and numeric entities; numbers beyond Unicode stay as they are."""
    keep = re.sub(r"&#(x?)([0-9a-fA-F]+);", lambda m: m[0] if int(m[2], 16 if m[1] else 10) <= 0x10FFFF else "&amp;" + m[0][1:], text)
    return html.unescape(keep)
