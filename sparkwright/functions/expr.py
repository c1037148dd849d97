"""Scalar functions as ``Column`` expressions.

All of them stay in the JVM.  Where Spark's own function differs from the
semantics wanted (rounding, word boundaries, invalid URLs), the difference is
spelled out here once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = re.compile("[一-鿿぀-ヿ가-힣]")
_SPECIAL = re.compile(r"([.*+?^${}()|\[\]\\])")
WORD = "[A-Za-z0-9_]"


def js_round(x: Column, places: int = 0) -> Column:
    """Half up towards positive infinity, unlike ``F.round`` (which rounds -2.5 to -3)."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def ratio(part: Column, whole: Column) -> Column:
    """Null where nothing was measured: null is "not measured", 0 is "measured zero"."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval; 0 without samples."""
    n = n.cast("double")
    p = hits.cast("double") / n
    zz = z * z
    low = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0)


def wilson_high(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Upper bound, by symmetry one less the lower bound of the misses; 0 without samples."""
    return F.when(n > 0, 1 - wilson_low(n - hits, n, z)).otherwise(0.0)


def finite_or_zero(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


# text


def _quoted(term: str) -> str:
    return _SPECIAL.sub(r"\\\1", term)


def pattern(term: str) -> str:
    """A term as a regular expression with ASCII word boundaries at both ends.

    A boundary at an end that is not a word character needs a word character
    beside it, as ``\\b`` does.
    """
    quoted = _quoted(term)
    left = f"(?<!{WORD})" if re.match(WORD, term[0]) else f"(?<={WORD})"
    right = f"(?!{WORD})" if re.match(WORD, term[-1]) else f"(?={WORD})"
    return f"(?i){left}{quoted}{right}"


def mentions(text: Column, term: str) -> Column:
    """Whole-word match, or a substring for terms with CJK characters; an empty term matches nothing."""
    if not term:
        return F.lit(False)
    if _CJK.search(term):
        return F.contains(F.lower(text), F.lit(term.lower()))
    return _any(text, [term], [])


def hits_term(text: Column, term: str, plain: str = "[a-z']+") -> Column:
    """Whole-word match for purely alphabetic terms, else a substring (phrases, CJK)."""
    if not term:
        return F.lit(False)
    if re.fullmatch(plain, term, re.IGNORECASE) and not _CJK.search(term):
        return text.rlike(pattern(term))
    return F.contains(F.lower(text), F.lit(term.lower()))


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _any(text: Column, words: Sequence[str], parts: Sequence[str]) -> Column:
    """Whether any of ``words`` stands in the text as a whole word, or any of ``parts`` anywhere: one pattern for each kind."""
    out = F.lit(False)
    inner = [w for w in words if re.match(WORD, w[0]) and re.match(WORD, w[-1])]
    if inner:
        found = text.rlike(f"(?i)(?<!{WORD})(?:{'|'.join(map(_quoted, inner))})(?!{WORD})")
        # looking for the letters alone is cheap and spares most texts the pattern
        out = out | (any_of([F.contains(F.lower(text), F.lit(w.lower())) for w in inner]) & found if "".join(inner).isascii() else found)
    for w in words:
        if w not in inner:
            out = out | text.rlike(pattern(w))
    if parts:
        out = out | F.lower(text).rlike("|".join(_quoted(x.lower()) for x in parts))
    return out


def mentions_any(text: Column, terms: Sequence[str]) -> Column:
    """``mentions`` of any of the terms."""
    terms = [t for t in terms if t]
    return _any(text, [t for t in terms if not _CJK.search(t)], [t for t in terms if _CJK.search(t)])


def hits_any(text: Column, terms: Sequence[str], plain: str = "[a-z']+") -> Column:
    """``hits_term`` of any of the terms."""
    terms = [t for t in terms if t]
    whole = [t for t in terms if re.fullmatch(plain, t, re.IGNORECASE) and not _CJK.search(t)]
    return _any(text, whole, [t for t in terms if t not in whole])


SENTENCE_END = "[.!?。！？；;\n]+"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s 　]+|[\s 　]+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), trim), lambda s: s != "")


def norm_keyword(text: Column) -> Column:
    return F.lower(F.regexp_replace(trim(text), r"\s+", " "))


def fingerprint(rule_id: Column, scope: Column) -> Column:
    return F.sha2(F.concat(rule_id, F.lit("::"), F.lower(F.trim(scope))), 256)


# URLs


def host(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; null if the URL can't be parsed."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def norm_domain(domain: Column) -> Column:
    name = F.lower(F.trim(domain))
    return F.when(F.startswith(name, F.lit("www.")), F.substr(name, F.lit(5))).otherwise(name)


def in_domain(host_: Column, domain: Column) -> Column:
    """The domain itself or a subdomain."""
    return (host_ == domain) | F.endswith(host_, F.concat(F.lit("."), domain))


def suffixes(host_: Column) -> Column:
    """``a.b.c`` -> ``a.b.c``, ``b.c``, ``c``: turns a suffix match into an equi-join."""
    parts = F.split(host_, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def origin(host_: Column, domain: Column) -> Column:
    return F.when(in_domain(host_, domain), "owned").otherwise("third_party")


# Platforms by domain, and those made of user contributions.
PLATFORMS = {
    "reddit.com": "reddit",
    "redd.it": "reddit",
    "youtube.com": "youtube",
    "youtu.be": "youtube",
    "linkedin.com": "linkedin",
    "quora.com": "quora",
    "wikipedia.org": "wikipedia",
    "github.com": "github",
}
UGC = ("reddit", "quora", "youtube", "linkedin")


def platform(host_: Column, platforms: dict[str, str] | None = None) -> Column:
    out = F.lit("other")
    for domain, name in (platforms or PLATFORMS).items():
        out = F.when(in_domain(host_, F.lit(domain)), name).otherwise(out)
    return out


TRACKING = r"^(utm_[^=]*|fbclid|gclid|msclkid|ref)(=|$)"


def normalize_url(url: Column) -> Column:
    """http(s) only; no fragment, tracking parameters, ``www.`` or trailing slash; query sorted; null otherwise.

    Takes absolute URLs; relative ones are resolved by ``resolve``.
    """
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    query = F.try_parse_url(url, F.lit("QUERY"))
    kept = F.array_sort(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    short = F.regexp_replace(path, "/+$", "")
    full = F.concat(scheme, F.lit("://"), host(url), F.when(short == "", "/").otherwise(short), tail)
    return F.when(scheme.isin("http", "https"), full)


def resolve(base: Column, link: Column) -> Column:
    """Absolute, protocol-relative, root-relative and plain relative links against ``base``."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("#")) | (link == ""), base)
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def segment_token(segment: Column) -> Column:
    """The template token of one path segment, dates aside."""
    return (
        F.when(segment.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "{uuid}")
        .when(segment.rlike(r"^\d{4}(-\d{2}){1,2}$"), "{date}")
        .when(segment.rlike(r"^(19|20)\d{2}$"), "{date}")
        .when(segment.rlike(r"^\d+$"), "{id}")
        .otherwise(segment)
    )


def url_template(path: Column) -> Column:
    """Path with ids, uuids and dates replaced; one or two digits after a date belong to it."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    step = lambda acc, s: F.concat(
        acc, F.array(F.when(s.rlike(r"^\d{1,2}$") & (F.element_at(acc, -1) == "{date}"), "{date}").otherwise(segment_token(s)))
    )
    folded = F.aggregate(parts, F.array(F.lit("")), step)
    return F.when(F.size(parts) == 0, "/").otherwise(F.array_join(folded, "/"))


def brand_of_domain(domain: Column) -> Column:
    """The label that names the brand: the first of one or two labels, else without one or two short suffix labels."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(domain), "^https?://", ""), r"^www\.", "")
    parts = F.split(F.regexp_extract(bare, "^[^/:]*", 0), r"\.")
    n = F.size(parts)
    two_short = (n >= 3) & (F.length(F.element_at(parts, -1)) <= 3) & (F.length(F.element_at(parts, -2)) <= 3)
    return F.when(n <= 2, parts[0]).when(two_short, F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))


# Severity and effort vocabulary.
SEVERITY_WEIGHT = {"high": 3.0, "mid": 1.0, "ok": 0.25}
SEVERITY_RANK = {"high": 2, "mid": 1, "ok": 0}
PILLAR_WEIGHT = {"P1": 0.3, "P2": 0.2, "P3": 0.2, "P4": 0.1, "P5": 0.2}
HEALTH_BUDGET = 12.0


def lookup(value: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def input_url(raw: Column) -> Column:
    """The address that a user typed, as a crawler's entry: ``https://`` where no scheme is given, host in lower case; null without a host that has a dot."""
    text = F.trim(raw)
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    part = lambda name: F.try_parse_url(full, F.lit(name))
    address = F.lower(F.regexp_replace(part("AUTHORITY"), "^[^@]*@", ""))
    file = F.coalesce(part("FILE"), F.lit(""))
    rest = F.concat(F.when(file.startswith("/"), F.lit("")).otherwise("/"), file, F.coalesce(F.concat(F.lit("#"), part("REF")), F.lit("")))
    return F.when(F.contains(part("HOST"), F.lit(".")), F.concat(F.lower(part("PROTOCOL")), F.lit("://"), address, rest))
