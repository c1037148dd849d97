"""Names of many projects found at once, against patterns made for each."""

from __future__ import annotations

import random
import re

from sparkwright.functions.lexicons import Lexicon
from sparkwright.operators import probes as P
from sparkwright.operators import serp as S
from sparkwright.operators import terms as T

CJK = re.compile(T.CJK)


def mentions(text, term):
    if not term:
        return False
    if CJK.search(term):
        return term.lower() in text.lower()
    return re.search(rf"\b{re.escape(term)}\b", text, re.I | re.A) is not None


TERMS = ["acme", "Acme Corp", "a-b", ".net", "c++", "über", "東京", "x", "acme corp ltd", "don't", "Ü-boot", "", "b.c"]
TEXTS = ["Acme corp is here", "acmecorp", "use .NET now", "the.net here", "c++", "a c++b", "xc++d", "in 東京都", "A-B or a--b", "ÜBER über alles", "acme  corp", "acme corp, ltd", "ACME CORP LTD", "b.c. d", "ab.cd", "i don't know", "", None, "x", "u-boot Ü-BOOT"]


def test_found(spark):
    rng = random.Random(4)
    pieces = ["acme", "corp", "ltd", " ", ".", "-", "net", "c++", "x", "b", "東京", "ü", "don't", "_"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    rows = [(i % 3, i, t) for i, t in enumerate(texts)]
    terms = [(p, k, t, bool(CJK.search(t))) for p in range(2) for k, t in enumerate(TERMS) if (p + k) % 3]
    got = T.found(spark.createDataFrame(rows, "project_id long, evidence_id long, text string"), spark.createDataFrame(terms, "project_id long, place int, term string, part boolean"), ["evidence_id"])
    want = {(i, p, k) for p, i, t in rows for q, k, term, _ in terms if p == q and t and mentions(t, term)}
    found = [(r.evidence_id, r.project_id, r.place) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) and len(want) > 100


def answers_of(spark):
    lines = ["Acme is the best.", "We avoid Acme Corp.", "Acme vs rival: hm", "Probably nice.", "acme might be great", "Not the best acme", "東京社 is great", "no info", "I'm not aware of it", "see foo.example", "Zeta and Rival Two"]
    rng = random.Random(5)
    texts = [None, ""] + ["".join(rng.choice(lines) + rng.choice([" ", "\n"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    return spark.createDataFrame([(i % 3, i, "e", t) for i, t in enumerate(texts)], "project_id long, evidence_id long, provider string, answer_text string")


NAMES = {0: ("Acme", "foo.example", ["Acme Corp", "東京社"], ["Rival", "Rival Two", "Zeta"]), 1: ("best", "www.foo.example", [], ["Acme"])}


def test_parse_is_that_of_one_site(spark):
    rows = [(p, kind, i, t) for p, (brand, domain, aliases, rivals) in NAMES.items() for kind, ts in (("brand", [brand]), ("domain", [domain]), ("alias", aliases), ("competitor", rivals)) for i, t in enumerate(ts)]
    terms = spark.createDataFrame(rows, "project_id long, kind string, place int, term string")
    answers = answers_of(spark)
    columns = ["evidence_id", "brand_present", "competitors", "sentiment", "hedged", "unknown_admission"]
    got = {r[0]: tuple(r) for r in T.parse(answers, terms).select(*columns).collect()}
    assert len(got) == answers.count()
    for p, (brand, domain, aliases, rivals) in NAMES.items():
        one = P.parse(answers.where(f"project_id = {p}"), brand, domain, aliases, rivals, Lexicon()).select(*columns).collect()
        assert {r[0]: tuple(r) for r in one} == {k: v for k, v in got.items() if k % 3 == p}
    assert all(not v[1] and v[2] == [] and v[3] == "neutral" for k, v in got.items() if k % 3 == 2)
    shares = {(r.project_id, r.name): r.pct for r in T.share_of_voice(T.parse(answers, terms), terms).collect()}
    n = sum(k % 3 == 0 for k in got)
    for name in NAMES[0][3]:
        assert shares[0, name] == int(sum(name in v[2] for k, v in got.items() if k % 3 == 0) / n * 100 + 0.5)
    assert T.parse(answers, terms.limit(0)).where("brand_present").count() == 0 and T.parse(answers.limit(0), terms).count() == 0


def test_sites_of_each_run(spark):
    serp = spark.createDataFrame([(1, 1, "k", "www.A.example", 12), (1, 1, "k", "b.example", 3), (1, 1, "k", "c.example", 4), (2, 1, "k", "a.example", 1), (2, 1, "k", "b.example", 2), (3, 1, "k", "a.example", 1), (1, 2, "m", "b.example", 1), (1, 2, "m", "c.example", 2)], "run_id long, keyword_id long, keyword string, domain string, item_rank long")
    labs = spark.createDataFrame([], "run_id long, keyword_id long, keyword string, search_volume long, difficulty long, intent string")
    sites = spark.createDataFrame([(1, "a.example", True), (1, "b.example", False), (1, "www.C.example", False), (1, "c.example", False), (2, "b.example", True), (2, "a.example", False)], "run_id long, domain string, own boolean")
    got = sorted((r.run_id, r.keyword_id, r.gap_type, r.our_position, r.rivals) for r in S.keyword_gaps_of(serp, labs, sites).collect())
    assert got == [(1, 1, "weak", 12, 2), (1, 2, "missing", None, 2), (2, 1, "winning", 2, 1)]
    share = {(r.run_id, r.domain): (r["items"], r.own) for r in S.share_of_serp_of(serp, sites).collect()}
    assert share == {(1, "a.example"): (0, True), (1, "b.example"): (2, False), (1, "c.example"): (2, False), (2, "a.example"): (1, False), (2, "b.example"): (1, True)}
