"""Plans and state whose size grows with the input, and no faster."""

from __future__ import annotations

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions import html as H
from sparkwright.operators import serp as S
from sparkwright.operators import terms as T
from sparkwright.plans import registry
from sparkwright.plans import rules as R
from sparkwright.sources import bindings
from sparkwright.sources.bindings import Bound
from sparkwright.streaming import progress as G
from tests.helpers import same
from tests.test_terms import CJK, NAMES, TERMS, TEXTS, answers_of


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_citations_pair_no_document_with_all_pages(spark, data):
    """What is asked of the cited URL must not turn the look-up of one page by its id into pairs of all documents and pages."""
    for name in ("citation_origin", "cited_domains", "ugc_share", "site_citations", "retrieved_only"):
        plan = _plan(registry.queries()[name](spark, data))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_citations_without_pages(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert Bound(spark, str(tmp_path)).citations.count() == 0


def test_page_signals_of_cut_and_quoted_references(spark, tmp_path):
    """Titles that end within a reference, or hold others than the three, as its SQL has them."""
    titles = ["a &amp;&amp;&amp", "token = &quot;73ab", "  x\n y &lt;b&gt; ", "", "&amp;lt;"]
    rows = [(i, f"https://e.example/{i}", f"<html><head><title>{t}</title></head><body><h1>x</h1></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    (file,) = (tmp_path / "pages").glob("*.parquet")
    file.rename(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet')")
    same(registry.queries()["page_signals"](spark, str(tmp_path)), con, registry.oracle_sql()["page_signals"])


class _State:
    """State of one key that counts the calls to it."""

    def __init__(self) -> None:
        self.calls, self.value, self.list = [], None, []

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def get(self):
        self.calls.append("get")
        return iter(list(self.list)) if self.value is not None and self.calls.count("get") % 2 == 0 else self.value

    def update(self, x):
        self.calls.append("update")
        self.value = x

    def put(self, x):
        self.calls.append("put")
        self.list = list(x)

    def appendList(self, x):
        self.calls.append("append")
        self.list += x

    def registerTimer(self, _):
        self.calls.append("timer")


def test_late_messages_take_as_many_calls_as_one():
    """Calls to the state don't grow with a run's messages, and what follows an end doesn't wait."""
    state = _State()
    run = G.LateProgress()
    run.init(state)
    rows = [{"at": i * 1000, "seq": i, "msg_type": "progress", "amount": i} for i in range(1000)]
    assert [tuple(r) for r in run.handleInputRows((1,), iter(rows[1:]), None)] == [(1, "running", 999, 0, 0, 999)]
    assert len(state.calls) <= 5 and len(state.list) == 999
    late = [rows[0], {"at": 500_500, "seq": 9999, "msg_type": "done", "amount": 0}]
    state.calls.clear()
    assert [tuple(r) for r in run.handleInputRows((1,), iter(late), None)] == [(1, "done", 502, 0, 0, 500)]
    assert len(state.calls) <= 5 and len(state.list) == 502


@pytest.mark.parametrize("few", [0, 64])
def test_standing_is_found(spark, monkeypatch, few):
    """Few terms a project are looked for as they are, many by pieces: the same rows."""
    monkeypatch.setattr(T, "FEW_TERMS", few)
    terms = spark.createDataFrame([(p, k, t, bool(CJK.search(t))) for p in range(2) for k, t in enumerate(TERMS)], "project_id long, place int, term string, part boolean")
    texts = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(TEXTS * 3)], "project_id long, evidence_id long, text string")
    columns = ["evidence_id", "project_id", "place", "term", "part"]
    want = sorted(map(tuple, T.found(texts, terms, ["evidence_id"]).select(columns).collect()))
    assert sorted(map(tuple, T.standing(texts, terms, ["evidence_id"]).select(columns).collect())) == want and len(want) > 20


def test_few_terms_make_no_row_for_each_word(spark):
    terms = spark.createDataFrame([(p, kind, 0, t) for p, x in NAMES.items() for kind, t in (("brand", x[0]), ("domain", x[1]))], "project_id long, kind string, place int, term string")
    assert "Generate" not in _plan(T.parse(answers_of(spark), terms))


def test_pages_are_parsed_in_slices(monkeypatch):
    """A worker holds the features of some pages, however many a batch has."""
    seen = []
    monkeypatch.setattr(H, "parse", lambda html, f=H.parse: seen.append(html) or f(html))
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": [f"<title>t{i}</title>" if i % 7 else None for i in range(1000)]})
    out = H.parsed(iter([batch]), ("page_id",))
    first = next(out)
    assert len(seen) == first.num_rows <= 100
    rows = [r for b in (first, *out) for r in zip(b.column("page_id").to_pylist(), b.column("title").to_pylist(), strict=True)]
    assert rows == [(i, f"t{i}" if i % 7 else None) for i in range(1000)]


def test_hit_metrics_reads_search_rows_once(spark, data, monkeypatch):
    asked = []
    monkeypatch.setattr(bindings, "frame", lambda s, d, name, f=bindings.frame: asked.append(name) or f(s, d, name))
    registry.queries()["hit_metrics"](spark, data)
    assert asked.count("gsc") == 1


def test_keyword_rules_ask_once_for_what_their_details_share(spark, data, monkeypatch):
    """Joins and aggregations that a rule and its details both need are written once."""
    asked = []
    monkeypatch.setattr(bindings, "frame", lambda s, d, name, f=bindings.frame: asked.append(name) or f(s, d, name))
    registry.queries()["hit_targets"](spark, data)
    assert asked.count("landing") == 1 and asked.count("serp") == 1


def test_items_are_ranked_before_they_are_named(spark, data):
    """Names of keywords and domains aren't moved with the items that are ranked."""
    plan = _plan(Bound(spark, data).serp)
    moved = plan[plan.index("Exchange") :]
    assert "Window" in plan and "concat" not in moved


@pytest.mark.parametrize("domain", ["www.a.example", " WWW.A.example ", "a.www.b", "wwwa.example", "www.www.c", "www.", "", None])
def test_domains_in_normal_form(spark, domain):
    """As the pattern ``^www\\.`` has it."""
    df = spark.createDataFrame([(domain,)], "d string")
    assert df.select(E.norm_domain(F.col("d"))).first()[0] == (None if domain is None else re.sub(r"^www\.", "", domain.strip(" ").lower()))


@pytest.mark.parametrize("frame", [lambda b: R._anchored(b).where("kind = 'keyword'"), lambda b: S.at_sites(b.backlinks, R._sites(b))])
def test_links_elsewhere_go_before_they_are_counted(spark, data, frame):
    """Only links to the wanted sites are judged and counted."""
    plan = _plan(frame(Bound(spark, data)))
    assert plan.count("LeftSemi") == 1
    below = plan[plan.index("LeftSemi") :]
    assert "l_suppkey" in below and "functions=[partial_count" not in below


def test_pages_of_one_file_are_dealt_to_many_parsers(spark, data):
    plan = _plan(H.page_features(Bound(spark, data).site_pages))
    assert "Exchange" in plan[plan.index("MapInArrow") :]
