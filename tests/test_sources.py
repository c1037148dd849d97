from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sparkwright.plans import findings as plans
from sparkwright.sources import payloads as P
from sparkwright.sources import shared, sinks
from sparkwright.streaming import progress as G


def test_answers_of_four_engines(spark):
    rows = [
        ("openai", {"output": [{"content": [{"text": "a", "annotations": [{"url": "http://x/1"}, {"url": "http://x/1"}]}]}]}, "a", ["http://x/1"], []),
        ("perplexity", {"choices": [{"message": {"content": "b"}}], "citations": ["http://y/1"], "search_results": [{"url": "http://y/1"}, {"url": "http://y/2"}]}, "b", ["http://y/1"], ["http://y/2"]),
        ("gemini", {"candidates": [{"content": {"parts": [{"text": "c"}]}, "groundingMetadata": {"groundingChunks": [{"web": {"uri": "http://z/1"}}]}}]}, "c", ["http://z/1"], []),
        ("deepseek", {"choices": [{"message": {"content": "d"}}]}, "d", [], []), ("other", {"x": 1}, None, [], []),
    ]
    df = spark.createDataFrame([(p, json.dumps(j)) for p, j, *_ in rows] + [("openai", "{broken"), ("openai", None)], "provider string, payload string")
    got = df.select(P.answer(F.col("provider"), F.col("payload")).alias("a"), P.cited(F.col("provider"), F.col("payload")).alias("c"), P.retrieved_only(F.col("provider"), F.col("payload")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(a, c, r) for *_, a, c, r in rows] + [(None, [], [])] * 2


def test_landed_tables(spark):
    gsc = spark.createDataFrame([(1, json.dumps({"rows": [{"keys": ["q"], "clicks": 1, "impressions": 5, "ctr": 0.2, "position": 3.5}, {"keys": [""]}, {"keys": []}]})), (2, "{}"), (3, None)], "run_id long, payload string")
    assert [(r.text, r.clicks, r.position) for r in P.keyword_metrics(gsc).collect()] == [("q", 1.0, 3.5)]
    serp = spark.createDataFrame([(1, "k", json.dumps({"items": [{"type": "organic", "domain": "a.b", "rank_absolute": 2}, {"type": "ads"}]})), (1, "z", "{}")], "run_id long, keyword string, payload string")
    assert [(r.keyword, r.domain, r.item_rank) for r in P.serp_items(serp).collect()] == [("k", "a.b", 2)]
    psi = {"loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 2600}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 12}}}, "lighthouseResult": {"categories": {"performance": {"score": 0.555}}, "audits": {"server-response-time": {"numericValue": 900.5}}}}
    r = P.page_speed(spark.createDataFrame([(1, json.dumps(psi))], "run_id long, payload string")).first()
    assert (r.lcp_ms, r.inp_ms, r.cls, r.score, r.ttfb_ms) == (2600.0, None, 0.12, 56, 900.5)
    bad = spark.createDataFrame([(1, 500, "{}"), (2, 200, "x"), (3, 200, '{"status_code": 40100}'), (4, 200, '{"status_code": 20000, "tasks": [{"status_code": 40501}]}'), (5, 200, '{"status_code": 20000}')], "id long, http_status int, payload string")
    assert {r.id: r.reason for r in P.envelope_errors(bad).collect()} == {1: "http", 2: "not json", 3: "envelope", 4: "envelope"}


def test_json_ld(spark):
    blocks = ['{"@type": "Organization"}', '{"@type": ["A", "B"]}', '{"@graph": [{"@type": "C"}, {"@type": "D"}, {}]}', "{broken", "{}"]
    got = spark.createDataFrame([(b,) for b in blocks], "b string").select(P.json_ld_types(F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == [["Organization"], ["A", "B"], ["C", "D"], None, []]


def test_gate(spark, tmp_path):
    evidence = spark.createDataFrame([(1, "L1"), (2, "L2"), (3, "L3")], "evidence_id long, level string")
    rows = [(1, "measured_hard", [1]), (2, "measured_hard", [2]), (3, "measured_sample", [2, 9]), (4, "measured_sample", [3]), (5, "inferred", [3]), (6, "inferred", [])]
    df = spark.createDataFrame(rows, "finding_id long, claim_type string, refs array<long>")
    good, bad = sinks.gated_findings(df, evidence)
    assert {r.finding_id for r in good.collect()} == {1, 3, 5} and {r.finding_id for r in bad.collect()} == {2, 4, 6}
    with pytest.raises(sinks.GateError):
        sinks.insert_findings(df, evidence, f"file://{tmp_path}/f")
    assert not (tmp_path / "f").exists()
    sinks.insert_findings(good, evidence, f"file://{tmp_path}/f")
    assert spark.read.parquet(f"file://{tmp_path}/f").count() == 3
    log = evidence.withColumn("type", F.when(F.col("evidence_id") < 3, "a").otherwise("b"))
    sinks.append_evidence(log, f"file://{tmp_path}/log")
    sinks.append_evidence(log, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").where("type = 'a'").count() == 4


def test_report(spark, data):
    text = sinks.report_markdown(plans.health_score(spark, data), plans.top_findings(spark, data), plans.constraint_locator(spark, data), plans.health_score(spark, data).first().run_id)
    assert "Main constraint" in text and "| P1 |" in text
    assert "not scored" in sinks.report_markdown(plans.health_score(spark, data), plans.top_findings(spark, data), plans.constraint_locator(spark, data), -1)


def test_stream_state_goes_on_over_batches(spark, tmp_path):
    kinds = [["progress", "evidence_created"], ["phase", "done"], ["evidence_created"]]
    seq = 0
    for i, batch in enumerate(kinds):
        rows = []
        for k in batch:
            seq += 1
            rows.append((1, seq, datetime.datetime(2024, 1, 1, 0, 0, seq), k, seq))
        df = spark.createDataFrame(rows, "run_id long, seq long, ts timestamp, msg_type string, amount long")
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = G.source(spark, f"file://{tmp_path}/in", df.schema)
    out = G.once(G.run_states(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", "update")
    last = out.orderBy(F.desc("messages")).first()
    assert (last.state, last.messages, last.evidence, last.phases, last.last_progress) == ("done", 4, 1, 1, 1)


def test_release_is_all_or_nothing(spark, tmp_path):
    a = spark.range(3)
    sinks.release({"x": a, "y": a.limit(1)}, f"file://{tmp_path}/v2")
    assert spark.read.parquet(f"file://{tmp_path}/v2/x").count() == 3 and spark.read.parquet(f"file://{tmp_path}/v2/y").count() == 1
    broken = a.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.release({"x": a, "y": broken}, f"file://{tmp_path}/v3")
    assert not (tmp_path / "v3").exists()
    with pytest.raises(FileExistsError):
        sinks.release({"x": a}, f"file://{tmp_path}/v2")


def test_affected_pages_round_trip():
    pages = [f"http://a/{i}" for i in range(12)]
    assert sinks.split_affected(sinks.affected_pages("why", pages[:3])) == ("why", pages[:3])
    assert sinks.split_affected(sinks.affected_pages("why", pages)) == ("why", pages[:10])
    assert sinks.affected_pages("why", []) == "why" and sinks.split_affected("why") == ("why", [])


def test_actions(spark):
    recs = spark.createDataFrame([(1, "low", 1, 5, 1), (1, "quick_win", 2, 6, 1), (1, "quick_win", 1, 7, 2), (2, "low", 1, 8, 1)], "run_id long, quadrant string, place int, finding_id long, rec_no long")
    text = sinks.actions_markdown(recs, 1)
    assert text.index("7/2") < text.index("6/1") < text.index("5/1") and "8/1" not in text


def landed(spark, *payloads):
    rows = [(i, "k", "www.A.example", "brand", p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "run_id long, keyword string, domain string, brand string, payload string").withColumns({"target": F.lit("t"), "platform": F.lit("p"), "account_id": F.col("run_id")})


ODD = (None, "", "nonsense", "{}", "[]", '{"tasks": []}', '{"tasks": [{"result": null}]}', '{"tasks": [{"result": [{"items": null}]}]}', '{"tasks": "x", "items": 3}')


def test_odd_payloads_give_no_rows_or_plain_defaults(spark):
    df = landed(spark, *ODD)
    for f in (P.keyword_overview, P.link_anchors, P.site_list, P.opportunities):
        assert f(df).count() == 0, f
    n = len(ODD)
    assert {(r.referring_domains, r.backlinks, r["rank"]) for r in P.link_summary(df).collect()} == {(0.0, 0.0, None)} and P.link_summary(df).count() == n
    assert {(r.present, r.asynchronous, r.markdown) for r in P.ai_overview(df).collect()} == {(False, False, None)}
    assert {(r.domain, r.total, r["items"]) for r in P.engine_index(df).collect()} == {("a.example", None, 0)}
    assert {(r.knowledge_panel, r.own_present, r["items"]) for r in P.brand_results(df).collect()} == {(False, False, 0)}
    assert {(r.total, r.shown, r.home_page, r.first_url) for r in P.site_search(df).collect()} == {(None, 0, False, None)}
    assert {(r.results, len(r.top)) for r in P.social_presence(df).collect()} == {(0, 0)}
    assert {(r.exists, r.title, r.url) for r in P.encyclopedia(df).collect()} == {(False, None, None)}
    assert {r.mentions for r in P.forum_mentions(df, F.lit(0)).collect()} == {0}


def test_brand_results_need_domain_url_and_rank(spark):
    item = '{"type": "organic", "domain": "%s", "url": %s, "rank_absolute": %s}'
    one = lambda *items: '{"tasks": [{"result": [{"items": [%s]}]}]}' % ", ".join(items)
    df = landed(spark, one(item % ("A.example", '"u"', 1)), one(item % ("a.example", "null", 1)), one(item % ("a.example", '"u"', "null")), one('{"type": "knowledge_graph"}', item % ("b.example", '"u"', 2)))
    got = {r.run_id: (r.knowledge_panel, r.own_present, r["items"]) for r in P.brand_results(df).collect()}
    assert got == {0: (False, True, 1), 1: (False, False, 0), 2: (False, False, 0), 3: (True, False, 1)}


def test_access_and_windows(spark):
    probes = spark.createDataFrame([(1, None), (2, 200), (3, 301), (4, 400), (5, 429), (6, 503)], "run_id long, status int")
    assert [r.blocked for r in P.crawler_access(probes).orderBy("run_id").collect()] == [False, False, False, True, True, True]
    files = spark.createDataFrame([(1, 200, "x"), (2, 200, " \n"), (3, 404, "x"), (4, None, "x"), (5, 200, None)], "run_id long, status int, body string")
    assert [r.exists for r in P.llms_txt(files).orderBy("run_id").collect()] == [True, False, False, False, False]
    post = '{"data": {"children": [{"data": {"created_utc": 1000}}, {"data": {"created_utc": 999}}, {"data": {}}, {}]}}'
    assert [r.mentions for r in P.forum_mentions(landed(spark, post), F.lit(1000 + 365 * 86400)).collect()] == [3]


def test_full_report(spark):
    gaps = spark.createDataFrame([(1, "b|x", 2, 9.5), (1, "a", 1, None), (2, "z", 1, 1.0), (1, "c", 3, 1.0)], "run_id long, keyword string, place int, score double")
    pillars = spark.createDataFrame([(1, "P2", 80.0), (1, "P1", None)], "run_id long, pillar string, score double")
    text = sinks.full_report({"Keywords and gaps": gaps, "Pillars": pillars, "Retest": gaps.where("run_id = 2")}, 1, rows=2)
    parts = text.split("## ")
    assert [p.split("\n")[0] for p in parts[1:]] == [f"{i}. {n}" for i, n in enumerate(sinks.SECTIONS, 1)]
    assert "| a | 1 | not measured |\n| b\\|x | 2 | 9.5 |\n\n1 more." in parts[4] and "| P1 | not measured |\n| P2 | 80.0 |" in parts[3]
    assert "Not measured." in parts[8] and "Not measured." in parts[1]


class _Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_no_local_folder_on_a_cluster(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.root(_Cluster)
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert sorted(map(tuple, shared.settle(df, "t").collect())) == [(1, None), (2, "x")] and shared.settle(df.limit(0), "t").count() == 0
