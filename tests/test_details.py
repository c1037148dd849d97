"""Details of hits: first examples, affected pages and keywords, in every shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import details as D

DETAILS = [
    ("A", "s", '{"examples": ["http://a", "b", {"url": "https://c"}, {"url": 3}, "http://a"], "count": 7}', (7, ["http://a", "https://c"])),
    ("B", "HTTP://x", '{"total": "5"}', (1, ["HTTP://x"])),
    ("C", "s", '{"queries": [{"query": " Kw ", "pages": [{"url": "http://p"}, {"url": "http://q"}]}, {"query": 5}, {"pages": []}], "keywords": [{"text": "kw"}, {"text": "other"}, 3]}', (2, ["http://p", "http://q"])),
    ("D", "s", None, (None, None)),
    ("E", "s", '{"blockedUrls": [], "sampleUrls": ["http://s"], "blockedCount": 2}', (2, ["http://s"])),
    ("F", "s", '{"keywords": 5, "queries": {"query": "x"}}', (None, None)),
    ("G", "http://y", '{"examples": [{"url": "/relative"}], "pageCount": 0}', (0, ["http://y"])),
    ("H", "s", '{"examples": [%s], "affectedPages": 99}' % ", ".join(f'"http://{i}"' for i in range(30)), (99, [f"http://{i}" for i in range(20)])),
    ("I", "s", "[]", (None, None)),
]


def frame(spark):
    return spark.createDataFrame([(k, 1, scope, j) for k, scope, j, _ in DETAILS], "rule_id string, run_id long, scope string, j string").withColumn("detail", F.parse_json("j"))


def test_affected_pages(spark):
    total, pages = D.affected_pages(F.col("detail"), F.col("scope"))
    got = {r.rule_id: (r.total, r.pages) for r in frame(spark).select("rule_id", total.alias("total"), pages.alias("pages")).collect()}
    assert got == {k: want for k, _, _, want in DETAILS}


def test_metric_targets(spark):
    assert sorted((r.rule_id, r.keyword) for r in D.metric_targets(frame(spark)).collect()) == [("C", "kw"), ("C", "other")]
    metrics = spark.createDataFrame([(1, "KW ", 10, 4.0), (1, "other", 5, 8.0), (2, "kw", 7, 1.0), (2, "more", 1, 1.0)], "run_id long, keyword string, impressions long, position double")
    got = sorted((r.measured_run, r.keywords, r.impressions, r.position) for r in D.target_metrics(D.metric_targets(frame(spark)), metrics).collect())
    assert got == [(1, 2, 15, 6.0), (2, 1, 7, 1.0)]


def test_first_examples_and_true_totals(spark):
    rows = [("K", run, "s", "keyword", str(i), None if i == 5 else f"k{i % 40:02}", None if i % 50 == 0 else float(i % 7)) for run in (1, 2) for i in range(500 if run == 1 else 3)] + [("U", 1, "u", "url", "9", "http://x", 0.0)]
    df = spark.createDataFrame(rows, "rule_id string, run_id long, scope string, kind string, ref string, example string, rank double").repartition(7)
    got = {(r.rule_id, r.run_id): r for r in D.listed(df, 10).collect()}
    for key in {(r[0], r[1]) for r in rows}:
        mine = sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[6] is None, r[6] or 0, r[5] is None, r[5] or "", r[4]))
        assert (got[key].total, got[key].refs, got[key].examples) == (len(mine), [r[4] for r in mine[:10]], [r[5] for r in mine[:10]])
    shapes = D.listed(df).select("rule_id", "run_id", D.detail(F.col("kind"), F.col("total"), F.col("examples")).alias("detail"))
    assert shapes.where("rule_id = 'U'").select(F.try_variant_get("detail", "$.examples[0].url", "string")).first()[0] == "http://x"
    assert shapes.where("rule_id = 'K' and run_id = 1").select(F.try_variant_get("detail", "$.total", "long"), F.try_variant_get("detail", "$.keywords[0].text", "string")).first() == (500, "k00")
    assert D.listed(df.limit(0)).count() == 0


def test_a_rule_that_raises_leaves_the_others(spark):
    from sparkwright.operators import rules as R

    rows = lambda k: spark.createDataFrame([(f"R{k}", k)], "rule_id string, run_id long")

    def at_planning():
        return rows(90).select("rule_id", "no_such_column")

    def at_running():
        return rows(91).select("rule_id", F.expr("run_id div (run_id - 91)").alias("run_id"))

    parts = [(f"R{k}", lambda k=k: rows(k)) for k in range(7)]
    found, failed = R.isolated([*parts[:3], ("plan", at_planning), *parts[3:6], ("run", at_running), parts[6]])
    assert sorted(r.rule_id for x in found for r in x.collect()) == [f"R{k}" for k in range(7)]
    assert [name for name, _ in failed] == ["plan", "run"] and failed[1][1] == "DIVIDE_BY_ZERO"
    assert R.isolated(parts)[1] == [] and len(R.isolated(parts)[0]) == 1 and R.isolated([]) == ([], [])
