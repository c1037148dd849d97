"""Findings, recommendations, scores and their change between runs.

``findings`` has run_id, finding_id, rule_id, fingerprint, severity, status,
pillar; ``recs`` has finding_id, rec_no, status, priority, effort, outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import expr as E

PILLARS = ("P1", "P2", "P3", "P4", "P5")
GATED = ("accepted", "edited")


def active(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("status").eqNullSafe("dismissed"))


def health(findings: DataFrame, pillars: DataFrame, affected_ratio: Column | None = None) -> DataFrame:
    """A score for each pillar that has data and overall: 100 less the penalty's part of the budget, re-weighted over scored pillars.

    ``pillars (run_id, pillar)`` says which pillars of a run have data; one
    without findings scores 100, one without data is null whatever was found.
    ``affected_ratio`` is kept between 0 and 1; a null one counts as 1.  A run
    in either table gives a row.
    """
    ratio = F.lit(1.0) if affected_ratio is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(affected_ratio, F.lit(1.0))))
    weight = E.lookup(F.col("severity"), E.SEVERITY_WEIGHT, 0.0) * ratio
    sums = active(findings).groupBy("run_id").agg(*[F.sum(F.when(F.col("pillar") == p, weight)).alias(p) for p in PILLARS])
    data = pillars.groupBy("run_id").agg(*[F.coalesce(F.bool_or(F.col("pillar") == p), F.lit(False)).alias(f"has_{p}") for p in PILLARS])
    score = lambda p: F.when(F.col(f"has_{p}"), E.js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - F.coalesce(p, F.lit(0.0)) / E.HEALTH_BUDGET))), 1))
    scored = data.join(sums, "run_id", "full_outer").select("run_id", *[score(p).alias(p) for p in PILLARS])
    total = sum((F.coalesce(F.col(p) * w, F.lit(0.0)) for p, w in E.PILLAR_WEIGHT.items()), F.lit(0.0))
    weights = sum((F.when(F.col(p).isNotNull(), w).otherwise(0.0) for p, w in E.PILLAR_WEIGHT.items()), F.lit(0.0))
    return scored.withColumn("overall", F.when(weights > 0, E.js_round(total / weights, 1)))


def rule_stats(rows: DataFrame, hit: Column, counted: Column, min_n: int = 20, threshold: float = 0.5) -> DataFrame:
    """Hits among counted rows of each rule; flagged when there are enough and the Wilson bound exceeds the threshold."""
    per = rows.groupBy("rule_id").agg(F.count_if(counted).alias("n"), F.count_if(counted & hit).alias("hits"))
    low = E.wilson_low(F.col("hits"), F.col("n"))
    return per.select("rule_id", "n", "hits", F.round(low, 6).alias("wilson_low"), ((F.col("n") >= min_n) & (low > threshold)).alias("flagged"))


def last_by_fingerprint(findings: DataFrame) -> DataFrame:
    """Of findings with one fingerprint in a run, the last by id."""
    return findings.groupBy("run_id", "fingerprint").agg(F.max_by("severity", "finding_id").alias("severity"))


def delta(findings: DataFrame, baseline: int, retest: int) -> DataFrame:
    """resolved / new / persistent / regressed by fingerprint, a full outer join of two runs."""
    last = last_by_fingerprint(findings)
    side = lambda run, name: last.where(F.col("run_id") == run).select("fingerprint", F.col("severity").alias(name))
    x = side(baseline, "baseline_severity").join(side(retest, "retest_severity"), "fingerprint", "full_outer")
    worse = E.lookup(F.col("retest_severity"), E.SEVERITY_RANK) > E.lookup(F.col("baseline_severity"), E.SEVERITY_RANK)
    state = F.when(F.col("retest_severity").isNull(), "resolved").when(F.col("baseline_severity").isNull(), "new").when(worse, "regressed").otherwise("persistent")
    return x.withColumn("state", state)


def outcome(state: Column, before: Column | None = None, after: Column | None = None, increase: bool = True, comparable: Column | None = None) -> Column:
    """What became of a recommendation: by its metric where both runs have it, else by its finding's state."""
    by_state = E.lookup(state, {"resolved": "effective", "regressed": "regressed", "persistent": "ineffective"}, "unknown")
    if before is None or after is None:
        return by_state
    better, worse = (after > before, after < before) if increase else (after < before, after > before)
    by_metric = F.when(better, "effective").when(worse, "regressed").otherwise("ineffective")
    out = F.when(before.isNotNull() & after.isNotNull(), by_metric).otherwise(by_state)
    return out if comparable is None else F.when(comparable, out).otherwise("unknown")


def top_findings(findings: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc(E.lookup(F.col("severity"), E.SEVERITY_WEIGHT, 0.0)), "finding_id")
    return active(findings).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("run_id", "place", "finding_id", "severity", "pillar")


def quadrant(priority: Column) -> Column:
    return F.when(priority.isin("quick_win", "strategic", "fill_in", "low"), priority).otherwise("fill_in")


def confidence(claim: Column) -> Column:
    return E.lookup(claim, {"measured_hard": "high", "measured_sample": "medium"}, "low")


def horizon(effort: Column) -> Column:
    return E.lookup(effort, {"low": "quick", "high": "long"}, "mid")


def constraint(findings: DataFrame) -> DataFrame:
    """Where a run's main constraint lies, by a four-way decision."""
    a = active(findings).groupBy("run_id").agg(
        F.count_if((F.col("pillar") == "P1") & (F.col("severity") == "high")).alias("broken"), F.count_if(F.col("pillar") == "P3").alias("p3"), F.count_if(F.col("pillar").isin("P4", "P5")).alias("p45")
    )
    kind = F.when(F.col("broken") > 0, "systemic_basics").when(F.col("p3") == 0, "visibility_data_missing").when((F.col("p3") >= 3) & (F.col("p45") >= 2), "authority_content").otherwise("fine_tuning")
    return a.select("run_id", kind.alias("kind"))


def report_level(sources: DataFrame, ai_samples: Column, competitors: Column) -> DataFrame:
    """R0 to R4 by which sources a run has, and its gaps."""
    has = lambda k: F.bool_or((F.col("source_key") == k) & (F.col("status") == "collected"))
    crawl = F.bool_or((F.col("source_key") == "crawl") & ((F.col("status") == "collected") | ((F.col("status") == "partial") & (F.col("captured") > 0))))
    x = sources.groupBy("run_id").agg(crawl.alias("crawl"), has("gsc").alias("gsc"), has("dataforseo").alias("market"), has("ai_probe").alias("ai"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") != "collected", F.col("source_key")))), ",").alias("gaps"))
    r2 = F.col("crawl") & F.col("gsc")
    r3 = r2 & F.col("market") & (competitors > 0)
    level = F.when(r3 & F.col("ai") & (ai_samples > 0), "R4").when(r3, "R3").when(r2, "R2").when(F.col("crawl"), "R1").otherwise("R0")
    return x.select("run_id", level.alias("level"), "gaps")


def ratio_row(name: str, before: Column, after: Column) -> list[Column]:
    """Percent of two runs and their difference; one-sided rows have no difference, and no row where neither side has data."""
    pct = lambda c: E.js_round(c * 100).cast("long")
    return [F.lit(name).alias("metric"), pct(before).alias("baseline"), pct(after).alias("retest"), (pct(after) - pct(before)).alias("delta")]


def freshness(artifacts: DataFrame, today: Column) -> DataFrame:
    """Age in days and whether an artifact is stale: never verified, or older than its cadence."""
    age = F.datediff(today, F.col("verified_on"))
    return artifacts.select("artifact_key", age.alias("age_days"), (F.col("verified_on").isNull() | (age > F.col("cadence_days"))).alias("stale"))


def next_version(published: DataFrame) -> DataFrame:
    n = F.max(F.regexp_extract("version", r"(\d+)$", 1).cast("int"))
    return published.agg(F.concat(F.lit("rules_v"), (F.coalesce(n, F.lit(0)) + 1).cast("string")).alias("next_version"))
