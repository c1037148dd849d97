"""Pages of one template: many share much, few are similar."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkwright.llm import near_dedup, storage


def pages(n, rng, shared=0.6, words=100):
    """Texts of which about 60 % of all shingles are common, and some pairs at, above and below the threshold in between."""
    common = [f"c{i}" for i in range(int(words * shared) + 4)]
    texts = [" ".join(common + [f"u{k}x{j}" for j in range(int(words * (1 - shared)))]) for k in range(n)]
    for k in range(0, n - 1, 97):  # the last words differ: 96 shingles each
        own = texts[k].split()
        texts[k + 1] = " ".join(own[: -rng.choice([2, 8, 12, 13, 14, 15, 20])] + [f"v{k}x{j}" for j in range(5)])
    return texts


def plain(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    return {(k, k + 1) for k in range(0, len(texts) - 1, 97) if 100 * len(sets[k] & sets[k + 1]) >= 75 * len(sets[k] | sets[k + 1])}


def test_links_across_blocks(spark):
    rng = random.Random(5)
    texts = pages(1500, rng)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.component_id, r.doc_id) for r in near_dedup.cluster(df, near_dedup.Params(block=64)).where("not kept").collect()}
    assert got == plain(texts) and got


def test_prefixes_leave_the_template_out(spark):
    """Where sets have only their template in common, no task is made; where two are similar, they meet, and little else."""
    rng = random.Random(6)
    texts = pages(3000, rng)
    p = near_dedup.Params(block=64)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = storage.keep(near_dedup.full_sets(df, p), "sets")
    open_ = storage.keep(df.select("doc_id", F.col("doc_id").alias("grp")), "open_ids")
    tasks = near_dedup.rest_tasks(open_, sets, p)
    rows = tasks.groupBy("task").agg(F.collect_set("doc_id").alias("ids")).collect()
    assert sum(len(r.ids) for r in rows) <= len(texts) // 10  # a grid of blocks would have some 3000 * 47
    met = {tuple(sorted(r.ids)) for r in rows}
    assert plain(texts) <= {(a, b) for ids in met for a in ids for b in ids if a < b}


def test_blocks_by_shingles(spark):
    """A bucket of few long texts is dealt to several blocks, and the links are the same."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = [" ".join(base[: 4000 - 40 * k]) for k in range(12)] + ["", None]
    df = spark.createDataFrame([*enumerate(texts), (3, None), (None, "x")], "doc_id long, text string")
    whole = sorted(map(str, near_dedup.cluster(df).collect()))
    assert whole == sorted(map(str, near_dedup.cluster(df, near_dedup.Params(shingles=5000)).collect()))
