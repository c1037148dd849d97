"""Run life cycle and sitemap discovery against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkwright.operators import lifecycle as L
from sparkwright.operators import log
from sparkwright.operators import sitemaps as M


def step(state, event):
    if event == "cancel":
        return "cancelled" if state in ("collecting", "diagnosing") else state
    if event == "retry":
        return "collecting" if state in ("failed", "cancelled") else state
    if event in ("decided", "undecided"):
        return {"decided": "output", "undecided": "reviewing"}[event] if state in ("reviewing", "output") else state
    return event if event in L.TRANSITIONS and state != "cancelled" else state


def test_replay(spark):
    rng = random.Random(7)
    names = [*L.TRANSITIONS, "unknown"]
    logs = {run: [rng.choice(names) for _ in range(rng.choice([0, 1, 5, 40, 3000 if run == 3 else 60]))] for run in range(40)}
    rows = [(run, i // 3, i, e) for run, events in logs.items() for i, e in enumerate(events)] + [(99, 0, 0, "cancel")]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "run_id long, ts long, seq long, event string")
    runs = spark.createDataFrame([(run, rng.choice([*L.STATES, "odd"])) for run in logs], "run_id long, status string")
    start = {r.run_id: r.status for r in runs.collect()}
    for block in (L.BLOCK, 4):
        got = {r.run_id: (r.status, r.events) for r in L.replay(runs, events, block).collect()}
        want = {}
        for run, es in logs.items():
            state = start[run]
            for e in es if state != "odd" else []:
                state = step(state, e)
            want[run] = (state, len(es))
        assert got == want
    assert L.replay(runs, events.limit(0)).where("events = 0").count() == 40 and L.replay(runs.limit(0), events).count() == 0


def test_only_cancelled_runs_are_held(spark):
    runs = spark.createDataFrame([(1, "failed"), (2, "cancelled"), (3, "completed"), (4, "cancelled"), (5, "draft")], "run_id long, status string")
    changes = spark.createDataFrame([(1, "collecting", False), (2, "collecting", False), (3, "collecting", None), (4, "collecting", True), (9, "failed", True)], "run_id long, status string, bypass boolean")
    want = {1: "collecting", 2: "cancelled", 3: "collecting", 4: "collecting", 5: "draft"}
    assert {r.run_id: r.status for r in log.change_status(runs, changes).collect()} == want
    assert {r.run_id: r.status for r in log.change_status(runs, changes.drop("bypass")).collect()} == want | {4: "cancelled"}


def test_templates_keep_and_refresh_their_pages(spark):
    shape = "template_id long, representative long, source string, pages long"
    stored = spark.createDataFrame([(1, 10, "manual", 3), (2, 20, "heuristic", 4), (3, 30, "manual", 5)], shape)
    incoming = spark.createDataFrame([(1, 11, "heuristic", 7), (2, 21, "heuristic", 8), (4, 41, "heuristic", 9)], shape)
    assert sorted(map(tuple, log.upsert_templates(stored, incoming, ["template_id"]).collect())) == [(1, 10, "manual", 7), (2, 21, "heuristic", 8), (3, 30, "manual", 5), (4, 41, "heuristic", 9)]


def plain_discovery(entry, told, files, limits):
    queue, seen, n_files, pages, warnings = list(told) or [entry + "/sitemap.xml"], set(), 0, [], []
    while queue and n_files < limits.files and len(pages) < limits.urls:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url not in files:
            warnings.append(f"sitemap_fetch_failed:{url}")
            continue
        status, index, locs = files[url]
        if status != 200:
            if told or url != entry + "/sitemap.xml":
                warnings.append(f"sitemap_http_{status}:{url}")
            continue
        n_files += 1
        if index:
            queue += locs
            continue
        for loc in locs:
            if loc not in pages:
                pages.append(loc)
            if len(pages) >= limits.urls:
                break
    if queue:
        warnings.append(f"sitemap_truncated:{len(queue)}_files_unread")
    return sorted(pages), sorted(warnings)


def test_sitemaps(spark):
    rng = random.Random(11)
    limits = M.Limits(4, 12)
    entries, rows, want = [], [], {}
    for run in range(30):
        entry = f"https://s{run}.example"
        names = [f"{entry}/m{i}.xml" for i in range(rng.randint(1, 7))] + [f"{entry}/sitemap.xml"]
        files = {}
        for name in names:
            if rng.random() < 0.85:
                index = rng.random() < 0.5
                locs = [rng.choice([*names, f"{entry}/gone.xml"]) for _ in range(rng.randint(0, 4))] if index else [f"{entry}/p{rng.randrange(15)}" for _ in range(rng.randint(0, 8))]
                files[name] = (rng.choice([200, 200, 200, 404]), index, locs)
        told = rng.sample(names, rng.randint(0, min(3, len(names)))) * rng.choice([1, 2])
        entries.append((run, entry + "/start?x=1", "User-agent: *\n" + "\n".join(f"Sitemap: {x}" for x in told)))
        for name, (status, index, locs) in files.items():
            tag = "sitemapindex" if index else "urlset"
            rows.append((run, name, status, f"<{tag} xmlns='x'>" + "".join(f"<url><loc> <![CDATA[{x}]]></loc></url>" if rng.random() < 0.3 else f"<url><LOC>{x}</LOC></url>" for x in locs) + f"</{tag}>"))
        want[run] = plain_discovery(entry, told, files, limits)
    pages, warnings = M.discover(spark.createDataFrame(entries, "run_id long, entry_url string, robots string"), spark.createDataFrame(rows, "run_id long, url string, status int, body string"), limits)
    got = {run: ([], []) for run in want}
    for r in pages.collect():
        got[r.run_id][0].append(r.url)
    for r in warnings.collect():
        got[r.run_id][1].append(r.warning)
    assert {k: (sorted(a), sorted(b)) for k, (a, b) in got.items()} == want
    assert any("truncated" in w for _, ws in want.values() for w in ws) and any("fetch_failed" in w for _, ws in want.values() for w in ws)


def test_locations(spark):
    xml = "<urlset><loc>https://a/?x=1&amp;y=2</loc><loc>&#104;t&#x74;p://b &amp;lt; &#x110000; &#1114112; &#xD800; &#00065;</loc><loc><![CDATA[ https://c ]]></loc><loc></loc></urlset>"
    got = spark.range(1).select(M.locations(F.lit(xml)).alias("x")).first().x
    assert got == ["https://a/?x=1&y=2", "http://b &lt; &#x110000; &#1114112; &#xD800; A", "https://c"]
