"""Messages that are late by some triggers, against the batch fold."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest

from sparkwright.operators import log
from sparkwright.streaming import progress as G

SHAPE = "run_id long, seq long, ts timestamp, msg_type string, amount long"
T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    with G.rocks_db(spark):
        yield spark


def messages(rng, runs=12, n=25):
    return [(run, i, T0 + datetime.timedelta(minutes=i), rng.choice(["progress", "evidence_created", "phase"] * 8 + ["done", "failed"]), rng.randrange(100)) for run in range(runs) for i in range(n)]


def latest(out):
    rows = sorted((r.batch, r.run_id, (r.state, r.messages, r.evidence, r.phases, r.last_progress)) for r in out.collect())
    return {run: state for _, run, state in rows}


def stream(spark, tmp_path, triggers, late):
    for i, rows in enumerate(triggers):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i:03}")
    import glob
    import os
    import shutil

    os.makedirs(tmp_path / "files", exist_ok=True)
    for i in range(len(triggers)):
        name = glob.glob(f"{tmp_path}/in/{i:03}/*.parquet")[0]
        shutil.copy(name, tmp_path / "files" / f"{i:03}.parquet")
        os.utime(tmp_path / "files" / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    source = G.source(spark, f"file://{tmp_path}/files", spark.createDataFrame([], SHAPE).schema)
    return latest(G.once(G.late_run_states(source, late), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", "update"))


def batch(spark, rows):
    return {r.run_id: (r.state, r.messages, r.evidence, r.phases, r.last_progress) for r in log.progress_state(spark.createDataFrame(rows, SHAPE)).collect()}


@pytest.mark.parametrize("late", ["1 day", "12 minutes"])
def test_late_messages_find_their_place(rocks, tmp_path, late):
    rng = random.Random(13)
    rows = messages(rng)
    # each message is late by up to ten minutes
    came = sorted(rows, key=lambda r: (r[2] + datetime.timedelta(minutes=rng.uniform(0, 10)), r[0]))
    size = len(came) // 6
    triggers = [came[i : i + size] for i in range(0, len(came), size)]
    assert stream(rocks, tmp_path, triggers, late) == batch(rocks, rows)


def test_fold_is_the_loop():
    rng = random.Random(14)
    for _ in range(200):
        rows = messages(rng, 1, rng.randint(0, 12))
        rng.shuffle(rows)
        kind, n, evidence, phases, last = G.START
        for _, _, _, what, amount in sorted(rows, key=lambda r: (r[2], r[1])):
            n += 1
            evidence += what == "evidence_created"
            phases += what == "phase"
            last = amount if what == "progress" else last
            if what in G.TERMINAL:
                kind = what
                break
        frame = pd.DataFrame(rows, columns=["run_id", "seq", "ts", "msg_type", "amount"])
        assert G.fold(G.START, frame) == (kind, n, evidence, phases, last)
        assert G.fold(("done", 1, 0, 0, None), frame) == ("done", 1, 0, 0, None)
