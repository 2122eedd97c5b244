"""The jobs: growing input, reruns, interrupted batches, partial runs, the command line."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from jobs import turn_slices, version_report

TURNS = [
    (1, 0, "user", "How are you?"), (1, 1, "assistant", "word " * 50), (1, 2, "user", None),
    (2, 0, "user", "Tell me."), (2, 1, "assistant", "fine"), (3, 0, "system", ""), (3, 1, None, "what? "),
]
MORE = [(4, 0, "user", "Again, please"), (4, 1, "assistant", "yes " * 40), (2, 2, "user", "\t thanks \n")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def want(turns):
    n, words = {}, {}
    for _, t, role, text in turns:
        w = (text or "").split()
        form = "empty" if not w else "question" if text.rstrip(" ").endswith("?") else "long" if len(w) >= 40 else "short"
        key = t, role or "unknown", f"{role or 'unknown'}/{form}"
        n[key], words[key] = n.get(key, 0) + 1, words.get(key, 0) + len(w)
    out = []
    for (t, role, label), c in n.items():
        size = sum(v for k, v in n.items() if k[0] == t)
        best = min((-v, k[2]) for k, v in n.items() if k[0] == t)[1]
        out.append((t, label, c, words[t, role, label], round(c / size, 6), label == best, role))
    return sorted(out)


def add(spark, turns, folder):
    spark.createDataFrame(turns, turn_slices.SCHEMA).coalesce(2).write.mode("append").parquet(folder)


def test_turn_slices_grow(spark, tmp_path):
    source, out, at = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    add(spark, [], source)
    assert rows(turn_slices.update(spark, source, out, at)) == []
    add(spark, TURNS, source)
    assert rows(turn_slices.update(spark, source, out, at)) == want(TURNS)
    add(spark, MORE, source)
    assert rows(turn_slices.update(spark, source, out, at, files_per_batch=1)) == want(TURNS + MORE)
    batches = sorted(os.listdir(f"{at}/sums"))
    assert rows(turn_slices.update(spark, source, out, at)) == want(TURNS + MORE)
    assert sorted(os.listdir(f"{at}/sums")) == batches  # nothing was read twice
    assert sorted(x for x in os.listdir(out) if x.startswith("role=")) == ["role=assistant", "role=system", "role=unknown", "role=user"]


def test_turn_slices_interrupted(spark, tmp_path):
    """A batch that wrote its sums but was not committed runs again, and counts once."""
    source, out, at = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    add(spark, TURNS, source)
    turn_slices.update(spark, source, out, at)
    for name in os.listdir(f"{at}/stream/commits"):
        os.remove(f"{at}/stream/commits/{name}")
    assert rows(turn_slices.update(spark, source, out, at)) == want(TURNS)


def test_version_report_partial(spark, tmp_path):
    events = [(i, f"2024-01-0{1 + i % 9} 0{i % 7}:00:00", u, "abc"[(i * u) % 3], 1.0, '{"k": 1}') for u in (1, 2, 11, 12, 21) for i in range(u, u + 12)]
    e = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    out = f"{tmp_path}/out"
    whole = rows(version_report.report(spark, str(tmp_path), out))
    assert len(whole) == 5 and rows(version_report.report(spark, str(tmp_path), out)) == whole
    kept = {d: os.path.getmtime(f"{out}/{d}") for d in os.listdir(out) if d == "collection=2"}
    assert rows(version_report.report(spark, str(tmp_path), out, "1")) == whole
    assert {d: os.path.getmtime(f"{out}/{d}") for d in kept} == kept
    assert all(0 <= r[2] <= 1 for r in whole) and all(r[5] == 1 + sum(o[6] == r[6] and o[2] > r[2] for o in whole) for r in whole)


def test_command_line(spark, tmp_path):
    add(spark, TURNS, f"{tmp_path}/in")
    with open(f"{tmp_path}/config.json", "w") as f:
        json.dump({"source": f"{tmp_path}/in", "out": f"{tmp_path}/elsewhere", "checkpoint": f"{tmp_path}/at"}, f)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-m", "jobs.turn_slices", "--config", f"{tmp_path}/config.json", "--out", f"{tmp_path}/out"], cwd=repo, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "read 7 new turns" in ran.stderr and rows(spark.read.parquet(f"{tmp_path}/out").select("slice", "label", "n", "n_words", "share", "is_consensus", "role")) == want(TURNS)
