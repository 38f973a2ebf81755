"""The runnable jobs: growing input, failures on the way, odd rows, and the allocation that both use."""

import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chirplake.operators import groups
from jobs import grow_pool, split_documents

ROOT = Path(__file__).resolve().parent.parent
POOL_SETTINGS = json.loads(grow_pool.CONFIG.read_text())
SPLIT_SETTINGS = json.loads(split_documents.CONFIG.read_text())


# ------------------------------------------------------------------ allocation
def plain_assignment(counts, ratios, have, heavy):
    names = list(ratios)
    out = {}
    for ifo in {i for i, *_ in counts}:
        own = [(g, n, hashlib.md5(f"42|group|{g}".encode()).hexdigest()) for i, g, n in counts if i == ifo]
        new = sum(n for _, n, _ in own)
        held = [sum(n for i, s, n in have if (i, s) == (ifo, name)) for name in names]
        lacking = [(new + sum(held)) * ratios[s] - h for s, h in zip(names, held, strict=True)]
        for g, n, _ in sorted((x for x in own if x[1] >= heavy * new), key=lambda x: (-x[1], x[2], x[0])):
            k = lacking.index(max(lacking))
            lacking[k] -= n
            out[ifo, g] = names[k]
        lacking = [max(x, 0.0) for x in lacking]
        light = sorted((x for x in own if x[1] < heavy * new), key=lambda x: (x[2], x[0]))
        total, before = sum(n for _, n, _ in light), 0
        for g, n, _ in light:
            at = (before + n / 2) / total * sum(lacking)
            out[ifo, g] = next((s for k, s in enumerate(names[:-1]) if at < sum(lacking[: k + 1])), names[-1])
            before += n
    return out


@pytest.mark.parametrize("have", [[], [("H1", "train", 500), ("H1", "val", 1), ("L1", "test", 9000)]])
def test_assign_many(spark, have):
    counts = [("H1", f"H1:{k}", 1 + k % 9) for k in range(300)] + [("H1", "H1:big", 700), ("H1", "H1:large", 300)] + [("L1", f"L1:{k}", 5) for k in range(40)]
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    frame = spark.createDataFrame(counts, "ifo string, grp string, n bigint")
    held = spark.createDataFrame(have, "ifo string, split string, n bigint") if have else None
    got = {(r["ifo"], r["grp"]): r["split"] for r in groups.assign_many(frame, ratios, held).collect()}
    assert got == plain_assignment(counts, ratios, have, 1 / 16)
    rows = {s: sum(n for i, g, n in counts if i == "H1" and got[i, g] == s) + sum(n for i, t, n in have if (i, t) == ("H1", s)) for s in ratios}
    assert all(abs(n / sum(rows.values()) - ratios[s]) < 0.02 for s, n in rows.items())


# ------------------------------------------------------------------ growing pool
def event(spark, rows):
    frame = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    return frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def add_file(events, folder, name):
    (folder / "events").mkdir(exist_ok=True)
    (part,) = (Path(d) for d in [folder / f"stage-{name}"])
    events.coalesce(1).write.parquet(str(part))
    (file,) = part.glob("part-*.parquet")
    os.replace(file, folder / "events" / f"{name}.parquet")


def grown(spark, folder):
    return grow_pool.grow_pool(spark, str(folder / "events"), str(folder / "out"), str(folder / "checkpoint"), POOL_SETTINGS)


def as_rows(pool):
    return sorted(map(tuple, pool.select("ord", "ifo", "gps", "grp", "split", "batch").collect()))


def test_pool_grows(spark, sf_dir, tmp_path):
    every = spark.read.parquet(f"{sf_dir}/events.parquet")
    first, rest = every.where("event_id < 600"), every.where("event_id >= 550")  # the second file repeats some of the first
    add_file(first, tmp_path, "a")
    one = as_rows(grown(spark, tmp_path))
    assert {r[5] for r in one} == {0}
    assert len(one) == first.count()
    assert as_rows(grown(spark, tmp_path)) == one  # nothing new, nothing changed
    add_file(rest, tmp_path, "b")
    two = as_rows(grown(spark, tmp_path))
    assert [r for r in two if r[5] == 0] == one
    assert sorted(r[0] for r in two) == sorted(r["event_id"] for r in every.select("event_id").collect())
    split = {}
    for _, ifo, _, grp, s, _ in two:
        assert split.setdefault((ifo, grp), s) == s  # a group keeps its split
    assert {r[4] for r in two} == {"train", "val", "test"}
    assert as_rows(grown(spark, tmp_path)) == two


def test_pool_after_a_failure(spark, sf_dir, tmp_path, monkeypatch):
    every = spark.read.parquet(f"{sf_dir}/events.parquet")
    for folder in ("whole", "broken"):
        (tmp_path / folder).mkdir()
        add_file(every.where("event_id % 2 = 0"), tmp_path / folder, "a")
        grown(spark, tmp_path / folder)
        add_file(every.where("event_id % 2 = 1"), tmp_path / folder, "b")
    want = as_rows(grown(spark, tmp_path / "whole"))
    monkeypatch.setattr(grow_pool.log, "info", lambda *a: 1 / 0)  # after a batch has written all, before it counts as done
    with pytest.raises(Exception, match="ZeroDivision|division by zero"):
        grown(spark, tmp_path / "broken")
    monkeypatch.undo()
    assert as_rows(grown(spark, tmp_path / "broken")) == want


def test_pool_of_odd_rows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", 2, "a", 5.0, None), (0, "2024-01-01 00:00:01", 4, "b", None, None), (2, None, 2, "a", 5.0, None), (3, "2024-01-01 00:00:02", 2, None, float("nan"), None), (4, "2024-01-01 00:00:03", 3, "a", -1.0, None)]
    add_file(event(spark, rows), tmp_path, "a")
    got = grown(spark, tmp_path)
    assert sorted(r["ord"] for r in got.collect()) == [0, 3]  # one of each detector and time; no time, or too quiet: out
    add_file(event(spark, []), tmp_path, "b")
    assert as_rows(grown(spark, tmp_path)) == as_rows(got)


# ------------------------------------------------------------------ split documents
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def released(spark, folder, docs, labels=()):
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(f"{folder}/docs")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels")
    return split_documents.split_documents(spark, f"{folder}/docs", f"{folder}/labels", f"{folder}/out", SPLIT_SETTINGS)


def test_documents_share_nothing(spark, tmp_path):
    docs = [(k, f"text {k}", "en", f"s{k % 30}", 1) for k in range(300)] + [(1000 + k, "copied", "en", f"s{k % 30}", 1) for k in range(60)]
    docs += [(2000 + k, None, "en", f"s{k}", None) for k in range(5)] + [(None, "copied", None, None, 1), (None, "text 3", "en", "s4", 1), (3, "other", "en", "s5", 1), (4000, "", "en", "", 0)]
    labels = [(k, k % 2, 0) for k in range(0, 300, 3)] + [(0, 1, 1), (None, 1, 1)]
    got = released(spark, tmp_path, docs, labels).collect()
    texts, sources = {}, {}
    for r in got:
        if r["text"] is not None:
            assert texts.setdefault(r["text"], r["split"]) == r["split"]
        assert sources.setdefault(r["source"], r["split"]) == r["split"]
    assert sources["s0"] == texts["copied"]  # the home of doc 1000, the first that holds it
    assert {r["doc_id"] for r in got} >= {k for k in range(300)} | {2000, 2001, 2002, 2003, 2004, 4000}
    assert [(r["quality"], r["toxic"]) for r in got if r["doc_id"] == 0] == [(1, 1)]
    assert all((r["quality"] is None) == (r["doc_id"] is None or r["doc_id"] >= 300 or r["doc_id"] % 3 > 0) for r in got)
    held = spark.read.parquet(f"{tmp_path}/out/documents").where("status = 'held_back'").collect()
    assert len(held) + len(got) == len(docs)
    assert {r["text"] for r in held} <= {"copied", "text 3"}
    manifest = {r["split"]: r for r in spark.read.json(f"{tmp_path}/out/manifest").collect()}
    assert sum(r["documents"] for r in manifest.values()) == len(got)
    assert sum(r["held_back"] for r in manifest.values()) == len(held)
    again = released(spark, tmp_path, docs[::-1], labels)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_no_documents(spark, tmp_path):
    assert released(spark, tmp_path, []).collect() == []


def test_command_line(tmp_path, sf_dir):
    config = tmp_path / "own.json"
    config.write_text(json.dumps(SPLIT_SETTINGS | {"ratios": {"learn": 0.5, "check": 0.5}}))
    args = ["--documents", f"{sf_dir}/documents.parquet", "--labels", f"{sf_dir}/labels.parquet", "--output", f"{tmp_path}/out", "--config", str(config)]
    done = subprocess.run([sys.executable, "-m", "jobs.split_documents", *args], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 documents" in done.stderr
    assert {p.name for p in (tmp_path / "out/documents/status=released").iterdir() if p.is_dir()} == {"split=learn", "split=check"}
