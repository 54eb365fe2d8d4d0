"""Orders, medians, arrays and single files that no task sees whole."""

from __future__ import annotations

import json
import random
import re
import statistics

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer.functions import media
from assayer.operators import metrics, order
from assayer.scratch import written
from assayer.sources import media as files
from assayer.sources import records, sinks

NESTED = "a string, b struct<c: array<string>>, n long"


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "8b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def put(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def read(spark, path, schema=NESTED):
    return [r.asDict(recursive=True) for r in records.read_array(spark, path, schema).orderBy("pos").collect()]


# Strings with every sign that could mislead a scan for brackets.
TRICKY = ["", "}", "{", "]", "[", '"', "\\", '\\"', "},{", '"}', "x" * 300, "é😀", "a\nb", "}]", "\\\\", "[{", " "]


@pytest.mark.parametrize("indent", [None, 2])
def test_array_in_many_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(5)
    want = [{"a": rng.choice(TRICKY) + rng.choice(TRICKY), "b": {"c": rng.choices(TRICKY, k=rng.randrange(3))}, "n": i} for i in range(60)]
    path = put(tmp_path / "a.json", json.dumps(want, ensure_ascii=rng.random() < 0.5, indent=indent))
    got = records.read_array(spark, path, NESTED)
    assert got.rdd.getNumPartitions() > 8
    rows = [r.asDict(recursive=True) for r in got.orderBy("pos").collect()]
    assert [r.pop("pos") for r in rows] == list(range(len(want))) and rows == want


@pytest.mark.parametrize("size", [1, 23])
def test_one_long_record_over_many_splits(spark, tmp_path, small_splits, size):
    long = {"a": "} ] " * 400, "b": {"c": ["{" * 50] * 20}, "n": 1}
    want = [{"a": "s", "b": {"c": []}, "n": 0}] * size + [long] + [{"a": "e", "b": None, "n": 2}] * size
    got = read(spark, put(tmp_path / "a.json", json.dumps(want)))
    assert [{k: r[k] for k in ("a", "b", "n")} for r in got] == want and [r["pos"] for r in got] == list(range(len(want)))


@pytest.mark.parametrize(("text", "n"), [("[]", 0), (" [ ] \n", 0), ("[{}]", 1), ('[,{"n": 1}\n{"n": 2},,{"n": 3},]', 3), ('﻿[{"n": 1}]', 1), ('[{"b": {}}]', 1)])
def test_lenient_arrays(spark, tmp_path, small_splits, text, n):
    assert len(read(spark, put(tmp_path / "a.json", text))) == n


@pytest.mark.parametrize(
    "text",
    ['[{"n": 1}', '{"n": 1}', "", '[{"n": 1}, 5]', '[{"n": 1}, [2]]', '["a"]', '[{"n": 1}] {"n": 2}', '[{"n": 1}] []', '[{"n": 1}]]', '[{"n": 1}, {"n": [1]', '[{"n": 1, "a": "x]', '[{"n": 1}}]', '[{"n": }]', "[[]]", '[{"n": 1}, null]'],
)
def test_broken_arrays_end_the_job(spark, tmp_path, small_splits, text):
    with pytest.raises((PySparkException, ValueError, Py4JJavaError)):
        read(spark, put(tmp_path / "a.json", text))


def test_unclosed_arrays_are_noticed_at_once(spark, tmp_path):
    with pytest.raises(ValueError):
        records.read_array(spark, put(tmp_path / "a.json", '[{"n": [1, 2]'), NESTED)


# --- one file from many tasks ------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 500])
def test_files_are_as_one_task_would_write_them(spark, tmp_path, n):
    values = [{"k": f"é{i}", "v": None if i % 3 else i} for i in range(n)]
    rows = spark.createDataFrame([(i, v["k"], v["v"]) for i, v in enumerate(values)], "pos long, k string, v long").repartition(7)
    lines = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values]
    for name, want in (("a.json", "[\n" + ",\n".join(lines) + "\n]\n" if n else "[]\n"), ("b.jsonl", "".join(x + "\n" for x in lines))):
        path = tmp_path / name
        for _ in range(2):
            sinks.write_records(rows, str(path))
            assert path.read_bytes().decode() == want
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json", "b.jsonl"]


def test_array_is_written_in_parts(spark, tmp_path, monkeypatch):
    seen = []
    parts = sinks._parts
    monkeypatch.setattr(sinks, "_parts", lambda s, folder: seen.append(len(parts(s, folder))) or parts(s, folder))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_records(spark.range(1000).select(F.col("id").alias("pos"), F.col("id").alias("x")), str(tmp_path / "a.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] > 1
    assert [r["x"] for r in json.loads((tmp_path / "a.json").read_text())] == list(range(1000))


# --- places and medians ------------------------------------------------------------


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = order.ranks(df, [F.desc("v"), "i"], ("g",)).collect()
    by: dict = {}
    for g, v, i in rows:
        by.setdefault(g, []).append((-v, i))
    want = {i: k for group in by.values() for k, (_, i) in enumerate(sorted(group))}
    assert {r["i"]: r["rank"] for r in got} == want and len(got) == len(rows)
    assert sorted(r["rank"] for r in order.ranks(df, ["i"]).collect()) == list(range(2000))
    assert order.ranks(df.limit(0), ["i"], ("g",)).collect() == []


@pytest.mark.parametrize("kinds", [1, 3, 400])
def test_medians(spark, kinds):
    rng = random.Random(kinds)
    rows = [(rng.choice(["a", "b", None, "none"]), rng.randrange(kinds) / 4) for _ in range(999)]
    rows = [(g, None if g == "none" or rng.random() < 0.1 else v) for g, v in rows] + [("one", 2.5)]
    got = {r["g"]: r["median"] for r in order.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    want = {g: statistics.median([v for h, v in rows if h == g and v is not None]) for g in ("a", "b", None, "one")}
    assert got == want
    summary = {r["model"]: r for r in metrics.score_summary(spark.createDataFrame(rows, "model string, score double")).collect()}
    assert {m: r["median"] for m, r in summary.items()} == want | {"none": None}
    assert summary["none"]["count"] == 0 and summary["one"]["stdev"] == 0.0


def natural(name: str) -> list:
    """Text and numbers by turns, as names are compared by hand."""
    return [int(x) if k % 2 else x.lower() for k, x in enumerate(re.split(r"([0-9]+)", name))]


def test_natural_key_orders_as_parts_do(spark):
    rng = random.Random(9)
    names = ["", "1", "10.png", "9.png", "!x", "a", "a1", "a!", "A01", "a1b", "a10b2", "a10b10", "f007", "F7", "é2", "z" * 40, "0", "00", "a0", "a00b", "9" * 200, "1" + "0" * 200]
    names += ["".join(rng.choice("aB!0129. ") for _ in range(rng.randrange(8))) for _ in range(300)]
    keys = {r["n"]: bytes(r["k"]) for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", media.natural_key("n").alias("k")).collect()}
    for a in names:
        for b in rng.sample(names, 40):
            assert (keys[a] < keys[b]) == (natural(a) < natural(b)) and (keys[a] == keys[b]) == (natural(a) == natural(b)), (a, b)


def test_frames_of_a_large_folder(spark):
    names = [f"f{i}.png" for i in range(1, 2001)]
    listed = spark.createDataFrame([(f"r/big/{n}", "image") for n in names] + [("r/one/x.jpg", "image")], "path string, kind string").repartition(6)
    located = spark.createDataFrame([("v", "r/big", "frames"), ("w", "r/one", "frames"), ("x", "r/m.mp4", "video"), ("y", None, None)], "video_path string, media_path string, media_kind string")
    got = {r["video_path"]: (r["frame_paths"], r["video_file"]) for r in files.sampled_frames(located, listed, 3).collect()}
    assert got == {"v": ([f"r/big/f{i}.png" for i in (1, 1001, 2000)], None), "w": (["r/one/x.jpg"], None), "x": (None, "r/m.mp4"), "y": (None, None)}


def test_written_tables_keep_their_types(spark):
    df = spark.range(3).select("id", F.array("id").alias("a"))
    assert written(df, "t").dtypes == df.dtypes and written(df.limit(0), "t").count() == 0


def test_data_uris_have_no_line_breaks(spark):
    import base64

    body = bytes(range(256)) * 3
    got = spark.createDataFrame([(bytearray(body),)], "b binary").select(media.data_uri("b").alias("u")).first()["u"]
    assert got == "data:image/jpeg;base64," + base64.b64encode(body).decode()
