"""Operators on hand-made records, with results worked out by hand."""

from __future__ import annotations

import json
import math
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer.functions import media, rewards, text
from assayer.operators import align, assemble, checks, metrics, resume
from assayer.plans import chat, modes
from assayer.sources import records, sinks
from assayer.streaming import resumable


def one(spark, value, column):
    """The column over a table with the single text x."""
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def each(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


ROWS = [("a", "real", "real"), ("a", "fs", "fake"), ("a", "efs", "real"), ("b", "real", "Error"), ("b", "", "fake"), ("", "fake", " FAKE "), ("c", "", "real")]


def test_report(spark):
    rows = spark.createDataFrame([(s, s, l, a) for s, l, a in ROWS], "source string, dataset string, label string, answer string")
    got = {(r["grp"], r["name"]): tuple(r)[2:] for r in metrics.report(rows).collect()}
    third = 2 / 3
    want = {
        ("overall", ""): (5, 7 / 12, third, third),
        ("by_source", "a"): (3, 0.75, 0.5, third),
        ("by_source", "b"): (1, 0.0, 0.0, 0.0),
        ("by_source", "c"): (0, 0.0, 0.0, 0.0),
    }
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    assert len(got) == 7


def test_report_of_nothing(spark):
    rows = spark.createDataFrame([], "source string, dataset string, label string, answer string")
    assert [tuple(r) for r in metrics.report(rows).collect()] == [("overall", "", 0, 0.0, 0.0, 0.0)]


def test_unknown_label_ends_the_job(spark):
    rows = spark.createDataFrame([("bogus", "real")], "label string, answer string")
    with pytest.raises(PySparkException):
        metrics.metrics(rows).collect()


def test_null_label_counts_as_blank(spark):
    rows = spark.createDataFrame([(None, "real")], "label string, answer string")
    assert metrics.metrics(rows).first()["total"] == 0


def test_score_summary(spark):
    rows = spark.createDataFrame([("m", 7), ("m", 8), ("m", 8), ("m", 10), ("m", None), ("one", 5), ("none", None), ("none", None)], "model string, score int")
    got = {r["model"]: tuple(r)[1:] for r in metrics.score_summary(rows).collect()}
    assert got["m"] == (4, 1, 8.25, 8.0, pytest.approx(math.sqrt(1.1875)), 7.0, 10.0)
    assert got["one"] == (1, 0, 5.0, 5.0, 0.0, 5.0, 5.0)
    assert got["none"] == (0, 2, None, None, None, None, None)


def test_answers(spark):
    said = ["<answer> Fake </answer>", "<answer>real</answer> later fake", "it looks real, no, FAKE", "unreal faked", None, ""]
    assert each(spark, said, text.parse_answer("x")) == ["fake", "real", "fake", "Error", "Error", "Error"]
    assert one(spark, None, text.parse_answer("x", "")) == ""


def test_observations(spark):
    said = ["<observation>\n x \n</observation>", "plain", "<ERROR> boom", "<observation></observation>", None]
    assert each(spark, said, text.parse_observation("x", allow_plain=True)) == ["x", "plain", "", "<observation></observation>", ""]
    assert each(spark, said, text.parse_observation("x")) == ["x", "", "", "", ""]


def test_scores(spark):
    said = ["ANALYSIS: ok\nSCORE: 10", "ANALYSIS: ok\nSCORE: 11", "SCORE: 5", "ANALYSIS: ok\nSCORE: 7.5", "analysis: a\nb\n score : 3 \n"]
    assert [r and tuple(r) for r in each(spark, said, text.parse_score("x"))] == [(10, "ok"), None, None, None, (3, "a\nb")]


def test_sanitised(spark):
    said = ["<observation> <explanation> a </explanation> </observation>", "b <answer>real</answer>", " ", "<explanation></explanation>"]
    got = [tuple(r) for r in each(spark, said, text.sanitised("x"))]
    assert got[0] == ("a", None) and got[1][1] == "answer tag" and got[2][1] == "empty" and got[3][1] == "empty"
    with pytest.raises(PySparkException):
        one(spark, "", text.sanitize_plain("x"))


def test_rationale_prefers_filled_fields(spark):
    rows = spark.createDataFrame(
        [(1, "<explanation> a </explanation>", "b", None), (2, " ", "b", None), (3, None, None, "<explanation>c</explanation>"), (4, "<explanation></explanation>", "b", None)],
        "i int, explanation string, rationale string, response string",
    )
    got = [r["y"] for r in rows.orderBy("i").select(assemble.rationale_of(set(rows.columns)).alias("y")).collect()]
    assert got == ["a", "b", "c", ""]


def test_small_texts(spark):
    assert one(spark, "Ab  C/7-", text.slug("x")) == "ab-c-7"
    assert one(spark, "//", text.slug("x")) == "model"
    assert one(spark, "x" * 6001, F.length(text.clip("x"))) == 6000 + len(text.CLIP_MARK)
    assert one(spark, "<explanation>e</explanation><answer>real</answer>", text.render_final("x")) == "e\n\n**Verdict: REAL**"
    assert one(spark, " raw ", text.render_final("x")) == "raw"
    assert one(spark, "http://h/v1/", text.chat_url("x")) == "http://h/v1/chat/completions"
    assert one(spark, "http://h", text.chat_url_versioned("x")) == "http://h/v1/chat/completions"
    assert one(spark, "ftp://h", text.chat_url_versioned("x")) is None
    assert one(spark, "a secret b", text.redact("x", F.lit("secret"))) == "a [redacted] b"
    assert one(spark, "org/M-32B", text.model_size("x")) == "32b"
    assert one(spark, "0, 1,,2", text.device_count("x")) == 3
    assert each(spark, [" Yes", "0", None], text.truthy("x")) == [True, False, False]
    assert one(spark, "+sft", text.judge_adapter("x", F.lit(True))) == "judge_sft_video"
    assert one(spark, "zz", text.int_or("x", 4)) == 4
    assert tuple(one(spark, "flagship", text.required_adapters("x", F.lit("")))) == (True, True)


@pytest.mark.parametrize(
    ("count", "wanted", "want"),
    [(10, 4, [0, 3, 6, 9]), (6, 3, [0, 2, 5]), (3, 16, [0, 1, 2]), (5, 1, [2]), (300, 16, [0, 20, 40, 60, 80, 100, 120, 140, 159, 179, 199, 219, 239, 259, 279, 299])],
)
def test_uniform_indices(spark, count, wanted, want):
    df = spark.createDataFrame([(count,)], "n int")
    assert df.select(media.uniform_indices("n", wanted)).first()[0] == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=20), st.integers(2, 40))
def test_uniform_indices_round_as_python_does(spark, counts, wanted):
    df = spark.createDataFrame([(c,) for c in counts], "n int")
    got = [r["y"] for r in df.select(media.uniform_indices("n", wanted).alias("y")).collect()]
    assert got == [list(range(c)) if c <= wanted else [round(i * (c - 1) / (wanted - 1)) for i in range(wanted)] for c in counts]


def test_frames(spark):
    df = spark.createDataFrame([(0, 5)], "zero int, n int")
    with pytest.raises(PySparkException):
        df.select(media.uniform_indices("zero", 4)).collect()
    assert df.select(media.uniform_indices_distinct("zero", 4)).first()[0] == [0]
    assert df.select(media.even_frames(F.sequence(F.lit(1), F.lit(3)))).first()[0] == [1, 2, 3, 3]
    assert df.select(media.natural_sort(F.array(*map(F.lit, ["f10.png", "f2.png", "F1.png"])))).first()[0] == ["F1.png", "f2.png", "f10.png"]
    assert df.select(media.duration_seconds("n", F.lit(2.0))).first()[0] == 2.5
    assert one(spark, "videos/a/b.mp4", media.frames_dir("x")) == "frames/a/b.mp4"
    assert one(spark, "/d/v.mp4", media.frames_dir("x")) == "frames/v"
    assert one(spark, "videos/a.mp4", media.media_candidates("x", "r")) == ["r/frames/a.mp4", "r/videos/a.mp4", "r/videos/a.mp4", "r/frames/videos/a.mp4"]
    blocks = df.select(media.frame_blocks(F.array(F.lit("u"), F.lit("v"))).alias("b")).first()["b"]
    assert [b["text"] for b in blocks if b["type"] == "text"] == ["[frame 1/2]", "[frame 2/2]"]


@pytest.mark.parametrize(("words", "want"), [(0, 0), (4, 0.5), (8, 1), (140, 1), (141, 59 / 60), (170, 0.5), (200, 0)])
def test_length_reward(spark, words, want):
    assert one(spark, f"<explanation>{'w ' * words}</explanation>", rewards.length("x")) == pytest.approx(want)


def test_format_reward(spark):
    said = ["<explanation>e</explanation><answer>real</answer>", "<answer>real</answer>", "<explanation>e</explanation><answer>real</answer><answer>fake</answer>", "bare"]
    assert each(spark, said, rewards.format("x")) == pytest.approx([1, 2 / 3, 2 / 3, 0])
    rewards.register(spark)
    spark.createDataFrame([(s,) for s in said], "x string").createOrReplaceTempView("said")
    assert [r[0] for r in spark.sql("SELECT reward_format(x, 'real') FROM said").collect()] == pytest.approx([1, 2 / 3, 2 / 3, 0])
    assert [r[0] for r in spark.sql("SELECT reward_accuracy(x, 'real') FROM said").collect()] == [1, 1, 1, 0]


def keyed(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "pos long, video_path string")


def test_zip(spark):
    a, b = keyed(spark, ["v0", "v1", "v2", "v3", "v4"]), keyed(spark, ["v0", "v2", "v1", "v3"])
    got = {r["pos"]: r["problem"] for r in align.zip_problems({"a": a, "b": b}).collect()}
    assert got == {1: "key", 2: "key", 4: "length"}
    with pytest.raises(PySparkException):
        align.strict_zip({"a": a, "b": b}).collect()
    assert align.strict_zip({"a": a, "b": a}).count() == 5
    assert align.strict_zip({"a": a, "b": keyed(spark, ["v0", "v1"])}, upto=1).count() == 1


def test_prefix(spark):
    manifest = keyed(spark, ["a", "b", "c"])
    assert [r["video_path"] for r in align.pending_after_prefix(manifest, keyed(spark, ["a"])).orderBy("pos").collect()] == ["b", "c"]
    for wrong in (["b"], ["a", "b", "c", "d"]):
        with pytest.raises(PySparkException):
            align.pending_after_prefix(manifest, keyed(spark, wrong)).collect()


def test_logs_and_shards(spark):
    log = lambda rows: spark.createDataFrame(rows, "pos long, video_path string, answer string")
    merged = resume.merge_logs(log([(0, "k1", "Error")]), log([(0, "k1", "fake")]), "video_path")
    assert merged.first()["answer"] == "fake"
    keys = keyed(spark, ["k1"])
    assert resume.pending(keys, merged, "video_path", resume.complete("single")).count() == 0
    both = resume.merge_shards([log([(0, "k1", "real")]), log([(0, "k1", "fake")])], keys, "video_path")
    assert both.first()["answer"] == "real"
    assert resume.merge_shards([log([(0, "k1", "real")]), None], keys, "video_path") is None
    ten = keyed(spark, [f"v{i}" for i in range(10)])
    assert sorted(r["pos"] for r in resume.shard(ten, 3, 1, limit=2).collect()) == [1, 4]


def test_checks(spark):
    with pytest.raises(PySparkException):
        checks.demand_unique(keyed(spark, ["a", "a"]), "video_path").collect()
    assert checks.demand_unique(keyed(spark, ["a", "b"]), "video_path").count() == 2
    with pytest.raises(PySparkException):
        checks.demand_filled(keyed(spark, [" "]), "video_path").collect()


def test_policies(spark):
    wrong = spark.createDataFrame([(0,)], "i int").select(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit("real").alias("answer"), F.lit("t").alias("text")) for n in "ab"]).alias("r")
    )
    seen = {r: F.lit("o") for r in assemble.ROLES}
    get = lambda p, s=None, label="fake": tuple(wrong.select(assemble.explanation_plan(F.lit(label), F.col("r"), p, s).alias("p")).first()["p"])[:3]
    assert get("drop") == (0, True, True)
    assert get("blind") == (2, True, False)
    assert get("ground-truth", seen) == (2, True, False)
    assert get("drop", label="real") == (2, False, False)
    with pytest.raises(PySparkException):
        get("ground-truth", seen | {"motion": F.lit(" ")})
    with pytest.raises(ValueError):
        get("ground-truth")


SCHEMA = "video_path string, label string"


def write(path, content):
    path.write_text(content)
    return str(path)


def test_scans(spark, tmp_path):
    array = write(tmp_path / "a.json", '\n[{"video_path": "v1"},\n {"video_path": "v2", "label": "real"}]')
    lines = write(tmp_path / "l.jsonl", '{"video_path": "v1"}\n\n{"video_path": "v2", "label": "real"}\n')
    for path in (array, lines):
        got = [(r["pos"], r["video_path"], r["label"]) for r in records.read_records(spark, path, SCHEMA).orderBy("pos").collect()]
        assert got == [(0, "v1", None), (1, "v2", "real")]
    assert records.read_records(spark, write(tmp_path / "e.jsonl", " \n \n"), SCHEMA).count() == 0


def test_positions_over_many_parts(spark, tmp_path):
    (tmp_path / "many.jsonl").mkdir()
    for k in range(7):
        write(tmp_path / "many.jsonl" / f"part-{k}.jsonl", "".join(f'{{"video_path": "{k}-{i}"}}\n\n' for i in range(k)))
    got = records.read_jsonl(spark, str(tmp_path / "many.jsonl"), SCHEMA).collect()
    assert sorted(r["pos"] for r in got) == list(range(21))
    by = {r["pos"]: r["video_path"].split("-") for r in got}
    assert all(int(by[p + 1][1]) == int(by[p][1]) + 1 for p in range(20) if by[p][0] == by[p + 1][0])


@pytest.mark.parametrize(
    ("name", "content"),
    [("s.jsonl", '{"video_path": "v"}\n5\n'), ("x.jsonl", '{"video_path": "v"}\n[{"video_path": "w"}]\n'), ("b.jsonl", '{"video_path"\n{"video_path": "v"}\n'), ("u.json", '[{"video_path": "v"}'), ("c.json", '[{"video_path": "v"}, {"video_path": ["a"]'), ("n.json", '[{"video_path": "v"}, 5]')],
)
def test_broken_files_end_the_job(spark, tmp_path, name, content):
    path = write(tmp_path / name, content)
    with pytest.raises((PySparkException, ValueError, Py4JJavaError)):
        records.read_records(spark, path, SCHEMA).collect()


def test_repair(spark, tmp_path):
    torn = write(tmp_path / "t.jsonl", '{"video_path": "v1"}\n{"video_pa')
    assert [r["video_path"] for r in records.repair_truncated(spark, torn, SCHEMA).collect()] == ["v1"]
    with pytest.raises(PySparkException):
        records.repair_truncated(spark, write(tmp_path / "m.jsonl", '{"vid\n{"video_path": "v1"}\n'), SCHEMA).collect()
    with pytest.raises(ValueError):
        records.repair_truncated(spark, "x.json", SCHEMA)


def test_order_of_a_folder_of_files(spark, tmp_path):
    """Files count in the order of their names, though Spark reads larger ones first; the torn line is the last file's."""
    lines = [json.dumps({"video_path": f"v{i}"}) for i in range(60)]
    ends = [0, 2, 50, 57, 60]
    (tmp_path / "log.jsonl").mkdir()
    for k in range(4):
        torn = '\n{"video_pa' if k == 3 else "\n"
        write(tmp_path / "log.jsonl" / f"part-0000{k}.txt", "\n".join(lines[ends[k] : ends[k + 1]]) + torn)
    rows = records.repair_truncated(spark, str(tmp_path / "log.jsonl"), SCHEMA).orderBy("pos").collect()
    assert [(r["pos"], r["video_path"]) for r in rows] == [(i, f"v{i}") for i in range(60)]


def test_threads_are_for_backends_that_wait():
    """The four observers are asked at once where answers are waited for, and in line where they are computed; the results are the same."""

    class Seen(chat.Stub):
        def chat(self, messages):
            threads.add(threading.get_ident())
            return super().chat(messages)

    class Waiting(Seen):
        waits = True

        def chat(self, messages):
            if "<observation>" in messages[-1]["content"]:
                together.wait(20)  # until all four are there
            return super().chat(messages)

    threads, together, got = set(), threading.Barrier(4), {}
    for kind in (Seen, Waiting):
        threads.clear()
        got[kind] = modes.process({}, kind(), "flagship") | {"wall_sec": 0}
        assert len(threads) == (1 if kind is Seen else 5)
    assert got[Seen] == got[Waiting] and len(got[Seen]["calls"]) == 5


def test_keys(spark, tmp_path):
    for name, content in (("k.json", '["a", {"video_path": " b "}]'), ("k.jsonl", '{"video_path": "a"}\n{"video_path": "b"}\n'), ("k.txt", "a\n\n b\n")):
        assert [r["video_path"] for r in records.read_keys(spark, write(tmp_path / name, content)).orderBy("pos").collect()] == ["a", "b"]
    with pytest.raises(PySparkException):
        records.read_keys(spark, write(tmp_path / "d.txt", "a\na\n")).collect()
    with pytest.raises(PySparkException):
        records.read_indexed(spark, write(tmp_path / "d.jsonl", '{"video_path": "a"}\n{"video_path": "a"}\n'), SCHEMA).collect()


def test_sources():
    assert records.named_sources(["a=x", "b=y=z"]) == {"a": "x", "b": "y=z"}
    for wrong in (["a"], ["=x"], ["a=x", "a=y"], []):
        with pytest.raises(ValueError):
            records.named_sources(wrong)
    with pytest.raises(ValueError):
        records.named_sources(["texture=x"], assemble.ROLES)
    assert records.output_name("out", "Org/M 7B", "judge", "test", True) == "out/org-m-7b/judge-video-test.jsonl"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", None), (0, "a", "é")], "pos long, video_path string, label string")
    lines, array = str(tmp_path / "o.jsonl"), str(tmp_path / "o.json")
    for path in (lines, array, lines):
        sinks.write_records(rows, path)
    want = [{"video_path": "a", "label": "é"}, {"video_path": "b", "label": None}]
    assert [json.loads(x) for x in open(lines, encoding="utf-8")] == want
    assert json.load(open(array, encoding="utf-8")) == want
    assert [r["video_path"] for r in records.read_records(spark, lines, SCHEMA).orderBy("pos").collect()] == ["a", "b"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["o.json", "o.jsonl"]
    assert sinks.sidecar("d/o.jsonl", "metrics") == "d/o_metrics.json"


class Broken:
    """The stub, but for calls that show a frame named bad, and judges that are to fail."""

    def __init__(self, judge=False):
        self.judge = judge

    def chat(self, messages):
        if "bad" in str(messages[-1]["content"]) or (self.judge and "report:" in str(messages[-1]["content"])):
            raise ValueError("bad")
        return chat.Stub().chat(messages)


@pytest.mark.parametrize("mode", modes.MODES)
def test_modes(spark, mode):
    seen = dict.fromkeys(assemble.ROLES, "seen")
    rows = spark.createDataFrame([("v1", ["m1", "m2"], seen), ("v2", ["bad"], {}), ("v3", [], seen)], "video_path string, frames array<string>, observations map<string, string>")
    got = {r["video_path"]: r for r in modes.infer(rows, Broken(), mode, "video_path string", role="motion", judge_video=True).collect()}
    assert got["v1"]["error"] is None and got["v2"]["error"] is not None and got["v3"]["error"] == "ValueError: no frames"
    assert got["v2"]["answer"] == got["v3"]["answer"] == ("" if mode == "observer" else "Error")
    assert [c["name"] for c in got["v1"]["calls"]] == {"multiturn": [*assemble.ROLES, "judge"], "flagship": [*assemble.ROLES, "judge"], "observer": ["motion"]}.get(mode, [mode])
    assert got["v1"]["observations"].get("motion") if mode == "observer" else got["v1"]["answer"] in ("real", "fake")
    if mode == "cot":
        assert set(got["v1"]["observations"]) == set(assemble.ROLES) and all(v.startswith("sign ") for v in got["v1"]["observations"].values())


def test_failed_rows_keep_what_they_had(spark):
    rows = spark.createDataFrame([("v1",)], "video_path string")
    for mode in ("flagship", "multiturn"):
        r = modes.infer(rows, Broken(judge=True), mode, "video_path string").first()
        assert r["answer"] == "Error" and r["error"] == "ValueError: bad" and r["explanation"] == ""
        assert [c["name"] for c in r["calls"]] == list(assemble.ROLES) and set(r["observations"]) == set(r["responses"]) == set(assemble.ROLES)
    reports = rows.withColumns({f"{r}_report": F.lit(f"<observation>{r}</observation>") for r in assemble.ROLES})
    assert modes.infer(reports, chat.Stub(), "judge", "video_path string").first()["observations"] == {r: r for r in assemble.ROLES}
    with pytest.raises(Exception, match="bad"):
        modes.infer(rows, Broken(judge=True), "flagship", "video_path string", fail_fast=True).collect()


def test_frames_go_as_parts():
    asked = []

    class Ear(chat.Stub):
        def chat(self, messages):
            asked.append(messages[-1]["content"])
            return super().chat([{"content": asked[-1][-1]["text"]}])

    modes.process({"frames": ["u1", "u2"]}, Ear(), "single")
    assert [p["type"] for p in asked[0]] == ["text", "image_url"] * 2 + ["text"]
    assert asked[0][2]["text"] == "[frame 2/2]" and asked[0][3]["image_url"] == {"url": "u2", "detail": "auto"} and asked[0][4]["text"] == assemble.QUERY["single"]


def test_a_slot_for_each_request(spark):
    """Six rows of five calls take 30 slots, and so do retries of a server."""
    began = __import__("time").perf_counter()
    rows = spark.createDataFrame([(f"v{i}",) for i in range(6)], "video_path string").coalesce(1)
    assert modes.infer(rows, chat.Stub(), "flagship", "video_path string", rpm=60 * 40).count() == 6
    assert __import__("time").perf_counter() - began >= 29 / 40
    slots, replies = [], [(429, {}, ""), (200, {}, {"choices": [{"message": {"content": "ok"}}]})]

    class Server(chat.Http):
        def send(self, payload):
            return replies.pop(0)

    assert Server("u", "m", sleep=lambda s: None).paced(lambda: slots.append(1)).chat([]).text == "ok" and len(slots) == 2


def test_spread_flagship_agrees(spark):
    rows = spark.createDataFrame([("v1", ["m1"]), ("v2", ["m2"])], "video_path string, frames array<string>")
    a = modes.infer(rows, chat.Stub(), "flagship", "video_path string")
    b = modes.infer_spread(rows, chat.Stub(), "video_path", "video_path string, frames array<string>")
    pick = lambda df: sorted((r["video_path"], r["answer"], r["explanation"], len(r["calls"])) for r in df.collect())
    assert pick(a) == pick(b)


def test_insists_where_access_is_denied():
    tries, waits = [], []

    def action():
        tries.append(1)
        if len(tries) < 4:
            raise PermissionError("in use")
        return "done"

    assert sinks.insist(action, sleep=waits.append) == "done" and len(waits) == 3 and all(0.2 <= w <= 0.4 for w in waits)
    with pytest.raises(PermissionError):
        tries.clear()
        sinks.insist(lambda: action() if len(tries) > 99 else (_ for _ in ()).throw(PermissionError()), attempts=3, sleep=waits.append)
    with pytest.raises(ValueError):
        sinks.insist(lambda: int("x"), sleep=waits.append)


def test_single_medium(spark, tmp_path):
    from assayer.sources import media as files

    (tmp_path / "v").mkdir()
    with pytest.raises(ValueError, match="without frames"):
        files.single(spark, str(tmp_path / "v"))
    (tmp_path / "v" / "1.PNG").write_bytes(b"x")
    (tmp_path / "a.mp4").write_bytes(b"x")
    (tmp_path / "a.txt").write_bytes(b"x")
    assert files.single(spark, str(tmp_path / "v"))[1] == "frames" and files.single(spark, str(tmp_path / "a.mp4"))[1] == "video"
    with pytest.raises(ValueError, match="is none of .bmp, .avi|is none of"):
        files.single(spark, str(tmp_path / "a.txt"))
    with pytest.raises(FileNotFoundError):
        files.single(spark, str(tmp_path / "none.mp4"))
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-100",), ("checkpoint-20",)], "n string")
    assert names.agg(media.latest_version("n")).first()[0] == "checkpoint-100"


def test_reports_are_in_order(spark):
    rows = spark.createDataFrame([(s, d, "real", "real") for s in "cab" for d in "zy"], "source string, dataset string, label string, answer string")
    assert [(r["grp"], r["name"]) for r in metrics.report(rows).collect()] == [("overall", ""), *[("by_source", s) for s in "abc"], *[("by_dataset", d) for d in "yz"]]
    assert [r["name"] for r in metrics.grouped(rows, "source").collect()] == ["a", "b", "c"]


def test_retries():
    waits, replies = [], [(429, {"Retry-After": "7"}, ""), (503, {}, ""), (200, {}, {"choices": [{"message": {"content": "ok"}}], "usage": {"completion_tokens": 3}})]

    class Server(chat.Http):
        def send(self, payload):
            return replies.pop(0)

    reply = Server("u", "m", sleep=waits.append).chat([])
    assert (reply.text, reply.completion_tokens) == ("ok", 3)
    assert 7 <= waits[0] <= 8 and 4 <= waits[1] <= 4.8
    replies[:] = [(400, {}, "no")]
    with pytest.raises(chat.Failure):
        Server("u", "m", sleep=waits.append).chat([])
    assert len(waits) == 2
    assert [chat.delay(k) for k in range(6)] == [2, 4, 8, 16, 30, 30]
    assert chat.content({"content": [{"text": "a"}, {"text": "b"}]}) == "a\nb" and chat.content({"content": "", "reasoning_content": "r"}) == "r"


def test_pace():
    now, waits = [0.0], []
    pace = chat.Pace(60, 2, clock=lambda: now[0], sleep=waits.append)
    for _ in range(3):
        pace.wait()
    assert waits == [2.0, 4.0]


def test_resumable(spark, tmp_path):
    inputs = keyed(spark, [f"v{i}" for i in range(7)])
    schema = "video_path string, answer string"
    log = str(tmp_path / "log")
    first = lambda df: df.select("video_path", F.when(F.col("pos") % 2 == 0, F.lit("real")).otherwise(F.lit("Error")).alias("answer"))
    second = lambda df: df.select("video_path", F.lit("fake").alias("answer"))
    done = resume.complete("single")
    a = [r["answer"] for r in resumable.run(inputs, first, log, schema, "video_path", done, batch_rows=3).collect()]
    assert a == ["real", "Error"] * 3 + ["real"]
    b = [r["answer"] for r in resumable.run(inputs, second, log, schema, "video_path", done, batch_rows=3).collect()]
    assert b == ["real", "fake"] * 3 + ["real"]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, sink, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", '{"video_path": "v1"}\n{"video_path": "v2"}\n')
    same = lambda df: df.withColumn("label", F.lit("real"))
    for n, more in ((2, None), (3, '{"video_path": "v3"}\n')):
        if more:
            write(tmp_path / "in" / "b.jsonl", more)
        resumable.stream(spark, source, "video_path string", same, sink, point)
        assert spark.read.json(f"{sink}/batch=*").count() == n


class Plain:
    """Repeats what it is asked, without tags."""

    def chat(self, messages):
        return chat.Reply(f"merged {len(messages[-1]['content'])}", 2, 0.0)


def reports(spark, rows, columns):
    return spark.createDataFrame([(i, f"v{i}", *r) for i, r in enumerate(rows)], f"pos long, video_path string, label string, {columns}")


def test_consolidation(spark):
    from assayer.plans import workflows

    manifest = spark.createDataFrame([(0, "v0", "fake"), (1, "v1", "real")], "pos long, video_path string, label string")
    roles = ", ".join(f"{r}_response string" for r in assemble.ROLES)
    a = reports(spark, [("fs", "t", "l", "m", "p"), ("", "t", "l", "m", "p")], roles)
    b = reports(spark, [(None, "", "l", "m", "p"), ("real", "<error> x", "l", "m", "p")], roles)
    got = {r["pos"]: r for r in workflows.consolidate_observations(manifest, {"a": a, "b": b}, Plain()).collect()}
    assert got[0]["num_models_used"] == {"texture": 1, "lighting": 2, "motion": 2, "physics": 2} and set(got[1]["observations"]) == set(assemble.ROLES)
    with pytest.raises(PySparkException):
        workflows.consolidate_observations(manifest, {"a": a, "b": reports(spark, [("real", *"tlmp"), ("real", *"tlmp")], roles)}, Plain()).collect()
    said = reports(spark, [("", "<explanation>e</explanation><answer>real</answer>"), ("", "<explanation>e</explanation><answer>real</answer>")], "response string")
    seen = spark.createDataFrame([(0, *"tlmp"), (1, *"tlmp")], f"pos long, {', '.join(f'{r} string' for r in assemble.ROLES)}")
    for policy, want in (("drop", ("", 0, True, True)), ("blind", ("merged", 1, True, False)), ("ground-truth", ("merged", 1, True, False))):
        rows = {r["pos"]: r for r in workflows.consolidate_explanations(manifest, {"a": said}, policy, Plain(), seen).collect()}
        text, used, wrong, dropped = want
        assert rows[0]["aggregated_explanation"].startswith(text) and tuple(rows[0])[3:6] == (used, wrong, dropped)
        assert tuple(rows[1])[3:6] == (1, False, False)


def test_grading(spark):
    from assayer.plans import workflows

    refs = spark.createDataFrame([(0, "v0", "fake", "r0"), (1, "v1", "real", "r1")], "pos long, video_path string, label string, rationale string")
    pred = lambda t: spark.createDataFrame([("v0", "fs", "fake", t), ("v1", "", "real", t)], "video_path string, label string, answer string, explanation string")
    out = workflows.grade(refs, {"a": pred("x"), "b": pred("")}, "full", chat.Stub())
    rows = {(r["model"], r["video_path"]): r for r in out.collect()}
    assert len(rows) == 4 and all((r["score"] is None) == (k[0] == "b") == (r["error"] is not None) for k, r in rows.items())
    done = out.where("model = 'a'").select("model", "video_path", "mode", "score")
    assert workflows.grade(refs, {"a": pred("x"), "b": pred("")}, "full", chat.Stub(), done).count() == 2
    with pytest.raises(PySparkException):
        workflows.grade(refs, {"a": pred("x")}, "noanswer", chat.Stub(), done).collect()
    with pytest.raises(PySparkException):
        workflows.grade(refs, {"a": pred("x").where("video_path = 'v0'")}, "full", chat.Stub()).collect()


def test_training_rows_and_media(spark, tmp_path):
    from assayer.plans import workflows
    from assayer.sources import media as files

    folder = tmp_path / "frames" / "a" / "v0.mp4"
    folder.mkdir(parents=True)
    for i in (1, 2, 10):
        (folder / f"f{i}.png").write_bytes(b"x")
    (tmp_path / "videos").mkdir()
    (tmp_path / "videos" / "v1.MP4").write_bytes(b"x")
    seen = files.listing(spark, str(tmp_path))
    rows = spark.createDataFrame([("videos/a/v0.mp4",), ("videos/v1.MP4",), ("videos/none.mp4",)], "video_path string")
    got = {r["video_path"]: r for r in files.sampled_frames(files.locate(rows, seen, str(tmp_path)), seen, 2).collect()}
    assert [p.rsplit("/", 1)[1] for p in got["videos/a/v0.mp4"]["frame_paths"]] == ["f1.png", "f10.png"]
    assert got["videos/v1.MP4"]["video_file"].endswith("v1.MP4") and got["videos/none.mp4"]["media_kind"] is None
    gold = spark.createDataFrame([(0, "v0", "efs", "why")], "pos long, video_path string, label string, explanation string")
    parts = {r: spark.createDataFrame([(0, "v0", "fake", f"saw {r}")], f"pos long, video_path string, label string, {r} string") for r in assemble.ROLES}
    joined = workflows.joined_reports(gold, parts)
    judge = workflows.training_rows(joined, "judge").first()
    assert judge["messages"][2]["content"] == "<explanation>\nwhy\n</explanation>\n<answer>fake</answer>"
    assert "Motion analysis report:\nsaw motion\n\n" in judge["messages"][1]["content"]
    assert workflows.training_rows(joined, "reinforce").first()["solution"] == "fake"
    with_media = joined.withColumn("frame_paths", F.array(F.lit("f"))).withColumn("video_file", F.lit(None).cast("string"))
    row = workflows.training_rows(with_media, "observer", role="motion").first()
    assert row["messages"][2]["content"] == "<observation>\nsaw motion\n</observation>" and row["chat_template_kwargs"]["max_pixels"] == 65536


def test_evaluate_a_file(spark, tmp_path):
    from assayer.plans import workflows

    path = write(tmp_path / "r.jsonl", '{"video_path": "a", "label": "real", "answer": "real", "source": "s"}\n{"video_path": "b", "label": "fs", "answer": "real"}\n')
    report = workflows.evaluate(spark, path, str(tmp_path / "r_metrics.json"))
    assert report.where("grp = 'overall'").first()["balanced_accuracy"] == 0.5
    assert len(json.loads((tmp_path / "r_metrics.json").read_text())) == 2
