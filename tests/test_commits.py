"""Logs and shards that are killed half-way or finish together, rates shared by tasks, listings by prefix."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import resume
from assayer.plans import chat, modes, slots
from assayer.sources import media
from assayer.streaming import commits, resumable, shards

SCHEMA = "video_path string, answer string"


def inputs(spark, n):
    return spark.createDataFrame([(i, f"v{i}") for i in range(n)], "pos long, video_path string")


def answered(said):
    return lambda df: df.select("video_path", F.lit(said).alias("answer"))


def answers(df):
    return [(r["pos"], r["answer"]) for r in df.collect()]


# --- commits -----------------------------------------------------------------------


@pytest.mark.parametrize("where", ["before the data", "within the data", "between data and commit"])
def test_a_killed_run_neither_repeats_nor_drops_a_row(spark, tmp_path, monkeypatch, where):
    log, calls = str(tmp_path / "log"), []

    class Killed(BaseException):
        pass

    def kill(*_a, **_k):
        calls.append(1)
        if len(calls) == 3:
            raise Killed

    commit, write = commits.CommitLog._commit, commits.sinks.write_batch

    def broken_write(rows, path):
        if where == "before the data":
            kill()
        write(rows, path)
        if where == "within the data" and len(calls) == 2:
            first = next(p for p in (tmp_path / "log" / "data" / path.rsplit("/", 1)[1]).iterdir() if p.name.startswith("part-"))
            first.write_text(first.read_text()[:9])  # what a task had written by then
        if where == "within the data":
            kill()

    def broken_commit(self, *a):
        if where == "between data and commit":
            kill()
        commit(self, *a)

    monkeypatch.setattr(commits.CommitLog, "_commit", broken_commit)
    monkeypatch.setattr(commits.sinks, "write_batch", broken_write)
    with pytest.raises(Killed):
        resumable.run(inputs(spark, 10), answered("real"), log, SCHEMA, "video_path", resume.complete("single"), batch_rows=3)
    monkeypatch.undo()
    kept = commits.CommitLog(spark, log)
    assert sorted(r["video_path"] for r in kept.read(SCHEMA).collect()) == [f"v{i}" for i in range(6)]
    got = resumable.run(inputs(spark, 10), answered("fake"), log, SCHEMA, "video_path", resume.complete("single"), batch_rows=3)
    assert answers(got) == [(i, "real" if i < 6 else "fake") for i in range(10)]
    assert kept.read(SCHEMA).count() == 10  # each row once, not only in the result
    kept.sweep()
    assert len(list((tmp_path / "log" / "data").iterdir())) == len(kept.commits()) == 4
    assert answers(commits.results(kept, SCHEMA, inputs(spark, 10), "video_path")) == answers(got)


def test_nothing_pending_writes_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    for _ in range(2):
        assert answers(resumable.run(inputs(spark, 4), answered("real"), log, SCHEMA, "video_path", resume.complete("single"))) == [(i, "real") for i in range(4)]
    assert len(commits.CommitLog(spark, log).commits()) == 1
    assert resumable.run(inputs(spark, 0), answered("real"), str(tmp_path / "none"), SCHEMA, "video_path", resume.complete("single")).count() == 0


def test_compaction(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    for k in range(3):
        log.append(spark.createDataFrame([(f"v{i}", f"{k}") for i in range(k, 6)], SCHEMA))
    wanted = spark.createDataFrame([(0, "v5"), (1, "v0"), (2, "v1"), (3, "v9")], "pos long, video_path string")
    log.compact(SCHEMA, ["video_path"], wanted)
    assert len(log.commits()) == 1
    assert {r["video_path"]: r["answer"] for r in log.read(SCHEMA).collect()} == {"v5": "2", "v0": "0", "v1": "1"}
    lines = [json.loads(x)["video_path"] for p in sorted((tmp_path / "log" / "data" / log.commits()[0][1]).glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["v5", "v0", "v1"]
    log.append(spark.createDataFrame([("v0", "new")], SCHEMA))
    log.sweep()
    assert [n for n, _ in log.commits()] == [3, 4] and log.read(SCHEMA).count() == 4


def test_writers_at_the_same_time(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    threads = [threading.Thread(target=log.append, args=(spark.createDataFrame([(f"v{k}", "real")], SCHEMA),)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["video_path"] for r in log.read(SCHEMA).collect()) == ["v0", "v1", "v2", "v3"]


# --- shards ------------------------------------------------------------------------


def test_two_shards_that_finish_together(spark, tmp_path):
    rows, output = inputs(spark, 9), str(tmp_path / "out" / "r.jsonl")
    part = lambda i, said: resume.shard(rows, 3, i).select("pos", "video_path", F.lit(said).alias("answer"))
    assert shards.finish(part(0, "real"), output, 3, 0, rows, "video_path", SCHEMA) is None
    assert shards.missing(spark, output, 3) == [1, 2]
    got = {}

    def finish(i):
        got[i] = shards.finish(part(i, "real"), output, 3, i, rows, "video_path", SCHEMA)

    threads = [threading.Thread(target=finish, args=(i,)) for i in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert any(x is not None for x in got.values())
    want = [{"video_path": f"v{i}", "answer": "real"} for i in range(9)]
    assert [json.loads(x) for x in (tmp_path / "out" / "r.jsonl").read_text().splitlines()] == want
    again = shards.finish(part(1, "fake"), output, 3, 1, rows, "video_path", SCHEMA)  # a shard that is run again
    assert answers(again.orderBy("pos")) == [(i, "fake" if i % 3 == 1 else "real") for i in range(9)]
    assert sorted(p.name for p in (tmp_path / "out" / "shards").iterdir() if not p.name.startswith(".")) == [f"r.shard0000{i}-of-00003.jsonl" for i in range(3)]


def test_shard_names():
    assert shards.shard_path("a.b/out.json", 12, 3) == "a.b/shards/out.shard00003-of-00012.json"
    assert shards.shard_path("out", 2, 0) == "shards/out.shard00000-of-00002"
    with pytest.raises(ValueError):
        shards.shard_path("out", 2, 2)


# --- rates -------------------------------------------------------------------------


def timed(row, backend):
    backend.chat([{"role": "user", "content": row["x"]}])
    return {"at": time.time()}


@pytest.mark.parametrize("busy", [1, 8])
def test_a_rate_for_all_tasks(spark, busy):
    rows = 24
    where = F.col("id") % busy
    df = spark.range(rows).select(F.col("id").cast("string").alias("x"), where.cast("int").alias("p")).rdd.map(lambda r: (r["p"], r["x"])).partitionBy(8).toDF("p int, x string").select("x")
    assert df.rdd.getNumPartitions() == 8
    gap = 0.05
    at = sorted(r["at"] for r in chat.map_rows(df, "x string, at double, error string", timed, chat.Stub(), rpm=60 / gap).collect())
    spread = at[-1] - at[0]
    # Never faster than the rate; a task that is alone has all of it, not an eighth.
    assert (rows - 1) * gap - 0.05 <= spread <= (rows - 1) * gap + 3
    for k in range(rows - 5):
        assert at[k + 5] - at[k] >= 4 * gap - 0.1


def test_slots_need_the_secret(spark):
    server = slots.serve(spark, 600)
    assert server.secret not in repr(server)
    stranger = slots.Slots(server.host, server.port, "0" * 32)
    with pytest.raises((ValueError, OSError)):
        stranger.wait()
    server.wait()


def test_observers_and_judges_share_a_rate(spark):
    rows = spark.createDataFrame([("v1", ["m1"])], "video_path string, frames array<string>")
    began = time.time()
    assert modes.infer_spread(rows, chat.Stub(), "video_path", "video_path string, frames array<string>", rpm=60 / 0.2).first()["error"] is None
    assert time.time() - began >= 4 * 0.2 - 0.1


# --- listings ----------------------------------------------------------------------


def fill(root, names):
    for n in names:
        at = root / n
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x")  # Spark leaves out empty files


NAMES = ["frames/a/1.mp4/f1.png", "frames/a/1.mp4/f2.JPG", "videos/a/1.mp4", "videos/a/2.MP4", "frames/a/3.mp4/notes.txt", "videos/a/3.mp4", "frames/videos/b/4.mp4/x.webp", "other/deep/er/z.png", "pic.png", "é ü/ö.mp4"]
PATHS = ["videos/a/1.mp4", "videos/a/2.MP4", "videos/a/3.mp4", "videos/b/4.mp4", "videos/none.mp4", "pic.png", "a/1.mp4", "é ü/ö.mp4", "other/deep"]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_listing_by_prefix_finds_what_a_whole_listing_does(spark, tmp_path, scheme):
    fill(tmp_path, NAMES)
    root = scheme + str(tmp_path)
    rows = spark.createDataFrame([(p,) for p in [*PATHS, f"{root}/pic.png"]], "video_path string")
    found = {r["video_path"]: (r["media_path"], r["media_kind"]) for r in media.locate_below(rows, root).collect()}
    want = {p: (None, None) for p in PATHS} | {
        "videos/a/1.mp4": ("frames/a/1.mp4", "frames"), "videos/a/2.MP4": ("videos/a/2.MP4", "video"), "videos/a/3.mp4": ("videos/a/3.mp4", "video"),
        "videos/b/4.mp4": ("frames/videos/b/4.mp4", "frames"), "pic.png": ("pic.png", "image"), "a/1.mp4": ("frames/a/1.mp4", "frames"), "é ü/ö.mp4": ("é ü/ö.mp4", "video"),
    }
    assert {p: (m and m.removeprefix(root + "/"), k) for p, (m, k) in found.items() if p in want} == want
    if not scheme:
        assert found[f"{root}/pic.png"] == (f"{root}/pic.png", "image")
        whole = {r["video_path"]: (r["media_path"], r["media_kind"]) for r in media.locate(rows, media.listing(spark, root), root).collect()}
        assert {p: whole[p] for p in want if "é" not in p} == {p: found[p] for p in want if "é" not in p}


def test_only_folders_of_candidates_are_listed(spark, tmp_path):
    fill(tmp_path, NAMES)
    seen = media.entries(spark.createDataFrame([(f"{tmp_path}/videos/a",), (f"{tmp_path}/gone",), (f"{tmp_path}/pic.png",)], "path string")).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in seen) == ["1.mp4", "2.MP4", "3.mp4"] and not any(r["folder"] for r in seen)


def test_stores_that_only_spark_reads_are_listed_as_a_whole(spark, tmp_path, monkeypatch):
    fill(tmp_path, NAMES)
    monkeypatch.setattr(media, "_arrow_path", lambda path: None)
    found = media.locate_below(spark.createDataFrame([("videos/a/1.mp4",)], "video_path string"), str(tmp_path)).first()
    assert found["media_kind"] == "frames"


# --- servers -----------------------------------------------------------------------


class Canned(chat.Single):
    """Gives a prepared reply instead of asking a server; a class of its own, as executors import it."""

    def send(self, payload):
        sent.append((self.url, payload))
        return canned[0]


sent, canned = [], [None]


def ask(status, body, **options):
    canned[0] = (status, {}, body)
    return Canned("https://h.example/api/", "m", key=" s3cret ", **options).chat([{"role": "user", "content": "q"}])


def test_a_server_that_is_asked_once():
    sent.clear()
    assert ask(200, {"choices": [{"message": {"content": " yes "}}], "usage": {"completion_tokens": 3}}) == chat.Reply("yes", 3, pytest.approx(0, abs=1))
    assert sent[0][0] == "https://h.example/api/v1/chat/completions" and sent[0][1]["max_tokens"] == 512
    sent.clear()
    for status, body in ((503, "busy s3cret"), (401, "wrong key s3cret\nline " + "x" * 295 + "s3cret"), (200, {"choices": []}), (200, {"choices": [{"message": {"content": " "}}]}), (200, "no json")):
        with pytest.raises(chat.Failure) as e:
            ask(status, body)
        assert "s3" not in str(e.value) and "\n" not in str(e.value) and len(str(e.value)) <= 301 and not e.value.retry
    assert len(sent) == 5  # one try each
    assert "[redacted]" in str(pytest.raises(chat.Failure, ask, 401, "s3cret").value)


@pytest.mark.parametrize(
    ("url", "want"),
    [("http://h", "http://h/v1/chat/completions"), (" https://h/v1/ ", "https://h/v1/chat/completions"), ("HTTPS://h/x/chat/completions/", "HTTPS://h/x/chat/completions"), ("ftp://h", None), ("http://", None), ("", None)],
)
def test_urls_as_the_column_function_has_them(spark, url, want):
    from assayer.functions import text

    assert spark.createDataFrame([(url,)], "u string").select(text.chat_url_versioned("u")).first()[0] == want
    if want:
        assert chat.versioned(url) == want
    else:
        with pytest.raises(ValueError):
            chat.versioned(url)


@pytest.mark.parametrize("wrong", [{"url": " "}, {"model": ""}, {"max_tokens": 0}, {"temperature": -0.1}, {"timeout": 0}, {"retries": -1}, {"backoff": -1}, {"max_tokens": "7"}])
def test_ranges_of_a_server(wrong):
    with pytest.raises(ValueError):
        chat.Http(**({"url": "http://h", "model": "m"} | wrong))


def test_other_ranges(spark, tmp_path):
    df = inputs(spark, 2)
    for bad in ({"concurrency": 0}, {"rpm": -1}):
        with pytest.raises(ValueError):
            chat.map_rows(df, "video_path string, error string", timed, chat.Stub(), **bad)
    with pytest.raises(ValueError):
        resumable.run(df, answered("real"), str(tmp_path), SCHEMA, "video_path", resume.complete("single"), batch_rows=0)
    for bad in ((0, 0), (2, 2), (2, -1)):
        with pytest.raises(ValueError):
            resume.shard(df, *bad)
    with pytest.raises(ValueError):
        resume.shard(df, 2, 1, limit=-1)
    with pytest.raises(ValueError):
        chat.Single("http://h", "m")
    assert chat.extra_body('{"top_p": 0.5}') == {"top_p": 0.5}
    for bad in ("[1]", "{", "7"):
        with pytest.raises(ValueError):
            chat.extra_body(bad)
