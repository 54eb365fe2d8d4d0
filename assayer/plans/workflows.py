"""Whole workflows: consolidate annotators, grade rationales, prepare training rows, evaluate."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import binary_label, parse_score, sanitised, strip
from ..operators import align, assemble, checks, metrics
from ..schemas import ROLES
from ..sources import records, sinks
from .chat import Backend, map_rows

METADATA = ("split", "label", "dataset", "source")


def _aligned(manifest: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Manifest and sources row by row, with labels that agree: the manifest's pos, video_path and gold label."""
    z = align.strict_zip({"m": manifest, **{f"s{i}": s for i, s in enumerate(sources.values())}}, carry={"m": ["label"], **{f"s{i}": ["label"] for i in range(len(sources))}})
    rows = z.withColumn("gold", binary_label("m_label"))
    for i, name in enumerate(sources):
        other = f"s{i}_label"
        rows = checks.demand(rows, (strip(other) == "") | (F.when(strip(other) != "", binary_label(other)) == F.col("gold")), F.concat(F.lit(f"label of {name} differs at "), F.col("video_path")))
    return rows.select("pos", "video_path", "gold")


def _asked(rows: DataFrame, keep: str, system: str, backend: Backend, **options: Any) -> DataFrame:
    """Rows with a prompt, and the backend's sanitised text; any failure ends the job."""

    def ask(row: dict[str, Any], b: Backend) -> dict[str, Any]:
        reply = b.chat([{"role": "system", "content": system}, {"role": "user", "content": row["prompt"]}])
        return {"raw": reply.text, "completion_tokens": reply.completion_tokens, "elapsed_sec": reply.elapsed_sec}

    said = map_rows(rows, f"{keep}, raw string, completion_tokens bigint, elapsed_sec double, error string", ask, backend, fail_fast=True, **options)
    clean = said.withColumn("clean", sanitised("raw"))
    return checks.demand(clean, F.col("clean.problem").isNull(), F.concat(F.lit("unusable response: "), F.col("clean.problem"))).withColumn("text", F.col("clean.value")).drop("clean", "raw", "error")


def consolidate_observations(manifest: DataFrame, sources: dict[str, DataFrame], backend: Backend, **options: Any) -> DataFrame:
    """Each role's reports of all sources as one report a video: pos, video_path, observations, num_models_used, usage.

    Sources have pos, video_path, label and any spelling of the role columns.
    A video without any report of a role ends the job.
    """
    long = []
    for i, (name, s) in enumerate(sources.items()):
        has = set(s.columns)
        roles = assemble.coalesced_reports(F.col("observations") if "observations" in has else None, has)
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("text")) for r, c in roles.items()]))
        long.append(s.select("pos", F.lit(i).alias("i"), F.lit(name).alias("name"), each.alias("x")).select("pos", "i", "name", "x.role", "x.text").where("text <> ''"))
    gold = _aligned(manifest, sources)
    reports = F.transform(F.array_sort(F.collect_list(F.struct("i", "name", "text"))), lambda x: F.struct(x["name"].alias("name"), F.lit("").alias("answer"), x["text"].alias("text")))
    grouped = reduce(DataFrame.unionByName, long).groupBy("pos", "role").agg(reports.alias("reports"))
    wanted = gold.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLES]))).join(grouped, ["pos", "role"], "left")
    wanted = checks.demand(wanted, F.col("reports").isNotNull(), F.concat(F.lit("no reports of "), F.col("role"), F.lit(" for "), F.col("video_path")))
    prompt = reduce(lambda a, r: F.when(F.col("role") == r, assemble.observation_prompt(F.col("gold"), r, F.col("reports"))).otherwise(a), ROLES, F.lit(None).cast("string"))
    asked = wanted.select("pos", "video_path", "role", F.size("reports").alias("n"), prompt.alias("prompt"))
    said = _asked(asked, "pos bigint, video_path string, role string, n int", "You merge several reports on one aspect of a video into one.", backend, **options)
    return said.groupBy("pos", "video_path").agg(
        F.map_from_entries(F.collect_list(F.struct("role", "text"))).alias("observations"),
        F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("num_models_used"),
        F.collect_list(F.struct(F.col("role").alias("name"), "completion_tokens", "elapsed_sec")).alias("usage"),
    )


def consolidate_explanations(manifest: DataFrame, sources: dict[str, DataFrame], policy: str, backend: Backend, observations: DataFrame | None = None, **options: Any) -> DataFrame:
    """All sources' rationales as one a video: pos, video_path, aggregated_explanation, num_models_used, all_wrong, dropped, usage.

    ``observations`` has pos and the role columns; the ground-truth policy needs it.
    """
    if policy == "ground-truth" and observations is None:
        raise ValueError("this policy needs observations")
    long = []
    for i, (name, s) in enumerate(sources.items()):
        has = set(s.columns)
        answer = assemble.annotator_answer("response" if "response" in has else F.lit(""), "answer" if "answer" in has else F.lit(""))
        long.append(s.select("pos", F.lit(i).alias("i"), F.lit(name).alias("name"), answer.alias("answer"), assemble.rationale_of(has).alias("text")).where("text <> ''"))
    reports = F.transform(F.array_sort(F.collect_list(F.struct("i", "name", "answer", "text"))), lambda x: F.struct(x["name"].alias("name"), x["answer"].alias("answer"), x["text"].alias("text")))
    rows = _aligned(manifest, sources).join(reduce(DataFrame.unionByName, long).groupBy("pos").agg(reports.alias("reports")), "pos", "left")
    rows = checks.demand(rows, F.col("reports").isNotNull(), F.concat(F.lit("no rationales for "), F.col("video_path")))
    seen: dict[str, Column] | None = None
    if observations is not None:
        rows = rows.join(observations.select("pos", *ROLES), "pos", "left")
        seen = {r: F.col(r) for r in ROLES}
    plan = rows.select("pos", "video_path", assemble.explanation_plan(F.col("gold"), F.col("reports"), policy, seen).alias("p")).select("pos", "video_path", "p.*")
    keep = "pos bigint, video_path string, num_models_used int, all_wrong boolean, dropped boolean"
    said = _asked(plan.where("not dropped"), keep, "You merge several rationales on one video into one.", backend, **options)
    names = ["pos", "video_path", "text", "num_models_used", "all_wrong", "dropped"]
    spent = F.struct("completion_tokens", "elapsed_sec")
    none = plan.where("dropped").withColumn("text", F.lit(""))
    out = said.select(*names, spent.alias("usage")).unionByName(none.select(*names, F.lit(None).cast("struct<completion_tokens: bigint, elapsed_sec: double>").alias("usage")))
    return out.withColumnRenamed("text", "aggregated_explanation")


def grade(references: DataFrame, predictions: dict[str, DataFrame], mode: str, backend: Backend, done: DataFrame | None = None, **options: Any) -> DataFrame:
    """Every model's rationale on every reference graded: model, pos, video_path, mode, label, score, analysis, tokens, error.

    All tables have pos, video_path, label and rationale columns, predictions
    an answer as well. Every reference needs a prediction of every model, with
    the same label where both have one. ``done`` holds results that count: those
    with a score; they may not go beyond the work list nor be of another mode.
    A failed call or an unreadable reply gives a row with an error.
    """
    ref = references.select("pos", "video_path", "label", assemble.rationale_of(set(references.columns)).alias("reference"))
    each = []
    for name, p in predictions.items():
        has = set(p.columns)
        answer = assemble.scored_answer("answer" if "answer" in has else F.lit(""), "response" if "response" in has else F.lit(""))
        each.append(p.select("video_path", F.lit(name).alias("model"), F.col("label").alias("own_label"), answer.alias("answer"), assemble.rationale_of(has).alias("rationale")))
    names = references.sparkSession.createDataFrame([(n,) for n in predictions], "model string")
    work = align.tasks(names, ref)
    tasks = work.join(reduce(DataFrame.unionByName, each), ["model", "video_path"], "left")
    tasks = checks.demand(tasks, F.col("answer").isNotNull(), F.concat(F.lit("no prediction of "), F.col("model"), F.lit(" for "), F.col("video_path")))
    both = (strip("label") != "") & (strip("own_label") != "")
    tasks = checks.demand(tasks, F.when(both, binary_label("label") == binary_label("own_label")).otherwise(F.lit(True)), F.concat(F.lit("labels differ for "), F.col("video_path")))
    if done is not None:
        tasks = checks.demand_empty(tasks, done.where(F.col("mode") != mode), "results of another mode")
        tasks = checks.demand_empty(tasks, done.join(work, ["model", "video_path"], "left_anti"), "results beyond the work list")
        tasks = tasks.join(done.where("score is not null").select("model", "video_path"), ["model", "video_path"], "left_anti")
    gold = F.coalesce(strip(F.coalesce("label", "own_label")))
    blank = (F.col("reference") == "") | (F.col("rationale") == "")
    asked = assemble.quality_messages(mode, F.col("reference"), F.col("rationale"), binary_label(gold, strict=False), F.col("answer"))
    rows = tasks.select("model", "pos", "video_path", gold.alias("label"), F.when(~blank, asked[1]["content"]).alias("asked"))
    system = assemble.SYSTEM[mode]

    def ask(row: dict[str, Any], b: Backend) -> dict[str, Any]:
        if not row["asked"]:
            raise ValueError("a rationale is empty")
        reply = b.chat([{"role": "system", "content": system}, {"role": "user", "content": row["asked"]}])
        return {"judge_response": reply.text, "completion_tokens": reply.completion_tokens, "elapsed_sec": reply.elapsed_sec}

    schema = "model string, pos bigint, video_path string, label string, judge_response string, completion_tokens bigint, elapsed_sec double, error string"
    said = map_rows(rows, schema, ask, backend, **options).withColumn("parsed", parse_score("judge_response"))
    unread = F.when(F.col("error").isNull() & F.col("parsed").isNull(), F.lit("no ANALYSIS and SCORE lines"))
    return said.select(
        "model", "pos", "video_path", F.lit(mode).alias("mode"), "label", F.col("parsed.score").alias("score"),
        F.coalesce("parsed.analysis", F.lit("")).alias("analysis"), "judge_response", "completion_tokens", "elapsed_sec", F.coalesce("error", unread).alias("error"),
    )


def joined_reports(authority: DataFrame, reports: dict[str, DataFrame]) -> DataFrame:
    """An authority's rows with one report of each role: pos, video_path, gold, explanation and the roles; none may be blank."""
    if set(reports) != set(ROLES):
        raise ValueError(f"one table a role is needed: {ROLES}")
    out = _aligned(authority, reports).join(authority.select("pos", assemble.rationale_of(set(authority.columns)).alias("explanation")), "pos")
    for role, r in reports.items():
        has = set(r.columns)
        text = assemble.coalesced_reports(F.col("observations") if "observations" in has else None, has)[role]
        out = out.join(r.select("pos", text.alias(role)), "pos")
    return checks.demand_filled(out, *ROLES)


def training_rows(joined: DataFrame, kind: str, with_video: bool = False, role: str = "", frame_size: int = 256, frames: int = 16) -> DataFrame:
    """Rows for training: kind observer (needs a role), judge or reinforce; with frame_paths and video_file of the input if with_video."""
    seen = {r: F.col(r) for r in ROLES}
    if kind == "observer":
        messages = assemble.observer_row(role, F.col(role))
    elif kind in ("judge", "reinforce"):
        messages = assemble.judge_row(seen, "gold", F.col("explanation") if kind == "judge" else None, with_video)
    else:
        raise ValueError(f"unknown kind: {kind}")
    media = [F.col(c) for c in ("frame_paths", "video_file") if with_video or kind == "observer"]
    solution = [F.col("gold").alias("solution")] if kind == "reinforce" else []
    options = assemble.template(with_video or kind == "observer", frame_size)
    if media:
        options = options.withField("nframes", F.when(F.col("video_file").isNotNull(), F.lit(frames)))
    return joined.select("pos", "video_path", messages.alias("messages"), *media, *solution, options.alias("chat_template_kwargs"))


def evaluate(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """The evaluation report of a result file with unique keys; with ``out`` also written as a document."""
    rows = records.read_indexed(spark, path, "video_path string, label string, answer string, source string, dataset string")
    report = metrics.report(rows)
    if out:
        sinks.write_records(report, out, order=None)
    return report
