"""Queries over the shared tables by name, and SQL with the same rows.

Documents stand for records: their source and language are the record's
source and dataset, their labels its gold label and a model's answer. As texts
hold no tags and no verdicts, queries wrap them, in Spark and SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, rewards, text
from ..operators import align, assemble, checks, metrics, order, resume
from ..schemas import ROLES
from ..scratch import new_path
from ..shipping import ship
from ..sources import media as media_files
from ..sources import records as sources
from ..sources import sinks
from ..streaming import commits, resumable, shards
from . import chat, modes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What both sides share: plain SQL that Spark and DuckDB read alike.
KEY = "concat('videos/', d.source, '/', cast(d.doc_id as string), '.mp4')"
LABEL = (
    "CASE WHEN l.quality = 1 THEN 'real' WHEN l.quality = 0 THEN CASE d.doc_id % 4 WHEN 0 THEN 'fake' WHEN 1 THEN 'EFS' "
    "WHEN 2 THEN ' fs ' ELSE 'fr' END ELSE '' END"
)
ANSWER = "CASE WHEN l.toxic = 1 THEN ' FAKE ' WHEN l.toxic = 0 THEN CASE WHEN d.doc_id % 7 = 0 THEN 'Error' ELSE 'Real' END ELSE 'fake' END"
RESPONSE = (
    "CASE d.doc_id % 4 WHEN 0 THEN concat('<explanation>', chr(10), d.text, chr(10), '</explanation>', chr(10), '<answer> Real </answer> or fake') "
    "WHEN 1 THEN concat('<Observation> ', d.text, ' </observation> Fake') WHEN 2 THEN concat('it looks real, no, FAKE: ', d.text) ELSE d.text END"
)
FIELDS = f"d.doc_id AS pos, {KEY} AS video_path, d.source AS source, d.lang AS dataset, d.text AS text, d.n_chars AS n_chars, {LABEL} AS label, {ANSWER} AS answer, {RESPONSE} AS response"
RECORDS = f"SELECT {FIELDS} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
WITH_R = f"WITH r AS ({RECORDS})"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as records: pos, video_path, source, dataset, text, n_chars, label, answer, response."""
    d, l = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    fields = [F.expr(x) for x in _split(FIELDS)]
    return d.join(l, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(*fields)


def _split(fields: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(fields):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not quoted and not depth:
            out.append(fields[start:i].strip())
            start = i + 1
    return [*out, fields[start:].strip()]


def q_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def q_tag(x: str, tag: str) -> str:
    return q_strip(rf"regexp_extract({x}, '(?is)<{tag}>\s*(.*?)\s*</{tag}>', 1)")


def q_has(x: str, tag: str) -> str:
    return rf"regexp_matches({x}, '(?is)<{tag}>\s*(.*?)\s*</{tag}>')"


def q_answer(x: str, missing: str = "Error") -> str:
    return (
        rf"coalesce(lower(nullif(regexp_extract({x}, '(?i)<answer>\s*(real|fake)\s*</answer>', 1), '')), "
        rf"lower(regexp_extract_all({x}, '(?i)\b(real|fake)\b', 1)[-1]), '{missing}')"
    )


def q_binary(x: str) -> str:
    return f"CASE WHEN lower({q_strip(x)}) = 'real' THEN 'real' WHEN lower({q_strip(x)}) IN ('fake', 'efs', 'fs', 'fr') THEN 'fake' END"


def q_observation(x: str, plain: bool) -> str:
    inner = q_tag(x, "observation")
    if not plain:
        return inner
    return f"CASE WHEN {inner} <> '' THEN {inner} WHEN NOT starts_with(lower({q_strip(x)}), '<error>') THEN {q_strip(x)} ELSE '' END"


# --- evaluation -----------------------------------------------------------------

COUNTS = f"""
c AS (SELECT source, dataset, {q_binary("label")} AS gold, lower({q_strip("answer")}) AS said FROM r)"""
SUMS = """count(*) FILTER (WHERE gold = 'fake' AND said = 'fake') AS tp, count(*) FILTER (WHERE gold = 'fake' AND said <> 'fake') AS fn,
count(*) FILTER (WHERE gold = 'real' AND said <> 'real') AS fp, count(*) FILTER (WHERE gold = 'real' AND said = 'real') AS tn"""
RATES = """(tp + fn + fp + tn)::BIGINT AS total,
coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0), 0.0::DOUBLE)::DOUBLE AS balanced_accuracy,
coalesce(tp / nullif(tp + fn, 0), 0.0::DOUBLE)::DOUBLE AS fake_recall,
coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0.0::DOUBLE) * coalesce(tp / nullif(tp + fn, 0), 0.0::DOUBLE)
  / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0::DOUBLE) + coalesce(tp / nullif(tp + fn, 0), 0.0::DOUBLE), 0), 0.0::DOUBLE)::DOUBLE AS fake_f1"""


def q_group(field: str) -> str:
    return f"SELECT name, {RATES} FROM (SELECT {field} AS name, {SUMS} FROM c WHERE {q_strip(field)} <> '' GROUP BY {field})"


@query(
    f"{WITH_R}, {COUNTS} SELECT 'overall' AS grp, '' AS name, {RATES} FROM (SELECT {SUMS} FROM c) "
    f"UNION ALL SELECT 'by_source', * FROM ({q_group('source')}) UNION ALL SELECT 'by_dataset', * FROM ({q_group('dataset')})"
)
def eval_report(spark, sf_dir):
    return metrics.report(records(spark, sf_dir))


@query(f"{WITH_R}, {COUNTS} SELECT {RATES} FROM (SELECT {SUMS} FROM c)")
def metrics_overall(spark, sf_dir):
    return metrics.metrics(records(spark, sf_dir))


@query(f"{WITH_R}, {COUNTS} {q_group('source')}")
def metrics_by_source(spark, sf_dir):
    return metrics.grouped(records(spark, sf_dir), "source")


@query(f"{WITH_R}, {COUNTS} {q_group('dataset')}")
def metrics_by_dataset(spark, sf_dir):
    return metrics.grouped(records(spark, sf_dir), "dataset")


@query(f"{WITH_R}, {COUNTS} SELECT {SUMS} FROM c")
def confusion_counts(spark, sf_dir):
    return records(spark, sf_dir).agg(*[c.alias(n) for n, c in metrics.confusion().items()])


SCORE = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value, 2) END"


@query(
    f"""SELECT model, count(score) AS "count", count(*) FILTER (WHERE score IS NULL) AS errors, round(avg(score), 6) AS mean, median(score) AS median,
round(stddev_pop(score), 6) AS stdev, min(score) AS min, max(score) AS max FROM (SELECT event_type AS model, {SCORE} AS score FROM events) GROUP BY model"""
)
def quality_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.expr(SCORE).alias("score"))
    out = metrics.score_summary(scores)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


@query(f"{WITH_R} SELECT pos, {q_binary('label')} AS gold FROM r")
def label_binary(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("pos", F.when(text.strip("label") != "", text.binary_label("label")).alias("gold"))


@query(f"{WITH_R} SELECT pos, label, answer FROM r WHERE {q_strip('label')} <> '' AND answer <> 'Error' AND {q_binary('label')} <> {q_binary('answer')}")
def label_mismatch_check(spark, sf_dir):
    rows = records(spark, sf_dir).where((text.strip("label") != "") & (F.col("answer") != "Error"))
    return checks.label_mismatches(rows, "label", "answer").select("pos", "label", "answer")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return metrics.status_counts(table(spark, sf_dir, "events"), "event_type")


@query(f"{WITH_R} SELECT count(*) FILTER (WHERE {q_tag('response', 'observation')} <> '') AS valid, count(*) AS total FROM r")
def valid_count(spark, sf_dir):
    return metrics.valid_count(records(spark, sf_dir), text.parse_observation("response") != "")


# --- text -----------------------------------------------------------------------


@query(f"{WITH_R} SELECT pos, {q_answer('response')} AS answer FROM r")
def parse_answer(spark, sf_dir):
    return records(spark, sf_dir).select("pos", text.parse_answer("response").alias("answer"))


@query(f"{WITH_R} SELECT pos, {q_answer('response', '')} AS prediction FROM r")
def parse_prediction(spark, sf_dir):
    return records(spark, sf_dir).select("pos", text.parse_answer("response", "").alias("prediction"))


@query(f"{WITH_R} SELECT pos, {q_observation('response', False)} AS strict, {q_observation('response', True)} AS plain FROM r")
def parse_observation(spark, sf_dir):
    return records(spark, sf_dir).select(
        "pos", text.parse_observation("response").alias("strict"), text.parse_observation("response", allow_plain=True).alias("plain")
    )


@query(f"{WITH_R} SELECT pos, {q_tag('response', 'explanation')} AS explanation FROM r")
def tag_extract(spark, sf_dir):
    return records(spark, sf_dir).select("pos", text.tagged("response", "explanation").alias("explanation"))


@query(
    f"{WITH_R} SELECT pos, {q_answer('response')} AS answer, {q_tag('response', 'explanation')} AS explanation, "
    f"CASE WHEN {q_answer('response')} = 'Error' THEN 'no real/fake answer' WHEN {q_tag('response', 'explanation')} = '' THEN 'no explanation' END AS problem FROM r"
)
def parse_final(spark, sf_dir):
    return records(spark, sf_dir).select("pos", text.parse_final("response").alias("f"), text.final_problem("response").alias("problem")).select("pos", "f.*", "problem")


JUDGED = "concat('ANALYSIS: ', d.text, chr(10), ' score : ', cast(d.doc_id % 13 as string), CASE WHEN d.doc_id % 5 = 0 THEN '.5' ELSE '' END)"


@query(
    rf"""SELECT doc_id, CASE WHEN s <> '' AND a <> '' THEN s::INTEGER END AS score, CASE WHEN s <> '' AND a <> '' THEN a END AS analysis FROM (
SELECT doc_id, regexp_extract(t, '(?im)^\s*SCORE\s*:\s*(10|[1-9])\s*$', 1) AS s, {q_strip("regexp_extract(t, '(?ims)^[[:space:]]*ANALYSIS[[:space:]]*:[[:space:]]*(.+?)^[[:space:]]*SCORE[[:space:]]*:', 1)")} AS a
FROM (SELECT d.doc_id, {JUDGED} AS t FROM documents d))"""
)
def parse_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d").select("doc_id", F.expr(JUDGED).alias("t"))
    return d.select("doc_id", text.parse_score("t").alias("s")).select("doc_id", "s.score", "s.analysis")


@query(
    f"""{WITH_R}, o AS (SELECT pos, response, CASE WHEN {q_observation('response', True)} <> '' THEN {q_observation('response', True)} ELSE {q_strip('response')} END AS v FROM r),
e AS (SELECT pos, response, CASE WHEN {q_has('v', 'explanation')} THEN {q_tag('v', 'explanation')} ELSE v END AS value FROM o)
SELECT pos, value, CASE WHEN {q_strip('response')} = '' THEN 'empty' WHEN regexp_matches(value, '(?i)</?answer\\b') THEN 'answer tag' WHEN value = '' THEN 'empty' END AS problem FROM e"""
)
def sanitize_plain(spark, sf_dir):
    return records(spark, sf_dir).select("pos", text.sanitised("response").alias("s")).select("pos", "s.*")


PARTS = (
    "CASE WHEN d.doc_id % 3 = 0 THEN concat('<explanation> ', d.lang, ' </explanation>') WHEN d.doc_id % 3 = 1 THEN ' ' END AS aggregated_explanation, "
    "CASE WHEN d.doc_id % 5 = 0 THEN concat(' ', d.source) END AS explanation"
)


def q_rationale(response: str) -> str:
    one = "CASE WHEN {h} THEN {t} ELSE {s} END"
    a, b = (one.format(h=q_has(f, "explanation"), t=q_tag(f, "explanation"), s=q_strip(f)) for f in ("coalesce(aggregated_explanation, '')", "coalesce(explanation, '')"))
    return (
        f"CASE WHEN {q_strip('coalesce(aggregated_explanation, ' + chr(39) * 2 + ')')} <> '' THEN {a} "
        f"WHEN {q_strip('coalesce(explanation, ' + chr(39) * 2 + ')')} <> '' THEN {b} ELSE {q_tag(response, 'explanation')} END"
    )


@query(f"SELECT doc_id, {q_rationale('response')} AS rationale FROM (SELECT d.doc_id, {PARTS}, {RESPONSE} AS response FROM documents d)")
def extract_rationale(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d")
    rows = d.select("d.doc_id", *[F.expr(x) for x in _split(PARTS)], F.expr(RESPONSE).alias("response"))
    return rows.select("doc_id", assemble.rationale_of(set(rows.columns)).alias("rationale"))


@query(
    "SELECT doc_id, CASE WHEN length(t) <= 6000 THEN t ELSE regexp_replace(substr(t, 1, 6000), '\\s+$', '') || chr(10) || '[…report truncated for Judge context…]' END AS clipped "
    f"FROM (SELECT doc_id, {q_strip('text')} AS t FROM documents)"
)
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clip("text").alias("clipped"))


@query(
    f"""{WITH_R}, p AS (SELECT pos, response, {q_tag('response', 'explanation')} AS e, upper(regexp_extract(response, '(?i)<answer>\\s*(real|fake)\\s*</answer>', 1)) AS a,
{q_has('response', 'explanation')} AS he FROM r)
SELECT pos, CASE WHEN he OR a <> '' THEN concat_ws(chr(10) || chr(10), nullif(e, ''), CASE WHEN a <> '' THEN '**Verdict: ' || a || '**' END) ELSE {q_strip('response')} END AS shown FROM p"""
)
def judge_render(spark, sf_dir):
    return records(spark, sf_dir).select("pos", text.render_final("response").alias("shown"))


@query(f"{WITH_R} SELECT pos, CASE WHEN {q_has('response', 'observation')} THEN {q_tag('response', 'observation')} ELSE {q_strip('response')} END AS report FROM r")
def observer_unwrap(spark, sf_dir):
    return records(spark, sf_dir).select("pos", text.unwrap("response", "observation").alias("report"))


# --- joins ----------------------------------------------------------------------

SPELLED = ", ".join(f"CASE WHEN d.doc_id % 4 = {i} THEN concat('<observation> {r} ', d.source, '</observation>') ELSE '' END AS {r}" for i, r in enumerate(ROLES))
SPELLED += ", " + ", ".join(f"CASE WHEN d.doc_id % 3 <> {i % 3} THEN concat('{r} of ', d.lang) ELSE '<ERROR> {r}' END AS {r}_response" for i, r in enumerate(ROLES))
SPELLED += ", " + ", ".join(f"concat(' {r} report ') AS {r}_report" for r in ROLES)


def q_spelled(role: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({q_observation(c, True)}, '')" for c in (role, f"{role}_response", f"{role}_report")) + ", '')"


@query(f"SELECT doc_id, {', '.join(f'{q_spelled(r)} AS {r}' for r in ROLES)} FROM (SELECT d.doc_id, {SPELLED} FROM documents d)")
def observations_coalesce(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", *[F.expr(x) for x in _split(SPELLED)])
    return rows.select("doc_id", *[c.alias(r) for r, c in assemble.coalesced_reports(None, set(rows.columns)).items()])


def _reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An authority and one report table a role, aligned by position."""
    r = records(spark, sf_dir).select("pos", "video_path", "label", "text")
    return {"gold": r, **{role: r.select("pos", "video_path", F.concat(F.lit(f"{role}: "), F.col("text")).alias("report")) for role in ROLES}}


@query(f"{WITH_R} SELECT pos, video_path, label AS gold_label, {', '.join(f'''sha256(concat('{r}: ', text)) AS {r}_report''' for r in ROLES)} FROM r")
def zip_join(spark, sf_dir):
    z = align.strict_zip(_reports(spark, sf_dir), carry={"gold": ["label"], **{r: ["report"] for r in ROLES}})
    return z.withColumns({f"{r}_report": F.sha2(f"{r}_report", 256) for r in ROLES})


@query(
    f"""{WITH_R}, n AS (SELECT max(pos) AS last FROM r)
SELECT pos, CASE WHEN pos = last THEN 'length' WHEN pos % 50 = 3 THEN 'blank' WHEN pos % 50 = 7 THEN 'key' END AS problem FROM r, n
WHERE pos = last OR pos % 50 IN (3, 7)"""
)
def zip_mismatch(spark, sf_dir):
    r = records(spark, sf_dir).select("pos", "video_path")
    last = r.agg(F.max("pos").alias("last"))
    bent = F.when(F.col("pos") % 50 == 3, F.lit(" ")).when(F.col("pos") % 50 == 7, F.lit("videos/other.mp4")).otherwise(F.col("video_path"))
    other = r.withColumn("video_path", bent).join(F.broadcast(last)).where("pos < last").drop("last")
    return align.zip_problems({"a": r, "b": other})


@query(
    f"""{WITH_R} SELECT pos, video_path, {q_binary('label')} AS label, {', '.join(f'''sha256({q_strip(f"concat('{r}: ', text)")}) AS {r}''' for r in ROLES)}
FROM r WHERE {q_strip('label')} <> ''"""
)
def joined_reports(spark, sf_dir):
    z = align.strict_zip(_reports(spark, sf_dir), carry={"gold": ["label"], **{r: ["report"] for r in ROLES}})
    labelled = z.where(text.strip("gold_label") != "")
    return labelled.select(
        "pos",
        "video_path",
        text.binary_label("gold_label").alias("label"),
        *[F.sha2(text.required(text.parse_observation(f"{r}_report", allow_plain=True), f"{r} report"), 256).alias(r) for r in ROLES],
    )


EVENT_LOG = "SELECT cast(user_id as string) AS k, event_id AS seq, event_type AS answer, value FROM events"


@query(f"SELECT k, seq, answer, value FROM ({EVENT_LOG}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1")
def upsert_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) AS k", "event_id AS seq", "event_type AS answer", "value")
    return resume.last_wins(rows, ["k"], "seq")


@query(
    "SELECT k, seq, value, shard FROM (SELECT cast(user_id as string) AS k, event_id AS seq, value, (event_id % 4)::INTEGER AS shard FROM events) "
    "QUALIFY row_number() OVER (PARTITION BY k ORDER BY shard, seq) = 1"
)
def merge_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) AS k", "event_id AS seq", "value", "cast(event_id % 4 as int) AS shard")
    return resume.first_wins(rows, ["k"], "shard", "seq")


@query(f"{WITH_R} SELECT pos, video_path FROM r WHERE pos % 3 = 1")
def shard_filter(spark, sf_dir):
    return resume.shard(records(spark, sf_dir).select("pos", "video_path"), 3, 1)


@query(f"{WITH_R} SELECT pos, video_path FROM r WHERE pos % 3 = 1 AND floor(pos / 3) < 20")
def limit_after_shard(spark, sf_dir):
    return resume.shard(records(spark, sf_dir).select("pos", "video_path"), 3, 1, limit=20)


@query(f"{WITH_R} SELECT pos, video_path, answer FROM r")
def shard_merge(spark, sf_dir):
    r = records(spark, sf_dir).select("pos", "video_path", "answer")
    parts = [resume.shard(r, 4, i) for i in range(4)]
    return resume.merge_shards(parts, r.select("pos", "video_path"), "video_path").select("pos", "video_path", "answer")


@query(f"{WITH_R} SELECT pos, printf('shards/%s.shard%05d-of-%05d%s', source, pos % 8, 8, '.jsonl') AS name FROM r")
def shard_name(spark, sf_dir):
    return records(spark, sf_dir).select("pos", resume.shard_name(F.col("source"), F.col("pos") % 8, 8).alias("name"))


@query(f"{WITH_R}, done AS (SELECT video_path FROM r WHERE lower(answer) IN ('real', 'fake')) SELECT pos, video_path FROM r ANTI JOIN done USING (video_path)")
def resume_pending(spark, sf_dir):
    r = records(spark, sf_dir)
    return resume.pending(r.select("pos", "video_path"), r.select("video_path", "answer"), "video_path", resume.complete("single"))


@query(f"{WITH_R}, n AS (SELECT (count(*) // 3) AS k FROM r) SELECT pos, video_path FROM r, n WHERE pos >= k")
def resume_prefix(spark, sf_dir):
    r = records(spark, sf_dir).select("pos", "video_path")
    n = r.agg(F.expr("count(*) div 3").alias("k"))
    done = r.join(F.broadcast(n)).where("pos < k").drop("k")
    return align.pending_after_prefix(r, done)


@query(
    f"""{WITH_R}, log AS (SELECT video_path, answer, 0 AS part, pos FROM r UNION ALL SELECT video_path, CASE WHEN pos % 2 = 0 THEN 'fake' ELSE 'Error' END, 1, pos FROM r WHERE answer = 'Error'),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY video_path ORDER BY part DESC, pos DESC) = 1)
SELECT r.pos, r.video_path FROM r JOIN last USING (video_path) WHERE lower(last.answer) NOT IN ('real', 'fake')"""
)
def retry_errors(spark, sf_dir):
    r = records(spark, sf_dir).select("pos", "video_path", "answer")
    retried = r.where("answer = 'Error'").withColumn("answer", F.when(F.col("pos") % 2 == 0, F.lit("fake")).otherwise(F.lit("Error")))
    logs = resume.merge_logs(r, retried, "video_path")
    return resume.pending(r.select("pos", "video_path"), logs, "video_path", resume.complete("single"))


@query(f"{WITH_R}, m AS (SELECT DISTINCT event_type AS model FROM events) SELECT model, video_path FROM m, r")
def cross_tasks(spark, sf_dir):
    models = table(spark, sf_dir, "events").select(F.col("event_type").alias("model")).distinct()
    return align.tasks(models, records(spark, sf_dir).select("video_path"))


@query(f"{WITH_R}, s AS (SELECT doc_id AS k, row_number() OVER (ORDER BY doc_id DESC) - 1 AS sample_pos FROM labels) SELECT sample_pos, pos, video_path FROM s JOIN r ON r.pos = s.k")
def sample_semi(spark, sf_dir):
    r = records(spark, sf_dir).select("pos", "video_path")
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"))
    sample = sources.ranked(l, -F.col("pos"), "at").join(r, "pos").select(F.col("at").alias("pos"), "video_path")
    return align.select_sample(r, sample, "video_path").select(F.col("sample_pos").cast("long").alias("sample_pos"), "pos", "video_path")


@query("SELECT d.doc_id AS pos, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def lookup_reorder(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "doc_id")
    return align.in_order(keys, table(spark, sf_dir, "labels"), "doc_id").select("pos", "quality", "toxic")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def foreign_results(spark, sf_dir):
    return resume.foreign(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "events"), "user_id")


@query(f"{WITH_R} SELECT pos, (pos // 16)::BIGINT AS batch FROM r")
def batch_ids(spark, sf_dir):
    return records(spark, sf_dir).select("pos", resume.batches(16).alias("batch"))


# --- prompts, conversations, training rows --------------------------------------

ANNOTATED = (
    "SELECT r.pos, r.label, m.i, m.name, CASE (r.pos + m.i) % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'fake' ELSE '' END AS answer, "
    "concat(m.name, ' saw ', r.text) AS said FROM r CROSS JOIN m WHERE trim(r.label) <> ''"
)
MODELS = "(VALUES (0, 'alpha'), (1, 'beta'), (2, 'gamma'))"


def _annotated(spark: SparkSession, sf_dir: str, kept: Column) -> DataFrame:
    """(pos, gold, reports): each labelled record with its annotators' (name, answer, text), in their order."""
    m = spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "gamma")], "i int, name string")
    r = records(spark, sf_dir).where(F.trim("label") != "").select("pos", "label", "text")
    said = r.join(F.broadcast(m)).select(
        "pos", text.binary_label("label").alias("gold"), "i", "name",
        F.when((F.col("pos") + F.col("i")) % 3 == 0, F.lit("real")).when((F.col("pos") + F.col("i")) % 3 == 1, F.lit("fake")).otherwise(F.lit("")).alias("answer"),
        F.concat("name", F.lit(" saw "), F.col("text")).alias("text"),
    )
    rows = F.array_sort(F.collect_list(F.struct("i", "name", "answer", "text")))
    return said.where(kept).groupBy("pos", "gold").agg(F.transform(rows, lambda x: F.struct(x["name"].alias("name"), x["answer"].alias("answer"), x["text"].alias("text"))).alias("reports"))


def q_lit(s: str) -> str:
    """A text as SQL, line breaks as chr(10)."""
    return "concat(" + ", chr(10), ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n")) + ", '')"


def q_blocks(title: str, named: bool, answer: bool, blank: str = "") -> str:
    name = "' (', name, ')', " if named else ""
    said = f"'Predicted answer: ', coalesce(nullif(answer, ''), '{blank}'), chr(10), " if answer else ""
    return f"concat('--- {title} ', cast(k as string), {name}' ---', chr(10), {said}said)"


def q_policy(policy: str) -> str:
    seen = "concat(" + ", ".join(f"{'chr(10), ' if i else ''}'{r.capitalize()}: ', '{r} of ', cast(w.pos as string)" for i, r in enumerate(ROLES)) + ")"
    wrong = {
        "drop": ("0", "NULL", None),
        "blind": ("n", f"concat({q_lit('Combine the visual evidence of these rationales.')}, chr(10), chr(10), every)", q_blocks("Rationale", False, False)),
        "ground-truth": (
            "n",
            f"concat('Ground-truth verdict: ', gold, '.', chr(10), chr(10), 'Every rationale below missed it. Explain it from the observations.', chr(10), chr(10), "
            f"'Consolidated observations:', chr(10), {seen}, chr(10), chr(10), every)",
            q_blocks("Initial rationale", True, True, "unparseable"),
        ),
    }[policy]
    every = f"string_agg({wrong[2]}, chr(10) || chr(10) ORDER BY i)" if wrong[2] else "NULL"
    return f"""{WITH_R}, m AS (SELECT * FROM {MODELS} AS t(i, name)), a AS (SELECT *, {q_binary('label')} AS gold FROM ({ANNOTATED})),
w AS (SELECT pos, gold, {every} AS every, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS k FROM a) GROUP BY pos, gold),
g AS (SELECT pos, string_agg({q_blocks('Rationale', True, True)}, chr(10) || chr(10) ORDER BY i) AS own, count(*) AS n_right
  FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS k FROM a WHERE answer = gold) GROUP BY pos)
SELECT w.pos, (CASE WHEN n_right IS NULL THEN {wrong[0]} ELSE n_right END)::INTEGER AS num_models_used, n_right IS NULL AS all_wrong,
  {'n_right IS NULL' if policy == 'drop' else 'false'} AS dropped,
  sha256(CASE WHEN n_right IS NULL THEN {wrong[1]} ELSE concat('Ground-truth verdict: ', gold, '.', chr(10), chr(10), 'Merge the rationales below, which all reached this verdict.', chr(10), chr(10), own) END) AS prompt
FROM w LEFT JOIN g ON w.pos = g.pos"""


def _policy(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    rows = _annotated(spark, sf_dir, F.lit(True))
    seen = {r: F.concat(F.lit(f"{r} of "), F.col("pos").cast("string")) for r in ROLES}
    return rows.select("pos", assemble.explanation_plan(F.col("gold"), F.col("reports"), policy, seen).alias("p")).select("pos", "p.*").withColumn("prompt", F.sha2("prompt", 256))


@query(q_policy("drop"))
def explanation_policy_drop(spark, sf_dir):
    return _policy(spark, sf_dir, "drop")


@query(q_policy("blind"))
def explanation_policy_blind(spark, sf_dir):
    return _policy(spark, sf_dir, "blind")


@query(q_policy("ground-truth"))
def explanation_policy_ground_truth(spark, sf_dir):
    return _policy(spark, sf_dir, "ground-truth")


@query(
    f"""{WITH_R}, m AS (SELECT * FROM {MODELS} AS t(i, name)), a AS (SELECT *, {q_binary('label')} AS gold FROM ({ANNOTATED})),
k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS k FROM a WHERE answer <> '')
SELECT pos, sha256(concat('This video is ', gold, '.', chr(10), 'Below are ', cast(count(*) as string), ' reports on its texture.', chr(10), chr(10),
  string_agg({q_blocks('Model', True, False)}, chr(10) || chr(10) ORDER BY i))) AS prompt, count(*)::INTEGER AS num_models_used FROM k GROUP BY pos, gold"""
)
def agg_prompt(spark, sf_dir):
    rows = _annotated(spark, sf_dir, F.col("answer") != "")
    prompt = assemble.observation_prompt(F.col("gold"), "texture", F.col("reports"))
    return rows.select("pos", F.sha2(prompt, 256).alias("prompt"), F.size("reports").alias("num_models_used"))


def _role_texts(clipped: bool = False) -> dict[str, Column]:
    return {r: F.concat(F.lit(f"{r}: "), F.col("text")) for r in ROLES}


def q_judge_input(clipped: bool) -> str:
    def one(r: str) -> str:
        t = f"concat('{r}: ', text)"
        if not clipped:
            return t
        s = q_strip(t)
        return f"CASE WHEN length({s}) <= 6000 THEN {s} ELSE regexp_replace(substr({s}, 1, 6000), '\\s+$', '') || chr(10) || '[…report truncated for Judge context…]' END"

    blocks = ", ".join(f"'{h}', chr(10), {one(r)}, chr(10), chr(10)" for r, h in assemble.REPORT_HEADS.items())
    return f"concat({blocks}, {q_lit(assemble.JUDGE_CLOSING)})"


@query(f"SELECT doc_id, sha256({q_judge_input(False)}) AS prompt, sha256({q_judge_input(True)}) AS clipped FROM documents")
def judge_prompt(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(assemble.judge_input(_role_texts()), 256).alias("prompt"), F.sha2(assemble.judge_input(_role_texts(), clipped=True), 256).alias("clipped"))


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("messages").alias("i", "m")).select(*keys, F.col("i").cast("int").alias("i"), "m.role", "m.content")


def q_messages(source: str, key: str, turns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {i} AS i, '{role}' AS role, {content} AS content FROM {source}" for i, (role, content) in enumerate(turns))


FULL_USER = (
    f"concat('Grade the rationale below.', chr(10), chr(10), 'Ground-truth answer:', chr(10), {q_binary('label')}, chr(10), chr(10), 'Reference rationale:', chr(10), dataset, "
    f"chr(10), chr(10), 'Model answer:', chr(10), coalesce(nullif({q_answer('answer', '')}, ''), {q_answer('response')}), chr(10), chr(10), 'Model rationale:', chr(10), {q_strip('text')})"
)


@query(
    f"{WITH_R}, g AS (SELECT * FROM r WHERE {q_strip('label')} <> '') "
    + q_messages("g", "pos", [("system", q_lit(assemble.SYSTEM["full"])), ("user", FULL_USER)])
)
def quality_messages_full(spark, sf_dir):
    r = records(spark, sf_dir).where(text.strip("label") != "")
    m = assemble.quality_messages("full", F.col("dataset"), text.required("text", "rationale"), text.binary_label("label"), assemble.scored_answer("answer", "response"))
    return _exploded(r.select("pos", m.alias("messages")), "pos")


@query(
    WITH_R
    + q_messages(
        "r", "pos",
        [("system", q_lit(assemble.SYSTEM["noanswer"])), ("user", f"concat('Compare the candidate rationale with the reference.', chr(10), chr(10), 'Reference rationale:', chr(10), dataset, chr(10), chr(10), 'Candidate rationale:', chr(10), {q_strip('text')})")],
    )
)
def quality_messages_noanswer(spark, sf_dir):
    r = records(spark, sf_dir)
    m = assemble.quality_messages("noanswer", F.col("dataset"), text.required("text", "rationale"))
    return _exploded(r.select("pos", m.alias("messages")), "pos")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS i, role, text AS content FROM conversations")
def multiturn_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return _exploded(assemble.conversation(c, "conv_id", "turn"), "conv_id")


OBSERVER_TURNS = [
    ("system", q_lit(assemble.SYSTEM["motion"])),
    ("user", q_lit("<video>\n" + assemble.QUERY["motion"])),
    ("assistant", f"concat('<observation>', chr(10), {q_strip('text')}, chr(10), '</observation>')"),
]


@query(f"{WITH_R} " + q_messages("r", "pos", OBSERVER_TURNS))
def sft_rows(spark, sf_dir):
    r = records(spark, sf_dir)
    return _exploded(r.select("pos", assemble.observer_row("motion", F.col("text")).alias("messages")), "pos")


JUDGE_TURNS = [("system", q_lit(assemble.SYSTEM["judge_text"])), ("user", f"sha256({q_judge_input(False)})")]


def _hashed_user(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", F.when(F.col("role") == "user", F.sha2("content", 256)).otherwise(F.col("content")))


@query(
    f"{WITH_R}, g AS (SELECT * FROM r WHERE {q_strip('label')} <> '') "
    + q_messages("g", "pos", [*JUDGE_TURNS, ("assistant", f"concat('<explanation>', chr(10), {q_strip('text')}, chr(10), '</explanation>', chr(10), '<answer>', {q_binary('label')}, '</answer>')")])
)
def judge_sft_rows(spark, sf_dir):
    r = records(spark, sf_dir).where(text.strip("label") != "")
    return _hashed_user(_exploded(r.select("pos", assemble.judge_row(_role_texts(), "label", F.col("text")).alias("messages")), "pos"))


@query(
    f"{WITH_R}, g AS (SELECT * FROM r WHERE {q_strip('label')} <> ''), t AS ({q_messages('g', 'pos', JUDGE_TURNS)}) "
    f"SELECT t.pos, t.i, t.role, t.content, {q_binary('label')} AS solution, false AS enable_thinking FROM t JOIN g ON t.pos = g.pos"
)
def grpo_rows(spark, sf_dir):
    r = records(spark, sf_dir).where(text.strip("label") != "")
    rows = r.select("pos", assemble.judge_row(_role_texts(), "label", None).alias("messages"), text.binary_label("label").alias("solution"), assemble.template()["enable_thinking"].alias("enable_thinking"))
    return _hashed_user(_exploded(rows, "pos", "solution", "enable_thinking"))


@query(
    f"""{WITH_R} SELECT pos, video_path, 'cot' AS mode, lower({q_strip('answer')}) AS answer, {q_tag('response', 'explanation')} AS explanation,
CASE WHEN pos % 2 = 0 THEN response ELSE text END AS response, (n_chars + 7)::BIGINT AS completion_tokens, CASE WHEN pos % 2 = 1 THEN text END AS texture_response, nullif(CASE WHEN answer = 'Error' THEN 'failed' ELSE '' END, '') AS error FROM r"""
)
def result_record(spark, sf_dir):
    r = records(spark, sf_dir)
    call = F.struct(F.lit("a").alias("name"), F.col("n_chars").cast("bigint").alias("completion_tokens"), F.lit(0.5).alias("elapsed_sec"))
    more = F.struct(F.lit("b").alias("name"), F.lit(7).cast("bigint").alias("completion_tokens"), F.lit(0.25).alias("elapsed_sec"))
    rows = r.select(
        "pos", "video_path", F.lower(text.strip("answer")).alias("answer"), text.tagged("response", "explanation").alias("explanation"),
        F.create_map(F.lit("motion"), F.col("text")).alias("observations"),
        F.when(F.col("pos") % 2 == 0, F.create_map(F.lit("judge"), F.col("response"), F.lit("texture"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("texture"), F.col("text"))).alias("responses"),
        F.array(call, more).alias("calls"), F.lit(0.7504).alias("wall_sec"), F.when(F.col("answer") == "Error", F.lit("failed")).otherwise(F.lit("")).alias("error"),
    )
    out = assemble.result_record(rows.withColumn("answer", F.lower("answer")), ["pos", "video_path"], "cot")
    return out.select("pos", "video_path", "mode", "answer", "explanation", "response", "completion_tokens", "texture_response", "error")


@query("SELECT user_id, sum(event_id % 100)::BIGINT AS completion_tokens, count(*) AS calls FROM events GROUP BY user_id")
def usage_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    call = F.struct(F.lit("a").alias("name"), (F.col("event_id") % 100).alias("completion_tokens"), F.lit(0.5).alias("elapsed_sec"))
    spent = e.select("user_id", assemble.usage(F.array(call), F.lit(0.5)).alias("u"))
    return spent.groupBy("user_id").agg(F.sum("u.completion_tokens").alias("completion_tokens"), F.sum(F.size("u.calls")).alias("calls"))


# --- rewards --------------------------------------------------------------------

COMPLETION = (
    "CASE d.doc_id % 3 WHEN 0 THEN concat('<explanation>', d.text, '</explanation><answer>real</answer>') "
    "WHEN 1 THEN concat('<explanation>', d.source, ' ', d.lang, ' ', d.lang, '</explanation> <ANSWER>fake</ANSWER><answer>real</answer>') ELSE d.text END"
)
WITH_C = f"WITH c AS (SELECT d.doc_id, {COMPLETION} AS c, CASE d.doc_id % 2 WHEN 0 THEN 'real' ELSE 'efs' END AS s FROM documents d)"


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d")
    return d.select("d.doc_id", F.expr(COMPLETION).alias("c"), F.expr("CASE d.doc_id % 2 WHEN 0 THEN 'real' ELSE 'efs' END").alias("s"))


Q_ACCURACY = f"CASE WHEN {q_answer('c', '')} = {q_binary('s')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
Q_WORDS = f"len(regexp_extract_all({q_tag('c', 'explanation')}, '[A-Za-z0-9]+'))"
Q_LENGTH = f"CASE WHEN {Q_WORDS} < 8 THEN {Q_WORDS} / 8.0::DOUBLE WHEN {Q_WORDS} <= 140 THEN 1.0::DOUBLE WHEN {Q_WORDS} >= 200 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - ({Q_WORDS} - 140) / 60.0::DOUBLE END"
Q_FORMAT = (
    f"(({q_tag('c', 'explanation')} <> '')::INTEGER + regexp_matches(c, '(?i)<answer>\\s*(real|fake)\\s*</answer>')::INTEGER "
    "+ (len(regexp_extract_all(c, '(?i)<answer>')) = 1)::INTEGER) / 3.0::DOUBLE"
)


@query(f"{WITH_C} SELECT doc_id, {Q_ACCURACY} AS reward FROM c")
def reward_accuracy(spark, sf_dir):
    return _completions(spark, sf_dir).select("doc_id", rewards.accuracy("c", "s").alias("reward"))


@query(f"{WITH_C} SELECT doc_id, {Q_LENGTH} AS reward FROM c")
def reward_length(spark, sf_dir):
    return _completions(spark, sf_dir).select("doc_id", rewards.length("c").alias("reward"))


@query(f"{WITH_C} SELECT doc_id, {Q_FORMAT} AS reward FROM c")
def reward_format(spark, sf_dir):
    return _completions(spark, sf_dir).select("doc_id", rewards.format("c").alias("reward"))


@query(f"{WITH_C} SELECT doc_id, round({Q_ACCURACY} * 1.0::DOUBLE + {Q_LENGTH} * 0.1::DOUBLE + {Q_FORMAT} * 0.1::DOUBLE, 9) AS reward FROM c")
def reward_mix(spark, sf_dir):
    return _completions(spark, sf_dir).select("doc_id", F.round(rewards.mix("c", "s"), 9).alias("reward"))


# --- frames, paths, names -------------------------------------------------------

FRAMES = "(n_chars % 400 + 1)"


@query(
    f"""WITH f AS (SELECT doc_id, {FRAMES}::INTEGER AS n FROM documents),
x AS (SELECT doc_id, CASE WHEN n <= 16 THEN range(n) ELSE list_transform(range(16), lambda i: round_even(i * (n - 1) / 15.0::DOUBLE, 0)::BIGINT) END AS ix FROM f)
SELECT doc_id, unnest(range(len(ix)))::INTEGER AS k, unnest(ix)::INTEGER AS frame FROM x"""
)
def uniform_indices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(FRAMES).alias("n"))
    return d.select("doc_id", F.posexplode(media.uniform_indices("n", 16)).alias("k", "frame"))


@query(
    f"""WITH f AS (SELECT doc_id, {FRAMES}::INTEGER AS n FROM documents),
x AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN least(12, n) = 1 THEN [0::BIGINT] ELSE list_transform(range(least(12, n)), lambda i: round_even(i * (n - 1) / (least(12, n) - 1)::DOUBLE, 0)::BIGINT) END)) AS ix FROM f)
SELECT doc_id, unnest(range(len(ix)))::INTEGER AS k, unnest(ix)::INTEGER AS frame FROM x"""
)
def uniform_indices_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(FRAMES).alias("n"))
    return d.select("doc_id", F.posexplode(media.uniform_indices_distinct("n", 12)).alias("k", "frame"))


@query(
    """WITH f AS (SELECT doc_id, (n_chars % 9 + 1)::INTEGER AS n FROM documents),
x AS (SELECT doc_id, CASE WHEN n % 2 = 1 THEN list_append(range(n), n - 1) ELSE range(n) END AS a FROM f)
SELECT doc_id, unnest(range(len(a)))::INTEGER AS k, unnest(a)::INTEGER AS frame FROM x"""
)
def even_frames(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("sequence(0, cast(n_chars % 9 as int))").alias("a"))
    return d.select("doc_id", F.posexplode(media.even_frames(F.col("a"))).alias("k", "frame"))


@query(
    """WITH f AS (SELECT source, doc_id, CASE doc_id % 2 WHEN 0 THEN 'f' ELSE 'F' END || (doc_id % 1000) || '.png' AS name FROM documents)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id % 1000, doc_id) - 1)::INTEGER AS k, doc_id % 1000 AS frame FROM f"""
)
def natural_sort(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("f")).otherwise(F.lit("F")), (F.col("doc_id") % 1000).cast("string"), F.lit(".png"))
    keyed = d.select("source", name.alias("name"), media.natural_key(name).alias("key"))
    out = order.ranks(keyed, ["key", "name"], ("source",), "k")
    return out.select("source", F.col("k").cast("int").alias("k"), F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("frame"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND n_chars > 0 THEN n_chars / (doc_id % 5)::DOUBLE ELSE 0.0::DOUBLE END AS seconds FROM documents")
def duration(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", media.duration_seconds("n_chars", (F.col("doc_id") % 5).cast("double")).alias("seconds"))


PATH = "CASE d.doc_id % 3 WHEN 0 THEN concat('videos/', d.source, '/', cast(d.doc_id as string), '.mp4') WHEN 1 THEN concat('/data/', d.source, '/v', cast(d.doc_id as string), '.MOV') ELSE concat(d.source, '.txt') END"


@query(
    f"""SELECT doc_id, CASE WHEN starts_with(p, '/') AND regexp_matches(p, '(?i)\\.(mp4|avi|mov|mkv|webm)$') THEN 'frames/' || regexp_extract(p, '([^/]*)\\.[^./]*$', 1)
WHEN starts_with(p, 'videos/') THEN 'frames/' || substr(p, 8) END AS frames, regexp_matches(p, '(?i)\\.(mp4|avi|mov|mkv|webm)$') AS is_video FROM (SELECT d.doc_id, {PATH} AS p FROM documents d)"""
)
def frames_path(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", F.expr(PATH).alias("p"))
    return d.select("doc_id", media.frames_dir("p").alias("frames"), media.is_video("p").alias("is_video"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'model') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query(
    """WITH u AS (SELECT page_id, url, regexp_replace(url, '/+$', '') AS raw FROM pages),
p AS (SELECT *, regexp_replace(regexp_extract(raw, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM u)
SELECT page_id, CASE WHEN ends_with(raw, '/chat/completions') THEN raw ELSE raw || '/chat/completions' END AS plain,
CASE WHEN regexp_matches(raw, '^(?i)https?://[^/?#]+') THEN CASE WHEN ends_with(path, '/chat/completions') THEN raw WHEN ends_with(path, '/v1') THEN raw || '/chat/completions' ELSE raw || '/v1/chat/completions' END END AS versioned FROM p"""
)
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.chat_url("url").alias("plain"), text.chat_url_versioned("url").alias("versioned"))


NAME = "concat('org/', d.source, CASE d.doc_id % 4 WHEN 0 THEN '-VL-32B' WHEN 1 THEN '-7b-instruct' WHEN 2 THEN '-3B' ELSE '' END)"


@query(
    f"SELECT doc_id, CASE WHEN contains(n, '32b') THEN '32b' WHEN contains(n, '7b') THEN '7b' WHEN contains(n, '3b') THEN '3b' END AS size FROM (SELECT d.doc_id, lower(regexp_extract({NAME}, '([^/]*)/*$', 1)) AS n FROM documents d)"
)
def model_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", F.expr(NAME).alias("n"))
    return d.select("doc_id", text.model_size("n").alias("size"))


FLAG = "CASE d.doc_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'on' WHEN 2 THEN '0' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'no' ELSE '' END"


@query(f"SELECT doc_id, lower({q_strip('f')}) IN ('1', 'true', 'yes', 'on', 'y') AS flag FROM (SELECT d.doc_id, {FLAG} AS f FROM documents d)")
def bool_norm(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", F.expr(FLAG).alias("f"))
    return d.select("doc_id", text.truthy("f").alias("flag"))


METHOD = "CASE d.doc_id % 5 WHEN 0 THEN 'training free' WHEN 1 THEN ' +sft' WHEN 2 THEN '+SFT+GRPO' WHEN 3 THEN 'Training-Free' ELSE 'other' END"


@query(
    f"""WITH m AS (SELECT d.doc_id, replace(upper({q_strip('x')}), ' ', '_') AS n FROM (SELECT doc_id, {METHOD} AS x FROM documents d) d),
k AS (SELECT doc_id, CASE WHEN n IN ('TRAINING_FREE', 'TRAINING-FREE') THEN 'TRAINING_FREE' WHEN n IN ('+SFT', 'SFT') THEN 'SFT' WHEN n IN ('+SFT+GRPO', 'GRPO') THEN 'GRPO' END AS method FROM m)
SELECT doc_id, method, CASE WHEN method = 'TRAINING_FREE' THEN 'base_model' WHEN method IS NOT NULL THEN 'judge_' || lower(method) || CASE WHEN doc_id % 2 = 0 THEN '_video' ELSE '_text' END END AS adapter FROM k"""
)
def training_method(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", F.expr(METHOD).alias("x"))
    return d.select("doc_id", text.training_method("x").alias("method"), text.judge_adapter("x", F.col("doc_id") % 2 == 0).alias("adapter"))


@query("SELECT doc_id, len(list_filter(string_split(source || ', ,' || lang || ',', ','), lambda x: trim(x) <> ''))::INTEGER AS devices FROM documents")
def device_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.device_count(F.concat("source", F.lit(", ,"), "lang", F.lit(","))).alias("devices"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, 'th', '[redacted]') END AS safe FROM documents")
def redact(spark, sf_dir):
    secret = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("th"))
    return table(spark, sf_dir, "documents").select("doc_id", text.redact("text", secret).alias("safe"))


@query("SELECT event_id, greatest((event_id % 40)::DOUBLE, least(30.0::DOUBLE, 2.0::DOUBLE * pow(2.0::DOUBLE, event_id % 6))) AS delay FROM events")
def retry_delay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", resume.retry_delay((F.col("event_id") % 6).cast("double"), (F.col("event_id") % 40).cast("double")).alias("delay"))


@query("SELECT doc_id, coalesce(TRY_CAST(source[4:] AS INTEGER), -1) AS number, coalesce(TRY_CAST(lang AS DOUBLE), 0.5::DOUBLE) AS share FROM documents")
def env_scalars(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 100).alias("number"), "lang")
    return d.select("doc_id", text.int_or("number", -1).alias("number"), text.float_or("lang", 0.5).alias("share"))


MODE = "CASE d.doc_id % 6 WHEN 0 THEN 'single' WHEN 1 THEN 'cot' WHEN 2 THEN 'multiturn' WHEN 3 THEN 'observer' WHEN 4 THEN 'judge' ELSE 'flagship' END"


@query(
    f"""SELECT doc_id, CASE WHEN mode = 'observer' THEN doc_id % 4 <> 3 ELSE mode IN ('flagship', 'multiturn') END AS observers, mode <> 'observer' AS judge,
mode <> 'judge' OR doc_id % 2 = 0 AS media FROM (SELECT d.doc_id, {MODE} AS mode FROM documents d)"""
)
def mode_needs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", F.expr(MODE).alias("mode"))
    role = F.when(F.col("doc_id") % 4 == 3, F.lit("gaze")).otherwise(F.lit("motion"))
    media_too = modes.needs_media(F.col("mode"), F.col("doc_id") % 2 == 0)
    return d.select("doc_id", text.required_adapters("mode", role).alias("a"), media_too.alias("media")).select("doc_id", "a.*", "media")


@query(
    f"""WITH p AS (SELECT d.doc_id, {PATH} AS p FROM documents d),
c AS (SELECT doc_id, CASE WHEN starts_with(p, '/') THEN [p] WHEN starts_with(p, 'videos/') THEN ['/r/frames/' || substr(p, 8), '/r/' || p, '/r/' || p, '/r/frames/' || p]
  ELSE ['/r/' || p, '/r/frames/' || p] END AS paths FROM p)
SELECT doc_id, unnest(range(len(paths)))::INTEGER AS rank, unnest(paths) AS path FROM c"""
)
def media_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", F.expr(PATH).alias("p"))
    return d.select("doc_id", F.posexplode(media.media_candidates("p", "/r")).alias("rank", "path"))


@query(
    """SELECT doc_id, 0 AS i, 'text' AS type, '[frame 1/2]' AS text, NULL::VARCHAR AS url FROM documents
UNION ALL SELECT doc_id, 1, 'image_url', NULL, 'data:image/jpeg;base64,' || to_base64(encode(source)) FROM documents
UNION ALL SELECT doc_id, 2, 'text', '[frame 2/2]', NULL FROM documents
UNION ALL SELECT doc_id, 3, 'image_url', NULL, 'data:image/jpeg;base64,' || to_base64(encode(lang)) FROM documents
UNION ALL SELECT doc_id, 4, 'text', 'look at ' || source, NULL FROM documents"""
)
def frame_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    uris = F.array(media.data_uri(F.col("source").cast("binary")), media.data_uri(F.col("lang").cast("binary")))
    parts = media.content_with_frames(F.concat(F.lit("look at "), F.col("source")), media.frame_blocks(uris))
    return d.select("doc_id", F.posexplode(parts).alias("i", "p")).select("doc_id", "i", "p.type", "p.text", F.col("p.image_url.url").alias("url"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'why' ELSE lang || chr(10) || source END AS content FROM documents")
def content_parts(spark, sf_dir):
    part = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    none = F.array().cast("array<struct<type: string, text: string>>")
    parts = F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.array(part("lang"), part("source")))
    return table(spark, sf_dir, "documents").select("doc_id", text.content_text(parts, F.lit("why")).alias("content"))


@query(
    f"""{WITH_R}, m AS (SELECT * FROM {MODELS} AS t(i, name)), a AS (SELECT *, {q_binary('label')} AS gold FROM ({ANNOTATED}))
SELECT pos, gold, count(*) FILTER (WHERE answer <> '')::INTEGER AS n_answers, bool_or(answer = gold) AS any_right, NOT bool_or(answer = gold) AS all_wrong FROM a GROUP BY pos, gold"""
)
def annotator_flags(spark, sf_dir):
    rows = _annotated(spark, sf_dir, F.lit(True))
    right = F.exists("reports", lambda x: x["answer"] == F.col("gold"))
    return rows.select("pos", "gold", F.size(F.filter("reports", lambda x: x["answer"] != "")).alias("n_answers"), right.alias("any_right"), (~right).alias("all_wrong"))


@query("SELECT doc_id, len(a)::INTEGER AS n, a[1] AS lead FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [source] END AS a FROM documents)")
def forwarded_args(spark, sf_dir):
    args = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("--"), "lang", "source")).otherwise(F.array("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.forwarded(args).alias("a")).select("doc_id", F.size("a").alias("n"), F.get("a", F.lit(0)).alias("lead"))


@query(f"{WITH_R} SELECT pos, video_path, label, answer FROM r")
def json_roundtrip(spark, sf_dir):
    """Records written as one JSONL file and read again, in order."""
    path = f"{new_path(spark)}/records.jsonl"
    sinks.write_records(records(spark, sf_dir).select("pos", "video_path", "label", "answer"), path)
    return sources.read_records(spark, path, "video_path string, label string, answer string")


@query(f"{WITH_R}, n AS (SELECT max(pos) AS last FROM r) SELECT pos, video_path FROM r, n WHERE pos < last")
def jsonl_repair(spark, sf_dir):
    """A log whose last line is cut off, without that line."""
    path = f"{new_path(spark)}/log.jsonl"
    r = records(spark, sf_dir).select("pos", F.to_json(F.struct("video_path")).alias("value"))
    last = r.agg(F.max("pos").alias("last"))
    torn = F.when(F.col("pos") == F.col("last"), F.substring("value", 1, 9)).otherwise(F.col("value"))
    lines = r.join(F.broadcast(last)).select("pos", torn.alias("value")).orderBy("pos").select("value")
    lines.coalesce(1).write.text(path)
    return sources.repair_truncated(spark, path, "video_path string")


@query(f"{WITH_R} SELECT pos, video_path, label, answer FROM r")
def json_array_roundtrip(spark, sf_dir):
    """Records written as one JSON array and scanned again, in order."""
    path = f"{new_path(spark)}/records.json"
    sinks.write_records(records(spark, sf_dir).select("pos", "video_path", "label", "answer"), path)
    return sources.read_records(spark, path, "video_path string, label string, answer string")


@query(
    f"""WITH p AS (SELECT d.doc_id, {PATH} AS p, d.doc_id % 4 AS kind FROM documents d)
SELECT doc_id, CASE WHEN kind = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'a folder without frames' END
  WHEN NOT regexp_matches(p, '(?i)\\.(mp4|avi|mov|mkv|webm|png|jpe?g|webp|bmp)$') THEN '.txt is none of ' || '{", ".join(media.SUFFIXES)}' END AS problem FROM p"""
)
def single_media(spark, sf_dir):
    """What is wrong with a path as the one medium of a run: folders need frames, files a known suffix."""
    d = table(spark, sf_dir, "documents").alias("d").select("d.doc_id", F.expr(PATH).alias("p"))
    frames = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 8 == 0, F.lit(0)).otherwise(F.lit(3)))
    return d.select("doc_id", media.single_problem("p", frames).alias("problem"))


@query(
    """WITH d AS (SELECT doc_id, source, doc_id % 4 AS n FROM documents), t AS (
SELECT doc_id, 'video' AS turn, source, CASE WHEN n > 0 THEN ['video', 'text'] ELSE ['text'] END AS kinds FROM d
UNION ALL SELECT doc_id, 'image', source, list_transform(range(n), lambda x: 'image') || ['text'] FROM d UNION ALL SELECT doc_id, 'text', source, ['text'] FROM d)
SELECT doc_id, turn, CASE WHEN turn = 'text' THEN 'assistant' ELSE 'user' END AS role, array_to_string(kinds, ' ') AS kinds, source AS text FROM t"""
)
def local_turns(spark, sf_dir):
    """A local model's turns with a video, with images, and of text, by how many frames there are."""
    d = table(spark, sf_dir, "documents")
    frames = F.slice(F.array(*[F.lit(f"f{i}") for i in range(3)]), 1, (F.col("doc_id") % 4).cast("int"))
    turns = {"video": assemble.video_turn(F.col("source"), frames), "image": assemble.image_turn(F.col("source"), frames), "text": assemble.local_turn("assistant", F.col("source"))}
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("turn"), t.alias("t")) for n, t in turns.items()])).alias("x")
    rows = d.select("doc_id", named).select("doc_id", "x.turn", "x.t.role", "x.t.content")
    kinds = F.array_join(F.transform("content", lambda p: p["type"]), " ")
    return rows.select("doc_id", "turn", "role", kinds.alias("kinds"), F.element_at("content", -1)["text"].alias("text"))


@query("SELECT user_id, 'checkpoint-' || max(event_id) AS latest FROM events GROUP BY user_id")
def latest_checkpoint(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string")).alias("name"))
    return e.groupBy("user_id").agg(media.latest_version("name").alias("latest"))


@query(f"{WITH_R}, n AS (SELECT count(*) AS total FROM r) SELECT pos + 1 AS done, total FROM r, n WHERE (pos + 1) % 100 = 0 OR pos + 1 = total")
def progress_marks(spark, sf_dir):
    return metrics.milestones(records(spark, sf_dir).select("pos"), 100)


@query(f"{WITH_R} SELECT pos, video_path, answer FROM r")
def shard_completion(spark, sf_dir):
    """Three shards that finish out of turn; the last one merges them."""
    r = records(spark, sf_dir).select("pos", "video_path", "answer")
    output = f"{new_path(spark)}/results.json"
    for i in (2, 0, 1):
        merged = shards.finish(resume.shard(r, 3, i), output, 3, i, r, "video_path", "video_path string, answer string")
    return merged


@query(
    f"""WITH l AS (SELECT event_id, event_type, user_id, {SCORE} AS score, max(event_id) OVER () AS last FROM events),
w AS (SELECT event_type, user_id, (row_number() OVER (ORDER BY event_type, user_id) - 1)::BIGINT AS pos FROM (SELECT DISTINCT event_type, user_id FROM events))
SELECT w.pos, w.event_type, w.user_id, b.score FROM w JOIN (SELECT event_type, user_id, arg_max(struct_pack(s := score), event_id).s AS score FROM l WHERE event_id < last GROUP BY ALL) b
ON w.event_type = b.event_type AND w.user_id = b.user_id"""
)
def score_log(spark, sf_dir):
    """A log of scores with repeated keys and a torn end, compacted into the wanted order and read again."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.expr(SCORE).alias("score"))
    path = f"{new_path(spark)}/scores.jsonl"
    last = e.agg(F.max("event_id").alias("last"))
    line = F.to_json(F.struct("event_type", "user_id", "score"), {"ignoreNullFields": "false"})
    torn = F.when(F.col("event_id") == F.col("last"), F.substring(line, 1, 20)).otherwise(line)
    e.join(F.broadcast(last)).select("event_id", torn.alias("value")).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    keys = ["event_type", "user_id"]
    scores = sources.repair_truncated(spark, path, "event_type string, user_id bigint, score double")
    wanted = order.ranks(e.select(*keys).distinct(), keys, name="pos")
    log = commits.CommitLog(spark, new_path(spark))
    log.append(resume.last_wins(scores, keys, "pos").drop("pos"))
    log.compact("event_type string, user_id bigint, score double", keys, wanted)
    return log.read("event_type string, user_id bigint, score double").drop("log_seq").join(wanted, keys)


GRADES = "video_path string, answer string"


@query(f"{WITH_R} SELECT pos, video_path, CASE WHEN pos % 3 = 1 THEN 'fake' ELSE 'real' END AS answer FROM r")
def resumable_map(spark, sf_dir):
    """A map in batches whose first run fails for every third record, and a second run that finds those pending."""
    r = records(spark, sf_dir).select("pos", "video_path")
    log, done = new_path(spark), resume.complete("single")
    size = max(1, r.count() // 4)
    first = lambda b: b.select("video_path", F.when(F.col("pos") % 3 == 1, F.lit("Error")).otherwise(F.lit("real")).alias("answer"))
    resumable.run(r, first, log, GRADES, "video_path", done, size)
    return resumable.run(r, lambda b: b.select("video_path", F.lit("fake").alias("answer")), log, GRADES, "video_path", done, size)


CLIP = "concat('videos/', cast(s_nationkey as string), '/', cast(s_suppkey as string), '.mp4')"


@query(
    f"""WITH s AS (SELECT s_suppkey, {CLIP} AS p, s_suppkey % 5 AS kind FROM supplier)
SELECT s_suppkey, CASE kind WHEN 0 THEN 'frames/' || substr(p, 8) WHEN 1 THEN p WHEN 2 THEN p WHEN 3 THEN 'frames/' || p END AS media,
CASE WHEN kind IN (0, 3) THEN 'frames' WHEN kind IN (1, 2) THEN 'video' END AS kind FROM s"""
)
def media_located(spark, sf_dir):
    """Each clip's frames or file: the best of its candidates that exists below a folder that the query fills."""
    root = new_path(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(CLIP).alias("video_path"), (F.col("s_suppkey") % 5).alias("kind"))
    inside = F.concat(F.lit("frames/"), F.substring("video_path", 8, 1 << 30))
    frames = lambda folder: F.transform(F.array(F.lit("f1.png"), F.lit("f2.PNG"), F.lit("notes.txt")), lambda n: F.concat(folder, F.lit("/"), n))
    paths = (
        F.when(F.col("kind") == 0, F.concat(frames(inside), F.array("video_path")))
        .when(F.col("kind") == 1, F.array("video_path"))
        .when(F.col("kind") == 2, F.array(F.concat(inside, F.lit("/notes.txt")), F.col("video_path")))
        .when(F.col("kind") == 3, frames(F.concat(F.lit("frames/"), F.col("video_path"))))
        .otherwise(F.array())
    )
    media_files.touch(s.select(F.explode(paths).alias("path")), root)
    found = media_files.locate_below(s.select("s_suppkey", "video_path"), root)
    return found.select("s_suppkey", F.substring("media_path", len(root) + 2, 1 << 30).alias("media"), F.col("media_kind").alias("kind"))


# --- calls ----------------------------------------------------------------------


def q_digest(x: str) -> str:
    """The number that the stub's replies follow from."""
    return f"('0x' || substr(sha256({x}), 1, 8))::BIGINT"


GRADED = "concat('Compare the candidate rationale with the reference.', chr(10), chr(10), 'Reference rationale:', chr(10), dataset, chr(10), chr(10), 'Candidate rationale:', chr(10), text)"


@query(
    f"{WITH_R}, n AS (SELECT pos, {q_digest(GRADED)} AS n FROM r) "
    "SELECT pos, (n % 10 + 1)::INTEGER AS score, 'grounded in ' || n % 83 || ' points' AS analysis, 7::BIGINT AS completion_tokens, NULL::VARCHAR AS error FROM n"
)
def chat_map_stub(spark, sf_dir):
    """Every record graded by the deterministic stub backend."""
    r = records(spark, sf_dir).select("pos", assemble.quality_messages("noanswer", F.col("dataset"), F.col("text"))[1]["content"].alias("asked"))

    def grade(row, backend):
        reply = backend.chat([{"role": "user", "content": row["asked"]}])
        return {"response": reply.text, "completion_tokens": reply.completion_tokens}

    out = chat.map_rows(r, "pos bigint, response string, completion_tokens bigint, error string", grade, chat.Stub())
    return out.select("pos", text.parse_score("response").alias("s"), "completion_tokens", "error").select("pos", "s.score", "s.analysis", "completion_tokens", "error")


def _modes(spark: SparkSession, sf_dir: str, mode: str, fails: int = 0) -> DataFrame:
    """A mode over all records by the stub, with each record's text as its one frame."""
    uris = F.array(media.data_uri(F.col("text").cast("binary"), "text/plain"))
    r = records(spark, sf_dir).select("pos", "video_path", "label", uris.alias("frames"))
    out = modes.infer(r, chat.Stub(fails), mode, "pos bigint, video_path string, label string")
    seen = [F.try_element_at("observations", F.lit(role)).alias(role) for role in ROLES]
    return out.select("pos", "video_path", "answer", "explanation", F.size("calls").alias("n_calls"), *seen, "error")


def q_framed(prompt: str) -> str:
    return f"concat('[frame 1/1]', chr(10), 'data:text/plain;base64,', to_base64(encode(text)), chr(10), {q_lit(prompt)})"


def q_failure(n: str) -> str:
    return f"'Failure: no reply to ' || {n} % 1000"


Q_VERDICT = "CASE WHEN j % 2 = 1 THEN 'fake' ELSE 'real' END AS answer, 'seen ' || j % 97 || ' signs in all of the given reports' AS explanation"


def q_flagship(fails: int) -> str:
    """Four observers and a judge: what each says, and where a record fails, if ``fails`` isn't 0."""
    observers = ", ".join(f"{q_digest(q_framed(assemble.QUERY[r]))} AS n_{r}" for r in ROLES)
    signs = ", ".join(f"'sign ' || n_{r} % 89 AS {r}" for r in ROLES)
    reports = "concat(" + ", ".join(f"{q_lit(h)}, chr(10), {r}, chr(10), chr(10)" for r, h in assemble.REPORT_HEADS.items()) + f", {q_lit(assemble.JUDGE_CLOSING)})"
    early = "CASE " + " ".join(f"WHEN n_{r} % {fails} = 0 THEN {q_failure(f'n_{r}')}" for r in ROLES) + " END" if fails else "NULL::VARCHAR"
    late = f"CASE WHEN early IS NULL AND j % {fails} = 0 THEN {q_failure('j')} END" if fails else "NULL::VARCHAR"
    return f"""{WITH_R}, o AS (SELECT pos, video_path, {observers} FROM r), s AS (SELECT *, {signs}, {early} AS early FROM o),
j AS (SELECT *, {q_digest(reports)} AS j FROM s), v AS (SELECT *, {late} AS late, {Q_VERDICT} FROM j)
SELECT pos, video_path, CASE WHEN early IS NULL AND late IS NULL THEN answer ELSE 'Error' END AS answer, CASE WHEN early IS NULL AND late IS NULL THEN explanation ELSE '' END AS explanation,
(CASE WHEN early IS NOT NULL THEN 0 WHEN late IS NOT NULL THEN 4 ELSE 5 END)::INTEGER AS n_calls, {', '.join(f'CASE WHEN early IS NULL THEN {r} END AS {r}' for r in ROLES)}, coalesce(early, late) AS error FROM v"""


@query(q_flagship(0))
def mode_flagship_stub(spark, sf_dir):
    """Four observers and a judge a record, by the stub backend."""
    return _modes(spark, sf_dir, "flagship")


@query(q_flagship(9))
def mode_flagship_failing(spark, sf_dir):
    """The same with a backend that refuses every ninth call or so: failed rows keep what they had got by then."""
    return _modes(spark, sf_dir, "flagship", fails=9)


def q_one_call(mode: str, failed: str, seen: list[str]) -> str:
    """A mode of one call: its verdict, and the observations in its response."""
    return (
        f"{WITH_R}, n AS (SELECT pos, video_path, {q_digest(q_framed(assemble.QUERY[mode]))} AS j FROM r), v AS (SELECT *, {Q_VERDICT}, {failed} AS error FROM n) "
        "SELECT pos, video_path, CASE WHEN error IS NULL THEN answer ELSE 'Error' END AS answer, CASE WHEN error IS NULL THEN explanation ELSE '' END AS explanation, "
        f"CASE WHEN error IS NULL THEN 1 ELSE 0 END AS n_calls, {', '.join(f'{x} AS {r}' for r, x in zip(ROLES, seen, strict=True))}, error FROM v"
    )


@query(q_one_call("cot", "NULL::VARCHAR", [f"'sign ' || j % {71 + i}" for i in range(len(ROLES))]))
def mode_cot_stub(spark, sf_dir):
    """One response a record that holds all four observations and the verdict."""
    return _modes(spark, sf_dir, "cot")


@query(q_one_call("single", f"CASE WHEN j % 4 = 0 THEN {q_failure('j')} END", ["NULL::VARCHAR"] * len(ROLES)))
def mode_single_failing(spark, sf_dir):
    """A verdict a record, from a backend that refuses every fourth call or so."""
    return _modes(spark, sf_dir, "single", fails=4)
