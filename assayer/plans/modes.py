"""Inference modes as plans of calls per record."""

from __future__ import annotations

import re
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANSWER_TAG, VERDICT
from ..operators.assemble import JUDGE_CLOSING, QUERY, REPORT_HEADS, SYSTEM
from ..schemas import ROLES
from .chat import Backend, Partial, Reply, map_rows
from .slots import serve

MODES = ("single", "cot", "multiturn", "observer", "judge", "flagship")
CALLS = "array<struct<name: string, completion_tokens: bigint, elapsed_sec: double>>"
OUTPUT = (
    "answer string, explanation string, observations map<string, string>, responses map<string, string>, "
    f"calls {CALLS}, wall_sec double, error string"
)

# The tags and words that responses are read by, as in functions.text.
_TAG = {t: re.compile(rf"<{t}>\s*(.*?)\s*</{t}>", re.I | re.S) for t in ("observation", "explanation", *ROLES)}
_ANSWER = re.compile(ANSWER_TAG, re.S)
_WORD = re.compile(VERDICT)


def needs_media(mode, judge_video):
    """Whether a mode looks at frames: all do but a judge that reads reports only. For values and columns alike."""
    return (mode != "judge") | judge_video


def inside(text: str, tag: str) -> str:
    m = _TAG[tag].search(text or "")
    return m[1].strip() if m else ""


def plain(text: str | None) -> str:
    """A report's text: of its tag, else all of it unless it tells of an error."""
    whole = (text or "").strip()
    return inside(whole, "observation") or ("" if whole.lower().startswith("<error>") else whole)


def verdict(text: str) -> tuple[str, str]:
    """Answer and explanation of a final response; incomplete ones fail."""
    strict = _ANSWER.search(text or "")
    words = _WORD.findall(text or "")
    answer = strict[1].lower() if strict else words[-1].lower() if words else ""
    why = inside(text, "explanation")
    if not answer or not why:
        raise ValueError("a final response needs a real/fake answer and an explanation")
    return answer, why


class _Calls:
    """One record's calls, with what each took and what has come of them so far."""

    def __init__(self, backend: Backend):
        self.backend, self.stats, self.responses, self.seen = backend, [], {}, {}

    def keep(self, name: str, reply: Reply, key: str) -> str:
        self.stats.append({"name": name, "completion_tokens": reply.completion_tokens, "elapsed_sec": reply.elapsed_sec})
        self.responses[key] = reply.text
        return reply.text

    def ask(self, name: str, messages: list[dict[str, Any]], key: str | None = None) -> str:
        return self.keep(name, self.backend.chat(messages), key or name)

    def observe(self, name: str, messages: list[dict[str, Any]]) -> None:
        self.note(name, self.ask(name, messages))

    def note(self, name: str, text: str) -> None:
        self.seen[name] = inside(text, "observation")
        if not self.seen[name]:
            raise ValueError(f"the {name} response has no observation")


def _pair(system: str, user: str | list[dict[str, Any]]) -> list[dict[str, Any]]:
    return [{"role": "system", "content": SYSTEM[system]}, {"role": "user", "content": user}]


def _frames(row: dict[str, Any]) -> list[dict[str, Any]]:
    """The parts of a record's ``frames`` (URIs): a numbered caption and an image each. A record of a table with frames needs some."""
    if "frames" not in row:
        return []
    uris = row["frames"]
    if uris is None or not len(uris):
        raise ValueError("no frames")
    parts: list[dict[str, Any]] = []
    for i, uri in enumerate(uris):
        parts += [{"type": "text", "text": f"[frame {i + 1}/{len(uris)}]"}, {"type": "image_url", "image_url": {"url": uri, "detail": "auto"}}]
    return parts


def _shown(frames: list[dict[str, Any]], text: str) -> str | list[dict[str, Any]]:
    return [*frames, {"type": "text", "text": text}] if frames else text


def _reports(observations: dict[str, str]) -> str:
    missing = [r for r in ROLES if not (observations.get(r) or "").strip()]
    if missing:
        raise ValueError(f"missing observations: {', '.join(missing)}")
    return "".join(f"{head}\n{observations[r]}\n\n" for r, head in REPORT_HEADS.items()) + JUDGE_CLOSING


def _given(row: dict[str, Any]) -> dict[str, str]:
    """A record's observations, each by the first of its spellings that cleans to something."""
    nested = dict(row.get("observations") or {})
    spelled = {r: (nested.get(r), row.get(r), row.get(f"{r}_response"), row.get(f"{r}_report")) for r in ROLES}
    return {r: next((t for t in map(plain, values) if t), "") for r, values in spelled.items()}


def process(row: dict[str, Any], backend: Backend, mode: str, role: str = "", judge_video: bool = False) -> dict[str, Any]:
    """All calls of a mode for one record.

    A failure carries what was done by then: the answer is Error (empty for
    observers), with the observations, responses and calls so far.
    """
    began, calls = time.perf_counter(), _Calls(backend)

    def results(answer: str, why: str) -> dict[str, Any]:
        return {
            "answer": answer, "explanation": why, "observations": calls.seen, "responses": calls.responses, "calls": calls.stats,
            "wall_sec": time.perf_counter() - began,
        }

    try:
        return results(*_run(row, calls, mode, role, judge_video))
    except Exception as e:  # noqa: BLE001
        raise Partial(f"{type(e).__name__}: {e}", results("" if mode == "observer" else "Error", "")) from e


def _run(row: dict[str, Any], calls: _Calls, mode: str, role: str, judge_video: bool) -> tuple[str, str]:
    judge = "judge_video" if judge_video else "judge_text"
    frames = _frames(row) if needs_media(mode, judge_video) else []
    if mode == "single":
        return verdict(calls.ask("single", _pair("single", _shown(frames, QUERY["single"])), "final"))
    if mode == "cot":
        text = calls.ask("cot", _pair("cot", _shown(frames, QUERY["cot"])), "final")
        calls.seen.update({r: inside(text, r) for r in ROLES})
        missing = [r for r, v in calls.seen.items() if not v]
        if missing:
            raise ValueError(f"the response lacks tags: {', '.join(missing)}")
        return verdict(text)
    if mode == "observer":
        calls.observe(role, _pair(role, _shown(frames, QUERY[role])))
        return "", ""
    if mode == "judge":
        calls.seen.update(_given(row))
    elif mode == "multiturn":
        talk = [{"role": "system", "content": SYSTEM["multiturn"]}]
        for i, r in enumerate(ROLES):
            talk.append({"role": "user", "content": _shown(frames, QUERY[r]) if i == 0 else QUERY[r]})
            text = calls.ask(r, talk)
            talk.append({"role": "assistant", "content": text})
            calls.note(r, text)
        if judge_video:
            return verdict(calls.ask("judge", [*talk, {"role": "user", "content": QUERY["verdict"]}]))
    elif mode == "flagship":
        # The four don't wait for one another; what they say counts once all have said it.
        said = lambda r: _observed(calls.backend.chat(_pair(r, _shown(frames, QUERY[r]))), r)
        if getattr(calls.backend, "waits", True):
            with ThreadPoolExecutor(len(ROLES)) as pool:
                replies = list(pool.map(said, ROLES))
        else:
            replies = list(map(said, ROLES))
        for r, reply in zip(ROLES, replies, strict=True):
            calls.note(r, calls.keep(r, reply, r))
    else:
        raise ValueError(f"unknown mode: {mode}")
    text = _reports(calls.seen)
    looks = judge_video and mode != "multiturn"
    return verdict(calls.ask("judge", _pair(judge if looks else "judge_text", _shown(frames, text) if looks else text)))


def _observed(reply: Reply, role: str) -> Reply:
    if not inside(reply.text, "observation"):
        raise ValueError(f"the {role} response has no observation")
    return reply


def infer(rows: DataFrame, backend: Backend, mode: str, keep: str, role: str = "", judge_video: bool = False, **options: Any) -> DataFrame:
    """A mode over a table: the columns of the DDL ``keep``, and the calls' results. Failed rows carry an error.

    A column ``frames`` (URIs, such as data URIs) goes along with the prompts
    of modes that look at media; a row without any fails. Where the table has
    no such column, prompts go alone.
    """
    if mode not in MODES or (mode == "observer" and role not in ROLES):
        raise ValueError(f"unknown mode or role: {mode} {role}")
    return map_rows(rows, f"{keep}, {OUTPUT}", lambda row, b: process(row, b, mode, role, judge_video), backend, **options)


def infer_spread(rows: DataFrame, backend: Backend, key: str, keep: str, judge_video: bool = False, **options: Any) -> DataFrame:
    """The flagship mode with its four observers as four rows, so that they run wherever there is room.

    Rows are spread by role, observed, gathered by key and judged. A rate
    holds for observers and judges together.
    """
    if isinstance(options.get("rpm"), (int, float)) and options["rpm"] > 0:
        options["rpm"] = serve(rows.sparkSession, options["rpm"])
    fan = rows.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLES])))
    seen = map_rows(fan, f"{keep}, role string, {OUTPUT}", lambda row, b: process(row, b, "observer", row["role"]), backend, **options)
    names = [c for c in rows.columns if c != key]
    one = seen.groupBy(key).agg(
        *[F.first(c).alias(c) for c in names],
        F.map_from_entries(F.collect_list(F.struct("role", F.try_element_at("observations", F.col("role"))))).alias("observations"),
        F.flatten(F.collect_list("calls")).alias("observer_calls"),
    )
    judged = map_rows(one, f"{keep}, observer_calls {CALLS}, {OUTPUT}", lambda row, b: process(row, b, "judge", judge_video=judge_video), backend, **options)
    return judged.withColumn("calls", F.concat(F.coalesce("observer_calls", F.array().cast(CALLS)), F.coalesce("calls", F.array().cast(CALLS)))).drop("observer_calls")
