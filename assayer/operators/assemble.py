"""Prompts, conversations, result records and training rows as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    binary_label,
    clip,
    extract_rationale,
    filled,
    final_block,
    first_filled,
    observation_block,
    parse_answer,
    parse_observation,
    present,
    required,
    strip,
)
from ..schemas import ROLES
from .checks import holds_answer_tag

# Headings and closing of the judge's input.
REPORT_HEADS = {
    "texture": "Texture analysis report:",
    "lighting": "Lighting analysis report:",
    "motion": "Motion analysis report:",
    "physics": "Physical plausibility analysis report:",
}
JUDGE_CLOSING = (
    "Return a brief explanation in <explanation></explanation> tags. Do not put any <answer> tags or final label inside "
    "the explanation. Then output exactly <answer>real</answer> or <answer>fake</answer>."
)

#: Our own wording of the instructions by role and mode.
SYSTEM = {
    "texture": "You inspect skin, hair and edges of the face for signs of synthesis and describe what you see.",
    "lighting": "You inspect light, shadow and reflection on the face for contradictions and describe what you see.",
    "motion": "You inspect how the face moves from frame to frame for jumps and drift and describe what you see.",
    "physics": "You inspect whether the face and what it touches obey physics and describe what you see.",
    "judge_text": "You weigh four reports on one video and decide whether it is real or fake.",
    "judge_video": "You weigh four reports on one video, check them against its frames, and decide whether it is real or fake.",
    "single": "You decide whether a video is real or fake.",
    "cot": "You reason step by step about a video and then decide whether it is real or fake.",
    "multiturn": "You study one video over several turns, one aspect each, before you give a verdict.",
    "full": "You grade the rationale of a verdict against a reference, knowing both verdicts.",
    "noanswer": "You grade a rationale against a reference without knowing any verdict.",
}
QUERY = {
    **{r: f"Describe the {r} of the face in this video in <observation></observation> tags." for r in ROLES},
    "single": f"Is this video real or fake? {JUDGE_CLOSING}",
    "cot": f"Think through {', '.join(f'the {r} in <{r}></{r}> tags' for r in ROLES)}. {JUDGE_CLOSING}",
    "verdict": f"Now give your verdict. {JUDGE_CLOSING}",
}


def catalogue(name: Column, entries: dict[str, str]) -> Column:
    """The entry of a static catalogue by name; null for unknown names."""
    pairs = [F.lit(x) for kv in entries.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), name)


def coalesced_reports(nested: Column | None, has: set[str], prefix: str = "") -> dict[str, Column]:
    """Each role's report from its four spellings: nested, <role>, <role>_response, <role>_report; the first that cleans to something."""
    out = {}
    for role in ROLES:
        spellings = [F.try_element_at(nested, F.lit(role))] if nested is not None else []
        spellings += [F.col(prefix + n) for n in (role, f"{role}_response", f"{role}_report") if prefix + n in has]
        out[role] = first_filled(*[parse_observation(s, allow_plain=True) for s in spellings])
    return out


def judge_input(reports: dict[str, Column], clipped: bool = False, with_video: bool = False) -> Column:
    """The four reports under their headings, then what the judge is to return."""
    blocks = [F.concat(F.lit(f"{head}\n"), clip(reports[r]) if clipped else reports[r], F.lit("\n\n")) for r, head in REPORT_HEADS.items()]
    return F.concat(F.lit("<video>\n" if with_video else ""), *blocks, F.lit(JUDGE_CLOSING))


def numbered_blocks(reports: Column, title: str, named: bool = True, answer: bool = False, blank_answer: str = "") -> Column:
    """``--- <title> i (name) ---`` and the text of each of an array of structs (name, answer, text)."""

    def one(r: Column, i: Column) -> Column:
        head = F.concat(F.lit(f"--- {title} "), (i + 1).cast("string"), F.concat(F.lit(" ("), r["name"], F.lit(")")) if named else F.lit(""), F.lit(" ---\n"))
        said = F.concat(F.lit("Predicted answer: "), F.coalesce(filled(r["answer"]), F.lit(blank_answer)), F.lit("\n")) if answer else F.lit("")
        return F.concat(head, said, r["text"])

    return F.array_join(F.transform(reports, one), "\n\n")


def observation_prompt(label: Column, role: str, reports: Column) -> Column:
    """The reports of all models on one aspect of a video whose label is known."""
    lead = F.concat(F.lit("This video is "), label, F.lit(".\nBelow are "), F.size(reports).cast("string"), F.lit(f" reports on its {role}."))
    return F.concat(lead, F.lit("\n\n"), numbered_blocks(reports, "Model"))


def explanation_prompt(label: Column, reports: Column) -> Column:
    """Rationales that reached the right verdict."""
    lead = F.concat(F.lit("Ground-truth verdict: "), label, F.lit(".\n\nMerge the rationales below, which all reached this verdict."))
    return F.concat(lead, F.lit("\n\n"), numbered_blocks(reports, "Rationale", answer=True))


def all_wrong_prompt(label: Column, observations: dict[str, Column], reports: Column) -> Column:
    """Rationales that all missed the verdict, with the observations to judge them by."""
    seen = F.concat_ws("\n", *[F.concat(F.lit(f"{r.capitalize()}: "), observations[r]) for r in ROLES])
    lead = F.concat(F.lit("Ground-truth verdict: "), label, F.lit(".\n\nEvery rationale below missed it. Explain it from the observations.\n\nConsolidated observations:\n"), seen)
    return F.concat(lead, F.lit("\n\n"), numbered_blocks(reports, "Initial rationale", answer=True, blank_answer="unparseable"))


def blind_prompt(reports: Column) -> Column:
    """Rationales without names, verdicts and label."""
    return F.concat(F.lit("Combine the visual evidence of these rationales."), F.lit("\n\n"), numbered_blocks(reports, "Rationale", named=False))


def annotator_answer(response: Column | str, answer: Column | str) -> Column:
    """An annotator's verdict: of the response, else of the answer field, else empty."""
    return first_filled(parse_answer(response, ""), parse_answer(answer, ""))


def scored_answer(answer: Column | str, response: Column | str) -> Column:
    """A scored model's verdict: of the answer field, else of the response, else Error."""
    return F.coalesce(filled(parse_answer(answer, "")), parse_answer(response))


def explanation_plan(label: Column, reports: Column, policy: str, observations: dict[str, Column] | None = None) -> Column:
    """What consolidating a video's rationales comes to, as a struct.

    Fields: num_models_used, all_wrong, dropped, prompt (null where dropped).
    ``reports`` is an array of structs (name, answer, text) of filled
    rationales. Right ones alone are used; without any the policy decides:
    drop the video, use all blindly, or use all with the label and four
    observations.
    """
    if policy not in ("drop", "blind", "ground-truth"):
        raise ValueError(f"unknown policy: {policy}")
    if policy == "ground-truth" and observations is None:
        raise ValueError("this policy needs observations")
    right = F.filter(reports, lambda r: r["answer"] == label)
    wrong = F.size(right) == 0
    if policy == "drop":
        used, prompt = F.lit(0), F.lit(None).cast("string")
    elif policy == "blind":
        used, prompt = F.size(reports), blind_prompt(reports)
    else:
        bare = [F.when(strip(observations[r]) == "", F.lit(r)) for r in ROLES]
        gaps = F.concat_ws(", ", *bare)
        used = F.size(reports)
        prompt = F.when(gaps != "", F.raise_error(F.concat(F.lit("missing observations: "), gaps)).cast("string")).otherwise(
            all_wrong_prompt(label, observations, reports)
        )
    return F.struct(
        F.when(wrong, used).otherwise(F.size(right)).alias("num_models_used"),
        wrong.alias("all_wrong"),
        (wrong & F.lit(policy == "drop")).alias("dropped"),
        F.when(wrong, prompt).otherwise(explanation_prompt(label, right)).alias("prompt"),
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def local_turn(role: str, text: Column, kinds: Column | None = None) -> Column:
    """A local model's turn: struct (role, content), content the media parts of ``kinds`` (an array of video or image) and then the text."""
    part = lambda kind, said: F.struct(kind.alias("type"), said.alias("text"))
    lead = F.array(part(F.lit("text"), text))
    if kinds is None:
        return F.struct(F.lit(role).alias("role"), lead.alias("content"))
    media = F.transform(kinds, lambda k: part(k, F.lit(None).cast("string")))
    return F.struct(F.lit(role).alias("role"), F.concat(media, lead).alias("content"))


def video_turn(text: Column, frames: Column) -> Column:
    """A user turn whose frames, however many, are one video; text alone without any."""
    return local_turn("user", text, F.when(F.size(frames) > 0, F.array(F.lit("video"))).otherwise(F.array().cast("array<string>")))


def image_turn(text: Column, frames: Column) -> Column:
    """A user turn with an image for each frame; text alone without any."""
    return local_turn("user", text, F.transform(frames, lambda f: F.lit("image")))


def quality_messages(mode: str, reference: Column, rationale: Column, label: Column | None = None, answer: Column | None = None) -> Column:
    """The conversation that asks for a grade; ``noanswer`` shows no verdict."""
    if mode == "noanswer":
        user = F.concat(F.lit("Compare the candidate rationale with the reference.\n\nReference rationale:\n"), reference, F.lit("\n\nCandidate rationale:\n"), rationale)
    elif mode == "full":
        user = F.concat(
            F.lit("Grade the rationale below.\n\nGround-truth answer:\n"), label, F.lit("\n\nReference rationale:\n"), reference,
            F.lit("\n\nModel answer:\n"), answer, F.lit("\n\nModel rationale:\n"), rationale,
        )
    else:
        raise ValueError(f"unknown mode: {mode}")
    return F.array(message("system", F.lit(SYSTEM[mode])), message("user", user))


def observer_row(role: str, report: Column) -> Column:
    """The three messages that teach an observer its role."""
    return F.array(
        message("system", F.lit(SYSTEM[role])),
        message("user", F.lit("<video>\n" + QUERY[role])),
        message("assistant", observation_block(required(report, f"{role} observation"))),
    )


def judge_row(reports: dict[str, Column], label: Column | str, explanation: Column | None, with_video: bool = False) -> Column:
    """The judge's messages: two for reinforcement (explanation None), with the verdict a third for supervision."""
    turns = [
        message("system", F.lit(SYSTEM["judge_video" if with_video else "judge_text"])),
        message("user", judge_input(reports, with_video=with_video)),
    ]
    if explanation is not None:
        text = required(explanation, "explanation")
        clean = F.when(holds_answer_tag(text), F.raise_error(F.lit("the explanation holds an answer tag")).cast("string")).otherwise(text)
        turns.append(message("assistant", final_block(clean, binary_label(label))))
    return F.array(*turns)


def template(with_video: bool = False, frame_size: int = 256, frames: int | None = None) -> Column:
    """Options of the chat template: thinking off, and for media the pixels and the number of frames."""
    return F.struct(
        F.lit(False).alias("enable_thinking"),
        F.lit(frame_size * frame_size if with_video else None).cast("bigint").alias("max_pixels"),
        F.lit(frames).cast("int").alias("nframes"),
    )


def conversation(rows: DataFrame, key: str, turn: str, role: str = "role", content: str = "text") -> DataFrame:
    """(key, messages): each conversation's turns in order."""
    turns = F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(content).alias("content"))))
    return rows.groupBy(key).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def usage(calls: Column, wall: Column) -> Column:
    """Struct (calls, completion_tokens, elapsed_sec) of an array of call statistics."""
    tokens = F.aggregate(calls, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c["completion_tokens"], F.lit(0).cast("bigint")))
    return F.struct(calls.alias("calls"), tokens.alias("completion_tokens"), F.bround(wall, 3).alias("elapsed_sec"))


def primary_response(responses: Column) -> Column:
    """The judge's response, else the final one, else the only one."""
    only = F.when(F.size(responses) == 1, F.map_values(responses)[0])
    named = F.coalesce(F.try_element_at(responses, F.lit("judge")), F.try_element_at(responses, F.lit("final")), F.lit(""))
    return F.coalesce(filled(named), only, named)


def result_record(rows: DataFrame, metadata: list[str], mode: str, judge_video: bool = False) -> DataFrame:
    """Results with flattened role columns, from answer, explanation, observations, responses, calls, wall_sec and error."""
    spent = usage(F.col("calls"), F.col("wall_sec"))
    return rows.select(
        *metadata,
        F.lit(mode).alias("mode"),
        F.lit(judge_video).alias("judge_video"),
        present("answer").alias("answer"),
        present("explanation").alias("explanation"),
        "observations",
        "responses",
        primary_response(F.col("responses")).alias("response"),
        spent["completion_tokens"].alias("completion_tokens"),
        spent["elapsed_sec"].alias("elapsed_sec"),
        spent.alias("usage"),
        *[F.try_element_at("observations", F.lit(r)).alias(r) for r in ROLES],
        *[F.try_element_at("responses", F.lit(r)).alias(f"{r}_response") for r in ROLES],
        filled("error").alias("error"),
    )


def rationale_of(df_columns: set[str]) -> Column:
    """The rationale of a row by the fields that its table has."""
    fields = [f for f in ("aggregated_explanation", "explanation", "rationale") if f in df_columns]
    return extract_rationale(*fields, response="response" if "response" in df_columns else F.lit(""))
