"""Text of records as Column expressions: tags, verdicts, scores, names, addresses. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the record formats.
ANSWER_TAG = r"(?iu)<answer>\s*(real|fake)\s*</answer>"
VERDICT = r"(?iu)\b(real|fake)\b"
SCORE_LINE = r"(?iumd)^\s*SCORE\s*:\s*(10|[1-9])\s*$"
ANALYSIS_BLOCK = r"(?iumsd)^\s*ANALYSIS\s*:\s*(.+?)(?=^\s*SCORE\s*:)"
CLIP_MARK = "\n[…report truncated for Judge context…]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """Null as the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space (any of Unicode's) at either end; null as the empty text."""
    return F.regexp_replace(present(c), r"(?U)^\s+|\s+$", "")


def filled(c: Column | str) -> Column:
    """Null where the text is empty."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first text that isn't empty, or the empty text."""
    return F.coalesce(*[filled(c) for c in cs], F.lit(""))


def tag_pattern(tag: str) -> str:
    return rf"(?ius)<\Q{tag}\E>\s*(.*?)\s*</\Q{tag}\E>"


def has_tag(c: Column | str, tag: str) -> Column:
    return present(c).rlike(tag_pattern(tag))


def tagged(c: Column | str, tag: str) -> Column:
    """What the first ``<tag>…</tag>`` holds, stripped; empty if there is none."""
    return strip(F.regexp_extract(present(c), tag_pattern(tag), 1))


def parse_answer(c: Column | str, missing: str = "Error") -> Column:
    """real or fake: of the first strict answer tag, else the last such word, else ``missing``."""
    strict = F.regexp_extract(present(c), ANSWER_TAG, 1)
    words = F.regexp_extract_all(present(c), F.lit(VERDICT), F.lit(1))
    return F.coalesce(F.lower(filled(strict)), F.lower(F.try_element_at(words, F.lit(-1))), F.lit(missing))


def parse_observation(c: Column | str, allow_plain: bool = False) -> Column:
    """The observation tag's text; with allow_plain also a whole untagged text unless it reports an error."""
    inner = tagged(c, "observation")
    if not allow_plain:
        return inner
    whole = strip(c)
    return F.when(inner != "", inner).when(~F.lower(whole).startswith("<error>"), whole).otherwise(F.lit(""))


def parse_final(c: Column | str) -> Column:
    """Struct (answer, explanation) of a final response."""
    return F.struct(parse_answer(c).alias("answer"), tagged(c, "explanation").alias("explanation"))


def final_problem(c: Column | str) -> Column:
    """Why a final response won't do, or null."""
    return F.when(~parse_answer(c).isin("real", "fake"), F.lit("no real/fake answer")).when(
        tagged(c, "explanation") == "", F.lit("no explanation")
    )


def unwrap(c: Column | str, tag: str) -> Column:
    """The tag's text where there is such a tag, else the whole text, stripped."""
    return F.when(has_tag(c, tag), tagged(c, tag)).otherwise(strip(c))


def extract_rationale(*fields: Column | str, response: Column | str) -> Column:
    """The first filled field, unwrapped; else the response's explanation tag.

    A field that is filled but holds an empty tag counts: it gives the empty text.
    """
    out = tagged(response, "explanation")
    for f in reversed(fields):
        out = F.when(strip(f) != "", unwrap(f, "explanation")).otherwise(out)
    return out


def sanitised(c: Column | str) -> Column:
    """Struct (value, problem): a model's text without observation and explanation wrappers.

    problem says why it won't do (empty, or an answer tag inside) and is null otherwise.
    """
    inner = parse_observation(c, allow_plain=True)
    value = unwrap(F.when(inner != "", inner).otherwise(strip(c)), "explanation")
    problem = (
        F.when(strip(c) == "", F.lit("empty"))
        .when(value.rlike(r"(?i)</?answer\b"), F.lit("answer tag"))
        .when(value == "", F.lit("empty"))
    )
    return F.struct(value.alias("value"), problem.alias("problem"))


def sanitize_plain(c: Column | str, what: str = "text") -> Column:
    """The sanitised text; a row with a problem ends the job."""
    s = sanitised(c)
    return F.when(s["problem"].isNotNull(), F.raise_error(F.concat(F.lit(f"{what}: "), s["problem"]))).otherwise(s["value"])


def parse_score(c: Column | str) -> Column:
    """Struct (score, analysis) of a judge's two lines; null if either is missing."""
    score = F.regexp_extract(present(c), SCORE_LINE, 1)
    analysis = strip(F.regexp_extract(present(c), ANALYSIS_BLOCK, 1))
    return F.when((score != "") & (analysis != ""), F.struct(score.cast("int").alias("score"), analysis.alias("analysis")))


def binary_label(c: Column | str, strict: bool = True) -> Column:
    """real, or fake for any of the kinds of fakes; others end the job, or are null if not strict."""
    name = F.lower(strip(c))
    out = F.when(name == "real", F.lit("real")).when(name.isin("fake", "efs", "fs", "fr"), F.lit("fake"))
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported label: "), present(c)))) if strict else out


def required(c: Column | str, what: str) -> Column:
    """The stripped text; an empty one ends the job."""
    return F.when(strip(c) == "", F.raise_error(F.lit(f"{what} is empty"))).otherwise(strip(c))


def observation_block(c: Column | str) -> Column:
    return F.concat(F.lit("<observation>\n"), strip(c), F.lit("\n</observation>"))


def final_block(explanation: Column, answer: Column) -> Column:
    return F.concat(F.lit("<explanation>\n"), explanation, F.lit("\n</explanation>\n<answer>"), answer, F.lit("</answer>"))


def slug(c: Column | str, default: str = "model") -> Column:
    """Lower-case words of letters and digits joined by hyphens."""
    return first_filled(F.regexp_replace(F.regexp_replace(F.lower(present(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(default))


def clip(c: Column | str, limit: int = 6000) -> Column:
    """At most ``limit`` characters and a mark that says so."""
    text = strip(c)
    cut = F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(CLIP_MARK)))


def render_final(c: Column | str) -> Column:
    """A final response for reading: explanation, then the verdict in bold; as it is if it has neither tag."""
    answer = F.upper(F.regexp_extract(present(c), ANSWER_TAG, 1))
    verdict = F.when(answer != "", F.concat(F.lit("**Verdict: "), answer, F.lit("**")))
    either = has_tag(c, "explanation") | present(c).rlike(ANSWER_TAG)
    return F.when(either, F.concat_ws("\n\n", filled(tagged(c, "explanation")), verdict)).otherwise(strip(c))


def truthy(c: Column | str) -> Column:
    return F.lower(strip(c)).isin("1", "true", "yes", "on", "y")


def training_method(c: Column | str) -> Column:
    """TRAINING_FREE, SFT or GRPO from the spellings in use; null for others."""
    name = F.regexp_replace(F.upper(strip(c)), " ", "_")
    return (
        F.when(name.isin("TRAINING_FREE", "TRAINING-FREE"), F.lit("TRAINING_FREE"))
        .when(name.isin("+SFT", "SFT"), F.lit("SFT"))
        .when(name.isin("+SFT+GRPO", "GRPO"), F.lit("GRPO"))
    )


def judge_adapter(method: Column | str, reads_video: Column) -> Column:
    """The name of the judge's adapter for a training method."""
    name = training_method(method)
    return F.when(name == "TRAINING_FREE", F.lit("base_model")).when(
        name.isNotNull(), F.concat(F.lit("judge_"), F.lower(name), F.when(reads_video, F.lit("_video")).otherwise(F.lit("_text")))
    )


def required_adapters(mode: Column | str, role: Column | str) -> Column:
    """Struct (observers, judge): which adapters a mode needs."""
    m = col(mode)
    observers = F.when(m == "observer", present(role).isin("texture", "lighting", "motion", "physics")).otherwise(m.isin("flagship", "multiturn"))
    return F.struct(observers.alias("observers"), (m != "observer").alias("judge"))


def chat_url(c: Column | str) -> Column:
    """A server's address with the path of chat completions."""
    base = F.regexp_replace(present(c), "/+$", "")
    return F.when(base.endswith("/chat/completions"), base).otherwise(F.concat(base, F.lit("/chat/completions")))


def chat_url_versioned(c: Column | str) -> Column:
    """As :func:`chat_url`, with /v1 where the path lacks it; null unless http or https with a host."""
    raw = F.regexp_replace(strip(c), "/+$", "")
    path = F.regexp_replace(F.regexp_extract(raw, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(
        raw.rlike(r"^(?i)https?://[^/?#]+"),
        F.when(path.endswith("/chat/completions"), raw)
        .when(path.endswith("/v1"), F.concat(raw, F.lit("/chat/completions")))
        .otherwise(F.concat(raw, F.lit("/v1/chat/completions"))),
    )


def redact(message: Column | str, secret: Column | str) -> Column:
    return F.when(present(secret) == "", present(message)).otherwise(F.replace(present(message), present(secret), F.lit("[redacted]")))


def model_size(c: Column | str) -> Column:
    """32b, 7b or 3b by the last part of a model's path; the longest name first; null if there is none."""
    name = F.lower(F.regexp_extract(present(c), r"([^/]*)/*$", 1))
    return F.when(name.contains("32b"), F.lit("32b")).when(name.contains("7b"), F.lit("7b")).when(name.contains("3b"), F.lit("3b"))


def device_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(present(c), ","), lambda x: F.trim(x) != ""))


def content_text(parts: Column, fallback: Column | None = None) -> Column:
    """Texts of a message's parts, a line each; ``fallback`` if there are none."""
    text = F.concat_ws("\n", F.transform(parts, lambda p: present(p["text"])))
    return text if fallback is None else first_filled(text, present(fallback))


def int_or(c: Column | str, default: int) -> Column:
    return F.coalesce(F.expr(f"try_cast({c} as int)") if isinstance(c, str) else c.try_cast("int"), F.lit(default))


def float_or(c: Column | str, default: float) -> Column:
    return F.coalesce(F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double"), F.lit(default))


def numbered(blocks: Column, head) -> Column:
    """Blocks of text, each after the line that ``head(block, number)`` gives, parted by empty lines."""
    return F.array_join(F.transform(blocks, lambda b, i: head(b, i + 1)), "\n\n")


def joined(parts: list[Column], sep: str = "\n\n") -> Column:
    return reduce(lambda a, b: F.concat(a, F.lit(sep), b), parts)


def forwarded(args: Column) -> Column:
    """Arguments to pass on: without a leading ``--``."""
    return F.when(F.get(args, F.lit(0)) == "--", F.slice(args, 2, F.greatest(F.size(args) - 1, F.lit(0)))).otherwise(args)
