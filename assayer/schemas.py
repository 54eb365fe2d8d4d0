"""Struct types of the record kinds. JSON is read with one of these, never by inference."""

from __future__ import annotations

ROLES = ("texture", "lighting", "motion", "physics")

MANIFEST = "video_path string, split string, label string, dataset string, source string, id string"
CALL = "struct<name: string, completion_tokens: bigint, elapsed_sec: double>"
MESSAGES = "array<struct<role: string, content: string>>"
REPORT_COLUMNS = ", ".join([*(f"{r} string" for r in ROLES), *(f"{r}_response string" for r in ROLES), *(f"{r}_report string" for r in ROLES)])
OBSERVATION_INPUT = f"video_path string, label string, observations map<string, string>, {REPORT_COLUMNS}"
RATIONALE_INPUT = (
    "video_path string, label string, aggregated_explanation string, explanation string, rationale string, response string, answer string"
)
RESULT = (
    f"{MANIFEST}, mode string, judge_video boolean, answer string, explanation string, observations map<string, string>, "
    "responses map<string, string>, response string, completion_tokens bigint, elapsed_sec double, "
    f"usage struct<calls: array<{CALL}>, completion_tokens: bigint, elapsed_sec: double>, error string"
)
AGGREGATED_OBSERVATION = (
    "video_path string, split string, label string, dataset string, source string, observations map<string, string>, "
    f"{', '.join(f'{r}_response string' for r in ROLES)}, num_models_used map<string, int>, usage array<{CALL}>"
)
AGGREGATED_EXPLANATION = (
    "video_path string, split string, label string, dataset string, source string, aggregated_explanation string, "
    "num_models_used int, all_wrong boolean, dropped boolean, usage struct<completion_tokens: bigint, elapsed_sec: double>"
)
QUALITY_SCORE = (
    "model string, video_path string, mode string, label string, score int, analysis string, judge_response string, "
    "completion_tokens bigint, elapsed_sec double, error string"
)
EVALUATION = "grp string, name string, total bigint, balanced_accuracy double, fake_recall double, fake_f1 double"
TRAINING_ROW = f"messages {MESSAGES}, frame_paths array<string>, video_file string, max_pixels bigint, nframes int, solution string"
