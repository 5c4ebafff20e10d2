"""State of projects and what a change makes stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Stages in order, the step that follows each, and inputs in the order they are compared.
STAGES = ("prepare-script", "await-script-style-approval", "prepare-script-voice", "await-script-voice-approval", "prepare-boards", "await-boards-approval", "ready-to-render", "fix-required", "await-final-qa", "complete")
NEXT_ACTION = {
    "prepare-script": "write-script", "await-script-style-approval": "approve-script-style", "prepare-script-voice": "stage-script-voice", "await-script-voice-approval": "approve-script-voice", "prepare-boards": "add-board",
    "await-boards-approval": "approve-boards", "ready-to-render": "render", "fix-required": "fix", "await-final-qa": "accept-qa", "complete": "none",
}
INPUTS = ("image_sha256", "annotation_sha256", "effective_annotation_sha256", "title_card", "animation_scene", "frame_plan", "renderer_profile", "hand_mode", "renderer_sha256", "fps")
REASONS = ("image_modified", "annotation_modified", "effective_annotation_modified", "title_card_modified", "animation_scene_modified", "frame_plan_modified", "renderer_profile_modified", "hand_mode_modified", "renderer_code_modified", "resolution_or_fps_modified")


def derive_stage(projects: DataFrame) -> DataFrame:
    """(project_id, stage) from flags: has_script, style_ok, has_voice, voice_ok, scenes, boards, plan_ready, boards_ok, final_current, qa_current, qa_ok."""
    f = F.col
    complete = (f("scenes") > 0) & (f("boards") >= f("scenes")) & f("plan_ready")
    stage = (
        F.when(~f("has_script"), STAGES[0]).when(~f("style_ok"), STAGES[1]).when(~f("has_voice"), STAGES[2]).when(~f("voice_ok"), STAGES[3]).when(~complete, STAGES[4]).when(~f("boards_ok"), STAGES[5])
        .when(~f("final_current"), STAGES[6]).when(f("qa_current"), STAGES[9]).when(f("qa_ok").eqNullSafe(F.lit(False)), STAGES[7]).otherwise(STAGES[8])
    )
    return projects.select("project_id", stage.alias("stage"))


def invalidation_reason(old: DataFrame, new: DataFrame, inputs: list[str], files: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """(scene_id, reason): why a scene's cached output may not be used, in fixed order; `default` when nothing differs.

    `inputs` name columns of INPUTS in both tables. With files (scene_id, sha256: the outputs there
    are), old also has key, sha256 and has_payload, and an entry without a key, an output that is
    gone or has another digest, and an entry without recorded inputs come before all inputs.
    """
    more = ["key", "sha256", "has_payload"] if files is not None else []
    df = new.join(old.select("scene_id", F.lit(True).alias("_had"), *[F.col(c).alias(f"_{c}") for c in [*inputs, *more]]), "scene_id", "left")
    reason = F.when(F.col("_had").isNull(), "no_prior_cache")
    if files is not None:
        df = df.join(files.select("scene_id", F.col("sha256").alias("_now")), "scene_id", "left")
        reason = reason.when(F.coalesce("_key", F.lit("")) == "", "no_prior_cache").when(F.col("_now").isNull(), "cached_output_missing").when(~F.col("_now").eqNullSafe(F.col("_sha256")), "cached_output_hash_mismatch")
        reason = reason.when(~F.coalesce("_has_payload", F.lit(False)), "cache_key_mismatch")
    for c in sorted(inputs, key=INPUTS.index):
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), REASONS[INPUTS.index(c)])
    return df.select("scene_id", reason.otherwise(F.lit(default)).alias("reason"))


def stale_cascade(changed: DataFrame, boards: DataFrame) -> DataFrame:
    """Boards (scene_id, source, approved) with stale and approved after a change of their source (changed: source)."""
    hit = changed.select("source", F.lit(True).alias("_hit")).distinct()
    df = boards.join(hit, "source", "left").withColumn("stale", F.coalesce("_hit", F.lit(False)))
    return df.select("scene_id", "source", "stale", (F.col("approved") & ~F.col("stale")).alias("approved"))


def qa_current(reports: DataFrame, finals: DataFrame) -> DataFrame:
    """(project_id, current): an acceptance holds only if every hash it names is still the current one. reports and finals: project_id, name, sha256."""
    df = reports.join(finals.select("project_id", "name", F.col("sha256").alias("_now")), ["project_id", "name"], "left")
    return df.groupBy("project_id").agg(F.bool_and(F.col("sha256").eqNullSafe(F.col("_now"))).alias("current"))


def next_action(stages: DataFrame, scenes: DataFrame, boards: DataFrame) -> DataFrame:
    """(project_id, action, scene_id): the next step, and for boards the first scene without one. scenes: project_id, seq, scene_id; boards: scene_id."""
    first = scenes.join(boards, "scene_id", "left_anti").groupBy("project_id").agg(F.min_by("scene_id", "seq").alias("scene_id"))
    action = F.coalesce(*[F.when(F.col("stage") == s, F.lit(a)) for s, a in NEXT_ACTION.items()])
    df = stages.join(first, "project_id", "left")
    return df.select("project_id", action.alias("action"), F.when(F.col("stage") == "prepare-boards", F.col("scene_id")).alias("scene_id"))
