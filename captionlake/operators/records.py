"""Projects, jobs, uploads, review and dubbing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.media import duration_fit
from captionlake.operators.sequences import joined_text

# Style settings that a preset keeps, states, and labels of a caption's review.
STYLE_KEYS = [
    "effect", "animation", "animationDuration", "animationIntensity", "font", "color", "highlightColor", "outlineColor", "fontSizePct", "bottomPct",
    "spacing", "scaleX", "angle", "outline", "shadow", "align", "bold", "italic", "maxWidthPct", "lineHeight", "safeAreaPct", "backgroundEnabled",
    "backgroundColor", "cropAspect", "cropX", "cropY", "cropLeft", "cropRight", "cropTop", "cropBottom", "enhanceFullHd",
]
REVIEW_STATES = ["pending", "approved", "edited"]
TIMING_SOURCES = ["whisper", "estimated", "manual"]
RESTARTED = "Application restarted"


# --- captions and review -----------------------------------------------------------------------------------------------


def validate_captions(captions: DataFrame) -> DataFrame:
    """captions (project_id, caption_idx, start, end, text, words) with error: null, or what is wrong first."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy("project_id").orderBy("caption_idx")), F.lit(0.0))
    time = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("start") >= before - 0.01) & ~F.isnan("start") & ~F.isnan("end"), F.lit(False))
    inside = F.forall("words", lambda w: F.coalesce((w["start"] >= F.col("start") - 0.01) & (w["end"] <= F.col("end") + 0.01) & (w["end"] > w["start"]), F.lit(False)))
    words = F.transform("words", lambda w: w.withField("text", F.substring(w["text"], 1, 300)))
    rows = captions.withColumn("_ok", time).withColumn("words", words).withColumn("text", F.substring("text", 1, 1000))
    error = F.when(~F.col("_ok"), "caption time").when(~inside, "word time").when((F.size("words") > 0) & (joined_text() != F.col("text")), "text")
    return rows.withColumn("error", error).drop("_ok")


def normalize_review(words: DataFrame) -> DataFrame:
    """Unknown review states and timing sources get their defaults."""
    status = F.when(F.col("review_status").isin(REVIEW_STATES), F.col("review_status")).otherwise(F.when(F.col("needs_review"), "pending").otherwise("approved"))
    source = F.when(F.col("timing_source").isin(TIMING_SOURCES), F.col("timing_source")).otherwise("whisper")
    return words.withColumn("review_status", status).withColumn("timing_source", source)


def pending_review(words: DataFrame, durations: DataFrame, margin: float = 0.6) -> DataFrame:
    """Words to review with the window to replay and their place in the project's list."""
    waiting = (F.col("review_status") == "pending") | (F.col("needs_review") & ~F.coalesce(F.col("review_status").isin("approved", "edited"), F.lit(False)))
    rows = words.where(waiting).join(durations, "project_id")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("start", "word_idx"))
    return rows.withColumn("review_idx", place).withColumn("replay_start", F.greatest(F.lit(0.0), F.col("start") - margin)).withColumn("replay_end", F.least("duration", F.col("end") + margin))


def apply_review_decisions(words: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (project_id, word_idx, new_text): another text edits the word, the same text approves it; an empty one does nothing."""
    clean = F.trim(F.regexp_replace("new_text", r"\s+", " "))
    asked = decisions.select("project_id", "word_idx", clean.alias("_new")).where("_new <> ''")
    rows = words.join(asked, ["project_id", "word_idx"], "left")
    asked_for, changed = F.col("_new").isNotNull(), F.col("_new").isNotNull() & (F.col("_new") != F.col("text"))
    new = {
        "text": F.when(changed, F.col("_new")).otherwise(F.col("text")),
        "review_status": F.when(changed, "edited").when(asked_for, "approved").otherwise(F.col("review_status")),
        "needs_review": F.col("needs_review") & ~asked_for,
    }
    if "timing_source" in words.columns:
        new["timing_source"] = F.when(changed, "manual").otherwise(F.col("timing_source"))
    for score in ("score", "review_score", "raw_confidence"):
        if score in words.columns:
            new[score] = F.when(~changed, F.col(score))
    return rows.withColumns(new).drop("_new")


def review_summary(words: DataFrame, group: tuple[str, ...] = ("project_id", "caption_idx")) -> DataFrame:
    """Flagged words and whether scores exist, as a label."""
    out = words.groupBy(*group).agg(
        F.count_if("needs_review").alias("flagged"), F.bool_or(F.col("review_score").isNotNull()).alias("machine"), F.bool_or(F.col("raw_confidence").isNotNull()).alias("legacy")
    )
    label = F.when(F.col("flagged") > 0, "review").when(F.col("machine"), "clear").when(F.col("legacy"), "legacy").otherwise("edited")
    return out.withColumn("label", label)


def captions_past_end(captions: DataFrame, durations: DataFrame) -> DataFrame:
    """Projects whose captions end more than 0.1 s after the media."""
    last = captions.groupBy("project_id").agg(F.max("end").alias("last_end"))
    return last.join(durations, "project_id").where("last_end > duration + 0.1D")


# --- projects, jobs, presets -----------------------------------------------------------------------------------------------


def recent_projects(projects: DataFrame, limit: int | None = 30, key: str = "updated_at", tie: str = "project_id") -> DataFrame:
    """The projects changed last; the limit is kept between 1 and 100."""
    return projects.orderBy(F.col(key).desc(), tie).limit(max(1, min(100, int(limit or 30))))


def list_presets(presets: DataFrame) -> DataFrame:
    """Presets with names unique in any case (the oldest stays) and their place in the list."""
    w = Window.partitionBy(F.lower("name")).orderBy("created_at", "name", "preset_id")
    return presets.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy("created_at", F.lower("name"))


def recover_jobs(jobs: DataFrame, open_states: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """Unfinished jobs become failed with a reason."""
    hit = F.col("status").isin(*open_states)
    error = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    return jobs.withColumn("error", F.when(hit, RESTARTED).otherwise(error)).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def migrate_words_v3(words: DataFrame) -> DataFrame:
    """Words of projects older than schema 3: raw score from confidence, default states; newer ones stay."""
    old = F.col("schema_version") < 3
    rows = words.withColumn("raw_confidence", F.when(old, F.coalesce("raw_confidence", "confidence")).otherwise(F.col("raw_confidence")))
    fixed = normalize_review(rows.withColumn("needs_review", F.coalesce("needs_review", F.lit(False))).withColumn("_s", F.col("review_status")).withColumn("_t", F.col("timing_source")))
    fixed = fixed.withColumn("review_status", F.when(old, F.col("review_status")).otherwise(F.col("_s"))).withColumn("timing_source", F.when(old, F.col("timing_source")).otherwise(F.col("_t")))
    return fixed.withColumn("schema_version", F.greatest("schema_version", F.lit(3))).drop("_s", "_t")


def migrate_projects_v3(projects: DataFrame) -> DataFrame:
    """Projects (captions and style as load_projects gives them, schema_version) older than schema 3: words of captions and the style get its fields; newer ones stay."""
    old = F.coalesce(F.col("schema_version"), F.lit(0)) < 3

    def word(w: Column) -> Column:
        needs = F.coalesce(w["needsReview"], F.lit(False))
        status = F.when(w["reviewStatus"].isin(REVIEW_STATES), w["reviewStatus"]).otherwise(F.when(needs, "pending").otherwise("approved"))
        source = F.when(w["timingSource"].isin(TIMING_SOURCES), w["timingSource"]).otherwise("whisper")
        w = w.withField("rawConfidence", F.coalesce(w["rawConfidence"], w["confidence"])).withField("needsReview", needs)
        return w.withField("reviewStatus", status).withField("timingSource", source)

    none = F.array().cast(projects.schema["captions"].dataType.elementType["words"].dataType)
    captions = F.transform("captions", lambda c: c.withField("words", F.transform(F.coalesce(c["words"], none), word)))
    style = F.map_concat(F.map_filter(F.coalesce("style", F.create_map().cast("map<string,string>")), lambda k, _: k != "schemaVersion"), F.create_map(F.lit("schemaVersion"), F.lit("3")))
    new = {"captions": captions, "style": style, "schema_version": F.lit(3).cast(projects.schema["schema_version"].dataType)}
    return projects.withColumns({name: F.when(old, value).otherwise(F.col(name)) for name, value in new.items()})


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their 1-based place in each queue (column queue; without it all are one queue).

    Places are counted by day of creation: jobs are numbered inside a day, and the days before are added up.
    """
    rows = jobs.where("status = 'queued'").withColumn("_queue", F.col("queue") if "queue" in jobs.columns else F.lit(0)).withColumn("_day", F.to_date("created_at"))
    days = rows.groupBy("_queue", "_day").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_queue").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_queue", "_day").orderBy("created_at", "job_id"))
    rows = rows.withColumn("_in", inside).join(days.select("_queue", F.col("_day").alias("_of"), before.alias("_before")).withColumnRenamed("_queue", "_q"), (F.col("_queue").eqNullSafe(F.col("_q"))) & F.col("_day").eqNullSafe(F.col("_of")))
    return rows.withColumn("position", (F.col("_in") + F.col("_before")).cast("int")).select(*jobs.columns, "position")


def latest_words_per_caption(jobs: DataFrame, default: int = 5) -> DataFrame:
    """Per project wordsPerCaption of its latest job, where it is a whole number from 1 to 12, else the default."""
    last = jobs.groupBy("project_id").agg(F.max_by("options_json", F.struct("created_at", "job_id")).alias("o"))
    value = F.get_json_object("o", "$.wordsPerCaption").try_cast("double") if hasattr(Column, "try_cast") else F.expr("try_cast(get_json_object(o, '$.wordsPerCaption') AS double)")
    good = (value == F.floor(value)) & value.between(1, 12)
    return last.select("project_id", F.when(good, value.cast("int")).otherwise(default).alias("words_per_caption"))


def project_summary(projects: DataFrame, captions: DataFrame) -> DataFrame:
    """Projects with their number of captions."""
    counts = captions.groupBy("project_id").agg(F.count("*").alias("caption_count"))
    return projects.join(counts, "project_id", "left").withColumn("caption_count", F.coalesce("caption_count", F.lit(0)))


def validate_project_sizes(media: DataFrame, hours: float = 4, gib: float = 2) -> DataFrame:
    """Per project (duration, bytes of each file) the totals and whether they are within the limits."""
    out = media.groupBy("project_id").agg(F.sum("duration").alias("total_duration"), F.sum("bytes").alias("total_bytes"))
    return out.withColumn("ok", (F.col("total_duration") <= hours * 3600) & (F.col("total_bytes") <= int(gib * 1024**3)))


def style_preset_values(style: Column) -> Column:
    """Of a map of settings those that presets keep and that are set."""
    return F.map_filter(style, lambda k, v: k.isin(STYLE_KEYS) & v.isNotNull())


def project_audio_files(clips: DataFrame, takes: DataFrame) -> DataFrame:
    """Distinct audio paths of a project's clips and takes."""
    own = clips.select("project_id", "audio_path")
    more = takes.select("clip_id", "audio_path").join(clips.select("project_id", "clip_id"), "clip_id").select("project_id", "audio_path")
    return own.union(more).where("audio_path IS NOT NULL AND audio_path <> ''").distinct()


def purge(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't in the table of what goes: applied to the projects and each table below them."""
    return rows.join(gone.select(*keys).distinct(), [*keys], "left_anti")


def restore_upload_order(files: DataFrame, names: DataFrame) -> DataFrame:
    """files (upload_id, pos, name, file_id) in the order of the submitted names (upload_id, pos, name), the k-th use of a name being
    its k-th file; an upload whose names don't match its files keeps its order. Adds new_pos."""
    by = Window.partitionBy("upload_id", "name").orderBy("pos")
    have = files.withColumn("k", F.row_number().over(by))
    want = names.withColumn("k", F.row_number().over(by)).select("upload_id", "name", "k", F.col("pos").alias("want_pos"))
    counts = names.groupBy("upload_id").agg(F.count("*").alias("n_names"))
    met = have.join(want, ["upload_id", "name", "k"], "left").join(counts, "upload_id", "left")
    all_of = Window.partitionBy("upload_id")
    whole = (F.count("want_pos").over(all_of) == F.count(F.lit(1)).over(all_of)) & (F.count(F.lit(1)).over(all_of) == F.col("n_names"))
    order = F.when(F.coalesce(whole, F.lit(False)), F.col("want_pos")).otherwise(F.col("pos"))
    return met.withColumn("_o", order).withColumn("new_pos", F.row_number().over(all_of.orderBy("_o"))).select("upload_id", "file_id", "name", "pos", "new_pos")


# --- voices and dubbing ----------------------------------------------------------------------------------------------------------


def voice_style_checks(styles: DataFrame) -> DataFrame:
    """styles (style_id, voice_id, name, emotion, reference_text, reference_seconds) cut to their lengths, with error."""
    cut = lambda c, n: F.trim(F.substring(F.trim(c), 1, n))
    rows = styles.withColumn("name", cut("name", 80)).withColumn("emotion", cut("emotion", 40))
    rows = rows.withColumn("reference_text", F.substring(F.trim(F.regexp_replace("reference_text", r"\s+", " ")), 1, 1000))
    twice = F.count("*").over(Window.partitionBy("voice_id", F.lower("emotion")))
    error = F.when((F.col("name") == "") | (F.col("emotion") == "") | (F.col("reference_text") == ""), "empty")
    error = error.when(~F.coalesce(F.col("reference_seconds").between(5, 10), F.lit(False)), "length").when(twice > 1, "emotion")
    return rows.withColumn("error", error)


def voice_usage(clips: DataFrame) -> DataFrame:
    return clips.groupBy("voice_style_id").agg(F.count("*").alias("n_clips"))


def unused_voice_styles(styles: DataFrame, clips: DataFrame) -> DataFrame:
    return styles.join(clips.select("voice_style_id").distinct(), "voice_style_id", "left_anti")


def clips_with_takes(clips: DataFrame, takes: DataFrame) -> DataFrame:
    """Clips with their takes as an ordered array, and their place in the project (by start, then id)."""
    nested = takes.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("take_index", *[c for c in takes.columns if c not in ("clip_id", "take_index")]))).alias("takes"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("start_time", "clip_id"))
    return clips.join(nested, "clip_id", "left").withColumn("clip_pos", place)


def voices_with_styles(voices: DataFrame, styles: DataFrame) -> DataFrame:
    """Voices by name in any case, each with its styles in the order in which they were made."""
    nested = styles.groupBy("voice_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "style_id", "emotion"))).alias("styles"))
    return voices.join(nested, "voice_id", "left").orderBy(F.lower("name"), "voice_id")


def select_take(takes: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Per clip the first take that fits, else the first; a user's choice (clip_id, take_index) of a ready take comes before both."""
    names = [c for c in takes.columns if c != "clip_id"]
    rows = takes
    chosen = F.lit(1)
    if choices is not None:
        rows = takes.join(choices.withColumnRenamed("take_index", "_want"), "clip_id", "left")
        chosen = F.when((F.col("_want") == F.col("take_index")) & (F.col("status") == "ready"), 0).otherwise(1)
    best = rows.groupBy("clip_id").agg(F.min_by(F.struct(*names), F.struct(chosen, (F.col("fit_status") != "fit").cast("int"), "take_index")).alias("t"))
    return best.select("clip_id", "t.*")


def validate_dub_clips(clips: DataFrame) -> DataFrame:
    """clips (project_id, clip_id, start_time, end_time, text, speed, pause_before, pause_after, duration) inside their limits, with error."""
    within = lambda c, low, high, default: F.greatest(F.lit(low), F.least(F.lit(high), F.when(F.col(c).isNull() | F.isnan(c) | (F.col(c) == 0), default).otherwise(F.col(c))))
    rows = clips.withColumn("start_time", F.greatest(F.lit(0.0), "start_time")).withColumn("end_time", F.least(F.coalesce("duration", F.lit(0.0)), "end_time"))
    rows = rows.withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    rows = rows.withColumns({"speed": within("speed", 0.85, 1.15, 1.0), "pause_before": within("pause_before", 0.0, 1.5, 0.0), "pause_after": within("pause_after", 0.0, 1.5, 0.0)})
    slot = F.col("end_time") - F.col("start_time")
    error = F.when(~F.coalesce(slot >= 0.2, F.lit(False)), "slot").when(F.col("text") == "", "no text").when(F.length("text") > 1000, "long text")
    return rows.withColumn("error", error.when(F.col("pause_before") + F.col("pause_after") >= slot - 0.2, "pauses"))


def validate_dub_export(projects: DataFrame, clips: DataFrame) -> DataFrame:
    """Per project the first thing that keeps its dub from export: no clips, one not ready, one too long, or an overlap; else null."""
    w = Window.partitionBy("project_id").orderBy("start_time", "clip_id")
    rows = clips.withColumn("_i", F.row_number().over(w)).withColumn("_before", F.lag("end_time").over(w))
    ready = (F.col("status") == "ready") & (F.coalesce("audio_path", F.lit("")) != "")
    error = F.when(~F.coalesce(ready, F.lit(False)), "not ready").when(F.col("fit_status") == "needs_edit", "too long").when(F.col("_before") > F.col("start_time") + 0.001, "overlap")
    first = rows.withColumn("error", error).groupBy("project_id").agg(F.count("*").alias("n_clips"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("_i"))).alias("error"))
    out = projects.select("project_id").join(first, "project_id", "left")
    return out.select("project_id", F.coalesce("n_clips", F.lit(0)).alias("n_clips"), F.when(F.col("n_clips").isNull(), "no clips").otherwise(F.col("error")).alias("error"))


def clips_to_regenerate(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (clip_id and new_ columns): whether each needs new sound, and its fit and state afterwards."""
    rows = clips.join(edits, "clip_id")
    same = F.lit(True)
    for c in ("text", "spoken_text", "voice_style_id", "speed", "pause_before", "pause_after"):
        have = F.coalesce(F.col(c), F.col("text")) if c == "spoken_text" else F.col(c)
        same = same & have.eqNullSafe(F.col(f"new_{c}"))
    fit = F.when(duration_fit(F.col("actual_duration"), F.col("new_end_time") - F.col("new_start_time"))["status"] == "needs_edit", "needs_edit").otherwise("fit")
    fit = F.when(~same, "pending").when(F.col("actual_duration") > 0, fit).otherwise(F.col("fit_status"))
    return rows.select("clip_id", (~same).alias("regenerate"), fit.alias("fit_status"), F.when(~same, "queued").otherwise(F.col("status")).alias("status"))
