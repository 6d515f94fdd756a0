"""Queries over projects, jobs, uploads, voices and dubbing clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.functions import media, text
from captionlake.operators import records
from captionlake.plans.captions import five_captions
from captionlake.plans.speech import _FIVE, r6
from captionlake.plans.tables import duck, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def full_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips with text, controls, sound and fit made from their numbers."""
    c = F.col("clip_id")
    return table(spark, d, "clips").withColumns(
        {
            "text": F.when(c % 19 == 0, " ").otherwise(F.concat(F.lit("  clip  "), c.cast("string"))), "speed": (c % 8) * 0.25, "pause_before": (c % 5) * 0.5, "pause_after": (c % 3) * 0.75,
            "audio_path": F.when(c % 9 != 0, F.concat(F.lit("dubs/"), (c % 1000).cast("string"), F.lit(".wav"))), "actual_duration": (c % 50) / 10.0,
            "fit_status": F.when(c % 13 == 0, "needs_edit").otherwise("fit"), "spoken_text": F.when(c % 2 == 0, F.concat(F.lit("  clip  "), c.cast("string"))),
        }
    )


_FULL = """full_clips AS (SELECT *, CASE WHEN clip_id % 19 = 0 THEN ' ' ELSE '  clip  ' || clip_id END AS text, (clip_id % 8) * 0.25::DOUBLE AS speed, (clip_id % 5) * 0.5::DOUBLE AS pause_before, (clip_id % 3) * 0.75::DOUBLE AS pause_after,
 CASE WHEN clip_id % 9 <> 0 THEN 'dubs/' || (clip_id % 1000) || '.wav' END AS audio_path, (clip_id % 50) / 10.0::DOUBLE AS actual_duration, CASE WHEN clip_id % 13 = 0 THEN 'needs_edit' ELSE 'fit' END AS fit_status,
 CASE WHEN clip_id % 2 = 0 THEN '  clip  ' || clip_id END AS spoken_text FROM clips)"""


@query("f6_validate_dub_clips", duck("clips", f""", {_FULL}, v AS (SELECT project_id, clip_id, greatest(0.0, start_time) AS s, least(60.0, end_time) AS e, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text,
 greatest(0.85, least(1.15, CASE WHEN speed = 0 THEN 1.0 ELSE speed END)) AS speed, greatest(0.0, least(1.5, pause_before)) AS pause_before, greatest(0.0, least(1.5, pause_after)) AS pause_after FROM full_clips)
SELECT project_id, clip_id, text, speed, pause_before, pause_after, CASE WHEN NOT (e - s >= 0.2) THEN 'slot' WHEN text = '' THEN 'no text' WHEN pause_before + pause_after >= e - s - 0.2 THEN 'pauses' END AS error FROM v"""))  # fmt: skip
def f6(spark: SparkSession, d: str) -> DataFrame:
    out = records.validate_dub_clips(full_clips(spark, d).withColumn("duration", F.lit(60.0)))
    return out.select("project_id", "clip_id", "text", "speed", "pause_before", "pause_after", "error")


@query("f7_validate_dub_export", duck("clips", f""", {_FULL}, p AS (SELECT DISTINCT c_custkey AS project_id FROM customer), v AS (SELECT *, row_number() OVER w AS i, CASE WHEN NOT (status = 'ready' AND audio_path IS NOT NULL) THEN 'not ready'
 WHEN fit_status = 'needs_edit' THEN 'too long' WHEN lag(end_time) OVER w > start_time + 0.001 THEN 'overlap' END AS error FROM full_clips WINDOW w AS (PARTITION BY project_id ORDER BY start_time, clip_id)),
f AS (SELECT project_id, count(*) AS n_clips, arg_min(error, i) FILTER (error IS NOT NULL) AS error FROM v GROUP BY project_id)
SELECT p.project_id, coalesce(n_clips, 0) AS n_clips, CASE WHEN n_clips IS NULL THEN 'no clips' ELSE error END AS error FROM p LEFT JOIN f USING (project_id)"""))  # fmt: skip
def f7(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    return records.validate_dub_export(projects, full_clips(spark, d))


@query("f8_style_preset_values", "SELECT o_orderkey AS preset_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS n_kept, o_orderstatus AS color FROM orders")
def f8(spark: SparkSession, d: str) -> DataFrame:
    style = F.create_map(F.lit("color"), F.col("o_orderstatus"), F.lit("bold"), F.when(F.col("o_orderkey") % 3 != 0, "1"), F.lit("hidden"), F.lit("x"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("preset_id"), records.style_preset_values(style).alias("style"))
    return rows.select("preset_id", F.size("style").alias("n_kept"), F.col("style")["color"].alias("color"))


@query("f9_validate_project_sizes", """SELECT o_custkey AS project_id, round(sum(o_totalprice / 20), 4) AS total_duration, CAST(sum(o_orderkey * 20000) AS BIGINT) AS total_bytes,
 sum(o_totalprice / 20) <= 14400 AND sum(o_orderkey * 20000) <= 2147483648 AS ok FROM orders GROUP BY o_custkey""")  # fmt: skip
def f9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_totalprice") / 20).alias("duration"), (F.col("o_orderkey") * 20000).alias("bytes"))
    return records.validate_project_sizes(rows).withColumn("total_duration", F.round("total_duration", 4))


def voices(spark: SparkSession, d: str) -> DataFrame:
    """One voice style for each supplier, several to a voice."""
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.alias("style_id"), (s % 40).alias("voice_id"), F.concat(F.lit("  "), "s_name").alias("name"), F.when(s % 31 == 0, "").otherwise(F.concat(F.when(s % 2 == 0, "Mood ").otherwise("mood "), F.floor(s / 3) % 3)).alias("emotion"),
        F.concat("s_name", F.lit("  says")).alias("reference_text"), (s % 12).cast("double").alias("reference_seconds"), (s * 7 % 100).alias("created_at"),
    )


_VOICES = """styles AS (SELECT s_suppkey AS style_id, s_suppkey % 40 AS voice_id, '  ' || s_name AS name, CASE WHEN s_suppkey % 31 = 0 THEN '' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'Mood ' ELSE 'mood ' END || (s_suppkey // 3) % 3 END AS emotion,
 s_name || '  says' AS reference_text, CAST(s_suppkey % 12 AS DOUBLE) AS reference_seconds, s_suppkey * 7 % 100 AS created_at FROM supplier)"""


@query("f11_voice_style_checks", f"""WITH {_VOICES} SELECT style_id, trim(name) AS name, emotion, CASE WHEN emotion = '' THEN 'empty' WHEN NOT (reference_seconds BETWEEN 5 AND 10) THEN 'length'
 WHEN count(*) OVER (PARTITION BY voice_id, lower(emotion)) > 1 THEN 'emotion' END AS error FROM styles""")  # fmt: skip
def f11(spark: SparkSession, d: str) -> DataFrame:
    return records.voice_style_checks(voices(spark, d)).select("style_id", "name", "emotion", "error")


@query("j12_restore_upload_order", duck("uploads", """, n AS (SELECT upload_id, row_number() OVER (PARTITION BY upload_id ORDER BY file_id DESC) AS pos, CASE WHEN upload_id % 7 = 0 AND file_id = max(file_id) OVER (PARTITION BY upload_id) THEN 'lost' ELSE name END AS name FROM uploads),
w AS (SELECT *, row_number() OVER (PARTITION BY upload_id, name ORDER BY pos) AS k FROM n), h AS (SELECT *, row_number() OVER (PARTITION BY upload_id, name ORDER BY pos) AS k FROM uploads),
m AS (SELECT h.*, w.pos AS want, count(w.pos) OVER (PARTITION BY h.upload_id) = count(*) OVER (PARTITION BY h.upload_id) AS whole FROM h LEFT JOIN w ON w.upload_id = h.upload_id AND w.name = h.name AND w.k = h.k)
SELECT upload_id, file_id, name, row_number() OVER (PARTITION BY upload_id ORDER BY CASE WHEN whole THEN want ELSE pos END) AS new_pos FROM m"""))  # fmt: skip
def j12(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    uploads = table(spark, d, "uploads")
    w = Window.partitionBy("upload_id")
    lost = (F.col("upload_id") % 7 == 0) & (F.col("file_id") == F.max("file_id").over(w))
    names = uploads.select("upload_id", F.row_number().over(w.orderBy(F.col("file_id").desc())).alias("pos"), F.when(lost, "lost").otherwise(F.col("name")).alias("name"))
    return records.restore_upload_order(uploads, names).select("upload_id", "file_id", "name", F.col("new_pos").cast("long").alias("new_pos"))


@query("j13_voice_usage", duck("clips", " SELECT voice_style_id, count(*) AS n_clips FROM clips GROUP BY voice_style_id"))
def j13(spark: SparkSession, d: str) -> DataFrame:
    return records.voice_usage(table(spark, d, "clips"))


@query("j13_unused_voice_styles", duck("clips", " SELECT s_suppkey AS voice_style_id FROM supplier WHERE s_suppkey NOT IN (SELECT voice_style_id FROM clips)"))
def j13_unused(spark: SparkSession, d: str) -> DataFrame:
    return records.unused_voice_styles(table(spark, d, "supplier").select(F.col("s_suppkey").alias("voice_style_id")), table(spark, d, "clips"))


@query("j14_clips_with_takes", duck("clips takes", """, n AS (SELECT clip_id, count(*) AS n_takes, arg_min(actual_duration, take_index) AS first_duration FROM takes GROUP BY clip_id)
SELECT project_id, c.clip_id, row_number() OVER (PARTITION BY project_id ORDER BY start_time, c.clip_id) AS clip_pos, coalesce(n_takes, 0) AS n_takes, first_duration FROM clips c LEFT JOIN n USING (clip_id)"""))  # fmt: skip
def j14(spark: SparkSession, d: str) -> DataFrame:
    out = records.clips_with_takes(table(spark, d, "clips"), table(spark, d, "takes"))
    return out.select("project_id", "clip_id", F.col("clip_pos").cast("long").alias("clip_pos"), F.when(F.col("takes").isNull(), 0).otherwise(F.size("takes")).cast("long").alias("n_takes"), F.get("takes", F.lit(0))["actual_duration"].alias("first_duration"))


@query("j14_voices_with_styles", f"WITH {_VOICES} SELECT voice_id, CAST(count(*) AS BIGINT) AS n_styles, arg_min(style_id, created_at * 1000000 + style_id) AS first_style FROM styles GROUP BY voice_id")
def j14_voices(spark: SparkSession, d: str) -> DataFrame:
    styles = voices(spark, d)
    out = records.voices_with_styles(styles.groupBy("voice_id").agg(F.min("name").alias("name")), styles)
    return out.select("voice_id", F.size("styles").cast("long").alias("n_styles"), F.get("styles", F.lit(0))["style_id"].alias("first_style"))


@query("j15_purge_projects", duck("clips", " SELECT project_id, clip_id FROM clips WHERE project_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)"))
def j15(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("project_id"))
    return records.purge(table(spark, d, "clips"), gone, "project_id").select("project_id", "clip_id")


def edits(clips: DataFrame) -> DataFrame:
    """Edits of every second clip: of each third of these the text changes, of each fifth the pause."""
    c = F.col("clip_id")
    return clips.where("clip_id % 2 = 0").select(
        "clip_id", F.when(c % 3 == 0, "new").otherwise(F.col("text")).alias("new_text"), F.coalesce("spoken_text", "text").alias("new_spoken_text"), F.col("voice_style_id").alias("new_voice_style_id"),
        F.col("speed").alias("new_speed"), F.when(c % 5 == 0, 0.3).otherwise(F.col("pause_before")).alias("new_pause_before"), F.col("pause_after").alias("new_pause_after"),
        F.col("start_time").alias("new_start_time"), (F.col("end_time") - 0.5).alias("new_end_time"),
    )


@query("j18_clips_to_regenerate", duck("clips", f""", {_FULL}, e AS (SELECT *, clip_id % 3 = 0 OR (clip_id % 5 = 0 AND pause_before <> 0.3) AS again, end_time - 0.5 - start_time AS slot FROM full_clips WHERE clip_id % 2 = 0)
SELECT clip_id, again AS regenerate, CASE WHEN again THEN 'pending' WHEN actual_duration > 0 THEN CASE WHEN slot > 0 AND actual_duration > slot + 0.04 AND actual_duration / slot > 1.18 THEN 'needs_edit' ELSE 'fit' END ELSE fit_status END AS fit_status,
 CASE WHEN again THEN 'queued' ELSE status END AS status FROM e"""))  # fmt: skip
def j18(spark: SparkSession, d: str) -> DataFrame:
    clips = full_clips(spark, d)
    return records.clips_to_regenerate(clips, edits(clips))


def fitted_takes(spark: SparkSession, d: str) -> DataFrame:
    takes = table(spark, d, "takes")
    return takes.withColumn("fit_status", media.duration_fit(F.col("actual_duration"), F.lit(3.0))["status"]).withColumn("status", F.when(F.col("take_index") % 4 == 0, "failed").otherwise("ready"))


_TAKES = """ft AS (SELECT *, CASE WHEN actual_duration <= 0 THEN 'failed' WHEN actual_duration <= 3.04 THEN 'fit' WHEN actual_duration / 3.0 <= 1.18 THEN 'stretch' ELSE 'needs_edit' END AS fit_status FROM takes)"""


@query("w11_select_take", duck("takes", f""", {_TAKES} SELECT clip_id, arg_min(take_index, CASE WHEN take_index = 2 AND clip_id % 4 = 0 THEN 0 ELSE 100000 END + CASE WHEN fit_status = 'fit' THEN 0 ELSE 1000 END + take_index) AS take_index FROM ft GROUP BY clip_id"""))
def w11(spark: SparkSession, d: str) -> DataFrame:
    takes = fitted_takes(spark, d)
    choices = takes.where("clip_id % 4 = 0").select("clip_id").distinct().withColumn("take_index", F.lit(2))
    return records.select_take(takes, choices).select("clip_id", F.col("take_index").cast("long").alias("take_index"))


@query("c9_duration_fit", duck("takes", f", {_TAKES} SELECT clip_id, take_index, fit_status, round(CASE WHEN fit_status IN ('stretch', 'needs_edit') THEN actual_duration / 3.0 ELSE 1.0 END, 6) AS rate FROM ft"))
def c9(spark: SparkSession, d: str) -> DataFrame:
    fit = media.duration_fit(F.col("actual_duration"), F.lit(3.0))
    return table(spark, d, "takes").select("clip_id", F.col("take_index").cast("long").alias("take_index"), fit["status"].alias("fit_status"), F.round(fit["rate"], 6).alias("rate"))


@query("w12_queue_positions", duck("jobs", " SELECT job_id, row_number() OVER (PARTITION BY job_id % 8 ORDER BY created_at, job_id) AS position FROM jobs WHERE status = 'queued'"))
def w12(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").withColumn("queue", F.col("job_id") % 8)
    return records.queue_positions(jobs).select("job_id", F.col("position").cast("long").alias("position"))


@query("w13_latest_words_per_caption", duck("jobs", """, l AS (SELECT project_id, job_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) AS k FROM jobs)
SELECT project_id, CAST(CASE WHEN job_id % 15 BETWEEN 1 AND 12 THEN job_id % 15 ELSE 5 END AS INT) AS words_per_caption FROM l WHERE k = 1"""))  # fmt: skip
def w13(spark: SparkSession, d: str) -> DataFrame:
    return records.latest_words_per_caption(table(spark, d, "jobs"))


@query("a10_project_summary", duck("words", f", {_FIVE} SELECT project_id, count(*) AS caption_count FROM cap GROUP BY project_id"))
def a10(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    return records.project_summary(words.select("project_id").distinct(), five_captions(words))


@query("a11_project_audio_files", duck("clips takes", f""", {_FULL} SELECT DISTINCT project_id, audio_path FROM (SELECT project_id, audio_path FROM full_clips UNION ALL
 SELECT c.project_id, 'takes/' || t.clip_id || '-' || t.take_index FROM takes t JOIN full_clips c USING (clip_id)) WHERE audio_path IS NOT NULL"""))  # fmt: skip
def a11(spark: SparkSession, d: str) -> DataFrame:
    takes = table(spark, d, "takes").withColumn("audio_path", F.concat(F.lit("takes/"), F.col("clip_id").cast("string"), F.lit("-"), F.col("take_index").cast("string")))
    return records.project_audio_files(full_clips(spark, d), takes)


@query("k1_recent_projects", duck("jobs", " SELECT job_id, project_id FROM jobs ORDER BY created_at DESC, job_id LIMIT 30"))
def k1(spark: SparkSession, d: str) -> DataFrame:
    return records.recent_projects(table(spark, d, "jobs"), 30, "created_at", "job_id").select("job_id", "project_id")


@query("k2_list_presets", "SELECT preset_id, name FROM (SELECT p_partkey AS preset_id, p_name AS name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey % 50, p_name, p_partkey) AS k FROM part) WHERE k = 1")
def k2(spark: SparkSession, d: str) -> DataFrame:
    presets = table(spark, d, "part").select(F.col("p_partkey").alias("preset_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 50).alias("created_at"))
    return records.list_presets(presets).select("preset_id", "name")


@query("k3_recover_jobs", duck("jobs", " SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'Application restarted' END AS error FROM jobs"))
def k3(spark: SparkSession, d: str) -> DataFrame:
    return records.recover_jobs(table(spark, d, "jobs")).select("job_id", "status", "error")


@query("c6_repair_filename")
def c6(spark: SparkSession, d: str) -> DataFrame:
    """Documents' texts as names, read as Latin-1 and repaired."""
    name = F.col("text")
    broken = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", text.repair_filename(broken).alias("repaired"), name.alias("name"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 1900 + 40).alias("width"), (F.col("o_custkey") % 1060 + 40).alias("height"))


def _even(x: str) -> str:
    return f"greatest(2.0, floor(({x}) / 2 + 0.5) * 2)"


@query("c7_crop_geometry")
def c7(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("video_id")
    names = F.array(*map(F.lit, ("original", "free", "9:16", "1:1", "4:5", "16:9")))
    style = F.struct(F.get(names, (k % 6).cast("int")).alias("aspect"), (k % 101).alias("x"), (k % 97).alias("y"), (k % 60).alias("left"), (k % 50).alias("right"), (k % 20).alias("top"), (k % 10).alias("bottom"))
    rows = _sizes(spark, d).withColumn("style", media.normalize_crop(style))
    return rows.select("video_id", media.crop_geometry(F.col("width"), F.col("height"), F.col("style")).alias("g")).select("video_id", "g.*")


@query("c8_full_hd_geometry", f"""SELECT video_id, CAST({_even('width * s')} AS BIGINT) AS width, CAST({_even('height * s')} AS BIGINT) AS height FROM (SELECT *, CASE WHEN height > width THEN least(1080 / width, 1920 / height) ELSE least(1920 / width, 1080 / height) END AS s
 FROM (SELECT o_orderkey AS video_id, CAST(o_orderkey % 1900 + 40 AS DOUBLE) AS width, CAST(o_custkey % 1060 + 40 AS DOUBLE) AS height FROM orders))""")  # fmt: skip
def c8(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).select("video_id", media.full_hd_geometry(F.col("width"), F.col("height")).alias("g")).select("video_id", "g.*")


@query("c12_numbers_to_thai")
def c12(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("pay "), F.format_number("o_totalprice", 2), F.lit(" for "), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), media.numbers_to_thai(said).alias("spoken"))


@query("c13_atempo_chain")
def c13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "takes").select("clip_id", "take_index", media.atempo_chain(F.col("actual_duration")).alias("filter"))


@query("c14_transcription_estimate", """SELECT o_orderkey AS video_id, CAST(greatest(8, floor(t * CASE o_orderkey % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.55 ELSE 0.4 END + 0.5)) AS BIGINT) AS low, CAST(greatest(15, floor(t * CASE o_orderkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 1.6 ELSE 1.2 END + 0.5)) AS BIGINT) AS high
 FROM (SELECT *, CAST(o_orderkey % 500 AS DOUBLE) AS t FROM orders)""")  # fmt: skip
def c14(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("accurate", "balanced", "fast")))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), media.transcription_estimate((F.col("o_orderkey") % 500).cast("double"), F.get(names, (F.col("o_orderkey") % 3).cast("int"))).alias("e"))
    return rows.select("video_id", "e.low", "e.high")
