"""Queries that make, check and export captions, and scores against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.functions import media, text
from captionlake.operators import alignment, intervals, quality, records, sequences, tokens
from captionlake.plans.speech import _DURATIONS, _FIVE, durations, five, five_captions, r6, reviewed
from captionlake.plans.tables import duck, table
from captionlake.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


@query(
    "w3_group_words",
    duck("words", """, a AS (SELECT *, CASE WHEN start - lag("end") OVER w > 0.25 OR regexp_matches(lag(text) OVER w, '[.!?…]|[。！？]$') THEN 1 ELSE 0 END AS cut FROM words WINDOW w AS (PARTITION BY project_id ORDER BY word_idx)),
b AS (SELECT *, sum(cut) OVER (PARTITION BY project_id ORDER BY word_idx) AS island FROM a),
c AS (SELECT *, (row_number() OVER (PARTITION BY project_id, island ORDER BY word_idx) - 1) // 10 AS chunk FROM b),
g AS (SELECT *, dense_rank() OVER (PARTITION BY project_id ORDER BY island, chunk) - 1 AS group_idx FROM c)
SELECT project_id, group_idx, round(min(start), 6) AS start, round(arg_max("end", word_idx), 6) AS "end", string_agg(text, ' ' ORDER BY word_idx) AS text, count(*) AS n_words FROM g GROUP BY project_id, group_idx"""),
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    grouped = sequences.group_words(table(spark, d, "words"))
    return r6(sequences.words_to_captions(grouped, "group_idx"), "start", "end")


@query("w1_tokens_to_words")
def w1(spark: SparkSession, d: str) -> DataFrame:
    """Words of each project given as tokens, every third of them cut in two."""
    rows = table(spark, d, "words")
    half = F.floor(F.length("text") / 2).cast("int")
    cut = (F.col("word_idx") % 3 == 0) & (F.length("text") > 3)
    whole = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit(" "), "text").alias("t"), F.col("start").alias("s"), F.col("end").alias("e")))
    middle = (F.col("start") + F.col("end")) / 2
    two = F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit(" "), F.substring("text", F.lit(1), half)).alias("t"), F.col("start").alias("s"), middle.alias("e")),
        F.struct(F.lit(1).alias("part"), F.substring("text", half + 1, F.length("text")).alias("t"), middle.alias("s"), F.col("end").alias("e")),
    )
    parts = rows.select("project_id", "word_idx", "score", F.explode(F.when(cut, two).otherwise(whole)).alias("p"))
    token_rows = parts.select(
        "project_id", (F.col("word_idx") * 2 + F.col("p.part")).alias("token_idx"), F.col("p.t").alias("text"), F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.col("score").alias("raw_confidence"),
        F.lit(-0.2).alias("segment_logprob"), F.lit(0.1).alias("no_speech"), ((F.col("word_idx") % 8 == 0) & (F.col("word_idx") > 0) & (F.col("p.part") == 0)).alias("segment_break"),
    )
    return r6(tokens.tokens_to_words(token_rows, "english"), "start", "end", "raw_confidence", "review_score")


@query(
    "w2_enforce_monotonic",
    duck("words", """, z AS (SELECT project_id, word_idx, start - (word_idx % 4) * 0.2 AS start, "end" - (word_idx % 4) * 0.2 AS "end", row_number() OVER (PARTITION BY project_id ORDER BY word_idx) AS i FROM words),
m AS (SELECT *, 0.04 * i + greatest(0.0, max(greatest(start + 0.04, "end") - 0.04 * i) OVER (PARTITION BY project_id ORDER BY word_idx)) AS e FROM z)
SELECT project_id, word_idx, round(greatest(start, coalesce(lag(e) OVER (PARTITION BY project_id ORDER BY word_idx), 0.0)), 6) AS start, round(e, 6) AS "end" FROM m"""),
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    back = (F.col("word_idx") % 4) * 0.2
    rows = table(spark, d, "words").withColumn("start", F.col("start") - back).withColumn("end", F.col("end") - back)
    return r6(sequences.enforce_monotonic(rows), "start", "end").select("project_id", "word_idx", "start", "end")


_PHRASES = """ph0 AS (SELECT *, regexp_matches(text, '^[ๆฯ,.!?…]') AS clings, row_number() OVER (PARTITION BY project_id ORDER BY start, word_idx) > 1 AS later,
 start - lag("end") OVER w >= 0.25 OR regexp_matches(lag(text) OVER w, '[.!?…。！？]$') AS cut FROM words WHERE "end" > start WINDOW w AS (PARTITION BY project_id ORDER BY start, word_idx)),
ph AS (SELECT *, sum(CASE WHEN NOT clings AND coalesce(cut, false) THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY start, word_idx) AS phrase_idx FROM ph0)"""


@query("w4_split_phrases", duck("words", f", {_PHRASES} SELECT project_id, word_idx, phrase_idx, NOT (clings AND later) AS space_before FROM ph"))
def w4(spark: SparkSession, d: str) -> DataFrame:
    return sequences.split_phrases(table(spark, d, "words")).select("project_id", "word_idx", "phrase_idx", "space_before")


@query("w5_reflow_words")
def w5(spark: SparkSession, d: str) -> DataFrame:
    """The whole caption layout: phrases, least-cost groups, line breaks, text."""
    grouped = alignment.reflow_words(sequences.split_phrases(table(spark, d, "words")), language="english")
    lined = sequences.auto_line_break(grouped)
    return r6(sequences.words_to_captions(lined), "start", "end").select("project_id", "start", "end", "text", "n_words")


@query(
    "w6_auto_line_break",
    duck("words", """, z AS (SELECT *, word_idx // 8 AS caption_idx, length(text) + 1 AS size FROM words),
y AS (SELECT *, sum(size) OVER (PARTITION BY project_id, caption_idx) AS total, sum(size) OVER (PARTITION BY project_id, caption_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM z),
x AS (SELECT *, row_number() OVER (PARTITION BY project_id, caption_idx ORDER BY CASE WHEN before IS NULL THEN 1 ELSE 0 END, abs(total / 2.0 - before), word_idx) AS k FROM y)
SELECT project_id, word_idx, total > 32 AND before IS NOT NULL AND k = 1 AS line_break_before FROM x"""),
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "words").withColumn("caption_idx", F.floor(F.col("word_idx") / 8))
    return sequences.auto_line_break(rows).select("project_id", "word_idx", "line_break_before")


@query(
    "w7_cap_word_durations",
    duck("words", """SELECT project_id, word_idx, round(start, 6) AS start, round(CASE WHEN "end" + 0.3 - start <= m THEN "end" + 0.3 ELSE start + m END, 6) AS "end"
 FROM (SELECT *, least(0.72, greatest(0.42, 0.32 + length(text) * 0.06)) AS m FROM words)"""),
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "words").withColumn("end", F.col("end") + 0.3)
    return r6(sequences.cap_word_durations(rows), "start", "end").select("project_id", "word_idx", "start", "end")


def glossary(spark: SparkSession, d: str) -> DataFrame:
    """Lists of terms: pairs of neighbouring words of each project, some twice."""
    rows = table(spark, d, "words")
    item = F.concat_ws(" ", F.col("text"), F.lead("text").over(sequences.by_project().orderBy("word_idx")))
    both = rows.select("project_id", F.floor(F.col("word_idx") / 4).alias("item_idx"), "word_idx", item.alias("item"))
    return both.groupBy("project_id", "item_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "item"))), lambda x: x["item"]), ",").alias("text"))


_TERMS = """g0 AS (SELECT project_id, word_idx // 4 AS item_idx, word_idx, text || coalesce(' ' || lead(text) OVER (PARTITION BY project_id ORDER BY word_idx), '') AS item FROM words),
g1 AS (SELECT project_id, item_idx, string_agg(item, ',' ORDER BY word_idx) AS text FROM g0 GROUP BY ALL),
g2 AS (SELECT project_id, item_idx, unnest(string_split(text, ',')) AS raw, generate_subscripts(string_split(text, ','), 1) AS p FROM g1),
g3 AS (SELECT project_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS term, item_idx, p FROM g2 WHERE trim(raw) <> ''),
g4 AS (SELECT project_id, term, min(item_idx * 1000 + p) AS first FROM g3 GROUP BY ALL)"""


@query("w9_normalize_glossary", duck("words", f", {_TERMS} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY first) - 1 AS term_idx, term FROM g4 QUALIFY term_idx < 200"))
def w9(spark: SparkSession, d: str) -> DataFrame:
    return sequences.normalize_glossary(glossary(spark, d))


@query("w8_apply_glossary")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return r6(alignment.apply_glossary(reviewed(table(spark, d, "words")), sequences.normalize_glossary(glossary(spark, d))), "start", "end", "score")


@query(
    "w10_shift_captions",
    duck("words", f""", {_FIVE}, {_DURATIONS}, s AS (SELECT project_id, greatest(-min(start), least(any_value(duration) - max("end"), (project_id % 7 - 3) * 1.0)) AS amount FROM cap JOIN durations USING (project_id) GROUP BY project_id)
SELECT project_id, caption_idx, round(start + amount, 6) AS start, round("end" + amount, 6) AS "end" FROM cap JOIN s USING (project_id)"""),
)
def w10(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    offsets = durations(words).withColumn("offset", (F.col("project_id") % 7 - 3) * 1.0)
    return r6(sequences.shift_captions(five_captions(words), offsets), "start", "end").select("project_id", "caption_idx", "start", "end")


@query("a12_words_to_captions", duck("words", f', {_FIVE} SELECT project_id, caption_idx, round(start, 6) AS start, round("end", 6) AS "end", text, n_words FROM cap'))
def a12(spark: SparkSession, d: str) -> DataFrame:
    return r6(five_captions(table(spark, d, "words")), "start", "end")


@query("f3_validate_captions", duck("words", f""", {_FIVE}, v AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY project_id ORDER BY caption_idx), 0.0) AS before,
 CASE WHEN caption_idx % 11 = 0 THEN start ELSE "end" END AS e, CASE WHEN caption_idx % 7 = 0 THEN text || '!' ELSE text END AS t FROM cap)
SELECT project_id, caption_idx, CASE WHEN NOT (start >= 0 AND e > start AND start >= before - 0.01) THEN 'caption time' WHEN t <> text THEN 'text' END AS error FROM v"""))  # fmt: skip
def f3(spark: SparkSession, d: str) -> DataFrame:
    """Captions of five words; of every 11th the end is lost, of every 7th the text was changed."""
    rows = five(table(spark, d, "words"))
    lists = rows.groupBy("project_id", "caption_idx").agg(F.sort_array(F.collect_list(sequences.word_struct(rows))).alias("words"))
    captions = five_captions(table(spark, d, "words")).drop("n_words").join(lists, ["project_id", "caption_idx"])
    captions = captions.withColumn("end", F.when(F.col("caption_idx") % 11 == 0, F.col("start")).otherwise(F.col("end")))
    captions = captions.withColumn("text", F.when(F.col("caption_idx") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return records.validate_captions(captions).select("project_id", "caption_idx", "error")


ORACLES["f3_validate_captions"] = ORACLES["f3_validate_captions"].replace(
    'coalesce(lag("end") OVER (PARTITION BY project_id ORDER BY caption_idx), 0.0)', 'coalesce(lag(CASE WHEN caption_idx % 11 = 0 THEN start ELSE "end" END) OVER (PARTITION BY project_id ORDER BY caption_idx), 0.0)'
)


@query(
    "f4_pending_review",
    duck("words", f""", {_DURATIONS} SELECT project_id, word_idx, row_number() OVER (PARTITION BY project_id ORDER BY start, word_idx) AS review_idx, round(greatest(0.0, start - 0.6), 6) AS replay_start,
 round(least(duration, "end" + 0.6), 6) AS replay_end FROM words JOIN durations USING (project_id) WHERE score < 0.65"""),
)
def f4(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    out = r6(records.pending_review(reviewed(words), durations(words)), "replay_start", "replay_end")
    return out.select("project_id", "word_idx", F.col("review_idx").cast("long").alias("review_idx"), "replay_start", "replay_end")


@query(
    "c4_caption_read_stats",
    duck("words", f""", {_FIVE}, z AS (SELECT project_id, caption_idx, length(regexp_replace(text, '\\s', '', 'g')) AS characters, greatest(0.001, "end" - start) AS duration FROM cap)
SELECT project_id, caption_idx, characters, round(characters / duration, 6) AS cps, characters / duration > 17 AS too_fast, characters > 64 AS overflow FROM z"""),
)
def c4(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.caption_read_stats(five_captions(table(spark, d, "words")))
    return r6(rows, "cps").select("project_id", "caption_idx", "characters", "cps", "too_fast", "overflow")


_SRT = r"""lpad(CAST(floor({0}/3600)::BIGINT % 24 AS VARCHAR),2,'0') || ':' || lpad(CAST(floor({0}/60)::BIGINT % 60 AS VARCHAR),2,'0') || ':' || lpad(CAST(floor({0})::BIGINT % 60 AS VARCHAR),2,'0') || ',' || lpad(CAST(floor({0}*1000)::BIGINT % 1000 AS VARCHAR),3,'0')"""


@query(
    "s7_to_srt",
    duck("words", f""", {_FIVE}, b AS (SELECT project_id, caption_idx, CAST(caption_idx + 1 AS VARCHAR) || chr(10) || {_SRT.format("start")} || ' --> ' || {_SRT.format('"end"')} || chr(10) || text || chr(10) AS block FROM cap)
SELECT project_id, string_agg(block, chr(10) ORDER BY caption_idx) AS srt FROM b GROUP BY project_id"""),
)
def s7(spark: SparkSession, d: str) -> DataFrame:
    return files.to_srt(five_captions(table(spark, d, "words")))


def _ass(effect: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        words = five(table(spark, d, "words")).withColumn("space_before", F.lit(True))
        return files.to_ass_events(words, five_captions(table(spark, d, "words")), {"effect": effect, "animation": "pop"})

    return run


for _effect in ("sentence", "word", "progressive", "karaoke"):
    query(f"s8_ass_{_effect}")(_ass(_effect))


@query("s9_to_ass_document")
def s9(spark: SparkSession, d: str) -> DataFrame:
    projects = durations(table(spark, d, "words")).select("project_id", F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return files.to_ass_document(projects, _ass("karaoke")(spark, d), {"fontSizePct": 10})


@query("s2_parse_subtitles", duck("words", f""", {_FIVE}, {_DURATIONS} SELECT project_id AS path, caption_idx AS cue_idx, round(floor(start * 1000) / 1000, 3) AS start, round(floor("end" * 1000) / 1000, 3) AS "end", text, CAST(NULL AS VARCHAR) AS error FROM cap"""))
def s2(spark: SparkSession, d: str) -> DataFrame:
    """SRT documents read back."""
    documents = s7(spark, d).withColumnsRenamed({"project_id": "path", "srt": "text"})
    out = files.parse_subtitles(documents)
    return out.withColumns({"start": F.round("start", 3), "end": F.round("end", 3), "cue_idx": F.col("cue_idx").cast("long")})


@query("s3_subtitle_overlap_errors", duck("words", f""", {_FIVE}, z AS (SELECT project_id AS path, caption_idx AS cue_idx, start - (caption_idx % 13) * 0.1 AS start, lag("end") OVER (PARTITION BY project_id ORDER BY caption_idx) AS previous_end FROM cap)
SELECT path, cue_idx, round(start, 6) AS start FROM z WHERE start < previous_end - 0.001"""))  # fmt: skip
def s3(spark: SparkSession, d: str) -> DataFrame:
    cues = five_captions(table(spark, d, "words")).withColumnsRenamed({"project_id": "path", "caption_idx": "cue_idx"})
    cues = cues.withColumn("start", F.col("start") - (F.col("cue_idx") % 13) * 0.1)
    return r6(files.subtitle_overlap_errors(cues), "start").select("path", "cue_idx", "start")


def _past_ties(df: DataFrame) -> DataFrame:
    """Word times to six places; shares of a time often end in a 5, which engines round either way."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("word_start", "word_end")})


@query(
    "s4_captions_from_cues",
    duck("words", f""", {_FIVE}, p AS (SELECT project_id, caption_idx, start, "end", unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_pos FROM cap),
z AS (SELECT *, greatest(1, length(text)) AS size, sum(greatest(1, length(text))) OVER (PARTITION BY project_id, caption_idx) AS total, sum(greatest(1, length(text))) OVER (PARTITION BY project_id, caption_idx ORDER BY word_pos) AS upto,
 count(*) OVER (PARTITION BY project_id, caption_idx) AS n FROM p)
SELECT project_id AS path, caption_idx AS cue_idx, CAST(word_pos AS INT) AS word_pos, text, round(start + ("end" - start) * (upto - size) / total + 1e-9, 6) AS word_start,
 round(CASE WHEN word_pos = n - 1 THEN "end" ELSE start + ("end" - start) * upto / total END + 1e-9, 6) AS word_end FROM z"""),
)
def s4(spark: SparkSession, d: str) -> DataFrame:
    cues = five_captions(table(spark, d, "words")).withColumnsRenamed({"project_id": "path", "caption_idx": "cue_idx"})
    by_space = lambda c: F.transform(F.split(c, " "), lambda x, i: F.struct(x.alias("text"), (i > 0).alias("space_before")))
    out = files.captions_from_cues(cues, segment=by_space)
    return _past_ties(out).select("path", "cue_idx", "word_pos", "text", "word_start", "word_end")


@query("s5_parse_vad_log", duck("regions", """SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY region_idx) - 1 AS region_idx, round(floor(start * 100) / 100, 2) AS start, round(floor("end" * 100) / 100, 2) AS "end" FROM regions WHERE floor("end" * 100) > floor(start * 100)"""))
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Regions written as a detector's log and read back."""
    line = F.format_string("Speech segment %d: start = %d.00, end = %d.00", F.col("region_idx"), F.floor(F.col("start") * 100), F.floor(F.col("end") * 100))
    logs = table(spark, d, "regions").select("project_id", "region_idx", line.alias("line")).groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("region_idx", "line"))), lambda x: x["line"]), "\n").alias("text"))
    out = files.parse_vad_log(logs)
    return out.withColumns({"start": F.round("start", 2), "end": F.round("end", 2), "region_idx": F.col("region_idx").cast("long")})


@query("s6_parse_silence_log", duck("silences", """SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY silence_idx) - 1 AS silence_idx, round(start, 3) AS start, round("end", 3) AS "end" FROM silences"""))
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Silences written as a filter's log and read back."""
    line = F.concat(F.format_string("[f] silence_start: %.3f\n[f] silence_end: %.3f | silence_duration: 1", F.col("start"), F.col("end")))
    logs = table(spark, d, "silences").select("project_id", "silence_idx", line.alias("line")).groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("silence_idx", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return r6(files.parse_silence_log(logs), "start", "end").withColumn("silence_idx", F.col("silence_idx").cast("long"))


@query(
    "f1_drop_hallucinated_segments",
    duck("segments", "SELECT project_id, segment_idx FROM segments WHERE NOT (no_speech_prob > 0.5 AND avg_logprob < -0.25)"),
)
def f1(spark: SparkSession, d: str) -> DataFrame:
    return files.drop_hallucinated_segments(table(spark, d, "segments")).select("project_id", "segment_idx")


@query(
    "f2_drop_low_confidence_segments",
    duck("words", "SELECT project_id, word_idx // 4 AS segment_idx, round(avg(score), 6) AS mean_score FROM words GROUP BY ALL HAVING avg(score) >= 0.35"),
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    word = F.struct(F.col("text").alias("word"), F.lit(None).cast("string").alias("text"), "start", "end", F.col("score").alias("probability"))
    rows = table(spark, d, "words").withColumn("segment_idx", F.floor(F.col("word_idx") / 4))
    nested = rows.groupBy("project_id", "segment_idx").agg(F.collect_list(word).alias("words"), F.round(F.avg("score"), 6).alias("mean_score"))
    return files.drop_low_confidence_segments(nested).select("project_id", "segment_idx", "mean_score")


@query("s1_tokens_of")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Recogniser results as JSON text, parsed and taken apart into tokens."""
    word = F.struct(F.concat(F.lit(" "), "text").alias("word"), "start", "end", F.col("score").alias("probability"))
    rows = table(spark, d, "words").withColumn("segment_idx", F.floor(F.col("word_idx") / 8))
    nested = rows.groupBy("project_id", "segment_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", word.alias("w")))).alias("ws"))
    nested = nested.join(table(spark, d, "segments"), ["project_id", "segment_idx"]).select(
        "project_id", F.struct("segment_idx", "start", "end", "no_speech_prob", "avg_logprob", F.array_join(F.transform("ws", lambda x: x["w"]["word"]), "").alias("text"), F.transform("ws", lambda x: x["w"]).alias("words")).alias("s")
    )
    as_json = nested.groupBy("project_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list("s")).alias("segments"))).alias("j"))
    parsed = as_json.select("project_id", F.from_json("j", files.RESULT_SCHEMA).alias("r")).select("project_id", "r.segments", "r.transcription")
    return r6(files.tokens_of(parsed), "start", "end", "raw_confidence")


@query("s10_load_projects")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Captions stored as JSON in project rows, parsed again."""
    lists = five_captions(table(spark, d, "words")).groupBy("project_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("start", "end", "text")))).alias("captions_json"))
    rows = files.load_projects(lists).select("project_id", F.size("style").alias("style_keys"), F.posexplode("captions").alias("place", "c"))
    return r6(rows.select("project_id", "style_keys", "place", "c.start", "c.end", "c.text"), "start", "end")


def _project_rows(spark: SparkSession, d: str) -> DataFrame:
    """Projects as they are stored: every part a JSON text, each of them missing in some."""
    words, regions = table(spark, d, "words"), table(spark, d, "regions")
    listed = lambda c: F.sort_array(F.collect_list(c))
    parts = words.groupBy("project_id").agg(listed(F.struct("word_idx", "text", "score")).alias("w"))
    spans = regions.groupBy("project_id").agg(listed(F.struct("start", "end", F.col("region_idx").cast("string").alias("id"))).alias("r"))
    rules = F.transform(F.filter("w", lambda x: x["word_idx"] < 3), lambda x: F.struct(x["text"].alias("from"), F.reverse(x["text"]).alias("to")))
    unless = lambda n, c: F.when(F.col("project_id") % n != 0, F.to_json(c))
    style = F.struct(F.concat(F.lit("Font "), F.col("project_id").cast("string")).alias("font"), (F.col("project_id") % 9 + 2).cast("string").alias("fontSizePct"))
    return parts.join(spans, "project_id", "left").select(
        "project_id", unless(4, style).alias("style_json"), unless(5, F.transform("w", lambda x: x["score"])).alias("waveform_json"), unless(3, F.coalesce("r", F.expr("filter(array(named_struct('start', 0D, 'end', 0D, 'id', '')), x -> false)"))).alias("speech_regions_json"),
        unless(7, rules).alias("dub_pronunciations_json"),
    )


@query(
    "s10_load_project_columns",
    duck("regions", """, w AS (SELECT project_id, count(*) AS n, sum(score) AS total, arg_min(text, word_idx) AS first, count_if(word_idx < 3) AS rules FROM words GROUP BY project_id),
r AS (SELECT project_id, count(*) AS n, min(start) AS a, max("end") AS b FROM regions GROUP BY project_id)
SELECT w.project_id, CASE WHEN w.project_id % 4 <> 0 THEN 'Font ' || w.project_id END AS font, CASE WHEN w.project_id % 4 <> 0 THEN CAST(w.project_id % 9 + 2 AS VARCHAR) END AS size, CASE WHEN w.project_id % 5 <> 0 THEN w.n ELSE 0 END AS peaks,
 CASE WHEN w.project_id % 5 <> 0 THEN round(total, 6) END AS peak_sum, CASE WHEN w.project_id % 3 <> 0 THEN coalesce(r.n, 0) ELSE 0 END AS n_regions, CASE WHEN w.project_id % 3 <> 0 THEN round(a, 6) END AS first_start,
 CASE WHEN w.project_id % 3 <> 0 THEN round(b, 6) END AS last_end, CASE WHEN w.project_id % 7 <> 0 THEN rules ELSE 0 END AS rules, CASE WHEN w.project_id % 7 <> 0 THEN first END AS said, CASE WHEN w.project_id % 7 <> 0 THEN reverse(first) END AS spoken
 FROM w LEFT JOIN r USING (project_id)"""),
)
def s10_columns(spark: SparkSession, d: str) -> DataFrame:
    """Style, waveform, regions and pronunciations of stored projects, parsed again."""
    rows = files.load_projects(_project_rows(spark, d))
    size = lambda c: F.size(c).cast("long")
    total = F.when(F.size("waveform") > 0, F.aggregate("waveform", F.lit(0.0), lambda a, x: a + x))
    return r6(
        rows.select(
            "project_id", F.col("style")["font"].alias("font"), F.col("style")["fontSizePct"].alias("size"), size("waveform").alias("peaks"), total.alias("peak_sum"), size("speech_regions").alias("n_regions"),
            F.array_min(F.transform("speech_regions", lambda x: x["start"])).alias("first_start"), F.array_max(F.transform("speech_regions", lambda x: x["end"])).alias("last_end"), size("pronunciations").alias("rules"),
            F.get("pronunciations", F.lit(0))["from"].alias("said"), F.get("pronunciations", F.lit(0))["to"].alias("spoken"),
        ),
        "peak_sum", "first_start", "last_end",
    )


@query("s11_ground_truth")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Both passes of each project stored as the JSON of a ground truth fixture, parsed again: the reference's words."""
    words = table(spark, d, "words")
    listed = words.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", "text", "start", "end"))).alias("w"))
    second = quality.project_text(table(spark, d, "candidate_words"), "second")
    reference = F.struct(F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("words"))
    text_of = F.to_json(F.struct(F.lit("en").alias("language"), reference.alias("reference"), F.struct(F.col("second").alias("text")).alias("candidate")))
    fixtures = listed.join(second, "project_id").select(F.col("project_id").alias("file"), text_of.alias("text"))
    rows = files.parse_ground_truth(fixtures).select("file", "language", F.length("candidate.text").alias("candidate_chars"), F.posexplode("reference.words").alias("word_idx", "w"))
    return r6(rows.select("file", "language", "candidate_chars", F.col("word_idx").cast("long").alias("word_idx"), "w.text", "w.start", "w.end"), "start", "end")


def _baseline(words: DataFrame) -> DataFrame:
    return words.where("word_idx % 5 <> 0")


@query("a1_word_error_rate")
def a1(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    both = quality.project_text(words, "a").join(quality.project_text(table(spark, d, "candidate_words"), "b"), "project_id")
    return r6(both.select("project_id", quality.word_error_rate(quality.metric_tokens(F.col("a"), "english"), quality.metric_tokens(F.col("b"), "english")).alias("wer")), "wer")


_KEY = "regexp_replace(lower(string_agg({0}.text, '' ORDER BY {0}.word_idx)), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')"


# DuckDB's distance counts bytes: letters of more than one byte stand as marks, of which the cleaned texts have none
_ONE_BYTE = """translate({}, 'ßäçèéêíñóöüàáâëìîïòôùúû', '!"#$%&()*+,-./:;<=>?@[]')"""


@query(
    "a2_char_error_rate",
    duck("candidate_words", f""", a AS (SELECT project_id, word_idx // 20 AS part, {_KEY.format("words")} AS t FROM words GROUP BY ALL), b AS (SELECT project_id, word_idx // 20 AS part, {_KEY.format("candidate_words")} AS t FROM candidate_words GROUP BY ALL)
SELECT project_id, part, round(CASE WHEN length(a.t) > 0 THEN levenshtein({_ONE_BYTE.format("a.t")}, {_ONE_BYTE.format("b.t")}) / length(a.t) ELSE CAST(length(b.t) > 0 AS INT) END, 6) AS cer FROM a JOIN b USING (project_id, part)"""),
)
def a2(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 20 words."""

    def passages(name: str, tag: str) -> DataFrame:
        rows = table(spark, d, name).withColumn("part", F.floor(F.col("word_idx") / 20))
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"])
        return rows.groupBy("project_id", "part").agg(F.array_join(ordered, "").alias(tag))

    both = passages("words", "a").join(passages("candidate_words", "b"), ["project_id", "part"])
    return r6(both.select("project_id", "part", quality.char_error_rate(F.col("a"), F.col("b")).alias("cer")), "cer")


@query(
    "a3_median_boundary_error",
    duck("candidate_words", """, a AS (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY word_idx) AS k FROM (SELECT *, regexp_replace(lower(text), '[\\p{P}\\p{S}\\s]+', '', 'g') AS key FROM words)),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY word_idx) AS k FROM (SELECT *, regexp_replace(lower(text), '[\\p{P}\\p{S}\\s]+', '', 'g') AS key FROM candidate_words)),
o AS (SELECT project_id, unnest([abs(b.start - a.start), abs(b."end" - a."end")]) AS o FROM a JOIN b USING (project_id, key, k))
SELECT p.project_id, round(median(o), 6) AS median_boundary_error FROM (SELECT DISTINCT project_id FROM words) p LEFT JOIN o USING (project_id) GROUP BY p.project_id"""),
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    return r6(quality.median_boundary_error(table(spark, d, "words"), table(spark, d, "candidate_words")), "median_boundary_error")


@query("a4_evaluate_fixtures")
def a4(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    out = quality.evaluate_fixtures(words, _baseline(words), table(spark, d, "candidate_words"), table(spark, d, "regions"), "english")
    return r6(out, "baseline_wer", "candidate_wer", "baseline_cer", "candidate_cer", "median_boundary_error")


def _own_regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions of every second project, and the candidate pass's for all: every third of them half as long."""
    regions = table(spark, d, "regions")
    half = F.when(F.col("region_idx") % 3 == 0, (F.col("start") + F.col("end")) / 2).otherwise(F.col("end"))
    return regions.where("project_id % 2 = 0"), regions.withColumn("end", half)


@query("a4_evaluate_without_regions")
def a4_without(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures of which half have no regions of their own."""
    words, (own, second) = table(spark, d, "words"), _own_regions(spark, d)
    out = quality.evaluate_fixtures(words, _baseline(words), table(spark, d, "candidate_words"), own, "english", second)
    return r6(out, "baseline_wer", "candidate_wer", "baseline_cer", "candidate_cer", "median_boundary_error")


@query("a5_quality_report")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return r6(quality.quality_report(a4(spark, d)), "baseline_wer", "candidate_wer", "wer_improvement", "median_boundary_error")


@query("p8_reconcile_edited_caption")
def p8(spark: SparkSession, d: str) -> DataFrame:
    """Captions of five words whose text is replaced by the candidate pass's words at the same places."""
    rows = five(table(spark, d, "words"))
    old = rows.groupBy("project_id", "caption_idx").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("old"))
    new = five(table(spark, d, "candidate_words")).groupBy("project_id", "caption_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", "text"))).alias("n"))
    both = five_captions(table(spark, d, "words")).join(old, ["project_id", "caption_idx"]).join(new, ["project_id", "caption_idx"])
    pieces = F.transform("n", lambda x, i: F.struct(x["text"].alias("text"), (i > 0).alias("space_before")))
    out = both.select("project_id", "caption_idx", F.posexplode(alignment.reconcile_edited_caption(F.col("start"), F.col("end"), F.col("old"), pieces)).alias("word_pos", "w")).select("project_id", "caption_idx", "word_pos", "w.*")
    return r6(out, "start", "end")


@query(
    "p9_retime_edited_caption",
    ORACLES["s4_captions_from_cues"].replace("project_id AS path, caption_idx AS cue_idx,", "project_id, caption_idx,"),
)
def p9(spark: SparkSession, d: str) -> DataFrame:
    """Captions without words, timed anew by characters."""
    rows = five_captions(table(spark, d, "words"))
    pieces = F.transform(F.split("text", " "), lambda x, i: F.struct(x.alias("text"), (i > 0).alias("space_before")))
    none = F.array().cast("array<struct<start:double,end:double,text:string>>")
    out = rows.select("project_id", "caption_idx", F.posexplode(alignment.reconcile_edited_caption(F.col("start"), F.col("end"), none, pieces)).alias("word_pos", "w"))
    return _past_ties(out.select("project_id", "caption_idx", "word_pos", F.col("w.text").alias("text"), F.col("w.start").alias("word_start"), F.col("w.end").alias("word_end")))


@query("j16_apply_review_decisions", duck("words", """SELECT project_id, word_idx, CASE WHEN word_idx % 6 = 0 THEN text || '!' ELSE text END AS text,
 CASE WHEN word_idx % 6 = 0 THEN 'edited' WHEN word_idx % 3 = 0 THEN 'approved' WHEN score < 0.65 THEN 'pending' ELSE 'approved' END AS review_status,
 score < 0.65 AND word_idx % 3 <> 0 AS needs_review FROM words"""))  # fmt: skip
def j16(spark: SparkSession, d: str) -> DataFrame:
    words = reviewed(table(spark, d, "words"))
    asked = words.where("word_idx % 3 = 0").select("project_id", "word_idx", F.when(F.col("word_idx") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat(F.lit("  "), "text")).alias("new_text"))
    return records.apply_review_decisions(words, asked).select("project_id", "word_idx", "text", "review_status", "needs_review")


@query("a9_review_summary", duck("words", """SELECT project_id, word_idx // 5 AS caption_idx, count_if(score < 0.65) AS flagged, CASE WHEN count_if(score < 0.65) > 0 THEN 'review' WHEN bool_or(word_idx % 10 < 5) THEN 'clear' ELSE 'legacy' END AS label
 FROM words GROUP BY ALL"""))  # fmt: skip
def a9(spark: SparkSession, d: str) -> DataFrame:
    words = five(reviewed(table(spark, d, "words"))).withColumn("review_score", F.when(F.col("word_idx") % 10 < 5, F.col("score"))).withColumn("raw_confidence", F.col("score"))
    return records.review_summary(words).select("project_id", "caption_idx", "flagged", "label")


@query("f10_captions_past_end", duck("words", f""", {_FIVE}, {_DURATIONS} SELECT c.project_id, round(max("end"), 6) AS last_end FROM cap c JOIN durations USING (project_id) GROUP BY c.project_id, duration HAVING max("end") > duration - (c.project_id % 4) + 0.1"""))
def f10(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    media_ends = durations(words).withColumn("duration", F.col("duration") - F.col("project_id") % 4)
    return r6(records.captions_past_end(five_captions(words), media_ends), "last_end").select("project_id", "last_end")


@query("k4_migrate_words_v3", duck("words", """SELECT project_id, word_idx, CASE WHEN project_id % 4 < 3 OR word_idx % 2 = 0 THEN score END AS raw_confidence,
 CASE WHEN project_id % 4 < 3 AND word_idx % 3 = 0 THEN CASE WHEN score < 0.65 THEN 'pending' ELSE 'approved' END WHEN word_idx % 3 = 0 THEN 'other' ELSE 'edited' END AS review_status, greatest(project_id % 4, 3) AS schema_version FROM words"""))  # fmt: skip
def k4(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words").withColumn("schema_version", F.col("project_id") % 4).withColumn("confidence", F.col("score")).withColumn("raw_confidence", F.when(F.col("word_idx") % 2 == 0, F.col("score")))
    words = words.withColumn("needs_review", F.col("score") < 0.65).withColumn("review_status", F.when(F.col("word_idx") % 3 == 0, "other").otherwise("edited")).withColumn("timing_source", F.lit("manual"))
    return records.migrate_words_v3(words).select("project_id", "word_idx", "raw_confidence", "review_status", F.col("schema_version").cast("long").alias("schema_version"))


@query("c1_word_segments")
def c1(spark: SparkSession, d: str) -> DataFrame:
    """Words of every caption by dictionary segmentation."""
    rows = five_captions(table(spark, d, "words")).select("project_id", "caption_idx", F.posexplode(text.word_segments(F.col("text"), "english")).alias("word_pos", "w"))
    return rows.select("project_id", "caption_idx", "word_pos", "w.text", "w.space_before")


@query("c2_grapheme_count", duck("words", "SELECT project_id, word_idx, length(text) AS graphemes FROM words"))
def c2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "words").select("project_id", "word_idx", text.grapheme_count(F.col("text")).alias("graphemes"))


@query("c3_attachment_flags", duck("words", "SELECT project_id, word_idx, regexp_matches(text, '^[ๆฯ,.!?…]') AS attaches, regexp_matches(text, '^[ะ-ฺ็-๎]|^ๆ+$') AS risk FROM words"))
def c3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "words").select("project_id", "word_idx", text.attaches_to_previous(F.col("text")).alias("attaches"), text.thai_risk(F.col("text")).alias("risk"))


@query("c5_time_codes", duck("words", f"""SELECT project_id, word_idx, {_SRT.format("start")} AS srt, CAST(floor(start/3600)::BIGINT AS VARCHAR) || ':' || lpad(CAST(floor(start/60)::BIGINT % 60 AS VARCHAR),2,'0') || ':' || lpad(CAST(floor(start)::BIGINT % 60 AS VARCHAR),2,'0') || '.' ||
 lpad(CAST(floor((start % 1) * 100)::BIGINT AS VARCHAR),2,'0') AS ass FROM words"""))  # fmt: skip
def c5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "words").select("project_id", "word_idx", text.srt_time(F.col("start")).alias("srt"), text.ass_time(F.col("start")).alias("ass"))


@query("c10_parse_pronunciations", duck("words", """SELECT project_id, word_idx, text AS source, reverse(text) AS target FROM words WHERE trim(text) <> '' AND NOT regexp_matches(text, '[=→]') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY word_idx) <= 100"""))
def c10(spark: SparkSession, d: str) -> DataFrame:
    """Rules written as lines of text and read back."""
    rules = _rules(spark, d)
    return rules.select("project_id", F.posexplode("rules").alias("p", "r"), "places").select("project_id", F.get("places", F.col("p")).alias("word_idx"), "r.source", "r.target")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "words").where("NOT text RLIKE '[=→]'")
    line = F.concat("text", F.when(F.col("word_idx") % 2 == 0, " = ").otherwise(" => "), F.reverse("text"))
    lists = rows.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", line.alias("line")))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lists.select("project_id", media.parse_pronunciations(lines).alias("rules"), F.transform("l", lambda x: x["word_idx"]).alias("places"))


@query("c11_apply_pronunciations")
def c11(spark: SparkSession, d: str) -> DataFrame:
    """All captions of each project spoken by its own rules."""
    rows = five_captions(table(spark, d, "words")).join(_rules(spark, d), "project_id", "left")
    return rows.select("project_id", "caption_idx", media.apply_pronunciations(F.col("text"), F.coalesce("rules", F.expr("filter(array(named_struct('source', '', 'target', '')), r -> false)"))).alias("spoken"))


_MOOD_WORDS = "|".join(words for _, words in media.MOODS).split("|")
_MOOD_CASE = " ".join(f"WHEN regexp_matches(lower(said), '{words}') THEN '{name}'" for name, words in media.MOODS)


@query(
    "c15_emotion_of_captions",
    duck("words", f""", {_FIVE}, k AS (SELECT {_MOOD_WORDS} AS k),
s AS (SELECT project_id, caption_idx, text || CASE WHEN caption_idx % 3 = 0 THEN k[caption_idx % len(k) + 1] ELSE '' END || CASE WHEN caption_idx % 6 = 0 THEN ' ' || k[(caption_idx * 7 + project_id) % len(k) + 1] ELSE '' END AS said FROM cap, k)
SELECT project_id, caption_idx, CASE {_MOOD_CASE} ELSE 'normal' END AS mood FROM s"""),
)
def c15_captions(spark: SparkSession, d: str) -> DataFrame:
    """Whole captions: most without a mood's word, some with one of all of them, some with two."""
    pick = lambda i: F.get(F.array(*map(F.lit, _MOOD_WORDS)), (i % len(_MOOD_WORDS)).cast("int"))
    i = F.col("caption_idx")
    said = F.concat("text", F.when(i % 3 == 0, pick(i)).otherwise(""), F.when(i % 6 == 0, F.concat(F.lit(" "), pick(i * 7 + F.col("project_id")))).otherwise(""))
    return five_captions(table(spark, d, "words")).select("project_id", "caption_idx", media.emotion_category(said).alias("mood"))


@query("c15_emotion_category")
def c15(spark: SparkSession, d: str) -> DataFrame:
    """Every word with a mood's name before or after it."""
    names = F.get(F.array(*map(F.lit, ("ตลกมาก", "ตกใจ", "เข้ม", "โมโห", "เหงา", "ปกติ"))), (F.col("word_idx") % 6).cast("int"))
    said = F.when(F.col("word_idx") % 2 == 0, F.concat("text", names)).otherwise(F.concat(names, "text"))
    return table(spark, d, "words").select("project_id", "word_idx", media.emotion_category(said).alias("mood"))
