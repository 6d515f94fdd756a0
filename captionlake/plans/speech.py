"""Queries over words, regions, silences and a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.operators import alignment, intervals, sequences
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


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Seconds and scores rounded to six places, so that engines agree."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def reviewed(words: DataFrame) -> DataFrame:
    return words.withColumn("needs_review", F.col("score") < 0.65).withColumn("review_status", F.when(F.col("score") < 0.65, "pending").otherwise("approved"))


def ranges(words: DataFrame) -> DataFrame:
    """One range for each project: from word 20 to word 32."""
    return words.where("word_idx IN (20, 32)").groupBy("project_id").agg(F.lit(0).alias("range_idx"), F.min("start").alias("start"), F.max("end").alias("end"))


_RANGES = 'ranges AS (SELECT project_id, 0 AS range_idx, min(start) AS start, max("end") AS "end" FROM words WHERE word_idx IN (20, 32) GROUP BY project_id)'
_PAIRS = """p AS (SELECT w.project_id, w.word_idx, w.start, w."end", r.region_idx, r.start AS rs, r."end" AS re, least(w."end", r."end") - greatest(w.start, r.start) AS o
 FROM words w JOIN regions r ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end")"""


@query(
    "j1_best_region_per_word",
    duck("regions", f""", {_PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY project_id, word_idx ORDER BY o DESC, rs, region_idx) AS k FROM p)
SELECT project_id, word_idx, region_idx, round(o, 6) AS overlap FROM b WHERE k = 1 AND o / greatest(0.001, "end" - start) >= 0.45"""),
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.best_region_per_word(table(spark, d, "words"), table(spark, d, "regions"))
    return r6(out, "overlap").select("project_id", "word_idx", "region_idx", "overlap")


@query("j2_align_words_to_regions")
def j2(spark: SparkSession, d: str) -> DataFrame:
    words, regions = reviewed(table(spark, d, "words")), table(spark, d, "regions")
    return r6(alignment.align_words_to_regions(words, intervals.best_region_per_word(words, regions), regions), "start", "end", "score")


_COVER = """c AS (SELECT r.project_id, r.region_idx, r.start, r."end", count(w.word_idx) AS n_words, min(w.start) AS ws, max(w."end") AS we, coalesce(bool_or(w.score < 0.65), false) AS flagged
 FROM regions r LEFT JOIN words w ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end" GROUP BY ALL),
g AS (SELECT *, CASE WHEN n_words = 0 THEN "end" - start ELSE greatest(0.0, greatest(start, ws) - start) END AS lg, CASE WHEN n_words = 0 THEN "end" - start ELSE greatest(0.0, "end" - least("end", we)) END AS tg FROM c)"""


@query("j3_speech_coverage", duck("regions", f", {_COVER} SELECT project_id, region_idx, n_words, round(lg, 6) AS leading_gap, round(tg, 6) AS trailing_gap, round(lg + tg, 6) AS uncovered_edges FROM g"))
def j3(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.speech_coverage(table(spark, d, "words"), table(spark, d, "regions"))
    return r6(out, "leading_gap", "trailing_gap", "uncovered_edges").select("project_id", "region_idx", "n_words", "leading_gap", "trailing_gap", "uncovered_edges")


_WEAK = """weak AS (SELECT * FROM g WHERE "end" - start >= 0.8 AND (n_words = 0 OR lg > 0.55 OR tg > 0.55 OR ("end" - start <= 5 AND n_words / ("end" - start) < 3) OR flagged))"""


@query("j4_weak_regions", duck("regions", f", {_COVER}, {_WEAK} SELECT project_id, region_idx, n_words FROM weak"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    return intervals.weak_regions(reviewed(table(spark, d, "words")), table(spark, d, "regions")).select("project_id", "region_idx", "n_words")


@query(
    "j5_words_outside_speech",
    duck("regions", f""", {_PAIRS}, m AS (SELECT project_id, word_idx, max(o) AS o FROM p GROUP BY ALL)
SELECT w.project_id, w.word_idx, w.text FROM words w LEFT JOIN m USING (project_id, word_idx) WHERE coalesce(m.o, 0) / greatest(0.001, w."end" - w.start) < 0.45"""),
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    return intervals.words_outside_speech(table(spark, d, "words"), table(spark, d, "regions")).select("project_id", "word_idx", "text")


@query(
    "j6_dub_overlaps",
    duck("clips", """SELECT a.project_id, a.clip_id, b.clip_id AS other_id FROM clips a JOIN clips b ON a.project_id = b.project_id AND a.clip_id <> b.clip_id
 AND b.end_time > a.start_time + 0.001 AND b.start_time < a.end_time - 0.001"""),
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    return intervals.dub_overlaps(table(spark, d, "clips"))


@query("j7_snap_words_to_silence")
def j7(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.snap_words_to_silence(table(spark, d, "words"), table(spark, d, "silences"))
    return r6(out, "start", "end").select("project_id", "word_idx", "start", "end")


def five(words: DataFrame) -> DataFrame:
    """Words in captions of five."""
    return words.withColumn("caption_idx", F.floor(F.col("word_idx") / 5)).withColumn("word_pos", (F.col("word_idx") % 5).cast("int"))


def five_captions(words: DataFrame) -> DataFrame:
    return sequences.words_to_captions(five(words))


_FIVE = """five AS (SELECT *, CAST(word_idx // 5 AS BIGINT) AS caption_idx, CAST(word_idx % 5 AS INT) AS word_pos FROM words),
cap AS (SELECT project_id, caption_idx, min(start) AS start, arg_max("end", word_idx) AS "end", string_agg(text, ' ' ORDER BY word_idx) AS text, count(*) AS n_words FROM five GROUP BY ALL)"""
_STATE = """st AS (SELECT c.project_id, c.caption_idx AS probe_idx, c.caption_idx, min(CASE WHEN t >= w.start AND t < w."end" THEN word_pos END) AS a, max(CASE WHEN w."end" <= t THEN word_pos END) AS b, max(word_pos) AS l
 FROM (SELECT *, start + 0.3 AS t FROM cap) c JOIN five w ON w.project_id = c.project_id AND w.caption_idx = c.caption_idx WHERE t >= c.start AND t < c."end" GROUP BY ALL)"""


def _caption_at(effect: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        words = five(table(spark, d, "words"))
        captions = five_captions(table(spark, d, "words"))
        probes = captions.select("project_id", F.col("caption_idx").alias("probe_idx"), (F.col("start") + 0.3).alias("t"))
        return intervals.caption_at(probes, captions, words, effect)

    return run


query("j8_caption_at_sentence", duck("words", f", {_FIVE}, {_STATE} SELECT project_id, probe_idx, caption_idx, coalesce(a, -1) AS active_idx, l AS visible_end FROM st"))(_caption_at("sentence"))
query("j8_caption_at_word", duck("words", f", {_FIVE}, {_STATE} SELECT project_id, probe_idx, caption_idx, a AS active_idx, l AS visible_end FROM st WHERE a IS NOT NULL"))(_caption_at("word"))
query(
    "j8_caption_at_progressive",
    duck("words", f", {_FIVE}, {_STATE} SELECT project_id, probe_idx, caption_idx, coalesce(a, -1) AS active_idx, coalesce(a, b) AS visible_end FROM st WHERE coalesce(a, b) IS NOT NULL"),
)(_caption_at("progressive"))


def durations(words: DataFrame) -> DataFrame:
    """Media lengths: the last word's end and two seconds."""
    return words.groupBy("project_id").agg((F.max("end") + 2.0).alias("duration"))


_DURATIONS = 'durations AS (SELECT project_id, max("end") + 2.0 AS duration FROM words GROUP BY project_id)'


@query(
    "j9_expand_range",
    duck("regions", f""", {_RANGES}, {_DURATIONS}, e AS (SELECT a.project_id, a.range_idx, min(r.start) AS lo, arg_max(r."end", r.start) AS hi FROM ranges a JOIN regions r
 ON a.project_id = r.project_id AND a."end" > r.start AND a.start < r."end" GROUP BY ALL)
SELECT a.project_id, a.range_idx, round(greatest(0.0, greatest(a.start - 0.25, coalesce(lo, 0.0))), 6) AS start, round(least(duration, least(a."end" + 0.25, coalesce(hi, duration))), 6) AS "end"
 FROM ranges a LEFT JOIN e USING (project_id, range_idx) JOIN durations USING (project_id)"""),
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    return r6(intervals.expand_range(ranges(words), table(spark, d, "regions"), durations(words)), "start", "end")


@query(
    "f5_clip_words_to_range",
    duck("words", f""", {_RANGES} SELECT w.project_id, w.word_idx, round(greatest(w.start, r.start), 6) AS start, round(least(w."end", r."end"), 6) AS "end" FROM words w JOIN ranges r
 ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end" WHERE least(w."end", r."end") - greatest(w.start, r.start) >= 0.04"""),
)
def f5(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    return r6(intervals.clip_words_to_range(words, ranges(words)), "start", "end").select("project_id", "word_idx", "start", "end")


def replaced(spark: SparkSession, d: str) -> DataFrame:
    words, new = table(spark, d, "words"), table(spark, d, "candidate_words")
    kept = intervals.words_outside_range(words, ranges(words)).withColumn("source", F.lit(0))
    fresh = intervals.clip_words_to_range(new, ranges(words)).drop("range_idx").withColumn("source", F.lit(1))
    return kept.unionByName(fresh)


@query(
    "j10_replace_words_in_range",
    duck("candidate_words", f""", {_RANGES}, k AS (SELECT w.project_id, w.word_idx, w.text, w.start, w."end", 0 AS source FROM words w LEFT JOIN ranges r USING (project_id) WHERE r.start IS NULL OR w."end" <= r.start OR w.start >= r."end"),
n AS (SELECT w.project_id, w.word_idx, w.text, greatest(w.start, r.start) AS start, least(w."end", r."end") AS "end", 1 AS source FROM candidate_words w JOIN ranges r
 ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end" WHERE least(w."end", r."end") - greatest(w.start, r.start) >= 0.04)
SELECT project_id, word_idx, text, round(start, 6) AS start, round("end", 6) AS "end", source FROM (SELECT * FROM k UNION ALL SELECT * FROM n)"""),
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    return r6(replaced(spark, d), "start", "end").select("project_id", "word_idx", "text", "start", "end", "source")


@query("j10_replace_and_reflow")
def j10_reflow(spark: SparkSession, d: str) -> DataFrame:
    """Words replaced in a range, then grouped into captions again."""
    rows = replaced(spark, d).withColumn("word_idx", F.col("word_idx") * 2 + F.col("source"))
    out = alignment.reflow_words(sequences.split_phrases(rows), language="english")
    return r6(sequences.words_to_captions(out), "start", "end").select("project_id", "start", "end", "text", "n_words")


@query(
    "j11_retry_worklist",
    duck("regions", f""", {_COVER}, {_WEAK}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start, region_idx) AS rank FROM weak),
x AS (SELECT k.project_id, k.region_idx, k.rank, k.start, w.text, w."end" AS we, row_number() OVER (PARTITION BY k.project_id, k.region_idx ORDER BY w."end" DESC, w.word_idx DESC) AS b
 FROM k LEFT JOIN words w ON w.project_id = k.project_id AND w."end" <= k.start WHERE rank <= 12)
SELECT project_id, region_idx, CAST(rank AS INT) AS rank, CASE WHEN start - max(we) <= 0.45 THEN string_agg(text, ' ' ORDER BY b DESC) FILTER (b <= 16) END AS context FROM x GROUP BY project_id, region_idx, rank, start"""),
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    weak = intervals.weak_regions(reviewed(words), table(spark, d, "regions"))
    return intervals.retry_worklist(weak, words).select("project_id", "region_idx", "rank", "context")


@query(
    "j17_range_text_comparison",
    duck("candidate_words", f""", {_RANGES}, a AS (SELECT r.project_id, r.range_idx, string_agg(w.text, ' ' ORDER BY w.start, w.word_idx) AS t FROM ranges r JOIN words w ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end" GROUP BY ALL),
b AS (SELECT r.project_id, r.range_idx, string_agg(w.text, ' ' ORDER BY w.start, w.word_idx) AS t FROM ranges r JOIN candidate_words w ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end" GROUP BY ALL)
SELECT r.project_id, r.range_idx, coalesce(a.t, '') AS current_text, coalesce(b.t, '') AS candidate_text FROM ranges r LEFT JOIN a USING (project_id, range_idx) LEFT JOIN b USING (project_id, range_idx)"""),
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    return intervals.range_text_comparison(words, table(spark, d, "candidate_words"), ranges(words))


def _passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return reviewed(table(spark, d, "words")), table(spark, d, "candidate_words"), table(spark, d, "regions")


_HYP = """hyp AS (SELECT r.project_id, r.region_idx, regexp_replace(lower(nfc_normalize(coalesce(string_agg(w.text, '' ORDER BY w.start, w.word_idx), ''))), '[^\\p{L}\\p{N}]+', '', 'g') AS hypothesis
 FROM regions r LEFT JOIN words w ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end" GROUP BY ALL)"""


@query("p1_hypothesis_text", duck("regions", f", {_HYP} SELECT * FROM hyp"))
def p1(spark: SparkSession, d: str) -> DataFrame:
    return alignment.hypothesis_text(table(spark, d, "words"), table(spark, d, "regions"))


@query(
    "p2_hypotheses_disagree",
    duck("candidate_words regions", f""", {_HYP}, {_HYP.replace("hyp AS", "cyp AS").replace("JOIN words w", "JOIN candidate_words w")}
SELECT project_id, region_idx FROM hyp JOIN cyp USING (project_id, region_idx) WHERE hyp.hypothesis <> '' AND cyp.hypothesis <> '' AND hyp.hypothesis <> cyp.hypothesis"""),
)
def p2(spark: SparkSession, d: str) -> DataFrame:
    return alignment.hypotheses_disagree(*_passes(spark, d))


@query("p3_retry_wins")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return alignment.retry_wins(*_passes(spark, d))


@query("p4_lcs_pairs")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return alignment.lcs_pairs(*_passes(spark, d))


@query("p5_mark_region_for_review")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return alignment.mark_region_for_review(*_passes(spark, d))


@query("p6_replace_region_words")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return r6(alignment.replace_region_words(*_passes(spark, d)), "start", "end")


@query("p7_merge_passes")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return r6(alignment.merge_passes(*_passes(spark, d)), "start", "end")


@query(
    "a7_merge_speech_regions",
    duck("segments", """, s AS (SELECT *, greatest(0.0, start - 0.08) AS a, "end" + 0.08 AS b FROM segments WHERE NOT (no_speech_prob > 0.5 AND avg_logprob < -0.25) AND "end" > start),
m AS (SELECT *, max(b) OVER (PARTITION BY project_id ORDER BY segment_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM s),
i AS (SELECT *, sum(CASE WHEN a > u + 0.06 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY segment_idx) AS island FROM m)
SELECT project_id, min(segment_idx) AS region_idx, round(arg_min(a, segment_idx), 6) AS start, round(max(b), 6) AS "end" FROM i GROUP BY project_id, island"""),
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return r6(sequences.merge_speech_regions(table(spark, d, "segments")), "start", "end")


_FALLBACK = f"""{_DURATIONS}, q AS (SELECT project_id, start, "end", max("end") OVER (PARTITION BY project_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM silences WHERE "end" > start),
f AS (SELECT q.project_id, start AS s, coalesce(c, 0.0) AS c, duration, false AS tail FROM q JOIN durations USING (project_id) UNION ALL
 SELECT d.project_id, duration, coalesce(max(x."end"), 0.0), duration, true FROM durations d LEFT JOIN silences x ON x.project_id = d.project_id AND x."end" > x.start GROUP BY d.project_id, duration),
fb AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY tail, s) - 1 AS region_idx, round(greatest(0.0, c - 0.08), 6) AS start, round(CASE WHEN tail THEN duration ELSE least(duration, s + 0.08) END, 6) AS "end" FROM f WHERE s > c + 0.04)"""


@query("a8_regions_from_silences", duck("silences", f", {_FALLBACK} SELECT * FROM fb"))
def a8(spark: SparkSession, d: str) -> DataFrame:
    out = sequences.regions_from_silences(table(spark, d, "silences"), durations(table(spark, d, "words")))
    return r6(out, "start", "end").withColumn("region_idx", F.col("region_idx").cast("long"))


@query("a13_speech_regions_for_project")
def a13(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "words")
    vad = table(spark, d, "regions").where("project_id % 3 = 0")
    merged = sequences.merge_speech_regions(table(spark, d, "segments")).where("project_id % 3 = 1")
    fallback = sequences.regions_from_silences(table(spark, d, "silences"), durations(words))
    offsets = words.select("project_id").distinct().withColumn("offset", F.col("project_id") % 2 * 0.5)
    return r6(sequences.speech_regions_for_project(vad, merged, fallback, offsets), "start", "end")


def _waveform(buckets: int, name: str, oracle: bool) -> None:
    sql = duck("samples", f""", n AS (SELECT project_id, count(*) AS n FROM samples GROUP BY ALL), b AS (SELECT project_id, n, unnest(range({buckets})) AS bucket FROM n),
r AS (SELECT b.project_id, b.bucket, max(abs(s.sample)) AS raw FROM b JOIN samples s ON s.project_id = b.project_id AND s.sample_idx >= (b.bucket * n) // {buckets} AND s.sample_idx < greatest((b.bucket * n) // {buckets} + 1, ((b.bucket + 1) * n) // {buckets}) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY raw, bucket) - 1 AS r FROM r),
t AS (SELECT project_id, max(CASE WHEN r = {int((buckets - 1) * 0.95)} THEN raw END) AS p95, max(raw) AS top FROM k GROUP BY ALL)
SELECT project_id, bucket, round(greatest(0.0, least(1.0, raw / CASE WHEN p95 > 0 THEN p95 WHEN top > 0 THEN top ELSE 1.0 END)), 6) AS peak FROM r JOIN t USING (project_id)""")  # fmt: skip
    query(name, sql if oracle else None)(lambda spark, d: r6(sequences.waveform_peaks(table(spark, d, "samples"), buckets), "peak"))


_waveform(200, "a6_waveform_peaks", True)
_waveform(8000, "a6_waveform_peaks_fine", True)
