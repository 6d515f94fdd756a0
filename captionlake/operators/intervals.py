"""Interval joins and what is built on them.

Rows have project_id, start and end (seconds); regions and silences too. Two intervals meet when each starts before the other
ends. Joins are on the project and a time bucket, so no project is one nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 30.0
WORD_OVERLAP = 0.45


def _bucketed(df: DataFrame, name: str, start: str, end: str, width: float) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.ceil(F.col(end) / width) - 1)
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: float = BUCKET, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows with equal keys whose intervals meet, once each. The right side's other columns must differ from the left's;
    its interval is r_start, r_end. A pair belongs to the later of the two first buckets."""
    a = _bucketed(left, "_bucket", start, end, width)
    b = _bucketed(right, "_bucket", "r_start", "r_end", width)
    joined = a.join(b, [*keys, "_bucket"])
    owner = F.greatest(F.floor(F.col(start) / width), F.floor(F.col("r_start") / width))
    return joined.where((F.col(end) > F.col("r_start")) & (F.col(start) < F.col("r_end")) & (F.col("_bucket") == owner)).drop("_bucket")


def as_right(df: DataFrame, **names: str) -> DataFrame:
    """df with its interval as r_start, r_end and other columns renamed."""
    return df.withColumnsRenamed({"start": "r_start", "end": "r_end"} | names)


def _overlap() -> Column:
    return F.least("end", "r_end") - F.greatest("start", "r_start")


def best_region_per_word(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words with the region that they overlap most (of equals the earliest), where that is WORD_OVERLAP of the word at least."""
    pairs = interval_join(words, as_right(regions.select("project_id", "region_idx", "start", "end")), ["project_id"])
    best = pairs.groupBy("project_id", "word_idx", "start", "end").agg(
        F.max_by(F.struct("region_idx", "r_start", "r_end", _overlap().alias("overlap")), F.struct(_overlap(), -F.col("r_start"), -F.col("region_idx"))).alias("b")
    )
    best = best.select("project_id", "word_idx", "start", "end", "b.region_idx", F.col("b.r_start").alias("region_start"), F.col("b.r_end").alias("region_end"), "b.overlap")
    return best.where(F.col("overlap") / F.greatest(F.lit(0.001), F.col("end") - F.col("start")) >= WORD_OVERLAP)


def words_outside_speech(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words of which no single region covers WORD_OVERLAP."""
    pairs = interval_join(words, as_right(regions.select("project_id", "start", "end")), ["project_id"])
    most = pairs.groupBy("project_id", "word_idx").agg(F.max(_overlap()).alias("overlap"))
    joined = words.join(most, ["project_id", "word_idx"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    return joined.where(F.col("overlap") / F.greatest(F.lit(0.001), F.col("end") - F.col("start")) < WORD_OVERLAP)


def speech_coverage(words: DataFrame, regions: DataFrame) -> DataFrame:
    """For every region: n_words that meet it, leading_gap, trailing_gap, uncovered_edges (without words twice its length), flagged (one waits for review)."""
    pairs = interval_join(words, as_right(regions), ["project_id"])
    waits = F.coalesce(F.col("needs_review"), F.lit(False)) if "needs_review" in words.columns else F.lit(False)
    if "review_status" in words.columns:
        waits = waits | F.coalesce(F.col("review_status") == "pending", F.lit(False))
    flagged = F.coalesce(F.bool_or(waits), F.lit(False))
    inside = pairs.groupBy("project_id", "region_idx").agg(F.count("*").alias("n_words"), F.min("start").alias("w_start"), F.max("end").alias("w_end"), flagged.alias("flagged"))
    joined = regions.join(inside, ["project_id", "region_idx"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0))).withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    length = F.col("end") - F.col("start")
    lead = F.when(F.col("n_words") == 0, length).otherwise(F.greatest(F.lit(0.0), F.greatest("start", "w_start") - F.col("start")))
    trail = F.when(F.col("n_words") == 0, length).otherwise(F.greatest(F.lit(0.0), F.col("end") - F.least("end", "w_end")))
    return joined.withColumn("leading_gap", lead).withColumn("trailing_gap", trail).withColumn("uncovered_edges", F.col("leading_gap") + F.col("trailing_gap")).drop("w_start", "w_end")


def weak_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions of 0.8 s or more with no words, a gap over 0.55 s at an edge, few words a second, or flagged words."""
    length = F.col("end") - F.col("start")
    few = (length <= 5) & (F.col("n_words") / length < 3)
    weak = (F.col("n_words") == 0) | (F.col("leading_gap") > 0.55) | (F.col("trailing_gap") > 0.55) | few | F.col("flagged")
    return speech_coverage(words, regions).where((length >= 0.8) & weak)


def dub_overlaps(clips: DataFrame) -> DataFrame:
    """Pairs (clip_id, other_id) of a project's clips that overlap by more than 0.001 s, both ways round."""
    left = clips.select("project_id", "clip_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    right = clips.select("project_id", F.col("clip_id").alias("other_id"), F.col("start_time").alias("r_start"), F.col("end_time").alias("r_end"))
    pairs = interval_join(left, right, ["project_id"])
    return pairs.where("clip_id <> other_id AND r_end > start + 0.001D AND r_start < end - 0.001D").select("project_id", "clip_id", "other_id")


def snap_words_to_silence(words: DataFrame, silences: DataFrame, least: float = 0.015) -> DataFrame:
    """Words trimmed by the silences that they meet: hidden inside one, cut at either side, and of a word around one its longer side."""
    quiet = silences.select("project_id", "start", "end").where("end > start AND NOT isnan(start) AND NOT isnan(end)")
    sound = words.where("end > start AND NOT isnan(start) AND NOT isnan(end)")
    pairs = interval_join(sound, as_right(quiet), ["project_id"])
    lists = pairs.groupBy("project_id", "word_idx").agg(F.sort_array(F.collect_list(F.struct("r_start", "r_end"))).alias("quiet"))
    joined = sound.join(lists, ["project_id", "word_idx"], "left")
    first = F.struct(F.col("start").alias("a"), F.col("end").alias("b"), F.lit(False).alias("hidden"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        a, b, q, r = acc["a"], acc["b"], s["r_start"], s["r_end"]
        skip = acc["done"] | (r <= a)
        over = q >= b
        inside = (a >= q) & (b <= r)
        head = (a >= q) & (a < r) & (b > r)
        tail = (a < q) & (b > q) & (b <= r)
        around = (a < q) & (b > r)
        left = around & (q - a >= b - r)
        new_a = F.when(skip | over | inside, a).when(head | (around & ~left), r).otherwise(a)
        new_b = F.when(skip | over | inside, b).when(tail | left, q).otherwise(b)
        return F.struct(new_a.alias("a"), new_b.alias("b"), (acc["hidden"] | (~skip & ~over & inside)).alias("hidden"), (acc["done"] | (~skip & (over | inside | left))).alias("done"))

    out = joined.withColumn("s", F.aggregate(F.coalesce("quiet", F.array().cast("array<struct<r_start:double,r_end:double>>")), first, step))
    kept = out.where("NOT s.hidden AND s.b - s.a >= %r AND NOT (end - start > 0.25D AND s.b - s.a < 0.08D)" % least)
    return kept.withColumn("start", F.col("s.a")).withColumn("end", F.col("s.b")).drop("s", "quiet")


def clip_words_to_range(words: DataFrame, ranges: DataFrame, least: float = 0.04) -> DataFrame:
    """Words cut to the ranges (project_id, range_idx, start, end) that they meet; pieces shorter than ``least`` go."""
    pairs = interval_join(words, as_right(ranges), ["project_id"])
    cut = pairs.withColumn("start", F.greatest("start", "r_start")).withColumn("end", F.least("end", "r_end")).drop("r_start", "r_end")
    return cut.where(F.col("end") - F.col("start") >= least)


def words_outside_range(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Words that meet no range of their project."""
    met = interval_join(words, as_right(ranges), ["project_id"]).select("project_id", "word_idx").distinct()
    return words.join(met, ["project_id", "word_idx"], "left_anti")


def expand_range(ranges: DataFrame, regions: DataFrame, duration: DataFrame, pad: float = 0.25) -> DataFrame:
    """Ranges widened by ``pad``, but not beyond the first and last speech region that the range meets, nor the media."""
    pairs = interval_join(ranges, as_right(regions.select("project_id", "start", "end")), ["project_id"])
    edge = pairs.groupBy("project_id", "range_idx").agg(F.min("r_start").alias("lo"), F.max_by("r_end", "r_start").alias("hi"))
    joined = ranges.join(edge, ["project_id", "range_idx"], "left").join(duration, "project_id")
    low, high = F.greatest(F.col("start") - pad, F.coalesce("lo", F.lit(0.0))), F.least(F.col("end") + pad, F.coalesce("hi", "duration"))
    return joined.select("project_id", "range_idx", F.greatest(F.lit(0.0), low).alias("start"), F.least("duration", high).alias("end"))


def caption_at(probes: DataFrame, captions: DataFrame, words: DataFrame, effect: str = "sentence") -> DataFrame:
    """For probes (project_id, probe_idx, t): the caption that shows at t, its active word and the last word to show, or no row.

    A caption without words shows as a whole (both -1) in the effects that show whole captions. words carry caption_idx and word_pos (their place in the caption).
    """
    points = probes.withColumn("start", F.col("t")).withColumn("end", F.col("t") + 1e-9)
    hit = interval_join(points, as_right(captions.select("project_id", "caption_idx", "start", "end")), ["project_id"]).where("t >= r_start AND t < r_end")
    inside = hit.select("project_id", "probe_idx", "t", "caption_idx").join(words.select("project_id", "caption_idx", "word_pos", "start", "end"), ["project_id", "caption_idx"], "left")
    state = inside.groupBy("project_id", "probe_idx", "t", "caption_idx").agg(
        F.min(F.when(F.expr("t >= start AND t < end"), F.col("word_pos"))).alias("active"), F.max(F.when(F.expr("end <= t"), F.col("word_pos"))).alias("before"),
        F.max("word_pos").alias("last"),
    )
    active = F.coalesce("active", F.lit(-1))
    visible = F.coalesce("active", "before", F.lit(-1)) if effect == "progressive" else F.coalesce("last", F.lit(-1))
    out = state.select("project_id", "probe_idx", "caption_idx", active.alias("active_idx"), visible.alias("visible_end"))
    if effect == "word":
        return out.where("active_idx >= 0")
    return out.where("visible_end >= 0") if effect == "progressive" else out


def retry_worklist(weak: DataFrame, words: DataFrame, limit: int = 12, context: int = 16, reach: float = 0.45) -> DataFrame:
    """The first ``limit`` weak regions of a project with the text of the words before, where one ends within ``reach`` of the region.

    Words before a region are those that end by its start: an as-of join on the running number of ended words.
    """
    ranked = weak.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("start", "region_idx"))).where(F.col("rank") <= limit)
    by_end = Window.partitionBy("project_id").orderBy("end", "word_idx")
    recent = words.withColumn("context", F.concat_ws(" ", F.collect_list("text").over(by_end.rowsBetween(1 - context, 0))))
    rows = recent.select("project_id", F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("region_idx"), F.lit(None).cast("double").alias("region_end"), F.lit(None).cast("int").alias("rank"), "context", F.col("end").alias("word_end"))
    asks = ranked.select("project_id", F.col("start").alias("at"), F.lit(1).alias("kind"), "region_idx", F.col("end").alias("region_end"), "rank", F.lit(None).cast("string").alias("context"), F.lit(None).cast("double").alias("word_end"))
    w = Window.partitionBy("project_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asks).withColumn("context", F.last("context", True).over(w)).withColumn("word_end", F.last("word_end", True).over(w)).where("kind = 1")
    near = F.col("at") - F.col("word_end") <= reach
    return both.select("project_id", "region_idx", F.col("at").alias("start"), F.col("region_end").alias("end"), "rank", F.when(near, F.col("context")).alias("context"))


def range_text_comparison(words: DataFrame, candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each range its current text beside the candidate's, words joined by spaces."""

    def text(rows: DataFrame, name: str) -> DataFrame:
        pairs = interval_join(rows.select("project_id", "word_idx", "text", "start", "end"), as_right(ranges), ["project_id"])
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", "word_idx", "text"))), lambda x: x["text"])
        return pairs.groupBy("project_id", "range_idx").agg(F.array_join(ordered, " ").alias(name))

    out = ranges.select("project_id", "range_idx").join(text(words, "current_text"), ["project_id", "range_idx"], "left")
    return out.join(text(candidates, "candidate_text"), ["project_id", "range_idx"], "left").na.fill("", ["current_text", "candidate_text"])
