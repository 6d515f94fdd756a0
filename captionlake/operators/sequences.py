"""Operators along the word sequence of a project: windows, islands, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.text import attaches_to_previous, grapheme_count

LINE_CHARS = 32
PAUSE = 0.25


def by_project():
    return Window.partitionBy("project_id")


def _flag(df: DataFrame, name: str, missing: bool) -> Column:
    return F.coalesce(F.col(name), F.lit(missing)) if name in df.columns else F.lit(missing)


def joined_text(words: str = "words") -> Column:
    """Caption text from an array of words (text, space_before, line_break_before)."""
    gap = lambda w: F.when(w["line_break_before"], "\n").when(w["space_before"], " ").otherwise("")
    return F.array_join(F.transform(words, lambda w, i: F.concat(F.when(i == 0, "").otherwise(gap(w)), w["text"])), "")


def word_struct(df: DataFrame) -> Column:
    return F.struct(
        "start", "word_idx", "end", "text", _flag(df, "space_before", True).alias("space_before"), _flag(df, "line_break_before", False).alias("line_break_before")
    )


def words_to_captions(words: DataFrame, group: str = "caption_idx") -> DataFrame:
    """One caption for each (project_id, group): first start, last end, text, number of words."""
    lists = words.groupBy("project_id", group).agg(F.sort_array(F.collect_list(word_struct(words))).alias("words"))
    return lists.select(
        "project_id", group, F.element_at("words", 1)["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), joined_text().alias("text"), F.size("words").alias("n_words")
    )


def enforce_monotonic(words: DataFrame, least: float = 0.04) -> DataFrame:
    """start and end such that words don't overlap and last ``least`` at least, in the order of word_idx.

    The fold start = max(start, end before), end = max(start + least, end) in closed form: end_i = least * i + max over k <= i of
    (max(start_k + least, end_k) - least * k), and the same from 0.
    """
    w = by_project().orderBy("word_idx")
    i = F.row_number().over(w)
    rows = words.withColumn("_i", i).withColumn("_room", F.greatest(F.col("start") + least, F.col("end")) - least * F.col("_i"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", least * F.col("_i") + F.greatest(F.lit(0.0), F.max("_room").over(upto)))
    before = F.coalesce(F.lag("_end").over(w), F.lit(0.0))
    return rows.withColumn("_start", F.greatest(F.col("start"), before)).withColumn("start", F.col("_start")).withColumn("end", F.col("_end")).drop("_i", "_room", "_end", "_start")


def group_words(words: DataFrame, size: int = 5, pause: float = PAUSE) -> DataFrame:
    """Add group_idx: cut at phrase breaks, pauses over ``pause`` and sentence marks, then at 2 * size words (1 for size 1)."""
    w = by_project().orderBy("word_idx")
    before = F.lag("text").over(w)
    cut = _flag(words, "phrase_break", False) | (F.col("start") - F.lag("end").over(w) > pause) | before.rlike("[.!?…]|[。！？]$")
    rows = words.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    most = 1 if size == 1 else 2 * size
    chunk = F.floor((F.row_number().over(Window.partitionBy("project_id", "_island").orderBy("word_idx")) - 1) / most)
    rows = rows.withColumn("_chunk", chunk)
    new = ((F.lag("_island").over(w) != F.col("_island")) | (F.lag("_chunk").over(w) != F.col("_chunk"))).cast("int")
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(0)))
    return rows.withColumn("group_idx", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut", "_island", "_chunk", "_new")


def split_phrases(words: DataFrame, pause: float = PAUSE) -> DataFrame:
    """Valid words in order of start with phrase_idx; marks that cling to the word before lose their space and break."""
    w = by_project().orderBy("start", "word_idx")
    rows = words.where("end > start AND NOT isnan(start) AND NOT isnan(end)").withColumn("_clings", attaches_to_previous(F.col("text")) & (F.row_number().over(w) > 1))
    rows = rows.withColumn("space_before", _flag(words, "space_before", True) & ~F.col("_clings")).withColumn("phrase_break", _flag(words, "phrase_break", False) & ~F.col("_clings"))
    other = F.lit(False)
    if "region_idx" in words.columns:
        other = F.coalesce(F.lag("region_idx").over(w) != F.col("region_idx"), F.lit(False))
    cut = other | F.col("phrase_break") | (F.col("start") - F.lag("end").over(w) >= pause) | F.lag("text").over(w).rlike("[.!?…。！？]$")
    rows = rows.withColumn("_new", (~attaches_to_previous(F.col("text")) & F.coalesce(cut, F.lit(False))).cast("int"))
    return rows.withColumn("phrase_idx", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_clings")


def auto_line_break(words: DataFrame, group: str = "caption_idx", chars: int = LINE_CHARS) -> DataFrame:
    """Add line_break_before: in captions of more than ``chars`` graphemes, before the word nearest to the middle (the first of equals)."""
    key = Window.partitionBy("project_id", group)
    w = key.orderBy("word_idx")
    rows = words.withColumn("_size", grapheme_count(F.col("text")) + _flag(words, "space_before", True).cast("int"))
    rows = rows.withColumn("_all", F.sum("_size").over(key)).withColumn("_before", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    off = F.abs(F.col("_all") / 2 - F.col("_before"))
    best = F.min_by("word_idx", F.when(F.col("_before").isNotNull(), F.struct(off.alias("off"), F.col("word_idx")))).over(key)
    hit = (F.col("_all") > chars) & F.col("_before").isNotNull() & (F.col("word_idx") == best)
    return rows.withColumn("line_break_before", F.coalesce(hit, F.lit(False))).drop("_size", "_all", "_before")


def cap_word_durations(words: DataFrame) -> DataFrame:
    """Words that last longer than their graphemes allow end earlier."""
    most = F.least(F.lit(0.72), F.greatest(F.lit(0.42), F.lit(0.32) + grapheme_count(F.col("text")) * 0.06))
    return words.withColumn("end", F.when(F.col("end") - F.col("start") <= most, F.col("end")).otherwise(F.col("start") + most))


def normalize_glossary(glossary: DataFrame, limit: int = 200) -> DataFrame:
    """Terms (project_id, term_idx, term) from texts (project_id, item_idx, text): cut at commas and line feeds, each once, the first ``limit``.

    An array column aliases gives further terms after those of its item, uncut.
    """
    found = F.coalesce(F.split("text", "[,\n]"), F.array().cast("array<string>"))
    if "aliases" in glossary.columns:
        found = F.concat(found, F.coalesce("aliases", F.array().cast("array<string>")))
    parts = glossary.select("project_id", "item_idx", F.posexplode(found).alias("p", "raw"))
    terms = parts.withColumn("term", F.trim(F.regexp_replace("raw", r"\s+", " "))).where("term <> ''")
    once = terms.groupBy("project_id", "term").agg(F.min(F.struct("item_idx", "p")).alias("first"))
    ranked = once.withColumn("term_idx", F.row_number().over(by_project().orderBy("first")) - 1)
    return ranked.where(F.col("term_idx") < limit).select("project_id", "term_idx", "term")


def shift_captions(captions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Captions moved by a project's offset, clamped so that none starts before 0 or ends after its duration (null: open).

    An array column words (with start, end and perhaps timing_source) moves along.
    """
    edge = captions.groupBy("project_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    most = F.coalesce(F.col("duration") - F.col("hi"), F.lit(float("inf")))
    amount = edge.join(offsets, "project_id").select("project_id", F.greatest(-F.col("lo"), F.least(most, F.coalesce("offset", F.lit(0.0)))).alias("amount"))
    moved = captions.join(amount, "project_id").withColumn("start", F.col("start") + F.col("amount")).withColumn("end", F.col("end") + F.col("amount"))
    source = lambda c: F.when(c == "estimated", "estimated").otherwise("manual")
    if "timing_source" in captions.columns:
        moved = moved.withColumn("timing_source", source(F.col("timing_source")))
    if "words" in captions.columns:
        names = captions.schema["words"].dataType.elementType.names
        shifted = lambda w: w.withField("start", w["start"] + F.col("amount")).withField("end", w["end"] + F.col("amount"))
        again = lambda w: shifted(w).withField("timing_source", source(w["timing_source"])) if "timing_source" in names else shifted(w)
        moved = moved.withColumn("words", F.transform("words", again))
    return moved.drop("amount")


def merge_speech_regions(segments: DataFrame, pad: float = 0.08, join: float = 0.06) -> DataFrame:
    """Speech regions from recogniser segments: without silent ones (missing scores count as 0), padded, merged where they nearly touch."""
    rows = segments.where("NOT (coalesce(no_speech_prob, 0) > 0.5D AND coalesce(avg_logprob, 0) < -0.25D) AND end > start")
    rows = rows.withColumn("a", F.greatest(F.lit(0.0), F.col("start") - pad)).withColumn("b", F.col("end") + pad)
    w = by_project().orderBy("segment_idx")
    upto = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("a") > upto + join).cast("int"), F.lit(0)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("project_id", "_island").agg(F.min("segment_idx").alias("region_idx"), F.min_by("a", "segment_idx").alias("start"), F.max("b").alias("end"))
    return merged.select("project_id", "region_idx", "start", "end")


def regions_from_silences(silences: DataFrame, durations: DataFrame, pad: float = 0.08) -> DataFrame:
    """The sound between silences (project_id, start, end) of media of a given duration, padded into the silence."""
    quiet = silences.where("end > start").select("project_id", "start", "end")
    tail = durations.select("project_id", F.col("duration").alias("start"), F.lit(None).cast("double").alias("end"))
    w = by_project().orderBy("start", F.col("end").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = quiet.unionByName(tail).join(durations, "project_id").withColumn("cursor", F.coalesce(F.max("end").over(w), F.lit(0.0)))
    # a silence that starts after the media's end comes after the tail row; the tail must see all silences
    last = by_project().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("cursor", F.when(F.col("end").isNull(), F.coalesce(F.max("end").over(last), F.lit(0.0))).otherwise(F.col("cursor")))
    rows = rows.where(F.col("start") > F.col("cursor") + 0.04)
    end = F.when(F.col("end").isNull(), F.col("duration")).otherwise(F.least(F.col("duration"), F.col("start") + pad))
    rows = rows.withColumn("region_idx", F.row_number().over(by_project().orderBy(F.col("end").isNull(), "start", "end")) - 1)
    return rows.select("project_id", "region_idx", F.greatest(F.lit(0.0), F.col("cursor") - pad).alias("start"), end.alias("end"))


def speech_regions_for_project(vad: DataFrame, merged: DataFrame, fallback: DataFrame, offsets: DataFrame) -> DataFrame:
    """Of each project the detector's regions, else those of segments, else those between silences; moved by the clip's offset."""
    names = ["project_id", "region_idx", "start", "end"]
    second = merged.join(vad.select("project_id").distinct(), "project_id", "left_anti")
    third = fallback.join(vad.select("project_id").union(merged.select("project_id")).distinct(), "project_id", "left_anti")
    found = vad.select(*names).unionByName(second.select(*names)).unionByName(third.select(*names)).join(offsets, "project_id", "left")
    move = F.coalesce("offset", F.lit(0.0))
    return found.select("project_id", "region_idx", (F.col("start") + move).alias("start"), (F.col("end") + move).alias("end"))


def waveform_peaks(samples: DataFrame, buckets: int = 2400) -> DataFrame:
    """Peaks (project_id, bucket, peak): largest absolute sample of each bucket over the 95 percent peak, at most 1."""
    count = max(200, min(8000, int(buckets or 2400)))
    sizes = samples.groupBy("project_id").agg(F.count("*").alias("n"))
    loud = samples.select("project_id", F.col("sample_idx").cast("long").alias("j"), F.abs("sample").cast("double").alias("x")).join(sizes, "project_id")
    # with fewer samples than buckets a sample stands in every bucket whose first place it is
    first = F.floor((F.col("j") * count + F.col("n") - 1) / F.col("n"))
    last = F.floor(((F.col("j") + 1) * count - 1) / F.col("n"))
    many = loud.where(F.col("n") >= count).withColumn("bucket", last)
    few = loud.where(F.col("n") < count).withColumn("bucket", F.explode(F.sequence(first, last)))
    raw = many.unionByName(few).groupBy("project_id", "bucket").agg(F.max("x").alias("raw"))
    ranked = raw.withColumn("r", F.row_number().over(by_project().orderBy("raw", "bucket")) - 1)
    pick = ranked.groupBy("project_id").agg(F.max(F.when(F.col("r") == int((count - 1) * 0.95), F.col("raw"))).alias("p95"), F.max("raw").alias("top"))
    reference = F.when(F.col("p95") > 0, F.col("p95")).when(F.col("top") > 0, F.col("top")).otherwise(1.0)
    return raw.join(pick, "project_id").select("project_id", "bucket", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") / reference)).alias("peak"))
