"""Scores of transcripts against human ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.distance import text_distance, token_error_rate
from captionlake.functions.text import grapheme_count, metric_key, word_segments
from captionlake.operators.intervals import words_outside_speech
from captionlake.operators.lineage import cut


def metric_tokens(text: Column, language: str = "th") -> Column:
    """Cleaned words of a text, without empty ones."""
    return F.filter(F.transform(word_segments(text, language), lambda w: metric_key(w["text"])), lambda t: t != "")


def plain_tokens(text: Column) -> Column:
    """The same by white space only."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), metric_key), lambda t: t != "")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Of two token arrays."""
    return token_error_rate(reference, hypothesis)


#: Up to so many cells of its table the built-in distance is taken; both give the same numbers.
SHORT = 1 << 18


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of the cleaned texts, by character, over the reference's length; of an empty reference 1 where the other is not."""
    a, b = metric_key(reference), metric_key(hypothesis)
    long = F.length(a).cast("long") * F.length(b) > SHORT
    far = F.coalesce(text_distance(F.when(long, a), F.when(long, b)), F.when(~long, F.levenshtein(a, b)))
    return F.when(F.length(a) > 0, far / F.length(a)).otherwise((F.length(b) > 0).cast("double"))


def median_boundary_error(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Per project the median of all start and end differences between the k-th uses of a word in both; null without matches."""
    w = Window.partitionBy("project_id", "key").orderBy("word_idx")

    def ranked(rows: DataFrame, tag: str) -> DataFrame:
        keyed = rows.withColumn("key", metric_key(F.col("text")))
        return keyed.select("project_id", "key", F.row_number().over(w).alias("k"), F.col("start").alias(f"s{tag}"), F.col("end").alias(f"e{tag}"))

    both = ranked(reference, "a").join(ranked(hypothesis, "b"), ["project_id", "key", "k"])
    off = both.select("project_id", F.explode(F.array(F.abs(F.col("sb") - F.col("sa")), F.abs(F.col("eb") - F.col("ea")))).alias("off"))
    found = off.groupBy("project_id").agg(F.expr("percentile(off, 0.5D)").alias("median_boundary_error"))
    return reference.select("project_id").distinct().join(found, "project_id", "left")


def project_text(words: DataFrame, name: str) -> DataFrame:
    """All words of a project joined by spaces."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"])
    return words.groupBy("project_id").agg(F.array_join(ordered, " ").alias(name))


def evaluate_fixtures(reference: DataFrame, baseline: DataFrame, candidate: DataFrame, regions: DataFrame, language: str = "th", candidate_regions: DataFrame | None = None) -> DataFrame:
    """One row of scores for each project that has a reference; words are those of the language's segmentation.

    Projects without regions of their own take those of the candidate pass.
    """
    if candidate_regions is not None:
        names = ["project_id", "region_idx", "start", "end"]
        regions = regions.select(*names).unionByName(candidate_regions.select(*names).join(regions.select("project_id").distinct(), "project_id", "left_anti"))
    texts = project_text(reference, "reference").join(project_text(baseline, "baseline"), "project_id", "left").join(project_text(candidate, "candidate"), "project_id", "left")
    tokens = texts.select(
        "project_id", *[metric_tokens(F.coalesce(c, F.lit("")), language).alias(c) for c in ("reference", "baseline", "candidate")],
        char_error_rate(F.col("reference"), F.coalesce("baseline", F.lit(""))).alias("baseline_cer"), char_error_rate(F.col("reference"), F.coalesce("candidate", F.lit(""))).alias("candidate_cer"),
    )
    silent = words_outside_speech(candidate, regions).groupBy("project_id").agg(F.count("*").alias("silent_word_count"))
    scored = tokens.select(
        "project_id", word_error_rate(F.col("reference"), F.col("baseline")).alias("baseline_wer"), word_error_rate(F.col("reference"), F.col("candidate")).alias("candidate_wer"), "baseline_cer", "candidate_cer"
    )
    out = scored.join(median_boundary_error(reference, candidate), "project_id", "left").join(silent, "project_id", "left")
    return out.withColumn("silent_word_count", F.coalesce("silent_word_count", F.lit(0)))


#: Parts that a range of values is cut into in one step.
CUTS = 512


def value_at_rank(rows: DataFrame, name: str, rank: int) -> float | None:
    """The value of a column with ``rank`` smaller or equal values before it (null and NaN don't count), exactly; None where there are not so many.

    A range that holds it is cut into CUTS parts, which are counted where the rows are; the part that holds the rank is the next range. A
    double has 64 bits and a step settles nine of them at least, so a few passes over the values do, whatever their number and
    spread, and no task sees more than its own rows and CUTS counts.
    """
    values = rows.where(F.col(name).isNotNull() & ~F.isnan(name)).select(F.col(name).cast("double").alias("v"))
    edge = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if edge[2] <= rank:
        return None
    lo, hi, before = edge[0], edge[1], 0  # the value lies in lo..hi, behind ``before`` smaller ones
    while lo < hi:
        inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
        step = hi / CUTS - lo / CUTS
        part = F.least(F.lit(CUTS - 1), F.greatest(F.lit(0), F.floor((F.col("v") - lo) / step))) if step > 0 else F.lit(0)
        counts = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("part").collect()
        if len(counts) == 1:  # too narrow to be cut: the least value of the range and the rest
            n = inside.where(F.col("v") == lo).count()
            if rank < before + n:
                return lo
            before, lo = before + n, inside.where(F.col("v") > lo).agg(F.min("v")).first()[0]
            continue
        for r in counts:
            if rank < before + r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            before += r["n"]
    return lo


def quality_report(scores: DataFrame) -> DataFrame:
    """One row: mean error rates, improvement, upper median of boundary errors, silent words, and whether the gates are passed."""
    scores = cut(scores.select("baseline_wer", "candidate_wer", "silent_word_count", "median_boundary_error"))  # read in several passes
    row = scores.agg(F.avg("baseline_wer").alias("baseline_wer"), F.avg("candidate_wer").alias("candidate_wer"), F.sum("silent_word_count").alias("silent_word_count"))
    row = row.withColumn("wer_improvement", F.when(F.col("baseline_wer") != 0, 1 - F.col("candidate_wer") / F.col("baseline_wer")).otherwise(0.0))
    known = scores.where(F.col("median_boundary_error").isNotNull() & ~F.isnan("median_boundary_error")).count()
    row = row.withColumn("median_boundary_error", F.lit(value_at_rank(scores, "median_boundary_error", known // 2)).cast("double"))
    passed = (F.col("wer_improvement") >= 0.15) & F.col("median_boundary_error").isNotNull() & (F.col("median_boundary_error") <= 0.2) & (F.col("silent_word_count") == 0)
    return row.withColumn("passed", F.coalesce(passed, F.lit(False)))


def caption_read_stats(captions: DataFrame, cps: float = 17, lines: int = 2, line_chars: int = 32) -> DataFrame:
    """characters (without spaces), cps, lines, too_fast and overflow of captions."""
    size = grapheme_count(F.regexp_replace("text", r"\s", ""))
    rows = captions.withColumn("characters", size).withColumn("cps", F.col("characters") / F.greatest(F.lit(0.001), F.col("end") - F.col("start"))).withColumn("lines", F.size(F.split("text", "\n")))
    return rows.withColumn("too_fast", F.col("cps") > cps).withColumn("overflow", (F.col("lines") > lines) | (F.col("characters") > lines * line_chars))
