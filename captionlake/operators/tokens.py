"""Recogniser tokens to timed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.text import locale_of, segmented, thai_risk
from captionlake.operators.intervals import interval_join
from captionlake.operators.sequences import enforce_monotonic

PHRASE_GAP = 0.18
REVIEW_BELOW = 0.65


def token_spans(tokens: DataFrame, thai: bool) -> DataFrame:
    """Valid tokens with from_char and to_char in the project's running text, and gap: seconds since the token before.

    At a segment break a language with spaces gets one, unless one of the two tokens has it.
    """
    w = Window.partitionBy("project_id").orderBy("token_idx")
    rows = tokens.where("text <> '' AND start IS NOT NULL AND end IS NOT NULL AND NOT isnan(start) AND NOT isnan(end)")
    before = F.lag("text").over(w)
    pad = F.lit(0) if thai else (F.col("segment_break") & before.isNotNull() & ~before.rlike(r"\s$") & ~F.col("text").rlike(r"^\s")).cast("int")
    rows = rows.withColumn("_pad", F.coalesce(pad, F.lit(0))).withColumn("gap", F.col("start") - F.lag("end").over(w))
    rows = rows.withColumn("to_char", F.sum(F.col("_pad") + F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("from_char", F.col("to_char") - F.length("text")).drop("_pad")


def tokens_to_words(tokens: DataFrame, language: str = "th") -> DataFrame:
    """Words (project_id, word_idx, text, start, end, raw_confidence, review_score, needs_review, review_status, space_before, phrase_break).

    tokens as tokens_of() gives them. The text between white space is segmented by itself, so a word may span tokens but no
    project is one long string; each word takes its times and scores from the tokens whose characters it holds.
    """
    locale = locale_of(language)
    thai = locale.startswith("th")
    spans = token_spans(tokens, thai)
    runs = F.filter(F.split("text", r"(?<=\s)(?=\S)|(?<=\S)(?=\s)", -1), lambda x: x != "")
    pieces = spans.select("project_id", "token_idx", "from_char", F.posexplode(runs).alias("p", "piece"))
    w = Window.partitionBy("project_id", "token_idx").orderBy("p")
    pieces = pieces.withColumn("a", F.col("from_char") + F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = pieces.where(F.col("piece").rlike(r"\S")).withColumn("b", F.col("a") + F.length("piece"))
    w = Window.partitionBy("project_id").orderBy("a")
    pieces = pieces.withColumn("chunk", F.sum(F.coalesce((F.lag("b").over(w) != F.col("a")).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = pieces.groupBy("project_id", "chunk").agg(F.min("a").alias("a"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "piece"))), lambda x: x["piece"]), "").alias("text"))
    items = chunks.select("project_id", "chunk", "a", F.posexplode(segmented(F.col("text"), language)).alias("p", "i"))
    w = Window.partitionBy("project_id", "chunk").orderBy("p")
    items = items.withColumn("from_char", F.col("a") + F.coalesce(F.sum(F.length("i.text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("project_id").orderBy("from_char")
    items = items.withColumn("word_no", F.sum(F.col("i.is_word").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("word_no > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from_char", "i.text"))), lambda x: x["text"]), "")
    words = items.groupBy("project_id", "word_no").agg(
        text.alias("text"), F.min("from_char").alias("start"), F.max(F.col("from_char") + F.length("i.text")).alias("end"), F.min_by("p", "from_char").alias("p")
    )
    space = F.lit(False) if thai else (F.col("p") == 0) & (F.col("word_no") > 1)
    words = words.withColumn("space_before", space)
    right = spans.select(
        "project_id", "token_idx", F.col("from_char").alias("r_start"), F.col("to_char").alias("r_end"), F.col("start").alias("t0"), F.col("end").alias("t1"), "raw_confidence", "segment_logprob", "no_speech",
        ((F.col("gap") >= PHRASE_GAP) & F.col("segment_break")).alias("breaks"),
    )
    pairs = interval_join(words.select("project_id", "word_no", "start", "end"), right, ["project_id"], width=256.0)
    times = pairs.groupBy("project_id", "word_no").agg(
        F.min_by("t0", "token_idx").alias("t0"), F.max_by("t1", "token_idx").alias("t1"), F.avg("raw_confidence").alias("raw_confidence"), F.avg("segment_logprob").alias("logprob"),
        (F.sum(F.coalesce("no_speech", F.lit(0.0))) / F.count("*")).alias("no_speech"), F.bool_or((F.col("r_start") == F.col("start")) & F.col("breaks")).alias("breaks"),
    )
    out = words.select("project_id", "word_no", "text", "space_before").join(times, ["project_id", "word_no"])
    risky = thai_risk(F.col("text")) if thai else F.lit(False)
    sure = F.coalesce(F.least(F.lit(1.0), F.exp("logprob")), F.col("raw_confidence"))
    score = F.col("raw_confidence") * 0.78 + sure * 0.22 - F.col("no_speech") * 0.35 - F.when(risky, 0.28).otherwise(0.0)
    score = F.when(F.col("raw_confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    out = out.withColumn("review_score", score).withColumn("needs_review", risky | F.col("review_score").isNull() | (F.col("review_score") < REVIEW_BELOW))
    out = out.withColumn("review_status", F.when(F.col("needs_review"), "pending").otherwise("approved")).withColumn("phrase_break", F.coalesce("breaks", F.lit(False)) if thai else F.lit(False))
    out = out.withColumn("word_idx", F.col("word_no") - 1).withColumn("start", F.col("t0")).withColumn("end", F.greatest(F.col("t0") + 0.02, "t1"))
    out = enforce_monotonic(out)
    return out.select("project_id", "word_idx", "text", "start", "end", "raw_confidence", "review_score", "needs_review", "review_status", "space_before", "phrase_break")
