"""Readers and writers: recogniser JSON, subtitle files, logs, project tables, ground truth; SRT and ASS text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.functions.media import half_up
from captionlake.functions.text import ass_color, ass_escape, ass_time, grapheme_count, srt_time, subtitle_seconds, word_segments

# Lines of the ASS format that are the same in every document, and the shape of word animations: percent of size at the start and
# at the turn (at full intensity), place of the turn, axes, and the fade of a whole line.
ASS_HEAD = ["[Script Info]", "ScriptType: v4.00+"]
ASS_STYLES = ["WrapStyle: 2", "ScaledBorderAndShadow: yes", "[V4+ Styles]"]
ASS_STYLE_FORMAT = "Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding"
ASS_EVENT_FORMAT = "Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"
DIALOGUE = ("Dialogue: 0,", ",Default,,0,0,0,,")
RESET = "{\\fscx100\\fscy100\\alpha&H00&}"
ANIMATIONS = {"pop": (35, 8, 0.62, ("x", "y"), "\\fad(40,70)"), "bounce": (30, 18, 0.5, ("y",), "\\fad(35,70)")}
EFFECTS = ("sentence", "word", "progressive", "karaoke")
FONT, COLOR, HIGHLIGHT = "Leelawadee UI", "FFFFFF", "B8FF38"

# Fields of recogniser results, noise tags, style defaults.
_WORDS = "array<struct<word:string,text:string,start:double,end:double,probability:double>>"
_TOKENS = "array<struct<text:string,token:string,t0:double,t1:double,start:double,end:double,p:double,probability:double,offsets:struct<`from`:double,`to`:double>>>"
_SEGMENTS = f"array<struct<text:string,start:double,end:double,no_speech_prob:double,avg_logprob:double,offsets:struct<`from`:double,`to`:double>,words:{_WORDS},tokens:{_TOKENS}>>"
RESULT_SCHEMA = f"segments {_SEGMENTS}, transcription {_SEGMENTS}"
NOISE_TAG = "(?is)^[\\[(].*(music|noise|silence|applause|ดนตรี|เสียงรบกวน).*[\\])]$"
_WORD_FIELDS = "array<struct<id:string,text:string,start:double,end:double,confidence:double,rawConfidence:double,reviewScore:double,needsReview:boolean,reviewStatus:string,timingSource:string,spaceBefore:boolean,phraseBreak:boolean>>"
CAPTIONS_SCHEMA = f"array<struct<id:string,start:double,end:double,text:string,words:{_WORD_FIELDS}>>"
FIXTURE_SCHEMA = (
    f"language string, reference struct<text:string,words:{_WORD_FIELDS}>, baseline struct<text:string>, candidate struct<text:string,words:{_WORD_FIELDS}>, "
    "speechRegions array<struct<id:string,start:double,end:double>>"
)
BOM = "﻿"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def drop_hallucinated_segments(segments: DataFrame) -> DataFrame:
    """Without segments that are silent and doubtful, or only a bracketed noise tag."""
    silent = (F.coalesce("no_speech_prob", F.lit(0.0)) > 0.5) & (F.coalesce("avg_logprob", F.lit(0.0)) < -0.25)
    tag = F.trim(F.coalesce("text", F.lit(""))).rlike(NOISE_TAG) if "text" in segments.columns else F.lit(False)
    return segments.where(~silent & ~tag)


def drop_low_confidence_segments(segments: DataFrame, least: float = 0.35) -> DataFrame:
    """Without segments whose words (nested, with probability) have a mean finite probability under ``least``."""
    sure = F.filter(F.transform(F.coalesce("words", F.array().cast(_WORDS)), lambda w: w["probability"]), _finite)
    mean = F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure)
    return segments.where((F.size(sure) == 0) | (mean >= least))


def tokens_of(results: DataFrame, key: str = "project_id") -> DataFrame:
    """Timed tokens (key, token_idx, text, start, end, raw_confidence, segment_logprob, no_speech, segment_break) of recogniser results.

    A segment gives its words, else its tokens (hundredths, or offsets in milliseconds, or seconds), else itself as one token.
    """
    flat = results.select(key, F.posexplode(F.coalesce("segments", "transcription")).alias("segment_idx", "s")).select(key, "segment_idx", "s.*")
    flat = drop_low_confidence_segments(drop_hallucinated_segments(flat))
    words = F.transform("words", lambda w: F.struct(F.coalesce(w["word"], w["text"]).alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("raw")))

    def token(t: Column) -> Column:
        at = lambda exact, ms, plain: F.coalesce(exact / 100, F.when(plain.isNull(), ms / 1000).otherwise(F.when(ms.isNotNull(), plain / 1000).otherwise(plain)))
        return F.struct(
            F.coalesce(t["text"], t["token"]).alias("text"), at(t["t0"], t["offsets"]["from"], t["start"]).alias("start"), at(t["t1"], t["offsets"]["to"], t["end"]).alias("end"),
            F.coalesce(t["p"], t["probability"]).alias("raw"),
        )

    start = F.coalesce(F.col("start"), F.col("offsets.from") / 1000, F.lit(0.0))
    end = F.coalesce(F.col("end"), F.col("offsets.to") / 1000, start + 0.2)
    whole = F.when(F.trim("text") != "", F.array(F.struct("text", start.alias("start"), end.alias("end"), F.exp("avg_logprob").alias("raw"))))
    timed = lambda a: F.filter(a, lambda t: _finite(t["start"]) & _finite(t["end"]) & (t["end"] >= t["start"]))
    rows = F.when(F.size("words") > 0, timed(words)).when(F.size("tokens") > 0, timed(F.transform("tokens", token))).otherwise(whole)
    out = flat.select(key, "segment_idx", "avg_logprob", "no_speech_prob", F.posexplode(rows).alias("place", "t"))
    w = Window.partitionBy(key).orderBy("segment_idx", "place")
    out = out.withColumn("token_idx", F.row_number().over(w) - 1)
    return out.select(
        key, "token_idx", "t.text", "t.start", "t.end", F.col("t.raw").alias("raw_confidence"), F.coalesce("avg_logprob", F.lit(0.0)).alias("segment_logprob"),
        F.coalesce("no_speech_prob", F.lit(0.0)).alias("no_speech"), ((F.col("place") == 0) & (F.col("token_idx") > 0)).alias("segment_break"),
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of a folder of recogniser results, one JSON file a project; project_id is the file's path."""
    results = spark.read.schema(RESULT_SCHEMA).json(path, multiLine=True)
    return tokens_of(results.select(F.col("_metadata.file_path").alias("project_id"), "segments", "transcription"))


def parse_subtitles(files: DataFrame, key: str = "path", text_col: str = "text") -> DataFrame:
    """Cues (key, cue_idx, start, end, text, error) of SRT and VTT texts; a bad time line is a row with an error, a text without cues
    is one row with the error ``no cues``, an empty text no row."""
    source = F.trim(F.regexp_replace(F.regexp_replace(F.col(text_col), f"^{BOM}", ""), "\r\n?", "\n"), F.lit(" \n\t\x0b\x0c\r"))
    blocks = F.split(F.regexp_replace(source, "(?i)^WEBVTT[^\n]*\n+", ""), "\n{2,}")
    rows = files.select(key, F.posexplode_outer(blocks).alias("block_idx", "block"))
    lines = F.transform(F.split("block", "\n"), lambda x: F.rtrim(x))
    rows = rows.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda x: x.contains("-->")), True))
    rows = rows.where((F.col("at") > 0) & ~F.get("lines", F.lit(0)).rlike(r"^NOTE(\s|$)"))
    pattern = r"^\s*(\S+)\s*-->\s*(\S+)(?:\s+.*)?$"
    timing = F.get("lines", (F.col("at") - 1).cast("int"))
    rows = rows.withColumn("start", subtitle_seconds(F.regexp_extract(timing, pattern, 1))).withColumn("end", subtitle_seconds(F.regexp_extract(timing, pattern, 2)))
    body = F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines")), "\n")
    rows = rows.withColumn("text", F.trim(F.regexp_replace(body, "<[^>]+>", ""), F.lit(" \n\t\x0b\x0c\r")))
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("end") <= F.col("start"))
    rows = rows.withColumn("error", F.when(bad, "bad time")).where(bad | (F.col("text") != ""))
    cues = rows.withColumn("cue_idx", F.row_number().over(Window.partitionBy(key).orderBy("block_idx")) - 1).select(key, "cue_idx", "start", "end", "text", "error")
    none = files.where(source != "").select(key).join(cues.select(key).distinct(), key, "left_anti")
    return cues.unionByName(none.select(key, F.lit("no cues").alias("error")), allowMissingColumns=True)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of a folder of .srt and .vtt files."""
    return parse_subtitles(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def subtitle_overlap_errors(cues: DataFrame, key: str = "path") -> DataFrame:
    """Cues that start before the cue before them ends."""
    before = F.lag("end").over(Window.partitionBy(key).orderBy("cue_idx"))
    return cues.withColumn("previous_end", before).where(F.col("start") < F.col("previous_end") - 0.001)


def captions_from_cues(cues: DataFrame, language: str = "th", key: str = "path", segment=None) -> DataFrame:
    """Words of cues, each with a share of the cue's time by its graphemes; all wait for review. segment: text column to array of
    (text, space_before), by default the dictionary segmentation."""
    pieces = (segment or (lambda c: word_segments(c, language)))(F.regexp_replace("text", "\n+", " "))
    rows = cues.select(key, "cue_idx", "start", "end", F.posexplode(pieces).alias("word_pos", "p"))
    w = Window.partitionBy(key, "cue_idx").orderBy("word_pos")
    rows = rows.withColumn("size", F.greatest(F.lit(1), grapheme_count(F.col("p.text")))).withColumn("total", F.sum("size").over(Window.partitionBy(key, "cue_idx")))
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    share = lambda n: F.col("start") + (F.col("end") - F.col("start")) * n / F.col("total")
    stop = F.when(F.lead("size").over(w).isNull(), F.col("end")).otherwise(share(upto))
    return rows.select(
        key, "cue_idx", "word_pos", F.col("p.text").alias("text"), F.col("p.space_before").alias("space_before"), share(upto - F.col("size")).alias("word_start"), stop.alias("word_end"),
        F.lit(True).alias("needs_review"), F.lit("pending").alias("review_status"), F.lit("estimated").alias("timing_source"),
    )


def parse_vad_log(logs: DataFrame, key: str = "project_id", text_col: str = "text") -> DataFrame:
    """Regions of speech detector logs (hundredths of seconds), numbered after empty ones have gone."""
    pattern = r"Speech segment\s+[0-9]+:\s+start\s*=\s*([0-9.]+),\s+end\s*=\s*([0-9.]+)"
    hits = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(2)).alias("b"))
    rows = logs.select(key, F.posexplode(hits).alias("p", "h")).select(key, "p", F.expr("try_cast(h.a AS double) / 100").alias("start"), F.expr("try_cast(h.b AS double) / 100").alias("end"))
    rows = rows.where("end > start")
    return rows.withColumn("region_idx", F.row_number().over(Window.partitionBy(key).orderBy("p")) - 1).select(key, "region_idx", "start", "end")


def parse_silence_log(logs: DataFrame, key: str = "project_id", text_col: str = "text") -> DataFrame:
    """Silences of a filter's log: each end with the latest start since the end before."""
    lines = logs.select(key, F.posexplode(F.split(text_col, "\r?\n")).alias("p", "line"))
    number = lambda name: F.expr(f"try_cast(nullif(regexp_extract(line, '{name}:\\\\s*([0-9.]+)', 1), '') AS double)")
    lines = lines.withColumn("s", number("silence_start")).withColumn("e", number("silence_end"))
    w = Window.partitionBy(key).orderBy("p")
    lines = lines.withColumn("run", F.coalesce(F.sum(F.col("e").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    latest = F.last("s", True).over(Window.partitionBy(key, "run").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("start", latest).where("e IS NOT NULL AND e > start")
    return rows.withColumn("silence_idx", F.row_number().over(Window.partitionBy(key).orderBy("p")) - 1).select(key, "silence_idx", "start", F.col("e").alias("end"))


def load_projects(projects: DataFrame) -> DataFrame:
    """Project rows with their JSON columns parsed; missing ones are empty."""
    parsed = {
        "captions": ("captions_json", CAPTIONS_SCHEMA, "[]"), "style": ("style_json", "map<string,string>", "{}"), "waveform": ("waveform_json", "array<double>", "[]"),
        "speech_regions": ("speech_regions_json", "array<struct<id:string,start:double,end:double>>", "[]"),
        "pronunciations": ("dub_pronunciations_json", "array<struct<`from`:string,`to`:string>>", "[]"),
    }
    for name, (source, kind, default) in parsed.items():
        value = F.coalesce(F.col(source), F.lit(default)) if source in projects.columns else F.lit(default)
        projects = projects.withColumn(name, F.from_json(value, kind))
    return projects


def parse_ground_truth(fixtures: DataFrame, key: str = "file", text_col: str = "text") -> DataFrame:
    """Fixtures (key and JSON text) as language, reference, baseline, candidate and speechRegions."""
    return fixtures.select(key, F.from_json(text_col, FIXTURE_SCHEMA).alias("f")).select(key, "f.*")


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Fixture files of a folder, with their names."""
    return spark.read.schema(FIXTURE_SCHEMA).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file"), "*")


# --- sinks ------------------------------------------------------------------------------------------------------------------


def srt_blocks(captions: DataFrame) -> DataFrame:
    """captions with their 1-based number in the project and their block of SRT text."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("caption_idx"))
    rows = captions.withColumn("cue_no", n)
    return rows.withColumn("block", F.concat(F.col("cue_no").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n")))


def to_srt(captions: DataFrame) -> DataFrame:
    """One SRT document for each project."""
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("cue_no", "block"))), lambda x: x["block"])
    return srt_blocks(captions).groupBy("project_id").agg(F.array_join(blocks, "\n").alias("srt"))


def write_srt(captions: DataFrame, path: str) -> None:
    """A folder project_id=... with one BOM-prefixed SRT text for each project."""
    to_srt(captions).select("project_id", F.concat(F.lit(BOM), "srt").alias("value")).repartition("project_id").write.partitionBy("project_id").text(path)


class Style:
    """Settings of a caption style as columns: of one dict for all projects, or of a map column ``style`` (text to text) of each row.

    Missing settings have defaults; numbers are kept in their limits, and text that is no number counts as 0, as do settings that are not
    among the choices count as the default.
    """

    def __init__(self, fixed: dict | None = None):
        self.fixed = fixed

    def text(self, key: str, default: str = "") -> Column:
        if self.fixed is not None:
            value = self.fixed.get(key)
            return F.lit(str(value) if value or value == 0 else default)
        return F.coalesce(F.nullif(F.element_at("style", key), F.lit("")), F.lit(default))

    def missing(self, key: str) -> Column:
        return F.lit(self.fixed.get(key) is None) if self.fixed is not None else F.element_at("style", key).isNull()

    def number(self, key: str, default: float, low: float, high: float) -> Column:
        if self.fixed is not None:
            value = F.lit(float(default if self.fixed.get(key) is None else self.fixed[key]))
        else:
            value = F.when(self.missing(key), F.lit(float(default))).otherwise(F.coalesce(F.element_at("style", key).try_cast("double"), F.lit(0.0)))
        return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))

    def on(self, key: str) -> Column:
        """True, or text that isn't empty, 0 or false."""
        return ~F.lower(self.text(key)).isin("", "false", "0", "none")

    def off(self, key: str) -> Column:
        """Set to false."""
        return ~self.missing(key) & F.lower(self._raw(key)).isin("false")

    def _raw(self, key: str) -> Column:
        return F.lit(str(self.fixed.get(key))) if self.fixed is not None else F.coalesce(F.element_at("style", key), F.lit(""))

    def color(self, key: str, default: str = COLOR) -> Column:
        return ass_color(self.text(key, default))

    def effect(self) -> Column:
        name = self.text("effect", EFFECTS[0])
        return F.when(name.isin(*EFFECTS), name).otherwise(EFFECTS[0])

    def animation(self, inline: bool) -> Column:
        """Animation code; inline: for a word inside a line."""
        whole = lambda c: half_up(c).cast("string")
        length = half_up(self.number("animationDuration", 220, 80, 1000))
        power = self.number("animationIntensity", 100, 20, 180) / 100
        fade = F.when(self.missing("animationDuration"), 180).otherwise(length).cast("string")
        kind, out = self.text("animation"), F.lit("")
        code = F.concat(F.lit("{\\alpha&HFF&\\t(0,"), fade, F.lit(",\\alpha&H00&)}")) if inline else F.concat(F.lit("{\\fad("), fade, F.lit(","), fade, F.lit(")}"))
        out = F.when(kind == "fade", code)
        for name, (less, more, turn, axes, edge) in ANIMATIONS.items():
            scale = lambda v, axes=axes: F.concat(*[x for a in axes for x in (F.lit(f"\\fsc{a}"), v)])
            middle = whole(length * turn)
            steps = [
                F.lit("{" + ("" if inline else edge)), scale(whole(100 - less * power)), F.lit("\\t(0,"), middle, F.lit(","), scale(whole(100 + more * power)), F.lit(")\\t("),
                middle, F.lit(","), length.cast("string"), F.lit(","), scale(F.lit("100")), F.lit(")}"),
            ]
            out = out.when(kind == name, F.concat(*steps))
        return out.otherwise("")


def _styled(rows: DataFrame, style: dict | DataFrame) -> tuple[DataFrame, Style]:
    """rows with the settings at hand: a dict for all, or a table (project_id, style) for each project."""
    if isinstance(style, dict):
        return rows, Style(style)
    return rows.join(style.select("project_id", F.coalesce("style", F.create_map().cast("map<string,string>")).alias("style")), "project_id", "left").withColumn("style", F.coalesce("style", F.create_map().cast("map<string,string>"))), Style()


def to_ass_events(words: DataFrame, captions: DataFrame, style: dict | DataFrame) -> DataFrame:
    """Dialogue lines (project_id, caption_idx, line_idx, line) of captions in a style's effect.

    words: (project_id, caption_idx, word_pos, text, start, end, space_before); a caption without words is one word. style: one dict for
    all, or (project_id, style map<string,string>), as load_projects gives it.
    """
    key = ["project_id", "caption_idx"]
    names = [*key, "word_pos", "text", "start", "end", "space_before"]
    bare = captions.join(words.select(*key).distinct(), key, "left_anti").withColumns({"word_pos": F.lit(0), "space_before": F.lit(True)})
    words = words.select(*names).unionByName(bare.select(*names))
    words, look = _styled(words, style)
    captions, _ = _styled(captions, style)
    head = lambda a, b: F.concat(F.lit(DIALOGUE[0]), ass_time(a), F.lit(","), ass_time(b), F.lit(DIALOGUE[1]))
    bright = look.color("highlightColor", HIGHLIGHT)
    gap = F.when((F.col("word_pos") > 0) & F.coalesce("space_before", F.lit(True)), " ").otherwise("")

    def karaoke() -> DataFrame:
        piece = F.concat(gap, F.lit("{\\kf"), F.greatest(F.lit(1), half_up((F.col("end") - F.col("start")) * 100)).cast("string"), F.lit("}"), ass_escape(F.col("text")))
        body = words.where(look.effect() == "karaoke").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("word_pos", piece.alias("x")))).alias("b"))
        rows = captions.join(body, key)
        return rows.select(*key, F.lit(0).alias("line_idx"), F.concat(head(F.col("start"), F.col("end")), F.array_join(F.transform("b", lambda b: b["x"]), "")).alias("line"))

    def word() -> DataFrame:
        line = F.concat(head(F.col("start"), F.col("end")), look.animation(False), F.lit("{\\c"), bright, F.lit("}"), ass_escape(F.col("text")))
        return words.where(look.effect() == "word").select(*key, F.col("word_pos").alias("line_idx"), line.alias("line"))

    def progressive() -> DataFrame:
        w = Window.partitionBy(*key).orderBy("word_pos")
        rows = words.where(look.effect() == "progressive").join(captions.select(*key, F.col("end").alias("caption_end")), key)
        rows = rows.withColumn("x", F.concat(gap, ass_escape(F.col("text")))).withColumn("gap", gap)
        rows = rows.withColumn("prior", F.array_join(F.collect_list("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), "")).withColumn("next", F.lead("start").over(w))
        end = F.when(F.col("next") > F.col("start"), F.col("next")).otherwise(F.greatest("end", "caption_end"))
        active = F.concat(F.lit("{\\c"), bright, F.lit("}"), look.animation(True), ass_escape(F.col("text")), F.lit(RESET + "{\\c"), look.color("color"), F.lit("}"))
        return rows.select(*key, F.col("word_pos").alias("line_idx"), F.concat(head(F.col("start"), end), "prior", "gap", active).alias("line"))

    def sentence() -> DataFrame:
        line = F.concat(head(F.col("start"), F.col("end")), look.animation(False), ass_escape(F.col("text")))
        return captions.where(look.effect() == "sentence").select(*key, F.lit(0).alias("line_idx"), line.alias("line"))

    made = {"karaoke": karaoke, "word": word, "progressive": progressive, "sentence": sentence}
    if isinstance(style, dict):
        return made.get(style.get("effect") or "sentence", sentence)()
    first, *others = [f() for f in made.values()]
    for other in others:
        first = first.unionByName(other)
    return first


def to_ass_document(projects: DataFrame, events: DataFrame, style: dict | DataFrame) -> DataFrame:
    """One ASS document for each project (project_id, width, height) from its events, in one style or each project's own."""
    projects, look = _styled(projects, style)
    plain = lambda c: F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    part = lambda of, percent: half_up(F.col(of) * percent / 100).cast("string")
    side = part("width", F.greatest(look.number("safeAreaPct", 5, 0, 15), (100 - look.number("maxWidthPct", 90, 30, 96)) / 2))
    font = F.substring(F.regexp_replace(look.text("font", FONT), r"[^\p{L}\p{N} ._-]", ""), 1, 80)
    align = look.text("align", "2")
    numbers = [plain(look.number("scaleX", 100, 60, 160)), F.lit("100"), plain(look.number("spacing", 0, -3, 20)), plain(look.number("angle", 0, -30, 30)), F.when(look.on("backgroundEnabled"), "3").otherwise("1")]
    numbers += [plain(look.number("outline", 4, 0, 16)), plain(look.number("shadow", 2, 0, 12)), F.when(align.isin("1", "2", "3"), align).otherwise("2")]
    style_line = F.concat_ws(
        ",", F.lit("Style: Default"), F.coalesce(F.nullif(font, F.lit("")), F.lit(FONT)), part("height", look.number("fontSizePct", 6, 1.5, 18)),
        look.color("color"), look.color("highlightColor"), look.color("outlineColor", "000000"), F.replace(look.color("backgroundColor", "000000"), F.lit("&H00"), F.lit("&H70")),
        F.when(look.off("bold"), "0").otherwise("-1"), F.when(look.on("italic"), "-1").otherwise("0"), F.lit("0,0"), *numbers, side, side, part("height", look.number("bottomPct", 12, 1, 60)), F.lit("1"),
    )
    lines = events.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("caption_idx", "line_idx", "line"))), lambda x: x["line"]).alias("lines"))
    size = [F.concat(F.lit(f"PlayRes{axis}: "), F.col(of).cast("string")) for axis, of in (("X", "width"), ("Y", "height"))]
    document = F.concat_ws(
        "\n", *map(F.lit, ASS_HEAD), *size, *map(F.lit, ASS_STYLES), F.lit(ASS_STYLE_FORMAT), style_line, F.lit("[Events]"), F.lit(ASS_EVENT_FORMAT),
        F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"),
    )
    return projects.join(lines, "project_id", "left").select("project_id", document.alias("ass"))
