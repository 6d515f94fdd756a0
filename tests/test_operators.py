"""Literal cases of the caption, speech, record and file operators."""

import pytest
from pyspark.sql import functions as F

WORDS = "project_id long, word_idx long, text string, start double, end double, score double, needs_review boolean, review_status string"


def words(spark, rows, schema="project_id long, word_idx long, text string, start double, end double"):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], schema)


def reviewed(spark, rows):
    return spark.createDataFrame([(1, i, t, float(s), float(e), None, n, st) for i, (t, s, e, n, st) in enumerate(rows)], WORDS)


def regions(spark, *spans):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(spans)], "project_id long, region_idx long, start double, end double")


def times(df, *names):
    return [tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_word_segments(spark):
    from captionlake.functions.text import grapheme_count, word_segments

    got = one(spark, word_segments(F.lit("กำลังทดสอบระบบใหม่ครับ!"), "th"))
    assert len(got) >= 4 and got[-1].text.endswith("!")
    got = one(spark, word_segments(F.lit("  hello,  big world... "), "english"))
    assert [(w.text, w.space_before) for w in got] == [("hello,", False), ("big", True), ("world...", True)]
    assert one(spark, word_segments(F.lit(" "))) == [] and one(spark, grapheme_count(F.lit("กำลัง"))) == 3


def tokens(spark, rows):
    return spark.createDataFrame(
        [(1, i, t, float(a), float(b), c, 0.0, 0.0, br) for i, (t, a, b, c, br) in enumerate(rows)],
        "project_id long, token_idx long, text string, start double, end double, raw_confidence double, segment_logprob double, no_speech double, segment_break boolean",
    )


def test_tokens_to_words(spark):
    from captionlake.operators.tokens import tokens_to_words

    rows = tokens(spark, [("กำ", 0, 0.1, 0.9, False), ("ลัง", 0.1, 0.25, 0.9, False), ("ทด", 0.25, 0.4, 0.9, False), ("สอบ", 0.4, 0.6, 0.9, False)])
    got = tokens_to_words(rows).orderBy("word_idx").collect()
    assert (got[0].text, got[0].start, got[0].end) == ("กำลัง", 0.0, 0.25)
    got = tokens_to_words(tokens(spark, [("คว", 0, 0.2, 0.9, False), ("าม", 0.2, 0.4, 0.9, True)])).collect()
    assert [r.text for r in got] == ["ความ"]
    got = tokens_to_words(tokens(spark, [(" hi", 8, 8, 0.9, False), (" you", 8, 8, 0.2, False), (" there", 8, 8, None, False)]), "english").orderBy("word_idx").collect()
    assert [r.text for r in got] == ["hi", "you", "there"] and all(r.end > r.start for r in got)
    assert all(a.end <= b.start + 1e-9 for a, b in zip(got, got[1:], strict=False))
    assert [r.needs_review for r in got] == [False, True, True]


def test_group_words(spark):
    from captionlake.operators.sequences import group_words, words_to_captions

    got = words_to_captions(group_words(words(spark, [("a", 0.0, 0.4), ("b.", 0.4, 0.8), ("c", 2.4, 2.8)])), "group_idx").orderBy("group_idx")
    assert [r.text for r in got.collect()] == ["a b.", "c"]
    assert group_words(words(spark, [("a", 0.0, 0.4), ("b", 0.7, 0.9)])).agg(F.max("group_idx")).first()[0] == 1
    many = words(spark, [(f"w{i}", i * 0.2, i * 0.2 + 0.2) for i in range(23)])
    assert sorted(r["count"] for r in group_words(many, 5).groupBy("group_idx").count().collect()) == [3, 10, 10]


def test_reflow_words(spark):
    from captionlake.operators.alignment import reflow_words
    from captionlake.operators.sequences import split_phrases

    def sizes(n, target):
        rows = words(spark, [(f"w{i}", i * 0.3, i * 0.3 + 0.3) for i in range(n)])
        out = reflow_words(split_phrases(rows), target, "english").groupBy("caption_idx").count().orderBy("caption_idx")
        return [r["count"] for r in out.collect()]

    assert sizes(10, 3) == [3, 3, 4] and sizes(5, 3) == [3, 2]
    gap = words(spark, [("one", 0.0, 0.3), ("two", 0.7, 1.0)])
    assert reflow_words(split_phrases(gap), 5, "english").select("caption_idx").distinct().count() == 2
    thai = words(spark, [("แต้", 0.0, 0.3), ("ๆ", 0.3, 0.5)])
    assert reflow_words(split_phrases(thai), 1, "th").select("caption_idx").distinct().count() == 1


def test_cap_and_snap(spark):
    from captionlake.operators.intervals import snap_words_to_silence
    from captionlake.operators.sequences import cap_word_durations

    (got,) = times(cap_word_durations(words(spark, [("บ้าน", 20.0, 21.5)])), "start", "end")
    assert got[0] == 20 and got[1] - got[0] <= 0.501
    snap = lambda rows, *quiet: times(snap_words_to_silence(words(spark, rows), regions(spark, *quiet)).orderBy("start"), "start", "end")
    assert snap([("a", 15.76, 16.35)], (15.7413, 16.0397)) == [(16.0397, 16.35)]
    assert snap([("a", 1.0, 3.0)], (1.5, 2.0)) == [(2.0, 3.0)]
    assert snap([("a", 1.0, 1.3), ("b", 2.0, 2.2)], (0.9, 1.27), (1.9, 2.3)) == []


def test_glossary(spark):
    from captionlake.operators.alignment import apply_glossary
    from captionlake.operators.sequences import normalize_glossary

    rows = reviewed(spark, [("New", 0, 0.2, False, "approved"), ("York", 0.2, 0.5, True, "pending"), ("is", 0.5, 0.7, False, "approved")])
    terms = normalize_glossary(spark.createDataFrame([(1, 0, "New  York, x,,x\nnew york")], "project_id long, item_idx long, text string"))
    assert [r.term for r in terms.orderBy("term_idx").collect()] == ["New York", "x", "new york"]
    got = apply_glossary(rows, terms).orderBy("word_idx").collect()
    assert [(r.text, r.end, r.needs_review) for r in got] == [("New York", 0.5, True), ("is", 0.7, False)]


def test_alignment_to_regions(spark):
    from captionlake.operators.alignment import align_words_to_regions
    from captionlake.operators.intervals import best_region_per_word, words_outside_speech

    rows = reviewed(spark, [("a", 0, 0.4, False, "approved"), ("b", 1, 2.2, False, "approved"), ("c", 2.3, 2.35, False, "approved")])
    speech = regions(spark, (0.9, 2.5))
    got = align_words_to_regions(rows, best_region_per_word(rows, speech), speech).orderBy("word_idx").collect()
    assert [(r.text, r.start, r.end, r.review_status) for r in got] == [("b", 1.0, 2.2, "approved"), ("c", 2.3, 2.35, "pending")]
    assert words_outside_speech(words(spark, [("x", 2.0, 3.0)]), regions(spark, (0, 1))).count() == 1
    alone = align_words_to_regions(rows, best_region_per_word(rows, regions(spark, (0, 1)).limit(0)), regions(spark, (0, 1)).limit(0))
    assert alone.count() == 3


def test_weak_regions_and_overlaps(spark):
    from captionlake.operators.intervals import dub_overlaps, weak_regions

    rows = reviewed(spark, [("a", 31.95, 32.5, False, "approved"), ("b", 32.5, 33.0, False, "approved")])
    assert weak_regions(rows, regions(spark, (31.95, 35.92))).count() == 1
    steady = reviewed(spark, [(f"w{i}", i * 0.3, i * 0.3 + 0.3, False, "approved") for i in range(10)])
    assert weak_regions(steady, regions(spark, (0, 3), (0, 0.5))).count() == 0
    clips = spark.createDataFrame([(1, 1, 2.0, 4.0), (1, 2, 3.5, 5.0), (1, 3, 5.0, 6.0)], "project_id long, clip_id long, start_time double, end_time double")
    assert {(r.clip_id, r.other_id) for r in dub_overlaps(clips).collect()} == {(1, 2), (2, 1)}


def test_interval_join_against_nested_loop(spark):
    import random

    from captionlake.operators.intervals import as_right, interval_join

    rng = random.Random(8)
    span = lambda: (s := round(rng.uniform(0, 200), 2), round(s + rng.choice([0, 0.5, 10, 70]), 2))
    left = [(rng.randint(1, 2), i, *span()) for i in range(150)]
    right = [(rng.randint(1, 2), i, *span()) for i in range(150)]
    a = spark.createDataFrame(left, "project_id long, a long, start double, end double")
    b = as_right(spark.createDataFrame(right, "project_id long, b long, start double, end double"))
    got = sorted((r.a, r.b) for r in interval_join(a, b, ["project_id"]).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])


def test_merge_and_fallback_regions(spark):
    from captionlake.operators.sequences import merge_speech_regions, regions_from_silences

    rows = spark.createDataFrame([(1, 0, 1.0, 2.0, 0.1, -0.1), (1, 1, 2.02, 3.0, 0.1, -0.1), (1, 2, 5.0, 6.0, 0.9, -0.9)], "project_id long, segment_idx long, start double, end double, no_speech_prob double, avg_logprob double")
    assert times(merge_speech_regions(rows), "region_idx", "start", "end") == [(0, 0.92, 3.08)]
    ends = spark.createDataFrame([(1, 10.0)], "project_id long, duration double")
    assert times(regions_from_silences(regions(spark, (2, 3), (7, 8)), ends).orderBy("region_idx"), "start", "end") == [(0.0, 2.08), (2.92, 7.08), (7.92, 10.0)]


def test_passes(spark):
    from captionlake.operators import alignment as a

    region = regions(spark, (0, 2))
    old = reviewed(spark, [("hello", 0, 0.5, False, "approved"), ("word", 0.5, 1, False, "edited"), ("now", 1, 1.5, False, "approved")])
    new = words(spark, [("Hello!", 0.0, 0.5), ("world", 0.5, 1.0), ("now", 1.0, 2.0)])
    assert sorted((r.word_idx, r.candidate_idx) for r in a.lcs_pairs(old, new, region).collect()) == [(0, 0), (2, 2)]
    assert a.hypotheses_disagree(old, new, region).count() == 1
    marked = a.mark_region_for_review(old, new, region).orderBy("word_idx").collect()
    assert [r.review_status for r in marked] == ["approved", "edited", "approved"]
    swapped = a.replace_region_words(old, new, region).orderBy("start").collect()
    assert [(r.text, r.review_status) for r in swapped] == [("Hello!", "approved"), ("world", "pending"), ("now", "approved")]
    longer = words(spark, [("hello", 0.0, 0.5), ("word", 0.5, 1.0), ("nowadays", 1.0, 1.9)])
    same = words(spark, [("hello", 0.0, 0.5), ("ward", 0.5, 1.0), ("now", 1.0, 1.5)])
    assert not a.retry_wins(old, same, region).first().wins
    assert a.retry_wins(old, longer, region).first().wins and a.retry_wins(old, new, region).first().wins
    assert {r.text for r in a.merge_passes(old, longer, region).collect()} == {"hello", "word", "nowadays"}


def test_lcs_and_edit_distance_against_brute_force():
    import random

    from captionlake.functions.distance import edit_distance
    from captionlake.operators.alignment import common_pairs

    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        ed = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
                ed[i][j] = min(ed[i - 1][j] + 1, ed[i][j - 1] + 1, ed[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        pairs = common_pairs(a, b)
        assert len(pairs) == dp[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert edit_distance(a, b) == ed[-1][-1]


def test_edited_caption(spark):
    from captionlake.operators.alignment import reconcile_edited_caption

    old = F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(t).alias("text")) for a, b, t in ((0, 1, "hello"), (1, 2, "world"), (2, 3, "now"))])
    new = lambda *t: F.array(*[F.struct(F.lit(x).alias("text"), F.lit(i > 0).alias("space_before")) for i, x in enumerate(t)])
    got = one(spark, reconcile_edited_caption(F.lit(0.0), F.lit(3.0), old, new("hello", "planet", "now")))
    assert [(w.text, w.start, w.end, w.review_status) for w in got] == [("hello", 0, 1, "kept"), ("planet", 1, 2, "edited"), ("now", 2, 3, "kept")]
    got = one(spark, reconcile_edited_caption(F.lit(0.0), F.lit(3.0), old, new("hello", "brave", "world", "now")))
    assert [w.text for w in got] == ["hello", "brave", "world", "now"] and all(w.end >= w.start for w in got) and (got[0].start, got[3].end) == (0, 3)


def test_metrics(spark):
    from captionlake.operators import quality as q

    assert one(spark, q.word_error_rate(q.metric_tokens(F.lit("hello world"), "english"), q.metric_tokens(F.lit("hello word"), "english"))) == 0.5
    assert one(spark, q.word_error_rate(q.plain_tokens(F.lit("")), q.plain_tokens(F.lit("x")))) == 1.0
    assert one(spark, q.char_error_rate(F.lit("abcd"), F.lit("abxd"))) == 0.25
    a, b = words(spark, [("x", 0.0, 1.0)]), words(spark, [("X", 0.1, 1.1)])
    assert q.median_boundary_error(a, b).first().median_boundary_error == pytest.approx(0.1)


def test_shift_and_expand(spark):
    from captionlake.operators.intervals import expand_range
    from captionlake.operators.sequences import shift_captions

    captions = spark.createDataFrame([(1, 0, 0.2, 1.2)], "project_id long, caption_idx long, start double, end double")
    move = lambda o, d: times(shift_captions(captions, spark.createDataFrame([(1, o, d)], "project_id long, offset double, duration double")), "start", "end")
    assert move(-2.0, 3.0) == [(0.0, 1.0)] and move(5.0, 2.0) == [(1.0, 2.0)]
    ask = spark.createDataFrame([(1, 0, 1.0, 2.0)], "project_id long, range_idx long, start double, end double")
    assert times(expand_range(ask, regions(spark, (0.9, 5)), spark.createDataFrame([(1, 10.0)], "project_id long, duration double")), "start", "end") == [(0.9, 2.25)]


def test_upload_order(spark):
    from captionlake.operators.records import restore_upload_order

    files = spark.createDataFrame([(1, 1, "b", 1), (1, 2, "a", 2), (1, 3, "b", 3)], "upload_id long, pos long, name string, file_id long")

    def order(*names):
        want = spark.createDataFrame([(1, i, n) for i, n in enumerate(names, 1)], "upload_id long, pos long, name string")
        return [r.file_id for r in restore_upload_order(files, want).orderBy("new_pos").collect()]

    assert order("b", "b", "a") == [1, 3, 2] and order("b", "c", "a") == [1, 2, 3] and order("b", "a") == [1, 2, 3]


def test_media_functions(spark):
    from captionlake.functions import media as m

    fit = lambda a, s: one(spark, m.duration_fit(F.lit(float(a)), F.lit(float(s)))["status"])
    assert [fit(2, 3), fit(3.3, 3), fit(4, 3), fit(0, 3)] == ["fit", "stretch", "needs_edit", "failed"]
    assert one(spark, m.atempo_chain(F.lit(1.1))) == "atempo=1.10000" and one(spark, m.atempo_chain(F.lit(5.0))) == "atempo=2,atempo=2,atempo=1.25000"
    assert one(spark, m.numbers_to_thai(F.lit("21 กับ 12.5 และ a7 1,000,000"))) == "ยี่สิบเอ็ด กับ สิบสองจุดห้า และ a7 หนึ่งล้าน"
    blank = {k: F.lit(None).cast("double") for k in ("x", "y", "left", "right", "top", "bottom")}
    style = F.struct(F.lit("9:16").alias("aspect"), *[v.alias(k) for k, v in blank.items()])
    got = one(spark, m.crop_geometry(F.lit(1920), F.lit(1080), m.normalize_crop(style)))
    assert (got.width, got.height, got.x, got.active) == (608, 1080, 656, True)
    hd = one(spark, m.full_hd_geometry(F.lit(640), F.lit(480)))
    assert (hd.width, hd.height) == (1440, 1080)
    rules = m.parse_pronunciations(F.lit("AI = เอไอ\nx => y$1\nbad line\n a.b → c"))
    assert [(r.source, r.target) for r in one(spark, rules)] == [("AI", "เอไอ"), ("x", "y$1"), ("a.b", "c")]
    assert one(spark, m.apply_pronunciations(F.lit("ai X a.b aXb"), rules)) == "เอไอ y$1 c ay$1b"
    assert one(spark, m.emotion_category(F.lit("โกรธมาก"))) == "angry"


def test_text_functions(spark):
    from captionlake.functions import text as t

    assert one(spark, t.srt_time(F.lit(3661.2345))) == "01:01:01,234" and one(spark, t.ass_time(F.lit(61.239))) == "0:01:01.23"
    assert one(spark, t.ass_escape(F.lit("{\\evil}\nx"))) == "（／evil）\\Nx"
    assert one(spark, t.ass_color(F.lit("#B8FF38"))) == "&H0038FFB8" and one(spark, t.ass_color(F.lit("12"))) == "&H00FFFF12"
    assert one(spark, t.repair_filename(F.lit("à¸\x81à¸\xb2.mp4"))) == "กา.mp4" and one(spark, t.repair_filename(F.lit("plain.mp4"))) == "plain.mp4"
    assert one(spark, t.subtitle_seconds(F.lit("01:02,5"))) == 62.5 and one(spark, t.subtitle_seconds(F.lit("1.5"))) is None


def test_subtitle_files(spark, tmp_path):
    from captionlake.sources import files as f

    (tmp_path / "a.srt").write_bytes("﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nHi\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,5\r\nthere\r\n".encode())
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000 align:left\n<b>Hello</b>\n")
    (tmp_path / "c.srt").write_text("1\n00:00:03,000 --> 00:00:02,000\nbad\n")
    (tmp_path / "d.srt").write_text("nothing here")
    got = {(r.path.rsplit("/", 1)[1], r.cue_idx): (r.start, r.end, r.text, r.error) for r in f.read_subtitles(spark, str(tmp_path)).collect()}
    assert got[("a.srt", 0)] == (1.0, 2.0, "Hi", None) and got[("a.srt", 1)] == (3.0, 4.5, "there", None)
    assert got[("b.vtt", 0)] == (1.0, 2.0, "Hello", None) and got[("c.srt", 0)][3] == "bad time" and got[("d.srt", None)][3] == "no cues"
    cues = spark.createDataFrame([("p", 0, 0.0, 2.0, "a"), ("p", 1, 1.5, 3.0, "b")], "path string, cue_idx int, start double, end double, text string")
    assert f.subtitle_overlap_errors(cues).count() == 1
    parts = f.captions_from_cues(spark.createDataFrame([("p", 0, 0.0, 6.0, "ab abcd")], "path string, cue_idx int, start double, end double, text string"), "english").orderBy("word_pos")
    assert [(r.text, r.word_start, r.word_end) for r in parts.collect()] == [("ab", 0.0, 2.0), ("abcd", 2.0, 6.0)]


def test_logs(spark):
    from captionlake.sources import files as f

    log = spark.createDataFrame([(1, "x\nSpeech segment 0: start = 146.00, end = 360.00\nSpeech segment 1: start = 5.00, end = 5.00\nSpeech segment 2: start = 3250.00, end = 3300.00")], "project_id long, text string")
    assert times(f.parse_vad_log(log).orderBy("region_idx"), "region_idx", "start", "end") == [(0, 1.46, 3.6), (1, 32.5, 33.0)]
    log = spark.createDataFrame([(1, "silence_end: 1\nsilence_start: 2\nsilence_start: 3\nsilence_end: 4.5 | d\nsilence_end: 9")], "project_id long, text string")
    assert times(f.parse_silence_log(log), "silence_idx", "start", "end") == [(0, 3.0, 4.5)]


def test_transcripts(spark, tmp_path):
    import json

    from captionlake.sources import files as f

    result = {"segments": [
        {"text": "hi there", "start": 0, "end": 1, "no_speech_prob": 0.1, "avg_logprob": -0.1, "words": [{"word": " hi", "start": 0, "end": 0.5, "probability": 0.9}, {"word": " there", "start": 0.5, "end": 1, "probability": 0.8}]},
        {"text": "gone", "start": 1, "end": 2, "no_speech_prob": 0.91, "avg_logprob": -0.9},
        {"text": "(Music)", "start": 1, "end": 2},
        {"text": "doubt", "start": 2, "end": 3, "words": [{"word": "doubt", "start": 2, "end": 3, "probability": 0.24}]},
        {"text": "tok", "start": 3, "end": 4, "tokens": [{"text": "tok", "t0": 300, "t1": 400, "p": 0.5}, {"text": "ms", "offsets": {"from": 4000, "to": 4500}}]},
        {"text": "whole", "start": 5, "end": 6, "avg_logprob": 0.0},
    ]}
    (tmp_path / "one.json").write_text(json.dumps(result))
    got = f.read_transcripts(spark, str(tmp_path)).orderBy("token_idx").collect()
    assert [(r.text, r.start, r.end, r.raw_confidence, r.segment_break) for r in got] == [
        (" hi", 0.0, 0.5, 0.9, False), (" there", 0.5, 1.0, 0.8, False), ("tok", 3.0, 4.0, 0.5, True), ("ms", 4.0, 4.5, None, False), ("whole", 5.0, 6.0, 1.0, True),
    ]


def test_sinks(spark, tmp_path):
    from captionlake.sources import files as f

    captions = spark.createDataFrame([(1, 0, 0.0, 1.0, "a b")], "project_id long, caption_idx long, start double, end double, text string")
    parts = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.5, True), (1, 0, 1, "b", 0.5, 1.0, True)], "project_id long, caption_idx long, word_pos int, text string, start double, end double, space_before boolean")
    assert f.to_srt(captions).first().srt == "1\n00:00:00,000 --> 00:00:01,000\na b\n"
    f.write_srt(captions, f"{tmp_path}/srt")
    assert spark.read.text(f"{tmp_path}/srt").count() == 4
    line = lambda **s: [r.line for r in f.to_ass_events(parts, captions, s).orderBy("line_idx").collect()]
    assert line(effect="karaoke") == ["Dialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,{\\kf50}a {\\kf50}b"]
    assert "\\fad(180,180)" in line(animation="fade")[0] and len(line(effect="word")) == 2
    assert line(effect="progressive")[1].startswith("Dialogue: 0,0:00:00.50,0:00:01.00,Default,,0,0,0,,a {\\c&H0038FFB8}")
    projects = spark.createDataFrame([(1, 1920, 1080)], "project_id long, width int, height int")
    ass = f.to_ass_document(projects, f.to_ass_events(parts, captions, {}), {"fontSizePct": 10}).first()["ass"]
    assert "Style: Default,Leelawadee UI,108," in ass and ass.endswith("a b")


def test_ground_truth_and_projects(spark, tmp_path):
    from captionlake.sources import files as f

    (tmp_path / "x.json").write_text('{"language":"th","reference":{"text":"a","words":[{"text":"a","start":0,"end":1}]},"baseline":{"text":"b"},"candidate":{"text":"a","words":[]}}')
    row = f.load_ground_truth(spark, str(tmp_path)).first()
    assert row.file == "x.json" and row.reference.words[0].text == "a" and row.speechRegions is None
    rows = spark.createDataFrame([(1, '[{"start":0,"end":1,"text":"hi"}]', None)], "project_id long, captions_json string, style_json string")
    got = f.load_projects(rows).first()
    assert got.captions[0].text == "hi" and got.style == {} and got.waveform == []


def test_records(spark):
    from captionlake.operators import records as r

    jobs = spark.createDataFrame([(1, "running"), (2, "ready")], "job_id long, status string")
    assert [(x.status, x.error) for x in r.recover_jobs(jobs).orderBy("job_id").collect()] == [("failed", "Application restarted"), ("ready", None)]
    takes = spark.createDataFrame([(1, 1, "needs_edit", "ready"), (1, 2, "fit", "ready"), (2, 1, "needs_edit", "ready")], "clip_id long, take_index int, fit_status string, status string")
    assert {(x.clip_id, x.take_index) for x in r.select_take(takes).collect()} == {(1, 2), (2, 1)}
    choice = spark.createDataFrame([(1, 1)], "clip_id long, take_index int")
    assert {(x.clip_id, x.take_index) for x in r.select_take(takes, choice).collect()} == {(1, 1), (2, 1)}
    clip = spark.createDataFrame([(1, 1, -1.0, 5.0, " a  b ", 2.0, -1.0, 0.0, 4.0)], "project_id long, clip_id long, start_time double, end_time double, text string, speed double, pause_before double, pause_after double, duration double")
    got = r.validate_dub_clips(clip).first()
    assert (got.start_time, got.end_time, got.text, got.speed, got.pause_before, got.error) == (0.0, 4.0, "a b", 1.15, 0.0, None)
    style = F.create_map(F.lit("color"), F.lit("fff"), F.lit("bold"), F.lit(None).cast("string"), F.lit("other"), F.lit("1"))
    assert one(spark, r.style_preset_values(style)) == {"color": "fff"}
