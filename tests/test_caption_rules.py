"""Rules that literal cases show best, and whole tables against plain Python where SQL can't express a query."""

import json
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
SPAN = "project_id long, region_idx long, start double, end double"
WORD = "project_id long, word_idx long, text string, start double, end double, score double, needs_review boolean, review_status string, review_reason string"


def word(i, text, start, end, score=0.9, needs=False, status="approved", reason=None, project=1):
    return (project, i, text, float(start), float(end), score, needs, status, reason)


def words(spark, *rows):
    return spark.createDataFrame(list(rows), WORD)


def spans(spark, *rows):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(rows)], SPAN)


# --- regions and captions ---------------------------------------------------------------------------------------------


def test_segments_without_scores_are_speech(spark):
    from captionlake.operators.sequences import merge_speech_regions

    rows = [(1, 0, 1.0, 2.0, None, None), (1, 1, 3.0, 4.0, 0.9, None), (1, 2, 5.0, 6.0, None, -0.9), (1, 3, 7.0, 8.0, 0.9, -0.9)]
    got = merge_speech_regions(spark.createDataFrame(rows, "project_id long, segment_idx long, start double, end double, no_speech_prob double, avg_logprob double"))
    assert [r.region_idx for r in got.orderBy("start").collect()] == [0, 1, 2]


def test_pending_words_make_a_region_weak(spark):
    from captionlake.operators.intervals import weak_regions

    rows = [word(i, "w", i * 0.2, i * 0.2 + 0.2, status="pending" if i == 3 else "approved") for i in range(10)]
    assert weak_regions(words(spark, *rows), spans(spark, (0, 2))).count() == 1
    assert weak_regions(words(spark, *rows).withColumn("review_status", F.lit("approved")), spans(spark, (0, 2))).count() == 0


def test_captions_without_words(spark):
    from captionlake.operators.intervals import caption_at
    from captionlake.sources.files import to_ass_events

    captions = spark.createDataFrame([(1, 0, 0.0, 1.0, "as {it} is")], "project_id long, caption_idx long, start double, end double, text string")
    none = spark.createDataFrame([], "project_id long, caption_idx long, word_pos int, text string, start double, end double, space_before boolean")
    probe = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.5)], "project_id long, probe_idx long, t double")
    at = lambda e: [(r.probe_idx, r.active_idx, r.visible_end) for r in caption_at(probe, captions, none, e).collect()]
    assert at("sentence") == at("karaoke") == [(0, -1, -1)] and at("word") == at("progressive") == []
    head = "Dialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,"
    line = lambda e: [r.line for r in to_ass_events(none, captions, {"effect": e}).collect()]
    assert line("karaoke") == [head + "{\\kf100}as （it） is"]
    assert line("word") == [head + "{\\c&H0038FFB8}as （it） is"]
    assert line("progressive") == [head + "{\\c&H0038FFB8}as （it） is{\\fscx100\\fscy100\\alpha&H00&}{\\c&H00FFFFFF}"]
    assert line("sentence") == line("other") == [head + "as （it） is"]


def test_each_project_has_its_style(spark):
    from captionlake.sources.files import to_ass_document, to_ass_events

    captions = spark.createDataFrame([(p, 0, 0.0, 1.0, "a b") for p in (1, 2, 3, 4)], "project_id long, caption_idx long, start double, end double, text string")
    parts = spark.createDataFrame([(p, 0, i, t, i / 2, i / 2 + 0.5, True) for p in (1, 2, 3, 4) for i, t in enumerate("ab")], "project_id long, caption_idx long, word_pos int, text string, start double, end double, space_before boolean")
    styles = {
        1: {"effect": "karaoke", "color": "#12345", "fontSizePct": "10", "bold": "false", "italic": "true", "align": "1"},
        2: {"effect": "word", "animation": "bounce", "animationDuration": "400", "animationIntensity": "50", "highlightColor": "00FF00", "scaleX": "1000", "spacing": "1.5"},
        3: {"effect": "progressive", "animation": "fade", "font": "A{b}c", "maxWidthPct": "x", "backgroundEnabled": "true"},
    }
    own = spark.createDataFrame([(p, s) for p, s in styles.items()], "project_id long, style map<string,string>")
    events = to_ass_events(parts, captions, own)
    projects = spark.createDataFrame([(p, 1920, 1080) for p in (1, 2, 3, 4)], "project_id long, width int, height int")
    got = {r.project_id: r["ass"] for r in to_ass_document(projects, events, own).collect()}
    for p in (1, 2, 3, 4):  # as with that style for all
        raw = styles.get(p, {})
        typed = {k: {"true": True, "false": False}.get(v, float(v) if re.fullmatch(r"[0-9.]+", v) and k not in ("highlightColor", "align") else int(v) if k == "align" else v) for k, v in raw.items() if v != "x"}
        if p == 3:
            typed["maxWidthPct"] = 30
        one = projects.where(f"project_id = {p}")
        want = to_ass_document(one, to_ass_events(parts.where(f"project_id = {p}"), captions.where(f"project_id = {p}"), typed), typed).first()["ass"]
        assert got[p] == want
    assert "Style: Default,Leelawadee UI,108,&H005F3412,&H00FFFFFF,&H00000000,&H70000000,0,-1,0,0,100,100,0,0,1,4,2,1,96,96,130,1" in got[1]
    assert "{\\fad(35,70)\\fscy85\\t(0,200,\\fscy109)\\t(200,400,\\fscy100)}{\\c&H0000FF00}a" in got[2] and ",160,100,1.5,0," in got[2]
    assert ",Abc," in got[3] and ",3,4,2,2,672,672,130,1" in got[3] and "{\\alpha&HFF&\\t(0,180,\\alpha&H00&)}b" in got[3]
    assert got[4].endswith(",,0,0,0,,a b")


def test_empty_subtitle_file(spark):
    from captionlake.sources.files import parse_subtitles

    rows = spark.createDataFrame([("empty", ""), ("blank", "﻿ \n"), ("bad", "hello")], "path string, text string")
    assert [(r.path, r.error) for r in parse_subtitles(rows).collect()] == [("bad", "no cues")]


def test_shifted_words_move_along(spark):
    from captionlake.operators.records import validate_captions
    from captionlake.operators.sequences import shift_captions

    kind = "project_id long, caption_idx long, start double, end double, text string, words array<struct<text:string,start:double,end:double,space_before:boolean,line_break_before:boolean,timing_source:string>>"
    rows = [(1, 0, 1.0, 2.0, "a b", [("a", 1.0, 1.5, True, False, "estimated"), ("b", 1.5, 2.0, True, False, "whisper")]), (1, 1, 3.0, 4.0, "c", None)]
    moved = shift_captions(spark.createDataFrame(rows, kind), spark.createDataFrame([(1, 5.0, 6.0)], "project_id long, offset double, duration double"))
    first, second = moved.orderBy("caption_idx").collect()
    assert [(w.start, w.end, w.timing_source) for w in first.words] == [(3.0, 3.5, "estimated"), (3.5, 4.0, "manual")] and second.words is None
    assert {r.error for r in validate_captions(moved.where("caption_idx = 0")).collect()} == {None}


def test_migrated_projects(spark):
    from captionlake.operators.records import migrate_projects_v3
    from captionlake.sources.files import load_projects

    captions = json.dumps([{"start": 0, "end": 1, "text": "a", "words": [{"text": "a", "start": 0, "end": 1, "confidence": 0.5, "needsReview": True, "reviewStatus": "odd", "timingSource": "odd"}]}, {"start": 1, "end": 2, "text": "b"}])
    rows = spark.createDataFrame([(v, captions, '{"color":"fff"}', v) for v in (1, 3)], "project_id long, captions_json string, style_json string, schema_version int")
    old, new = migrate_projects_v3(load_projects(rows)).orderBy("project_id").collect()
    w = old.captions[0].words[0]
    assert (w.rawConfidence, w.needsReview, w.reviewStatus, w.timingSource) == (0.5, True, "pending", "whisper") and old.captions[1].words == []
    assert old.style == {"color": "fff", "schemaVersion": "3"} and old.schema_version == 3
    assert new.captions[0].words[0].reviewStatus == "odd" and new.captions[1].words is None and new.style == {"color": "fff"}


def test_merged_term_keeps_the_first_words_fields(spark):
    from captionlake.operators.alignment import apply_glossary

    kind = "project_id long, word_idx long, text string, start double, end double, space_before boolean, phrase_break boolean, confidence double, raw_confidence double, review_score double, needs_review boolean, note string"
    rows = [(1, 0, "new", 0.0, 1.0, False, True, 0.4, None, 0.2, False, "x"), (1, 1, "york", 1.0, 2.0, True, False, 0.9, 0.6, None, True, "y"), (1, 2, "x", 2.0, 3.0, True, False, 0.9, None, None, False, "z")]
    terms = spark.createDataFrame([(1, 0, "New York")], "project_id long, term_idx long, term string")
    one, other = apply_glossary(spark.createDataFrame(rows, kind), terms).orderBy("word_idx").collect()
    assert (one.text, one.start, one.end, one.space_before, one.phrase_break, one.raw_confidence, one.review_score, one.needs_review, one.note, one.n_merged) == ("New York", 0.0, 2.0, False, True, 0.5, 0.2, True, "x", 2)
    assert (other.text, other.confidence, other.raw_confidence, other.n_merged) == ("x", 0.9, None, 1)


def test_aliases_are_terms(spark):
    from captionlake.operators.sequences import normalize_glossary

    rows = spark.createDataFrame([(1, 0, "New  York,x", ["NYC", "a, b"]), (1, 1, None, ["x", " "]), (1, 2, "y", None)], "project_id long, item_idx long, text string, aliases array<string>")
    assert [r.term for r in normalize_glossary(rows).orderBy("term_idx").collect()] == ["New York", "x", "NYC", "a, b", "y"]


# --- passes -----------------------------------------------------------------------------------------------------------------


def test_region_without_candidate_words_never_wins(spark):
    from captionlake.operators.alignment import retry_wins

    new = words(spark, word(0, "far", 50, 51))
    got = {r.region_idx: r.wins for r in retry_wins(words(spark, word(0, "a", 20, 21)), new, spans(spark, (0, 10), (49, 52))).collect()}
    assert got == {0: False, 1: True}


def test_reasons_stay(spark):
    from captionlake.operators import alignment as a

    old = words(spark, word(0, "same", 0, 1, status="pending", needs=True, reason="own"), word(1, "gone", 1, 2), word(2, "out", 8, 9, reason="kept reason"))
    new = words(spark, word(0, "same", 0, 1), word(1, "other", 1, 2))
    region = spans(spark, (0, 2))
    why = lambda df: {r.text: r.review_reason for r in df.collect()}
    assert why(a.mark_region_for_review(old, new, region)) == {"same": "own", "gone": "pass-disagreement", "out": "kept reason"}
    assert why(a.replace_region_words(old, new, region)) == {"same": "own", "other": "coverage-retry", "out": "kept reason"}
    assert why(a.merge_passes(old, new, region)) == {"same": "own", "gone": "pass-disagreement", "out": "kept reason"}
    longer = words(spark, word(0, "same", 0, 1), word(1, "goneforever", 1, 2))
    assert why(a.merge_passes(old, longer, region)) == {"same": "own", "goneforever": "coverage-retry", "out": "kept reason"}


def test_overlapping_regions_are_decided_in_order(spark):
    """The second region sees the words that the first one has put there, and finds nothing to do."""
    from captionlake.operators import alignment as a

    old = words(spark, word(0, "a", 0, 1), word(1, "b", 1, 2), word(2, "c", 2, 3))
    new = words(spark, word(0, "a", 0, 1), word(1, "bbbbbb", 1, 2), word(2, "c", 2, 3))
    got = a.merge_passes(old, new, spans(spark, (0, 2), (1, 3), (2.5, 3), (10, 11))).orderBy("start").collect()
    assert [(r.text, r.word_idx, r.origin, r.review_reason) for r in got] == [("a", 0, "retry", None), ("bbbbbb", 1, "retry", "coverage-retry"), ("c", 2, "kept", None)]


# --- scores -----------------------------------------------------------------------------------------------------------------


def test_words_are_segmented_for_error_rates(spark):
    from captionlake.operators.quality import evaluate_fixtures

    said = lambda t: words(spark, word(0, t, 0, 1))
    got = evaluate_fixtures(said("สวัสดีครับวันนี้อากาศดี"), said("สวัสดีครับวันนี้อากาศร้อน"), said("สวัสดีครับวันนี้อากาศดี"), spans(spark).limit(0), candidate_regions=spans(spark, (0, 1))).first()
    assert 0 < got.baseline_wer < 0.5 and got.candidate_wer == 0 and got.silent_word_count == 0


def test_upper_median(spark):
    from captionlake.operators.quality import quality_report

    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        values = [rng.choice([0.1, 0.10001, 0.25, 3.0, 0.0]) for _ in range(n)] + [None]
        rows = spark.createDataFrame([(0.5, 0.25, v, 0) for v in values], "baseline_wer double, candidate_wer double, median_boundary_error double, silent_word_count long")
        assert quality_report(rows).first().median_boundary_error == sorted(values[:-1])[n // 2]
    assert quality_report(rows.where("median_boundary_error IS NULL")).first().passed is False


def test_queue_places_over_days(spark):
    from captionlake.operators.records import queue_positions

    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 5}:00:00", "queued" if i % 4 else "done", i % 2) for i in range(30)]
    table = spark.createDataFrame(rows, "job_id long, created_at string, status string, queue int")
    for by in (True, False):
        got = {r.job_id: r.position for r in queue_positions(table if by else table.drop("queue")).collect()}
        want = {}
        for q in {r[3] if by else 0 for r in rows}:
            waiting = sorted((r[1], r[0]) for r in rows if r[2] == "queued" and (not by or r[3] == q))
            want |= {job: k + 1 for k, (_, job) in enumerate(waiting)}
        assert got == want


# --- whole tables against plain Python ------------------------------------------------------------------------------------------


def key_of(text):
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower())


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best


def distance(a, b):
    """The plain table, a row at a time: a running minimum stands for the steps to the right."""
    codes = {k: i for i, k in enumerate({*a, *b})}
    right, place = np.array([codes[x] for x in b], int), np.arange(len(b) + 1)
    row = place
    for i, x in enumerate(a, 1):
        row = np.minimum.accumulate(np.append(i, np.minimum(row[1:] + 1, row[:-1] + (right != codes[x]))) - place) + place
    return int(row[-1])


@pytest.fixture(scope="module")
def speech(spark):
    from captionlake.plans.tables import table

    load = lambda n: table(spark, SMALL, n).toPandas()
    return {n: load(n) for n in ("words", "candidate_words", "regions")}


@tables
def test_p4_on_whole_tables(spark, speech):
    """Pairs are common, in order, and as many as a longest common subsequence has."""
    from captionlake.plans import registry

    got = {}
    for r in registry.QUERIES["p4_lcs_pairs"](spark, SMALL).collect():
        got.setdefault((r.project_id, r.region_idx), []).append((r.word_idx, r.candidate_idx))
    sides = []
    for name in ("words", "candidate_words"):
        by = {}
        for w in speech[name].sort_values(["start", "word_idx"]).itertuples():
            by.setdefault(w.project_id, []).append((w.start, w.end, w.word_idx, key_of(w.text)))
        sides.append(by)
    checked = 0
    for r in speech["regions"].itertuples():
        a, b = ([w for w in s.get(r.project_id, []) if w[1] > r.start and w[0] < r.end] for s in sides)
        pairs = sorted(got.get((r.project_id, r.region_idx), []))
        assert len(pairs) == lcs([w[3] for w in a], [w[3] for w in b])[0][0]
        keys = [{w[2]: w[3] for w in s} for s in (a, b)]
        assert all(keys[0][i] == keys[1][j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        checked += len(pairs)
    assert checked == sum(map(len, got.values())) > 100


@tables
def test_p5_p6_p7_on_whole_tables(spark, speech):
    """The decisions of p3 and the pairs of p4, applied word by word."""
    from captionlake.plans import registry

    rows = lambda q: registry.QUERIES[q](spark, SMALL).collect()
    wins = {(r.project_id, r.region_idx): r.wins for r in rows("p3_retry_wins")}
    differ = {(r.project_id, r.region_idx) for r in rows("p2_hypotheses_disagree")}
    pairs = [(r.project_id, r.region_idx, r.word_idx, r.candidate_idx) for r in rows("p4_lcs_pairs")]
    matched = {p[:3] for p in pairs}
    partners = {}
    for p, r, i, j in sorted(pairs):
        partners.setdefault((p, j), []).append((r, i))
    regions = {}
    for r in speech["regions"].itertuples():
        regions.setdefault(r.project_id, []).append(r)
    met = lambda w: [(w.project_id, r.region_idx) for r in regions.get(w.project_id, []) if w.end > r.start and w.start < r.end]
    marked, swapped, merged = {}, {}, {}
    for w in speech["words"].itertuples():
        key, state = (w.project_id, w.word_idx), ("pending", True) if w.score < 0.65 else ("approved", False)
        where = met(w)
        doubt = any((*r, w.word_idx) not in matched for r in where)
        marked[key] = ("pending", True, "pass-disagreement") if doubt else (*state, None)
        if not where:
            swapped[(*key, "kept")] = (*state, None)
        if not any(wins[r] for r in where):
            hit = any(r in differ and not wins[r] and (*r, w.word_idx) not in matched for r in where)
            merged[(*key, "kept")] = ("pending", True, "pass-disagreement") if hit else (*state, None)
    old = {(w.project_id, w.word_idx): ("pending", True, None) if w.score < 0.65 else ("approved", False, None) for w in speech["words"].itertuples()}
    for w in speech["candidate_words"].itertuples():
        where = met(w)
        for out, taken in ((swapped, bool(where)), (merged, any(wins[r] for r in where))):
            if taken:
                known = [i for r, i in partners.get((w.project_id, w.word_idx), []) if out is swapped or wins[w.project_id, r] or (w.project_id, r) in differ]
                out[w.project_id, w.word_idx, "retry"] = old[w.project_id, known[0]] if known else ("pending", True, "coverage-retry")
    state = lambda r: (r.review_status, r.needs_review, r.review_reason)
    assert {(r.project_id, r.word_idx): state(r) for r in rows("p5_mark_region_for_review")} == marked
    assert {(r.project_id, r.word_idx, r.origin): state(r) for r in rows("p6_replace_region_words")} == swapped
    assert {(r.project_id, r.word_idx, r.origin): state(r) for r in rows("p7_merge_passes")} == merged


@tables
def test_a1_on_whole_tables(spark, speech):
    from captionlake.operators.quality import metric_tokens
    from captionlake.plans import registry

    text = {n: speech[n].sort_values(["project_id", "word_idx"]).groupby("project_id")["text"].apply(" ".join) for n in ("words", "candidate_words")}
    rows = [(int(p), t, text["candidate_words"][p]) for p, t in text["words"].items() if p in text["candidate_words"]]
    table = spark.createDataFrame(rows, "project_id long, a string, b string")
    tokens = {r.project_id: (r.a, r.b) for r in table.select("project_id", metric_tokens(F.col("a"), "english").alias("a"), metric_tokens(F.col("b"), "english").alias("b")).collect()}
    want = {p: round(distance(a, b) / len(a), 6) for p, (a, b) in tokens.items()}
    assert {r.project_id: r.wer for r in registry.QUERIES["a1_word_error_rate"](spark, SMALL).collect()} == pytest.approx(want)


@tables
def test_a4_and_a5_on_whole_tables(spark, speech):
    """All scores of both fixture queries by plain Python, the regions' fallback included, and the report's row from them."""
    from captionlake.plans import captions, registry

    clean = lambda t: re.sub(r"[\W_]+", "", t.lower())
    by = {}
    for name in ("words", "candidate_words"):
        for w in speech[name].sort_values(["project_id", "word_idx"]).itertuples():
            by.setdefault(w.project_id, {}).setdefault(name, []).append(w)
    own, second = (t.toPandas() for t in captions._own_regions(spark, SMALL))
    full = speech["regions"]
    spans_of = lambda table, p: [(r.start, r.end) for r in table[table.project_id == p].itertuples()]
    for query, regions_of in (("a4_evaluate_fixtures", lambda p: spans_of(full, p)), ("a4_evaluate_without_regions", lambda p: spans_of(own, p) or spans_of(second, p))):
        got = {r.project_id: r for r in registry.QUERIES[query](spark, SMALL).collect()}
        assert {*got} == {p for p in by if "words" in by[p]}
        for p, sides in by.items():
            a, b = sides["words"], sides.get("candidate_words", [])
            base = [w for w in a if w.word_idx % 5]
            tokens = lambda ws: [t for t in (clean(w.text) for w in ws) if t]
            wer = lambda ws, a=a: distance(tokens(a), tokens(ws)) / len(tokens(a))
            cer = lambda ws, a=a: distance("".join(tokens(a)), "".join(tokens(ws))) / len("".join(tokens(a)))
            assert (got[p].baseline_wer, got[p].candidate_wer) == pytest.approx((wer(base), wer(b)), abs=1e-6)
            assert (got[p].baseline_cer, got[p].candidate_cer) == pytest.approx((cer(base), cer(b)), abs=1e-6)
            used, off = {}, []
            for w in b:
                used.setdefault(clean(w.text), []).append(w)
            for w in a:
                if used.get(clean(w.text)):
                    v = used[clean(w.text)].pop(0)
                    off += [abs(v.start - w.start), abs(v.end - w.end)]
            assert got[p].median_boundary_error == pytest.approx(float(np.median(off)), abs=1e-6)
            silent = sum(max([0.0, *(min(w.end, e) - max(w.start, s) for s, e in regions_of(p))]) / max(0.001, w.end - w.start) < 0.45 for w in b)
            assert got[p].silent_word_count == silent
        if query == "a4_evaluate_fixtures":
            report = registry.QUERIES["a5_quality_report"](spark, SMALL).first()
            mean = lambda name, got=got: float(np.mean([r[name] for r in got.values()]))
            assert (report.baseline_wer, report.candidate_wer) == pytest.approx((mean("baseline_wer"), mean("candidate_wer")), abs=1e-5)
            assert report.median_boundary_error == sorted(r.median_boundary_error for r in got.values())[len(got) // 2]
            assert report.silent_word_count == sum(r.silent_word_count for r in got.values())


@tables
def test_w5_on_whole_tables(spark):
    """Each phrase has the least cost that any way of grouping it has, and all words are in captions."""
    from captionlake.functions.text import grapheme_count
    from captionlake.operators import alignment, sequences
    from captionlake.plans.tables import table

    rows = sequences.split_phrases(table(spark, SMALL, "words"))
    grouped = alignment.reflow_words(rows, language="english").withColumn("size", grapheme_count(F.col("text"))).toPandas()
    checked = 0
    for _, phrase in grouped.groupby(["project_id", "phrase_idx"]):
        p = phrase.sort_values(["start", "word_idx"])
        n, start, end, size, space = len(p), p["start"].tolist(), p["end"].tolist(), p["size"].tolist(), p["space_before"].tolist()
        part = [c[1] for c in p["caption_idx"].tolist()]

        def cost(i, j, n=n, start=start, end=end, size=size, space=space):
            k = j - i
            chars = sum(size[i:j]) + sum(space[i + 1 : j])
            if k > 9 or (k > 1 and (end[j - 1] - start[i] > 4 or chars > 64)):
                return np.inf
            c = ((k - 5) / 5) ** 2 * 4 + max(0, k - 7) * 4 + (2.5 if k == 1 and n > 1 else 0)
            return c + ((1.5 if n - j == 1 else 0) - min(1.2, max(0, start[j] - end[j - 1]) / 0.08 * 0.3) if j < n else 0)

        best = [np.inf] * n + [0.0]
        for i in reversed(range(n)):
            best[i] = min(cost(i, j) + best[j] for j in range(i + 1, min(n, i + 9) + 1))
        edges = [0, *[i for i in range(1, n) if part[i] != part[i - 1]], n]
        assert sum(cost(i, j) for i, j in zip(edges, edges[1:], strict=False)) == pytest.approx(best[0], abs=1e-5)
        checked += n
    assert checked == table(spark, SMALL, "words").where("end > start").count()


@tables
def test_w8_on_whole_tables(spark, speech):
    from captionlake.operators.sequences import normalize_glossary
    from captionlake.plans import captions, registry

    squeeze = lambda t: re.sub(r"\s+", "", t).lower()
    terms = {}
    for r in normalize_glossary(captions.glossary(spark, SMALL)).orderBy("project_id", "term_idx").collect():
        terms.setdefault(r.project_id, {}).setdefault(squeeze(r.term), r.term)
    want = []
    for p, rows in speech["words"].sort_values(["project_id", "word_idx"]).groupby("project_id"):
        rows, i = rows.to_dict("records"), 0
        while i < len(rows):
            hit = next((j for j in range(min(len(rows), i + 10), i, -1) if squeeze("".join(r["text"] for r in rows[i:j])) in terms.get(p, {})), None)
            part = rows[i : hit or i + 1]
            text = terms[p][squeeze("".join(r["text"] for r in part))] if hit else part[0]["text"]
            want.append((p, part[0]["word_idx"], text, round(part[-1]["end"], 6), len(part)))
            i += len(part)
    got = registry.QUERIES["w8_apply_glossary"](spark, SMALL).collect()
    assert sorted((r.project_id, r.word_idx, r.text, r.end, r.n_merged) for r in got) == sorted(want)


@tables
def test_p8_on_whole_tables(spark, speech):
    """Kept words are a longest common subsequence with their old times; words are in order, inside the caption, and spell the new text."""
    from captionlake.plans import registry

    got = {}
    for r in registry.QUERIES["p8_reconcile_edited_caption"](spark, SMALL).collect():
        got.setdefault((r.project_id, r.caption_idx), []).append(r)
    old, new = ({k: g.sort_values("word_idx") for k, g in speech[n].assign(c=speech[n].word_idx // 5).groupby(["project_id", "c"])} for n in ("words", "candidate_words"))
    assert {*got} == {*old} & {*new}
    for k, rows in got.items():
        rows.sort(key=lambda r: r.word_pos)
        a, b = old[k].to_dict("records"), new[k]["text"].tolist()
        low, high = round(a[0]["start"], 6), round(a[-1]["end"], 6)
        assert [r.text for r in rows] == b
        kept = [(r.old_idx, r) for r in rows if r.old_idx is not None]
        assert len(kept) == lcs([w["text"] for w in a], b)[0][0] and [i for i, _ in kept] == sorted(i for i, _ in kept)
        assert all(r.review_status == "kept" and r.text == a[i]["text"] and r.end >= round(min(a[i]["end"], high), 6) - 1e-6 for i, r in kept)
        assert all(r.start >= low - 1e-6 and r.end <= high + 1e-6 for r in rows)
        assert all(p.end <= q.start + 1e-6 for p, q in zip(rows, rows[1:], strict=False))
        if len(a) == len(b):  # all gaps are even where the words are all replaced one by one
            assert all(abs(r.start - w["start"]) < 1e-5 for r, w in zip(rows, a, strict=True) if r.old_idx is not None and r.old_idx == r.word_pos)


@tables
def test_c12_on_whole_tables(spark):
    """Numbers read back from their words."""
    from captionlake.plans import registry
    from captionlake.plans.tables import table

    digits = {"ศูนย์": 0, "หนึ่ง": 1, "เอ็ด": 1, "สอง": 2, "ยี่": 2, "สาม": 3, "สี่": 4, "ห้า": 5, "หก": 6, "เจ็ด": 7, "แปด": 8, "เก้า": 9}
    places = {"สิบ": 10, "ร้อย": 100, "พัน": 1000, "หมื่น": 10_000, "แสน": 100_000}
    names = re.compile("|".join(sorted([*digits, *places, "ล้าน"], key=len, reverse=True)))

    def number(text):
        total, part, digit = 0, 0, None
        assert names.sub("", text) == ""
        for m in names.findall(text):
            if m in digits:
                digit = digits[m]
            elif m == "ล้าน":
                total, part, digit = (total + part + (digit or 0)) * 10**6, 0, None
            else:
                part, digit = part + (1 if digit is None else digit) * places[m], None
        return total + part + (digit or 0)

    want = {r.o_orderkey: f"{r.o_totalprice:.2f}" for r in table(spark, SMALL, "orders").collect()}
    for r in registry.QUERIES["c12_numbers_to_thai"](spark, SMALL).collect():
        price, order = re.fullmatch("pay (.*) for (.*)", r.spoken).groups()
        whole, _, decimals = price.partition("จุด")
        assert number(order) == r.order_id and number(whole) == int(want[r.order_id].split(".")[0])
        assert "".join(str(digits[m]) for m in names.findall(decimals)) == want[r.order_id].split(".")[1]
