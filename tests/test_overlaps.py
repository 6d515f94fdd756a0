"""Regions that overlap, pieces of speech, and terms that share words: grouped folds against the plain ones, word by word."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_caption_rules import SMALL, key_of, lcs, spans, tables, word, words


def common(a, b):
    best, pairs, i, j = lcs(a, b), [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def merged_plainly(old, new, regions):
    """One region after the other over the whole list of words."""
    now = [dict(w, origin="kept") for w in old]
    for start, end in sorted(regions):
        meets = lambda w, start=start, end=end: w["end"] > start and w["start"] < end
        rank = lambda w: (w["start"], w["word_idx"], w["origin"])
        a, b = sorted(filter(meets, now), key=rank), sorted((dict(w, origin="retry") for w in new if meets(w)), key=rank)
        edges = lambda ws, start=start, end=end: (
            max(0.0, max(start, min(w["start"] for w in ws)) - start) + max(0.0, end - min(end, max(w["end"] for w in ws))) if ws else (end - start) * 2
        )
        text_a, text_b = (key_of("".join(w["text"] for w in ws)) for ws in (a, b))
        mean = lambda ws: sum(w["score"] for w in ws if w["score"] is not None) / max(1, sum(w["score"] is not None for w in ws)) if any(w["score"] is not None for w in ws) else None
        edge, gain = edges(a) - edges(b), len(text_b) - len(text_a)
        better = not a or (text_a and text_a == text_b and edge >= 0.3) or gain >= 3 or (gain >= 2 and edge >= 0.12) or (gain >= 1 and edge >= 0.3)
        sound = mean(a) is None or mean(b) is None or mean(b) >= mean(a) - 0.18
        pairs = common([key_of(w["text"]) for w in a], [key_of(w["text"]) for w in b])
        if b and better and sound:
            prior = {j: a[i] for i, j in pairs}
            state = lambda j, prior=prior: {k: prior[j][k] for k in ("needs_review", "review_status", "review_reason")} if j in prior else {"needs_review": True, "review_status": "pending", "review_reason": "coverage-retry"}
            now = [w for w in now if not meets(w)] + [dict(w, **state(j)) for j, w in enumerate(b)]
        elif text_a and text_b and text_a != text_b:
            same = {id(a[i]) for i, _ in pairs}
            for w in a:
                if id(w) not in same and w["review_status"] != "edited":
                    w.update(needs_review=True, review_status="pending", review_reason="pass-disagreement")
    return sorted((w["word_idx"], w["origin"], w["text"], w["needs_review"], w["review_status"], w["review_reason"]) for w in now)


def speech(rng, n, vocab, project=1):
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.1, 0.4])
        end = t + rng.choice([0.2, 0.5, 0.5, 3.0])
        rows.append(word(i, rng.choice(vocab), round(t, 2), round(end, 2), rng.choice([0.9, 0.5, None]), rng.random() < 0.3, rng.choice(["approved", "pending", "edited"]), rng.choice([None, "own"]), project))
        t = end if rng.random() < 0.9 else t
    return rows


NAMES = ("project_id", "word_idx", "text", "start", "end", "score", "needs_review", "review_status", "review_reason")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merging_equals_the_ordered_fold(spark, seed):
    from captionlake.operators.alignment import merge_passes

    rng = random.Random(seed)
    old, new, regions, want = [], [], [], []
    for project in (1, 2, 3):
        a, b = speech(rng, 60, ["a", "bb", "ccc", "สวัสดี", "-"], project), speech(rng, 60, ["a", "bb", "cccc", "สวัสดี", "x-y"], project)
        last = max(r[4] for r in a)
        spots = sorted((round(s, 2), round(s + rng.choice([0.3, 1.0, 4.0]), 2)) for s in (rng.uniform(0, last) for _ in range(25)))
        spots = list(dict.fromkeys(spots))
        old, new, regions = old + a, new + b, regions + [(project, i, *s) for i, s in enumerate(spots)]
        as_dicts = lambda rows: [dict(zip(NAMES, r, strict=True)) for r in rows]
        want += [(project, *w) for w in merged_plainly(as_dicts(a), as_dicts(b), spots)]
    table = spark.createDataFrame(regions, "project_id long, region_idx long, start double, end double")
    got = merge_passes(words(spark, *old), words(spark, *new), table).collect()
    assert sorted(((r.project_id, r.word_idx, r.origin, r.text, r.needs_review, r.review_status, r.review_reason) for r in got), key=str) == sorted(want, key=str)


def test_a_chain_of_overlaps_takes_as_many_shuffles_as_one(spark):
    from captionlake.operators.alignment import merge_passes

    rng = random.Random(4)
    old, new = speech(rng, 900, ["a", "bb", "ccc"]), speech(rng, 900, ["a", "bb", "cccc"])
    chain = [(i * 0.5, i * 0.5 + 1.2) for i in range(500)]
    plans = []
    for regions in (chain, chain[:1]):
        df = merge_passes(words(spark, *old), words(spark, *new), spans(spark, *regions))
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        got = sorted(((r.word_idx, r.origin, r.text, r.needs_review, r.review_status, r.review_reason) for r in df.collect()), key=str)
        as_dicts = lambda rows: [dict(zip(NAMES, r, strict=True)) for r in rows]
        assert got == sorted(merged_plainly(as_dicts(old), as_dicts(new), regions), key=str)
    assert plans[0] == plans[1]


def test_pieces_of_speech_equal_one_scan(spark):
    """Words that reach over each other, regions that overlap, and gaps: as if each project were scanned as a whole."""
    from captionlake.operators import alignment

    rng = random.Random(5)
    rows, want = [], {}
    for p in range(6):
        before = 0.0
        at = 0.0
        for i in range(80):
            at += rng.choice([0.0, 0.0, 0.1, 2.0])
            start, end = at, at + rng.choice([0.02, 0.2, 0.5])
            lo, hi = start - rng.choice([0.0, 0.3, 1.0]), end + rng.choice([-0.01, 0.0, 0.4])
            rows.append((p, i, start, end, lo, hi))
            s, e = max(start, lo, before), min(end, hi)
            if e - s < 0.04:
                e = min(hi, s + 0.04)
            if e - s >= 0.04:
                want[p, i] = (s, e)
                before = e
            at = end if rng.random() < 0.8 else at
    best = spark.createDataFrame([(p, i, s, e, 0, lo, hi) for p, i, s, e, lo, hi in rows], "project_id long, word_idx long, start double, end double, region_idx long, region_start double, region_end double")
    said = spark.createDataFrame([(p, i, "w", s, e, 0.9, False, "approved") for p, i, s, e, *_ in rows], "project_id long, word_idx long, text string, start double, end double, score double, needs_review boolean, review_status string")
    regions = best.select("project_id", "region_idx", F.col("region_start").alias("start"), F.col("region_end").alias("end"))
    got = alignment.align_words_to_regions(said, best, regions).collect()
    assert {(r.project_id, r.word_idx): (r.start, r.end) for r in got} == want
    assert len(want) > 300


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_that_share_words(spark, seed):
    """Longest first, from the left, on texts of few words, so that runs overlap in long chains."""
    from captionlake.operators.alignment import apply_glossary

    rng = random.Random(seed)
    kind = "project_id long, word_idx long, text string, start double, end double, score double"
    rows, terms, want = [], [], []
    for p in range(4):
        text = [rng.choice(["a", "b", "A b", "", "ไ"]) for _ in range(150)]
        own = list(dict.fromkeys("".join(rng.choice("abไ") for _ in range(rng.randint(1, 12))) for _ in range(12)))
        rows += [(p, 3 * i + p, t, float(i), i + 1.0, None if i % 7 == 0 else i / 150) for i, t in enumerate(text)]
        terms += [(p, i, t) for i, t in enumerate(own if p else [])]
        keys, i = [t.replace(" ", "").lower() for t in text], 0
        while i < len(text):
            hit = next((j for j in range(min(len(text), i + 10), i, -1) if p and "".join(keys[i:j]) in own), None)
            n = (hit or i + 1) - i
            scores = [k / 150 for k in range(i, i + n) if k % 7]
            want.append((p, 3 * i + p, "".join(keys[i : i + n]) if hit else text[i], float(i + n), n, round(sum(scores) / len(scores), 9) if scores else None))
            i += n
    table = spark.createDataFrame(terms, "project_id long, term_idx long, term string")
    got = apply_glossary(spark.createDataFrame(rows, kind), table).collect()
    assert sorted((r.project_id, r.word_idx, r.text, r.end, r.n_merged, r.score if r.score is None else round(r.score, 9)) for r in got) == sorted(want)


@tables
def test_terms_are_found_without_joins(spark):
    """The size of words is unknown before they are read, so a join would send them, or their runs, to the driver where the table looks small."""
    from captionlake.plans import registry

    plan = registry.QUERIES["w8_apply_glossary"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("batch", [1, 2, 7, 64])
def test_terms_across_batches(spark, batch):
    """Runs that begin in one Arrow batch and end in a later one; projects with terms after projects without; a null project; missing scores and flags."""
    from captionlake.operators.alignment import apply_glossary

    rng = random.Random(batch)
    kind = "word_idx int, note array<string>, text string, project_id string, start double, end double, score float, review_score double, confidence double, raw_confidence double, needs_review boolean"
    rows, terms, want = [], [], []
    for p in [None, *"edcba"]:
        own = {} if p in (None, "c") else {k: k.upper() for k in {"".join(rng.choice("ab") for _ in range(rng.randint(1, 11))) for _ in range(8)}}
        terms += [(p, i, t) for i, t in enumerate(own.values() if p else ["a", "ab"])] + [(p, 99 + i, t.lower()) for i, t in enumerate(own.values())]
        pick = lambda *more: rng.choice([None, float("nan"), *more])
        said = [(i, [f"{p}{i}"], rng.choice(["a", " b", "A b", "", None]), p, float(i), i + 0.5, pick(0.5, 0.25), pick(1.0, 2.0), pick(4.0, 3.0), pick(8.0), rng.choice([None, True, False])) for i in range(40)]
        rows += said
        keys, i = [(r[2] or "").replace(" ", "").lower() for r in said], 0
        while i < len(said):
            hit = next((j for j in range(min(len(said), i + 10), i, -1) if "".join(keys[i:j]) in own), None)
            run, first = said[i : hit or i + 1], said[i]
            if hit:
                mean = lambda found: sum(found) / len(found) if (found := [x for x in found if x is not None and x == x]) else None
                raw = mean([r[8] if r[9] is None else r[9] for r in run])
                first = (*first[:2], own["".join(keys[i:hit])], *first[3:5], run[-1][5], *(mean([r[k] for r in run]) for k in (6, 7, 8)), raw, any(r[10] for r in run))
            want.append((*first, len(run)))
            i += len(run)
    names = [c.split()[0] for c in kind.split(", ")]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = apply_glossary(spark.createDataFrame(rows, kind), spark.createDataFrame(terms, "project_id string, term_idx int, term string"))
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found.columns == ["project_id", *[n for n in names if n != "project_id"], "n_merged"]
    assert sorted(repr(tuple(r[n] for n in (*names, "n_merged"))) for r in got) == sorted(map(repr, want))
    assert any(r.n_merged > 4 for r in got)
