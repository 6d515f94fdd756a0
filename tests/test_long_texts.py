"""Texts and transcripts of a whole long project: linear segmentation, distances in bands."""

import random
import time

import pytest
from pyspark.sql import functions as F


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, a, vocab, rate):
    out = []
    for x in a:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(rng.choice(vocab) if r < 2 * rate / 3 else x)
        if r > 1 - rate / 3:
            out.append(rng.choice(vocab))
    return out


@pytest.mark.parametrize(("band", "strip"), [(64, 4096), (1, 7), (3, 1), (2, 50)])
def test_distance_equals_the_plain_one(monkeypatch, band, strip):
    from captionlake.functions import distance

    monkeypatch.setattr(distance, "FIRST_BAND", band)
    monkeypatch.setattr(distance, "STRIP", strip)
    rng = random.Random(band)
    for _ in range(400):
        vocab = "abcdefghij"[: rng.choice([1, 2, 4, 10])]
        a = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        b = edited(rng, a, vocab, rng.random()) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        assert distance.edit_distance(a, b) == plain_distance(a, b)
        assert distance.edit_distance("".join(a), "".join(b)) == distance.edit_distance(b, a)


def test_distance_of_long_transcripts():
    from captionlake.functions.distance import edit_distance

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    a = [rng.choice(vocab) for _ in range(40_000)]
    b = edited(rng, a, vocab, 0.06)
    began = time.process_time()
    far = edit_distance(a, b)
    assert time.process_time() - began < 3  # half a second here; the plain table has 1.6 billion cells
    assert 1000 < far < 2600
    # changes at known places only
    c = list(a)
    for i in range(0, 40_000, 400):
        c[i] = "other"
    assert edit_distance(a, c) == 100 and edit_distance(a, c[5:] + ["x"] * 9) <= 114


def test_long_texts_have_the_rates_of_short_ones(spark, monkeypatch):
    from captionlake.operators import quality

    rng = random.Random(7)
    pairs = []
    for i in range(30):
        a = [rng.choice("abcdeé ไทย") for _ in range(rng.randint(0, 80))]
        pairs.append((i, "".join(a), "".join(edited(rng, a, "abcé", 0.3))))
    pairs += [(30, None, "x"), (31, "", ""), (32, "abc", None), (33, "!!", "")]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    want = {r.i: r.x for r in df.select("i", quality.char_error_rate(F.col("a"), F.col("b")).alias("x")).collect()}
    monkeypatch.setattr(quality, "SHORT", 0)
    assert {r.i: r.x for r in df.select("i", quality.char_error_rate(F.col("a"), F.col("b")).alias("x")).collect()} == want
    assert want[30] == 1.0 and want[31] == 0.0 and want[32] == 1.0 and want[33] == 0.0


def test_character_rate_of_a_whole_project(spark):
    from captionlake.operators.quality import char_error_rate

    rng = random.Random(8)
    a = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    b = a[:30_000] + "xyz" + a[30_010:90_000] + a[90_500:]
    row = spark.createDataFrame([(a, b)], "a string, b string").select(char_error_rate(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x == pytest.approx(510 / 100_000, abs=3e-5)


def segments_by_fold(text, words):
    """The definition: each word is found in what is left of the text; marks go to the word before."""
    out, rest, first = [], text, True
    for w in words:
        gap, _, rest = rest.partition(w)
        if marks := "".join(gap.split()):
            out = out[:-1] + [(out[-1][0] + marks, *out[-1][1:])] if out else [(marks, False, False)]
        out.append((w, True, not first and gap[-1:].isspace()))
        first = False
    if marks := "".join(rest.split()):
        out = out[:-1] + [(out[-1][0] + marks, *out[-1][1:])] if out else [(marks, False, False)]
    return out


def test_segments_equal_the_fold(spark):
    from captionlake.functions.text import segmented

    rng = random.Random(9)
    parts = ["a", "hello", "don't", "3.14", "-", ",", "…", " ", "  ", "(", ")", "กำลัง", "ทดสอบ", "ระบบ", "ๆ", "é", "$5", "a.b", "\n", "!?"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "...", " , a", "a ,b", "aa a aaa"]
    for language in ("english", "th"):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        rows = df.select("i", "t", F.flatten(F.sentences("t", F.lit("th" if language == "th" else "en"), F.lit(""))).alias("w"), segmented(F.col("t"), language).alias("s")).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert [tuple(x) for x in r.s] == segments_by_fold(r.t or "", r.w or [])


def test_segmentation_takes_time_with_the_length(spark):
    from captionlake.functions.text import word_segments

    rng = random.Random(10)
    took = {}
    for n in (4_000, 16_000, 64_000):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", ",", "."]) for _ in range(n))
        df = spark.createDataFrame([(text,)], "t string").cache()
        df.count()
        for _ in range(2):
            began = time.time()
            got = df.select(F.size(word_segments(F.col("t"), "english")).alias("n")).first().n
            took[n] = time.time() - began
        assert got == n
        df.unpersist()
    assert took[16_000] < 3 and took[64_000] < 12 * max(took[16_000], 0.3)
    thai = "กำลังทดสอบระบบใหม่ครับ" * 3_000  # no white space at all
    df = spark.createDataFrame([(thai,)], "t string")
    began = time.time()
    words = df.select(word_segments(F.col("t"), "th").alias("w")).first().w
    assert "".join(w.text for w in words) == thai and time.time() - began < 10
