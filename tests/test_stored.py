"""Named export files, updates of stored tables, and ranks found in passes."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

CAPTION = "project_id long, caption_idx long, start double, end double, text string"


def captions(spark, projects=5, n=4):
    rows = [(p, i, i * 2.0, i * 2.0 + 1.5, f"line {i}\nof ไทย {p}") for p in range(projects) for i in range(n)]
    return spark.createDataFrame(rows, CAPTION)


# --- named files ------------------------------------------------------------------------------------------------------


def test_one_named_file_a_project_and_back(spark, tmp_path):
    from captionlake.sources.exports import write_documents
    from captionlake.sources.files import read_subtitles, to_srt

    names = spark.createDataFrame([(0, "Talk one.mp4"), (1, "talk ONE.mov"), (2, "../up/a:b?.mkv"), (3, ".hidden"), (4, None)], "project_id long, name string")
    path = str(tmp_path / "out")
    write_documents(to_srt(captions(spark)), "srt", "srt", path, names)
    assert sorted(os.listdir(path)) == ["4.srt", "Talk one.srt", "a b.srt", "hidden.srt", "talk ONE-2.srt"]
    got = {(os.path.basename(r.path.replace("%20", " ")), r.cue_idx, r.start, r.end, r.text) for r in read_subtitles(spark, path).collect()}
    files = {0: "Talk one.srt", 1: "talk ONE-2.srt", 2: "a b.srt", 3: "hidden.srt", 4: "4.srt"}
    assert got == {(files[r.project_id], r.caption_idx, r.start, r.end, r.text) for r in captions(spark).collect()}
    assert open(f"{path}/4.srt", encoding="utf-8").read().startswith("﻿1\n00:00:00,000 --> ")


def test_append_overwrite_and_empty_exports(spark, tmp_path):
    from captionlake.sources.exports import write_documents
    from captionlake.sources.files import to_srt

    path = str(tmp_path / "out")
    documents = to_srt(captions(spark))
    write_documents(documents.where("project_id < 2"), "srt", "srt", path)
    write_documents(documents.where("project_id = 2"), "srt", "srt", path)
    assert sorted(os.listdir(path)) == ["0.srt", "1.srt", "2.srt"]
    before = open(f"{path}/2.srt").read()
    with pytest.raises(Exception, match="files are there already"):
        write_documents(documents.where("project_id >= 2"), "srt", "srt", path)
    assert sorted(os.listdir(path)) == ["0.srt", "1.srt", "2.srt"] and open(f"{path}/2.srt").read() == before
    write_documents(documents.where("project_id >= 2"), "srt", "srt", path, overwrite=True)
    assert sorted(os.listdir(path)) == ["2.srt", "3.srt", "4.srt"]
    write_documents(documents.where("project_id > 99"), "srt", "srt", path, overwrite=True)
    assert os.listdir(path) == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from captionlake.sources import exports

    exports.register(spark)
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.srt", "x"), ("b.srt", "y"), ("bad/name.srt", "z")], "file string, document string").repartition(3)
    with pytest.raises(Exception, match="not a file name"):
        rows.write.format(exports.FORMAT).mode("append").save(path)
    assert not os.path.isdir(path) or {*os.listdir(path)} <= {"_staging"}  # a task that was still running may have left its own staging folder
    twice = spark.createDataFrame([("a.srt", "x"), ("a.srt", "y")], "file string, document string").repartition(2)
    with pytest.raises(Exception, match="one file name"):
        twice.write.format(exports.FORMAT).mode("append").save(path)
    assert not os.path.isdir(path) or {*os.listdir(path)} <= {"_staging"}


def test_readers_over_folders_with_malformed_files(spark, tmp_path):
    from captionlake.sources.files import load_ground_truth, read_subtitles, read_transcripts

    folder = tmp_path / "subs"
    folder.mkdir()
    (folder / "good.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nhello\n", encoding="utf-8")
    (folder / "good.vtt").write_text("WEBVTT\n\nNOTE x --> y\n\n00:01.000 --> 00:02.500 align:start\n<b>hi</b>\n", encoding="utf-8")
    (folder / "empty.srt").write_text("", encoding="utf-8")
    (folder / "none.srt").write_text("just text", encoding="utf-8")
    (folder / "bad.srt").write_text("1\n00:00:05,000 --> 00:00:01,000\nback\n\n2\n00:00:06,000 --> 00:00:07,000\nfine\n", encoding="utf-8")
    got = {(os.path.basename(r.path), r.cue_idx, r.start, r.text, r.error) for r in read_subtitles(spark, str(folder)).collect()}
    assert got == {("good.srt", 0, 0.0, "hello", None), ("good.vtt", 0, 1.0, "hi", None), ("none.srt", None, None, None, "no cues"), ("bad.srt", 0, 5.0, "back", "bad time"), ("bad.srt", 1, 6.0, "fine", None)}
    results = tmp_path / "results"
    results.mkdir()
    (results / "a.json").write_text('{"segments": [{"words": [{"word": " hi", "start": 0, "end": 1, "probability": 0.5}], "avg_logprob": -0.1, "no_speech_prob": 0.1}]}')
    (results / "broken.json").write_text('{"segments": [')
    assert {os.path.basename(r.project_id) for r in read_transcripts(spark, str(results)).collect()} <= {"a.json"}
    fixtures = tmp_path / "fixtures"
    fixtures.mkdir()
    (fixtures / "one.json").write_text('{"language": "th", "reference": {"text": "a b", "words": [{"text": "a", "start": 0, "end": 1}]}, "baseline": {"text": "a"}}')
    (fixtures / "broken.json").write_text("not json")
    rows = {r.file: r for r in load_ground_truth(spark, str(fixtures)).collect()}
    assert rows["one.json"].reference.text == "a b" and rows["one.json"].candidate is None and rows["broken.json"].reference is None


# --- stored tables ------------------------------------------------------------------------------------------------------


def state(path):
    """Every data file with the time it was written."""
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def buckets(files):
    return {int(f.split("/")[0].split("=")[1]) for f in files}


def test_a_purge_rewrites_one_bucket_of_each_table(spark, tmp_path):
    from captionlake.operators import stored

    words = spark.range(4000).selectExpr("id % 40 AS project_id", "id AS word_idx", "concat('w', id) AS text")
    clips = spark.range(400).selectExpr("id % 50 AS project_id", "id AS clip_id")
    paths = [str(tmp_path / "words"), str(tmp_path / "clips")]
    for rows, path in zip((words, clips), paths, strict=True):
        stored.store_table(rows, path, buckets=16)
    before = [state(p) for p in paths]
    gone = spark.createDataFrame([(7,), (999,)], "project_id long")
    own = {r[0] for r in gone.select(stored.bucket_of(F.col("project_id"), 16)).collect()}
    touched = stored.purge_stored(spark, paths, gone, buckets=16)
    for path, old, rows in zip(paths, before, (words, clips), strict=True):
        new = state(path)
        changed = buckets({f for f in old if new.get(f) != old[f]} | {f for f in new if f not in old})
        assert changed == {*touched[path]} <= own and changed
        assert sorted(map(tuple, stored.read_table(spark, path).collect())) == sorted(map(tuple, rows.where("project_id <> 7").collect()))


def test_conditional_updates_touch_what_they_change(spark, tmp_path):
    from captionlake.operators import records, stored

    path = str(tmp_path / "jobs")
    jobs = spark.range(500).selectExpr("id AS job_id", "id % 60 AS project_id", "CASE WHEN id % 60 IN (3, 4) AND id % 7 = 0 THEN 'running' ELSE 'complete' END AS status", "CAST(NULL AS STRING) AS error")
    stored.store_table(jobs, path, buckets=32)
    old = state(path)
    touched = stored.recover_stored_jobs(spark, path, buckets=32)
    new = state(path)
    assert 0 < len(touched) <= 2 and buckets({f for f in old if new.get(f) != old[f]}) == {*touched}
    want = records.recover_jobs(jobs).select("job_id", "status", "error").collect()
    assert sorted(map(tuple, stored.read_table(spark, path).select("job_id", "status", "error").collect()), key=str) == sorted(map(tuple, want), key=str)
    assert stored.recover_stored_jobs(spark, path, buckets=32) == [] and state(path) == new  # nothing is open any more
    # a bucket that loses all rows goes
    everything = spark.range(60).selectExpr("id AS project_id")
    stored.purge_stored(spark, [path], everything.where("project_id < 59"), buckets=32)
    assert {r.project_id for r in stored.read_table(spark, path).select("project_id").distinct().collect()} == {59}
    assert len(buckets(state(path))) == 1


def test_migration_of_stored_words(spark, tmp_path):
    from captionlake.operators import records, stored

    path = str(tmp_path / "words")
    words = spark.range(300).selectExpr(
        "id % 30 AS project_id", "id AS word_idx", "CAST(0.5 AS DOUBLE) AS confidence", "CAST(NULL AS DOUBLE) AS raw_confidence", "true AS needs_review", "'odd' AS review_status", "'manual' AS timing_source",
        "CAST(IF(id % 30 < 3, 2, 3) AS INT) AS schema_version",
    )
    stored.store_table(words, path, buckets=32)
    old = state(path)
    touched = stored.migrate_stored_words(spark, path, buckets=32)
    assert 0 < len(touched) <= 3 and buckets({f for f in old if state(path).get(f) != old[f]}) == {*touched}
    names = words.columns
    want = records.migrate_words_v3(words).select(*names).collect()
    assert sorted(map(tuple, stored.read_table(spark, path).select(*names).collect()), key=str) == sorted(map(tuple, want), key=str)


# --- ranks ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cuts", [2, 512])
def test_value_at_rank(spark, monkeypatch, cuts):
    from captionlake.operators import quality

    monkeypatch.setattr(quality, "CUTS", cuts)
    rng = random.Random(cuts)
    for values in (
        [rng.choice([0.1, 0.1 + 2**-55, 0.25, 3.0]) for _ in range(40)],
        [rng.gauss(0, 1) * 10 ** rng.randint(-5, 5) for _ in range(60)],
        [5.0],
        [-1e308, 1e308, 0.0, 5e-324, -0.0, 1.0],
    ):
        df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
        for rank in {0, len(values) // 2, len(values) - 1}:
            assert quality.value_at_rank(df, "v", rank) == sorted(values)[rank]
        assert quality.value_at_rank(df, "v", len(values)) is None
    assert quality.value_at_rank(spark.createDataFrame([], "v double"), "v", 0) is None
