"""The pipeline's stages, one after the other, on a small corpus."""

import random

from tests.llm.corpus import rows


def corpus(tmp_path, spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    data, labels = [], []
    for i in range(240):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 160))]
        good = i % 4 != 0
        text = " ".join(words) if good else " ".join(w + rng.choice(["###", "$$$"]) for w in words)
        data.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    text = data[1][1].split(" ")
    text[5] = "changed"
    data.append((900, " ".join(text), "en", "s0", 0))  # a near copy
    data.append((901, data[2][1], "en", "s0", 0))  # a copy
    data.append((902, data[5][1].replace(" ", "\n", 3) + "\ntoken = abcdefgh12345678", "en", "s0", 0))
    data += [(2000 + r[0], r[1], r[2], r[3], r[4]) for r in rows() if r[1] is None or not r[1].strip()]
    path = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, data


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    path, data = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = p.quality_classifier(spark, docs, path)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(240) if i % 4} <= ids and not {i for i in range(240) if i % 4 == 0} & ids
    lines = p.line_dedup(spark, docs, path)
    assert lines.columns == docs.columns
    got = {r.doc_id: r for r in lines.collect()}
    assert 901 not in got and got[2].text == data[2][1] and all(r.text is None or r.n_chars == len(r.text) for r in got.values())
    groups = p.ngram_jaccard_join(spark, docs, path)
    assert groups.columns == docs.columns
    left = {r.doc_id for r in groups.collect()}
    assert not {900, 901} & left and {1, 2} <= left
    secret = {r.doc_id: r.text for r in p.secret_scans(spark, docs, path).collect()}
    assert secret[902].endswith("\n[SECRET]") and secret[1] == data[1][1]
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "secret_scans", "packing"]


def test_run(spark, tmp_path):
    """run() equals the stages, each written and read again."""
    import corpus_pipeline as p

    path, _ = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = sorted(tuple(r) for r in docs.select(names).collect())
    assert sorted(tuple(r) for r in p.run(spark, path).select(names).collect()) == want and len(want) > 170


CLASH = ["found", "n_hex", "score", "_score", "cuts", "later_id", "n_lines", "component_id", "place", "fold", "node"]


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, and columns of any name: each stage gives its columns and loses no clean row."""
    from pyspark.sql import functions as F

    import corpus_pipeline as p

    path, _ = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({n: F.lit(i) for i, n in enumerate(CLASH)})
    odd = docs.unionByName(docs.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    total = odd.count()
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
        got = stage(spark, odd, path)
        if name == "packing":
            assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
            continue
        assert got.columns == docs.columns
        rows = got.collect()
        assert total - 80 <= len(rows) <= total and {tuple(r[n] for n in CLASH) for r in rows if r.doc_id is not None} == {tuple(range(len(CLASH)))}
        assert sum(r.doc_id is None for r in rows) == 2


def test_repeated_rows_in_stages(spark, tmp_path):
    """Equal rows stay or go together; documents that are copies under other ids leave one."""
    import corpus_pipeline as p

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda stage: sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect())
    assert ids(p.ngram_jaccard_join) == [1, 1] and ids(p.line_dedup) == [1, 1] and ids(p.secret_scans) == [1, 1, 2] and ids(p.packing) == [1, 1, 2]
