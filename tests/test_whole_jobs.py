"""Queries without SQL take all captions, rules, terms and texts."""

import os

import pytest

from captionlake.plans import captions, registry
from captionlake.plans.tables import table

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_all_captions_are_spoken(spark):
    want = {(r.project_id, r.caption_idx) for r in registry.QUERIES["a12_words_to_captions"](spark, SMALL).collect()}
    got = registry.QUERIES["c11_apply_pronunciations"](spark, SMALL).collect()
    assert max(i for _, i in want) >= 10
    assert len(got) == len(want) and {(r.project_id, r.caption_idx) for r in got} == want


def test_rules_and_terms_of_all_words(spark):
    words = {r.project_id: r.n for r in table(spark, SMALL, "words").groupBy("project_id").count().withColumnRenamed("count", "n").collect()}
    items = captions.glossary(spark, SMALL).groupBy("project_id").count().collect()
    assert max(words.values()) > 50
    assert {r.project_id: r["count"] for r in items} == {p: -(-n // 4) for p, n in words.items()}
    assert max(len(r.rules) for r in captions._rules(spark, SMALL).collect()) == min(100, max(words.values()))


def test_whole_names(spark):
    got = {r.doc_id: r.name for r in registry.QUERIES["c6_repair_filename"](spark, SMALL).collect()}
    assert got == {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
