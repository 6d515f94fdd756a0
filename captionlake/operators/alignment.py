"""Comparing two passes over the same speech, and the sequential helpers that windows can't express.

Each helper works on arrays of one bounded group (a region, a caption, a phrase, a project's words) that Spark has collected
in order; it is called for a batch of groups at a time.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from captionlake.functions.text import attaches_to_previous, grapheme_count, hypothesis_key, thai_risk
from captionlake.functions.udf import vectorised
from captionlake.operators.intervals import as_right, interval_join
from captionlake.operators.sequences import by_project

TEXT_GAIN, SMALL_TEXT_GAIN, EDGE_GAIN, SMALL_EDGE_GAIN, SCORE_DROP = 3, 2, 0.3, 0.12, 0.18


@vectorised("string")
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def word_key(text: Column) -> Column:
    return hypothesis_key(nfkc(text))


def _score(df: DataFrame) -> Column:
    return F.coalesce(*[F.col(c) for c in ("review_score", "raw_confidence", "confidence", "score") if c in df.columns], F.lit(None).cast("double"))


def _reason(df: DataFrame) -> Column:
    return F.col("review_reason") if "review_reason" in df.columns else F.lit(None).cast("string")


def region_side(rows: DataFrame, regions: DataFrame, tag: str) -> DataFrame:
    """For every region what a pass has in it: number of words, uncovered edges, letters and digits of its text, mean score, list of words.

    Columns n_, edges_, text_, score_ and words_ with the tag; words_ is null where there are none. All comes from one interval join.
    """
    slim = rows.select("project_id", "word_idx", "text", "start", "end", word_key(F.col("text")).alias("key"), _score(rows).alias("_score"))
    spans = regions.select("project_id", "region_idx", "start", "end")
    found = interval_join(slim, as_right(spans), ["project_id"]).groupBy("project_id", "region_idx").agg(
        F.count("*").alias("n"), F.min("start").alias("lo"), F.max("end").alias("hi"), F.avg(F.nanvl("_score", F.lit(None))).alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "word_idx", "text", "key"))).alias("words"),
    )
    joined = spans.join(found, ["project_id", "region_idx"], "left")
    edges = F.greatest(F.lit(0.0), F.greatest("start", "lo") - F.col("start")) + F.greatest(F.lit(0.0), F.col("end") - F.least("end", "hi"))
    edges = F.when(F.col("n").isNull(), (F.col("end") - F.col("start")) * 2).otherwise(edges)
    raw = F.array_join(F.transform("words", lambda x: x["text"]), "")
    out = {"n": F.coalesce("n", F.lit(0)), "edges": edges, "text": word_key(F.coalesce(raw, F.lit(""))), "score": F.col("score"), "words": F.col("words")}
    return joined.select("project_id", "region_idx", *[c.alias(f"{name}_{tag}") for name, c in out.items()])


def region_sides(words: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Both passes' sides (a: words, b: candidates) of every region."""
    return region_side(words, regions, "a").join(region_side(candidates, regions, "b"), ["project_id", "region_idx"])


def hypothesis_text(words: DataFrame, regions: DataFrame) -> DataFrame:
    """hypothesis: for each region the letters and digits of its words, in order."""
    return region_side(words, regions, "a").select("project_id", "region_idx", F.col("text_a").alias("hypothesis"))


def _differ() -> Column:
    return (F.col("text_a") != "") & (F.col("text_b") != "") & (F.col("text_a") != F.col("text_b"))


def hypotheses_disagree(words: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions whose two texts are both there and differ."""
    return region_sides(words, candidates, regions).where(_differ()).select("project_id", "region_idx")


def _wins() -> Column:
    """The candidate has words in the region, is better covered or longer, and its score has not dropped much."""
    edge = F.col("edges_a") - F.col("edges_b")
    gain = grapheme_count(F.col("text_b")) - grapheme_count(F.col("text_a"))
    same = (F.col("text_a") != "") & (F.col("text_a") == F.col("text_b"))
    better = (F.col("n_a") == 0) | (same & (edge >= EDGE_GAIN)) | (gain >= TEXT_GAIN) | ((gain >= SMALL_TEXT_GAIN) & (edge >= SMALL_EDGE_GAIN)) | ((gain >= 1) & (edge >= EDGE_GAIN))
    sound = F.col("score_a").isNull() | F.col("score_b").isNull() | (F.col("score_b") >= F.col("score_a") - SCORE_DROP)
    return (F.col("n_b") > 0) & better & sound


def compare_passes(words: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region with wins (the candidate pass should replace its words) and differ (both have text, and not the same)."""
    return region_sides(words, candidates, regions).select("project_id", "region_idx", _wins().alias("wins"), _differ().alias("differ"))


def retry_wins(words: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region with wins."""
    return compare_passes(words, candidates, regions).drop("differ")


def common_pairs(left: list, right: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; where both sides could move on, the left one does."""
    m, n = len(left), len(right)
    codes = {k: i for i, k in enumerate(dict.fromkeys([*left, *right]))}
    a, b = np.array([codes[x] for x in left], np.int64), np.array([codes[x] for x in right], np.int64)
    best = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m - 1, -1, -1):
        # a row from its right end: the running maximum of matches and of the row below
        reach = np.maximum(best[i + 1, :n], np.where(b == a[i], best[i + 1, 1:] + 1, 0))
        best[i, :n] = np.maximum.accumulate(reach[::-1])[::-1]
    pairs, i, j = [], 0, 0
    while i < m and j < n:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return pairs


@vectorised("array<struct<left:int,right:int>>")
def _common_pairs(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[{"left": i, "right": j} for i, j in common_pairs(list(a), list(b))] for a, b in zip(left, right, strict=True)])


def _matched(sides: DataFrame) -> DataFrame:
    """(project_id, region_idx, word_idx, candidate_idx) of words that both sides of a region have."""
    keys = lambda c: F.transform(c, lambda x: x["key"])
    found = sides.where("words_a IS NOT NULL AND words_b IS NOT NULL").withColumn("p", F.explode(_common_pairs(keys("words_a"), keys("words_b"))))
    return found.select("project_id", "region_idx", F.col("words_a")[F.col("p.left")]["word_idx"].alias("word_idx"), F.col("words_b")[F.col("p.right")]["word_idx"].alias("candidate_idx"))


def lcs_pairs(words: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """(project_id, region_idx, word_idx, candidate_idx) of words that both passes have in a region."""
    return _matched(region_sides(words, candidates, regions))


def _members(sides: DataFrame, tag: str, *more: str) -> DataFrame:
    """(project_id, region_idx, word_idx) of one side's words."""
    return sides.select("project_id", "region_idx", *more, F.explode(f"words_{tag}").alias("w")).select("project_id", "region_idx", *more, "w.word_idx")


_WORD = ["project_id", "word_idx", "text", "start", "end"]


def _decided(words: DataFrame, candidates: DataFrame, sides: DataFrame, reason: str) -> DataFrame:
    """Words after the decisions of disjoint regions (sides with wins): the candidate's words, or doubtful ones marked, or as they were.

    A word marked or replaced before keeps its own reason where no decision gives a new one; a candidate's word that matches an old one takes over
    the old one's review state and reason.
    """
    pairs = _matched(sides)
    met = _members(sides, "a", "wins").join(pairs.select("project_id", "region_idx", "word_idx", F.lit(True).alias("same")).distinct(), ["project_id", "region_idx", "word_idx"], "left")
    state = met.groupBy("project_id", "word_idx").agg(F.max("wins").alias("gone"), F.max(~F.col("wins") & F.col("same").isNull()).alias("doubt"))
    origin = F.col("origin") if "origin" in words.columns else F.lit("kept")
    rows = words.select(*_WORD, _score(words).alias("score"), "needs_review", "review_status", _reason(words).alias("review_reason"), origin.alias("origin"))
    kept = rows.join(state, ["project_id", "word_idx"], "left").where("NOT coalesce(gone, false)")
    hit = F.coalesce("doubt", F.lit(False)) & (F.col("review_status") != "edited")
    kept = kept.select(
        *_WORD, "score", (hit | F.col("needs_review")).alias("needs_review"), F.when(hit, "pending").otherwise(F.col("review_status")).alias("review_status"),
        F.when(hit, reason).otherwise(F.col("review_reason")).alias("review_reason"), "origin",
    )
    old = pairs.join(rows.select("project_id", "word_idx", F.struct("needs_review", "review_status", "review_reason").alias("o")), ["project_id", "word_idx"])
    prior = old.groupBy("project_id", F.col("candidate_idx").alias("word_idx")).agg(F.min_by("o", "region_idx").alias("o"))
    taken = _members(sides.where("wins"), "b").select("project_id", "word_idx").distinct()
    fresh = candidates.select(*_WORD, _score(candidates).alias("score")).join(taken, ["project_id", "word_idx"]).join(prior, ["project_id", "word_idx"], "left")
    fresh = fresh.select(
        *_WORD, "score", F.coalesce("o.needs_review", F.lit(True)).alias("needs_review"), F.coalesce("o.review_status", F.lit("pending")).alias("review_status"),
        F.when(F.col("o").isNull(), "coverage-retry").otherwise(F.col("o.review_reason")).alias("review_reason"), F.lit("retry").alias("origin"),
    )
    return kept.unionByName(fresh)


def mark_region_for_review(words: DataFrame, candidates: DataFrame, regions: DataFrame, reason: str = "pass-disagreement") -> DataFrame:
    """words with needs_review, review_status and review_reason set where a region's word has no match and wasn't edited; others keep theirs."""
    sides = region_sides(words, candidates, regions)
    unmatched = _members(sides, "a").join(_matched(sides), ["project_id", "region_idx", "word_idx"], "left_anti").select("project_id", "word_idx").distinct().withColumn("_hit", F.lit(True))
    joined = words.withColumn("review_reason", _reason(words)).join(unmatched, ["project_id", "word_idx"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("review_status") != "edited")
    new = {
        "needs_review": hit | F.col("needs_review"), "review_reason": F.when(hit, reason).otherwise(F.col("review_reason")),
        "review_status": F.when(hit, "pending").otherwise(F.col("review_status")),
    }
    return joined.withColumns(new).drop("_hit")


def replace_region_words(words: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Words outside the regions and the candidates' words inside; a matched candidate keeps the old review state, others wait for review."""
    return _decided(words, candidates, region_sides(words, candidates, regions).withColumn("wins", F.lit(True)), "").drop("score")


_DECIDED = "array<struct<word_idx:long,text:string,start:double,end:double,needs_review:boolean,review_status:string,review_reason:string,origin:string>>"


def _letters(text: str) -> str:
    """Lower-case letters and digits of the compatibility form."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if unicodedata.category(c)[0] in "LN")


class _Pass:
    """Words in order of start that come into reach of regions in order of start, and leave it for good."""

    def __init__(self, words: list[dict]):
        self.waiting, self.at, self.near, self.gone = words, 0, [], []

    def inside(self, start: float, end: float) -> list[dict]:
        while self.at < len(self.waiting) and self.waiting[self.at]["start"] < end:
            self.near.append(self.waiting[self.at])
            self.at += 1
        left = [w for w in self.near if w["end"] <= start]
        if left:  # later regions start no earlier
            self.gone += left
            self.near = [w for w in self.near if w["end"] > start]
        return sorted((w for w in self.near if w["start"] < end), key=lambda w: w["order"])

    def replace(self, old: list[dict], new: list[dict]) -> None:
        out = {id(w) for w in old}
        self.near = [w for w in self.near if id(w) not in out] + new

    def all(self) -> list[dict]:
        return self.gone + self.near + self.waiting[self.at :]


def _side(words: list[dict], start: float, end: float) -> tuple[float, str, float | None]:
    """Uncovered edges, text and mean score of a region's words."""
    if not words:
        return (end - start) * 2, "", None
    lo, hi = min(w["start"] for w in words), max(w["end"] for w in words)
    scores = [w["score"] for w in words if w["score"] is not None and w["score"] == w["score"]]
    edges = max(0.0, max(start, lo) - start) + max(0.0, end - min(end, hi))
    return edges, _letters("".join(w["text"] for w in words)), sum(scores) / len(scores) if scores else None


def _takes(before: tuple, after: tuple, had_words: bool) -> bool:
    """The candidate is better covered or longer (letters and digits have no marks, so each is one grapheme), and its score has not dropped much."""
    edge, gain = before[0] - after[0], len(after[1]) - len(before[1])
    same = before[1] != "" and before[1] == after[1]
    better = not had_words or (same and edge >= EDGE_GAIN) or gain >= TEXT_GAIN or (gain >= SMALL_TEXT_GAIN and edge >= SMALL_EDGE_GAIN) or (gain >= 1 and edge >= EDGE_GAIN)
    return better and (before[2] is None or after[2] is None or after[2] >= before[2] - SCORE_DROP)


def fold_run(regions: list[dict], words: list[dict], candidates: list[dict], reason: str) -> list[dict]:
    """The words of a run of regions, decided one by one in order of start: each region sees what the ones before have left."""
    def ordered(rows, origin: str) -> list[dict]:
        seen = {w["word_idx"]: dict(w, origin=origin, order=(w["start"], w["word_idx"], origin)) for w in rows}
        return sorted(seen.values(), key=lambda w: w["order"])

    now, other = _Pass(ordered(words, "kept")), _Pass(ordered(candidates, "retry"))
    for r in sorted(regions, key=lambda r: (r["start"], r["region_idx"])):
        a, b = now.inside(r["start"], r["end"]), other.inside(r["start"], r["end"])
        before, after = _side(a, r["start"], r["end"]), _side(b, r["start"], r["end"])
        wins = bool(b) and _takes(before, after, bool(a))
        if not wins and (not before[1] or not after[1] or before[1] == after[1]):
            continue
        pairs = common_pairs([w["key"] for w in a], [w["key"] for w in b])
        if wins:
            known = {j: a[i] for i, j in pairs}
            waits = {"needs_review": True, "review_status": "pending", "review_reason": "coverage-retry"}
            now.replace(a, [dict(w, **{k: known[j][k] for k in waits} if j in known else waits) for j, w in enumerate(b)])
        else:
            matched = {i for i, _ in pairs}
            for i, w in enumerate(a):
                if i not in matched and w["review_status"] != "edited":
                    w.update(needs_review=True, review_status="pending", review_reason=reason)
    return now.all()


def region_runs(sides: DataFrame) -> DataFrame:
    """sides (project_id, region_idx, start, end, reach) with run: regions that can see each other's decisions, by themselves or by words in both."""
    w = Window.partitionBy("project_id").orderBy("start", "region_idx")
    new = F.col("start") >= F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return sides.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_passes(words: DataFrame, candidates: DataFrame, regions: DataFrame, reason: str = "pass-disagreement") -> DataFrame:
    """One decision for each retried region, in order of start: take the candidate, mark the disagreement, or leave the words.

    Where regions overlap, or share a word, a later one sees what the earlier one has left. Such regions make a run: each pass is joined with
    its regions once, and a run with its words is folded in one task, so the number of shuffles doesn't depend on how long a chain of
    overlaps is. word_idx is that of the pass a word comes from (origin: kept or retry).
    """
    spans = regions.select("project_id", "region_idx", "start", "end")
    none = lambda kind: F.lit(None).cast(kind)

    def side(rows: DataFrame, tag: str, review: bool) -> DataFrame:
        state = ["needs_review", "review_status", _reason(rows).alias("review_reason")] if review else [none("boolean").alias("needs_review"), none("string").alias("review_status"), none("string").alias("review_reason")]
        slim = rows.select("project_id", "word_idx", "text", "start", "end", word_key(F.col("text")).alias("key"), _score(rows).cast("double").alias("score"), *state)
        word = F.struct("word_idx", "text", "start", "end", "key", "score", "needs_review", "review_status", "review_reason")
        found = interval_join(slim, as_right(spans), ["project_id"]).groupBy("project_id", "region_idx")
        return found.agg(F.max("end").alias(f"hi_{tag}"), F.collect_list(word).alias(f"words_{tag}"))

    a, b = side(words, "a", True), side(candidates, "b", False)
    sides = spans.join(a, ["project_id", "region_idx"], "left").join(b, ["project_id", "region_idx"], "left")
    sides = region_runs(sides.withColumn("reach", F.greatest("end", "hi_a", "hi_b")))
    runs = sides.groupBy("project_id", "run").agg(
        F.collect_list(F.struct("region_idx", "start", "end")).alias("regions"), F.flatten(F.collect_list("words_a")).alias("words"), F.flatten(F.collect_list("words_b")).alias("candidates")
    )

    @F.pandas_udf(_DECIDED)
    def decided(spans: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([fold_run(list(r), list(o), list(n), reason) for r, o, n in zip(spans, olds, news, strict=True)])

    folded = runs.select("project_id", F.explode(decided("regions", "words", "candidates")).alias("w")).select("project_id", "w.*")
    # by places only: the words' keys and lists above aren't made twice
    met = interval_join(words.select("project_id", "word_idx", "start", "end"), as_right(spans.drop("region_idx")), ["project_id"]).select("project_id", "word_idx").distinct()
    rest = words.join(met, ["project_id", "word_idx"], "left_anti").select(*_WORD, "needs_review", "review_status", _reason(words).alias("review_reason"), F.lit("kept").alias("origin"))
    return rest.unionByName(folded)


# --- scans over a project's words -------------------------------------------------------------------------------------


def _collected(words: DataFrame, order: list[str], fields: list[str], name: str = "rows", by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    return words.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))


@vectorised("array<struct<word_idx:long,start:double,end:double>>")
def _clamped(rows: pd.Series) -> pd.Series:
    out = []
    for group in rows:
        kept, before = [], 0.0
        for w in group:
            start, end = max(w["start"], w["region_start"], before), min(w["end"], w["region_end"])
            if end - start < 0.04:
                end = min(w["region_end"], start + 0.04)
            if end - start >= 0.04:
                kept.append({"word_idx": w["word_idx"], "start": start, "end": end})
                before = end
        out.append(kept)
    return pd.Series(out)


def align_words_to_regions(words: DataFrame, best: DataFrame, regions: DataFrame) -> DataFrame:
    """Words inside their best region, after the kept word before; changed or short words wait for review with a lower score.

    best: best_region_per_word(words, regions). Projects without regions keep their words as they are. A kept word ends in its region, so
    a word that starts (in its own region) after the ends of all regions before doesn't depend on any word before: there the
    project is cut, and only pieces of speech whose regions overlap are scanned as one.
    """
    w = by_project().orderBy("word_idx")
    apart = F.greatest("start", "region_start", F.lit(0.0)) >= F.max("region_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = best.withColumn("_cut", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = _collected(pieces, ["word_idx"], ["start", "end", "region_start", "region_end"], by=("project_id", "piece"))
    times = lists.select("project_id", F.explode(_clamped("rows")).alias("t")).select("project_id", "t.word_idx", F.col("t.start").alias("new_start"), F.col("t.end").alias("new_end"))
    joined = words.join(times, ["project_id", "word_idx"]).join(best.select("project_id", "word_idx", "region_idx"), ["project_id", "word_idx"])
    moved = (F.abs(F.col("new_start") - F.col("start")) > 0.02) | (F.abs(F.col("new_end") - F.col("end")) > 0.02)
    short = F.col("new_end") - F.col("new_start") < 0.09
    needs = F.col("needs_review") | moved | short
    manual = F.lit(False)
    if "timing_source" in words.columns:
        manual = F.coalesce(F.col("timing_source") == "manual", F.lit(False))
    manual = manual | (F.col("review_status") == "edited")
    out = joined.withColumns(
        {
            "review_status": F.when(needs & ~manual, "pending").otherwise(F.col("review_status")), "needs_review": needs,
            "score": F.when(F.col("score").isNotNull(), F.greatest(F.lit(0.0), F.col("score") - F.when(moved, 0.12).otherwise(0.0) - F.when(short, 0.08).otherwise(0.0))),
            "start": F.col("new_start"), "end": F.col("new_end"),
        }
    ).drop("new_start", "new_end")
    rest = words.join(regions.select("project_id").distinct(), "project_id", "left_anti").withColumn("region_idx", F.lit(None).cast("long"))
    return out.unionByName(rest.select(*out.columns))


MOST_WORDS = 10


class _Terms:
    """A project's terms by spelling. The spellings are in order, so those that begin with a text lie behind each other."""

    def __init__(self, spelt: list[str] = (), terms: list[str] = ()):
        self.known = dict(zip(spelt[::-1], terms[::-1], strict=True))  # of equal spellings the first term
        self.spelt = sorted(self.known)

    def runs(self, keys: list[str], first: int, stop: int, closed: bool) -> tuple[list[tuple[int, int, str]], int]:
        """(place, count, term) of the runs of words first to stop that spell a term, longest first, from the left; the word behind the last decided one.

        Unless closed, words may follow: a run that they could lengthen is left open.
        """
        found, i, spelt = [], first, self.spelt
        while spelt and i < stop:
            text, hit, n = "", None, 0
            while n < MOST_WORDS and i + n < stop:
                text += keys[i + n]
                at = bisect_left(spelt, text)
                if at == len(spelt) or not spelt[at].startswith(text):
                    break
                n += 1
                if spelt[at] == text:
                    hit = (i, n, self.known[text])
            else:
                if n < MOST_WORDS and not closed:
                    return found, i
            if hit:
                found.append(hit)
            i += hit[1] if hit else 1
        return found, stop


def _mean_of(values: pa.Array, members: np.ndarray, inside: np.ndarray) -> pa.Array:
    """Mean of each row of members (places in values; only those inside count) without missing values; null where all are missing."""
    at = values.to_numpy(zero_copy_only=False)[members]
    there = inside & ~np.isnan(at)
    n = there.sum(axis=1)
    return pa.array(np.cumsum(np.where(there, at, 0.0), axis=1)[:, -1] / np.maximum(n, 1), mask=n == 0)


def _with_runs(rows: pa.RecordBatch, runs: list[tuple[int, int, str]], keep: np.ndarray, fields: list[str]) -> pa.RecordBatch:
    """The rows to keep with each run as one word (see apply_glossary), and n_merged."""
    columns, merged = {f: rows.column(f) for f in ("project_id", *fields)}, np.ones(rows.num_rows, np.int32)
    if runs:
        first, count = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
        inside = np.arange(MOST_WORDS) < count[:, None]
        members = np.where(inside, first[:, None] + np.arange(MOST_WORDS), first[:, None])
        merged[first] = count
        keep = keep.copy()
        keep[members[inside & (np.arange(MOST_WORDS) > 0)]] = False
        new = {name: _mean_of(columns[name], members, inside) for name in ("score", "review_score", "confidence") if name in columns}
        if "raw_confidence" in columns:
            raw = columns["raw_confidence"]
            new["raw_confidence"] = _mean_of(pc.coalesce(raw, columns["confidence"]) if "confidence" in columns else raw, members, inside)
        if "needs_review" in columns:
            flags = pc.fill_null(columns["needs_review"], False).to_numpy(zero_copy_only=False)
            new["needs_review"] = pa.array((flags[members] & inside).any(axis=1))
        new |= {"text": pa.array([r[2] for r in runs], columns["text"].type), "end": columns["end"].take(pa.array(first + count - 1))}
        hit = np.zeros(rows.num_rows, bool)
        hit[first] = True
        columns |= {name: pc.replace_with_mask(columns[name], pa.array(hit), values) for name, values in new.items()}
    return pa.RecordBatch.from_pydict(columns | {"n_merged": pa.array(merged)}).filter(pa.array(keep))


def _merge_job(fields: list[str]):
    """Rows in order of project and word, a project's terms (the row with _terms) before its words: only one project's terms and its undecided words are held."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_words, project, terms = None, None, _Terms()
        for batch in chain(batches, [None]):
            parts = [p for p in (open_words, batch) if p is not None and p.num_rows]
            if not parts:
                continue
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
            ids, lists, keys = rows.column("project_id"), rows.column("_terms"), rows.column("_key").to_pylist()
            cuts = np.flatnonzero(np.diff(ids.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False))) + 1
            runs, decided = [], 0
            for a, b in pairwise([0, *cuts.tolist(), rows.num_rows]):
                if (now := ids[a].as_py()) != project:
                    project, terms = now, _Terms()
                if lists[a].is_valid:
                    own = lists[a].values
                    terms, a = _Terms(own.field("spelt").to_pylist(), own.field("term").to_pylist()), a + 1
                found, decided = terms.runs(keys, a, b, batch is None or b < rows.num_rows)
                runs += found
            open_words = rows.slice(decided)
            done = rows.slice(0, decided)
            yield _with_runs(done, runs, done.column("_terms").is_null().to_numpy(zero_copy_only=False), fields)

    return job


def apply_glossary(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Runs of up to ten words that spell a term (longest first, from the left) become one word; adds n_merged.

    terms: (project_id, term_idx, term), at most 200 a project. A merged word has all fields of its first word, but the last one's end, the
    means of each score, and waits for review where one of them does. Other words stay as they are. Words and lists of terms are
    dealt out by project and sorted once, and read in one pass: no joins, no list of a project's words, no row for each run that could be a term.
    """
    fields = [c for c in words.columns if c != "project_id"]
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    term = F.struct("term_idx", squeeze(F.col("term")).alias("spelt"), "term")
    lists = terms.where("project_id IS NOT NULL AND term IS NOT NULL").groupBy("project_id").agg(F.sort_array(F.collect_list(term)).alias("_terms"))
    scores = {c: F.col(c).cast("double") for c in ("score", "review_score", "confidence", "raw_confidence") if c in fields}
    given = words.withColumns(scores).select("project_id", *fields)
    both = given.unionByName(lists, allowMissingColumns=True)
    order = both.repartition("project_id").sortWithinPartitions("project_id", F.col("_terms").isNull(), "word_idx")
    schema = StructType([*(StructField(f.name, f.dataType) for f in both.drop("_terms").schema), StructField("n_merged", IntegerType())])
    return order.withColumn("_key", squeeze(F.coalesce("text", F.lit("")))).mapInArrow(_merge_job(fields), schema)


def balanced_cuts(size, start, end, space, unsafe, target: int, soft_pause: float, max_duration: float, max_chars: int) -> list[int]:
    """Sizes of the groups of a phrase with the least cost (see reflow_words).

    One table of costs, words by group sizes, is made at once; then the phrase is solved from its right end, each word taking the
    least of its row plus the solution of what follows. Of equal costs (to 1e-6) the size nearest to the target counts, then the smaller one.
    """
    n = len(size)
    if not n:
        return []
    slack = 0 if target == 1 else max(1, int(target * 0.34 + 0.5))
    sizes = np.arange(1, min(n, target + slack + 2) + 1)
    first = np.arange(n)[:, None]
    after = first + sizes  # the word that a group is followed by
    inside, final = after <= n, after == n
    last = np.minimum(after, n) - 1
    start, end = np.asarray(start, float), np.asarray(end, float)
    chars = np.append(0, np.cumsum(size))
    gaps = np.append(0, np.cumsum(np.asarray(space, bool)))
    length = chars[last + 1] - chars[first] + gaps[last + 1] - gaps[first + 1]
    over = ((end[last] - start[first] > max_duration) | (length > max_chars)) & (sizes > 1)
    free = inside & ~np.logical_or.accumulate(over, axis=1)
    ahead = np.minimum(after, n - 1)
    free &= final | ~np.asarray(unsafe, bool)[ahead]
    pause = np.where(final, 0.0, np.maximum(0.0, start[ahead] - end[last]))
    cost = np.square((sizes - target) / target) * 4 + np.maximum(0, sizes - target - slack) * 4 - np.minimum(1.2, pause / max(0.01, soft_pause) * 0.3)
    if target > 1:
        cost = cost + np.where((sizes == 1) & (n > 1), 2.5, 0.0) + np.where(n - after == 1, 1.5, 0.0)
    cost = np.where(free, cost, np.inf)
    best, take = np.full(n + len(sizes) + 1, np.inf), np.zeros(n, int)
    best[n] = 0.0
    by_taste = np.lexsort((sizes, np.abs(sizes - target)))
    for i in range(n - 1, -1, -1):
        total = cost[i] + best[i + sizes]
        least = total.min()
        if least < np.inf:
            pick = by_taste[np.argmax(total[by_taste] <= least + 1e-6)]
            best[i], take[i] = total[pick], sizes[pick]
    if best[0] == np.inf:
        return [n]
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(cuts[-1] + int(take[cuts[-1]]))
    return np.diff(cuts).tolist()


def reflow_words(words: DataFrame, target: int = 5, language: str = "th", soft_pause: float = 0.08, max_duration: float = 4.0, max_lines: int = 2, line_chars: int = 32) -> DataFrame:
    """Phrases (split_phrases) cut into captions of about ``target`` words at least cost; adds caption_idx (phrase order, then place).

    Cost of a group: 4 ((size - target) / target)^2, 4 a word beyond target and slack, 2.5 for a lone word, minus up to 1.2 for
    the pause after it, plus 1.5 where it leaves a lone last word. Groups over the time or character limit, and Thai cuts
    before a clinging mark or sign, aren't taken.
    """
    thai = language.lower() in ("th", "thai", "auto")
    clings = (attaches_to_previous(F.col("text")) | thai_risk(F.col("text"))) if thai else F.lit(False)
    rows = words.withColumn("_size", grapheme_count(F.col("text"))).withColumn("_clings", clings)
    fields = ["_size", "end", "space_before", "_clings"]
    lists = _collected(rows, ["start", "word_idx"], fields, by=("project_id", "phrase_idx"))
    goal = max(1, int(target + 0.5))

    @F.pandas_udf("array<int>")
    def cut(size: pd.Series, start: pd.Series, end: pd.Series, space: pd.Series, clings: pd.Series) -> pd.Series:
        out = []
        for g, s, e, sp, c in zip(size, start, end, space, clings, strict=True):
            tiny = [thai and i > 0 and s[i] - e[i - 1] <= 0.02 and e[i] - s[i] <= 0.08 and g[i] == 1 for i in range(len(g))]
            sizes = balanced_cuts(g, s, e, sp, [bool(x) or t for x, t in zip(c, tiny, strict=True)], goal, soft_pause, max_duration, max_lines * line_chars)
            out.append(np.repeat(np.arange(len(sizes)), sizes).tolist())
        return pd.Series(out)

    part = lambda f: F.transform("rows", lambda r: r[f])
    cuts = lists.withColumn("g", cut(part("_size"), part("start"), part("end"), part("space_before"), part("_clings")))
    placed = cuts.select("project_id", "phrase_idx", F.explode(F.arrays_zip(F.transform("rows", lambda r: r["word_idx"]).alias("word_idx"), F.col("g"))).alias("z"))
    placed = placed.select("project_id", "phrase_idx", F.col("z.word_idx").alias("word_idx"), F.col("z.g").alias("part"))
    return words.join(placed.drop("phrase_idx"), ["project_id", "word_idx"]).withColumn("caption_idx", F.struct("phrase_idx", "part"))


# --- edited captions ---------------------------------------------------------------------------------------------------

_TIMED = "array<struct<text:string,space_before:boolean,start:double,end:double,old_idx:int,review_status:string>>"


LEAST = 0.04


def _edited_times(a: float, b: float, old: list, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """For each new text the old word that it is (-1: none), its start and its end.

    Matched words are the walls between gaps. A gap with as many new as old words takes the old times one by one; in others the new
    words share what lies between the walls by their numbers of characters, LEAST each at least. At last words are
    moved so that none starts before the one before it ends, nor ends after the caption.
    """
    n = len(texts)
    pairs = np.array(common_pairs([w["text"] for w in old], texts), int).reshape(-1, 2)
    old_start, old_end = (np.array([w[k] for w in old], float) for k in ("start", "end"))
    # walls: the matched words, and one before the first and after the last word
    wall_old, wall_new = np.concatenate([[-1], pairs[:, 0], [len(old)]]), np.concatenate([[-1], pairs[:, 1], [n]])
    left_end = np.concatenate([[a], old_end[pairs[:, 0]]])
    right_start = np.concatenate([old_start[pairs[:, 0]], [b]])
    gap = np.searchsorted(wall_new, np.arange(n), side="right") - 1
    kept = np.full(n, -1)
    kept[pairs[:, 1]] = pairs[:, 0]
    new_words, old_words = np.diff(wall_new) - 1, np.diff(wall_old) - 1
    even = (new_words == old_words)[gap] & (kept < 0)
    source = np.where(kept >= 0, kept, np.where(even, wall_old[gap] + np.arange(n) - wall_new[gap], -1))
    start, end = np.zeros(n), np.zeros(n)
    known = source >= 0
    start[known], end[known] = old_start[source[known]], old_end[source[known]]
    for g in np.unique(gap[~known]):
        at = np.flatnonzero((gap == g) & ~known)
        weight = np.maximum(1, [len(texts[j]) for j in at]).astype(float)
        room = max(LEAST * len(at), right_start[g] - left_end[g])
        stop = left_end[g] + np.cumsum(np.maximum(LEAST, room * weight / weight.sum()))
        before = np.append(left_end[g], stop[:-1])
        stop[-1] = max(before[-1] + LEAST, left_end[g] + room)
        start[at], end[at] = before, stop
    step = LEAST * np.arange(1, n + 1)
    reach = np.minimum(b, np.maximum.accumulate(np.maximum(np.maximum(start, a) + LEAST, end) - step) + step)
    return kept.tolist(), np.maximum(np.maximum(start, a), np.append(a, reach[:-1])), reach


@vectorised(_TIMED)
def reconcile_edited_caption(start: pd.Series, end: pd.Series, old: pd.Series, pieces: pd.Series) -> pd.Series:
    """Timed words of an edited caption: words of the old text keep their times, as many new as old ones take theirs, others share the gap.

    old: array of (text, start, end); pieces: array of (text, space_before). Without old words all share the caption by characters.
    """
    out = []
    for a, b, before, after in zip(start, end, old, pieces, strict=True):
        before, after = list(before if before is not None else []), list(after if after is not None else [])
        texts = [p["text"] for p in after]
        if not after:
            kept, begins, ends = [], [], []
        elif before:
            kept, begins, ends = _edited_times(a, b, before, texts)
        else:
            weight = np.maximum(1, [len(t) for t in texts]).astype(float)
            edges = a + max(LEAST, b - a) * np.append(0, np.cumsum(weight)) / weight.sum()
            kept, begins, ends = [-1] * len(texts), edges[:-1], np.append(edges[1:-1], b)
        out.append(
            [
                {"text": p["text"], "space_before": p["space_before"], "start": float(s), "end": float(e), "old_idx": k if k >= 0 else None, "review_status": "kept" if k >= 0 else "edited"}
                for p, k, s, e in zip(after, kept, begins, ends, strict=True)
            ]
        )
    return pd.Series(out)
