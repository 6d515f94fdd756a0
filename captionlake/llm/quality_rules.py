"""Quality rules: fixed base limits, then robust multivariate outliers per language and source.

The second verdict is a minimum-covariance-determinant (MCD) estimate of the transformed statistics of each (language, source)
group. Random subsets of a bounded sample give STARTS starting estimates. From each of them concentration steps run
over all rows of the group: distances, the cut that holds the nearest CORE of the rows (from a histogram), new mean and covariance of
those rows by grouped sums. The estimate of least determinant stays, is reweighted by the rows within a chi-square quantile of it, and
documents beyond a far chi-square quantile of the result are rejected. Only small linear algebra on a row per group runs in Python.

One rule holds for groups of any size: the estimate of n rows is mixed with that of its language, n less 5 to PRIOR_ROWS, that of a language with
that of all rows, and that of all rows with a wide one. So a source of a few documents is judged mostly by its language,
and one of thousands by itself.

All variances are raised by that of counting itself (FLOOR, as in regularised MCD), as most statistics of clean texts hardly vary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.llm.bytewords import chunks, mix, row_of, shingle_hashes
from captionlake.llm.tables import discard, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Part of a group that the concentration steps keep: the usual choice that stands a quarter of outliers.
CORE = 0.75
STEPS = 4
STARTS = 4
#: Rows of a group from which the starting estimates are drawn, and random subsets tried on them.
SAMPLE, SUBSETS = 500, 50
#: Part of a normal group that takes part in the reweighting (the usual one), and part that the final cut rejects: one in a million.
REWEIGHTED, REJECTED = 0.975, 1e-6
#: How many rows, beyond one for each statistic, an estimate must have to weigh as much as the wider one that it is drawn towards: five for each statistic.
PRIOR_ROWS = 25
#: Standard deviation of each transformed statistic where nothing is known: what the estimate of all rows is drawn towards.
WIDE = 1.0
#: Standard deviation of each transformed statistic by counting alone, in the shortest text that passes the base rule: a root of counts over n
#: has the variance 1 / 4n (three words at a time for repeats), a logarithm of n counts 1 / n; words have about 5 characters, and their length varies by half.
FLOOR = {
    "x_len": MIN_WORDS**-0.5,
    "x_word": 0.5 * MIN_WORDS**-0.5,
    "x_sym": 0.5 * (5 * MIN_WORDS) ** -0.5,
    "x_dup": 0.5 * MIN_WORDS**-0.5,
    "x_rep": 0.5 * (MIN_WORDS / 3) ** -0.5,
}
DIMS = list(FLOOR)
BIN = 1 / 64
SALTS = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list[np.ndarray]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        for c in chunks(batch.column("text")):
            start, end, first = c.words()
            words = c.hashes(start, end)
            rows = row_of(first)
            columns["n_words"].append(np.diff(first))
            columns["word_chars"].append(c.per_row(~c.space & ((c.data & 0xC0) != 0x80)))
            columns["n_symbols"].append(c.per_row(_SYMBOL[c.data]))

            ls, le, lfirst = c.lines()
            solid = np.zeros(len(c.data) + 1, np.int64)
            np.cumsum(~c.space, out=solid[1:])
            has_word = solid[le] > solid[ls]
            lrow = row_of(lfirst)[has_word]
            key = mix(c.hashes(ls[has_word], le[has_word]) + lrow.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            _, at = np.unique(key, return_index=True)
            columns["n_dup_lines"].append(np.bincount(lrow, minlength=c.rows) - np.bincount(lrow[at], minlength=c.rows))

            covered = np.zeros(len(words), bool)
            if len(words) >= 3:
                inside = rows[:-2] == rows[2:]
                at = np.flatnonzero(inside)
                key = mix(shingle_hashes(words, 3)[at] + rows[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                twice = np.zeros(len(key), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                at = at[twice]
                for i in range(3):
                    covered[at + i] = True
            columns["n_repeat_words"].append(np.bincount(rows[covered], minlength=c.rows))
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "lang", "source")] + [pa.array(np.concatenate(v).astype(np.int64)) for v in columns.values()],
                names=["doc_id", "lang", "source", *columns],
            )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of counts for each whole text (null: no words): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        _statistics, f"doc_id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )


def _transformed(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns(
        {
            "x_len": F.log1p(words),
            "x_word": F.log(chars / words),
            "x_sym": F.sqrt(F.col("n_symbols") / chars),
            "x_dup": F.sqrt(F.col("n_dup_lines") / words),
            "x_rep": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def chi_square(x: float, d: int) -> float:
    """Part of a chi-square distribution with d degrees of freedom below x, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = d / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_quantile(part: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, d) < part else (low, middle)
    return high


def consistency(part: float, d: int) -> float:
    """What the covariance of a normal distribution's nearest ``part`` is multiplied by to get that of the whole."""
    return part / chi_square(chi_square_quantile(part, d), d + 2)


def _estimate(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and logarithm of the determinant of a covariance with the floor."""
    cov = cov + np.diag(np.square([FLOOR[x] for x in DIMS]))
    return np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """STARTS estimates of a sampled group: the best of SUBSETS random subsets of least size after two concentration steps, and the medians."""
    x = pdf.sort_values(DIMS)[DIMS].to_numpy()
    rng, (n, d) = np.random.default_rng(17), x.shape
    keep, scale = max(1, int(CORE * n)), consistency(CORE, len(DIMS))
    tried = [(np.inf, np.median(x, axis=0), np.diag(1 / np.square([FLOOR[k] for k in DIMS])))]
    for _ in range(SUBSETS):
        part = x[rng.permutation(n)[: d + 1]]
        for _ in range(3):
            mean = part.mean(axis=0)
            inverse, size = _estimate(mean, scale * np.cov(part.T, bias=True).reshape(d, d))
            away = x - mean
            part = x[np.argsort(np.einsum("ni,ij,nj->n", away, inverse, away), kind="stable")[:keep]]
        tried.append((size, mean, inverse))
    best = sorted(tried, key=lambda t: t[0])[: STARTS - 1] + tried[:1]
    return pd.DataFrame({"grp": pdf["grp"].iloc[0], "start": range(len(best)), "mean": [b[1] for b in best], "inverse": [b[2].reshape(-1) for b in best]})


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """Count, sums and sums of products of the statistics in each group: merged map-side, whatever the group's size."""
    sums = [F.count("*").cast("double").alias("n")] + [F.sum(d).alias(f"s_{d}") for d in DIMS]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[i:]]
    return rows.groupBy(*by).agg(*sums)


def _solve(part: float):
    """Mean, inverse covariance (made consistent for the nearest ``part`` of a group, with the floor) and determinant from sums."""
    d, scale = len(DIMS), consistency(part, len(DIMS))

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean = pdf[[f"s_{x}" for x in DIMS]].to_numpy() / pdf[["n"]].to_numpy()
            cov = np.zeros((len(pdf), d, d))
            for i, a in enumerate(DIMS):
                for j in range(i, d):
                    cov[:, i, j] = cov[:, j, i] = scale * (pdf[f"p_{a}_{DIMS[j]}"] / pdf["n"] - mean[:, i] * mean[:, j])
            found = [_estimate(m, c) for m, c in zip(mean, cov, strict=True)]
            out = {"mean": list(mean.round(9)), "inverse": [f[0].reshape(-1).round(9) for f in found], "size": [round(f[1], 9) for f in found]}
            yield pd.DataFrame({"grp": pdf["grp"], "start": pdf["start"]} | out)

    return job


def _join_group(rows: DataFrame, by_group: DataFrame, *more: str) -> DataFrame:
    """Join the few rows for each group to all its rows; the rows of a group are spread over SALTS keys, so a large one isn't one task."""
    spread = by_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["grp", "salt", *more])


def _distances(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2 of every row to each of its group's estimates."""
    d = len(DIMS)
    joined = _join_group(rows, fit.select("grp", "start", "mean", "inverse"))
    away = [F.col(x) - F.col("mean")[i] for i, x in enumerate(DIMS)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + away[i] * away[j] * F.col("inverse")[i * d + j]
    return joined.withColumn("d2", F.greatest(total, F.lit(0.0))).drop("mean", "inverse")


def _cuts(rows: DataFrame, part: float) -> DataFrame:
    """For each estimate the least histogram bin of log distance below which at least ``part`` of the group's rows lie."""
    counts = rows.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp", "start")
    up = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return up.where(F.col("upto") >= F.col("all") * part).groupBy("grp", "start").agg(F.min("bin").alias("cut"))


def _binned(rows: DataFrame) -> DataFrame:
    # bins are clipped far outside any real distance, so a group's histogram has a fixed number of them
    return rows.withColumn("bin", F.least(F.greatest(F.floor(F.log(F.col("d2") + 1e-6) / BIN), F.lit(-1600)), F.lit(3200)).cast("int"))


def robust_fit(rows: DataFrame) -> DataFrame:
    """(grp, start, mean, inverse): the reweighted MCD estimate of each group of rows (grp, salt, the statistics)."""
    shape = "grp string, start int, mean array<double>, inverse array<double>"
    order = Window.partitionBy("grp").orderBy("salt", F.xxhash64(*DIMS))
    sample = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE)
    fit = materialize(sample.select("grp", *DIMS).groupBy("grp").applyInPandas(_starts, shape))
    for _ in range(STEPS):
        near = _binned(_distances(rows, fit))
        core = _join_group(near, _cuts(near, CORE), "start").where("bin <= cut")
        after = materialize(_moments(core, "grp", "start").mapInPandas(_solve(CORE), shape + ", size double"))
        discard(fit)
        fit = after
    best = fit.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "inverse"), F.struct("size", "start")).alias("b")).select("grp", "b.*")
    near = _distances(rows, best).where(F.col("d2") <= chi_square_quantile(REWEIGHTED, len(DIMS)))
    out = materialize(_moments(near, "grp", "start").mapInPandas(_solve(REWEIGHTED), shape + ", size double"))
    discard(fit)
    return out


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates (grp, n, mean, inverse) mixed with wider ones (wide_mean, wide_inverse; null: around the own mean, WIDE in each statistic).

    Mean and covariance are those of a mixture of both: the covariances' mean, and what the two means differ by.
    """
    d = len(DIMS)
    for pdf in batches:
        means, inverses = [], []
        for r in pdf.itertuples():
            free = max(0.0, r.n - d)  # so few rows as statistics say nothing by themselves
            mean, cov, part = np.array(r.mean), np.linalg.inv(np.array(r.inverse).reshape(d, d)), free / (free + PRIOR_ROWS)
            wide = (mean, np.eye(d) * WIDE**2) if r.wide_mean is None else (np.array(r.wide_mean), np.linalg.inv(np.array(r.wide_inverse).reshape(d, d)))
            apart = mean - wide[0]
            means.append((part * mean + (1 - part) * wide[0]).round(9))
            inverses.append(np.linalg.inv(part * cov + (1 - part) * wide[1] + part * (1 - part) * np.outer(apart, apart)).reshape(-1).round(9))
        yield pd.DataFrame({"grp": pdf["grp"], "mean": means, "inverse": inverses})


def _mixed(fit: DataFrame, sizes: DataFrame, wider: DataFrame | None) -> DataFrame:
    """fit (grp, mean, inverse) of the groups in sizes (grp, n, parent), drawn towards the estimates of their parents."""
    rows = fit.select("grp", "mean", "inverse").join(sizes, "grp")
    if wider is None:
        none = F.lit(None).cast("array<double>")
        rows = rows.withColumns({"wide_mean": none, "wide_inverse": none})
    else:
        rows = rows.join(wider.select(F.col("grp").alias("parent"), F.col("mean").alias("wide_mean"), F.col("inverse").alias("wide_inverse")), "parent")
    shape = "grp string, mean array<double>, inverse array<double>"
    return materialize(rows.select("grp", F.col("n").cast("double").alias("n"), "mean", "inverse", "wide_mean", "wide_inverse").mapInPandas(_drawn, shape))


def robust_outliers(stats: DataFrame) -> DataFrame:
    """Add distance (squared) and kept_by_fit: false where the row lies far outside the robust centre of its language and source.

    Estimates are made for each language and source, each language, and all rows, and mixed from the widest to the narrowest.
    """
    own, of_lang, every = F.concat_ws("\x01", F.lit("s"), "lang", "source"), F.concat_ws("\x01", F.lit("l"), "lang"), F.lit("a")
    rows = _transformed(stats).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    rows = materialize(rows.withColumn("own", own))
    sizes = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("n")))  # a row for each language and source
    in_groups = materialize(rows.select(F.explode(F.array("own", of_lang, every)).alias("grp"), "salt", *DIMS))
    fit = robust_fit(in_groups)
    everything = _mixed(fit, sizes.agg(F.sum("n").alias("n")).select(every.alias("grp"), "n", F.lit("").alias("parent")), None)
    langs = _mixed(fit, sizes.groupBy("lang").agg(F.sum("n").alias("n")).select(of_lang.alias("grp"), "n", every.alias("parent")), everything)
    owns = _mixed(fit, sizes.select(own.alias("grp"), "n", of_lang.alias("parent")), langs)
    discard(in_groups, fit, everything, langs, sizes)
    judged = _distances(rows.withColumn("grp", F.col("own")), owns.withColumn("start", F.lit(0))).withColumn("distance", F.col("d2"))
    return judged.withColumn("kept_by_fit", F.col("distance") <= chi_square_quantile(1 - REJECTED, len(DIMS)))


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts, base verdict and final verdict for every document.

    Cases: null and empty texts have no words, so the base rule rejects them; null lang or source count as an own
    (empty) name; equal rows get equal verdicts; repeated ids give one row each; a very long text is counted whole in one
    task; an empty table gives no rows; other columns are ignored, whatever their names. Only rows that pass the base rule enter
    the fit, so junk doesn't shape the estimates. distance is squared, and null where the base rule has judged the row.
    """
    stats = materialize(
        text_statistics(docs, **columns).withColumn(
            "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        )
    )
    judged = robust_outliers(stats.where(~F.col("base_failed")))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = judged.select(*names, F.col("kept_by_fit").alias("kept"), F.round("distance", 6).alias("distance"))
    failed = stats.where("base_failed").select(*names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts for all documents."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
