"""SimHash fingerprints with DataFrame functions only.

Each term (SHINGLE words in a row) votes with its weight, the number of its occurrences, on BITS signed bits: one bit
of its two 64-bit hashes each. The votes are counted as packed sums: a long holds four 16-bit counters, so a part of
a text of at most PART terms needs BITS / 4 sums, and parts are added up afterwards.

Near fingerprints are searched by permuted block tables: the bits are cut into RADIUS + AGREE blocks, of which two fingerprints within
RADIUS bits have AGREE in common at least, and a table for each choice of AGREE blocks is keyed by their bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.llm.tables import materialize

BITS = 128
#: Fingerprints are near when they differ in at most so many bits.
RADIUS = 7
#: Equal blocks that key a table. 1 of 8 blocks: 8 tables with keys of 16 bits. What is found is the same with 2 of 9 blocks: 36 tables with keys of
#: 28 bits, 36 rows a fingerprint instead of 8, but few others under a key beyond some 10^8 fingerprints.
AGREE = 1
#: Queries of the search: documents whose id is divisible by this.
EVERY = 100
SHINGLE = 2
#: Terms of one part: a 16-bit counter holds as many.
PART = 32_768
#: Documents of one range of ids, between which the next document is looked up; ranges are even between so many sampled quantiles.
RANGE = 2048
QUANTILES = 1024
#: Up to so many ranges (a row of 16 bytes each) their first ids are broadcast; beyond, they are joined by a shuffle.
BROADCAST_RANGES = 1 << 20
_LANES = 0x0001000100010001


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fp1, fp2 (64 bits each) for the texts of each distinct value of keys.

    Cases: a text of one word has that word as its only term; a text without words (or null) has no terms and the
    fingerprint 0; the keys must be unique, else texts with equal keys share a fingerprint of all their terms.
    """
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lists = texts.select(*keys, words.alias("_w"))
    terms = lists.select(*keys, F.posexplode_outer(_pairs(F.col("_w"))).alias("_p", "_t"))
    part = F.floor(F.coalesce("_p", F.lit(0)) / PART).alias("_part")
    rows = terms.select(*keys, part, F.xxhash64("_t").alias("_a"), F.xxhash64(F.lit(29), "_t").alias("_b"), F.col("_t").isNotNull().cast("long").alias("_one"))
    rows = rows.select(*keys, "_part", "_one", *[F.when(F.col("_one") == 1, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("_a", "_b")])
    sums = [
        F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(_LANES))).alias(f"{c}{i}") for c in ("_a", "_b") for i in range(16)
    ]
    parts = rows.groupBy(*keys, "_part").agg(F.sum("_one").alias("_n"), *sums)
    return _from_parts(parts, keys)


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) <= SHINGLE, F.when(F.size(words) > 0, F.array(F.concat_ws(" ", words)))).otherwise(
        F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def _from_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add the counters of all parts and set each bit that more than half of the votes set."""
    counters = [
        F.sum(F.shiftrightunsigned(f"{c}{i}", 16 * lane).bitwiseAND(F.lit(0xFFFF))).alias(f"{c}{i + 16 * lane}")
        for c in ("_a", "_b") for i in range(16) for lane in range(4)
    ]
    total = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), *counters)

    def bits(c: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(64):
            out = out.bitwiseOR(F.when(2 * F.col(f"{c}{i}") > F.col("_n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)))
        return out

    return total.select(*keys, bits("_a").alias("fp1"), bits("_b").alias("fp2"))


def likeness(a1: str, a2: str, b1: str, b2: str) -> Column:
    """Part of equal bits of two fingerprints."""
    return 1 - (F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))) / F.lit(float(BITS))


def block_keys(fp1: str, fp2: str, radius: int = RADIUS, agree: int = AGREE) -> Column:
    """The keys of a fingerprint in all tables: a number for the table and the bits of its blocks."""
    blocks = radius + agree
    text = F.concat(F.lpad(F.bin(fp1), 64, "0"), F.lpad(F.bin(fp2), 64, "0"))
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    piece = [F.substring(text, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
    return F.array(*[F.xxhash64(F.lit(t), *[piece[i] for i in which]) for t, which in enumerate(combinations(range(blocks), agree))])


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """(q1, q2, fp1, fp2, distance): every different fingerprint of prints within ``radius`` bits of one of queries (both: fp1, fp2).

    Equal fingerprints are one point on both sides, so copies are never expanded. All rows are in the tables; only tables'
    rows whose key a query has are compared with it. A pair may meet in several tables and is given once.
    """
    asked = queries.select("fp1", "fp2").distinct().select(F.col("fp1").alias("q1"), F.col("fp2").alias("q2"), F.explode(block_keys("fp1", "fp2", radius, agree)).alias("key"))
    table = prints.select("fp1", "fp2").distinct().select("fp1", "fp2", F.explode(block_keys("fp1", "fp2", radius, agree)).alias("key"))
    away = F.bit_count(F.expr("q1 ^ fp1")) + F.bit_count(F.expr("q2 ^ fp2"))
    near = asked.join(table, (asked["key"] == table["key"]) & (away <= radius) & (away > 0)).select("q1", "q2", "fp1", "fp2", away.alias("distance"))
    return near.distinct()


def near_queries(own: DataFrame, radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """(fp1, fp2, near_queries, near_query): for each fingerprint how many query documents have one within the radius, and the least of their ids.

    Queries are all rows whose id is divisible by ``every``. A query counts for its own row too.
    """
    asked = own.where(F.col("doc_id") % every == 0).groupBy("fp1", "fp2").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    asked = materialize(asked)
    found = near_fingerprints(asked, own, radius).select("q1", "q2", "fp1", "fp2")
    found = found.unionByName(asked.select(F.col("fp1").alias("q1"), F.col("fp2").alias("q2"), "fp1", "fp2"))
    named = found.join(asked.select(F.col("fp1").alias("q1"), F.col("fp2").alias("q2"), "n", "least"), ["q1", "q2"])
    return named.groupBy("fp1", "fp2").agg(F.sum("n").alias("near_queries"), F.min("least").alias("near_query"))


def _id_ranges(docs: DataFrame) -> tuple[Column, int] | None:
    """A number for the range of a doc_id, growing with it, and how many there are: a cell between sampled quantiles of the ids, cut evenly into ranges of about RANGE rows.

    Quantiles follow the rows, so ids may lie anywhere in 64 bits. None for an empty table.
    """
    parts = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", parts, 20 * QUANTILES).alias("at"), F.min("doc_id").alias("lo")).first()
    if not found["n"]:
        return None
    # distinct edges, the least first; a look-up of two steps: among every 32nd edge, then among the 32 from there on
    edges = sorted({found["lo"], *found["at"]})
    rows = [edges[i : i + 32] for i in range(0, len(edges), 32)]
    below = lambda array: F.size(F.filter(array, lambda e: e <= F.col("doc_id")))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    coarse = below(longs([r[0] for r in rows]))
    cell = (coarse - 1) * 32 + below(F.element_at(F.array(*[longs(r) for r in rows]), coarse)) - 1
    each = -(-found["n"] // len(edges) // RANGE) or 1
    low, high = longs(edges), longs([*edges[1:], edges[-1]])
    # as decimals: differences of 64-bit ids may need 65 bits
    wide = lambda c: c.cast("decimal(20,0)")
    inside = (wide(F.col("doc_id")) - wide(F.get(low, cell))) * each / (wide(F.get(high, cell)) - wide(F.get(low, cell)) + 1)
    return cell.cast("long") * each + F.least(F.floor(inside), F.lit(each - 1)).cast("long"), each * len(edges)


def _with_next(docs: DataFrame) -> DataFrame:
    """Add next_id, next_tie, next_copy and next_text: the following row in order of (doc_id, _tie, _copy), after the last one the first.

    Rows are grouped by ranges of ids. The rows of the first id of each range are also put, as guards, at the end of
    the range before it, so that one window over bounded ranges finds every follower.
    """
    found = _id_ranges(docs)
    if found is None:
        return docs.withColumns({"next_id": F.lit(None).cast("long"), "next_tie": F.lit(None).cast("long"), "next_copy": F.lit(None).cast("int"), "next_text": F.lit(None).cast("string")})
    place, ranges = found
    rows = docs.withColumn("_range", place)
    heads = rows.groupBy("_range").agg(F.min("doc_id").alias("doc_id"))
    w = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    last = F.max("_range").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("doc_id", F.coalesce(F.lag("_range").over(w), last).alias("_guards"))
    guards = docs.join(F.broadcast(heads) if ranges <= BROADCAST_RANGES else heads, "doc_id").select(*docs.columns, F.col("_guards").alias("_range"), F.lit(1).alias("_guard"))
    both = rows.withColumn("_guard", F.lit(0)).unionByName(guards)
    w = Window.partitionBy("_range").orderBy("_guard", "doc_id", "_tie", "_copy")
    follow = {"next_id": "doc_id", "next_tie": "_tie", "next_copy": "_copy", "next_text": "text"}
    return both.withColumns({k: F.lead(v).over(w) for k, v in follow.items()}).where("_guard = 0").drop("_range", "_guard")


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter replaced by the next document's start).

    Cases: a null text is empty; the edited text of an empty text is empty; a next document shorter than the quarter
    gives all it has; a lone document follows itself; rows with equal ids are in order of their text's hash, equal rows one after the
    other, and each is followed by the next one; rows without an id are left out; ids may lie anywhere in 64 bits; the terms of a very
    long text are counted in parts; an empty table gives no rows; other columns are ignored, whatever their names.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_queries (how many
    documents with an id divisible by EVERY have a fingerprint within RADIUS bits) and near_query (the least of their ids).
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    slim = slim.withColumn("_tie", F.xxhash64("text"))
    copies = slim.groupBy("doc_id", "_tie").agg(F.count("*").cast("int").alias("_n")).where("_n > 1")
    if copies.isEmpty():
        slim = slim.withColumn("_copy", F.lit(0))
    else:  # equal rows are numbered: one of them is read and stands for all
        one = slim.dropDuplicates(["doc_id", "_tie"]).join(copies, ["doc_id", "_tie"], "left")
        slim = one.select("doc_id", "text", "_tie", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_copy"))
    rows = _with_next(slim)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))
    sha = F.when(F.col("k.kind") == 1, F.sha2(F.col("k.t").cast("binary"), 256))
    key, after = ["doc_id", "_tie", "_copy"], ["next_id", "next_tie", "next_copy"]
    rows = rows.select(*key, *after, n.cast("long").alias("n_chars"), F.explode(kinds).alias("k"))
    rows = rows.select(*key, *after, "n_chars", F.col("k.kind").alias("kind"), F.coalesce(sha, F.lit("")).alias("sha"), F.col("k.t").alias("text"))
    prints = materialize(fingerprints(rows, [*key, *after, "n_chars", "kind", "sha"]))
    own = prints.where("kind = 0").select(*key, *after, "n_chars", "fp1", "fp2")
    edits = prints.where("kind = 1").select(*key, "sha", F.col("fp1").alias("e1"), F.col("fp2").alias("e2"))
    follow = own.select(*[F.col(k).alias(a) for k, a in zip(key, after, strict=True)], F.col("fp1").alias("f1"), F.col("fp2").alias("f2"))
    out = own.join(edits, key).join(follow, after).join(near_queries(own), ["fp1", "fp2"], "left")
    show = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), show("fp1", "fp2").alias("fingerprint"), show("e1", "e2").alias("edited_fingerprint"),
        likeness("fp1", "fp2", "e1", "e2").alias("near_edited"), likeness("fp1", "fp2", "f1", "f2").alias("near_next"),
        F.coalesce("near_queries", F.lit(0)).alias("near_queries"), "near_query",
    )


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return simhash_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
