"""Secret scans with DataFrame functions only.

Base kinds come from fixed patterns. The method adds spans of kind ``markov``: tokens whose characters follow a Markov model of
random strings rather than one of ordinary identifiers, by the log-likelihood ratio of the two. Both models are trained
from a bounded sample of labelled tokens of the corpus itself: values that a base pattern found are random strings, tokens
outside of base matches are ordinary, of any length and with digits or without; only those with digits that are long enough to be
judged and occur once have no label, as they may be secrets.
A token is added when the ratio over all its characters beats the odds against a secret, so a short token has to be odder than a long one.

Spans are found by marking: a pattern's matches are wrapped in a control character, the text is split at it, and the running
length of the pieces gives each match's place in code points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.tables import spare_names

# Fixed values of the base rules: patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

#: Tokens that the models judge: shorter ones could not beat the odds.
TOKEN = r"[A-Za-z0-9+/_=-]+"
TOKEN_CHARS = 16
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents (in expectation) whose tokens train the models.
TRAINING_DOCS = 20_000
#: A token is taken for random when its log-likelihood ratio is over this: the logarithm of the odds against a secret, a million to one.
THRESHOLD = math.log(1e6)
#: Weight, in counts, of single characters in a transition's probability.
BACKING = 8.0
_MARK, _OTHER = "\x01", "\x02"
#: Pieces of a marked text that are summed up together: an even number, so that each block starts with text.
BLOCK = 256
#: Result columns of a scan.
RESULTS = ("n_assign", "n_access", "n_hex", "found", "base_found")


def _spans(text: Column, pattern: str, quick: str) -> Column:
    """All leftmost, non-overlapping matches of pattern as array<struct<start, end, match>>; quick must be in a text with any."""
    marked = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    # pieces alternate: text, match, text, match, ..., text; blocks of them are summed up first, so that no array grows piece by piece over a long text
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        found = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("match"))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

    def placed(pieces: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        blocks = F.transform(first, lambda b: F.aggregate(F.slice(pieces, b * BLOCK + 1, BLOCK), start, step))
        shift = F.struct(F.lit(0).alias("at"), none.alias("found"))

        def add(acc: Column, block: Column) -> Column:
            moved = F.transform(block["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["match"].alias("match")))
            return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["found"], moved).alias("found"))

        return F.aggregate(blocks, shift, add, lambda acc: acc["found"])

    return F.when(text.rlike(quick), placed(marked)).otherwise(none)


def _base(text: Column) -> dict[str, Column]:
    value = lambda s: F.regexp_extract(s["match"], ASSIGN, 1)
    return {
        "assign": F.filter(_spans(text, ASSIGN, ASSIGN), lambda s: F.length(value(s)) >= ASSIGN_VALUE),
        "access": F.filter(_spans(text, ACCESS, "AKIA[A-Z0-9]{12}"), lambda s: F.length(s["match"]) >= ACCESS_CHARS),
        "hex": _spans(text, f"[0-9a-f]{{{HEX_CHARS},}}", f"[0-9a-f]{{{HEX_CHARS}}}"),
    }


def labelled_tokens(docs: DataFrame) -> DataFrame:
    """(token, random, n): distinct tokens of doc texts with their numbers; random is 1 for values of base spans, 0 for tokens outside of all base matches.

    Tokens of TOKEN_CHARS or more with a digit that occur once outside of base matches are left out.
    """
    text = F.col("text")
    base = _base(text)
    secrets = docs.select(F.explode(F.concat(
        F.transform(base["assign"], lambda s: F.regexp_extract(s["match"], ASSIGN, 1)), F.transform(base["access"], lambda s: s["match"]), F.transform(base["hex"], lambda s: s["match"]),
    )).alias("token"), F.lit(1).alias("random"))
    plain = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, ACCESS, f"[0-9a-f]{{{HEX_CHARS},}}"), text)
    plain = docs.select(F.explode(F.regexp_extract_all(plain, F.lit(f"({TOKEN})"))).alias("token"), F.lit(0).alias("random"))
    tokens = secrets.unionByName(plain).where(F.length("token") >= 2).groupBy("token", "random").agg(F.count("*").alias("n"))
    return tokens.where((F.col("random") == 1) | (F.col("n") > 1) | (F.length("token") < TOKEN_CHARS) | ~F.col("token").rlike("[0-9]"))


def train(docs: DataFrame, bound: int = TRAINING_DOCS) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of every pair of neighbouring characters, row by row of ALPHABET.

    At most ``bound`` documents in expectation give tokens (all, where there are fewer); the table has a fixed size. Counts
    are backed by single characters, and those by one count each: without secrets the model of random strings is uniform.
    """
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, bound / max(n, 1))))
    tokens = labelled_tokens(part)
    pairs = tokens.select("random", "n", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    size = len(ALPHABET)
    counts = [[0.0] * size * size, [0.0] * size * size]
    pairs = pairs.select("random", "n", F.expr(f"instr('{ALPHABET}', substr(token, i, 1)) - 1").alias("a"), F.expr(f"instr('{ALPHABET}', substr(token, i + 1, 1)) - 1").alias("b"))
    for r in pairs.where("a >= 0 AND b >= 0").groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect():  # at most 2 * size * size rows
        counts[r["random"]][r["a"] * size + r["b"]] += r["n"]
    models = [_transitions(c, size) for c in counts]
    return [round(math.log(r) - math.log(o), 6) for o, r in zip(*models, strict=True)]


def rates(tokens: DataFrame, ratios: list[float]) -> DataFrame:
    """(random, tokens, found) of labelled tokens (token, random): how many are taken for random."""
    return tokens.groupBy("random").agg(F.count("*").alias("tokens"), F.count_if(_ratio(F.col("token"), ratios) > THRESHOLD).alias("found"))


def held_out_rates(docs: DataFrame) -> DataFrame:
    """rates() of the distinct tokens of a fifth of the documents, of TOKEN_CHARS or more, by models trained on the others."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 0
    ratios = train(docs.where(~other))
    return rates(labelled_tokens(docs.where(other)).where(F.length("token") >= TOKEN_CHARS), ratios)


def planted_tokens(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(token, random, length): for each document and length a random string of letters and digits (1), and ordinary tokens made of its words (0).

    Ordinary ones are two words joined by an underscore, with a capital or by a number, cut to the length; documents with fewer words give
    none. Random strings are base64 digests of the id, none of which a base pattern finds.
    """
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]{4,})")))
    rows = docs.select("doc_id", words.alias("w"), F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    digest = F.translate(F.base64(F.unhex(F.sha2(F.concat_ws(":", "doc_id", "length").cast("binary"), 512))), "+/=", "")
    at = F.pmod(F.xxhash64("doc_id", "length"), F.greatest(F.size("w") - 1, F.lit(1))).cast("int")
    a, b = F.get("w", at), F.get("w", at + 1)
    made = F.array(F.concat_ws("_", a, b), F.concat(F.lower(a), F.initcap(b)), F.concat(F.lower(a), F.pmod(F.hash("doc_id"), F.lit(1000)).cast("string"), F.lower(b)), F.concat(F.lower(a), F.lit("2024"), F.lower(b)))
    plain = rows.where(F.size("w") >= 2).select(F.explode(made).alias("token"), "length").where(F.length("token") >= F.col("length"))
    plain = plain.select(F.substring("token", F.lit(1), F.col("length")).alias("token"), F.lit(0).alias("random"), "length")
    return rows.select(F.substring(digest, F.lit(1), F.col("length")).alias("token"), F.lit(1).alias("random"), "length").unionByName(plain).distinct()


def _transitions(counts: list[float], size: int) -> list[float]:
    """Probabilities of the next character: counts of pairs, backed by BACKING counts spread like single characters (each seen once more)."""
    single = [1.0 + sum(counts[j::size]) for j in range(size)]
    whole = sum(single)
    out = []
    for i in range(size):
        row = counts[i * size : (i + 1) * size]
        out += [(n + BACKING * single[j] / whole) / (sum(row) + BACKING) for j, n in enumerate(row)]
    return out


def _ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token: the sum over its neighbouring characters."""
    size = len(ALPHABET)
    table = F.lit(ratios)
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        places, F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")),
        lambda acc, p: F.struct(p.alias("before"), (acc["sum"] + F.when(acc["before"] >= 0, F.get(table, (acc["before"] * size + p).cast("int"))).otherwise(0.0)).alias("sum")),
        lambda acc: acc["sum"],
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """Add to docs the counts of base kinds, all spans and the base spans, under ``names`` (n_assign, n_access, n_hex, found, base_found).

    Spans are array<struct<start, rank, end>>, by start, then kind as listed (rank). Cases: a null text is empty and has no spans;
    rows and ids may repeat, each row is scanned by itself; an added span never overlaps a base span; a very long text is scanned whole
    in one task; a table without any secret trains on smoothed counts; an empty table gives no rows; other columns stay, whatever
    their names. Columns of docs named like a result column are replaced by it.
    """
    docs = docs.drop(*names)
    n_assign, n_access, n_hex, found, base_found = names
    t, tokens, *kinds = spare_names(docs, "_t", "_tokens", "_assign", "_access", "_hex")
    rows = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    if ratios is None:
        ratios = train(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    base = _base(F.col(t))
    rows = rows.withColumns(dict(zip(kinds, base.values(), strict=True)) | {tokens: _spans(F.col(t), f"[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}", f"[A-Za-z0-9+/_=-]{{{TOKEN_CHARS}}}")})
    as_kind = lambda spans, rank: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))
    rows = rows.withColumn(base_found, F.array_sort(F.concat(*[as_kind(F.col(k), i) for i, k in enumerate(kinds)])))
    # the ratio comes first: few tokens are left to be held against the base spans
    fresh = F.filter(F.col(tokens), lambda x: (_ratio(x["match"], ratios) > THRESHOLD) & ~F.exists(F.col(base_found), lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    rows = rows.withColumn(found, F.array_sort(F.concat(F.col(base_found), as_kind(fresh, 3))))
    counts = {name: F.size(k).cast("long") for name, k in zip((n_assign, n_access, n_hex), kinds, strict=True)}
    return rows.withColumns(counts).select(*docs.columns, *names)


def _listed(spans: str) -> Column:
    name = lambda r: F.element_at(F.array(*map(F.lit, ("assign", "access", "hex", "markov"))), r + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by ``mask``; same columns, whatever their names. A null text stays null."""
    names = spare_names(docs, *RESULTS)
    rows = scan_secrets(docs, id_col, text_col, names=names)
    found = names[3]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        # spans of different kinds may overlap: what an earlier one has covered is not masked twice
        gap = F.substring(F.col(text_col), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["text"], gap, F.lit(mask))).otherwise(acc["text"]).alias("text"))

    rest = lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col)))
    text = F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed("base_found").cast("binary"), 256).alias("base_sha256"), _listed("found").alias("spans")
    )
