"""The operators of the llm subpackage against brute force on a small corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.corpus import WORD, docs, empty, rows

PLAIN = [(r[0], r[1]) for r in rows()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- 1 -------------------------------------------------------------------------------------------------------------


def brute_windows(data, size):
    first, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in data}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone |= {*range(i, i + size)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("size", "hot"), [(50, None), (12, None), (50, 1), (12, 1), (10, None)])
def test_substring_dedup(spark, monkeypatch, size, hot):
    from captionlake.llm import substrings

    if hot:  # all prefixes that are shared are lengthened, up to whole windows
        monkeypatch.setattr(substrings, "PREFIX_SEGMENTS", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.drop_repeated_windows(docs(spark), size).collect()}
    assert got == brute_windows(PLAIN, size)
    assert sum(v[1] for v in got.values()) > 200


def test_substring_dedup_edge_tables(spark):
    from captionlake.llm.substrings import drop_repeated_windows

    assert drop_repeated_windows(empty(spark)).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    data = [(5, text, None, None, 0, 0, "", "", "", 0)] * 2 + [(None, text, None, None, 0, 0, "", "", "", 0), (9, text, None, None, 0, 0, "", "", "", 0)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in drop_repeated_windows(docs(spark, data)).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (9, 80)]


def test_suffix_array_nodes():
    """Each node of each depth holds the rows that share so many words below one prefix, no more and no fewer."""
    from captionlake.llm.substrings import nodes_at, sorted_suffixes

    rng = np.random.default_rng(0)
    words, prefix = rng.integers(1, 4, (80, 6)), rng.integers(0, 3, 80)
    words[:20, 4:] = 0
    order, shared = sorted_suffixes(prefix, words)
    for depth in range(7):
        keys = [(prefix[i], *words[i, :depth]) for i in range(80)]
        node = nodes_at(order, shared, depth).tolist()
        assert len({*zip(keys, node, strict=True)}) == len({*keys}) == len({*node})


def test_window_owners():
    """Every window of every segment, also at their ends, belongs to the least owner of an equal window with the same prefix."""
    from captionlake.llm.substrings import window_owners

    rng, window, gram = np.random.default_rng(1), 8, 3
    prefixes = [[1, 2, 3], [3, 1, 1]]
    segs, prefix, anchor = [], [], []
    for _ in range(150):
        p, before = int(rng.integers(0, 2)), int(rng.integers(0, window - gram + 1))
        after = int(rng.integers(window - gram - before, window - gram + 1))
        segs.append([*rng.integers(1, 3, before), *prefixes[p], *rng.integers(1, 3, after)])
        prefix.append(p)
        anchor.append(before)
    owner = rng.integers(0, 1000, len(segs))
    first = np.append(0, np.cumsum([len(s) for s in segs]))
    row, start, own = window_owners(np.array(prefix), np.concatenate(segs), first, np.array(anchor), owner, window)
    want = [(i, s) for i, x in enumerate(segs) for s in range(len(x) - window + 1)]
    assert list(zip(row.tolist(), start.tolist(), strict=True)) == want
    key = lambda i, s: (prefix[i], anchor[i] - s, *segs[i][s : s + window])
    least = {}
    for i, s in want:
        least[key(i, s)] = min(least.get(key(i, s), 10**6), owner[i])
    assert own.tolist() == [least[key(i, s)] for i, s in want]


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    from captionlake.llm.packing import pack, token_pieces, vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in PLAIN}
    got = pack(token_pieces(docs(spark))).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id]) and r.length == len(ids)
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, ids in want.items():
        assert [s for s, _ in sorted(parts[d])] == list(np.cumsum([0] + [n for _, n in sorted(parts[d])][:-1])) and sum(n for _, n in parts[d]) == len(ids)
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places][:-1])) and sum(n for _, n in places) <= 2048
    assert len(sequences) <= 1.1 * sum(map(len, want.values())) / 2048 + 1
    assert pack(token_pieces(empty(spark))).count() == 0


def test_rank_file_gives_the_tokenizers_ids():
    """Words that tiktoken merges have the ids that the tokenizers library gives: every entry of the vocabulary, alone and glued, and all Latin characters."""
    from tokenizers import Tokenizer

    from captionlake.llm.packing import _PLAIN, WordEncoder, ranks_path, vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    entries = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    rng = random.Random(5)
    latin = [chr(c) for c in range(0x20, 0x250)]
    texts = entries + latin + [f"a{c}b" for c in latin]
    texts += [rng.choice(entries).strip() + rng.choice(entries).strip() for _ in range(60_000)]
    texts += ["".join(rng.choice("aeinorst'.,-") for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    texts = [t for t in dict.fromkeys(texts) if _PLAIN.fullmatch(t)]
    assert len(texts) > 100_000
    encoder = WordEncoder(vocabulary_path(), ranks_path())
    for lo in range(0, len(texts), 20_000):
        part = texts[lo : lo + 20_000]
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(part) == want


def test_packing_keeps_other_columns(spark):
    from pyspark.sql import functions as F

    from captionlake.llm.packing import pack, token_pieces

    names = ["cls", "cell", "rank", "slot", "lo", "n", "row", "sequence_id"]
    pieces = token_pieces(docs(spark)).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    got = pack(pieces)
    assert got.columns == [c for c in pieces.columns if c != "sequence_id"] + ["sequence_id", "offset"]
    assert {tuple(r[n] for n in names[:-1]) for r in got.collect()} == {tuple(range(7))} and got.count() == pieces.count()


def test_cutting_patterns_cover_demand():
    from captionlake.llm.packing import cutting_patterns

    rng = np.random.default_rng(4)
    for _ in range(5):
        demand = rng.integers(0, 400, 32) * (rng.random(32) < 0.6) * (np.arange(32) < 12)  # small pieces can fill nearly all room
        found = cutting_patterns(demand, 32)
        assert all((c * np.arange(1, 33)).sum() <= 32 for c, _ in found)
        assert (sum((c * n for c, n in found), np.zeros(32, int)) >= demand).all()
        least = (demand * np.arange(1, 33)).sum() / 32
        assert sum(n for _, n in found) <= 1.05 * least + 20


def test_cutting_plan_proves_its_gap_beside_a_session(spark):
    """All 256 classes, over 200 columns (the inverse is made anew), and demands that no greedy filling solves, with a session alive."""
    from captionlake.llm.packing import GAP, _inverse, cutting_plan

    assert spark.range(3).count() == 3
    rng = np.random.default_rng(5)
    for lo, hi, top in ((1, 257, 60), (60, 140, 10**6), (40, 90, 10**4)):
        demand = np.zeros(256, np.int64)
        demand[lo - 1 : hi - 1] = rng.integers(1, top, hi - lo)
        plan = cutting_plan(demand, 256)
        assert (sum((c * n for c, n in plan.patterns), np.zeros(256, int)) >= demand).all()
        assert all((c * np.arange(1, 257)).sum() <= 256 for c, _ in plan.patterns)
        assert 0 <= plan.gap <= GAP + 1e-9
        assert sum(n for _, n in plan.patterns) <= plan.value + np.count_nonzero(demand)
    m = rng.normal(size=(256, 256))
    assert np.abs(_inverse(m) @ m - np.eye(256)).max() < 1e-6


def test_cutting_plan_bound_against_all_patterns():
    """The least number of sequences by full search on tiny demands lies between the proven bound and the plan."""
    import itertools

    from captionlake.llm.packing import cutting_plan

    rng = np.random.default_rng(6)
    units = 7
    patterns = [p for p in itertools.product(*(range(units // c + 1) for c in range(1, units + 1))) if 0 < sum(n * c for n, c in zip(p, range(1, units + 1))) <= units]
    for _ in range(6):
        demand = rng.integers(0, 3, units)
        plan = cutting_plan(demand, units)
        least, now = 0, {tuple(demand)}
        while not any(not any(d) for d in now):
            now = {tuple(np.maximum(np.array(d) - p, 0)) for d in now for p in patterns}
            least += 1
        assert plan.bound <= least + 1e-9
        assert least <= sum(n for _, n in plan.patterns)


# --- 3 -------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    from captionlake.llm.fingerprints import simhash_report

    got = {r.doc_id: r for r in simhash_report(docs(spark)).collect()}
    order = sorted((d, t or "") for d, t in PLAIN)
    assert len(got) == len(order)
    by_text = defaultdict(set)
    for (d, t), (nd, nt) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == sha(t[: len(t) - k] + nt[:k])
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
        assert got[d].near_next == pytest.approx(bits(got[d].fingerprint, got[nd].fingerprint))
        assert got[d].near_edited == pytest.approx(bits(got[d].fingerprint, got[d].edited_fingerprint))
        by_text[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    prints = {d: int(r.fingerprint, 16) for d, r in got.items()}
    for d, r in got.items():
        near = [o for o, p in prints.items() if o % 100 == 0 and bin(prints[d] ^ p).count("1") <= 7]
        assert (r.near_queries, r.near_query) == (len(near), min(near, default=None))
    assert any(r.near_queries for r in got.values())
    assert simhash_report(empty(spark)).count() == 0


def test_fingerprints_far_and_equal_ids(spark, monkeypatch):
    """Ids anywhere in 64 bits, equal ids and equal rows: each row is followed by the next one, in ranges of few rows."""
    from captionlake.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE", 2)
    monkeypatch.setattr(fingerprints, "QUANTILES", 8)
    rng = random.Random(8)
    ids = [*range(60), 2**61, 2**63 - 1, -(2**63), 7, 7, 7]
    text = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 30))) for i in ids}
    data = [(i, text[i]) for i in ids]
    got = fingerprints.simhash_report(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    order = sorted(data)
    want = sorted((d, sha(t[: len(t) - len(t) // 4] + after[: len(t) // 4])) for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == want


def test_fingerprint_votes(spark):
    """A fingerprint's bits are the majority of its terms' hash bits."""
    from pyspark.sql import functions as F

    from captionlake.llm.fingerprints import fingerprints

    text = "a b c a b d"
    terms = ["a b", "b c", "c a", "a b", "b d"]
    hashes = spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(29), "t").alias("b")).collect()
    want = [sum((sum((r[c] >> i) & 1 for r in hashes) * 2 > len(terms)) << i for i in range(64)) for c in ("a", "b")]
    got = fingerprints(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first()
    assert [got.fp1 & (2**64 - 1), got.fp2 & (2**64 - 1)] == want


@pytest.mark.parametrize("agree", [1, 2])
def test_near_fingerprints(spark, agree):
    """The tables find every fingerprint within the radius of a query, whichever bits differ."""
    from captionlake.llm.fingerprints import near_fingerprints

    rng = random.Random(2)
    values = [rng.getrandbits(128) for _ in range(40)]
    for v in values[:40]:
        for n in (1, 2, 3, 5, 6, 7, 8):
            x = v
            for i in rng.sample(range(128), n):
                x ^= 1 << i
            values.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in values], "fp1 long, fp2 long")
    near = near_fingerprints(table.limit(40), table, 7, agree).collect()
    full = lambda a, b: ((a % 2**64) << 64) | b % 2**64
    got = {(full(r.q1, r.q2), full(r.fp1, r.fp2)): r.distance for r in near}
    want = {(a, b): bin(a ^ b).count("1") for a in values[:40] for b in values if 0 < bin(a ^ b).count("1") <= 7}
    assert len(near) == len(got) and got == want and len(want) >= 240


# --- 4 -------------------------------------------------------------------------------------------------------------


def brute_lines(data, least):
    """Lines of runs of every length with enough words that an earlier place also has, but for lines of that first copy."""
    lines = {d: [s for s in (t or "").split("\n") if WORD.search(s)] for d, t in data}
    first = {}
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for n in range(1, len(lines[d]) - i + 1):
                first.setdefault(tuple(lines[d][i : i + n]), (d, i))
    out = {}
    for d, t in data:
        gone = set()
        for i in range(len(lines[d])):
            for n in range(1, len(lines[d]) - i + 1):
                block = tuple(lines[d][i : i + n])
                if first[block] < (d, i) and sum(len(WORD.findall(s)) for s in block) >= least:
                    f, at = first[block]
                    gone |= {j for j in range(i, i + n) if f != d or j >= at + n}
        kept, k = [], 0
        for s in (t or "").split("\n"):
            if WORD.search(s):
                k += 1
                if k - 1 in gone:
                    continue
            kept.append(s)
        out[d] = (len(lines[d]), len(gone), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [1, 20])
def test_line_dedup(spark, least):
    from captionlake.llm.lines import drop_repeated_lines

    got = {r.doc_id: (r._n_lines, r._n_removed, sha(r.text or "")) for r in drop_repeated_lines(docs(spark), least).collect()}
    assert got == brute_lines(PLAIN, least)
    assert sum(v[1] for v in got.values()) > 10


def test_line_dedup_runs_of_every_length(spark):
    """Runs go as a whole where no power-of-two block has enough words, and with their short tails."""
    from captionlake.llm.lines import drop_repeated_lines

    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    runs = [[line(n) for n in sizes] for sizes in ([9] * 3, [4] * 7, [50, 5, 5], [5, 5, 50], [19], [1] * 23, [6] * 3)]
    data = [(2 * i + k, "\n".join([line(3), *r, line(3)])) for i, r in enumerate(runs) for k in (0, 1)]
    pool = [line(rng.randint(1, 12)) for _ in range(4)]
    data += [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(12)]
    rows = drop_repeated_lines(docs(spark, [(d, t, None, None, 0, 0, "", "", "", 0) for d, t in data])).collect()
    assert {r.doc_id: (r._n_lines, r._n_removed, sha(r.text)) for r in rows} == brute_lines(data, 20)
    got = {r.doc_id: r.text for r in rows}
    assert [got[2 * i + 1].count("\n") for i in range(7)] == [1, 1, 1, 1, 2, 1, 4]


def test_line_dedup_first_copies_stay_whole(spark):
    """Lines that repeat themselves: the first block with enough words stays, as do the first ones of longer periods."""
    from captionlake.llm.lines import drop_repeated_lines

    texts = [["a b"] * 60, ["c d", "e f"] * 30, ["g h i"] * 8 + ["x"] + ["g h i"] * 8, ["j"] * 19, ["k l m n"] * 4 + ["o"] * 30, ["a b"] * 9 + ["other line"]]
    data = [(d, "\n".join(t)) for d, t in enumerate(texts)]
    rows = drop_repeated_lines(docs(spark, [(d, t, None, None, 0, 0, "", "", "", 0) for d, t in data])).collect()
    assert {r.doc_id: (r._n_lines, r._n_removed, sha(r.text)) for r in rows} == brute_lines(data, 20)
    kept = {r.doc_id: r._n_lines - r._n_removed for r in rows}
    assert (kept[0], kept[1], kept[3], kept[5]) == (10, 10, 19, 10)


def test_line_dedup_keeps_columns(spark):
    from captionlake.llm.lines import drop_repeated_lines

    out = drop_repeated_lines(docs(spark))
    assert out.columns == docs(spark).columns + ["_n_lines", "_n_removed"]
    assert drop_repeated_lines(empty(spark)).count() == 0


def test_line_dedup_any_id(spark):
    """Ids of all 64 bits, below 0 too, in their order."""
    from captionlake.llm.lines import drop_repeated_lines

    run = "\n".join(f"line {i} of a longer run" for i in range(5))
    ids = [-(2**63), -5, 0, 2**61, 2**63 - 1]
    got = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame([(i, f"{run}\nown {i}") for i in ids], "doc_id long, text string")).collect()}
    assert got == {i: f"{run}\nown {i}" if i == ids[0] else f"own {i}" for i in ids}


def test_line_dedup_clashing_names(spark):
    from pyspark.sql import functions as F

    from captionlake.llm.lines import drop_repeated_lines

    names = ["_id", "cuts", "CUT_ID", "place", "line", "lines", "k1", "n", "start", "part", "_n_lines"]
    table = docs(spark).select("doc_id", F.col("text").alias("body"), *[F.lit(i).alias(n) for i, n in enumerate(names)], F.lit("t").alias("text"))
    got = drop_repeated_lines(table, text_col="body")
    assert got.columns == [c for c in table.columns if c != "_n_lines"] + ["_n_lines", "_n_removed"]
    assert {(r.text, *(r[n] for n in names[:-1])) for r in got.collect()} == {("t", *range(len(names) - 1))}
    assert {r.doc_id: (r._n_lines, r._n_removed, sha(r.body or "")) for r in got.collect()} == brute_lines(PLAIN, 20)


# --- 5 -------------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    from captionlake.llm.sharding import stratified_shards

    data = [(i, f"t{i % 9}" if i % 4 else None, "en", "hot" if i % 3 else f"s{i % 7}", 0, 0, "", "", "", 0) for i in range(500)] + [(7, "t7", "en", "hot", 0, 0, "", "", "", 0)] * 2
    got = stratified_shards(docs(spark, data)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in data)
    slots, mix = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r.shard].append(r.slot)
        mix[r.stratum][r.shard] += 1
        assert r.law == "rows" and r.grown_shard is None
    assert {*slots} == {*range(16)} and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    for counts in mix.values():  # every source in proportion, up to the rounding at both ends of a shard
        assert max(counts[s] for s in range(16)) - min(counts[s] for s in range(16)) <= 2
    texts = {r[0]: r[1] or "" for r in data}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert stratified_shards(empty(spark)).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------------


def test_bpe(spark):
    from tokenizers import Tokenizer

    from captionlake.llm.bpe import bpe_round_trip, vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    extra = ["ΣΑΣ Σας İstanbul", "é ́a x\x1cz\x85y", "日本語 １２３ ½ ไทย กำลัง", "it's WE'LL can't", "aaaaaaaaa hahahaha", "<|startoftext|>A b<|endoftext|>", "😀👍🏽", "y" * 5000]
    data = rows() + [(10_000 + i, t, None, None, 0, 0, "", "", "", 0) for i, t in enumerate(extra)]
    got = {r.doc_id: r for r in bpe_round_trip(docs(spark, data)).collect()}
    for r in data:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        g = got[r[0]]
        assert (g.ids, g.n_tokens, g.decoded) == (ids, len(ids), text)
        assert g.ids_sha256 == sha(" ".join(map(str, ids))) and g.decoded_sha256 == sha(text)
    assert bpe_round_trip(empty(spark)).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------------


def test_classifier(spark):
    from captionlake.llm.classifier import classify

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    data, labels = [], []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        good = i % 4 != 0
        text = " ".join(words) if good else " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words)
        data.append((i, text, "en", "s", 0, 0, "", "", "", 0))
        if i % 8 != 7:
            labels.append((i, int(good), 0))
    data += [(1000, None, None, None, None, 0, "", "", "", 0), (1001, "", None, None, 0, 0, "", "", "", 0), (1, data[1][1], "en", "s", 0, 0, "", "", "", 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classify(docs(spark, data), table).collect()
    assert len(got) == len(data)
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.held_out and r.doc_id < 1000]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len(right) > 50 and np.mean(right) > 0.95
    scores = {r.doc_id: r.score for r in got}
    assert scores[1000] == scores[1001]
    assert classify(empty(spark), table).count() == 0
    assert all(abs(r.score - 0.5) < 0.05 for r in classify(docs(spark, data[:3]), table.limit(0)).collect())


def test_factorisation_machine_pairs():
    from captionlake.llm.classifier import FactorisationMachine

    fm = FactorisationMachine(6, rank=3)
    rng = np.random.default_rng(0)
    fm.w, fm.v, fm.bias = rng.normal(size=6), rng.normal(size=(6, 3)), 0.3
    feature, value = np.array([0, 2, 5, 1, 3]), np.array([1.0, 0.5, -2.0, 1.5, 0.7])
    row = np.array([0, 0, 0, 1, 1])
    for r, got in enumerate(fm.score(2, row, feature, value)):
        f, x = feature[row == r], value[row == r]
        total = fm.bias + fm.w[f] @ x + sum(fm.v[f[i]] @ fm.v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


# --- 8 -------------------------------------------------------------------------------------------------------------


def brute_statistics(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [s for s in t.split("\n") if WORD.search(s)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered)


def test_quality_rules(spark):
    from captionlake.llm.quality_rules import quality_rules

    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    clean = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 300))) for _ in range(200)]
    junk = [" ".join(rng.choice(vocab) + "###" for _ in range(100)) for _ in range(6)]
    data = rows() + [(5000 + i, t, "en", "s0", 0, 0, "", "", "", 0) for i, t in enumerate(clean + junk)]
    got = {r.doc_id: r for r in quality_rules(docs(spark, data)).collect()}
    assert len(got) == len(data)
    for r in data:
        g = got[r[0]]
        want = brute_statistics(r[1])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)
    assert all(got[5000 + i].kept for i in range(len(clean)))
    assert not any(got[5000 + len(clean) + i].kept for i in range(len(junk)))
    assert quality_rules(empty(spark)).count() == 0


def brute_mcd(x, rng):
    """The reweighted estimate (mean, covariance) of least determinant, by many starts that all run to their end."""
    from captionlake.llm import quality_rules as q

    floor = np.diag(np.square(list(q.FLOOR.values())))
    keep, d = int(np.ceil(q.CORE * len(x))), x.shape[1]
    away = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
    fit = lambda part, k: (part.mean(axis=0), k * np.cov(part.T, bias=True) + floor)
    best = (np.inf, None)
    for _ in range(60):
        part, before = x[rng.permutation(len(x))[: d + 1]], None
        for _ in range(100):
            mean, cov = fit(part, q.consistency(q.CORE, d))
            size = np.linalg.slogdet(cov)[1]
            if before is not None and abs(size - before) < 1e-12:
                break
            before, part = size, x[np.argsort(away(mean, cov), kind="stable")[:keep]]
        best = min(best, (size, (mean, cov)), key=lambda t: t[0])
    return fit(x[away(*best[1]) <= q.chi_square_quantile(q.REWEIGHTED, d)], q.consistency(q.REWEIGHTED, d))


def test_minimum_covariance_determinant(spark):
    """Three groups, one with a cluster of outliers that would mask itself, and small ones that their language or all rows judge for the most part."""
    from captionlake.llm import quality_rules as q

    rng = np.random.default_rng(5)
    rows = []

    def add(lang, source, n, length, symbols, odd=0):
        for i in range(n):
            words = int(np.exp(rng.normal(length, 0.5))) + 50
            chars = int(words * np.exp(rng.normal(1.6, 0.05)))
            many = int(chars * rng.uniform(0.2, 0.3)) if i < odd else int(rng.poisson(chars * symbols))
            rows.append((len(rows), lang, source, words, chars, many, int(rng.poisson(0.3)), int(rng.poisson(words * 0.02)), False))

    add("en", "web", 400, 5.5, 0.002, 90)
    add("en", "books", 300, 7.0, 0.0)
    add("de", "web", 200, 5.0, 0.01)
    add("en", "tiny", 30, 5.5, 0.002, 8)
    add("xx", "tiny", 20, 5.5, 0.002)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    table = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean")
    got = {r.doc_id: r for r in q.robust_outliers(table).collect()}
    assert len(got) == len(rows)
    x = np.array([[np.log1p(w), np.log(c / w), np.sqrt(s / c), np.sqrt(u / w), np.sqrt(p / w)] for _, _, _, w, c, s, u, p, _ in rows])
    cut = q.chi_square_quantile(1 - q.REJECTED, 5)
    lang, source = (np.array([r[i] for r in rows]) for i in (1, 2))

    def mixed(n, own, wide):
        part, apart = max(0, n - 5) / (max(0, n - 5) + q.PRIOR_ROWS), own[0] - wide[0]
        return part * own[0] + (1 - part) * wide[0], part * own[1] + (1 - part) * wide[1] + part * (1 - part) * np.outer(apart, apart)

    fit = brute_mcd(x, rng)
    everything = mixed(len(x), fit, (fit[0], np.eye(5) * q.WIDE**2))
    langs = {k: mixed((lang == k).sum(), brute_mcd(x[lang == k], rng), everything) for k in ("en", "de", "xx")}
    for k, s in {*zip(lang.tolist(), source.tolist(), strict=True)}:
        own = np.flatnonzero((lang == k) & (source == s))
        mean, cov = mixed(len(own), brute_mcd(x[own], rng), langs[k])
        for i in own:
            away = (x[i] - mean) @ np.linalg.inv(cov) @ (x[i] - mean)
            assert got[i].distance == pytest.approx(away, rel=0.15, abs=0.5)
            if abs(away / cut - 1) > 0.15:
                assert got[i].kept_by_fit == (away <= cut)
    assert not any(got[i].kept_by_fit for i in range(90)) and not any(got[900 + i].kept_by_fit for i in range(8))
    assert sum(r.kept_by_fit for r in got.values()) >= len(rows) - 98 - 2


def test_chi_square():
    from captionlake.llm.quality_rules import chi_square, chi_square_quantile

    for part, d, value in [(0.95, 5, 11.0705), (0.975, 5, 12.8325), (0.5, 1, 0.454936), (0.999, 7, 24.3219)]:
        assert chi_square_quantile(part, d) == pytest.approx(value, abs=1e-3) and chi_square(value, d) == pytest.approx(part, abs=1e-5)


def test_sources_of_any_size_are_judged_by_one_rule(spark):
    """Of sources with 1 to 40 documents the odd ones go, whatever their number, and the clean ones stay."""
    from captionlake.llm import quality_rules as q

    rng = np.random.default_rng(8)
    rows = []
    for source, n in {"big": 600, **{f"s{n}": n for n in (1, 2, 11, 25, 40)}}.items():
        for i in range(n):
            words = int(np.exp(rng.normal(5.5, 0.4))) + 50
            chars = int(words * np.exp(rng.normal(1.6, 0.05)))
            odd = n > 1 and i == 0
            rows.append((len(rows), "en", source, words, chars, chars // 3 if odd else int(rng.poisson(chars * 0.002)), 0, int(rng.poisson(words * 0.02)), False, odd))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    table = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, odd boolean")
    got = q.robust_outliers(table).collect()
    assert len(got) == len(rows) and all(r.kept_by_fit != r.odd for r in got)


def test_few_rows_have_no_outliers(spark):
    from captionlake.llm.quality_rules import quality_rules

    text = " ".join(f"word{i}" for i in range(60))
    got = quality_rules(docs(spark, [(i, text if i else text.replace("w", "#"), "en", "s", 0, 0, "", "", "", 0) for i in range(5)])).collect()
    assert [r.kept for r in got] == [True] * 5 and all(r.distance is not None for r in got)


# --- 9 -------------------------------------------------------------------------------------------------------------

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_secrets(t):
    t = t or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(spans)


def test_secret_scans(spark):
    from pyspark.sql import functions as F

    from captionlake.llm import secrets

    rng = random.Random(5)
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    planted = [mixed(40) for _ in range(5)]
    data = rows() + [
        (7000, "é api_key: 'abc.def-ghi=' and PASSWORD = short token=secret=abcdefgh1234 token: secret: abcdefghij", None, None, 0, 0, "", "", "", 0),
        (7002, "é token=abcdefgh1 " * 700, None, None, 0, 0, "", "", "", 0),
        (7001, "deadbeef" * 4 + "z" + "deadbeef" * 5 + " AKIAAKIAAKIA12 AKIAABCDEFGHIJKL", None, None, 0, 0, "", "", "", 0),
        *[(7100 + i, f"my key {p} is here, thisisanordinarylongidentifier_name stays", None, None, 0, 0, "", "", "", 0) for i, p in enumerate(planted)],
        *[(7200 + i, f"token={mixed(30)} the identifier_of_something and another_ordinary_identifier remain", None, None, 0, 0, "", "", "", 0) for i in range(20)],
    ]
    found = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, data)).collect()}
    assert len(found) == len(data)
    for r in data:
        want = brute_secrets(r[1])
        assert [(s.start, s.rank, s.end) for s in found[r[0]].base_found] == [w[:3] for w in want]
        extra = [s for s in found[r[0]].found if s.rank == 3]
        assert [s for s in found[r[0]].found if s.rank != 3] == found[r[0]].base_found
        assert all(s.end <= w[0] or w[2] <= s.start for s in extra for w in want)
    for i, p in enumerate(planted):
        text = data[len(rows()) + 3 + i][1]
        assert [(text[s.start : s.end]) for s in found[7100 + i].found] == [p]
    clash = docs(spark, data).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(("found", "n_hex", "_t", "_tokens", "BASE_FOUND", "_hex"))])
    kept = secrets.redact_secrets(clash)
    assert kept.columns == clash.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple(range(6))}
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs(spark, data)).collect()}
    assert clean[7100] == "my key [SECRET] is here, thisisanordinarylongidentifier_name stays"
    assert clean[7001].startswith("[SECRET]z[SECRET] AKIAAKIAAKIA12 [SECRET]")
    assert secrets.redact_secrets(docs(spark, data)).columns == docs(spark).columns
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_secret_rates_on_held_out_tokens(spark):
    """Values of base spans are found, ordinary tokens with digits or without are not, in documents that trained nothing."""
    from captionlake.llm.secrets import held_out_rates

    rng = random.Random(7)
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    words = ["river", "stone", "house", "market", "winter", "garden", "letter", "people", "number", "system", "window", "summer"]
    data = [(i, f"token = {mixed(32)} and the {rng.choice(words)}_{rng.choice(words)}_{rng.choice(words)}_{rng.choice(words)} of {rng.choice(words)}{i} at {rng.choice(words)}", None, None, 0, 0, "", "", "", 0) for i in range(300)]
    got = {r.random: (r.tokens, r.found) for r in held_out_rates(docs(spark, data)).collect()}
    assert got[1][0] > 40 and got[1][1] >= 0.95 * got[1][0] and got[0][0] > 30 and got[0][1] <= 0.05 * got[0][0]


def brute_ratios(texts):
    """Log-likelihood ratios of pairs of characters, from the definition: pairs of labelled tokens, backed by single characters."""
    from captionlake.llm import secrets as s

    size, place = len(s.ALPHABET), {c: i for i, c in enumerate(s.ALPHABET)}
    counts, labelled = np.zeros((2, size, size)), Counter()
    assign = re.compile(s.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "(?:%s)" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))))
    for text in texts:
        tokens = [(1, m[1]) for m in assign.finditer(text) if len(m[1]) >= 8] + [(1, m[0]) for m in re.finditer(s.ACCESS, text) if len(m[0]) >= 16] + [(1, m) for m in re.findall("[0-9a-f]{32,}", text)]
        rest = re.sub("[0-9a-f]{32,}", " ", re.sub(s.ACCESS, " ", assign.sub(" ", text)))
        labelled.update(tokens + [(0, t) for t in re.findall(s.TOKEN, rest)])
    for (kind, token), n in labelled.items():
        if kind or n > 1 or len(token) < s.TOKEN_CHARS or not re.search("[0-9]", token):
            for a, b in zip(token, token[1:], strict=False):
                if a in place and b in place:
                    counts[kind, place[a], place[b]] += n
    models = []
    for c in counts:
        single = 1 + c.sum(axis=0)
        models.append((c + s.BACKING * single / single.sum()) / (c.sum(axis=1, keepdims=True) + s.BACKING))
    return np.log(models[1]) - np.log(models[0])


def test_markov_spans_against_brute_force(spark):
    from captionlake.llm import secrets

    rng = random.Random(11)
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    words = ["river", "stone", "house", "Market", "winter", "garden", "letter", "people", "number12", "system"]
    name = lambda: rng.choice(["_", "", "-"]).join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    texts = [f"{name()} {name()} token={mixed(rng.randint(8, 40))}, {name()} {mixed(rng.randint(6, 40))} é {name()}={mixed(12)} /{name()}/" for _ in range(200)]
    data = [(i, t, None, None, 0, 0, "", "", "", 0) for i, t in enumerate(texts)]
    want = brute_ratios(texts)
    got = np.array(secrets.train(docs(spark, data).select("doc_id", "text"))).reshape(want.shape)
    assert np.abs(got - want).max() < 1e-5
    place = {c: i for i, c in enumerate(secrets.ALPHABET)}
    found = {r.doc_id: [(m.start, m.end) for m in r.found if m.rank == 3] for r in secrets.scan_secrets(docs(spark, data)).collect()}
    added = 0
    for i, text in enumerate(texts):
        base = [(a, b) for a, _, b, *_ in brute_secrets(text)]
        score = lambda t: sum(want[place[a], place[b]] for a, b in zip(t, t[1:], strict=False))
        spans = [m.span() for m in re.finditer(secrets.TOKEN, text) if len(m[0]) >= secrets.TOKEN_CHARS and score(m[0]) > secrets.THRESHOLD and all(m.end() <= a or b <= m.start() for a, b in base)]
        assert found[i] == spans
        added += len(spans)
    assert added > 100


def test_planted_secrets_by_length(spark):
    """Strings that no base pattern finds, and ordinary tokens of the same lengths with underscores, capitals and numbers."""
    from captionlake.llm import secrets

    rng = random.Random(12)
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    syllables = ["ri", "ver", "sto", "ne", "hou", "se", "mar", "ket", "win", "ter", "gar", "den", "let", "peo", "ple", "num", "ber", "sys", "tem", "sum"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    data = [(i, " ".join(word() for _ in range(60)) + f" v{i} token = {mixed(32)} {word()}{i}", None, None, 0, 0, "", "", "", 0) for i in range(300)]
    table = docs(spark, data).select("doc_id", "text")
    ratios = secrets.train(table)
    got = {(n, r.random): (r.tokens, r.found) for n in (16, 20) for r in secrets.rates(secrets.planted_tokens(table, [n]), ratios).collect()}
    assert got[16, 1][1] >= 0.95 * got[16, 1][0] and got[20, 1][1] >= 0.97 * got[20, 1][0] and got[16, 1][0] == 300
    assert got[16, 0][1] <= 0.05 * got[16, 0][0] and got[20, 0][1] <= 0.05 * got[20, 0][0] and got[16, 0][0] > 300  # of 300 texts of 60 words


# --- 10 ------------------------------------------------------------------------------------------------------------


def brute_components(data, k, percent):
    sets = {}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for d, t in data:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "pivots"), [(5, 75, 8), (2, 40, 1)])
def test_jaccard_join(spark, monkeypatch, k, percent, pivots):
    from captionlake.llm import jaccard

    monkeypatch.setattr(jaccard, "FIRST_PIVOTS", pivots)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs(spark), k, percent).collect()}
    assert got == brute_components(PLAIN, k, percent)
    assert len({v[1] for v in got.values()}) < len(got) - 5


def test_jaccard_join_edge_tables(spark):
    from captionlake.llm.jaccard import jaccard_join

    assert jaccard_join(empty(spark)).count() == 0
    data = [(4, "A b c d e f", None, None, 0, 0, "", "", "", 0)] * 2 + [(None, "a B c d e f", None, None, 0, 0, "", "", "", 0), (2, "a b C d e f", None, None, 0, 0, "", "", "", 0)]
    assert {r.component_id for r in jaccard_join(docs(spark, data)).collect()} == {2}
    text = " ".join(f"w{i}" for i in range(40))
    near, other = text.replace("w3 ", "x "), " ".join(f"v{i}" for i in range(40))
    # one id on different texts, and equal rows: each text is a point of its own
    data = [(d, t, None, None, 0, 0, "", "", "", 0) for d, t in [(7, text), (7, other), (5, near), (5, near), (9, other)]]
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join(docs(spark, data)).collect()) == [(5, 5), (5, 5), (7, 5), (7, 7), (9, 7)]


def brute_set_components(sets, percent):
    top = {d: d for d in sets}
    for a in sorted(sets):
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                lo, hi = sorted((top[a], top[b]))
                top = {d: lo if t == hi else t for d, t in top.items()}
    return top


def linked(spark, sets, percent):
    from captionlake.llm.jaccard import link_components

    table = spark.createDataFrame([(d, len(s), sorted(s)) for d, s in sets.items()], "node long, n long, set array<long>")
    comps = link_components(table, percent)
    return {d: d for d in sets} | ({r.node: r.component for r in comps.collect()} if comps is not None else {})


def test_jaccard_join_borders_of_two_levels(spark):
    """2 and 3 link; by size 3 borders the ring of 2, and by distance to the pivot 1 it is 2 that borders the ring of 3."""
    common, shared = {*range(66)}, {*range(100, 122)}
    sets = {1: common | {66} | {*range(200, 233)}, 2: common | {66} | shared | {*range(300, 311)}, 3: common | shared | {*range(400, 411)}}
    assert linked(spark, sets, 75) == brute_set_components(sets, 75) == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize(("replicas", "percent", "seed"), [(2, 75, 11), (3, 60, 12)])
def test_jaccard_join_passages(spark, monkeypatch, replicas, percent, seed):
    """Sets built from shared passages, with so few pivots that regions recurse, whole or in cells."""
    from captionlake.llm import jaccard

    monkeypatch.setattr(jaccard, "FIRST_PIVOTS", 3)
    monkeypatch.setattr(jaccard, "MOST_PIVOTS", 9)
    monkeypatch.setattr(jaccard, "CELL_PIVOTS", 2)
    monkeypatch.setattr(jaccard, "REPLICAS", replicas)
    rng = random.Random(seed)
    sets = {}
    for d in range(70):
        passages = rng.sample(range(8), rng.randint(3, 5))
        sets[d] = {20 * p + i for p in passages for i in range(20) if rng.random() < 0.97} | {1000 * d + 1000 + i for i in range(rng.randint(0, 9))}
    got = linked(spark, sets, percent)
    assert got == brute_set_components(sets, percent)
    assert 3 < len({*got.values()}) <= 70


def test_jaccard_join_large_group(spark):
    """200 near copies of one text, each with an edit or a few, some of them out of reach of the original."""
    rng = random.Random(6)
    base = [*range(160)]
    sets = {}
    for d in range(200):
        out = {c + j for c in [rng.randrange(156) for _ in range(rng.randint(1, 6))] for j in range(5)}
        sets[d] = {*base} - out | {1000 + 7 * rng.randrange(60) + i for i in range(rng.randint(0, len(out)))}
    got = linked(spark, sets, 75)
    assert got == brute_set_components(sets, 75)


def test_components(spark):
    from captionlake.llm.components import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (103, 110), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100, 110: 100}


def test_components_by_small_plans(spark, monkeypatch):
    """Random graphs, a long path and a hub, in any order of nodes; no plan reads its input more than twice, as the driver holds many."""
    from captionlake.llm import components as c

    reads = []

    def kept(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return materialize(df)

    materialize = c.materialize
    monkeypatch.setattr(c, "materialize", kept)
    rng = random.Random(8)
    names = rng.sample(range(-500, 500), 400)
    edges = [(rng.choice(names[:150]), rng.choice(names[:150])) for _ in range(90)] + [(names[200], n) for n in names[201:280]] + [*zip(names[280:-1], names[281:], strict=True)]
    top = {n: n for e in edges if e[0] != e[1] for n in e}
    for u, v in edges:
        if u != v and top[u] != top[v]:
            lo, hi = sorted((top[u], top[v]))
            top = {d: lo if t == hi else t for d, t in top.items()}
    got = [(r.node, r.component) for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert sorted(got) == sorted(top.items()) and len({*top.values()}) > 5
    assert len(reads) > 4 and max(reads) <= 2


def test_jaccard_join_pairs_meet_in_few_regions(spark, monkeypatch):
    """Mutually distant near copies share many regions; two sets are not compared in each of these."""
    from captionlake.llm import jaccard

    compared = []

    def kept(df):
        out = materialize(df)
        if {"pivot", "center"} <= {*df.columns} and "m" not in df.columns:
            compared.append(out.count())
        return out

    materialize = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", kept)
    rng = random.Random(4)
    sets = {d: {c for c in range(240) if rng.random() < 0.75} for d in range(24)}
    assert linked(spark, sets, 75) == brute_set_components(sets, 75)
    assert sum(compared) <= 3 * 24 * 23 / 2
