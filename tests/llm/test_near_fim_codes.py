"""MinHash dedup, fill-in-middle and vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import docs, empty, rows
from tests.llm.test_operators import PLAIN, brute_components, brute_set_components, sha

# --- 11 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "percent", "bands", "band_rows"), [(5, 85, 25, 5), (2, 60, 60, 2)])
def test_minhash_dedup(spark, k, percent, bands, band_rows):
    from captionlake.llm.minhash import minhash_dedup

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(docs(spark), k, percent, bands, band_rows).collect()}
    want = brute_components(PLAIN, k, percent)
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}
    assert len({v[1] for v in got.values()}) <= len(got) - 5


def test_minhash_edge_tables(spark):
    from captionlake.llm.minhash import minhash_dedup

    assert minhash_dedup(empty(spark)).count() == 0
    alone = [(1, None, None, None, 0, 0, "", "", "", 0), (2, "", None, None, 0, 0, "", "", "", 0), (3, " \n", None, None, 0, 0, "", "", "", 0)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(docs(spark, alone)).collect()) == [(d, 0, d, True) for d in (1, 2, 3)]
    text = " ".join(f"w{i}" for i in range(80))
    near, other = text.replace("w3 ", "x "), " ".join(f"v{i}" for i in range(40))
    # one id on different texts, equal rows, rows without an id: each text is a node of its own
    data = [(d, t, None, None, 0, 0, "", "", "", 0) for d, t in [(7, text), (7, other), (5, near), (5, near), (9, other.upper()), (None, text), (None, "only here so far")]]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup(docs(spark, data)).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (7, 7, True), (9, 7, False), (None, 5, None), (None, None, None)]


def texts_of(sets):
    """Texts whose sets of single words are the given sets."""
    return [(d, " ".join(f"t{x}" for x in sorted(s)), None, None, 0, 0, "", "", "", 0) for d, s in sets.items()]


def near_group(rng, n, size=150):
    """Near copies of one text, many of them out of reach of it and of each other."""
    sets = {}
    for d in range(n):
        out = {c + j for c in rng.sample(range(size - 5), rng.choice([1, 2, 4, 8])) for j in range(3)}
        sets[d] = {*range(size)} - out | {1000 + 100 * d + i for i in range(len(out))}
    return sets


@pytest.mark.parametrize(("first", "most", "dealt"), [(256, 1000, 20_000), (1, 3, 7)])
def test_minhash_large_group(spark, monkeypatch, first, most, dealt):
    """Buckets that take several rounds of pivots, dealt over several tasks."""
    from captionlake.llm import minhash

    monkeypatch.setattr(minhash, "FIRST_PIVOTS", first)
    monkeypatch.setattr(minhash, "MOST_PIVOTS", most)
    monkeypatch.setattr(minhash, "BUCKET_ROWS", dealt)
    sets = near_group(random.Random(first), 60 if first == 1 else 150)
    got = {r.doc_id: r.component_id for r in minhash.minhash_dedup(docs(spark, texts_of(sets)), k=1).collect()}
    assert got == brute_set_components(sets, 85)
    assert 3 < len({*got.values()}) < len(got)


@pytest.mark.parametrize("size", [12, 150, 3000, 20_000])
def test_sketches_keep_links_and_drop_most_others(size):
    """Of 200 pairs just above the threshold none is lost, and of pairs at 0.7 few are kept."""
    from captionlake.llm.bytewords import mix
    from captionlake.llm.minhash import _maybe, odd_sketches

    rng = np.random.default_rng(size)
    kept = {}
    for aim in (0.85, 0.7):
        a, b = [], []
        for _ in range(200 if size < 5000 else 30):
            common = math.ceil(size * 2 * aim / (1 + aim)) if aim == 0.85 else math.floor(size * 2 * aim / (1 + aim))
            h = mix(rng.integers(0, 1 << 63, 2 * size - common).astype(np.uint64))
            a.append(np.sort(h[:size]))
            b.append(np.sort(np.concatenate([h[:common], h[size:]])))
        s, t = (np.ascontiguousarray(odd_sketches(np.append(0, np.cumsum([len(x) for x in side])), np.concatenate(side))).view(np.uint64) for side in (a, b))
        n = np.array([size] * len(a))
        kept[aim] = _maybe(n, n, s, t, 85).mean()
    assert kept[0.85] == 1.0
    assert kept[0.7] < {12: 1.01, 150: 0.05, 3000: 0.05, 20_000: 0.3}[size]  # in very large sets the parities are close to even


def test_bands_meet_as_often_as_they_should():
    from captionlake.llm.bytewords import mix
    from captionlake.llm.minhash import band_keys

    rng = np.random.default_rng(3)
    same = []
    for _ in range(150):
        h = mix(rng.integers(0, 1 << 63, 260).astype(np.uint64))
        a, b = np.sort(h[:230]), np.sort(h[30:])  # 200 of 260: 0.769
        keys = band_keys(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
        same.append((keys[0] == keys[1]).mean())
    assert np.mean(same) == pytest.approx((200 / 260) ** 5, abs=0.04)


# --- 12 ------------------------------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_infilling(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


MARKED = [(i, t, None, None, 0, 0, "", "", "", 0) for i, t in enumerate(["a <P> b", "<M>", "x<S", "<P", "<", "<M <S b> <P", "a  ", "  ", " a", "ü é\n", "\x85  x", "w " * 9000 + "<M>"] * 12)]


@pytest.mark.parametrize("size", [1, 7, 2048])
def test_fill_in_middle(spark, size):
    from captionlake.llm.infilling import fill_in_middle_digests

    data = rows() + [(1000 + r[0], *r[1:]) for r in MARKED if size > 1 or len(r[1]) < 100]
    got = {r.doc_id: r for r in fill_in_middle_digests(docs(spark, data), piece_units=size, partitions=5).collect()}
    forms = Counter()
    for d, t, *_ in data:
        n, form, prefix, middle, output = brute_infilling(d, t)
        assert tuple(got[d]) == (d, n, form, prefix, middle, sha(output), sha(t or ""))
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 3


def test_fill_in_middle_edge_tables(spark):
    """No rows; one row many times over; an id on different texts; rows without an id; ids of any size."""
    from captionlake.llm.infilling import fill_in_middle_digests

    assert fill_in_middle_digests(empty(spark)).count() == 0
    texts = [(8, "a b c d e f g"), (8, "h i"), (None, "j k l"), (None, "j k l"), (-(1 << 63), "m n"), ((1 << 63) - 1, "o p q")] + [(8, "a b c d e f g")] * 40
    data = [(d, t, None, None, 0, 0, "", "", "", 0) for d, t in texts]
    want = Counter()
    for d, t in texts:
        n, form, prefix, middle, output = brute_infilling(d, t)
        want[(d, n, form, prefix, middle, sha(output), sha(t))] += 1
    assert Counter(map(tuple, fill_in_middle_digests(docs(spark, data), piece_units=2).collect())) == want


def test_fill_in_middle_texts_and_back(spark):
    from captionlake.llm.infilling import fill_in_middle, restore_documents, restore_text

    data = rows() + [(1000 + r[0], *r[1:]) for r in MARKED]
    before = docs(spark, data).withColumn("form", F.lit("clash"))
    out = fill_in_middle(before)
    assert out.columns == [c for c in before.columns if c != "form"] + ["form"]
    texts = {r[0]: r[1] for r in data}
    for r in out.collect():
        _, form, _, _, output = brute_infilling(r.doc_id, texts[r.doc_id])
        assert (r.form, r.text) == (form, None if texts[r.doc_id] is None else output)
        assert restore_text(r.text or "", r.form) == (texts[r.doc_id] or "")
    assert {r.doc_id: r.text for r in restore_documents(out).collect()} == texts
    assert {r.form for r in fill_in_middle(docs(spark), rate=0).collect()} == {"plain"}


# --- 13 ------------------------------------------------------------------------------------------------------------


def brute_codes(vectors, parts=4, entries=256, rounds=4):
    """Every part against every entry, in Python's own numbers."""
    kept = [(i, label, [math.floor(1024 * c) for c in v]) for i, label, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][2]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0], kept[i][2]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def assign():
        away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return [[min((away(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = Counter()
    for (_, label, _), f in zip(kept, found, strict=True):
        errors[label] += sum(d for d, _ in f)
    digest = sha(",".join(str(v) for b in books for e in b for v in e))
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], digest) for (i, label, _), f in zip(kept, found, strict=True)), key=str)


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v, label, "x", 0, 0, 0) for i, label, v in vectors], "vec_id long, embedding array<float>, label int, code string, error int, x int, salt int").repartition(3)


@pytest.mark.parametrize(("entries", "seed", "scale"), [(256, 1, 1.0), (5, 2, 1.0), (7, 3, 30_000.0)])
def test_vector_codes(spark, entries, seed, scale):
    """Vectors in groups, with ties (half steps on a coarse grid) and copies; columns with the names of the result and of the job."""
    from captionlake.llm.vector_codes import compress_vectors

    rng = random.Random(seed)
    centers = [[rng.uniform(-scale, scale) for _ in range(8)] for _ in range(6)]
    vectors = []
    for i in range(120):
        c = rng.choice(centers)
        v = [float(np.float32(round(x + rng.uniform(-0.02, 0.02) * scale, 2))) for x in c] if i % 3 else [rng.randint(-4, 4) / 1024 * scale for _ in range(8)]
        vectors.append((rng.randint(-(10**12), 10**12), rng.choice([0, 1, None]), v))
    vectors += [(vectors[0][0], 1, vectors[0][2])] * 3 + [(5, 1, vectors[3][2])]
    vectors += [(1, 0, None), (2, 0, [None] + [0.0] * 7), (3, None, [math.nan] + [0.0] * 7), (4, 0, [0.0] * 7 + [math.inf]), (6, 1, [-math.inf] * 8)]
    got = compress_vectors(table_of(spark, vectors), entries=entries).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(vectors, entries=entries)


def test_vector_code_edge_tables(spark):
    from captionlake.llm.vector_codes import compress_vectors

    assert compress_vectors(table_of(spark, [])).count() == 0
    assert compress_vectors(table_of(spark, [(1, 0, None), (2, 0, [])])).count() == 0
    # other lengths than the first vector's go; a length of three parts and a bit is filled up with zeros; too large components go
    vectors = [(1, 0, [0.1, 0.2, 0.3, 0.4, 0.5]), (2, 0, [0.1] * 8), (3, 1, [0.2] * 5), (4, 1, [1e30] * 5), (None, None, [0.3] * 5)]
    want = brute_codes([(i, label, [*v, 0.0, 0.0, 0.0]) for i, label, v in [(1, 0, [float(np.float32(c)) for c in vectors[0][2]]), (3, 1, [float(np.float32(0.2))] * 5), (1 << 60, None, [float(np.float32(0.3))] * 5)]])
    got = sorted((tuple(r) for r in compress_vectors(table_of(spark, vectors)).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[1:] for r in got] == [r[1:] for r in sorted(want)] and [r[0] for r in got] == [1, 3, None]
    assert len({r.code for r in compress_vectors(table_of(spark, [(i, 0, [0.25] * 8) for i in range(300)])).collect()}) == 1


@pytest.mark.parametrize("scale", [40, 1 << 27])
def test_balls_equal_a_full_search(scale):
    """Entries with and without neighbours, stable cores, rings, ties and equal entries, in doubles and in longs."""
    from captionlake.llm.vector_codes import Balls, _squares

    rng = np.random.default_rng(scale)
    centers = rng.integers(-scale, scale, (12, 4))
    x = np.concatenate([centers[rng.integers(0, 12, 500)] + rng.integers(-scale // 8, scale // 8 + 1, (500, 4)), rng.integers(-scale, scale, (100, 4))])
    entries = np.concatenate([x[:40], x[:3]])
    full = np.array([[((p - e) ** 2).sum() for e in entries] for p in x])
    first, away = Balls(entries, None).assign(x, None)
    assert (first == full.argmin(1)).all() and (away == full.min(1)).all()
    moved = entries + rng.integers(-scale // 20, scale // 20 + 1, entries.shape)
    radii = np.array([math.isqrt(int(max([0, *_squares(x[first == i], np.repeat(entries[i : i + 1], (first == i).sum(), 0))]))) + 1 + math.isqrt(int(_squares(moved[i : i + 1], entries[i : i + 1])[0])) + 1 for i in range(len(entries))], object)
    full = np.array([[((p - e) ** 2).sum() for e in moved] for p in x])
    balls = Balls(moved, radii)
    again, away = balls.assign(x, first)
    assert (again == full.argmin(1)).all() and (away == full.min(1)).all()
    assert min(len(near) for near, _ in balls.near) < len(entries) - 1  # the search was not full


def test_partial_sums_of_entries():
    from captionlake.llm.vector_codes import _sum_job

    x, entry = np.array([[1, 2, 3, 4], [5, 6, 7, 8], [-1, 0, 2, 2]]), np.array([[0, 1], [2, 1], [0, 0]])
    lists = lambda a: pa.array(a.tolist(), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([lists(x), lists(entry), lists(entry * 3)], names=["x", "entry", "away"])
    (out,) = list(_sum_job(2, 3)(iter([batch])))
    assert out.to_pylist() == [
        {"part": 0, "entry": 0, "n": 2, "far": 0, "sums": ["0", "2"]}, {"part": 0, "entry": 2, "n": 1, "far": 6, "sums": ["5", "6"]},
        {"part": 1, "entry": 0, "n": 1, "far": 0, "sums": ["2", "2"]}, {"part": 1, "entry": 1, "n": 2, "far": 3, "sums": ["10", "12"]},
    ]
