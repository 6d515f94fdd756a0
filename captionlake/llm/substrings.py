"""Substring dedup: removes word windows that a document with a smaller id already has, by prefix-partitioned suffix trees.

Which suffixes. The anchor of a window of WINDOW words is the GRAM-word piece with the least hash in it (leftmost of equals). Equal
windows have equal anchors at equal places, so only suffixes that start at an anchor need a tree (about 2 per WINDOW - GRAM
words), and only those whose anchor occurs in more than one document. A suffix comes with the segment of text that its
windows cover: at most WINDOW words to the right and WINDOW - GRAM to the left. Equal segments are merged before they meet, so
copies never gather in one group.

Partition by prefix. Suffixes are partitioned by their first GRAM words. Where more than PREFIX_SEGMENTS segments share a prefix it
is lengthened: the windows are halved by where they begin, and each half is filed under the longest words that all its
windows contain, a prefix of GRAM + (WINDOW - GRAM) / 2 words of the suffix that starts at the half's last window, and so on until
the prefixes are short of neither memory nor words: a prefix of WINDOW words is one node by itself, a grouped minimum.

Trees. A memory-sized group of prefixes builds, for each prefix, the tree of the suffixes and the tree of the reversed words before
them, both as a sorted array with longest common prefixes; a node of depth d is a run of neighbours that share d words. A
window that begins o words before its anchor is repeated where leaves are together below a node of depth WINDOW - o of the first
tree and one of depth o of the second: the deep internal nodes. The least document below owns the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.bytewords import Chunk, chunks, mix, row_of, shingle_hashes
from captionlake.llm.tables import discard, materialize

WINDOW = 50
GRAM = 10
#: Segments in one tree group, and segments below one prefix from which it is lengthened.
GROUP_SEGMENTS = 1_000
PREFIX_SEGMENTS = 250
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(chunk: Chunk, window: int) -> tuple[np.ndarray, ...]:
    """Per run of windows with one anchor: row, anchor hash, first and last window start, anchor (word indices of the
    chunk); then the words' starts and ends and each row's first word."""
    gram = min(GRAM, window)
    start, end, first = chunk.words()
    grams = shingle_hashes(chunk.hashes(start, end), gram)
    width = window - gram + 1
    n = len(start) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none, start, end, first
    place = np.arange(len(grams), dtype=np.uint64) & _PLACE
    at = _sliding_min((grams & ~_PLACE) | place, width) & _PLACE
    begins = np.arange(n, dtype=np.int64)
    row = row_of(first)
    whole = row[:n] == row[window - 1 :]
    # the low bits of a position say how far behind the window's start its anchor lies
    anchor = begins + ((at - begins.astype(np.uint64)) & _PLACE).astype(np.int64)
    begins, anchor = begins[whole], anchor[whole]
    new = np.ones(len(begins), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (begins[1:] != begins[:-1] + 1) | (row[begins[1:]] != row[begins[:-1]])
    lead = np.flatnonzero(new)
    tail = np.append(lead[1:], len(begins)) - 1
    a = begins[lead] if len(lead) else begins[:0]
    b = begins[tail] if len(lead) else begins[:0]
    return row[a], grams[anchor[lead]], a, b, anchor[lead], start, end, first


def _emit_anchors(window: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for c in chunks(batch.column("text")):
                row, h, *_ = anchors(c, window)
                key = np.unique(np.rec.fromarrays([row, h.view(np.int64)])) if len(row) else None
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c.lo + key.f0]), pa.array(key.f1)], names=["doc_id", "h"])

    return job


def _emit_segments(window: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0xA24BAED4963EE407)
        blank = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("hs")
            known = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            many = lists.value_lengths().to_numpy(zero_copy_only=False)
            known = mix(known + np.repeat(np.arange(len(many)), many).astype(np.uint64) * salt)
            for c in chunks(batch.column("text")):
                row, h, a, b, anchor, start, end, first = anchors(c, window)
                at = np.flatnonzero(np.isin(mix(h + (row + c.lo).astype(np.uint64) * salt), known))
                if not len(at):
                    continue
                raw = c.data.tobytes().translate(blank)
                lo, hi = start[a[at]], end[b[at] + window - 1]
                step = 20_000  # rows a batch: long texts give their segments in several
                for i in range(0, len(at), step):
                    j = at[i : i + step]
                    seg = [raw[x:y] for x, y in zip(lo[i : i + step].tolist(), hi[i : i + step].tolist(), strict=True)]
                    columns = [pa.array(x) for x in (h[j].view(np.int64), ids[c.lo + row[j]], a[j] - first[row[j]], anchor[j] - a[j])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(seg, pa.binary())], names=["h", "doc_id", "a", "anchor", "seg"])

    return job


def _runs(row: np.ndarray, off: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of a row with one owner as (row, first offset, count, owner)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return row[at], off[at], np.diff(np.append(at, len(row))), owner[at]


def sorted_suffixes(prefix: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of rows of words below their prefixes: the order, and what each shares with the one before it (-1: not even the prefix)."""
    order = np.lexsort([*words.T[::-1], prefix])
    same = words[order][1:] == words[order][:-1]
    shared = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1)) if words.shape[1] else np.zeros(len(same), np.int64)
    return order, np.append(-1, np.where(prefix[order][1:] == prefix[order][:-1], shared, -1))


def nodes_at(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """The node of each leaf at a depth: neighbours that share so many words are below the same one."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(shared < depth)
    return node


def window_owners(prefix: np.ndarray, words: np.ndarray, first: np.ndarray, anchor: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window start in it, least owner of an equal window) for every window of all segments, in order.

    Segment i has words[first[i] : first[i + 1]] and its suffix starts at anchor[i] in it; prefix[i] is a number for its prefix.
    """
    many = np.diff(first)
    behind, ahead = anchor, many - anchor  # words before the suffix and in it
    code = np.append(np.unique(words, return_inverse=True)[1] + 1, 0)  # 0: past the segment's end
    place = lambda at, inside: np.where(inside, (first[:-1] + anchor)[:, None] + at, len(words))
    right = np.arange(min(window, int(ahead.max())))[None, :]
    left = np.arange(1, int(behind.max()) + 1)[None, :]
    forward = sorted_suffixes(prefix, code[place(right, right < ahead[:, None])])
    backward = sorted_suffixes(prefix, code[place(-left, left <= behind[:, None])])
    rows, starts, owners = [], [], []
    for o in range(int(behind.max()) + 1):
        at = np.flatnonzero((o <= behind) & (window - o <= ahead))
        if len(at):
            node = nodes_at(*forward, window - o)[at] * len(many) + nodes_at(*backward, o)[at]
            _, below = np.unique(node, return_inverse=True)
            least = np.full(below.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, below, owner[at])
            rows.append(at)
            starts.append(anchor[at] - o)
            owners.append(least[below])
    row, start, own = (np.concatenate(x) if rows else np.zeros(0, np.int64) for x in (rows, starts, owners))
    order = np.lexsort((start, row))
    return row[order], start[order], own[order]


def _tree(window: int):
    def job(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("seg").combine_chunks().cast(pa.large_binary()).cast(pa.large_string())
        hashed, counts = [], []
        for c in chunks(column):
            start, end, first = c.words()
            hashed.append(c.hashes(start, end))
            counts.append(np.diff(first))
        first = np.append(0, np.cumsum(np.concatenate(counts)))
        prefix, anchor, owner, skip = (table.column(n).to_numpy() for n in ("prefix", "anchor", "first_doc", "skip"))
        row, start, own = window_owners(prefix, np.concatenate(hashed), first, anchor, owner, window)
        at, off, many, own = _runs(row, start, own)
        columns = {"k1": table.column("k1").to_numpy()[at], "k2": table.column("k2").to_numpy()[at], "off": off + skip[at], "len": many, "owner": own}
        return pa.table(columns)

    return job


def _lengthen(window: int):
    """Each segment once for each half of its windows, with the words of those windows only and their longer prefix."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, owner, anchors_, lows, highs, skips = (batch.column(n).to_numpy() for n in ("k1", "k2", "first_doc", "anchor", "low", "high", "skip"))
            for c in chunks(batch.column("seg").cast(pa.large_binary()).cast(pa.large_string())):
                start, end, first = c.words()
                words, many, raw = c.hashes(start, end), np.diff(first), c.data.tobytes()
                anchor, low, high = (x[c.lo : c.lo + c.rows] for x in (anchors_, lows, highs))
                least, most = anchor - (many - window), anchor  # a segment's windows begin so many words before its anchor
                for l, h in {*zip(low.tolist(), high.tolist(), strict=True)}:
                    middle = (l + h) // 2
                    for a, b in ((l, middle), (middle + 1, h)):
                        at = np.flatnonzero((low == l) & (high == h) & (most >= a) & (least <= b))
                        if not len(at):
                            continue
                        length = window - (b - a)
                        begin = first[at] + anchor[at] - a
                        salt = np.uint64(a * (window + 1) + b)
                        pre = [mix(shingle_hashes(x, length)[begin] + salt).view(np.int64) for x in (words, mix(words ^ np.uint64(0x5851F42D4C957F2D)))]
                        lead = np.minimum(most[at], b)  # words before the anchor that stay
                        lo, hi = first[at] + anchor[at] - lead, first[at] + anchor[at] - np.maximum(least[at], a) + window
                        seg = [raw[x:y] for x, y in zip(start[lo].tolist(), end[hi - 1].tolist(), strict=True)]
                        row = c.lo + at
                        columns = [*pre, k1[row], k2[row], owner[row], lead, np.full(len(at), a), np.full(len(at), b), skips[row] + anchor[at] - lead]
                        names = ["prefix", "second", "k1", "k2", "first_doc", "anchor", "low", "high", "skip", "seg"]
                        yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in columns], pa.array(seg, pa.binary())], names=names)

    return job


def _strip(window: int, with_text: bool):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
                for text, cuts in zip(part.column("text"), part.column("cuts"), strict=True):
                    words = (text.as_py() or "").encode().split()
                    n = len(words)
                    if cuts := cuts.as_py():
                        edge = np.zeros(n + 1, np.int64)
                        pairs = np.array([(x["start"], x["start"] + x["len"] + window - 1) for x in cuts])
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, np.minimum(pairs[:, 1], n), -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                    body = b" ".join(words)
                    out["n_words"].append(n)
                    out["n_removed"].append(n - len(words))
                    out["kept_sha256"].append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        out["kept"].append(body.decode())
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
                arrays = [pa.array(x, t) for x, t in zip(out.values(), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *list(out)[: 3 + with_text]])

    return job


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs (doc_id, start, len) of window starts whose words also start a window in a document of smaller id."""
    found = materialize(docs.where("doc_id IS NOT NULL").mapInArrow(_emit_anchors(window), "doc_id long, h long"))
    shared = materialize(found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"))
    lists = found.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    segments = docs.join(lists, "doc_id").select("doc_id", "text", "hs").mapInArrow(_emit_segments(window), "h long, doc_id long, a long, anchor long, seg binary")
    segments = segments.withColumn("k1", F.xxhash64("h", "seg")).withColumn("k2", F.xxhash64(F.lit(1), "seg"))
    segments = materialize(segments)
    discard(found, shared)
    merged = segments.groupBy("h", "k1", "k2", "seg").agg(F.min("doc_id").alias("first_doc"), F.min("anchor").alias("anchor"))
    whole = lambda n: F.lit(n).cast("long")
    names = ["prefix", "second", "k1", "k2", "first_doc", "anchor", "low", "high", "skip", "seg"]
    rows = merged.withColumnsRenamed({"h": "prefix"}).withColumns({"second": whole(0), "low": whole(0), "high": whole(window - min(GRAM, window)), "skip": whole(0)})
    rows, small, held, width = materialize(rows.select(names)), None, [], window - min(GRAM, window) + 1
    result = "k1 long, k2 long, off long, len long, owner long"
    while True:
        held.append(rows)
        if width == 1:  # the prefixes are whole windows
            nodes = rows.groupBy("prefix", "second").agg(F.min("first_doc").alias("owner"))
            deep = rows.select("prefix", "second", "k1", "k2", "skip").join(nodes, ["prefix", "second"]).select("k1", "k2", F.col("skip").alias("off"), whole(1).alias("len"), "owner")
            break
        hot = materialize(rows.groupBy("prefix").count().where(F.col("count") > PREFIX_SEGMENTS).select("prefix"))
        part = rows.join(hot, "prefix", "left_anti")
        small = part if small is None else small.unionByName(part)
        if hot.isEmpty():
            deep = None
            break
        longer = rows.join(hot, "prefix", "left_semi").select(names).mapInArrow(_lengthen(window), rows.schema)
        rows, width = materialize(longer), -(-width // 2)
        held.append(hot)
    if small is None:
        owners = deep
    else:
        groups = max(1, -(-small.count() // GROUP_SEGMENTS))
        trees = small.withColumn("grp", F.pmod(F.xxhash64("prefix"), F.lit(groups))).groupBy("grp").applyInArrow(_tree(window), result)
        owners = trees if deep is None else trees.unionByName(deep)
    owners = materialize(owners)
    discard(*held)
    # a window found in more than one run of a document is harmless: cuts are merged where they are applied
    return (
        segments.select("doc_id", "a", "k1", "k2").join(owners, ["k1", "k2"]).where("owner < doc_id")
        .select("doc_id", (F.col("a") + F.col("off")).alias("start"), "len")
    )


def drop_repeated_windows(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Each document without the words covered by windows that a document of smaller id also has.

    Cases: a null or empty text has no words; texts shorter than a window lose nothing; rows without an id are kept
    whole and own nothing; rows that share an id count as parts of one document and never take words from each
    other; equal rows are equal copies; a very long text is cut into segments like others, and is one task's work in itself only;
    an empty table gives no rows; other columns are ignored, whatever their names.

    Returns doc_id, n_words, n_removed, kept_sha256 and, unless with_text is false, kept (the kept words joined by one space).
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = repeated_windows(slim, window).groupBy("doc_id").agg(F.collect_set(F.struct("start", "len")).alias("cuts"))
    return slim.join(cuts, "doc_id", "left").mapInArrow(
        _strip(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents after substring dedup."""
    return drop_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
