"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the pairs of neighbours are looked up by binary search among
the sorted keys of all merges, the lowest rank of each word is found, and all its pairs of that rank are merged from the left; words
without a pair to merge leave the array. Each task does this for the distinct words of its batches.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_WORDS = 200_000
# The white space that the vocabulary's own patterns know (Unicode White_Space).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary as arrays: symbols of bytes, sorted pair keys, their ranks and what they make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = dict(vocab) | self.special
        self.size = max(names.values()) + 1
        self.token = [""] * self.size
        for name, i in names.items():
            self.token[i] = name
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars])
        self.last = np.array([vocab[c + suffix] for c in chars])
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges])
        made = np.array([vocab[a + b] for a, b in merges])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def pieces(self, text: str) -> list[str | int]:
        """Words (byte strings come later) and ids of special tokens of a text without single spaces."""
        out: list[str | int] = []
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            # each character becomes lower case by itself: a sigma at a word's end is no exception
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        else:
            text = text.lower()
        return _PIECES.findall(text)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by merge rounds over all words together."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_symbols, done_word = [], []
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(found, self.rank[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(word)))
            least = np.repeat(least, counts)
            active = least < none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_word.append(word[~active])
            hit = (rank == least) & active
            # of hits in a row (one symbol repeated) every second is merged, from the left
            place = np.arange(len(hit))
            lead = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - lead) % 2 == 0
            taken = np.append(False, hit[:-1])
            symbols = np.where(hit, self.made[np.append(at, 0)], symbols)
            keep = active & ~taken
            symbols, word = symbols[keep], word[keep]
        done_symbols.append(symbols)
        done_word.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        edges = np.searchsorted(word[order], np.arange(1, len(words)))
        return np.split(symbols[order], edges)


class BatchCoder:
    """Ids and decoded text of whole texts; what stands between single spaces or line feeds is encoded once while it is kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def _learn(self, parts: list[str]) -> None:
        pieces = [self.vocabulary.pieces(p) for p in parts]
        words = list(dict.fromkeys(w for ps in pieces for w in ps if isinstance(w, str)))
        ids = dict(zip(words, self.vocabulary.encode_words([w.encode() for w in words]), strict=True))
        token = self.vocabulary.token
        for part, ps in zip(parts, pieces, strict=True):
            own = [i for p in ps for i in (ids[p].tolist() if isinstance(p, str) else [p])]
            self.known[part] = (len(own), " ".join(map(str, own)).encode(), " ".join([token[i] for i in own]).encode())

    def code(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: number of ids, the decimal ids joined by a space, the decoded text (tokens joined by a space)."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        missing: set[str] = set()
        for parts in split:
            missing.update(set(parts).difference(known))
        self._learn(list(missing))
        for parts in split:
            sizes, ids, decoded = zip(*map(known.__getitem__, parts), strict=True)
            yield sum(sizes), b" ".join(filter(None, ids)), b" ".join(filter(None, decoded))


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> BatchCoder:
    """A worker's coder: its words stay known from one task to the next."""
    return BatchCoder(Vocabulary(path))


def _coding_job(path: str, with_text: bool):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            text = batch.column("text")
            for lo in range(0, batch.num_rows, 200):
                texts = [t or "" for t in text.slice(lo, 200).to_pylist()]
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for n, ids, decoded in coder.code(texts):
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    if with_text:
                        out["ids"].append([int(i) for i in ids.split()])
                        out["decoded"].append(decoded.decode())
                names = list(out)[: 5 if with_text else 3]
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                arrays = [pa.array(out[k], kinds.get(k, pa.string())) for k in names]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 200), *arrays], names=["doc_id", *names])

    return job


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Ids of every whole text and the text decoded from them.

    Cases: null and empty texts have no ids and decode to the empty text; special tokens' strings in a text are those tokens;
    a word longer than a batch is still one word; repeated rows and ids are coded one by one; an empty table gives no rows;
    other columns are ignored.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_text, ids and decoded.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    return slim.mapInArrow(_coding_job(path or vocabulary_path(), with_text), schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
