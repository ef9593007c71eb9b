"""Byte-level BPE encoding and decoding with a pair occurrence index.

Encoding a batch: texts are cut at the added tokens and into pre-tokens; the distinct pre-tokens that the worker
has not met yet are laid out one after another in a single symbol array. The index maps every adjacent pair that has a
merge to all its positions. Active ranks are applied in ascending order, each at all its positions at once,
and the pairs that come about are entered in the lists of their ranks. Words never merge across their ends.
Each distinct pre-token is thus merged once (its ids are kept in a memo of bounded size), and a text's ids are
its pre-tokens' ids in turn.

The vocabulary file is a parameter: it is read by the path's bytes on the driver, checked against ``MAX_FILE``
and sent to the workers once, as a broadcast of constant size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memory import lean

#: Largest vocabulary file that is broadcast, in bytes.
MAX_FILE = 64 << 20
#: Distinct pre-tokens whose ids a worker keeps; beyond that it starts anew (results do not change).
MEMO = 500_000
#: Symbols whose pairs are entered in the index at a time.
NOTED = 1 << 19
#: The pre-tokenizer's pattern of the byte-level vocabularies (fixed value), white space spelled out below.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode White_Space (fixed values); Python's own \s also takes \x1c-\x1f.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(spec: dict) -> None:
    """ValueError for a vocabulary file that asks for anything this module does not do."""
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [x for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(x)]
    wrong += ["model"] if model.get("type", "BPE") != "BPE" else []
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += ["pre_tokenizer"] if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) else []
    wrong += ["decoder"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []
    wrong += [f"added token with {x}" for x in ("single_word", "lstrip", "rstrip") if any(t.get(x) for t in spec.get("added_tokens", []))]
    if wrong:
        raise ValueError(f"vocabulary file with unsupported {', '.join(wrong)}")


class Vocabulary:
    """Parsed vocabulary file of the tokenizers library (byte-level BPE without normalizer); ValueError for any other."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        refuse_others(spec)
        model, letters = spec["model"], _byte_letters()
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.bytes_of = [self._raw(by_id[i], letters) if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: by rank: the two ids and the id that they become
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        keys = np.array([a << 32 | b for a, b, _ in self.pairs], dtype=np.int64)
        self.keys, self.ranks = np.unique(keys, return_index=True)
        self.words = regex.compile(PATTERN.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]"))
        # the same for texts of Latin-1 without numerals that are no digits, where \w tells letters and digits apart; faster
        self.plain = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\w{SPACE}]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]"))
        found = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    @staticmethod
    def _raw(token: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()


def is_plain(text: str) -> bool:
    """Whether a text is Latin-1 without its six numerals that are no digits."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in "²³¹¼½¾")


def _sorted_once(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    return places[np.flatnonzero(np.diff(places, prepend=-1))]


class Encoder:
    """Encodes batches of texts; one for each worker process."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        #: pre-token -> its number; numbers are given as pre-tokens come
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        #: ids of all numbered pre-tokens one after another, and where each one's begin
        self.flat, self.begins = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another and how many each has, by the pair occurrence index."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        owner = np.repeat(np.arange(len(raws), dtype=np.int32), [len(r) for r in raws])
        symbols = self.v.byte_ids[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        edge = np.flatnonzero(owner[1:] != owner[:-1]) if n else np.zeros(0, dtype=np.int64)
        after[edge], before[edge + 1] = -1, -1  # no pair crosses a word's end
        after[n - 1 :] = -1
        where: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(places: np.ndarray) -> None:
            """Enter the pairs that begin at these places in the index."""
            rank = self.v.rank_of(symbols[places], symbols[after[places]])
            has = np.flatnonzero(rank >= 0)
            if not len(has):
                return
            order = has[np.argsort(rank[has], kind="stable")]
            own = rank[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, at in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(places[order], cuts)):
                if r not in where:
                    where[r] = []
                    heapq.heappush(ranks, r)
                where[r].append(at)

        for start in range(0, n, NOTED):
            note((np.flatnonzero(after[start : start + NOTED] >= 0) + start).astype(np.int32))
        while ranks:
            rank = heapq.heappop(ranks)
            a, b, made = self.v.pairs[rank]
            found = where.pop(rank)
            places = _sorted_once(np.concatenate(found)) if len(found) > 1 else found[0]
            ahead = after[places]
            places = places[(symbols[places] == a) & (ahead >= 0) & (symbols[ahead] == b)]
            if a == b:
                places = self._apart(places, after)
            if not len(places):
                continue
            second = after[places]
            third = after[second]
            symbols[places], symbols[second] = made, -1
            after[places] = third
            more = third >= 0
            before[third[more]] = places[more]
            left = before[places]
            left = left[left >= 0]
            note(_sorted_once(np.concatenate([places[more], left])))
        kept = symbols >= 0
        return symbols[kept].astype("<u4"), np.bincount(owner[kept], minlength=len(raws))

    @staticmethod
    def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places whose pairs overlap, every other one from the left."""
        out, taken = [], -1
        for p, q in zip(places.tolist(), after[places].tolist()):
            if p != taken:
                out.append(p)
                taken = q
        return np.array(out, dtype=np.int64)

    def pieces(self, text: str) -> list[str]:
        """A whole text as pre-tokens and added tokens."""
        if self.v.cut is None or not any(t in text for t in self.v.added):
            return (self.v.plain if is_plain(text) else self.v.words).findall(text)
        out: list[str] = []
        for i, part in enumerate(self.v.cut.split(text)):
            out += [part] if i % 2 else self.v.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.number) > MEMO:
            self._forget()
        known = len(self.number)
        get = self.number.__getitem__
        numbers = [np.fromiter(map(get, words), dtype=np.int32, count=len(words)) for words in map(self.pieces, texts)]
        new = list(islice(self.number, known, None))
        flat, sizes = self.merge(["" if w in self.v.added else w for w in new])
        if any(w in self.number for w in self.v.added):  # an added token has its one id
            at = [k for k, w in enumerate(new) if w in self.v.added]
            flat = np.insert(flat, np.cumsum(sizes)[at] if at else [], [self.v.added[new[k]] for k in at]).astype("<u4")
            sizes[at] = 1
        self.flat = np.concatenate([self.flat, flat])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
        each = np.diff(self.begins)
        out = []
        for own in numbers:
            n = each[own]
            total = int(n.sum())
            shift = self.begins[own] - (np.cumsum(n) - n)
            out.append(self.flat[np.repeat(shift, n) + np.arange(total)].tobytes())
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def read_vocabulary(path: str) -> bytes:
    """Bytes of a vocabulary file on the driver, no larger than ``MAX_FILE``."""
    with open(path, "rb") as f:
        raw = f.read(MAX_FILE + 1)
    if len(raw) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    return raw


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    """One in each worker process; later tasks find the pre-tokens of earlier ones."""
    key = hashlib.md5(raw).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(raw))
    return _ENCODERS[key]


def batches(parts: Iterator[pd.DataFrame], chars: int = 6 << 20) -> Iterator[pd.DataFrame]:
    """Batches put together to about ``chars`` characters of text, so that a merge serves many new pre-tokens at once."""
    held, size = [], 0
    for pdf in parts:
        held.append(pdf)
        size += int(pdf["text"].str.len().fillna(0).sum())
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids binary)``; ids as little-endian unsigned 32-bit integers, null text as empty."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(raw.value)
        for pdf in batches(parts):
            ids = encoder.encode([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(lean(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids binary)`` to ``(doc_id, text)``; null ids as none."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(raw.value)
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [encoder.decode(x or b"") for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, encoding and decoding in one pass.

    One row per row of docs: null and empty texts have no tokens and the digests of nothing, repeated rows
    repeat, other columns are not read. A long text is encoded whole; memory is bounded by a batch's texts and
    ``MEMO`` pre-tokens.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(raw.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in batches(parts):
            ids = encoder.encode([t or "" for t in pdf["text"]])
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [sha(x) for x in ids],
                    "decoded_sha256": [sha(encoder.decode(x).encode("utf-8", "surrogatepass")) for x in ids],
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: Vocabulary of the registered queries.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
