"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped to score.

Counting: each task turns its texts into 64-bit word hashes, counts the pairs of ``CHUNK`` tokens at a time and
sends each distinct pair once to the shard of its pair hash. Shards are ranges of pair hashes, so a word that follows or precedes a third of all words is spread over all of
them; their number follows the corpus (``SHARD_BYTES`` of text each). Beyond ``FAN`` shards pairs are dealt in two
steps, first to groups of shards, so that a chunk never makes more than ``FAN`` blocks. A shard's task merges its
counts and writes one file: pair hashes in order and their counts. It passes on sums for each word (how often it
follows how many different words; how many of its followers occur once, twice, more often), dealt in the same way to
ranges of word hashes, one for ``PAIRS_A_WORD`` shards of pairs, whose tasks write the word files. Nothing by word,
pair or shard goes to the driver, only a dozen totals do.

Files are written under a temporary name and moved into place, so a repeated task replaces equal content. Every
shard has its files, so a missing one is an error. They lie in the shared folder; workers map them, ``MAPPED`` at a
time, and search them with sorted batches of hashes.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.memory import lean
from tidemark.session import materialize, move_shared, new_folder, open_shared

#: Tokens that a task counts or scores at a time, and bytes of text for each shard.
CHUNK, SCORED, SHARD_BYTES = 2_500_000, 300_000, 12 << 20
#: Most shards that a chunk is dealt to at once, shards of pairs for each one of words, and files that a worker maps.
FAN, PAIRS_A_WORD, MAPPED = 1024, 4, 256
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
HELD_OUT, HELD_OUT_REST = 7, 2


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, cut at space and \\x09-\\x0d."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    x = u * np.uint64(0x9E3779B97F4A7C15) + (v ^ (v >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Range of a hash: shards are in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _counted(us: list, vs: list, ns: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of their hashes and their counts; empties the lists, to hold few copies."""
    u, v = np.concatenate(us), np.concatenate(vs)
    us.clear(), vs.clear()
    p = pair_hash(u, v)
    order = np.argsort(p)
    p = p[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    if ns is None:
        n = np.diff(np.append(first, len(p)))
    else:
        n = np.concatenate(ns)[order]
        ns.clear()
        n = np.add.reduceat(n, first)
    del p
    order = order[first]
    return u[order], v[order], n


def _cuts(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Of hashes in order, the part of each shard that has any."""
    edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        yield shard, slice(int(edges[shard]), int(edges[shard + 1]))


def _pack(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs with counts; each first word once."""
    order = np.argsort(u, kind="stable")
    u, v, n = u[order], v[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    runs = np.diff(np.append(first, len(u))).astype("<u4")
    small = zlib.compress(runs.tobytes() + n.astype("<u4").tobytes(), 1)
    return np.array([len(first), len(u)], dtype="<u8").tobytes() + u[first].tobytes() + v.tobytes() + small


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    first, v = np.frombuffer(raw, "<u8", k, 16), np.frombuffer(raw, "<u8", n, 16 + 8 * k)
    small = np.frombuffer(zlib.decompress(raw[16 + 8 * k + 8 * n :]), "<u4")
    return np.repeat(first, small[:k]), v, small[k:].astype(np.int64)


def _pack_sums(sums: np.ndarray) -> bytes:
    """Columns of a word hash and six counts; the counts, mostly small, byte by byte."""
    counts = np.ascontiguousarray(sums[1:]).astype("<i8").view(np.uint8).reshape(6, -1, 8)
    return np.array([sums.shape[1]], "<u8").tobytes() + sums[0].astype("<i8").tobytes() + zlib.compress(counts.transpose(0, 2, 1).tobytes(), 1)


def _unpack_sums(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    counts = np.frombuffer(zlib.decompress(raw[8 + 8 * n :]), np.uint8).reshape(6, 8, n)
    return np.concatenate([np.frombuffer(raw, "<i8", n, 8)[None], np.ascontiguousarray(counts.transpose(0, 2, 1)).view("<i8")[:, :, 0]])


def _summed(held: list[np.ndarray]) -> np.ndarray:
    """One column for each word, in the order of the unsigned hashes; empties the list."""
    every = np.concatenate(held, axis=1)
    held.clear()
    every = every[:, np.argsort(every[0].view(np.uint64), kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], every[0, 1:] != every[0, :-1]]))
    out = np.add.reduceat(every, first, axis=1)
    out[0] = every[0, first]
    return out


def _save(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, widest first, behind their number of items."""
    tmp = f"{uri}.{TaskContext.get().taskAttemptId()}.tmp"
    with open_shared(tmp, "wb") as f:
        f.write(np.array([len(x) for x in arrays], dtype="<u8").tobytes())
        for x in arrays:
            f.write(x.tobytes())
    move_shared(tmp, uri)


#: What the arrays of a file hold.
PAIRS, WORDS = ("<u8", "<i8", "<i8", "<u1"), ("<u8", "<u8", "<u8", "<f4")


def _mapped(uri: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """A file's arrays, memory-mapped; the shared folder has to be mounted on the workers for that."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{uri} cannot be memory-mapped: name a mounted folder in spark.checkpoint.dir")
    raw = np.memmap(parsed.path, dtype=np.uint8, mode="r")
    at, out = 8 * len(kinds), []
    for n, kind in zip(raw[:at].view("<u8").tolist(), kinds):
        size = n * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many things occur 1, 2, 3 and 4 times."""
    if not all(n[:3]):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


@dataclass
class Model:
    """Where the arrays are, how many shards of each kind there are, and totals."""

    folder: str
    shards: int
    word_shards: int = 0
    tokens: int = 0
    distinct: int = 0
    pairs: int = 0
    pair_discounts: tuple[float, float, float] = (0.5, 0.75, 0.9)
    word_discounts: tuple[float, float, float] = (0.5, 0.75, 0.9)
    left_over: float = 1.0
    _maps: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": OrderedDict()}

    def _arrays(self, kind: str, shard: int) -> list[np.ndarray]:
        """Of the ``MAPPED`` files that were used last; others are unmapped as their arrays go."""
        if (kind, shard) in self._maps:
            self._maps.move_to_end((kind, shard))
        else:
            self._maps[kind, shard] = _mapped(f"{self.folder}/{kind}-{shard:07d}", PAIRS if kind == "pairs" else WORDS)
            if len(self._maps) > MAPPED:
                self._maps.popitem(last=False)
        return self._maps[kind, shard]

    def _found(self, kind: str, keys: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For sorted keys, by shard: which keys, which of them are there, where, and the shard's arrays."""
        shards = self.shards if kind == "pairs" else self.word_shards
        of = shard_of(keys, max(shards, 1))
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(edges, edges[1:]) if shards and len(keys) else ():
            arrays = self._arrays(kind, int(of[a]))
            if len(arrays[0]):
                part = slice(a, b)
                at = np.minimum(np.searchsorted(arrays[0], keys[part]), len(arrays[0]) - 1)
                yield part, arrays[0][at] == keys[part], at, arrays

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        for part, has, at, (_, many_at, many, counts) in self._found("pairs", keys):
            n = counts[at].astype(np.int64)
            big = np.flatnonzero(has & (n == 255))
            if len(big):
                n[big] = many[np.searchsorted(many_at, at[big])]
            out[part] = np.where(has, n, 0)
        return out

    def word_rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, number of different words before, and weight of the lower order after each word."""
        count, before, backoff = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys))
        for part, has, at, (_, counts, befores, backoffs) in self._found("words", keys):
            count[part] = np.where(has, counts[at], 0)
            before[part] = np.where(has, befores[at], 0)
            backoff[part] = np.where(has, backoffs[at], 1.0)
        return count, before, backoff

    def log10(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(v | u) of each token and its training count."""
        words, back = np.unique(np.concatenate([u, v]), return_inverse=True)
        count, before, backoff = (x[back] for x in self.word_rows(words))
        n = len(u)
        keys, back = np.unique(pair_hash(u, v), return_inverse=True)
        pairs = self.pair_counts(keys)[back]
        d = np.array([0.0, *self.word_discounts])
        b = before[n:]
        lower = np.maximum(b - d[np.minimum(b, 3)], 0.0) / max(1, self.pairs) + self.left_over / (self.distinct + 1)
        d = np.array([0.0, *self.pair_discounts])
        seen = np.maximum(pairs - d[np.minimum(pairs, 3)], 0.0) / np.maximum(count[:n], 1)
        p = np.where(count[:n] > 0, seen + backoff[:n] * lower, lower)
        return np.log10(p), count[n:]


def _texts(pdf: pd.DataFrame, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a..b with about ``most`` tokens: words before, words, tokens of each row."""
    held, sizes, a, total = [], [], 0, 0
    for i, text in enumerate(pdf["text"]):
        own = hashes_of(words_of(text))
        held.append(own)
        sizes.append(len(own) + 1)
        total += len(own) + 1
        if total >= most or i == len(pdf) - 1:
            v = np.concatenate([x for own in held for x in (own, [END])]).astype(np.uint64)
            ends = np.cumsum(sizes)
            u = np.concatenate([[START], v[:-1]]).astype(np.uint64)
            u[ends[:-1]] = START
            yield a, i + 1, u, v, np.array(sizes)
            held, sizes, a, total = [], [], i + 1, 0


def train(docs: DataFrame) -> Model:
    """Model of all texts of ``docs(text)``; null texts are empty ones. No rows give the uniform model."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    groups = -(-shards // FAN)
    shards = groups * -(-shards // groups)  # each group has as many
    word_shards = -(-shards // PAIRS_A_WORD)
    word_groups = -(-word_shards // FAN)
    word_shards = word_groups * -(-word_shards // word_groups)
    folder = new_folder(spark, "ngrams")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, vs, held = [], [], 0
        for pdf in parts:
            for _, _, u, v, _ in _texts(pdf, SCORED):
                us.append(u), vs.append(v)
                held += len(u)
                if held >= CHUNK:
                    yield from dealt(us, vs, groups if groups > 1 else shards)
                    held = 0
        if held:
            yield from dealt(us, vs, groups if groups > 1 else shards)

    def dealt(us: list, vs: list, number: int, ns: list | None = None) -> Iterator[pd.DataFrame]:
        """Distinct pairs of what the lists hold, by shard (or group of shards); the lists are emptied."""
        u, v, n = _counted(us, vs, ns)
        for s, part in _cuts(pair_hash(u, v), number):
            yield pd.DataFrame({"shard": [s], "raw": [_pack(u[part], v[part], n[part])]})

    def deal_again(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A group's pairs, a chunk at a time, to its shards."""
        us, vs, ns, held = [], [], [], 0
        for pdf in parts:
            for raw in pdf["raw"]:
                for of, x in zip((us, vs, ns), _unpack(raw)):
                    of.append(x)
                held += len(us[-1])
                if held >= CHUNK:
                    yield from dealt(us, vs, shards, ns)
                    held = 0
        if held:
            yield from dealt(us, vs, shards, ns)

    def merge_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []  # the merged part first; a partition is one shard
        pending, shard = 0, None
        for pdf in parts:
            for shard, raw in zip(pdf["shard"].tolist(), pdf["raw"]):
                if raw is None:
                    continue
                held.append(_unpack(raw))
                pending += len(held[-1][0])
                if pending > max(1 << 20, len(held[0][0])):
                    held.append(_merged(held))
                    pending = 0
        if shard is not None:
            yield from store_pairs(shard, held)

    def _merged(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        us, vs, ns = (list(x) for x in zip(*held))
        held.clear()
        return _counted(us, vs, ns)

    def store_pairs(shard: int, held: list) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.uint64)
        u, v, n = _merged(held) if held else (none, none, none.astype(np.int64))
        many = np.flatnonzero(n >= 255)
        _save(f"{folder}/pairs-{shard:07d}", [pair_hash(u, v), many.astype("<i8"), n[many].astype("<i8"), np.minimum(n, 255).astype(np.uint8)])
        words, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        first, second, k = at[: len(u)], at[len(u) :], len(words)
        total = lambda of, x: np.bincount(of, weights=x, minlength=k).astype(np.int64)  # noqa: E731  exact below 2**53
        sums = np.stack([words.view(np.int64), np.bincount(second, minlength=k), total(second, n), total(first, n == 1), total(first, n == 2), total(first, n >= 3), total(first, np.where(u == START, n, 0))])
        yield pd.DataFrame({"shard": [-1], "raw": [b""], "tokens": [int(n.sum())]} | {f"n{x}": [int((n == x).sum())] for x in (1, 2, 3, 4)})
        for frame in dealt_sums(sums, word_groups if word_groups > 1 else word_shards):
            yield frame.assign(tokens=0, n1=0, n2=0, n3=0, n4=0)

    def dealt_sums(sums: np.ndarray, number: int) -> Iterator[pd.DataFrame]:
        for s, part in _cuts(sums[0].view(np.uint64), number):
            yield pd.DataFrame({"shard": [s], "raw": [_pack_sums(sums[:, part])]})

    def deal_sums_again(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A group's sums, a chunk at a time, to its shards."""
        held, pending = [], 0
        for pdf in parts:
            for raw in pdf["raw"]:
                held.append(_unpack_sums(raw))
                pending += held[-1].shape[1]
                if pending >= CHUNK // 2:
                    yield from dealt_sums(_summed(held), word_shards)
                    pending = 0
        if held:
            yield from dealt_sums(_summed(held), word_shards)

    block = "shard int, raw binary"
    by_word = f"{block}, tokens long, n1 long, n2 long, n3 long, n4 long"
    pairs = texts.mapInPandas(lean(count), block)
    if groups > 1:
        pairs = pairs.repartitionById(groups, F.col("shard")).mapInPandas(lean(deal_again), block)
    anchors = lambda n: spark.range(n).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("raw"))  # noqa: E731  no shard without a file
    sums, _ = materialize(pairs.union(anchors(shards)).repartitionById(shards, F.col("shard")).mapInPandas(lean(merge_pairs), by_word), "word-sums")
    n1, n2, n3, n4, tokens = sums.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "tokens"))).first()
    if not tokens:
        return Model(folder, 0)
    discounts = _discounts([n1, n2, n3, n4])

    def store_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of a range of words, held merged; a partition is one shard."""
        held, pending, shard = [], 0, None
        for pdf in parts:
            for shard, raw in zip(pdf["shard"].tolist(), pdf["raw"]):
                if raw is None:
                    continue
                held.append(_unpack_sums(raw))
                pending += held[-1].shape[1]
                if pending > max(1 << 18, held[0].shape[1]):
                    held, pending = [_summed(held)], 0
        if shard is None:
            return
        words, before, count, m1, m2, m3, starts = _summed(held) if held else np.zeros((7, 0), dtype=np.int64)
        total = count + starts
        followed = m1 + m2 + m3 > 0
        backoff = np.where(followed, np.minimum((discounts[0] * m1 + discounts[1] * m2 + discounts[2] * m3) / np.maximum(total, 1), 1.0), 1.0)
        _save(f"{folder}/words-{shard:07d}", [words.view(np.uint64), total.astype("<u8"), before.astype("<u8"), backoff.astype("<f4")])
        yield pd.DataFrame({"distinct": [int((count > 0).sum())], "pairs": [int(before.sum())]} | {f"m{k}": [int((before == k).sum())] for k in (1, 2, 3, 4)})

    by_range = sums.where("shard >= 0").select("shard", "raw")
    if word_groups > 1:
        by_range = by_range.repartitionById(word_groups, F.col("shard")).mapInPandas(lean(deal_sums_again), block)
    words = by_range.union(anchors(word_shards)).repartitionById(word_shards, F.col("shard")).mapInPandas(lean(store_words), "distinct long, pairs long, m1 long, m2 long, m3 long, m4 long")
    done, _ = materialize(words, "word-totals")
    m = done.agg(*(F.sum(c).alias(c) for c in ("distinct", "pairs", "m1", "m2", "m3", "m4"))).first()
    low = _discounts([m.m1, m.m2, m.m3, m.m4])
    left = (low[0] * m.m1 + low[1] * m.m2 + low[2] * (m.distinct - m.m1 - m.m2)) / m.pairs
    return Model(folder, shards, word_shards, tokens, m.distinct, m.pairs, discounts, low, left)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % HELD_OUT == HELD_OUT_REST, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity)``, one row for each row.

    A null text counts as empty: its only token is the end. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # totals and places, no arrays

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in parts:
            for a, b, u, v, sizes in _texts(pdf, SCORED):
                logs, counts = model.log10(u, v)
                base = np.log10((counts + 1) / (model.tokens + model.distinct + 1))
                first = np.cumsum(sizes) - sizes
                total = np.add.reduceat(logs, first)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[a:b].astype("Int64"),
                        "n_tokens": sizes,
                        "n_known": np.add.reduceat((counts > 0).astype(np.int64), first),
                        "train_tokens": model.tokens,
                        "base_score": np.add.reduceat(base, first),
                        "score": total,
                        "perplexity": 10 ** np.minimum(-total / sizes, 300),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(lean(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op10_ngram_lm(spark, sf_dir: str) -> DataFrame:
    """Whole table ``documents``; the model learns from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
