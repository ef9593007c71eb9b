"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are made from word shingles; documents whose fingerprints differ in at most
``max_bits`` bits are linked. The search is exact: the bits are dealt into m partitions with thresholds t_i so
that sum(t_i + 1) = max_bits + 1. Two fingerprints within ``max_bits`` differ by at most t_i bits in at least
one partition i. Correlated bits share a partition, and the thresholds come from a dynamic programme over
candidate counts that are estimated from a bounded sample (``SAMPLE``); the sample decides only the cost, never
the result. Each partition is probed by clearing bits: fingerprints that differ there by at most t bits meet in
the key that has the bits common to both, so i bits cleared on one side and j on the other with i + j <= t.

Documents with equal fingerprints form one class before the search, so a group of copies of any size is one
row. Candidates are verified inside the join, which emits only true links between different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.components import components
from tidemark.llm.memory import lean
from tidemark.session import materialize, scratch

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Fingerprints from which candidate counts are estimated.
SAMPLE = 4096
#: Numbers of partitions that are considered.
PARTITIONS = (1, 2, 3, 4)

_hash = partial(xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, words_each: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for a text without words or null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z; space and \x09-\x0d
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < words_each else map(b" ".join, zip(*(words[i:] for i in range(words_each))))
    return of_hashes(np.fromiter(map(_hash, shingles), dtype=np.uint64))


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingles' hashes, repeats included; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, fp)``, fp as a signed long. Other columns are not read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fps = np.array([fingerprint(t, words_each) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(lean(run), "doc_id long, fp long")


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m equal partitions; each grows by the bit most correlated with those it has."""
    with np.errstate(all="ignore"):  # a bit that never changes correlates with none
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.eye(64)
    left, out = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = sorted(left)
        own = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(1)))]]
        while len(own) < size:
            rest = [b for b in rest if b not in own]
            own.append(rest[int(np.argmax(corr[np.ix_(rest, own)].sum(1)))])
        out.append(sorted(own))
        left -= set(own)
    return out


def _near(bits: np.ndarray, own: list[int], max_bits: int) -> list[float]:
    """For t = 0..max_bits the estimated share of pairs that differ by at most t of these bits."""
    p = bits[:, own].mean(0) if len(bits) else np.full(len(own), 0.5)
    dist = np.zeros(max_bits + 1)
    dist[0] = 1.0
    for q in 2 * p * (1 - p):  # bits as if independent: finer than any sample resolves
        dist = dist * (1 - q) + np.concatenate([[0.0], dist[:-1]]) * q
    seen = np.zeros(max_bits + 1)
    packed = bits[:, own].astype(np.float32)
    for at in range(0, len(packed), 512):
        part = packed[at : at + 512]
        d = part.sum(1)[:, None] + packed.sum(1)[None, :] - 2 * part @ packed.T
        seen += [(d <= t + 0.5).sum() for t in range(max_bits + 1)]
    pairs = max(1, len(packed) * (len(packed) - 1))
    return [max(a, (s - len(packed)) / pairs) for a, s in zip(np.cumsum(dist), seen)]


def allocate(sample: np.ndarray, total: int, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Partitions as ``(mask, threshold)`` with the least estimated work for ``total`` fingerprints.

    A threshold of -1 leaves a partition out. Work is probe keys plus candidate pairs.
    """
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(sample) else np.zeros((0, 64), np.uint8)
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m in PARTITIONS:
        groups = _groups(bits, m)
        # dp[s]: least work of the partitions so far with sum(t + 1) = s
        dp: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in groups:
            near = _near(bits, own, max_bits)
            ones = float(bits[:, own].sum(1).mean()) if len(bits) else len(own) / 2
            work = {-1: 0.0}
            for t in range(max_bits + 1):
                keys = sum(comb(int(np.ceil(ones)), k) for k in range(t + 1))
                work[t] = 2.0 * total * keys + total * total / 2 * near[t]
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, ts) in dp.items():
                for t, w in work.items():
                    u = s + t + 1
                    if u <= max_bits + 1 and (u not in step or cost + w < step[u][0]):
                        step[u] = (cost + w, [*ts, t])
            dp = step
        cost, ts = dp[max_bits + 1]
        if cost < best[0]:
            best = (cost, [(sum(1 << b for b in own), t) for own, t in zip(groups, ts)])
    return [(mask, t) for mask, t in best[1] if t >= 0]


def probe_keys(fps: np.ndarray, mask: int, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For k = 0..t: the masked fingerprints with any k of their set bits cleared, the row of each, and k."""
    own = [b for b in range(64) if mask >> b & 1]
    base = fps & np.uint64(mask)
    yield base, np.arange(len(fps)), 0
    for k in range(1, t + 1):
        for chosen in combinations(own, k):
            cut = np.uint64(sum(1 << b for b in chosen))
            rows = np.flatnonzero((base & cut) == cut)
            yield base[rows] & ~cut, rows, k


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints ``fp`` (signed long, one row each) to all links ``(fp, fp_2)``, fp < fp_2, at most ``max_bits`` apart."""
    total = fps.count()
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    plan = allocate(sample, total, max_bits)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            all_fps = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for at in range(0, len(all_fps), 2048):
                own = all_fps[at : at + 2048]
                for i, (mask, t) in enumerate(plan):
                    got = [(key, own[rows], np.full(len(rows), k, np.int32)) for key, rows, k in probe_keys(own, mask, t)]
                    key, fp, cut = (np.concatenate(x) for x in zip(*got))
                    yield pd.DataFrame({"part": np.full(len(key), i, np.int32), "key": key.view(np.int64), "fp": fp.view(np.int64), "cut": cut})

    keys = fps.select("fp").mapInPandas(lean(run), "part int, key long, fp long, cut int")
    other = keys.select(*(F.col(c).alias(f"{c}_2") for c in keys.columns))
    limit = F.element_at(F.array(*(F.lit(t) for _, t in plan)), F.col("part") + 1)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_2"))) <= max_bits
    meet = (F.col("part") == F.col("part_2")) & (F.col("key") == F.col("key_2"))
    return keys.join(other, meet & (F.col("fp") < F.col("fp_2")) & (F.col("cut") + F.col("cut_2") <= limit) & near).select("fp", "fp_2").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words_each: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, fp, component_id)``, one row per row of docs.

    component_id is the smallest doc_id reachable over links, the document's own included; classes whose ids
    are all null have a null component_id unless linked to others. Null and empty texts have fingerprint zero
    and are linked like any other. Rows that repeat a doc_id are each fingerprinted. Extra columns are ignored.
    """
    with scratch(docs.sparkSession) as kept:
        fps, fps_uri = materialize(fingerprints(docs, words_each), "simhash")
        classes, _ = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
        named = components(links(classes, max_bits).select(F.col("fp").alias("a"), F.col("fp_2").alias("b")))
        linked = classes.join(named, classes["fp"] == named["vertex"])  # only classes with a link
        # aggregates are written before they are joined: both sides are then plain exchanges, whose hot partitions Spark splits
        least, _ = materialize(linked.groupBy("component").agg(F.min("first").alias("least")), "simhash-least")
        moved = linked.join(least, "component").select("fp", "least")
        named_all, named_uri = materialize(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-named")
        kept += [fps_uri, named_uri]
    return fps.join(named_all, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
