"""Document fingerprints by randomised edit embedding, and near copies by banding.

A walk reads a text with one pointer. At each step it emits the character under the pointer and a random bit,
shared by all texts and given by step and character, says whether the pointer moves on. Texts a few edits
apart leave each other's track at an edit and fall back into step soon after, so their edit distance becomes a
small Hamming distance between what they emit. A whole text of n characters takes about 2n steps.

A fingerprint keeps ``BITS`` emitted characters as one bit each. Bit k is taken at a step that is uniform over
the steps of the walk and the same for walks of almost the same length: the steps of bit k are the records of a
random sequence (each next one at a geometrically larger step), and the last record before the walk ends
counts. Thus the schedule has no largest length, and equal texts have equal fingerprints. ``WALKS`` independent
walks share the bits. Likeness is the share of agreeing bits beyond the half that agree by chance.

Walks run side by side for a batch of texts, one vector operation a step; once only a few long texts are
left, each is walked alone.

Near copies come by banding: each band is a fixed sample of bits, two fingerprints that agree in one are verified
over all bits. A band has as many bits as keep chance meetings rare whatever the number of fingerprints, and there
are as many bands as give a pair that is just like enough the chance ``FOUND``. Fingerprints are
classes, so copies are one row; each band's key links its fingerprints to the first of them, and of the other pairs
only those across the groups found so far are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm.components import components
from tidemark.llm.memory import lean
from tidemark.session import materialize, scratch

BITS, WALKS, SEED = 512, 2, 20240229
#: Characters that are walked side by side, and texts below which each is walked alone.
BATCH_CHARS, ALONE = 8 << 20, 24
#: Steps after which the shared random bits repeat.
PERIOD = 4096
#: Least likeness of near copies, and the chance to find a pair of just that likeness.
LIKENESS, FOUND = 0.8, 0.9
#: Bits of information in a sampled bit (texts share frequent characters), and binary logarithm of the fingerprints for each chance meeting in a band.
INFORMATION, RARE = 0.86, 4
#: Level at which texts are packed to be shuffled.
PACKED = 9


class Walker:
    """The shared randomness; equal in every process."""

    def __init__(self, bits: int = BITS, walks: int = WALKS, seed: int = SEED):
        self.each = bits // walks
        self.moves, self.letters, self.records = [], [], []
        rng = np.random.default_rng(seed)
        for _ in range(walks):
            moves = rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
            moves[:, 0] = 0  # class 0 is the end of a text: the pointer stays
            self.moves.append(moves)
            self.letters.append(rng.integers(0, 2, (self.each, 256), dtype=np.uint8))
            self.records.append([self._records(rng) for _ in range(self.each)])
        self.steps = [np.unique(np.concatenate(r)) for r in self.records]
        self.last = [[np.searchsorted(s, r) for r in rs] for s, rs in zip(self.steps, self.records)]

    @staticmethod
    def _records(rng: np.random.Generator) -> np.ndarray:
        at, out = 0, []
        while at < 1 << 40:
            out.append(at)
            at = int(at / max(rng.random(), 1e-9)) + 1
        return np.array(out, dtype=np.int64)

    @staticmethod
    def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters hashed to 1..255, each text closed by a 0; and where each begins."""
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        cls = (((codes * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        cls[begins + sizes] = 0
        return cls, begins

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """One row of packed bits for each text."""
        if not texts:
            return np.zeros((0, self.each * len(self.moves) // 8), dtype=np.uint8)
        cls, begins = self.classes(texts)
        return np.packbits(np.hstack([self._walk(w, cls, begins) for w in range(len(self.moves))]), axis=1)

    def _walk(self, w: int, cls: np.ndarray, begins: np.ndarray) -> np.ndarray:
        moves, steps = self.moves[w], self.steps[w]
        n = len(begins)
        seen = np.zeros((256, n), dtype=np.uint8)  # class under the pointer at each record step
        ended = np.zeros(n, dtype=np.int64)
        live, at = np.arange(n), begins.copy()
        step = due = 0
        check = 1
        while len(live):
            if step == check:  # leave out the walks that have ended; checked ever more rarely
                going = cls[at] != 0
                ended[live[~going]] = step
                live, at = live[going], at[going]
                check = step + 1 + step // 32
                if len(live) <= ALONE:
                    break
            here = cls.take(at)
            if step == steps[due]:
                if due == len(seen):
                    seen = np.vstack([seen, np.zeros_like(seen)])
                seen[due, live] = here
                due += 1
            at += moves[step % PERIOD].take(here)
            step += 1
        for text, place in zip(live.tolist(), at.tolist()):
            seen, ended[text] = self._alone(w, cls, text, place, step, check, due, seen)
        own = np.zeros((n, self.each), dtype=np.uint8)
        cols = np.arange(n)
        for k in range(self.each):
            record = np.searchsorted(self.records[w][k], np.maximum(ended, 1), side="left") - 1
            own[:, k] = self.letters[w][k][seen[self.last[w][k][record], cols]]
        return own

    def _alone(self, w: int, cls: np.ndarray, text: int, place: int, step: int, check: int, due: int, seen: np.ndarray) -> tuple[np.ndarray, int]:
        moves, steps = self.moves[w], self.steps[w]
        stop = place + int(np.argmin(cls[place:] != 0))
        own, flat, start = cls[place : stop + 1].tobytes(), moves.tobytes(), 0
        while True:
            to = min(check, int(steps[due]))
            while step < to:
                start += flat[(step % PERIOD) << 8 | own[start]]
                step += 1
            if step == check:
                if own[start] == 0:
                    return seen, step
                check = step + 1 + step // 32
            if step == steps[due]:
                if due == len(seen):
                    seen = np.vstack([seen, np.zeros_like(seen)])
                seen[due, text] = own[start]
                due += 1


_WALKER: list[Walker] = []


def walker() -> Walker:
    """One for each process."""
    if not _WALKER:
        _WALKER.append(Walker())
    return _WALKER[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row from packed bits: 1 for equal fingerprints, about 0 for unrelated ones."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / (8 * a.shape[1])
    return np.maximum(0.0, 1.0 - 2.0 * differ)


def _chunks(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_chars, fingerprint)``, one row per row; null text as empty, other columns not read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [t or "" for t in pdf["text"]]
            for a, b in _chunks(texts):
                fps = walker().fingerprints(texts[a:b])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].astype("Int64"), "n_chars": [len(t) for t in texts[a:b]], "fingerprint": [x.tobytes().hex() for x in fps]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(lean(run), "doc_id long, n_chars long, fingerprint string")


def bands(count: int, least: float = LIKENESS, found: float = FOUND) -> np.ndarray:
    """For ``count`` fingerprints a row of ``BITS`` bits for each band, as 64-bit words."""
    size = min(BITS, math.ceil((math.log2(max(count, 64)) - 1 + RARE) / INFORMATION))
    agree = (1 - (1 - least) / 2) ** size
    number = max(1, math.ceil(math.log(1 - found) / math.log1p(-agree))) if agree < 1 else 1
    rng = np.random.default_rng(SEED + 1)
    masks = np.zeros((number, BITS // 64), dtype=np.uint64)
    for band in masks:
        for bit in rng.choice(BITS, size, replace=False).tolist():
            band[bit // 64] |= np.uint64(1 << (bit % 64))
    return masks.view(np.int64)


def near_copies(members: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``members(doc_id, fingerprint)`` to ``(f, near_id)``: each fingerprint's hash and the smallest doc_id reachable over links.

    Fingerprints that are at least ``least`` alike are linked if they agree in a band (a pair that is just so alike
    does with a probability of ``FOUND``). Equal fingerprints are one class, so repeated rows and ties need no order.
    A class whose ids are all null has a null near_id unless it is linked to others; a null fingerprint is left out;
    an empty table gives no rows. Other columns are not read.
    """
    words = BITS // 64
    wide = [f"w{i}" for i in range(words)]
    longs = [F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long").alias(w) for i, w in enumerate(wide)]
    classes = members.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    classes, _ = materialize(classes.select(F.xxhash64("fingerprint").alias("f"), "first", *longs), "fingerprint-classes")
    masks = bands(classes.count(), least)

    own = F.array(*(F.xxhash64(F.lit(b), *(F.col(w).bitwiseAND(F.lit(int(mask[i]))) for i, w in enumerate(wide) if mask[i])) for b, mask in enumerate(masks)))
    keys = classes.select("f", F.explode(own).alias("key"))
    pivots, _ = materialize(keys.groupBy("key").agg(F.min("f").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "band-pivots")
    met, _ = materialize(keys.join(pivots, "key"), "bands")

    other = classes.select(*(F.col(c).alias(f"{c}_2") for c in ("f", *wide)))
    alike = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_2"))) for w in wide), F.lit(0)) <= int((1 - least) / 2 * BITS + 1e-9)
    pairs = met.where("f <> pivot").select("f", F.col("pivot").alias("f_2")).distinct()
    links, _ = materialize(pairs.join(classes.drop("first"), "f").join(other, "f_2").where(alike).select(F.col("f").alias("a"), F.col("f_2").alias("b")), "near-links")

    named, _ = materialize(components(links), "near-components")
    now, _ = materialize(met.drop("pivot").join(named, met["f"] == named["vertex"], "left").select("key", "f", F.coalesce("component", "f").alias("label")), "labelled-bands")
    main = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    main, _ = materialize(main.where("labels > 1").drop("labels"), "band-groups")
    now, _ = materialize(now.join(main, "key").join(classes.drop("first"), "f"), "open-bands")
    second = now.drop("main").select("key", *(F.col(c).alias(f"{c}_2") for c in ("f", "label", *wide)))
    across = (F.col("label") != F.col("label_2")) & ((F.col("label_2") == F.col("main")) | (F.col("f") < F.col("f_2")))
    more = now.where("label <> main").join(second, "key").where(across & alike).select(F.col("f").alias("a"), F.col("f_2").alias("b"))
    more, _ = materialize(more.distinct(), "near-links")

    named, _ = materialize(components(links.union(more)), "near-components")
    linked = classes.select("f", "first").join(named, classes["f"] == named["vertex"]).select("f", "first", "component")
    smallest, _ = materialize(linked.groupBy("component").agg(F.min("first").alias("least")), "near-least")
    moved, _ = materialize(linked.join(smallest, "component").select("f", "least"), "near-named")
    return classes.select("f", "first").join(moved, "f", "left").select("f", F.coalesce("least", "first").alias("near_id"))


def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([zstandard.compress(t.encode("utf-8", "surrogatepass"), PACKED) for t in texts], dtype=object)


def _unpacked(raw: bytes) -> str:
    return zstandard.decompress(raw).decode("utf-8", "surrogatepass")


def with_next(docs: DataFrame, number: int) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range sorted and closed by the row that follows it (``halo`` = 1); texts are packed.

    The row after the last one is the first one. Null ids come before all others; rows of one id are ordered by
    a hash of their texts, and an id with more than a range's share of rows is cut by that hash. Texts are shuffled
    once; what is broadcast or collected has a few rows for each of ``number`` ranges.
    """
    least = -(1 << 63)
    id_ = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select(F.coalesce(id_, F.lit(least).cast("long")).alias("k"))
    shares = [i / number for i in range(1, number)]
    cuts = sorted(set((ids.agg(F.percentile_approx("k", shares, 20 * number)).first()[0] if shares else None) or []))
    cuts = [(k, least) for k in cuts]  # ranges begin with (k, hash)
    keyed = docs.select(id_.alias("doc_id"), text.alias("text"), F.coalesce(id_, F.lit(least).cast("long")).alias("k"), F.xxhash64(text).alias("h"))
    if shares:
        total = ids.count()
        for r in ids.groupBy("k").count().where(F.col("count") * number > 2 * total).collect():  # fewer than ``number`` ids
            parts = -(-r["count"] * number // total)
            inside = keyed.where(F.col("k") == r.k).agg(F.percentile_approx("h", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
            cuts += [(r.k, h) for h in inside]
    cuts = sorted(set(cuts))
    ck, ch = (np.array([c[i] for c in cuts], dtype=np.int64) for i in range(2))

    @pandas_udf("int")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        k, h = k.to_numpy(), h.to_numpy()
        out = np.searchsorted(ck, k, side="right")  # past all cuts of the same id
        for same in np.unique(ck[1:][ck[1:] == ck[:-1]]):  # ids that are cut inside
            at, a, b = k == same, np.searchsorted(ck, same), np.searchsorted(ck, same, side="right")
            out[at] = a + np.searchsorted(ch[a:b], h[at], side="right")
        return pd.Series(out.astype(np.int32))

    pack = pandas_udf(_packed, "binary")
    firsts = sorted((r.r, r["first"]) for r in keyed.select("k", "h").groupBy(range_of("k", "h").alias("r")).agg(F.min(F.struct("k", "h")).alias("first")).collect())
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    edges = docs.sparkSession.createDataFrame([(r, first["k"], first["h"], b) for (r, first), b in zip(firsts, before)], "edge int, first_k long, first_h long, before int")
    ranged = keyed.select("doc_id", "k", "h", range_of("k", "h").alias("r"), pack("text").alias("packed")).join(F.broadcast(edges), F.col("r") == F.col("edge"), "left")
    own = F.struct(F.col("r").alias("range"), F.lit(0).alias("halo"))
    both = F.when((F.col("k") == F.col("first_k")) & (F.col("h") == F.col("first_h")), F.array(own, F.struct(F.col("before").alias("range"), F.lit(1).alias("halo")))).otherwise(F.array(own))
    dealt = ranged.select("doc_id", "packed", "k", "h", F.inline(both))
    return dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "halo", "k", "h", "packed")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited forms (the last quarter replaced by the next document's beginning), and likeness."""
    spark = docs.sparkSession
    rows = with_next(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for pdf in parts:
            for doc_id, packed, halo in zip(pdf["doc_id"].astype("Int64"), pdf["packed"], pdf["halo"]):
                held.append((doc_id, _unpacked(packed), halo))
                size += len(held[-1][1])
                if size >= BATCH_CHARS // 4 and len(held) > 1:
                    yield compare(held[:-1], [x[1] for x in held])
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield compare(held[:-1], [x[1] for x in held])

    def compare(own: list[tuple], texts: list[str]) -> pd.DataFrame:
        keep = [i for i, x in enumerate(own) if x[2] == 0]
        quarters = [len(t) // 4 for t in texts]
        edited = [texts[i][: len(texts[i]) - quarters[i]] + texts[i + 1][: quarters[i]] for i in keep]
        fps = walker().fingerprints([*texts, *edited])
        mine, after, other = fps[keep], fps[[i + 1 for i in keep]], fps[len(texts) :]
        return pd.DataFrame(
            {
                "doc_id": pd.Series([own[i][0] for i in keep], dtype="Int64"),
                "n_chars": [len(texts[i]) for i in keep],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": [x.tobytes().hex() for x in mine],
                "edited_fingerprint": [x.tobytes().hex() for x in other],
                "near_edited": likeness(mine, other),
                "near_next": likeness(mine, after),
            }
        )

    return rows.select("doc_id", "packed", "halo").mapInPandas(lean(run), RESULT)


def with_near_copies(rows: DataFrame) -> DataFrame:
    """Rows with a fingerprint, and near_id of their class; see :func:`near_copies`."""
    with scratch(rows.sparkSession) as kept:
        rows, uri = materialize(rows, "fingerprints")
        named, named_uri = materialize(near_copies(rows).select("f", "near_id"), "near-ids")
        kept += [uri, named_uri]
    return rows.join(named, F.xxhash64(rows["fingerprint"]) == named["f"]).select(*rows.columns, "near_id")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Whole table ``documents``; see :func:`against_edits`; near_id is the smallest doc_id among near copies, see :func:`near_copies`."""
    return with_near_copies(against_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")))
