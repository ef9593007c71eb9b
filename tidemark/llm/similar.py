"""Near-dedup by SimHash, completed to all links of a Jaccard similarity of whole texts' word shingles.

Two texts are linked if their sets of shingles of ``WORDS`` words (hashed to 64 bits) have a similarity of
``SHARE`` or more. Equal sets form one class before the search. Candidates come from two sources, and every one
is verified on whole texts:

- SimHash fingerprints of the same shingles that differ in at most ``simhash.MAX_BITS`` bits, found by the
  generalised pigeonhole search. A similarity of 0.8 is about ten differing bits of 64, where no partition of the
  bits is selective, so this alone would lose most links.
- prefix filtering for all others: with shingles in one order for all texts, two such sets share a shingle among
  the first n - ceil(share n) + 1 of each. The order puts shingles that are frequent in a bounded sample
  (``SAMPLE``) last; it decides only the cost, never the result.

Before texts meet, pairs are tested on bitmaps that hold the parity of how many of a set's hashes fall on each bit:
two sets differ in at least as many hashes as their bitmaps in bits, so the test loses no similar pair.

Each fingerprint and each shared shingle links its texts to one of them; of the pairs left only those across the
groups found so far are compared, so a large group of near copies costs a link each while every pair that could
join two groups is still verified.

Tables written on the way are dropped once the next ones stand, and the stage's jobs drop their shuffle files: at
any time the disk holds what one job shuffles and the tables still to be read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.memory import lean, slices
from tidemark.session import drop_folder, freed_shuffles, materialize, scratch

#: Words of a shingle, and the least similarity as a fraction (numerator, denominator).
WORDS, SHARE = 5, (4, 5)
#: Texts from which frequent shingles are found, and how many of those are kept in mind.
SAMPLE, FREQUENT = 8192, 50_000
#: Words of 64 bits of a set's parity bitmap, and how many of its folded form.
PARITY, FOLDED = 16, 4


def shingle_hashes(text: str | None, words_each: int = WORDS) -> np.ndarray:
    """Hashes of a whole text's shingles in order, repeats included; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(words_each, len(words))
    mixed = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(mixed)]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def shingle_set(text: str | None, words_each: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    return np.unique(shingle_hashes(text, words_each))


def parity(hashes: np.ndarray) -> np.ndarray:
    """A set's bitmap of 64 * ``PARITY`` bits."""
    odd = np.bincount((hashes >> np.uint64(40) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _text(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _frequent(texts: DataFrame, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several texts of a sample have, sorted, and the binary logarithm of how many have each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (own for part in parts for own in slices(part)):
            sets = [shingle_set(t, words_each) for t in pdf["text"]]
            yield pd.DataFrame({"token": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)})

    step = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod("h", F.lit(step)) == 0).select("text")
    seen = some.mapInPandas(lean(run), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = seen.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens = found["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(found["n"].to_numpy(dtype=np.float64)[order]).astype(np.int64)


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], share: tuple[int, int] = SHARE) -> np.ndarray:
    """The first of a set's hashes in the common order, of which similar sets share one."""
    n = len(hashes)
    if not n:
        return hashes
    known, level = frequent
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    place = np.where(known[at] == hashes, level[at], 0) if len(known) else np.zeros(n, dtype=np.int64)
    return hashes[np.lexsort((hashes, place))][: n - -(-share[0] * n // share[1]) + 1]


def _classes(texts: DataFrame, words_each: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cls, n, rep, h, fp, bits)``, one row for each distinct set, ``(token, cls, n, pos, pivot)``, one for each shingle of a prefix that several have, and ``(doc_id, h, cls)``, one for each row.

    rep is the smallest (doc_id, hash of its text) of the class, null if all ids are null; h the hash of one text.
    pivot is the smallest class with the shingle.
    """
    spark = texts.sparkSession
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, words_each))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (own for part in parts for own in slices(part)):
            hashes = [shingle_hashes(t, words_each) for t in pdf["text"]]
            fps = np.array([simhash.of_hashes(x) for x in hashes], dtype=np.uint64).view(np.int64)
            sets = [np.unique(x) for x in hashes]
            names = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "h": pdf["h"], "cls": names, "n": np.array([len(s) for s in sets], np.int32), "fp": fps, "bits": [parity(s) for s in sets], "tokens": [prefix(s, shared.value, share).view(np.int64) for s in sets]})

    found, found_uri = materialize(texts.mapInPandas(lean(run), "doc_id long, h long, cls long, n int, fp long, bits array<long>, tokens array<long>"), "shingles")
    rep = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("rep")
    # size, bitmap and tokens follow from the set: any row of the class has them
    wide = found.groupBy("cls").agg(F.first("n").alias("n"), rep, F.min("h").alias("h"), F.min("fp").alias("fp"), F.first("bits").alias("bits"), F.first("tokens").alias("tokens"))
    wide, wide_uri = materialize(wide, "shingle-classes")
    rows, _ = materialize(found.select("doc_id", "h", "cls"), "shingle-rows")
    drop_folder(spark, found_uri)
    postings = wide.select("cls", "n", F.posexplode("tokens").alias("pos", "token"))
    pivots = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("cls").alias("pivot")).where("k > 1").drop("k")
    pivots, pivots_uri = materialize(pivots, "pivots")
    postings, _ = materialize(postings.join(pivots, "token"), "shared-shingles")
    drop_folder(spark, pivots_uri)
    classes, _ = materialize(wide.drop("tokens"), "similar-classes")
    drop_folder(spark, wide_uri)
    return classes, postings, rows


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """``(cls, cls_2)``: each class and the first of its fingerprint, and the first ones of linked fingerprints."""
    firsts, _ = materialize(classes.groupBy("fp").agg(F.min("cls").alias("pivot")), "fingerprints")
    own = classes.select("fp", "cls").join(firsts, "fp").where("cls <> pivot").select("cls", F.col("pivot").alias("cls_2"))
    other = firsts.select(F.col("fp").alias("fp_2"), F.col("pivot").alias("cls_2"))
    near = simhash.links(firsts.select("fp")).join(firsts, "fp").join(other, "fp_2").select(F.col("pivot").alias("cls"), "cls_2")
    return own.union(near)


def _fits(share: tuple[int, int]):
    """Whether two sets that meet at these places, if for the first time, can still share enough."""
    most = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n_2") - F.col("pos_2") - 1)
    return (share[0] + share[1]) * most >= share[0] * (F.col("n") + F.col("n_2"))


def _may(share: tuple[int, int], words: int, bits: str, bits_2: str):
    """Whether two sets' bitmaps leave room for the similarity: it allows (1 - share) / (1 + share) of both sizes to differ."""
    differ = sum((F.bit_count(F.get(bits, F.lit(i)).bitwiseXOR(F.get(bits_2, F.lit(i)))) for i in range(words)), F.lit(0))
    return (share[0] + share[1]) * differ <= (share[1] - share[0]) * (F.col("n") + F.col("n_2"))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words_each: int, share: tuple[int, int]) -> DataFrame:
    """Of ``(cls, cls_2)`` the pairs whose whole sets are similar, as ``(a, b)``."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for pdf in parts:
            good = []
            for a, t, u in zip(pdf["a"], pdf["text"], pdf["text_2"]):
                if a != last:
                    last, mine = a, shingle_set(t, words_each)
                other = shingle_set(u, words_each)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                good.append((share[0] + share[1]) * both >= share[0] * (len(mine) + len(other)))
            yield pdf.loc[np.array(good, dtype=bool), ["a", "b"]]

    sizes = classes.select("cls", "n", "bits")
    other = sizes.select(*(F.col(c).alias(f"{c}_2") for c in sizes.columns))
    with scratch(classes.sparkSession) as kept:
        pairs, _ = materialize(pairs.join(sizes, "cls").join(other, "cls_2").where(_may(share, PARITY, "bits", "bits_2")).select("cls", "cls_2"), "similar-pairs")
        needed, _ = materialize(pairs.select("cls").union(pairs.select("cls_2")).distinct().join(classes.select("cls", "h"), "cls"), "similar-needed")
        own, _ = materialize(texts.select("h", "text").join(needed, "h").select("cls", "text").dropDuplicates(["cls"]), "similar-texts")
        left = own.select(F.col("cls").alias("a"), "text")
        right = own.select(F.col("cls").alias("b"), F.col("text").alias("text_2"))
        met = pairs.select(F.col("cls").alias("a"), F.col("cls_2").alias("b")).join(right, "b").join(left, "a")
        links, uri = materialize(met.select("a", "b", "text", "text_2").mapInPandas(lean(run), "a long, b long"), "similar-links")
        kept.append(uri)
    return links


def groups(docs: DataFrame, words_each: int = WORDS, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text, ...)`` to ``(cls, rep)``, each distinct set and the smallest (doc_id, hash of its text) reachable over links, and ``(doc_id, h, cls)`` of all rows.

    Texts without words have the empty set and are copies of each other. A component whose ids are all null has
    a null rep. Extra columns are ignored; an empty table gives none.
    """
    texts = _text(docs)
    classes, postings, rows = _classes(texts, words_each, share)

    def other(rows: DataFrame) -> DataFrame:
        return rows.select("token", *(F.col(c).alias(f"{c}_2") for c in rows.columns if c != "token"))

    to_pivot = postings.where("cls <> pivot").join(other(postings.where("cls = pivot").drop("pivot")), "token").where(_fits(share)).select("cls", "cls_2")
    first = _by_fingerprint(classes).union(to_pivot)
    links = _verified(first.select(F.least("cls", "cls_2").alias("cls"), F.greatest("cls", "cls_2").alias("cls_2")).distinct(), classes, texts, words_each, share)

    with scratch(docs.sparkSession) as kept:
        named, _ = materialize(components(links), "similar-components")
        now = postings.drop("pivot").join(named, postings["cls"] == named["vertex"], "left").select("token", "cls", "n", "pos", F.coalesce("component", "cls").alias("label"))
        now, now_uri = materialize(now, "labelled-shingles")
        of_token = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        of_token, _ = materialize(of_token.where("labels > 1").drop("labels"), "main-labels")
        folded = F.transform(F.sequence(F.lit(0), F.lit(FOLDED - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(PARITY // FOLDED - 1)), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get("bits", k * FOLDED + i))))
        now = now.join(of_token, "token").join(classes.select("cls", folded.alias("bits")), "cls")
        now, _ = materialize(now, "open-shingles")  # of shingles that more than one group has
        drop_folder(docs.sparkSession, now_uri)
        # pairs within a token's main group are linked already; all others have a side outside it
        outside = now.where("label <> main")
        met = outside.join(other(now.drop("main")), "token").where((F.col("label") != F.col("label_2")) & ((F.col("label_2") == F.col("main")) | (F.col("cls") < F.col("cls_2"))) & _fits(share) & _may(share, FOLDED, "bits", "bits_2"))
        pairs = met.select(F.least("cls", "cls_2").alias("cls"), F.greatest("cls", "cls_2").alias("cls_2")).distinct()
        links, uri = materialize(links.union(_verified(pairs, classes, texts, words_each, share)), "similar-links")
        kept.append(uri)

    named, _ = materialize(components(links), "similar-components")
    linked = classes.select("cls", "rep").join(named, classes["cls"] == named["vertex"]).select("cls", "rep", "component")
    least, _ = materialize(linked.groupBy("component").agg(F.min("rep").alias("least")), "similar-least")
    moved, _ = materialize(linked.join(least, "component").select("cls", "least"), "similar-named")
    return classes.select("cls", "rep").join(moved, "cls", "left").select("cls", F.coalesce("least", "rep").alias("rep")), rows


def keep_one_of_similar(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest doc_id stays, once.

    Of rows of one doc_id with different texts in one group the one with the smallest hash stays; rows that
    repeat a doc_id and a text are one document, of which the row with the smallest columns stays. Rows without a
    doc_id cannot be named as kept or dropped; they stay. Null texts are without words.
    """
    with scratch(spark) as kept, freed_shuffles(spark):
        named, rows = groups(docs)
        named, _ = materialize(named, "similar-reps")
        own = F.struct("doc_id", "h")
        gone = rows.where("doc_id is not null").join(named, "cls").where(own != F.col("rep"))
        gone, gone_uri = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "similar-gone")
        again, again_uri = materialize(rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).count().where("count > 1").select("_id", "_h"), "similar-again")
        kept += [gone_uri, again_uri]
        id_, h = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
        left = docs.join(gone, (id_ == gone["_id"]) & (h == gone["_h"]), "left_anti")
        if again.isEmpty():
            return left
        same = (id_ == again["_id"]) & (h == again["_h"])
        once = left.join(again, same, "left_semi").groupBy(id_.alias("_id"), h.alias("_h")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
        return left.join(again, same, "left_anti").select(*docs.columns).union(once.select("_row.*"))
