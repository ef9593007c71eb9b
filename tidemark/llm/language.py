"""Language identification by fusing text, markup, address and host evidence.

Log-likelihoods of a text under each language come from hashed letter trigrams, counted over all documents
with a declared language. Declared language and address suffix are read as noisy observations: their
probabilities given each language are counted over the whole corpus, with the language that the text alone
makes likeliest. The prior is that of the host, smoothed towards its domain and that towards the corpus. Text
log-likelihoods are tempered, since neighbouring trigrams are not independent, and all evidence is added up.

Two passes read the texts: one counts, one scores. All else works on a few numbers for each document. Tables by
host and domain are aggregated before any shuffle, written to the shared folder and met by sort-merge joins,
so a host with a third of all rows is split by Spark. All declared languages are told apart, however rare: their
log-probabilities lie in the shared folder in blocks of ``BLOCK`` languages, of which the driver holds one at a time
and a worker ``HELD``. What is collected or broadcast has a few numbers for each language.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memory import lean, slices
from tidemark.session import materialize, new_folder, open_shared

#: Languages of a block of trigram tables, hashed trigrams, and blocks (of 8 MB) that a worker holds.
BLOCK, BUCKETS, HELD = 64, 1 << 14, 8
#: Weight of a trigram's log-likelihood, pseudo-count of a trigram, rows by which a prior leans on the one above.
TEMPER, PSEUDO, LEAN = 0.2, 0.5, 20.0
#: A document is accepted with this posterior, unless uniform text explains its trigrams better by so many nats.
MIN_POSTERIOR, MAX_LOSS = 0.5, 100.0

_LANG = re.compile(r"<html[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})|http-equiv=[\"']content-language[\"'][^>]*content=[\"']([A-Za-z]{2,3})", re.I)
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_SPACES = re.compile(r"[\W\d_]+")


def markup_language(page: str) -> str | None:
    """Language that a page declares, two or three letters in lower case."""
    found = _LANG.search(page)
    return (found[1] or found[2]).lower() if found else None


def visible_text(page: str) -> str:
    return html_lib.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of a whole text's letters, all else being one space."""
    codes = np.frombuffer(f" {_SPACES.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < 5:
        return np.zeros(0, dtype=np.int32)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int32)


def from_documents(docs: DataFrame) -> DataFrame:
    """``documents``: lang is the declared language, source the host."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.xxhash64(text).alias("h"), text.alias("text"), F.lower(F.trim(F.col("lang").cast("string"))).alias("declared"), F.col("source").cast("string").alias("host"), F.lit(False).alias("markup"))


def from_pages(pages: DataFrame) -> DataFrame:
    """``pages``: the declared language is in the markup, the host in the address."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    text = F.col("html").cast("string")
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.xxhash64(text).alias("h"), text.alias("text"), F.lit(None).cast("string").alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.lit(True).alias("markup"))


def _read(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, str | None]]:
    for text, declared, markup in zip(pdf["text"], pdf["declared"], pdf["markup"]):
        text = text or ""
        yield trigrams(visible_text(text) if markup else text), markup_language(text) if markup else declared


def _count(rows: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all rows with a declared language, summed by each task first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in parts:
            for grams, lang in _read(pdf):
                if lang:
                    if lang not in sums:
                        if len(sums) > 4 * BLOCK:  # odd declarations do not fill memory
                            yield from flush(sums)
                        sums[lang] = np.zeros(BUCKETS + 1, dtype=np.int64)
                    sums[lang][:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                    sums[lang][BUCKETS] += 1
        yield from flush(sums)

    def flush(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})
        sums.clear()

    return rows.select("text", "declared", "markup").mapInPandas(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Trigram counts, a row for each language, to smoothed log-probabilities, a column for each."""
    smooth = counts + PSEUDO
    return np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T, dtype=np.float64)


class TextModel:
    """All languages, and the files of log-probabilities of trigrams, each of a block of languages."""

    def __init__(self, languages: list[str], blocks: list[str]):
        self.languages, self.blocks = languages, blocks
        self._held: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "blocks": self.blocks, "_held": {}}

    def _logs(self, block: str) -> np.ndarray:
        """A block's table; the first ``HELD`` that were asked for stay, others are read each time."""
        if block in self._held:
            return self._held[block]
        with open_shared(block, "rb") as f:
            logs = np.frombuffer(f.read(), dtype="<f8").reshape(BUCKETS, -1)
        if len(self._held) < HELD:
            self._held[block] = logs
        return logs

    def likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row for each text's trigrams, a column for each language."""
        found = [np.unique(grams, return_counts=True) for grams in texts]
        parts = [np.array([n @ logs[at] for at, n in found]).reshape(len(texts), logs.shape[1]) for logs in map(self._logs, self.blocks)]
        return np.concatenate(parts, axis=1)


def learn(rows: DataFrame) -> TextModel:
    counts, _ = materialize(_count(rows), "trigrams")
    languages = sorted(r.lang for r in counts.where(F.col("bucket") == BUCKETS).select("lang").collect())
    folder, blocks = new_folder(rows.sparkSession, "languages"), []
    for start in range(0, len(languages), BLOCK):
        own = languages[start : start + BLOCK]
        table, at = np.zeros((len(own), BUCKETS)), {lang: i for i, lang in enumerate(own)}
        for r in counts.where(F.col("lang").isin(own) & (F.col("bucket") < BUCKETS)).toLocalIterator():
            table[at[r.lang], r.bucket] = r.n
        blocks.append(f"{folder}/{start}.f8")
        with open_shared(blocks[-1], "wb") as f:
            f.write(log_probabilities(table).astype("<f8").tobytes())
    return TextModel(languages, blocks)


def _text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (own for part in parts for own in slices(part)):
            got = list(_read(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "page_id": pdf["page_id"].astype("Int64"), "h": pdf["h"], "host": pdf["host"], "declared": [x[1] for x in got], "n_trigrams": [len(x[0]) for x in got], "likelihoods": list(shared.value.likelihoods([x[0] for x in got]))})

    return rows.mapInPandas(lean(run), "doc_id long, page_id long, h long, host string, declared string, n_trigrams long, likelihoods array<double>")


def _counts(scored: DataFrame, key: str, size: int) -> DataFrame:
    """For each value of ``key`` how many rows the text alone gives to each language."""
    found = scored.where(F.col(key).isNotNull() & (F.col("best") >= 0)).groupBy(key, "best").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_language = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"))  # an entry for each language at most
    return by_language.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("n"))


def _log_of(values: Column) -> Column:
    return F.transform(values, lambda x: F.log(x))


def identify(rows: DataFrame) -> DataFrame:
    """Rows of :func:`from_documents` and :func:`from_pages` to doc_id, page_id, h, declared, text_lang, lang, posterior, n_trigrams, accepted.

    A document without letters is judged by its other evidence; missing evidence says nothing. A table without
    any declared language has lang null and nothing accepted. Null texts count as empty. One row for each row.
    """
    model = learn(rows)
    size = len(model.languages)
    if not size:
        null = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", "h", "declared", null.alias("text_lang"), null.alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("accepted"))
    names = F.array(*map(F.lit, model.languages))
    best = F.when(F.col("n_trigrams") > 0, F.array_position("likelihoods", F.array_max("likelihoods")).cast("int") - 1).otherwise(F.lit(-1))
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1))
    domain = F.coalesce(F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)), F.col("host"))
    scored = _text_scores(rows, model).withColumns({"best": best, "suffix": suffix, "domain": domain})
    scored, _ = materialize(scored, "language-scores")

    totals = np.zeros(size)
    for r in scored.where("best >= 0").groupBy("best").count().collect():
        totals[r["best"]] = r["count"]
    corpus = (totals + 1) / (totals.sum() + size)
    as_array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    lean = lambda n, above: F.zip_with(n, above, lambda x, p: (x + LEAN * p) / (F.aggregate(n, F.lit(0.0), lambda s, y: s + y) + LEAN))
    # P(observed value | language): counted with a pseudo-count, so that a value never rules a language out
    given = lambda n: F.zip_with(n, as_array(totals), lambda x, t: (x + 0.5) / (t + 10.0))

    declared, _ = materialize(_counts(scored, "declared", size).select(F.col("declared").alias("declared_k"), _log_of(given(F.col("n"))).alias("by_declared")), "declared")
    suffixes, _ = materialize(_counts(scored, "suffix", size).select(F.col("suffix").alias("suffix_k"), _log_of(given(F.col("n"))).alias("by_suffix")), "suffixes")
    domains = _counts(scored, "domain", size).select(F.col("domain").alias("domain_k"), lean(F.col("n"), as_array(corpus)).alias("of_domain"))
    hosts = _counts(scored.withColumn("place", F.struct("host", "domain")), "place", size).where("place.host is not null")
    hosts = hosts.select(F.col("place.host").alias("host_k"), F.col("place.domain").alias("domain_k"), "n").join(domains, "domain_k")
    hosts, _ = materialize(hosts.select("host_k", _log_of(lean(F.col("n"), F.col("of_domain"))).alias("by_host")), "hosts")

    all_evidence = scored.join(declared, scored["declared"] == declared["declared_k"], "left").join(suffixes, F.col("suffix") == F.col("suffix_k"), "left").join(hosts, F.col("host") == F.col("host_k"), "left")
    zero = as_array(np.zeros(size))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(F.transform("likelihoods", lambda x: x * TEMPER), F.coalesce("by_declared", zero)), add(F.coalesce("by_suffix", zero), F.coalesce("by_host", _log_of(as_array(corpus)))))
    fused = all_evidence.withColumn("total", total).withColumn("top", F.array_max("total"))
    sure = 1.0 / F.aggregate(F.transform("total", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda s, y: s + y)
    loss = -F.array_max("likelihoods") - F.col("n_trigrams") * math.log(BUCKETS)
    return fused.select(
        "doc_id",
        "page_id",
        "h",
        "declared",
        F.when(F.col("best") >= 0, F.get(names, F.col("best"))).alias("text_lang"),
        F.get(names, F.array_position("total", F.col("top")).cast("int") - 1).alias("lang"),
        sure.alias("posterior"),
        "n_trigrams",
        ((sure >= MIN_POSTERIOR) & (loss <= MAX_LOSS)).alias("accepted"),
    )


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Whole tables ``documents`` and ``pages``: one row for each document (doc_id) and each page (page_id)."""
    rows = from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).unionByName(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return identify(rows).drop("h")


def keep_known(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is accepted; texts stay in place unless many are rejected."""
    gone, _ = materialize(identify(from_documents(docs)).where(~F.col("accepted")).select(F.col("doc_id").alias("_lang_id"), F.col("h").alias("_lang_h")).distinct(), "rejected")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_lang_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_lang_h"))
    return docs.join(gone, same, "left_anti")
