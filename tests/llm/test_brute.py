"""Votes, evidence and the pipeline's stages against plain Python from their definitions, and very long texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe, language, line_dedup, ngram_lm, packing, quality, simhash
from tidemark.llm.quality import features

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
WORDS = {"en": "the of and that with this from have".split(), "de": "der die und nicht mit von auch sich".split(), "fr": "le les des que pour dans une sur".split()}


def prose(seed, n=60, lang="en"):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") for _ in range(n)).capitalize() + "."


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


# --- op 3 -----------------------------------------------------------------------------------------------------------
def voted(model, text):
    """The vote for one text, cosine by cosine."""
    x = (features([text or ""])[0].astype(float) * model.idf - model.mean) @ model.axes.astype(float)
    size = math.sqrt(sum(v * v for v in x))
    found = []
    for vector, label in zip(model.vectors.tolist(), model.labels.tolist()):
        found.append((sum(a * b for a, b in zip(x.tolist(), vector)) / max(size, 1e-12), label))
    found.sort(key=lambda f: -f[0])
    weights = [(max(c, 1e-3) ** quality.SHARPNESS, label) for c, label in found[: quality.NEIGHBOURS]]
    return sum(w * y for w, y in weights) / sum(w for w, _ in weights)


def quality_rows():
    rows, labels = [], []
    for i in range(240):
        t = prose(i, 10 + i % 50, "en" if i % 2 else "de")
        if i % 3 == 0:
            t = " ".join(w + ("$$$" if i % 2 else "###") for w in t.split())
        rows.append((i, t, "en" if i % 2 else "de", "a"))
        labels.append((i, int(i % 3 != 0), 0))
    return [*rows, (900, None, None, None), (901, "", None, None), (902, "x" * 2_000_000, None, None)], labels


def test_votes_are_exact(spark):
    rows, labels = quality_rows()
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known)
    got = {r.doc_id: r.score for r in quality.classify(docs, known).collect()}
    for i, t, *_ in rows:
        assert math.isclose(got[i], voted(model, t), abs_tol=2e-3), i
    few = quality.Model.fit(features(["a b", "c"]), np.array([1.0, 0.0]))  # fewer labelled rows than neighbours
    assert math.isclose(few.score(features(["a c d"]))[0], voted(few, "a c d"), abs_tol=1e-4)


# --- op 5 -----------------------------------------------------------------------------------------------------------
def grams(text):
    letters = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    letters = " " + " ".join(letters.split()) + " " if letters.split() else "  "
    raw = f" {language._SPACES.sub(' ', (text or '').lower())} "
    assert raw.split() == letters.split()
    top = (1 << 64) - 1
    out = []
    for a, b, c in zip(raw, raw[1:], raw[2:]) if len(raw) >= 5 else ():
        x = (ord(a) * 0x9E3779B97F4A7C15 & top) ^ (ord(b) * 0xC2B2AE3D27D4EB4F & top) ^ (ord(c) * 0x165667B19E3779F9 & top)
        out.append((x * 0x9E3779B97F4A7C15 & top) >> 50)
    return out


def identified(rows):
    """``(lang, posterior, accepted)`` of each row of (text, declared, host), by the definitions."""
    names = sorted({d for _, d, _ in rows if d})
    counts = {name: Counter() for name in names}
    for text, declared, _ in rows:
        if declared:
            counts[declared].update(grams(text))
    log_p = {}
    for name, c in counts.items():
        total = sum(c.values()) + language.PSEUDO * language.BUCKETS
        log_p[name] = lambda g, c=c, total=total: math.log((c[g] + language.PSEUDO) / total)
    likes = [[sum(log_p[name](g) for g in grams(text)) for name in names] for text, _, _ in rows]
    best = [max(range(len(names)), key=lambda k: like[k]) if grams(text) else -1 for (text, _, _), like in zip(rows, likes)]
    totals = [best.count(k) for k in range(len(names))]
    corpus = [(x + 1) / (sum(totals) + len(names)) for x in totals]
    suffix = lambda host: host.rsplit(".", 1)[1] if host and "." in host else None
    domain = lambda host: ".".join(host.split(".")[-2:]) if host else None
    by = {kind: defaultdict(lambda: [0] * len(names)) for kind in ("declared", "suffix", "domain", "host")}
    for (_, declared, host), b in zip(rows, best):
        if b >= 0:
            for kind, value in (("declared", declared), ("suffix", suffix(host)), ("domain", domain(host)), ("host", host)):
                if value is not None:
                    by[kind][value][b] += 1
    lean = lambda n, above: [(x + language.LEAN * p) / (sum(n) + language.LEAN) for x, p in zip(n, above)]
    out = []
    for (text, declared, host), like in zip(rows, likes):
        score = [language.TEMPER * x for x in like]
        for kind, value in (("declared", declared), ("suffix", suffix(host))):
            if value in by[kind]:
                score = [s + math.log((x + 0.5) / (t + 10)) for s, x, t in zip(score, by[kind][value], totals)]
        prior = lean(by["host"][host], lean(by["domain"][domain(host)], corpus)) if host in by["host"] else corpus
        score = [s + math.log(p) for s, p in zip(score, prior)]
        top = max(range(len(names)), key=lambda k: score[k])
        sure = 1 / sum(math.exp(s - score[top]) for s in score)
        loss = -max(like) - len(grams(text)) * math.log(language.BUCKETS)
        out.append((names[top], sure, sure >= language.MIN_POSTERIOR and loss <= language.MAX_LOSS))
    return out


def language_rows():
    rng = random.Random(4)
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        host = rng.choice([f"www.site{i % 4}.{lang}", f"news.site{i % 2}.com", "localhost", None])
        rows.append((i, prose(i, rng.choice([1, 4, 30]), lang), rng.choice([lang, lang, None, "de"]), host))
    return [*rows, (200, None, "en", "www.site1.en"), (201, "", None, None), (202, "12 34 !", "fr", "x.fr"), (203, "ﾊﾟ世界 ñ", None, "site1.com"), (203, "die und", "de", "site1.com")]


def test_evidence_is_fused_as_defined(spark):
    rows = language_rows()
    found = language.identify(language.from_documents(table(spark, rows))).collect()
    got = Counter((r.doc_id, r.lang, round(r.posterior, 6), r.accepted) for r in found)
    want = identified([(t, d, h) for _, t, d, h in rows])
    assert got == Counter((i, lang, round(sure, 6), ok) for (i, *_), (lang, sure, ok) in zip(rows, want))


# --- stages against brute force ------------------------------------------------------------------------------------------
def deduped(rows):
    """Texts after line dedup: later occurrences of three lines go."""
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0], r[1]))
    first, gone = {}, defaultdict(set)
    for i, t in order:
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in first:
                gone[i, t] |= {k, k + 1, k + 2}
            else:
                first[window] = (i, t, k)
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in rows]


def test_pipeline_against_brute_force(spark, tmp_path):
    from test_similar import kept_brute

    rng = random.Random(6)
    rows, labels = [], []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        t = "\n".join(prose(100 * i + k, 14, lang) for k in range(4))
        if i % 5 == 0:
            t = " ".join(w + "$$$" for w in t.split())
        labels.append((i, int(i % 5 != 0), 0))
        rows.append((i, t, lang, f"www.site{i % 4}.{lang}"))
    passage = "\n".join(prose(9000 + k, 20) for k in range(4))
    rows += [(200 + i, "\n".join(prose(7000 + 10 * i + k, 12) for k in range(3)) + "\n" + passage, "en", "a.com") for i in range(4)]
    for i in (1, 2, 4, 7):  # exact and near copies
        rows.append((300 + i, rows[i][1], rows[i][2], "b.com"))
        words = rows[i][1].replace("\n", " ").split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((400 + i, " ".join(words), rows[i][2], "b.com"))
    rows += [(500, "", "en", "a.com"), (501, None, "en", "a.com")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(str(tmp_path / "labels.parquet"))
    docs, of = spark.read.parquet(str(tmp_path / "documents.parquet")), {i: (lang, src) for i, _, lang, src in rows}

    def apply(name, docs):
        STAGES[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    now = [(i, t) for i, t, *_ in rows]
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    model = quality.fit(docs, known)
    docs, now = apply("quality", docs), [(i, t) for i, t in now if voted(model, t) >= quality.THRESHOLD]
    assert read(docs) == sorted(now, key=str) and {i for i, _ in now} == {i for i, *_ in rows if i >= 90 or i % 5}
    said = identified([(t, *of[i]) for i, t in now])
    docs, now = apply("language", docs), [r for r, (_, _, ok) in zip(now, said) if ok]
    assert read(docs) == sorted(now, key=str)
    docs, now = apply("line_dedup", docs), deduped(now)
    assert read(docs) == sorted(now, key=str)
    kept = kept_brute(now)
    docs, now = apply("near_dedup", docs), [r for r in now if r[0] in kept]
    assert read(docs) == sorted(now, key=str)
    e = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(bpe.vocabulary_path())))
    want = Counter()
    for (i, _), ids in zip(now, e.encode([t or "" for _, t in now])):
        ids += (2).to_bytes(4, "little")
        at, n = 0, len(ids) // 4
        for k, size in enumerate(([n % 1024] if n % 1024 else []) + [1024] * (n // 1024)):
            want[i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])] += 1
            at += size
    out = apply("packing", docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == Counter((i, k, c) for i, k, _, _, c in want.elements())


# --- very long texts -----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(52_000))
    assert len(text) > 4_900_000
    return text, table(spark, [(1, text, "en", "a.com"), (2, text + " end", "en", "a.com"), (3, "short text here", "en", "a.com"), (4, None, None, None)])


def test_long_texts(spark, long_docs):
    text, docs = long_docs
    assert {r.doc_id for r in STAGES["near_dedup"](spark, docs, "").select("doc_id").collect()} == {1, 3, 4}
    named = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert named[1] == named[2] == 1 and named[3] == 3
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed").collect()}
    assert lines[1] == (52_000, 0) and lines[2] == (52_000, 51_999)
    known = language.identify(language.from_documents(docs))
    assert known.where("accepted").count() >= 3
    scored = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.train(docs)).collect()}
    assert scored[1].n_tokens == 12 * 52_000 + 1 == scored[1].n_known
    pieces = packing.pack_documents(docs.where("doc_id <> 2"), bpe.vocabulary_path())
    sums = {r.doc_id: r["sum(length)"] for r in pieces.groupBy("doc_id").sum("length").collect()}
    (ids,) = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(bpe.vocabulary_path()))).encode([text])
    assert sums[1] == len(ids) // 4 + 1 and sums[4] == 1
