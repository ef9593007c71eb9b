"""Fingerprints, BPE, quality, language and line dedup on small tables with every awkward case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as spark_f

from tidemark.llm import bpe, edit_embedding, language, line_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string"


def table(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "own", "own") for i, t, lang, src in rows], SCHEMA)


WORDS = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("n", "rk", "st", "b", "vel", "x")]


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


# --- op 1 -----------------------------------------------------------------------------------------------------------
def test_fingerprints_follow_edits(spark):
    rng = random.Random(3)
    texts = [prose(i, 150) for i in range(40)]
    w = edit_embedding.walker()
    fps = w.fingerprints(texts)
    assert (fps == w.fingerprints(texts[::-1])[::-1]).all()  # whatever stands beside a text

    def edit(t, k):
        words = t.split(" ")
        for _ in range(k):
            words[rng.randrange(len(words))] = "zzz"
        return " ".join(words)

    one, ten = (w.fingerprints([edit(t, k) for t in texts]) for k in (1, 10))
    near = [float(np.mean(edit_embedding.likeness(fps, x))) for x in (fps, one, ten, np.roll(fps, 1, axis=0))]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] and near[1] > 0.6 and near[3] < 0.25


def test_against_edits_brute(spark):
    rows = [(5, "beta " * 30, "en", "a"), (1, None, "en", "a"), (3, "alpha gamma " * 9, "en", "a"), (9, "x", "en", "a"), (7, "", "en", "a"), (3, "alpha gamma " * 9, "en", "a"), (11, "ünï " * 400, "en", "a"), (None, "no id", "en", "a")]
    got = edit_embedding.against_edits(table(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = []
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        f, e, n = edit_embedding.walker().fingerprints([t, edited, texts[(i + 1) % len(texts)]])
        like = lambda a, b: float(edit_embedding.likeness(a[None], b[None])[0])
        want.append((order[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), f.tobytes().hex(), e.tobytes().hex(), like(f, e), like(f, n)))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert edit_embedding.against_edits(table(spark, rows).limit(0)).count() == 0
    assert edit_embedding.against_edits(table(spark, rows[:1])).count() == 1


def walked(text, w, walker):
    """One walk of a text, character by character, from the definition."""
    classes = [((ord(c) * 2654435761 % (1 << 32)) >> 16) % 255 + 1 for c in text] + [0]
    place = step = 0
    met = {}
    wanted = set(np.concatenate(walker.records[w]).tolist())
    check, ended = 1, 0
    while True:
        if step == check:
            if classes[place] == 0:
                ended = step
                break
            check = step + 1 + step // 32
        if step in wanted:
            met[step] = classes[place]
        place += int(walker.moves[w][step % edit_embedding.PERIOD][classes[place]])
        step += 1
    out = []
    for k, records in enumerate(walker.records[w]):
        last = max(r for r in records.tolist() if r < max(ended, 1))
        out.append(int(walker.letters[w][k][met[last]]))
    return out


def test_fingerprints_are_walks(spark):
    walker = edit_embedding.walker()
    rng = random.Random(9)
    texts = ["", "a", "é" * 40, "ab" * 300, prose(4, 120), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(700)), *(prose(i, 3 + i) for i in range(30))]
    got = walker.fingerprints(texts)  # side by side, then alone
    for t, bits in zip(texts, got):
        want = [b for w in range(edit_embedding.WALKS) for b in walked(t, w, walker)]
        assert np.unpackbits(bits).tolist() == want, t[:20]


def test_hot_id_is_cut_inside(spark):
    """A third of all rows have one id; their next documents follow the order of hashes."""
    rows = [(7, prose(i, 5), "en", "a") for i in range(200)] + [(100 + i, prose(1000 + i, 4), "en", "a") for i in range(400)]
    dealt = edit_embedding.with_next(table(spark, rows), 12).where("halo = 0")
    assert dealt.groupBy("range").count().agg({"count": "max"}).first()[0] <= 120
    got = {r.edited_sha256 for r in edit_embedding.against_edits(table(spark, rows)).collect()}
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(rows, key=lambda r: (r[0], signed(xxh64_intdigest(r[1].encode(), seed=42))))
    want = set()
    for a, b in zip(order, [*order[1:], order[0]]):
        q = len(a[1]) // 4
        want.add(hashlib.sha256((a[1][: len(a[1]) - q] + b[1][:q]).encode()).hexdigest())
    assert got == want


def test_very_long_text(spark):
    long = "lorem ipsum dolor " * 70_000
    (row,) = (r for r in edit_embedding.against_edits(table(spark, [(1, long, "en", "a"), (2, "x", "en", "a")])).collect() if r.doc_id == 1)
    assert row.n_chars == len(long) and len(row.fingerprint) == 128 and 0 <= row.near_edited <= 1


def test_near_copies(spark):
    texts = [prose(i, 200) for i in range(12)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(100, texts[0], "en", "a"), (101, texts[1][:-9] + "changed.", "en", "a"), (102, None, "en", "a"), (103, "", "en", "a"), (None, texts[2], "en", "a"), (None, "alone", "en", "a"), (4, texts[4], "en", "a")]
    got = edit_embedding.with_near_copies(edit_embedding.against_edits(table(spark, rows))).collect()
    assert len(got) == len(rows)
    near = {}
    for r in got:
        near.setdefault(r.doc_id, set()).add(r.near_id)
    assert near.pop(None) == {2, None}
    assert near == {**{i: {i} for i in range(12)}, 100: {0}, 101: {1}, 102: {102}, 103: {102}}
    assert edit_embedding.near_copies(edit_embedding.fingerprints(table(spark, rows).limit(0))).count() == 0


def test_near_copies_find_nearly_all_pairs(spark):
    """Classes against all pairs of fingerprints that are just like enough or more."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (150, 64), dtype=np.uint8)
    flip = lambda x, n: x ^ np.packbits(np.isin(np.arange(512), rng.choice(512, n, replace=False)))
    near = [flip(b, int(n)) for b, n in zip(base, rng.integers(30, 52, 150))]
    family = [flip(base[0], 20) for _ in range(60)]  # one large group, linked pair by pair
    every = np.array([*base, *near, *family])
    table = spark.createDataFrame([(i, x.tobytes().hex()) for i, x in enumerate(every)] + [(900, None)], "doc_id long, fingerprint string")
    got = table.join(edit_embedding.near_copies(table), spark_f.xxhash64("fingerprint") == spark_f.col("f")).collect()
    of = {r.doc_id: r.near_id for r in got}
    like = edit_embedding.likeness
    pairs = [(i, j) for i in range(len(every)) for j in range(i) if like(every[i][None], every[j][None])[0] >= 0.8]
    assert len(of) == len(every) and sum(of[i] == of[j] for i, j in pairs) >= 0.9 * len(pairs) and len(pairs) > 150
    linked = set(pairs)
    assert all(of[i] == i or any((i, j) in linked or (j, i) in linked for j in range(len(every))) for i in of)  # nothing else is joined


# --- op 2 -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_is_the_librarys(spark, reference):
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "'s", "'LL", "a", "aaaa", "é", "the", "12", "…", "\x1c", "　", "½", "日本", "!!", "💡"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "aaaa" * 3000, prose(1, 3000)]
    rows = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)] + [(7, texts[7], "en", "a"), (None, "x", None, None)])
    got = {r.doc_id: r for r in bpe.round_trip(rows, bpe.vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        back = reference.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), repr(t)
    assert got[None].n_tokens == 1 and bpe.round_trip(rows, bpe.vocabulary_path()).count() == len(texts) + 2
    back = bpe.decode(bpe.encode(rows, bpe.vocabulary_path()), bpe.vocabulary_path())
    assert {r.doc_id: r.text for r in back.collect()}[400] == ""


def test_bpe_on_all_characters(reference):
    e = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(bpe.vocabulary_path())))
    points = [c for c in [*range(0x3100), *range(0xFE00, 0x10500)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} .{chr(c)}\n {chr(c)}  x" for c in points]
    want = [np.array(x.ids, "<u4").tobytes() for x in reference.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want


def test_bpe_refuses_what_it_does_not_do():
    import json

    raw = bpe.read_vocabulary(bpe.vocabulary_path())
    for change in (
        lambda s: s.update(normalizer={"type": "NFC"}),
        lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
        lambda s: s["model"].update(ignore_merges=True),
        lambda s: s["model"].update(end_of_word_suffix="</w>"),
        lambda s: s["added_tokens"][0].update(lstrip=True),
        lambda s: s.update(decoder=None),
    ):
        spec = json.loads(raw)
        change(spec)
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec).encode())


def test_bpe_memo_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMO", 5)
    e = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(bpe.vocabulary_path())))
    for k in range(8):
        texts = [prose(10 * k + i, 12) for i in range(4)]
        want = [np.array(x.ids, "<u4").tobytes() for x in reference.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts) == want == e.encode(texts)


# --- op 3 -----------------------------------------------------------------------------------------------------------
def test_quality_separates_held_out(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        t = prose(i)
        if bad:
            t = " ".join(f"{w}{'%%%' if i % 4 < 2 else '$$$'}" for w in t.split())
        rows.append((i, t, "en", "a"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, None, None), (901, "", None, None), (None, "word", None, None), (5, rows[5][1], "en", "a")]
    labels += [(None, 1, 0), (2, None, 0), (4, 7, 0), (6, 1, 0), (6, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 300 and r.predicted != int(r.doc_id % 3 != 0)]
    assert not wrong
    none = quality.classify(table(spark, rows), lab.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(table(spark, rows).limit(0), lab).count() == 0


def test_quality_never_sees_held_out_labels(spark):
    rows = [(i, prose(i), "en", "a") for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(table(spark, rows), spark.createDataFrame(x, kind)).collect()) for x in (labels, flipped))
    assert a == b


# --- op 5 -----------------------------------------------------------------------------------------------------------
TONGUES = {"en": "the of and that with this from have".split(), "de": "der die und nicht mit von auch sich".split(), "fr": "le les des que pour dans une sur".split()}


def sentence(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(TONGUES[lang]) for _ in range(n))


def test_language_evidence(spark):
    rows = [(i, sentence(lang := ("en", "de", "fr")[i % 3], i), lang, "host-" + lang) for i in range(90)]
    rows += [(200, sentence("de", 7), "en", "host-en"), (201, None, "fr", "host-fr"), (202, "", None, "host-de"), (203, "12 34", None, None), (None, sentence("en", 1), None, None)]
    pages = spark.createDataFrame(
        [(1, "http://www.x.de/a", f"<html lang='de'><script>var the = 'of the';</script><p>{sentence('de', 3)}</p></html>"), (2, None, None), (3, "https://y.fr:80/", f"<p>{sentence('fr', 5)}</p>")],
        "page_id long, url string, html string",
    )
    both = language.from_documents(table(spark, rows)).unionByName(language.from_pages(pages))
    got = language.identify(both).collect()
    assert len(got) == len(rows) + 3
    docs, found = {r.doc_id: r for r in got if r.page_id is None}, {r.page_id: r for r in got if r.page_id}
    assert all(docs[i].lang == ("en", "de", "fr")[i % 3] and docs[i].accepted for i in range(90))
    assert docs[200].lang == "de"  # long text outweighs its declaration and host
    assert docs[201].lang == "fr" and docs[202].lang == "de"  # without text: declaration and host, host alone
    assert docs[None].lang == "en" and docs[203].posterior > 0
    assert found[1].lang == "de" and found[1].declared == "de" and found[3].lang == "fr" and found[2].lang is not None
    assert abs(sum(1 for r in got if r.posterior is None)) == 0
    empty = language.identify(language.from_documents(table(spark, rows).limit(0)))
    assert empty.count() == 0 and empty.columns == language.identify(both).columns


def test_language_stage_keeps_clean_and_drops_noise(spark):
    rng = random.Random(9)
    rows = [(i, sentence(lang := ("en", "de")[i % 2], i), lang, "h") for i in range(60)]
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(900))
    docs = table(spark, [*rows, (500, noise, None, "h"), (501, None, "en", "h"), (None, rows[0][1], "en", "h")])
    kept = language.keep_known(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([-1, *range(60), 501])


def test_markup():
    assert language.markup_language('<!DOCTYPE html><html class="x" lang="fr-CA">') == "fr"
    assert language.markup_language("<p lang=de>") is None
    assert "track" not in language.visible_text("<p>a<script>track()</script>&amp;b</p>") and "&b" in language.visible_text("&amp;b")


# --- op 6 -----------------------------------------------------------------------------------------------------------
def brute_lines(rows):
    """Rows are (id, text); equal rows are one document."""
    seen, gone = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = (t or "").split("\n")
        if t is None or len(ls) < 3:
            continue
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if w in seen:
                gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
            else:
                seen[w] = (i, p)
    return {(i, t): None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in rows}


def test_line_dedup_brute(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(100, "x\nx\nx\nx\nx"), (101, None), (102, ""), (103, "one"), (104, "a\nb\n\n\n\n"), rows[4], (None, "p\nq\nr\ns"), (105, "p\nq\nr")]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    got = line_dedup.dedup_lines(docs).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append((t, want[i, t]))
    for r in got:
        assert r.text in [w for _, w in ids[r.doc_id]], r
        before = [t for t, w in ids[r.doc_id] if w == r.text][0]
        assert r.n_lines == (0 if before is None else before.count("\n") + 1)
    assert sum(r.n_removed for r in got) > 30 and {r.text for r in got if r.doc_id == 105} == {""}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    stage = line_dedup.dedup_stage(spark, docs, "")
    assert stage.columns == docs.columns and stage.where("n_chars <> length(text)").count() == 0


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(table(spark, [(1, "a\nb\nc", None, None)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
