"""WARC, SimHash, packing, nearest neighbours, language model and pipeline against brute force."""

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from tidemark.llm import bpe, nearest, ngram_lm, packing, simhash, warc
from tidemark.llm.components import components
from tidemark.session import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t), "own", "own") for i, t in rows], DOCS)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi".split()) for _ in range(n))


# --- op 4 -----------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    big = "<p>" + "é%0d" * 30_000
    rows = [(1, "http://a/ü\r\nx", big), (2, None, big), (5, "http://b", "x" * 1000), (3, "http://c", "x" * 1000), (4, "http://d", "short"), (6, "", "short"), (7, "u", None), (8, "u", ""), (9, "u", "y" * 70_000), (9, "u", "y" * 70_000), (None, "u", "z" * 2000), (None, "n", "x" * 1000)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string")
    paths = warc.write_archives(pages, new_folder(spark, "warc"))
    found = warc.read_archives(paths)
    assert found.where("problem is not null").count() == 0
    got = sorted(map(repr, (tuple(r) for r in warc.resolve(found).collect())))
    groups = defaultdict(list)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            groups[h].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(groups.get(h, []), default=None)
        revisit = top is not None and i != top and len(raw) >= 1000
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(map(repr, want))
    texts = [bytes(r.payload).decode() for r in found.where("kind = 'response'").select("payload").collect()]
    assert sorted(texts) == sorted((h or "") for (i, _, h), w in zip(rows, want) if w[3] == "response")
    ids = [r.record_id for r in found.select("record_id").collect()]
    assert len(ids) == len(set(ids)) == len(rows)
    none = warc.read_archives(warc.write_archives(pages.limit(0), new_folder(spark, "warc")))
    assert none.count() == 0


def test_warc_many_equal_rows(spark, monkeypatch):
    """A third of all rows equal, in one piece and in segments, and one payload with many revisits."""
    monkeypatch.setattr(warc, "COPIES", 16)
    rows = [(7, "u", "s" * 70_000)] * 40 + [(None, "u", None)] * 150 + [(8, "v", "t" * 1500)] * 40 + [(i, "w", "r" * 2000) for i in range(100, 220)] + [(900, None, "r" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = warc.read_archives(warc.write_archives(pages, new_folder(spark, "warc")))
    ids = [r.record_id for r in found.select("record_id").collect()]
    assert len(ids) == len(set(ids)) == len(rows) and found.where("problem is not null").count() == 0
    got = Counter(map(tuple, warc.resolve(found).collect()))
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = Counter({(7, 70_000, digest("s" * 70_000), "response", None): 40, (None, 0, digest(""), "response", None): 150, (8, 1500, digest("t" * 1500), "response", None): 40})
    want += Counter({(i, 2000, digest("r" * 2000), "revisit", 900): 1 for i in range(100, 220)}) + Counter({(900, 2000, digest("r" * 2000), "response", None): 1})
    assert got == want


def test_warc_damage(spark):
    raw = b"abc" * 40_000
    digest = hashlib.sha1(raw).hexdigest()
    parts = list(warc.records(1, "u", raw, digest, None))
    assert len(parts) > 2
    kept = {"whole": parts, "gap": [parts[0], *parts[2:]], "cut": parts[:-1]}
    folder = new_folder(spark, "damage")
    for name, records in kept.items():
        path = folder.removeprefix("file://") + f"/{name}.warc.gz"
        with open(path, "wb") as f:
            f.write(b"".join(records[::-1]))  # any order
        paths = spark.createDataFrame([(f"file://{path}",)], "path string")
        (row,) = warc.read_archives(paths).collect()
        assert (row.problem is None) == (name == "whole") and (row.payload is None) != (name == "whole")
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(gzip.decompress(parts[0])[:-100])))
    for broken in (b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc" == warc.unchunked(warc.chunked(b"abc"))


# --- op 7 -----------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", raw) if w]
    if not ws:
        return 0
    shingles = [" ".join(ws)] if len(ws) < 3 else [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hs = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_brute(spark):
    rng = random.Random(4)
    rows = [(i, words(i, 60)) for i in range(40)]
    for k in range(60):  # near copies, some far enough to need a chain
        base = words(k % 6, 300).split()
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = "new"
        rows.append((100 + k, " ".join(base)))
    rows += [(300, None), (301, ""), (302, " \t\x0b "), (303, "ÄB c"), (304, "äb c"), (305, "a b c d"), (300, None), (None, words(1, 60)), (None, "alone text here now")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = sorted({brute_fingerprint(t) for _, t in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        r = root(brute_fingerprint(t))
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (i is not None or least.get(r) is not None) else None
    want = sorted(repr((i, brute_fingerprint(t), least[root(brute_fingerprint(t))])) for i, t in rows)
    assert sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("near", [0, 1, 2, 3])
def test_probes_miss_nothing(near):
    rng = np.random.default_rng(near)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.zeros(300, np.uint64)
    for i in range(300):
        for b in rng.choice(64, near, replace=False):
            flips[i] |= np.uint64(1 << int(b))
    for total in (300, 10**6, 10**10):  # other sizes, other partitions
        plan = simhash.allocate(fps, total)
        assert sum(t + 1 for _, t in plan) == simhash.MAX_BITS + 1
        found = np.zeros(300, bool)
        for mask, t in plan:
            keys = [defaultdict(list) for _ in range(2)]
            for side, x in enumerate((fps, fps ^ flips)):
                for key, rows, k in simhash.probe_keys(x, mask, t):
                    for r, q in zip(rows.tolist(), key.tolist()):
                        keys[side][r].append((q, k))
            for r in range(300):
                found[r] |= any(q == q2 and k + k2 <= t for q, k in keys[0][r] for q2, k2 in keys[1][r])
        assert found.all(), total


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {v: root(v) for v in parent}
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: c for v, c in want.items() if sum(x == c for x in want.values()) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op 8 -----------------------------------------------------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, words(i, rng.randrange(1, 900))) for i in range(300)] + [(400, None), (401, ""), (402, words(1, 5000)), (402, words(1, 5000)), (None, "x y")]
    got = packing.pack_documents(docs(spark, rows), bpe.vocabulary_path()).collect()
    e = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(bpe.vocabulary_path())))
    pieces = Counter()
    for (i, _), ids in zip(rows, e.encode([t or "" for _, t in rows])):
        ids += (2).to_bytes(4, "little")
        n, at = len(ids) // 4, 0
        for k, size in enumerate(([n % 1024] if n % 1024 else []) + [1024] * (n // 1024)):
            pieces[i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])] += 1
            at += size
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by) <= math.ceil(sum(r.length for r in got) / 1024) + 2
    assert packing.pack_documents(docs(spark, rows).limit(0), bpe.vocabulary_path()).count() == 0


def test_local_search_empties_sequences():
    def searched(sizes, bins):
        search = packing.Search(np.array(sizes), bins, 10)
        before = int((search.fill**2).sum())
        search.improve(100)
        assert sorted(i for b in search.bins for i in b) == list(range(len(sizes))) and (search.fill <= 10).all()
        assert int((search.fill**2).sum()) > before
        return sorted(search.fill[search.fill > 0].tolist())

    assert searched([3, 2, 6, 7], [[0, 1], [2], [3]]) == [8, 10]  # moves empty a sequence
    one = packing.Search(np.array([4, 3, 6, 3]), [[0, 1], [2, 3]], 10)
    assert one._step(0, np.array([1])) and sorted(one.fill.tolist()) == [6, 10]  # one for one: 4 against 3
    two = packing.Search(np.array([3, 3, 5, 4]), [[0, 1], [2, 3]], 10)
    assert two._step(0, np.array([1])) and sorted(two.fill.tolist()) == [5, 10]  # two for one: 3 and 3 against 5
    assert not two._step(int(np.argmin(two.fill)), np.array([int(np.argmax(two.fill))]))
    rng = np.random.default_rng(0)
    many = rng.integers(1, 1025, 1500)
    packed = packing.pack(many)
    assert sorted(i for b in packed for i in b) == list(range(1500)) and all(many[b].sum() <= 1024 for b in packed)
    assert len(packed) <= len(packing.best_fit(many, 1024))


# --- op 9 -----------------------------------------------------------------------------------------------------------
def test_nearest_recall_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(0, 8, 900)] + 0.7 * rng.standard_normal((900, 16))).astype(np.float32)
    x[500:560] = x[0]  # copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    bad = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0, None] * 8), (1200, []), (None, rows[1][1]), (1250, [1.0, 2.0]), (3, rows[3][1])]
    table = spark.createDataFrame([(*r, "own") for r in rows + bad], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in nearest.search(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 900, 50):
        s = y @ y[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        hit += len({v for _, v, _ in got[q]} & set(best.tolist()))
        total += 5
        assert [k for k, _, _ in got[q]] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for _, v, c in got[q])
    assert hit / total >= 0.9
    assert [v for _, v, _ in got[0]] == [500, 501, 502, 503, 504]  # ties to smaller ids
    assert not {1000, 1050, 1100, 1150, 1200, 1250} & set(got)
    assert nearest.search(table.limit(0), table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert nearest.search(few, few).count() == 2


def test_nearest_returns_all_candidates_of_small_tables(spark):
    """One table of many lengths: vectors of a length are each other's only candidates."""
    rng = np.random.default_rng(5)
    rows, of = [], defaultdict(list)
    for size in range(8, 40):
        for _ in range(2 + size % 5):
            rows.append((len(rows), rng.standard_normal(size).tolist()))
            of[size].append(rows[-1][0])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(dict)
    for r in nearest.search(table, table).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    for own in of.values():
        for i in own:
            assert sorted(got[i]) == list(range(1, len(own))) and sorted(got[i].values()) == sorted(set(own) - {i})


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_recall(spark, clustered):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 32))
    if clustered:
        x = rng.standard_normal((60, 32))[rng.integers(0, 60, 3000)] + 0.3 * x
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in nearest.search(table, table.where("vec_id % 50 = 0")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(60), np.arange(60) * 50] = -9
    want = {(50 * i, int(j)) for i, row in enumerate(near) for j in np.argsort(-row)[:5]}
    assert len(found) == 300 and len(found & want) >= 270


def test_probes_come_in_order_of_success():
    v = np.random.default_rng(1).standard_normal(16)
    short, long = (nearest.probes(v, 0, 1.0, t) for t in (0.3, 0.9))
    assert len(short) < len(long) and (long[: len(short)] == short).all() and short[0] == nearest.buckets(v[None], 0)[0]


# --- op 10 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("fan, mapped", [(1024, 256), (3, 2)])
def test_kneser_ney_brute(spark, monkeypatch, fan, mapped):
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 2000)  # several shards
    monkeypatch.setattr(ngram_lm, "FAN", fan)  # dealt at once, or in two steps
    monkeypatch.setattr(ngram_lm, "MAPPED", mapped)
    monkeypatch.setattr(ngram_lm, "PAIRS_A_WORD", 1)
    monkeypatch.setattr(ngram_lm, "CHUNK", 500)
    rows = [(i, words(i, 40 + i) + (" Zeta\x0bÉ" if i % 3 else "")) for i in range(60)] + [(70, None), (71, ""), (72, "unseen words only here"), (3, words(3, 43)), (None, "alpha beta")]
    table = docs(spark, rows)
    split = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").split(" ") if w]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count, pair = Counter(), Counter()
    for i, t in rows:
        if not out(i):
            ws = split(t)
            count.update([*ws, "</s>"])
            pair.update(zip(["<s>", *ws], [*ws, "</s>"]))
    before, after = Counter(v for _, v in pair), defaultdict(list)
    for (u, _), n in pair.items():
        after[u].append(n)

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))]

    d = discounts(pair.values())
    low = discounts(before.values()) if all(sum(v == k for v in before.values()) for k in (1, 2, 3)) else [0, 0.5, 0.75, 0.9]
    rest = sum(low[min(v, 3)] for v in before.values()) / len(pair)

    def p(u, v):
        lower = max(before[v] - low[min(before[v], 3)], 0) / len(pair) + rest / (len(count) + 1)
        if u not in after:
            return lower
        n, total = pair[u, v], sum(after[u])
        return max(n - d[min(n, 3)], 0) / total + min(sum(d[min(x, 3)] for x in after[u]) / total, 1) * lower

    model = ngram_lm.train(table.where(~ngram_lm.held_out()))
    assert model.shards > 2 and model.word_shards > 1 and (model.tokens, model.distinct) == (sum(count.values()), len(count))
    got = defaultdict(list)
    for r in ngram_lm.score(table, model).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        ws = split(t)
        r = got[i][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(count[w] > 0 for w in [*ws, "</s>"]), sum(count.values()))
        assert math.isclose(r.score, sum(math.log10(p(u, v)) for u, v in zip(["<s>", *ws], [*ws, "</s>"])), rel_tol=1e-6)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (sum(count.values()) + len(count) + 1)) for w in [*ws, "</s>"]), rel_tol=1e-9)
    assert sum(map(len, got.values())) == len(rows)
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    assert not model.pair_counts(np.sort(keys)).any() and len(model._maps) <= mapped
    for u in ("<s>", "alpha"):  # probabilities of all words and the unknown one sum to one
        assert math.isclose(sum(p(u, v) for v in count) + p(u, "?"), 1.0, rel_tol=1e-6)
    empty = ngram_lm.score(table, ngram_lm.train(table.limit(0))).collect()
    assert len(empty) == len(rows) and all(r.score == 0 and r.train_tokens == 0 for r in empty)


def test_pairs_and_sums_are_packed_whole():
    rng = np.random.default_rng(2)
    u, v = (np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))[rng.integers(0, 300, 5000)] for _ in range(2))
    u, v, n = ngram_lm._counted([u], [v])
    n = n * rng.integers(1, 1 << 30, len(n))
    cuts = list(ngram_lm._cuts(ngram_lm.pair_hash(u, v), 7))
    back = [ngram_lm._unpack(ngram_lm._pack(u[part], v[part], n[part])) for _, part in cuts]
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*back)))) == sorted(zip(u.tolist(), v.tolist(), n.tolist()))
    assert all((ngram_lm.shard_of(ngram_lm.pair_hash(*x[:2]), 7) == s).all() for (s, _), x in zip(cuts, back))
    sums = rng.integers(-(1 << 62), 1 << 62, (7, 900))
    assert (ngram_lm._unpack_sums(ngram_lm._pack_sums(sums)) == sums).all()


# --- pipeline -------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(120):
        t = "\n".join(words(1000 * i + k, 12) for k in range(5))
        if i % 4 == 0:
            t = " ".join(w + "$$$" for w in t.split())
        labels.append((i, int(i % 4 != 0), 0))
        rows.append((i, t))
    rows += [(200 + i, rows[i][1]) for i in (1, 2, 3)]  # copies
    passage = "\n".join(words(77_000 + k, 14) for k in range(4))
    rows += [(300 + i, "\n".join(words(99_000 + 10 * i + k, 12) for k in range(4)) + "\n" + passage) for i in range(3)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if name != "packing":
            assert now.columns == columns
            kept[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(kept["quality"]) == {i for i, _ in rows if i >= 200 or i % 4}  # junk goes, clean documents stay
    assert kept["language"] == kept["quality"]
    assert set(kept["line_dedup"]) == set(kept["language"])
    assert passage in kept["line_dedup"][300] and all(passage.split("\n")[1] not in kept["line_dedup"][i] for i in (301, 302))
    assert all(kept["line_dedup"][200 + i] == "" for i in (1, 2, 3))
    assert {i for i in kept["near_dedup"] if i >= 200} == {201, 300, 301, 302}  # of the emptied copies one stays
    assert {r.doc_id for r in now.collect()} == set(kept["near_dedup"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == now.count() and rng is not None
