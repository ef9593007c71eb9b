"""The near-duplicate stage against brute force over five-word shingles."""

import os
import random
import time
from collections import Counter, defaultdict

import corpus_pipeline
from tidemark import session
from tidemark.llm import similar

STAGE = dict(corpus_pipeline.STAGES)["near_dedup"]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*(w[i:] for i in range(5))))


def kept_brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    of = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        of[root(i)].append(doc)
    return {min(d for d in ids if d is not None) for ids in of.values() if any(d is not None for d in ids)}


def test_stage_links_all_similar_texts(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, common = [], text(12)
    for k in range(12):
        base, n = text(rng.choice([40, 120, 400])), len(rows)
        for i in range(9):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                own[rng.randrange(len(own))] = "changed"
            rows.append((n + i, " ".join(own + (common if i % 3 == 0 else []))))
    rows += [(900 + i, " ".join(text(6) + common)) for i in range(20)]  # a common passage alone is no copy
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c"), (None, rows[0][1]), (None, "only here"), (1000, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (8192, 8):
        monkeypatch.setattr(similar, "SAMPLE", sample)
        got = STAGE(spark, table, "").collect()
        assert Counter(r.doc_id for r in got if r.doc_id is not None) == Counter(kept_brute(rows))
        assert sum(r.doc_id is None for r in got) == 2
    assert STAGE(spark, table.limit(0), "").count() == 0


def test_copies_that_differ_in_many_bits_go(spark):
    """A Jaccard similarity of 0.8 is mostly more than three bits of a fingerprint."""
    rng = random.Random(1)
    rows = []
    for k in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(100)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(["new", *base[1:50], "new", *base[51:]]))]
    kept = STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == set(range(0, 40, 2))


def test_rows_of_one_id_with_unrelated_texts_both_stay(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    one, two = text(50), text(50)
    rows = [(7, one, "x"), (7, two, "y"), (7, one, "a"), (8, two, "z"), (9, one + " end", "z")]
    kept = STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string, own string"), "")
    assert sorted(map(tuple, kept.collect())) == sorted([(7, one, "a"), (7, two, "y")])  # of equal rows the smallest


def test_components_split_a_hub(spark):
    """A third of all links meet in one vertex; the join with the minima is split where it is skewed."""
    from tidemark.llm import components as c

    links = spark.range(30_000).selectExpr("id + 10 as a", "if(id % 3 = 0, 0, id + 11) as b").where("b < 30010")
    got = c.components(links.selectExpr("greatest(a, b) as a", "least(a, b) as b"))
    want = {}
    parent = list(range(30_011))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in links.collect():
        a, b = root(r.a), root(r.b)
        parent[max(a, b)] = min(a, b)
    want = {r.vertex: r.component for r in got.collect()}
    assert want and all(root(v) == m for v, m in want.items()) and len(want) == len({x for r in links.collect() for x in (r.a, r.b)})


def shuffle_files(spark):
    """Of this process, by name."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for top in folders for _, _, names in os.walk(str(top)) for name in names if name.startswith("shuffle_")}


def test_stage_frees_its_disk_on_the_way(spark, monkeypatch):
    """Shuffle files go with their job, tables of whole documents' shingles before texts meet."""
    rng = random.Random(4)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(60)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:59], "new"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    before, seen, write = shuffle_files(spark), [], session.materialize

    def spied(df, label):
        out = write(df, label)
        if label == "similar-texts":
            seen.append({os.path.basename(uri).rsplit("-", 1)[0] for uri in session._OWN})
        return out

    monkeypatch.setattr(similar, "materialize", spied)
    others = {os.path.basename(uri).rsplit("-", 1)[0] for uri in session._OWN}
    kept = STAGE(spark, table, "")
    for _ in range(50):  # they are removed beside the next job
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert len(seen) == 2 and not any((now - others) & {"shingles", "shingle-classes", "pivots", "labelled-shingles"} for now in seen)
    assert "similar-texts" in seen[0] and spark.conf.get(session._FREE, None) is None
    assert {r.doc_id for r in kept.collect()} == set(range(0, 80, 2))
