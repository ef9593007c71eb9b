"""The packing search against brute force over all exchanges."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing


def raises_squares(sizes, bins, capacity):
    """Whether one item or two of a sequence can go to an underfull one, for nothing, one item or (one for) two, so that squared fills grow."""
    fill = [int(sizes[b].sum()) for b in bins]
    under = [k for k, f in enumerate(fill) if 0 < f < capacity]
    ones = {k: {int(sizes[i]) for i in bins[k]} for k in under}
    twos = {k: {int(sizes[i] + sizes[j]) for i, j in combinations(bins[k], 2)} for k in under}
    for a in under:
        for b in under:
            if a != b:
                for given, back in ((ones[a], {0} | ones[b] | twos[b]), (twos[a], ones[b])):
                    if any(0 < g - s <= capacity - fill[b] and fill[b] + g - s > fill[a] for g in given for s in back):
                        return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_search_ends_where_no_exchange_helps(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 90) if seed % 2 else rng.integers(20, 45, 90)
    order, bins, room = rng.permutation(90), [[]], 100
    for i in order.tolist():  # next fit: a poor start
        if sizes[i] > room:
            bins.append([])
            room = 100
        bins[-1].append(i)
        room -= int(sizes[i])
    search = packing.Search(sizes, bins, 100)
    before = int((search.fill**2).sum())
    search.improve()
    assert sorted(i for b in search.bins for i in b) == list(range(90)) and (search.fill <= 100).all() and int((search.fill**2).sum()) > before
    assert all(f == sizes[b].sum() for f, b in zip(search.fill, search.bins))
    left = [b for b in search.bins if b]
    assert len(left) == -(-int(sizes.sum()) // 100) or not raises_squares(sizes, left, 100)


def test_pack_searches_all_underfull_sequences(monkeypatch):
    """The sequences that can exchange are not among the 200 emptiest."""
    wide, sizes, bins = 300, [], []
    for own in [[510]] * wide + [[300, 300], [200, 300, 399]] * 5 + [[700]] * 5:
        bins.append(list(range(len(sizes), len(sizes) + len(own))))
        sizes += own
    sizes = np.array(sizes)
    monkeypatch.setattr(packing, "best_fit", lambda sizes, capacity: [list(b) for b in bins])
    packed = packing.pack(sizes, shakes=0)
    assert sorted(i for b in packed for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 1024 for b in packed)
    assert len(packed) == -(-int(sizes.sum()) // 1024) or not raises_squares(sizes, packed, 1024)


def test_search_empties_sequences_of_best_fit():
    saved = 0
    for seed in range(4):
        sizes = np.minimum(np.random.default_rng(seed).lognormal(5.9, 0.6, 400).astype(int) + 1, 1023)
        packed = packing.pack(sizes, shakes=300_000)
        assert sorted(i for b in packed for i in b) == list(range(400)) and all(0 < sizes[b].sum() <= 1024 for b in packed)
        assert -(-int(sizes.sum()) // 1024) <= len(packed) <= len(packing.best_fit(sizes, 1024))
        saved += len(packing.best_fit(sizes, 1024)) - len(packed)
        assert packed == packing.pack(sizes, shakes=300_000)  # repeatable
    assert saved >= 3


def test_rounds_open_underfull_sequences_again(spark, monkeypatch):
    """Several groups, equal rows among them: dealt evenly, packed in rounds, no piece lost."""
    rng = random.Random(1)
    monkeypatch.setattr(packing, "GROUP", 120)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 700))) for i in range(500)] + [(None, "word " * 90)] * 250
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(table, bpe.vocabulary_path()).collect()
    assert len(got) == 750 and got[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 2
    largest = packing._round(spark.range(900).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "91L length", "7L ids_crc32", "id row"), 8, 0, 1024).groupBy((F.col("sequence_id").bitwiseAND((1 << 56) - 1) / (1 << 24)).cast("int")).count()
    assert largest.agg(F.max("count")).first()[0] < 200  # equal rows are dealt over all groups
