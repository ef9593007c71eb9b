"""Operators on hand-made frames: nulls, empty tables, ties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.errors import StoreError
from tidemark.functions import order
from tidemark.operators import access, mutate, position, queue, relate, shapes
from tidemark.plans import ordered


def test_encodings(spark):
    keys = [b"aaa-z", b"bbb-a", b"ccc-m", b"\x80\xff", b"\xff\x00\x80"]
    df = spark.createDataFrame([(k,) for k in keys], "k binary").select("k", order.reverse_bytes("k").alias("r"))
    assert all(bytes(r.r) == bytes(r.k)[::-1] for r in df.collect())
    numbers = [0, 1, 255, 256, 2**63, 2**64 - 1]
    rows = spark.createDataFrame([(str(n),) for n in numbers], "s string").selectExpr("cast(s as decimal(20,0)) as n")
    got = rows.select("n", order.big_endian(rows.n).alias("b"), order.integer_of(order.little_endian(rows.n)).alias("back")).collect()
    assert all(bytes(r.b) == int(r.n).to_bytes(8, "big") and r.back == r.n for r in got)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=5), st.binary(max_size=5))
def test_successor_and_separator(p, q):
    after = order.successor(p)
    if after is None:
        assert not p.strip(b"\xff")
    else:
        assert p < after and all(not x.startswith(p) for x in (after, after + b"\0")) and p + b"\xff" * 9 < after
    a, b = sorted((p, q))
    if a < b:
        s = order.separator(a, b)
        assert a < s <= b


def test_fold_against_a_model(spark):
    rng = random.Random(7)
    base = {k: f"b{k}" for k in range(0, 30, 2)}
    ops = [(i, rng.choice(mutate.OPS), rng.randrange(12) if rng.random() < 0.8 else rng.randrange(40), rng.choice([None, f"v{i}"])) for i in range(9000)]
    model, said = dict(base), {}
    for i, op, k, v in ops:
        there = k in model
        done = {"upsert": True, "insert_unique": not there, "update_only": there, "erase": there}[op]
        said[i] = done
        if done and op == "erase":
            del model[k]
        elif done:
            model[k] = v
    b = spark.createDataFrame(list(base.items()), "k int, v string")
    o = spark.createDataFrame(ops, "seq long, op string, k int, v string")
    assert {r.k: r.v for r in mutate.fold(b, o, "k", "v").collect()} == model
    assert {r.seq: r.done for r in mutate.outcomes(b, o, "k").collect()} == said
    assert mutate.fold(b.limit(0), o.limit(0), "k", "v").count() == 0


def test_ordered_helpers(spark):
    df = spark.createDataFrame([(k, 1) for k in range(0, 200, 2)], "k int, n int")
    assert sorted((r.k, r["rank"]) for r in position.ranks(df, "k").collect()) == [(k, k // 2) for k in range(0, 200, 2)]
    got = {r.k: (r.prev, r["next"]) for r in position.neighbours(df, "k").collect()}
    assert got[0] == (None, 2) and got[100] == (98, 102) and got[198] == (196, None)
    probes = spark.createDataFrame([(-5,), (3,), (3,), (198,), (199,)], "p int")
    assert sorted((r.p, r.found if r.found is not None else -1) for r in position.seek_many(df, "k", probes, "p").collect()) == [(-5, 0), (3, 4), (3, 4), (198, 198), (199, -1)]
    assert [r.k for r in position.skip(df, "k", 33).collect()] == [66] and position.skip(df, "k", 100).count() == 0
    assert ordered.ranked(df.limit(0), ["k"]).count() == 0


def test_points_and_batches(spark):
    df = spark.createDataFrame([(b"a", b""), (b"b", None), (b"ab", b"x")], "k binary, v binary")
    assert access.contains(df, "k", b"b") and not access.contains(df, "k", b"c")
    with pytest.raises(StoreError, match="NotFound"):
        access.at(df, "k", b"zz")
    probes = spark.createDataFrame([(0, b"b"), (1, b"no"), (2, b"a"), (3, b"b")], "pos int, k binary")
    assert [(r.pos, r.found) for r in access.find_many(df, "k", probes).collect()] == [(0, True), (1, False), (2, True), (3, True)]
    assert [bytes(r.k) for r in access.visit(df, "k", b"a").collect()] == [b"a", b"ab"]
    assert position.count_range(df, "k", b"", b"").first()[0] == 3 and position.count_range(df, "k", b"b", b"a").first()[0] == 0
    up = mutate.upsert(df, spark.createDataFrame([(b"a", None), (b"z", b"")], "k binary, v binary"), "k")
    assert {bytes(r.k): r.v for r in up.collect()} == {b"a": None, b"b": None, b"ab": bytearray(b"x"), b"z": bytearray(b"")}


def test_shapes(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 20), ("a", 5000, 5001), ("b", 1, 2)], "p string, s long, e long")
    assert sorted((r.p, r.lo, r.hi, r.n) for r in shapes.merged_spans(spans, "p", "s", "e", 100).collect()) == [("a", 0, 20, 2), ("a", 5000, 5001, 1), ("b", 1, 2, 1)]
    kinds = spark.createDataFrame([("x", i, k) for i, k in enumerate(["a", "a", None, None, "b", "a"])], "p string, i int, k string")
    assert sorted(((r.k or "", r.first, r.last, r.n) for r in shapes.runs(kinds, "p", "i", "k").collect())) == [("", 2, 3, 2), ("a", 0, 1, 2), ("a", 5, 5, 1), ("b", 4, 4, 1)]
    empty = spans.limit(0)
    assert shapes.merged_spans(empty, "p", "s", "e").count() == 0
    assert mutate.append_violations(spark.createDataFrame([(0, 5), (1, 5), (2, 7)], "seq int, k int"), "k", "seq").first()[0] == 1


def test_conflicts(spark):
    touched = spark.createDataFrame([(1, 5, "a", b"k"), (2, 9, "a", b"k"), (3, 5, "b", None), (4, 5, "c", b"q")], "txn long, snapshot long, db string, key binary")
    log = spark.createDataFrame([(7, "a", b"k", False), (8, "b", b"z", False), (6, "c", None, False)], "commit_txn long, db string, key binary, unknown boolean")
    assert sorted(r.txn for r in relate.conflicts(touched, log).collect()) == [1, 3, 4]
    unknown = spark.createDataFrame([(7, None, None, True)], log.schema)
    assert sorted(r.txn for r in relate.conflicts(touched, unknown).collect()) == [1, 3, 4]


def test_queue_options():
    with pytest.raises(StoreError):
        queue.check_options("x" * 49, 1, 0, 1)


def test_outcomes_of_a_hot_key_run_in_chunks(spark, monkeypatch):
    """A key with nearly all operations: chunk by chunk, as one by one."""
    monkeypatch.setattr(mutate, "CHUNK", 16)
    rng = random.Random(7)
    ops = [(i, rng.choice(mutate.OPS), "hot" if i % 9 else rng.choice("abc")) for i in range(400)]
    base = {"hot", "a"}
    want, there = {}, set(base)
    for i, op, k in ops:
        want[i] = {"upsert": True, "insert_unique": k not in there, "update_only": k in there, "erase": k in there}[op]
        there = there - {k} if op == "erase" else there | {k} if op in ("upsert", "insert_unique") else there
    df = spark.createDataFrame(ops, "seq long, op string, k string")
    got = mutate.outcomes(spark.createDataFrame([(k,) for k in base], "k string"), df, "k")
    assert {r.seq: r.done for r in got.collect()} == want and got.columns == ["k", "seq", "op", "done"] or set(got.columns) == {"k", "seq", "op", "done"}
