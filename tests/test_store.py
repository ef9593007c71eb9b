"""The store against a model, and its edges."""

import random

import pytest

from tidemark.errors import Code, StoreError
from tidemark.functions.order import MAX_KEY, REVERSE, U32, U64
from tidemark.plans import inspect, manifest
from tidemark.plans.store import Store


def rows(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def raises(code):
    return pytest.raises(StoreError, match=code.value)


def key(i, prefix="key"):
    return f"{prefix}:{i:012d}".encode()


@pytest.fixture
def store(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), rows_per_file=40) as s:
        yield s


def test_put_modes(store):
    with store.write() as t:
        said = t.apply([("upsert", b"k", b"v1"), ("insert_unique", b"k", b"v2"), ("update_only", b"k", b"v3"), ("upsert", b"k", b"v4"), ("update_only", b"absent", b"x")])
        assert said == [True, False, True, True, False]
        with pytest.raises(StoreError, match="KeyExists"):
            t.reserve(b"k", b"x", mode="insert_unique")
        assert t.get(b"k") == b"v4"
    with store.read() as s:
        assert rows(s.all()) == [(b"k", b"v4")]
        with raises(Code.NOT_FOUND):
            s.at(b"absent")


def test_against_a_model(store):
    rng, model = random.Random(12345), {}
    for _ in range(4):
        batch = []
        for _ in range(120):
            k, x = key(rng.randrange(150)), rng.random()
            v = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(0, 9)))
            batch.append(("upsert", k, v) if x < 0.45 else ("insert_unique", k, v) if x < 0.55 else ("update_only", k, v) if x < 0.65 else ("erase", k, None))
        said = []
        for op, k, v in batch:
            there = k in model
            done = {"upsert": True, "insert_unique": not there, "update_only": there, "erase": there}[op]
            said.append(done)
            if done and op == "erase":
                del model[k]
            elif done:
                model[k] = v
        with store.write() as t:
            assert t.apply(batch) == said
        assert inspect.check(store) == []
        with store.read() as s:
            assert rows(s.all()) == sorted(model.items())
            assert s.count() == len(model)
            keys = sorted(model)
            for _ in range(4):
                lo, hi = sorted((key(rng.randrange(160)), key(rng.randrange(160))))
                assert s.count_range(lo, hi) == sum(lo <= k < hi for k in keys)
                assert s.rank(lo) == sum(k < lo for k in keys)
            n = rng.randrange(len(keys))
            assert rows(s.skip(n)) == [(keys[n], model[keys[n]])]
            assert rows(s.skip(len(keys))) == []
            asked = [key(rng.randrange(170)) for _ in range(8)]
            assert s.find_many(asked) == [model.get(k) for k in asked]
    with store.write() as t:
        t.clear()
    assert rows(store.snapshot().all()) == []


def test_ranges_and_prefixes(store):
    with store.write() as t:
        t.put_many([(key(i), b"") for i in range(100)])
        t.put_many([(b"user:%d" % i, b"u") for i in range(40)] + [(b"\xff\xff", b"top"), (b"\xff\xff\x01", b"above")])
    with store.read() as s:
        assert s.between(key(10), key(20)).count() == 10
        assert s.upto(key(7)).count() == 7
        assert s.upto(b"").count() == 0  # below the empty key
        assert s.count_range(key(95), b"") == 5 + 42  # an empty bound is none
        assert s.count_range(key(9), key(3)) == 0
        assert s.prefix(b"user:").count() == 40
        assert s.prefix(b"\xff").count() == 2
        assert rows(s.seek(b"user:")) == [(b"user:0", b"u")]
        assert rows(s.seek(b"\xff\xff\xff")) == []
        assert rows(s.first()) == [(key(0), b"")] and rows(s.last())[0][0] == b"\xff\xff\x01"


def test_orders(store):
    with store.write() as t:
        t.db("hosts", REVERSE)
        t.put_many([(b"aaa-z", b""), (b"bbb-a", b""), (b"ccc-m", b"")], "hosts")
        t.put_many([(b"h%d.example.com" % i, b"e") for i in range(20)], "hosts")
        t.db("n", U64)
        t.put_many([((i * 2654435761 % 100000).to_bytes(8, "little"), b"") for i in range(60)], "n")
    with store.read() as s:
        assert [k for k, _ in rows(s.all("hosts"))][:1] == [b"bbb-a"]
        assert s.prefix(b".example.com", "hosts").count() == 20
        got = [int.from_bytes(k, "little") for k, _ in rows(s.all("n"))]
        assert got == sorted(got) and len(got) == 60
        with raises(Code.INVALID_ARGUMENT):
            s.get(b"x", "n")
        assert s.dbs() == ["hosts", "n"]
    with raises(Code.INCOMPATIBLE), store.write() as t:
        t.db("hosts", U32)
    with raises(Code.INVALID_ARGUMENT), store.write() as t:
        t.db("m", U32, prefix_keys=True)


def test_limits_break_the_transaction(store):
    with store.write() as t:
        t.put(b"x" * MAX_KEY, b"")
    for bad in (b"", b"x" * (MAX_KEY + 1)):
        with pytest.raises(StoreError), store.write() as t:
            try:
                t.put(bad, b"v")
            except StoreError:
                with raises(Code.BAD_TRANSACTION):
                    t.put(b"fine", b"v")
                raise
    assert store.snapshot().count() == 1


def test_snapshots_and_no_commit_without_change(store):
    for v in (b"first", b"second"):
        with store.write() as t:
            t.put(b"v", v)
    old = store.snapshot()
    with store.write() as t:
        t.put(b"v", b"third")
    assert old.get(b"v") == b"second" and store.snapshot().get(b"v") == b"third"
    before = store.version
    with store.write():
        pass
    assert store.version == before
    old.close()


def test_nested(store):
    with store.write() as t:
        t.put(b"keep", b"1")
        with t.nested():
            t.put(b"inner", b"2")
        try:
            with t.nested():
                t.put(b"gone", b"3")
                t.erase(b"keep")
                raise RuntimeError
        except RuntimeError:
            pass
        assert t.contains(b"keep") and not t.contains(b"gone")
    assert [k for k, _ in rows(store.snapshot().all())] == [b"inner", b"keep"]


def test_append(spark, store):
    batch = lambda ks: spark.createDataFrame([(i, k, b"v") for i, k in enumerate(ks)], "seq long, key binary, value binary")
    with store.write() as t:
        t.append(batch([key(i) for i in range(100)]))
    with store.write() as t:
        t.append(batch([key(100)]))
    for bad in ([key(50)], [key(100)], [key(102), key(101)]):
        with raises(Code.INVALID_ARGUMENT), store.write() as t:
            t.append(batch(bad))
    assert store.snapshot().count() == 101 and inspect.check(store) == []


def test_compact_shrink_vacuum_copy(spark, store, tmp_path):
    with store.write() as t:
        t.put_many([(key(i), b"x" * 20) for i in range(200)])
    with store.write() as t:
        t.erase_many([key(i) for i in range(200) if i % 5])
    want = rows(store.snapshot().all())
    dense = store.compact(str(tmp_path / "dense"))
    assert rows(dense.snapshot().all()) == want and dense.store_id != store.store_id and inspect.check(dense) == []
    with store.read() as s:
        store.copy_snapshot(s, str(tmp_path / "copy"))
    assert manifest.recover(str(tmp_path / "copy"))[0].checkpoint == store.checkpoint()
    store.snapshot().close()
    for name in list(store.pins()):
        pass
    files = len(store.manifest.paths())
    assert store.shrink() > 0 and len(store.manifest.paths()) < files
    assert rows(store.snapshot().all()) == want and inspect.check(store) == []


def test_recovery_passes_over_a_broken_version(spark, store):
    for v in (b"1", b"2"):
        with store.write() as t:
            t.put(b"k", v)
    good = store.version - 1
    broken = next(iter(store.manifest.paths()))
    with open(f"{store.path}/{broken}", "ab") as f:
        f.write(b"torn")
    again = Store.open(spark, store.path)
    assert again.version == good and again.rolled_back == good + 1 and again.snapshot().get(b"k") == b"1"


def test_check_finds_damage(spark, store):
    with store.write() as t:
        t.put_many([(key(i), b"v") for i in range(50)])
    path = f"{store.path}/{sorted(store.manifest.paths())[0]}"
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(path, "wb").write(raw)
    assert any("digest" in x for x in inspect.check(store))
    with raises(Code.CORRUPTED):
        Store.open(spark, store.path, verify_reads=True).snapshot().all()


def test_open_options(spark, tmp_path, store):
    with raises(Code.NOT_FOUND):
        Store.open(spark, str(tmp_path / "none"), create_if_missing=False)
    with raises(Code.KEY_EXISTS):
        Store.open(spark, store.path, error_if_exists=True)
    with raises(Code.READ_ONLY), Store.open(spark, store.path, read_only=True).write():
        pass
    with store.writer(), raises(Code.BUSY), store.write(timeout=0.05):
        pass
    lazy = Store.open(spark, str(tmp_path / "lazy"), sync="none")
    with lazy.write() as t:
        t.put(b"a", b"1")
    assert lazy.snapshot().get(b"a") == b"1" and manifest.versions(lazy.path) == [0]
    lazy.close()
    assert manifest.versions(lazy.path) == [0, 1]
    small = Store.open(spark, str(tmp_path / "small"), max_size=10, max_dbs=1)
    with raises(Code.MAP_FULL), small.write() as t:
        t.put(b"a", b"1" * 100)
    with raises(Code.TOO_MANY_DBS), small.write() as t:
        t.db("a"), t.db("b")
    assert inspect.stats(store)["version"] == store.version
    assert inspect.trees(store).count() == 1 and inspect.metas(store).count() >= 1


def test_check_reads_the_order_inside_files(spark, tmp_path):
    import pyarrow.parquet as pq

    from tidemark.plans import inspect
    from tidemark.plans.store import digest_of

    with Store.open(spark, str(tmp_path / "s")) as s:
        with s.write() as t:
            t.put_many([(b"k%02d" % i, b"v") for i in range(20)])
        groups = inspect.row_groups(s).collect()
        assert sum(r.rows for r in groups) == 20 and all(r.bytes > 0 for r in groups)
        (f,) = s.manifest.main.files
        table = pq.read_table(f"{s.path}/{f.path}")
        pq.write_table(table.take([1, 0, *range(2, 20)]), f"{s.path}/{f.path}")
        f.digest = digest_of(f"{s.path}/{f.path}")
        assert any("not above" in x for x in inspect.check(s))


def test_reader_lag_is_told_at_commit(spark, tmp_path):
    told = []
    with Store.open(spark, str(tmp_path / "s"), on_reader_lag=lambda oldest, now: told.append((oldest, now))) as s:
        with s.write() as t:
            t.put(b"a", b"1")
        assert not told
        snap = s.snapshot()
        with s.write() as t:
            t.put(b"a", b"2")
        assert told == [(snap.id, s.version)]
        snap.close()


def test_lazy_commits_become_durable_in_the_background(spark, tmp_path):
    import time

    s = Store.open(spark, str(tmp_path / "s"), sync="lazy", sync_interval=1e9, background_sync=True)
    s.options.sync_interval = 1.5
    with s.write() as t:
        t.put(b"a", b"1")
    s._synced_at = time.monotonic()
    assert manifest.versions(s.path) == [0] or manifest.versions(s.path) == [0, 1]
    end = time.time() + 20
    while manifest.versions(s.path) == [0] and time.time() < end:
        time.sleep(0.1)
    assert Store.open(spark, s.path).snapshot().get(b"a") == b"1"
    s.close()
